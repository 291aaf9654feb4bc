"""Numbering and running sums inside groups, one of which may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shared import materialize


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, order: str, name: str, values: DataFrame | None = None) -> DataFrame:
    """``df`` with the range of ``order`` that a row is in, as ``name``: about as many rows in each, whatever the values.

    Bounds are percentiles of the column, found when the query runs by a scan of it alone, in
    ``values`` if that is given (a table with the column that is cheaper to scan). Ranges hold
    whole values, and the rows of a group in one range are no more than all rows in it, so no
    group makes a range larger. Null values are in no range.
    """
    n = max(2, _parts(df))
    points = F.array(*(F.lit(i / n) for i in range(1, n)))
    bounds = (df if values is None else values).select(F.col(order).cast("long").alias("__v")).agg(F.percentile_approx("__v", points, F.lit(100 * n)).alias("__p"))
    bounds = bounds.select(F.array_sort(F.array_distinct(F.coalesce("__p", F.array().cast("array<bigint>")))))
    cut = df.withColumn("__bounds", bounds.scalar())
    return cut.withColumn(name, F.size(F.filter("__bounds", lambda b: b < F.col(order)))).drop("__bounds")


def running_before(df: DataFrame, group: str, order: str, weight: Column, name: str, values: DataFrame | None = None) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows of the group before the row, as ``name``.

    ``order`` is an integer, unique in the group. Rows are summed in ranges of ``order`` that hold
    about as many rows each, and the ranges of a group are summed up by themselves, so no task
    sorts a whole group. ``values`` is as in ``in_ranges``.
    """
    cut = in_ranges(df, order, "__b", values).withColumn("__w", weight)
    inside = Window.partitionBy(group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(group, "__b").agg(F.sum("__w").alias("__t"))
    ahead = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__base"))
    local = cut.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    joined = local.join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    return joined.select(*df.columns, (F.col("__base") + F.col("__in")).cast("long").alias(name))


def numbered(df: DataFrame, group: str, order: str, name: str = "position", start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in the group by ``order``."""
    return running_before(df, group, order, F.lit(1), "__n").withColumn(name, F.col("__n") + start).drop("__n")


#: Rows that a task is to sort at most, where rows are counted first.
SORTED = 250_000


def parts_for(count: int, rows: DataFrame) -> int:
    """Partitions for so many rows: the session's number, more where that would leave a task over SORTED."""
    return max(_parts(rows), -(-count // SORTED))


def numbered_rows(rows: DataFrame, group: str, *order: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """``rows`` with numbers from 0 in the group by ``order``, whose columns may be of any type and tie.

    Meant for narrow rows: they are ranged by group and order, written once with their place in the
    partition, and the counts of a partition's groups are summed up, so a group may hold any share
    of the rows. Rows alike in all of ``order`` are dealt to several partitions and come in any order.
    ``parts`` is the number of ranges, the session's shuffle partitions if not given.
    """
    keys = [group, *order, "__tie"]
    placed = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts or _parts(rows), *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"__p": F.shiftright("__at", 33), "__i": F.col("__at").bitwiseAND((1 << 33) - 1)})
    parts = placed.groupBy(group, "__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    ahead = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__base"))
    joined = placed.join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return joined.select(*rows.columns, (F.col("__base") + F.col("__i")).alias(name))
