"""Vectors of passages written back by book and model, in parts and again, each once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.shared import materialize

KEYS = ("book", "model", "id")


def read_vectors(spark: SparkSession, path: str, schema: str = "id long, vector array<float>, book string, model string") -> DataFrame | None:
    """The vectors below ``path``, None if none have been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_back(incoming: DataFrame, path: str) -> None:
    """Put ``incoming`` (book, model, id, ord, vector) in place below ``path``.

    Only the partitions of books and models that come in are written anew, with what they held
    for other ids, so partial writes add up, and a write that is repeated changes nothing. Of
    several vectors of one id the last by ``ord`` counts. Vectors of one model that differ in
    width, among themselves or from those in place, are an error before anything is written.
    """
    spark = incoming.sparkSession
    once = incoming.where("vector IS NOT NULL").groupBy(*KEYS).agg(F.max_by("vector", "ord").alias("vector"))
    once = materialize(once, "incoming-vectors")
    stored = read_vectors(spark, path)
    rows = once.select("model", "vector")
    widths = (rows if stored is None else rows.unionByName(stored.join(once.select("model").distinct(), "model", "left_semi").select("model", "vector"))).groupBy("model").agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"))
    if bad := widths.where("least <> most").orderBy("model").first():
        raise ValueError(f"vectors of model {bad.model} have {bad.least} and {bad.most} dimensions")
    new = once
    if stored is not None:
        touched = stored.join(once.select("book", "model").distinct(), ["book", "model"], "left_semi")
        new = once.unionByName(touched.join(once.select(*KEYS), list(KEYS), "left_anti").select(*once.columns))
    new = materialize(new, "vectors").hint("rebalance", "book", "model")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book", "model").parquet(path)


def pending(passages: DataFrame, path: str, model: str) -> DataFrame:
    """The passages (book, id) that have no vector of ``model`` yet."""
    stored = read_vectors(passages.sparkSession, path)
    return passages if stored is None else passages.join(stored.where(F.col("model") == model).select("book", "id"), ["book", "id"], "left_anti")


def pending_counts(passages: DataFrame, stored: DataFrame, group: str = "book") -> DataFrame:
    """group, total and pending: its passages (group, id), and those among them without a vector in ``stored`` (id)."""
    have = stored.where("vector IS NOT NULL").select(F.col("id").alias("__id")).distinct()
    joined = passages.join(have, F.col("id") == F.col("__id"), "left")
    return joined.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col("__id").isNull()).alias("pending"))
