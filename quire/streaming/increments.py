"""Incremental passages, job states and a log tail as streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.passages import passages


def stream_passages(spark: SparkSession, source: str, out: str, checkpoint: str, files: int = 1) -> None:
    """Cut passages of new section files only and append them; what is done is in the checkpoint.

    One pass over what is there now; a restart goes on after the last finished batch.
    """
    sections = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)
    query = passages(sections).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


# States in the order in which a job may pass through them.
STATES = "queued running done error canceled".split()


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job from an event log with repeats and late entries.

    Finished states stay whatever comes later; of others the latest event counts. Works on
    batches and, in complete mode, on streams.
    """
    ended = F.col("state").isin("done", "error", "canceled")
    order = F.struct("ts", "event_id")
    return events.groupBy("job").agg(
        F.coalesce(F.min_by(F.when(ended, F.col("state")), F.when(ended, order)), F.max_by("state", order)).alias("state"), F.count("*").alias("events"), F.max("ts").alias("last")
    )


# Levels of log entries, from the least to the most severe.
LEVELS = ("verbose", "debug", "info", "warn", "error")


def log_tail(log: DataFrame, since: int, level: str | None = None, search: str | None = None, category: str | None = None) -> DataFrame:
    """Entries (event_id, level, event_type, props) after an id, of a level or a more severe one, of a category, whose message holds a text whatever the case.

    An unknown level is no floor; entries of an unknown level count as the least severe.
    """
    rank = lambda v: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in LEVELS)), v), F.lit(0)), F.lit(1))
    out = log.where(F.col("event_id") > since)
    out = out.where(rank(F.col("level")) > LEVELS.index(level)) if level in LEVELS else out
    out = out if category in (None, "", "all") else out.where(F.col("event_type") == category)
    return out if not search else out.where(F.contains(F.lower("props"), F.lit(search.lower())))


def merge_batches(spark: SparkSession, source: str, out: str, checkpoint: str, delta: Callable[[DataFrame], DataFrame], files: int = 1) -> None:
    """New files below ``source`` in micro-batches, each reduced by ``delta`` and put down under its number.

    A batch replaces what is there under its number, so one that ran before the job was killed and
    runs again counts once, and a restart goes on after the last batch in ``checkpoint``. Work and
    writes are in proportion to the new files; ``merged_batches`` folds what the batches left.
    """

    def put(rows: DataFrame, number: int) -> None:
        delta(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged_batches(spark: SparkSession, out: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all batches, with their number as ``batch``, folded by key."""
    return fold(spark.read.parquet(out))


def facts_delta(rows: DataFrame) -> DataFrame:
    """Facts (owner, key, ord, text, chapter) reduced to one row a key; the same fold serves batches and their union.

    The text is that of least ``ord``, whichever batch it came in; the chapter is the earliest
    known one (0 is unknown).
    """
    return rows.groupBy("owner", "key").agg(
        F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"), F.coalesce(F.min(F.nullif(F.col("chapter"), F.lit(0))), F.lit(0)).alias("chapter")
    )
