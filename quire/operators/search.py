"""Exact cosine search with citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions compared in one pass over the vectors; more are taken in blocks of so many.
BLOCK = 2048
#: Scores that a task holds at once: so many rows of a batch are compared with a block at a time.
HELD = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Length of a vector; 1 for a zero vector, so that it scores 0."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_passages(vectors: DataFrame, question: list[float], k: int, vector_col: str, position_col: str) -> DataFrame:
    """The ``k`` nearest rows, at least one and at most all, ties in order of position.

    Vectors of another width than the question's are an error, as they come from another model.
    """
    asked = F.array(*(F.lit(float(x)) for x in question))
    width = F.when(F.size(vector_col) == len(question), F.col(vector_col)).otherwise(F.raise_error(F.lit("vector width differs from the question's")))
    scored = vectors.where(F.col(vector_col).isNotNull()).withColumn("score", cosine(width, asked))
    return scored.orderBy(F.desc("score"), position_col).limit(max(1, k))


def top_of_questions(vectors: DataFrame, questions: DataFrame, k: int, vector_col: str = "embedding", position_col: str = "vec_id") -> DataFrame:
    """question, rank (from 1), position, score: the ``k`` nearest rows by cosine for every question.

    ``questions``: question (a long), vector. They go to the tasks in blocks of BLOCK, so what a
    task holds is bounded; each task keeps the ``k`` best of a block as it reads, HELD scores at a
    time, and these few are ranked together. Scores are rounded to 12
    places, as a product's last bits depend on the slice; ties go to the smaller position; a zero
    vector scores 0. Null vectors take no
    part; vectors of another width than the questions' are an error.
    """
    k = max(1, k)
    asked = questions.where("vector IS NOT NULL").select(F.col("question").cast("long").alias("question"), F.col("vector").cast("array<double>").alias("vector"))
    schema = "question long, position long, score double"
    found = vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(position_col).cast("long").alias("position"), F.col(vector_col).cast("array<double>").alias("vector"))
    held: list = []

    def compared(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], np.int64)
        unit = _units(np.array([r[1] for r in block], np.float64))

        step = max(1, HELD // len(ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    widths = set(pc.list_value_length(some.column("vector")).to_pylist())
                    if widths != {unit.shape[1]}:
                        raise ValueError(f"vectors have {sorted(widths)} dimensions, questions {unit.shape[1]}")
                    own = some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, unit.shape[1])
                    best = _best(*best, np.round(unit @ _units(own).T, 12), some.column("position").to_numpy(zero_copy_only=False), k)
            n = best[0].shape[1]
            made = [pa.array(np.repeat(ids, n)), pa.array(best[1].ravel()), pa.array(best[0].ravel())]
            yield pa.RecordBatch.from_arrays(made, ["question", "position", "score"])

        return rows.mapInArrow(run, schema)

    for r in asked.toLocalIterator():
        held.append((r.question, r.vector))
        if len(held) == BLOCK:
            found, held = found.unionByName(compared(held)), []
    if held:
        found = found.unionByName(compared(held))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "position"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("question", "rank", "position", "score")


def _best(score: np.ndarray, place: np.ndarray, new: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each question (row) among those held and the ``new`` scores at the places ``at``; ties go to the smaller place."""
    if score.shape[1] == k:  # few of the new ones reach what is held
        hit = ~(new < score[:, -1:]).all(0)  # so written, what is no number is passed on
        new, at = new[:, hit], at[hit]
    score = np.concatenate([score, new], 1)
    place = np.concatenate([place, np.broadcast_to(at, new.shape)], 1)
    order = np.lexsort((place, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)
