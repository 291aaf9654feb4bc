"""Batches that run again, vectors written in parts, many questions at once."""

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from quire.operators import search, vectors
from quire.streaming import increments

FACTS = "owner long, key string, ord long, text string, chapter long"
VECTORS = "book string, model string, id long, ord int, vector array<float>"


def test_a_killed_run_goes_on_and_counts_once(spark, tmp_path):
    """The second of three batches fails after its rows are written; the restart gives what one batch gives."""
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    parts = [[(1, "a", 5, "five", 0), (2, "b", 1, "one", 3)], [(1, "a", 2, "two", 7), (3, "c", 9, "nine", 0)], [(1, "a", 8, "eight", 4), (2, "b", 4, "four", 2)]]
    for part in parts:
        spark.createDataFrame(part, FACTS).coalesce(1).write.mode("append").parquet(source)
    seen = []

    def failing(rows):
        seen.append(rows.count())
        if len(seen) == 2:
            raise RuntimeError("lost")
        return increments.facts_delta(rows)

    with pytest.raises(StreamingQueryException):
        increments.merge_batches(spark, source, out, checkpoint, failing)
    assert len(spark.read.parquet(out).select("batch").distinct().collect()) == 1
    increments.merge_batches(spark, source, out, checkpoint, increments.facts_delta)
    increments.merge_batches(spark, source, out, checkpoint, increments.facts_delta)  # nothing new
    whole = increments.facts_delta(spark.createDataFrame(sum(parts, []), FACTS))
    merged = increments.merged_batches(spark, out, increments.facts_delta)
    assert sorted(map(tuple, merged.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    spark.createDataFrame([(1, "a", 1, "first", 1)], FACTS).write.mode("append").parquet(source)
    increments.merge_batches(spark, source, out, checkpoint, increments.facts_delta)
    by_key = {(r.owner, r.key): (r.text, r.chapter) for r in increments.merged_batches(spark, out, increments.facts_delta).collect()}
    assert by_key == {(1, "a"): ("first", 1), (2, "b"): ("one", 2), (3, "c"): ("nine", 0)}


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """The checkpoint is lost after all batches ran: the same numbers are written again."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(2):
        spark.createDataFrame([(1, "a", i, f"t{i}", i)], FACTS).coalesce(1).write.mode("append").parquet(source)
    for checkpoint in ("first", "second"):
        increments.merge_batches(spark, source, out, f"{tmp_path}/{checkpoint}", increments.facts_delta)
    assert spark.read.parquet(out).count() == 2


def test_vectors_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/v"
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert vectors.read_vectors(spark, path) is None
    first = make([("a", "m", 1, 1, [1.0, 0.0]), ("a", "m", 1, 2, [0.0, 1.0]), ("b", "m", 2, 1, [1.0, 1.0]), ("a", "m", 9, 1, None)])
    second = make([("a", "m", 3, 1, [2.0, 0.0]), ("a", "m", 1, 1, [5.0, 5.0]), ("a", "wide", 1, 1, [1.0, 2.0, 3.0])])
    for rows in (first, second, second):
        vectors.write_back(rows, path)
    got = sorted((r.book, r.model, r.id, list(r.vector)) for r in vectors.read_vectors(spark, path).collect())
    assert got == [("a", "m", 1, [5.0, 5.0]), ("a", "m", 3, [2.0, 0.0]), ("a", "wide", 1, [1.0, 2.0, 3.0]), ("b", "m", 2, [1.0, 1.0])]
    for bad in ([("a", "m", 7, 1, [1.0, 2.0, 3.0])], [("z", "new", 1, 1, [1.0]), ("z", "new", 2, 1, [1.0, 2.0])]):
        with pytest.raises(ValueError, match="dimensions"):
            vectors.write_back(make(bad), path)
    assert vectors.read_vectors(spark, path).count() == 4
    waiting = vectors.pending(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "book string, id long"), path, "m")
    assert [tuple(r) for r in waiting.collect()] == [("a", 2)]


def test_many_questions_against_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.integers(-2, 3, (300, 5)).astype(float)  # many ties
    rows[7] = 0
    asked = np.concatenate([rows[:20], np.zeros((1, 5))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(999, None)], "vec_id long, embedding array<double>").repartition(6)
    questions = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "question long, vector array<double>")
    monkeypatch.setattr(search, "BLOCK", 8)
    got = {}
    for r in search.top_of_questions(df, questions, 7).orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append((r.position, round(r.score, 9)))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = unit(asked) @ unit(rows).T
    for q in range(len(asked)):
        assert [s for _, s in got[q]] == [round(s, 9) for s in sorted(score[q], reverse=True)[:7]]
        assert all(abs(score[q][p] - s) < 1e-9 for p, s in got[q]) and len({p for p, _ in got[q]}) == 7
    assert [p for p, _ in got[20]] == list(range(7))
    assert search.top_of_questions(df.where("vec_id < 3"), questions, 7).where("question = 0").count() == 3
    assert search.top_of_questions(df, questions.where("question < 0"), 7).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        search.top_of_questions(df, spark.createDataFrame([(1, [1.0])], "question long, vector array<double>"), 2).count()
