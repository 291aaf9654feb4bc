"""Rows as files: round trips, failed jobs that leave what was there, names that stay below their folder."""

import json

import pytest
from pyspark.sql import functions as F

from quire.sources import files

SECTIONS = "book string, number int, title string, text string"


def test_sections_and_artefacts_come_back(spark, tmp_path):
    rows = [("Böok One", i, f"Chapter {i}: The Gate", f"Text {i} – ünï\n\nend") for i in range(1, 40)] + [("Böok One", 1000, None, ""), (None, 1, "—", None), ("b", 2, "x" * 200, "w " * 50_000)]
    made = files.section_files(spark.createDataFrame(rows, SECTIONS)).repartition(5)
    path = f"file://{tmp_path}/sections"
    files.write_files(made, path)
    back = files.read_files(spark, path)
    assert back.columns == made.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    names = {r.file for r in back.collect()}
    assert {"book-one/001-chapter-1-the-gate.txt", "book-one/1000-section.txt", "book/001-section.txt"} <= names
    files.write_files(made.where("number = 1"), path)  # the whole is replaced
    assert files.read_files(spark, path).count() == 2
    files.write_files(made.where("number = 2"), path, mode="append")
    assert files.read_files(spark, path).count() == 4 and sum(p.name.startswith("job-") for p in (tmp_path / "sections").iterdir()) == 2
    reports = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "name string, n int, note string")
    files.write_files(files.artefact(reports, "name", "n", "note"), f"{tmp_path}/reports")
    got = {r.file: json.loads(r.text) for r in files.read_files(spark, f"{tmp_path}/reports").collect()}
    assert got == {"a.json": {"n": 1, "note": None}, "b.json": {"n": 2, "note": "x"}}
    assert files.read_files(spark, f"{tmp_path}/reports").select(F.from_json("text", "n int, note string").alias("j")).where("j.n = 2 AND j.note = 'x'").count() == 1


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/f"
    good = spark.createDataFrame([(f"d/{i}.txt", f"t{i}") for i in range(20)], "file string, text string").repartition(4)
    files.write_files(good, path)
    bad = good.withColumn("text", F.when(F.col("file") == "d/7.txt", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(bad, path)
    assert sorted(map(tuple, files.read_files(spark, path).collect())) == sorted(map(tuple, good.collect()))
    assert sum(p.name.startswith("job-") for p in (tmp_path / "f").iterdir()) == 1
    for name in ("../out.txt", "/etc/x", ""):
        with pytest.raises(Exception, match="not a file below"):
            files.write_files(spark.createDataFrame([(name, "x")], "file string, text string"), path)
    assert not (tmp_path / "out.txt").exists() and files.read_files(spark, path).count() == 20


def test_a_changed_file_is_told(spark, tmp_path):
    path = f"{tmp_path}/f"
    files.write_files(spark.createDataFrame([("a.txt", "as written")], "file string, text string"), path)
    next(tmp_path.glob("f/job-*/task-*/a.txt")).write_text("changed")
    with pytest.raises(Exception, match="not what was written"):
        files.read_files(spark, path).collect()
