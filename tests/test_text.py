import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import names, signals, text
from quire.operators.passages import passages, windows
from quire.sources import replies


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n😀", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_windows_cover_the_text(t, size, overlap):
    t = t.strip()
    found = list(windows(t, size, overlap))
    if not t:
        assert not found
        return
    assert found[0][0] == 0 and found[-1][1] == len(t)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b and c >= b - overlap and d > c
    assert all(b - a <= size for a, b in found)


def test_windows_prefer_paragraphs_then_sentences_then_spaces():
    assert list(windows("x" * 70 + "\n\n" + "y. " * 20, 100, 10))[0] == (0, 70)
    assert list(windows("x" * 70 + ". " + "y" * 60, 100, 10))[0] == (0, 71)
    assert list(windows("x" * 70 + " " + "y" * 60, 100, 10))[0] == (0, 70)
    assert list(windows("x" * 250, 100, 10)) == [(0, 100), (90, 190), (180, 250)]
    assert list(windows("x" * 1600)) == [(0, 1600)]


def test_passages_of_blank_sections(spark):
    df = spark.createDataFrame([(1, None), (2, "  \n "), (3, " hi ")], "doc_id long, text string")
    assert [(r.doc_id, r.char_start, r.char_end, r.text) for r in passages(df).collect()] == [(3, 0, 2, "hi")]
    assert passages(df.where("doc_id > 9")).count() == 0


def test_clean(spark):
    raw = "a dun-\ngeon\r\nline  two\n\n\n\nnext \t para "
    assert one(spark, text.cleaned(F.col("t")), t=raw) == "a dungeon line two\n\nnext para"


@pytest.mark.parametrize(("a", "b", "want"), [("pages 1-2", "pages 3-9", "pages 1-9"), ("", "x", "x"), ("x", "x", "x"), ("x", "y", "x; y"), ("x", "", "x")])
def test_refs(spark, a, b, want):
    assert one(spark, text.merged_refs(F.col("a"), F.col("b")), a=a, b=b) == want


def test_slugs_and_names(spark):
    assert one(spark, text.folder_slug(F.col("t")), t="Ébène & Straße — Nº 2") == "ebene-strae-n-2"
    assert one(spark, text.folder_slug(F.col("t")), t="…") == "book"
    assert one(spark, text.slug(F.col("t")), t=" The  Gate! ") == "the-gate"
    assert one(spark, text.citation(F.lit(3), F.col("t"), F.lit(""), F.lit(0), F.lit(9)), t="Gate") == "ch. 3 · “Gate” · chars 0–9"
    assert one(spark, text.first_spellings(F.array(F.lit("A"), F.lit("b"), F.lit("a"), F.lit(""), F.lit("B")), F.col("o")), o="b") == ["A"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Lady Quillon", "Quillon"), ("Marrow's", "Marrow"), ("When Tessa", "Tessa"), ("The And", "And"), ("Dr. Anna  Bell", "Anna Bell")],
)
def test_normal_names(spark, raw, want):
    assert one(spark, names.normal(F.col("t")), t=raw) == want


def test_plausible_and_speech(spark):
    for word, ok in (("I'd", False), ("X", False), ("The", False), ("Mara", True)):
        assert one(spark, names.plausible(F.col("t")), t=word) is ok
    assert one(spark, names.speakers(F.col("t")), t="Mara Venn said no. Then asked Tom again.") == ["Mara Venn", "Then", "Tom"]
    assert one(spark, names.display(F.array(F.lit("Tom"), F.lit("Subject Tom Orr"), F.lit("Tom Orr"))), t="") == "Tom Orr"


@pytest.mark.parametrize(
    ("passage", "score"),
    [
        ("", 0.0),
        ("Quiet rain fell.", 0.0),
        ("You gained level and mana and XP.", 1.5),
        ("[Level Up]", 2.0),
        ("Strength: 14", 1.0),
        ("SYSTEM ONLINE NOW", 1.5),
        ("You must wait. Level 3", 1.5),
    ],
)
def test_signals(spark, passage, score):
    assert one(spark, signals.score(signals.counts(F.col("t"))), t=passage) == score


@pytest.mark.parametrize(
    ("reply", "want", "error"),
    [
        ('{"rules": [{"a": 1}]}', ['{"a": 1}'], ""),
        ('```json\n[{"a": 1},]\n```', ['{"a": 1}'], ""),
        ('Here: {"a": "p, ] q ,}r",} so far', ['{"a": "p, ] q ,}r"}'], ""),
        ("{“a”: 1}", ['{"a": 1}'], ""),
        ('{"rules": [', [], "truncated"),
        ("no idea", [], "no JSON value"),
        ("", [], "nothing"),
        (None, [], "nothing"),
        ('{"rules": 3}', [], ""),
    ],
)
def test_replies(spark, reply, want, error):
    df = spark.createDataFrame([(reply,)], "r string").select(replies.parsed(F.col("r"), "rules").alias("p"))
    got = df.first()["p"]
    assert (got["items"], got["error"]) == (want, error)


def test_spellings_of_a_long_list_in_linear_time(spark):
    start = time.monotonic()
    items = F.transform(F.sequence(F.lit(0), F.lit(29_999)), lambda i: F.concat(F.when(i % 2 == 0, F.lit("N")).otherwise(F.lit("n")), F.floor(i / 2).cast("string")))
    got = spark.range(1).select(text.first_spellings(items, F.lit("n7")).alias("x")).first().x
    assert got == [f"N{i}" for i in range(15_000) if i != 7]
    assert time.monotonic() - start < 30  # comparing each with all before it took minutes


def test_spellings_without_blanks_and_nulls(spark):
    df = spark.createDataFrame([(["b", "", "A", None, "a", "B", "c"], "C"), ([], "x"), (None, "x")], "x array<string>, o string")
    assert [r[0] for r in df.select(text.first_spellings(F.col("x"), F.col("o"))).collect()] == [["b", "A"], [], None]
    assert df.select(text.first_spellings(F.col("x"))).first()[0] == ["b", "A", "c"]
