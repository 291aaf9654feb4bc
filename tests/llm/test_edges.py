"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import caps, chat, hashing_search, langid, line_templates, mixing, packing, queries, simhash, token_blocks, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row string, key string, h long, n_lines int, id int, none boolean, size int"
LONG = "word and other " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today", "en", "b", 1),
    (1, "The quick brown fox jumps over the lazy dog today", "en", "b", 1),
    (2, "The quick brown fox jumps over the lazy dog today", "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", None, 3),
    (6, LONG, "en", "c", 9),
    (7, "12345 !!! ---", "en", "\U0001f600", 9),
    (8, "Der schnelle Fuchs über den Zaun", "de", "b", 9),
    (None, "Kein Name für diesen Text", "de", "b", 9),
    (9, "You are a worthless idiot. Not a stupid one, they said.", "en", "b", 9),
    (10, "🙂 ünïcödé <|endoftext|> \x00 ퟿", "en", "b", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (0.5, 1, "r", "k", 2, 3, 4, True, 5)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id > 1000")


def test_token_blocks(docs, none):
    got = token_blocks.token_blocks(docs, queries.vocabulary()).toPandas()
    assert len(got) == len(ROWS)
    assert (got.sort_values("start")["start"].to_numpy() == np.concatenate([[0], np.cumsum(got.sort_values("start")["n_tokens"])[:-1]])).all()
    assert got[got["doc_id"].isin([3, 4])]["n_tokens"].tolist() == [1, 1]
    assert got.sort_values("start")["doc_id"].isna().iloc[0]
    assert token_blocks.token_blocks(none, queries.vocabulary()).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, queries.vocabulary()).toPandas()
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 1024
    long = got[got["doc_id"] == 6].sort_values("piece")
    assert long["length"].iloc[1:].eq(1024).all() and long["start"].tolist() == [0, *long["length"].cumsum()[:-1]]
    assert got[got["doc_id"].isna()].shape[0] == 1 and got[got["doc_id"] == 1].shape[0] == 2
    assert packing.pack_documents(none, queries.vocabulary()).count() == 0


def test_language(docs, none):
    model = langid.fit(docs.select("text", "lang"), F.lit(True))
    got = langid.predict(docs, model)
    assert set(docs.columns) - {"score"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 7)) and 0 <= r.score <= 1
        assert r.lang_pred == "und" or r.lang_pred in ("de", "en")
    assert langid.fit(none.select("text", "lang"), F.lit(True)) is None
    assert langid.predict(none, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_lines(spark, docs, none):
    got = line_templates.drop_templates(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "n_dropped"])
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)] and by[5] == [(" \n\t ", 2, 0)] and len(by[1]) == 2
    assert line_templates.drop_templates(none).count() == 0
    line = "Copyright notice of the {} archive page {} of all pages"
    rows = [(i, f"{'alpha beta gamma delta omega'.split()[i]} stands here alone\n" + line.format("public", i)) for i in range(5)] + [(9, line.format("secret", 4)), (8, "All\nAll\nAll"), (7, "All")]
    got = {r.doc_id: r for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0 and [got[i].n_dropped for i in (1, 2, 3, 4)] == [1, 1, 1, 1]
    figures = ["{} {} {} {}", "{} = {} + {} x", "| {} | {} | a |", "{}, {}: {} b c"]  # mostly numbers: alike only if equal
    rows = [(i, "\n".join(f.format(i, i + 1, i + 2, i * 7) for f in figures)) for i in range(9)] + [(9, figures[0].format(*range(4))), (10, figures[0].format(*range(4)))]
    told = {r.doc_id: r for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(r.n_dropped for r in told.values()) == 0
    short = [(i, f"All rights reserved, friends\nword{i}\nMenu\n日本語の文がここに二十文字以上ありますのでね") for i in range(5)] + [(i, f"w{i} x{i}") for i in range(5, 400)]
    told = {r.doc_id: r for r in line_templates.drop_templates(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert [told[i].n_dropped for i in range(5)] == [0, 3, 3, 3, 3] and told[1].text == "word1" and told[7].n_dropped == 0
    told = line_templates.drop_templates(spark.createDataFrame(short, "doc_id long, text string"), short_every=50).where("doc_id = 1").first()
    assert told.text == "word1\nMenu"
    assert got[1].text == "beta stands here alone" and got[9].n_dropped == 0 and got[8].n_dropped == got[7].n_dropped == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == len(ROWS)
    zero = got[got["fingerprint"] == "0" * 16]
    assert set(zero["doc_id"]) == {3, 4, 5} and set(zero["component_id"]) == {3}
    assert got[got["doc_id"].isin([1, 2])]["component_id"].tolist() == [1, 1, 1]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.without_copies(docs).toPandas()
    assert sorted(kept["doc_id"].dropna()) == [1, 3, 6, 7, 8, 9, 10] and kept["doc_id"].isna().sum() == 1
    assert list(kept.columns) == docs.columns


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(9, 1), (1, 0), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model)
    assert set(docs.columns) <= set(got.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert by[9].predicted == 1 and by[1].predicted == by[3].predicted == by[4].predicted == 0
    assert toxicity.score(none, toxicity.fit(none, labels.where("doc_id > 99"), F.lit(True))).count() == 0


def test_mixture(docs, none):
    runs, figures = mixing.mixture(docs)
    got = mixing.taken(runs, figures).toPandas()
    assert len(got) == len(ROWS) and got[got["doc_id"].isin([3, 4, 5])]["taken"].eq(0).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.taken(*mixing.mixture(docs.repartition(5))).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got[order].sort_values(order).to_numpy(float).tolist().__repr__() == again[order].sort_values(order).to_numpy(float).tolist().__repr__()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert words == got["taken"].sum()
    clash = docs.withColumns({c: F.lit(i) for i, c in enumerate(("row_key", "copy", "pass", "shard", "slot", "index", "ordinal"))})
    again = mixing.mixed_documents(clash)
    assert again.columns == clash.columns and {(r.row_key, r["copy"], r["index"]) for r in again.collect()} == {(0, 1, 5)}
    assert mixing.taken(*mixing.mixture(none)).count() == 0 and mixing.mixed_documents(none).count() == 0


VECTORS = [
    (1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.01, 0.0], 0), (3, [1.0, 0.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [float("nan"), 1.0, 0.0], 0),
    (7, [1.0, None, 0.0], 0), (8, [1.0, 0.0, 0.0], None), (9, [1.0, 0.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [], 0), (12, [0.0, 1.0, 0.0], 0), (None, [0.0, 0.0, 1.0], 0), (13, [float("inf"), 0.0, 1.0], 0),
]


def test_caps(spark):
    df = spark.createDataFrame([(*v, "x", 1) for v in VECTORS], "vec_id long, embedding array<float>, label int, node string, n long")
    got = caps.near_vectors(df).toPandas()
    assert len(got) == len(VECTORS)
    links = got.groupby("vec_id")["n_links"].apply(list).to_dict()
    assert links[1] == [3] and links[2] == [3] and links[9] == [3, 3] and all(links[i] == [0] for i in (3, 4, 5, 6, 7, 8, 10, 11, 12, 13))
    assert got[got["vec_id"].isin([1, 2, 9])]["component_id"].eq(1).all() and got["kept"].sum() == len(VECTORS) - 3
    assert caps.near_vectors(df.where("vec_id > 99")).count() == 0


def test_search(spark):
    df = spark.createDataFrame([(*v, "x") for v in VECTORS], "vec_id long, embedding array<float>, query_id int, rank string")
    got = {}
    for r in hashing_search.nearest(df, df.where("vec_id IN (1, 4, 5, 9, 10)"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[1][:4] == [3, 8, 9, 9] and got[1][4] == 2 and 4 not in got and 5 not in got and 10 not in got
    assert all(9 not in got[9] for _ in [0])
    assert hashing_search.nearest(df.where("vec_id > 99"), df.where("vec_id > 99")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>x\ny"), (1, 2, None, "<\\|a <\\\\| <|"), (2, None, "a\nb", "x"), (2, 1, "<n| <nn|\n", "t\n"), (2, 1, "<n| <nn|\n", "t\n"), (None, 0, "assistant", ""), (3, 5, "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, parsed int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [(t.role, t.text) for t in got[1].parsed] == [("user", ""), ("assistant", rows[1][3]), ("", rows[2][3])]
    assert [(t.role, t.text) for t in got[2].parsed] == [("a\nb", "x"), ("<n| <nn|\n", "t\n"), ("<n| <nn|\n", "t\n")]
    assert got[1].formatted.count("<|im_start|>") == 3 and got[1].formatted.count("<|im_end|>") == 3
    assert got[None].parsed[0].text == "" and len(got[3].parsed[0].text) == 200_000
    assert chat.format_conversations(df.where("turn > 99")).count() == 0


def test_unlike_texts_all_stay_whatever_their_ids(spark):
    """Rows are told apart by id and text: null and repeated ids take no other text with them."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")

    def kept(*rows):
        df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra int")
        return sorted(((r.doc_id, r.text[0]) for r in simhash.without_copies(df).collect()), key=str)

    assert kept((1, a), (None, a), (None, b), (None, c)) == [(1, "a"), (None, "b"), (None, "c")]
    assert kept((1, a), (5, a), (5, b)) == [(1, "a"), (5, "b")]
    assert kept((1, a), (1, b), (None, c), (None, d)) == [(1, "a"), (1, "b"), (None, "c"), (None, "d")]
    assert kept((None, a), (None, a), (None, b), (2, b), (2, b), (2, c)) == [(2, "b"), (2, "c"), (None, "a")]
    near = a.rsplit(" ", 1)[0] + " other"
    assert kept((7, near), (7, a), (3, b)) == [(3, "b"), (7, "a")]
