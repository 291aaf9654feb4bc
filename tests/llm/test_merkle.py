"""The manifest against trees built in plain Python, and the registered query against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, place int, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, text=None):
    fields = (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], doc["text"] if text is None else text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """Levels of one tree, from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def steps(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def brute(docs):
    docs = sorted(docs, key=lambda d: ((d["lang"] is not None, (d["lang"] or "").encode()), d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
    langs = list(dict.fromkeys(d["lang"] for d in docs))
    trees = {g: climb([leaf(d) for d in docs if d["lang"] == g]) for g in langs}
    top = climb([trees[g][-1][0] for g in langs])
    out, seen = [], {}
    for d in docs:
        g = d["lang"]
        at = seen[g] = seen.get(g, -1) + 1
        path = steps(trees[g], at) + steps(top, langs.index(g))
        hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None
        now = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"])) if hit else leaf(d)
        for before, after in path:
            now = sha(before + now + after)
        root = top[-1][0]
        out.append((d["doc_id"], leaf(d), trees[g][-1][0], root, sha("".join(b + a for b, a in path)), now, now == root))
    return sorted(out, key=str)


def run(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lowered(F.col("text")))
    return sorted((tuple(r) for r in merkle.audit(df, tampered).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 3, "h") for r in rows], SCHEMA)


@pytest.mark.parametrize("count", [1, 2, 8, 9, 65, 600])
def test_against_plain_trees(spark, count):
    rows = [(i * 7919 % 10_007, f"Text {i} of Ünï", ["en", "de", "en", "en", None][i % 5], "s", i) for i in range(count)]
    got = run(frame(spark, rows))
    assert got == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert len({r[3] for r in got}) == 1


def test_edges(spark):
    """Nulls anywhere, repeated rows and ids, long texts, many groups, clashing columns."""
    rows = [(None, None, None, None, None), (None, "A", "x", None, 1), (1, "Same", "en", "a", 4), (1, "Same", "en", "a", 4), (1, "other", "en", "a", 4), (2, "", "", "", 0), (3, "WORD " * 50_000, "en", "b", 1)]
    rows += [(100 + i, f"T{i}", f"g{i % 70}", "s", None) for i in range(150)]
    assert run(frame(spark, rows)) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert run(frame(spark, rows).where("doc_id = -5")) == []


def test_tampered_rows_fail_alone(spark):
    rows = [(i, f"Upper {i}" if i % 2 else f"lower {i}", "en", "s", i) for i in range(90)]
    for doc_id, *_, verified in run(frame(spark, rows)):
        assert verified == (not (zlib.crc32(str(doc_id).encode()) % 3 == 0 and doc_id % 2))


def test_query_against_sql(spark):
    data = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, data).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert got == sorted(con.sql(queries.ORACLES["op13_merkle_manifest"]).fetchall())


def test_written_manifest_is_read_by_group(spark, tmp_path):
    rows = [(i, f"T {i}", "en" if i % 3 else "de", "s", i) for i in range(30)]
    found = merkle.manifest(frame(spark, rows))
    merkle.write_manifest(found, f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m")
    ok = back.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert len(ok) == 30 and all(r.ok for r in ok) and back.select("subroot").distinct().count() == 2
