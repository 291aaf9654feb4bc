"""Shards of a k-d tree: balance, copies, slots and edges, and splits against a plain search."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard int, slot long, node long, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "s") for r in rows], SCHEMA)


def whole(spark, rows, count=8):
    got = sharding.shards(frame(spark, rows), count).toPandas()
    assert len(got) == len(rows)
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((d == d, int(d) if d == d else 0, s, c) for d, s, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == want
    assert got["shard"].between(0, count - 1).all()
    for _, part in got.groupby("shard"):
        part = part.sort_values("slot")
        assert part["slot"].tolist() == list(range(len(part)))
        ids = part["doc_id"].dropna()
        assert ids.is_monotonic_increasing
    return got


def test_near_equal_bytes_and_copies_together(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 37 % 100_003, f"{i} " + "x" * int(rng.exponential(400)), ["en", "de", None][i % 3], f"src{int(rng.exponential(4))}") for i in range(4000)]
    rows += [(200_000 + i, f"copy {i % 60} " + "y" * 300, "en", "src0") for i in range(180)]
    got = whole(spark, rows)
    held = got.groupby("shard")["size"].sum()
    assert len(held) == 8 and held.max() <= 1.05 * held.mean() and held.min() >= 0.95 * held.mean()
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1


def test_hot_copies_are_dealt_out(spark):
    """A third of all bytes in one text: its copies go to several shards, which stay equal."""
    rows = [(i, f"text {i} " + "x" * (i % 50), "en", "a") for i in range(2000)] + [(5000 + i, "the same text again and again", "en", "hot") for i in range(1000)]
    got = whole(spark, rows, 7)
    held = got.groupby("shard")["size"].sum()
    assert held.max() <= 1.08 * held.mean() and held.min() >= 0.92 * held.mean()
    assert got[got["doc_id"] >= 5000]["shard"].nunique() >= 2


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, one shard, fewer rows than shards, no rows."""
    rows = [(None, None, None, None), (1, "", None, "a"), (1, "", None, "a"), (2, "LONG " * 50_000, "en", "\U0001f600"), (None, "x", "en", None), (3, "Ünï", "de", "a")]
    whole(spark, rows, 4)
    assert whole(spark, rows, 1)["shard"].eq(0).all()
    whole(spark, [(7, "one", "en", "s")] * 30, 5)
    assert sharding.shards(frame(spark, rows).where("doc_id = -1"), 4).count() == 0


def test_split_is_the_weighted_median_of_the_widest_dimension(spark):
    rng = np.random.default_rng(11)
    n = 3000
    weight = rng.integers(1, 100, n)
    key = rng.integers(0, 1 << 31, n)
    tie = rng.integers(0, 1 << 32, n)
    data = [(int(w), int(t), [int(k), 5, 5, 5], 0) for w, t, k in zip(weight, tie, key, strict=True)]
    points = spark.createDataFrame(data, "weight long, tie long, coords array<long>, node long")
    want = int(weight.sum()) // 3
    cut = sharding._medians(points, {0: (0, want)}, [0], 0)[0]
    full = key.astype(np.int64) * (1 << 32) + tie
    left = int(weight[full < cut].sum())
    run = np.cumsum(weight[np.argsort(full)])
    assert abs(left - want) == np.abs(np.append(run, 0) - want).min()
    boxes = sharding.grown(points.drop("node"), 6, int(weight.sum())).groupBy("shard").agg(F.sum("weight").alias("w")).toPandas()
    assert len(boxes) == 6 and (boxes["w"] / boxes["w"].mean()).between(0.98, 1.02).all()


def test_query_and_files(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = queries.QUERIES["op11_kd_shards"](spark, data)
    got = found.toPandas()
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all() and len(got) == docs.count()
    sharding.write_shards(docs, found, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s").select("doc_id", "text", "shard").toPandas().merge(got, on="doc_id", suffixes=("", "_"))
    assert len(back) == len(got) and (back["shard"] == back["shard_"]).all()
    assert all(zlib.crc32(t.encode()) == c for t, c in zip(back["text"], back["text_crc32"], strict=True))
