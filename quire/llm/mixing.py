"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in hashed order, once for each pass over it.
The stream is cut into blocks of equal length, and the target of a source is a quota of blocks.
The tree splits the quotas of all sources among output shards, halving the shards at each node
and drawing how many blocks of each source go left, so every shard gets its exact number of
blocks and the sources mix at random. The blocks of a source's quota are permuted by a seeded
bijection, each shard draws its number of them in that order, so no block is drawn twice, and
puts what it drew in hashed order. A block that no shard draws is not in the mix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, join_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Times a source may be repeated.
REPEATS = 3


def sizes(docs: DataFrame, text_col: str = "text") -> F.Column:
    """Words of the whole text; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: pd.DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = REPEATS) -> pd.DataFrame:
    """``sources`` (source, size) with weight and target, in order of code points, null last.

    Weights repeat in that order and share all words; a target stops at ``repeats`` times the
    source's size, and the excess is shared again by weight until none is above.
    """
    names = [None if v is None or v != v else v for v in sources["source"]]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    out = sources.iloc[order].reset_index(drop=True)
    weight = np.array([weights[i % len(weights)] for i in range(len(out))], np.float64)
    size = out["size"].to_numpy(np.float64)
    most, total = repeats * size, size.sum()
    target, capped = np.zeros(len(out)), np.zeros(len(out), bool)
    while not capped.all():
        rest = total - most[capped].sum()
        target = np.where(capped, most, rest * weight / weight[~capped].sum())
        over = ~capped & (target > most)
        if not over.any():
            break
        capped |= over
    target = np.where(capped, most, target)
    return out.assign(weight=weight, target=target)[["source", "size", "weight", "target"]]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas (sources) split over shards: an array (shards, sources), by a tree of draws.

    At each node the blocks of both halves are counted, and the left half's share of each source
    is a multivariate-hypergeometric draw. Seeds come from the node, so reruns agree.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, own = stack.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        left = int(own.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        took = rng.multivariate_hypergeometric(own, left, method="marginals") if left else np.zeros_like(own)
        stack += [(lo, mid, took), (mid, hi, own - took)]
    return out


def bijection(n: int, seed: list[int]) -> tuple[int, int]:
    """Factor and shift for which (factor * i + shift) % n takes every number below n once."""
    rng = np.random.default_rng(seed)
    factor = int(rng.integers(1, max(2, n)))
    while math.gcd(factor, n) > 1:
        factor += 1
    return factor, int(rng.integers(0, max(1, n)))


def row_key(id_col: str, text_col: str, source_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3), repeats: int = REPEATS, shards: int = 16, block_words: int = 256, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The draw and the documents' figures.

    The draw has a row for each run of words that a shard takes from one pass over a document:
    row_key, copy, doc_id, source, size, pass, shard, slot (order within the shard), index (the
    block, counted over all passes of the source), from_word, n_words. The figures have a row for each row of ``docs``: row_key, copy, doc_id,
    source, size, source_size, target. ``row_key`` hashes id, source and text; repeated rows
    share it and differ in ``copy``. Null ids and sources are kept, null being one source.
    Documents without a word are in no run, and an empty table gives two empty ones. Small
    sources have shorter blocks, and blocks grow where there would be over 2**29 of them.
    One row for each source goes to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key(id_col, text_col, source_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), sizes(docs, text_col).alias("size"))
    rows = rows.groupBy("row_key", "doc_id", "source", "size").count()
    rows = materialize(rows.select("row_key", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"), "doc_id", "source", "size"), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("size")).toPandas(), weights, repeats)
    size, target = plan["size"].to_numpy(np.int64), plan["target"].to_numpy(np.float64)
    most = max(block_words, -(-int(size.sum()) * repeats // 2**29))
    block = np.clip(size // 1024, 1, most)
    blocks = -(-size // block)
    quota = np.minimum(np.rint(target / block), repeats * blocks).astype(np.int64)
    ends = np.cumsum(split_quotas(quota, shards, seed), 0).T  # of each source, its blocks up to and with each shard
    turns = [bijection(int(q), [seed, i]) for i, q in enumerate(quota)]
    names = [None if v is None or v != v else v for v in plan["source"]]
    table = spark.createDataFrame(
        [(names[i], i, int(size[i]), float(target[i]), int(block[i]), int(blocks[i]), int(quota[i]), *turns[i], [int(v) for v in ends[i]]) for i in range(len(plan))],
        "name string, ordinal int, source_size long, target double, words long, blocks long, quota long, factor long, shift long, ends array<long>",
    )
    figures = rows.join(F.broadcast(table) if len(plan) <= BROADCAST_ROWS else table, F.col("source").eqNullSafe(F.col("name"))).drop("name")

    # The documents of each pass in hashed order. Buckets of the hash keep the running sums apart.
    passes = F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("blocks")).cast("int") - 1)
    streams = figures.where("size > 0 AND quota > 0").withColumn("pass", F.explode(passes)).withColumn("h", F.xxhash64("row_key", "copy", "pass", F.lit(seed)))
    buckets = max(64, rows.count() // 5_000)
    streams = streams.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    order = Window.partitionBy("ordinal", "pass", "bucket").orderBy("h", "row_key", "copy").rowsBetween(Window.unboundedPreceding, -1)
    streams = materialize(streams.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))), "streams")
    filled = materialize(streams.groupBy("ordinal", "pass", "bucket").agg(F.sum("size").alias("filled")), "buckets")
    order = Window.partitionBy("ordinal", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = filled.select("ordinal", "pass", "bucket", F.coalesce(F.sum("filled").over(order), F.lit(0)).alias("base"))
    placed = join_small(streams, base, ["ordinal", "pass", "bucket"], rows=filled.count()).withColumn("at", F.col("base") + F.col("before"))
    covered = F.sequence(F.floor(F.col("at") / F.col("words")), F.floor((F.col("at") + F.col("size") - 1) / F.col("words")))
    # the blocks of the quota, permuted; each shard draws its number of them
    runs = placed.withColumn("block", F.explode(covered)).withColumn("index", F.col("pass") * F.col("blocks") + F.col("block")).where("index < quota")
    drawn = F.size(F.filter("ends", lambda e: e <= F.expr("(factor * index + shift) % quota")))
    runs = runs.withColumn("shard", drawn).where(F.col("shard") < shards)
    begin = F.greatest(F.col("at"), F.col("block") * F.col("words"))
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("words"))
    runs = runs.select(
        "row_key", "copy", "doc_id", "source", "size", "pass", "shard", F.xxhash64("ordinal", "index", F.lit(seed)).alias("slot"), "index",
        (begin - F.col("at")).alias("from_word"), (end - begin).alias("n_words"),
    )
    return runs, figures.select("row_key", "copy", "doc_id", "source", "size", "source_size", "target")


def taken(runs: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the shards hold, for every row."""
    held = runs.where("shard IS NOT NULL").groupBy("row_key", "copy").agg(F.sum("n_words").alias("taken"))
    return figures.join(held, ["row_key", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, by shard and in each by slot.

    A document comes once for each pass that takes words of it, in the shard and at the slot of
    the first block that takes them, its text cut to the words taken there, with their spacing;
    only the document at the end of a source's quota is cut. ``n_chars``, if there is such a
    column, follows the text. Rows are ranged by (shard, slot), so partitions and written files
    are in that order.
    """
    runs, figures = mixture(docs, id_col, text_col, source_col, **options)
    first = F.min_by(F.struct("shard", "slot"), "from_word")
    spans = runs.groupBy("row_key", "copy", "pass").agg(F.sum("n_words").alias("__n"), F.first("size").alias("__size"), first.alias("__at"))
    spans = spans.select(F.col("row_key").alias("__row"), "__n", "__size", F.col("__at.shard").alias("__shard"), F.col("__at.slot").alias("__slot"))
    keyed = docs.withColumn("__row", row_key(id_col, text_col, source_col))
    if figures.where("copy > 1").head(1):
        keyed = keyed.dropDuplicates(["__row"])
    words = F.regexp_extract_all(F.col(text_col), F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    part = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("__n").cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    out = keyed.join(spans, "__row").withColumn(text_col, F.when(F.col("__n") >= F.col("__size"), F.col(text_col)).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    out = out.repartitionByRange("__shard", "__slot", "__row").sortWithinPartitions("__shard", "__slot", "__row")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
