"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations learned by iterative quantization on a bounded
sample. Codes are cut into substrings of 16 bits, each with an index from value to rows. All values
within ``reach`` bits of a query's substring are probed in every index, so by the pigeonhole
principle every code within ``substrings * (reach + 1) - 1`` bits is retrieved, and most of the
farther ones that matter. Codes within ``radius`` bits stay, the ``pool`` nearest of them are
reranked by the cosine of the original vectors.

Reach and radius are learned from the true neighbours, among all rows, of a few sampled vectors: a
share ``recall`` of these agrees with its vector up to ``reach`` bits in some substring and up to
``radius`` bits in all. A query that finds too few rows is asked again with larger ones, in the end
with all values, so no query gets fewer rows than there are.

The indexes are dealt out by substring, leading bits of the value and, where that is still many
rows, parts of them; a query goes only to values that its reach leaves. Equal vectors are one
entry, which holds as many of their ids as any answer can take.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.caps import usable
from quire.llm.common import join_small, materialize

#: Bits of a substring.
PART = 16


@dataclass
class Codes:
    """Rotations of one dimension: ``rotate`` is (dims, bits)."""

    center: np.ndarray
    rotate: np.ndarray
    reach: int = 0
    radius: int = 0
    pool: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit rows as 64-bit words."""
        return np.packbits((x - self.center) @ self.rotate > 0, axis=1).view(np.uint64)


def learn_codes(x: np.ndarray, bits: int, seed: int, rounds: int = 12) -> Codes:
    """Iterative quantization of unit rows ``x``, once for each rotation that ``bits`` need."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    center = x.mean(0) if len(x) else np.zeros(d)
    y = x - center
    parts = []
    for _ in range(math.ceil(bits / d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds if len(x) > d else 0):
            u, _, v = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        parts.append(r)
    return Codes(center, np.concatenate(parts, 1)[:, :bits])


def apart(words: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits of codes: in all, and in each substring."""
    parts = np.bitwise_count(words.view(np.uint16) ^ other.view(np.uint16))
    return parts.sum(-1, dtype=np.int64), parts


_MASKS: dict[int, np.ndarray] = {}


def masks(width: int, reach: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``reach`` at most are set."""
    if width not in _MASKS:
        every = np.arange(1 << width)
        _MASKS[width] = every[np.argsort(np.bitwise_count(every), kind="stable")]
    return _MASKS[width][: sum(math.comb(width, i) for i in range(min(reach, width) + 1))]


class SubstringIndex:
    """Rows by the value of the low ``width`` bits of one substring."""

    def __init__(self, low: np.ndarray, width: int):
        self.order = np.argsort(low, kind="stable")
        self.starts = np.searchsorted(low[self.order], np.arange((1 << width) + 1))
        self.width = width
        self.probed = 0

    def probe(self, low: int, reach: int) -> np.ndarray:
        """Rows whose value is within ``reach`` bits of ``low``."""
        values = low ^ masks(self.width, reach)
        begin = self.starts[values]
        n = self.starts[values + 1] - begin
        total = int(n.sum())
        self.probed += total
        shift = np.repeat(begin - np.cumsum(n) + n, n)
        return self.order[shift + np.arange(total)]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(rows: DataFrame, k: int, bits: int = 256, sample: int = 8192, asks: int = 256, recall: float = 0.98, seed: int = 3) -> dict[int, Codes]:
    """Codes for each dimension in a sample of at most ``sample`` of ``rows`` (v), of least hash.

    At most ``asks`` of the sample are asked for their ``k`` true neighbours among all rows. Reach
    and radius are such that ``recall`` of these are met, and so is the pool: a second pass counts
    the rows whose codes are as near as a true neighbour's, so the pool grows with the rows.
    """
    some = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).toPandas()
    out: dict[int, Codes] = {}
    asked: dict[int, np.ndarray] = {}
    rng = np.random.default_rng(seed)
    for d, part in some.groupby(some["v"].map(len)):
        x = _unit(part["v"])
        out[int(d)] = learn_codes(x, bits, seed)
        asked[int(d)] = x[rng.permutation(len(x))[: max(1, asks * len(x) // len(some))]]
    shared = rows.sparkSession.sparkContext.broadcast(asked)  # at most ``asks`` vectors

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims):
                if int(d) not in shared.value:
                    continue
                q, x = shared.value[int(d)], _unit(pdf["v"][dims == d])
                score = q @ x.T
                score[score > 1 - 1e-9] = -2  # the vector itself
                n = min(k, len(x))
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                held = best.get(int(d), (np.zeros((len(q), 0)), np.zeros((len(q), 0, d))))
                both = np.concatenate([held[0], np.take_along_axis(score, top, 1)], 1), np.concatenate([held[1], x[top]], 1)
                order = np.argsort(-both[0], axis=1, kind="stable")[:, :k]
                best[int(d)] = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order[:, :, None], 1)
        for d, (score, x) in best.items():
            at, place = np.nonzero(score > -2)
            if len(at):
                yield pd.DataFrame({"dims": d, "ask": at, "score": score[at, place], "x": list(x[at, place])})

    rank = F.row_number().over(Window.partitionBy("dims", "ask").orderBy(F.desc("score")))
    found = rows.select("v").mapInPandas(near, "dims int, ask int, score double, x array<double>")
    found = found.withColumn("i", rank).where(F.col("i") <= k).select("dims", "ask", "x").toPandas()  # asks * k rows at most
    coded = {d: out[d].of(x) for d, x in asked.items() if len(x)}

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims):
                if int(d) not in coded:
                    continue
                words, own = coded[int(d)], out[int(d)].of(_unit(pdf["v"][dims == d]))
                counts = held.setdefault(int(d), np.zeros((len(words), bits + 1), np.int64))
                for i, w in enumerate(words):
                    counts[i] += np.bincount(np.bitwise_count(own ^ w).sum(1, dtype=np.int64), minlength=bits + 1)
        for d, counts in held.items():
            ask, distance = np.nonzero(counts)
            yield pd.DataFrame({"dims": d, "ask": ask, "distance": distance, "n": counts[ask, distance]})

    near_codes = rows.select("v").mapInPandas(ranks, "dims int, ask int, distance int, n long").groupBy("dims", "ask", "distance").agg(F.sum("n").alias("n")).toPandas()  # asks * (bits + 1) rows at most
    for d, part in found.groupby("dims"):
        code = out[int(d)]
        mine = near_codes[near_codes["dims"] == d]
        table = np.zeros((len(coded[int(d)]), bits + 1), np.int64)
        table[mine["ask"], mine["distance"]] = mine["n"]
        table = table.cumsum(1)
        all_, parts = apart(code.of(np.stack(part["x"].to_numpy())), code.of(asked[int(d)][part["ask"].to_numpy()]))
        code.reach, code.radius = (int(math.ceil(np.quantile(v, recall))) for v in (parts.min(1), all_))
        code.pool = int(math.ceil(np.quantile(table[part["ask"].to_numpy(), all_], recall)))
    return out


def _search(index: DataFrame, probes: DataFrame, keys: list[str], width: int, pool: int) -> DataFrame:
    """q, entry and distance of what each group of the index gives its queries."""

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(asks):
            j, prefix = int(rows["j"].iat[0]), int(rows["prefix"].iat[0])
            words = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1)
            codes = np.frombuffer(b"".join(asks["code"]), np.uint64).reshape(len(asks), -1)
            own, entry = SubstringIndex(rows["low"].to_numpy(), width), rows["entry"].to_numpy()
            for q, code, reach, radius in zip(asks["q"].to_numpy(), codes, asks["reach"].to_numpy(), asks["radius"].to_numpy(), strict=True):
                value = int(code.view(np.uint16)[j])
                found = own.probe(value & ((1 << width) - 1), int(reach) - (prefix ^ (value >> width)).bit_count())
                found = found[np.bitwise_count(words[found] ^ code).sum(1, dtype=np.int64) <= radius]
                distance, parts = apart(words[found], code[None])
                # a row comes from the first substring that retrieves it
                first = (parts <= reach).argmax(1) == j
                found, distance = found[first], distance[first]
                if len(found) > pool:
                    top = np.lexsort((entry[found], distance))[:pool]
                    found, distance = found[top], distance[top]
                out.append((np.full(len(found), q), entry[found], distance))
        joined = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pd.DataFrame({"q": joined[0], "entry": joined[1], "distance": joined[2]})

    return index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(search, "q long, entry long, distance long")


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = 256, recall: float = 0.98, least_pool: int = 256, block_rows: int = 16384,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each query.

    Score is the cosine in double precision, summed in order of the components; ties go to the
    smaller id. A query never finds a row of its own id. Unusable vectors (null, empty, zero, null
    or non-finite components), null ids and queries of a dimension without rows find nothing and
    are not found. With fewer than ``k`` candidates all are returned; repeated rows are candidates
    each; repeated queries are answered once. An empty table gives no rows.
    """
    side = lambda df, name: df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vector_col).alias("v"), F.xxhash64(vector_col).alias("n1"), F.xxhash64(F.lit(1), F.col(vector_col)).alias("n2"))
    base, asked = side(rows, "vec_id"), side(queries, "query_id").distinct()
    same = base.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1  # rows of one id
    rank = F.row_number().over(Window.partitionBy("n1", "n2").orderBy("vec_id"))
    entries = base.withColumn("i", rank).where(F.col("i") <= k + same).groupBy("n1", "n2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    entries = materialize(entries.select(F.monotonically_increasing_id().alias("entry"), "ids", "v", F.size("v").alias("dims")), "entries")
    asked = materialize(asked, "asked")
    questions = materialize(asked.groupBy("n1", "n2").agg(F.first("v").alias("v")).select(F.monotonically_increasing_id().alias("q"), "n1", "n2", "v", F.size("v").alias("dims")), "questions")
    codes = fit(entries, k, bits, recall=recall)
    shared = rows.sparkSession.sparkContext.broadcast(codes)  # a few matrices of dims x bits
    pool = max([least_pool, *(c.pool for c in codes.values())])
    prefixes = min(12, max(0, math.ceil(math.log2(max(1, entries.count()) / block_rows))))
    width = PART - prefixes

    def coded(vectors: pd.Series, dims: int) -> np.ndarray | None:
        code = shared.value.get(dims)
        return None if code is None else code.of(_unit(vectors))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("dims"):
                words = coded(part["v"], int(d))
                if words is None:
                    words = np.zeros((len(part), bits // 64), np.uint64)  # a dimension that the sample missed: alike
                values = words.view(np.uint16).astype(np.int64)
                n, m = values.shape
                yield pd.DataFrame({
                    "dims": int(d), "j": np.tile(np.arange(m), n), "prefix": (values >> width).ravel(), "low": (values & ((1 << width) - 1)).ravel(),
                    "entry": np.repeat(part["entry"].to_numpy(), m), "code": np.repeat(np.array([w.tobytes() for w in words], object), m),
                })

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (d, more), part in pdf.groupby(["dims", "more"]):
                code, words = shared.value.get(int(d)), coded(part["v"], int(d))
                if words is None:
                    words = np.zeros((len(part), bits // 64), np.uint64)
                reach = min(PART, (code.reach if code else PART) + 3 * int(more))
                radius = bits if reach >= PART else min(bits, (code.radius if code else bits) + 3 * int(more) * bits // PART)
                near = masks(prefixes, reach)
                values = words.view(np.uint16).astype(np.int64)
                n, m = values.shape
                where = (values >> width)[:, :, None] ^ near[None, None, :]
                yield pd.DataFrame({
                    "dims": int(d), "j": np.tile(np.repeat(np.arange(m), len(near)), n), "prefix": where.ravel(), "q": np.repeat(part["q"].to_numpy(), m * len(near)),
                    "code": np.repeat(np.array([w.tobytes() for w in words], object), m * len(near)), "reach": reach, "radius": radius,
                })

    keys = ["dims", "j", "prefix"]
    index = materialize(entries.select("entry", "dims", "v").mapInPandas(deal, "dims int, j int, prefix int, low int, entry long, code binary"), "index")
    parts = materialize(index.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("parts")), "parts")
    split = join_small(index, parts, keys).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int")).drop("parts")
    # ids that an answer needs before those of its own rows go, or all that there are
    enough = materialize(entries.groupBy("dims").agg(F.least(F.sum(F.size("ids")), F.lit(k + same)).alias("enough")), "enough")
    open_, kept = questions.join(F.broadcast(enough), "dims").withColumn("more", F.lit(0)), None  # a row for each dimension
    for turn in range(PART // 3 + 2):
        probes = open_.select("q", "dims", "v", "more").mapInPandas(send, "dims int, j int, prefix int, q long, code binary, reach int, radius int")
        probes = join_small(probes, parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        found = _search(split, probes, [*keys, "part"], width, pool)
        order = Window.partitionBy("q").orderBy("distance", "entry")
        found = materialize(found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= pool).select("q", "entry"), f"found-{turn}")
        sizes = found.join(entries.select("entry", F.size("ids").alias("n")), "entry").groupBy("q").agg(F.sum("n").alias("n"))
        left = open_.join(sizes, "q", "left").withColumn("done", F.coalesce("n", F.lit(0)) >= F.col("enough"))
        left = materialize(left.select(*open_.columns, "done"), f"asked-{turn}")
        done = found.join(left.where("done").select("q"), "q", "left_semi")
        kept = done if kept is None else kept.unionByName(done)
        open_ = left.where("NOT done").drop("done").withColumn("more", F.col("more") + 1)
        if not open_.head(1):
            break

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm: Column = F.sqrt(dot("v", "v"))
    scored = kept.join(entries.select("entry", "ids", F.col("v").alias("x"), norm.alias("xn")), "entry").join(questions.select("q", "v", norm.alias("vn")), "q")
    scored = scored.select("q", "ids", (dot("x", "v") / (F.col("xn") * F.col("vn"))).alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    scored = materialize(scored.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + same).select("q", "ids", "score"), "scored")
    answers = asked.select("query_id", "n1", "n2").join(questions.select("q", "n1", "n2"), ["n1", "n2"]).join(scored, "q")
    answers = answers.select("query_id", "q", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
