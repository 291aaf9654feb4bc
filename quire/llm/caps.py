"""Embedding near-dedup by spherical-cap filters.

Filter directions form a structured random product code: the dimensions are cut into parts, each
part has a small book of random unit vectors, and a direction joins one vector from each book.
A vector is list-decoded to all directions whose cap it lies in, that is whose inner product with
it exceeds the height of a cap that random vectors lie in ``mean`` of on average; one with a shorter
list takes its ``least`` nearest directions. Vectors that share a direction and the label meet:
first as sketches of 64 bytes, which tell the rows that may have a near one there, then these rows
with their vectors, which are compared exactly. Near vectors share most of their lists, others
hardly any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import block_pairs, compare_groups, shifted_pairs
from quire.llm.common import join_small, materialize
from quire.llm.components import components, contract


def usable(vector: str | F.Column) -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class ProductCode:
    """``parts`` books of ``words`` random unit vectors each: words ** parts directions.

    Parts have eight or more dimensions; fewer dimensions make one part, one dimension two words.
    """

    def __init__(self, dims: int, parts: int = 2, words: int = 256, seed: int = 5):
        rng = np.random.default_rng([seed, dims])
        self.parts = max(1, min(parts, dims // 8))
        self.cuts = np.array_split(np.arange(dims), self.parts)
        self.books = []
        for cut in self.cuts:
            book = rng.normal(size=(words, len(cut)))
            self.books.append(np.unique(np.round(book / np.linalg.norm(book, axis=1, keepdims=True), 12), axis=0))
        self.directions = int(np.prod([len(b) for b in self.books]))

    def _half(self, x: np.ndarray, chosen: range) -> np.ndarray:
        """Scores of all joint words of some parts: (rows, words ** len(chosen))."""
        total = np.zeros((len(x), 1))
        for p in chosen:
            total = (total[:, :, None] + (x[:, self.cuts[p]] @ self.books[p].T)[:, None, :]).reshape(len(x), -1)
        return total

    def decode(self, x: np.ndarray, height: float, least: int) -> list[np.ndarray]:
        """For each unit row, the ascending numbers of the directions whose caps it lies in."""
        middle = (self.parts + 1) // 2
        a, b = self._half(x, range(middle)), self._half(x, range(middle, self.parts))
        bar = height * np.sqrt(self.parts / x.shape[1])
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(x)
        todo, top = np.arange(len(x)), 24
        width = max(a.shape[1], b.shape[1])
        while len(todo):
            m, n = min(top, a.shape[1]), min(top, b.shape[1])
            ia, ib = np.argsort(-a[todo], 1, kind="stable"), np.argsort(-b[todo], 1, kind="stable")
            sa, sb = np.take_along_axis(a[todo], ia, 1), np.take_along_axis(b[todo], ib, 1)
            total = (sa[:, :m, None] + sb[:, None, :n]).reshape(len(todo), -1)
            k = min(least, total.shape[1])
            nearest = -np.partition(-total, k - 1, 1)[:, k - 1]
            limit = np.minimum(bar, nearest)
            # nothing beyond the best of either half may exceed the limit
            beyond = np.full(len(todo), -np.inf)
            if m < a.shape[1]:
                beyond = np.maximum(beyond, sa[:, m] + sb[:, 0])
            if n < b.shape[1]:
                beyond = np.maximum(beyond, sb[:, n] + sa[:, 0])
            sure = beyond < limit
            for r in np.flatnonzero(sure):
                at = np.flatnonzero(total[r] >= limit[r])
                out[todo[r]] = np.sort(ia[r, at // n] * b.shape[1] + ib[r, at % n]).astype(np.int32)
            todo, top = todo[~sure], min(top * 4, width)
        return out


class Sketch:
    """Unit vectors on ``WIDTH`` orthonormal axes at most, each coordinate as one of 255 steps.

    A projection brings vectors no farther apart, and a step is off by half its width at most, so
    the sketches of two vectors within a distance are within ``reach`` of it: no pair is lost.
    """

    WIDTH, STEPS = 64, 127

    def __init__(self, dims: int, seed: int = 7):
        rng = np.random.default_rng([seed, dims])
        self.axes = np.eye(dims, self.WIDTH) if dims <= self.WIDTH else np.linalg.qr(rng.normal(size=(dims, self.WIDTH)))[0]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(x @ self.axes, -1, 1) * self.STEPS).astype(np.int8)

    @classmethod
    def reach(cls, cosine: float) -> float:
        """Largest squared distance in steps of the sketches of unit vectors of this cosine or more."""
        return (cls.STEPS * (math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6) + math.sqrt(cls.WIDTH)) ** 2


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.98, mean: int = 15, least: int = 20, block: int = 512,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows of one label (not null) and dimension whose cosine in double precision is at least
    ``cosine`` are linked. Equal vectors of a label are one class, compared once and counted with
    all their rows. Unusable vectors (null, empty, zero, null or non-finite components) and null
    labels have no links and are their own component; null ids are kept and name a component only
    if it has no other id. An empty table gives no rows.
    """
    usable_row = usable(vector_col) & F.col(label_col).isNotNull()
    node = F.when(usable_row, F.xxhash64(label_col, vector_col))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), node.alias("node"))
    ids = base.select("vec_id", "node")
    classes = base.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = materialize(classes, "classes")
    # as many directions as keep the number of vectors for each direction about the same
    words = 256 * max(1, math.ceil(math.sqrt(classes.count() / 2**20)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, tuple[ProductCode, Sketch]] = {}
        for pdf in batches:
            dims = pdf["vector"].map(len).to_numpy()
            for d in np.unique(dims):
                part = pdf[dims == d]
                code, sketch = codes.setdefault(int(d), (ProductCode(int(d), words=words), Sketch(int(d))))
                height = NormalDist().inv_cdf(1 - min(0.5, mean / code.directions))
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    x = np.stack(some["vector"].to_numpy()).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    yield some[["label", "node", "weight", "vector"]].assign(dims=int(d), sketch=[v.tobytes() for v in sketch.of(x)], others=code.decode(x, height, least))

    reach = Sketch.reach(cosine)

    def mark(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """The rows that may have a near one in their group."""
        steps = np.frombuffer(b"".join(pdf["sketch"]), np.int8).reshape(len(pdf), -1).astype(np.float32)
        own, apart, size = pdf["own"].to_numpy(), (pdf["bi"] != pdf["bj"]).to_numpy(), np.diff(starts)
        found = np.zeros(len(pdf), bool)
        little = np.flatnonzero(size <= 24)
        if len(little):
            at = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in little])
            for i, j in shifted_pairs(np.concatenate([[0], np.cumsum(size[little])]), own[at], apart[at]):
                i, j = at[i], at[j]
                near = np.square(steps[i] - steps[j]).sum(1) <= reach
                found[i[near]] = found[j[near]] = True
        for g in np.flatnonzero(size > 24):
            lo, hi = starts[g], starts[g + 1]
            x = steps[lo:hi]
            square = np.square(x).sum(1)
            near = square[:, None] + square - 2 * (x @ x.T) <= reach  # whole numbers below 2 ** 24, so exact
            near &= own[lo:hi, None] != own[None, lo:hi] if apart[lo] else ~np.eye(hi - lo, dtype=bool)
            found[lo:hi] = near.any(1)
        yield pdf.loc[found, ["label", "dims", "direction", "node"]]

    def compare(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        node, weight, direction = pdf["node"].to_numpy(), pdf["weight"].to_numpy(), pdf["direction"].to_numpy()
        own, apart = pdf["own"].to_numpy(), (pdf["bi"] != pdf["bj"]).to_numpy()
        links, seen = np.zeros(len(pdf), np.int64), []
        size = np.diff(starts)
        for d in np.unique(pdf["dims"].to_numpy()[starts[:-1]]):
            groups = np.flatnonzero(pdf["dims"].to_numpy()[starts[:-1]] == d)
            rows = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in groups])
            x = np.zeros((len(pdf), int(d)))
            x[rows] = np.stack(pdf["vector"].to_numpy()[rows]).astype(np.float64)
            x[rows] /= np.linalg.norm(x[rows], axis=1, keepdims=True)
            little = groups[size[groups] <= 24]
            if len(little):
                at = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in little])
                edges = np.concatenate([[0], np.cumsum(size[little])])
                for i, j in shifted_pairs(edges, own[at], apart[at]):
                    i, j = at[i], at[j]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
                        # a pair counts in the first direction that both lists hold
                        if np.intersect1d(pdf["others"].iat[p], pdf["others"].iat[q], assume_unique=True)[0] == direction[p]:
                            links[p] += weight[q]
                            links[q] += weight[p]
                            seen.append((np.array([p]), np.array([q])))
            for g in groups[size[groups] > 24]:
                lo, hi = starts[g], starts[g + 1]
                near = np.triu(x[lo:hi] @ x[lo:hi].T >= cosine, 1)
                if apart[lo]:
                    near &= own[lo:hi, None] != own[None, lo:hi]
                if not near.any():
                    continue
                earlier = [v[v < direction[lo]] for v in pdf["others"].iloc[lo:hi]]
                number = {v: k for k, v in enumerate(np.unique(np.concatenate(earlier)).tolist())}
                if number:
                    holds = np.zeros((hi - lo, len(number)), np.float32)
                    for r, v in enumerate(earlier):
                        holds[r, [number[k] for k in v.tolist()]] = 1
                    near &= holds @ holds.T == 0
                i, j = np.nonzero(near)
                links[lo:hi] += np.bincount(i, weight[lo + j], hi - lo).astype(np.int64) + np.bincount(j, weight[lo + i], hi - lo).astype(np.int64)
                seen.append((lo + i, lo + j))
        if not seen:
            return
        a, b = np.concatenate([p for p, _ in seen]), np.concatenate([q for _, q in seen])
        _, first, number = np.unique(node, return_index=True, return_inverse=True)
        label = contract(number[a], number[b], len(first))
        moved = np.flatnonzero(label != np.arange(len(label)))
        total = np.bincount(number, links, len(first)).astype(np.int64)
        some = np.flatnonzero(total)
        out = pd.DataFrame({"a": np.concatenate([node[first[label[moved]]], node[first[some]]]), "b": np.concatenate([node[first[moved]], node[first[some]]]), "n": np.concatenate([np.zeros(len(moved), np.int64), total[some]])})
        yield out

    kind = dict(rows.dtypes)[label_col]
    decoded = classes.select("label", "node", "weight", "vector").mapInPandas(index, f"label {kind}, node long, weight long, vector {dict(rows.dtypes)[vector_col]}, dims int, sketch binary, others array<int>")
    decoded = materialize(decoded, "decoded")
    keys = ["label", "dims", "direction"]
    directions = decoded.select("label", "dims", F.explode("others").alias("direction"), "node", "sketch")
    marked = materialize(compare_groups(block_pairs(directions, keys, "node", block), keys, mark, f"label {kind}, dims int, direction int, node long").distinct(), "marked")
    meeting = materialize(join_small(decoded.select("node", "weight", "vector", "others"), marked, ["node"]), "meeting")
    found = materialize(compare_groups(block_pairs(meeting, keys, "node", block), keys, compare, "a long, b long, n long"), "compared")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    grouped = components(found.where("n = 0").select("a", "b"))
    named = classes.select("node", "weight", "least").join(counts, "node", "left").join(grouped, "node", "left")
    named = named.select("node", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    least_of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least_of, "component").select("node", "n_links", "component_id"), "components")
    linked = ids.where("node IS NOT NULL").join(named.hint("shuffle_merge"), "node").select("vec_id", "n_links", "component_id")
    alone = ids.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
