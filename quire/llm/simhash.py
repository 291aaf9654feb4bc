"""SimHash near-dedup with pivot distance tables.

Each fingerprint gets a row of Hamming distances to many reference fingerprints. Two fingerprints
within ``radius`` bits differ by at most ``radius`` in every coordinate, so pairs with a larger
coordinate difference are discarded before their bits are compared.

The references are chosen so that the table also yields keys: beside random ones there is one base
fingerprint and, for each bit of each stripe of bits, the base with that bit turned. The
differences of these coordinates to the base's are the same for two fingerprints that agree on the
stripe. With more stripes than ``radius``, two fingerprints within ``radius`` bits agree on all
stripes of one of the ``combinations(stripes, stripes - radius)`` choices, so joining on the
coordinates of each choice loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import block_pairs, compare_groups, shifted_pairs
from quire.llm.common import BROADCAST_ROWS, join_small, materialize
from quire.llm.components import components, contract

SEED = 42


def fingerprint(text: str | None, shingle: int = 4, distinct: bool = False) -> int:
    """SimHash of the lower-cased words' shingles, repeats included unless ``distinct``; 0 without a word.

    A bit is 1 if it is set in over half of the shingles' XXH64. Fewer words than a shingle make
    one sequence.
    """
    h = _hashes(text, shingle, distinct and shingle == 1)
    return _bits(np.unique(h) if distinct else h)


def _hashes(text: str | None, shingle: int, once: bool = False) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, in order; each word only ``once`` if asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if once:
        words = list(dict.fromkeys(words))
    joined = memoryview(b" ".join(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def _bits(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(h)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        count += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), of(F.col(text_col)).alias("fp"))


class Pivots:
    """Reference fingerprints and the keys that their coordinates give."""

    def __init__(self, radius: int = 4, stripes: int = 6, loose: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.radius = radius
        self.base = rng.integers(0, 2**63, dtype=np.uint64) << np.uint64(1) ^ rng.integers(0, 2**63, dtype=np.uint64)
        self.random = rng.integers(0, 2**63, loose, dtype=np.uint64) << np.uint64(1) ^ rng.integers(0, 2**63, loose, dtype=np.uint64)
        self.turned = self.base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
        self.stripes = np.array_split(np.arange(64), stripes)
        self.choices = [np.concatenate([self.stripes[i] for i in c]) for c in combinations(range(stripes), stripes - radius)]

    def table(self, fp: np.ndarray) -> np.ndarray:
        """Distances to base, turned and random references: a row of bytes for each fingerprint."""
        refs = np.concatenate([[self.base], self.turned, self.random])
        return np.bitwise_count(fp[:, None] ^ refs[None, :])

    def keys(self, table: np.ndarray) -> np.ndarray:
        """For each choice of stripes a number made of the coordinates' differences to the base's."""
        offset = (table[:, 1:65].astype(np.int16) - table[:, :1] + 1) // 2  # 0 or 1, as one bit was turned
        out = np.zeros((len(table), len(self.choices)), np.int64)
        for c, bits in enumerate(self.choices):
            for b in bits:
                out[:, c] = out[:, c] * 2 + offset[:, b]
        return out


def link_fingerprints(distinct: DataFrame, radius: int = 4, stripes: int = 6, block: int = 1024, check: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` bits; a spanning set of them.

    ``distinct`` has each fingerprint once, in column fp. With ``check`` it has a second
    fingerprint, too, in column second; pairs count only within ``check`` bits of that, and links
    are between the values of a column node.
    """
    pivots = Pivots(radius, stripes)
    node = "fp" if check is None else "node"
    payload = ["fp"] if check is None else ["fp", "second", "node"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pivots.keys(pivots.table(pdf["fp"].to_numpy(np.int64).view(np.uint64)))
            n, c = keys.shape
            yield pd.DataFrame({"choice": np.tile(np.arange(c, dtype=np.int32), n), "key": keys.ravel()} | {p: np.repeat(pdf[p].to_numpy(), c) for p in payload})

    def compare(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        bits = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        second = None if check is None else pdf["second"].to_numpy(np.int64).view(np.uint64)
        table = pivots.table(bits)[:, [0, *range(65, 65 + len(pivots.random))]].astype(np.int8)
        label = np.arange(len(pdf))
        pairs: list[np.ndarray] = []
        waiting = 0
        apart = (pdf["bi"] != pdf["bj"]).to_numpy()
        for i, j in shifted_pairs(starts, pdf["own"].to_numpy(), apart):
            near = label[i] != label[j]
            i, j = i[near], j[near]
            near = np.abs(table[i] - table[j]).max(1, initial=0) <= radius
            i, j = i[near], j[near]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= radius
            if second is not None:
                near &= np.bitwise_count(second[i] ^ second[j]) <= check
            pairs.append(np.stack([i[near], j[near]]))
            waiting += int(near.sum())
            if waiting > 500_000:
                label = _merge(label, *np.concatenate(pairs, 1))
                pairs, waiting = [], 0
        if pairs:
            label = _merge(label, *np.concatenate(pairs, 1))
        moved = np.flatnonzero(label != np.arange(len(label)))
        names = pdf[node].to_numpy()
        yield pd.DataFrame({"a": names[label[moved]], "b": names[moved]})

    kinds = "".join(f", {p} long" for p in payload)
    indexed = materialize(distinct.select(*payload).mapInPandas(index, f"choice int, key long{kinds}"), "index")
    dealt = block_pairs(indexed, ["choice", "key"], node, block)
    return compare_groups(dealt, ["choice", "key"], compare, "a long, b long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least index of the component) after the pairs (a, b) are linked too."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return contract(np.concatenate([a, at]), np.concatenate([b, label[at]]), len(label))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints at ``radius`` or fewer bits are linked; component_id is the least doc_id that
    links reach. Null and empty texts have fingerprint zero, linked like any other. Rows with a
    null id keep it and do not name a component unless there is no other id in it. Repeated rows
    are all returned. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(link_fingerprints(distinct, radius))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(least, "component").select("fp", "component_id"), "named")
    return prints.join(named.hint("shuffle_merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and component_id of every row; see ``similar_texts``. Edge cases are as in ``near_duplicates``."""
    rows, named = similar_texts(docs, id_col, text_col, **options)
    return rows.join(named.hint("shuffle_merge"), "node").select("doc_id", "component_id")


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    radius: int = 6, stripes: int = 8, check: int = 14, share: int = 80, shingle: int = 5, block: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """doc_id and node (hash of the text) of every row; component (a node) and component_id (least doc_id) of every node.

    Texts are linked at a Jaccard similarity of ``share`` percent or more, that of their sets of
    hashed shingles, and every link is verified by it. Pairs are sought in three ways. SimHash pivot tables (words within ``radius`` bits, shingles within
    ``check``) and the least text of each shared key link most groups in work linear in their size.
    Then all texts that share a key and are not linked yet are compared, so no pair is lost: in
    any one order of shingles, two sets that similar share one of their first
    n - ceil(n * ``share`` / 100) + 1, which are the keys. Shingles common in a sample come last in
    the order, so that passages found everywhere are seldom keys. Before sets are read, pairs whose
    parities (bits, each turned by the shingles hashed to it) differ in more bits than sets that
    similar differ in shingles are left out. There are 1,024 of them to compare all texts of a key
    by, and two or more for each shingle to tell from which pairs sets are read; the longer parity
    of a pair is folded to the shorter. Texts without a word are alike.
    """
    texts = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    common = _common_shingles(texts, shingle)

    @F.pandas_udf("fp long, second long, n int, parity array<long>, wide array<long>, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = _hashes(t, shingle)
            kept = _set(h)
            last = common[np.searchsorted(common[:-1], kept)] == kept
            keys = np.concatenate([kept[~last], kept[last]])[: len(kept) + len(kept) * -share // 100 + 1]
            wide = _parity(kept, max(1024, 1 << (2 * len(kept) - 1).bit_length()))
            out.append((fingerprint(t, 1, True), _bits(h), len(kept), _parity(kept, 1024), wide if len(wide) > 16 else None, keys.view(np.int64)))
        fp, second, n, parity, wide, keys = zip(*out, strict=True) if out else ((),) * 6
        return pd.DataFrame({"fp": np.array(fp, np.uint64).view(np.int64), "second": np.array(second, np.uint64).view(np.int64), "n": np.array(n, np.int32), "parity": list(parity), "wide": pd.Series(wide, dtype=object), "keys": list(keys)})

    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("node"), of(F.col(text_col)).alias("p"))
    prints = materialize(prints.select("doc_id", "node", "p.*"), "fingerprints")
    nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    twice = materialize(nodes.where("rows > 1").select("node"), "twice")
    figures = prints.drop("doc_id")
    distinct = join_small(figures, twice, ["node"], "left_anti").unionByName(join_small(figures, twice, ["node"], "left_semi").dropDuplicates(["node"]))

    # Texts that share a key, and the least of them.
    keyed = distinct.select("node", F.explode("keys").alias("key"))
    lows = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = materialize(join_small(keyed, materialize(lows.select("key", "low"), "lows"), ["key"]).select("key", "node", "low"), "shared").where("low < node")
    sought = link_fingerprints(distinct, radius, stripes, check=check).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = materialize(sought.unionByName(shared.select(F.col("low").alias("a"), F.col("node").alias("b"))).where("a < b").distinct(), "first-pairs")
    links = _verified(materialize(_likely(first, distinct, share), "likely"), texts, share, shingle)

    # All others that share a key, but for those linked already.
    label = materialize(components(links), "first-components").select("node", "component")
    rest = materialize(join_small(shared.drop("low"), label, ["node"], "left").withColumn("component", F.coalesce("component", "node")), "rest")
    mixed = materialize(rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "mixed")
    rest = join_small(rest, mixed, ["key"], "left_semi").join(distinct.select("node", "n", "parity").hint("shuffle_merge"), "node")

    def compare(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        node, label, n = pdf["node"].to_numpy(), pdf["component"].to_numpy(), pdf["n"].to_numpy(np.int64)
        parity = np.stack(pdf["parity"]).view(np.uint64)
        apart = (pdf["bi"] != pdf["bj"]).to_numpy()
        for i, j in shifted_pairs(starts, pdf["own"].to_numpy(), apart):
            near = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * share)
            i, j = i[near], j[near]
            near = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64) * (100 + share) <= (n[i] + n[j]) * (100 - share)
            if near.any():
                a, b = node[i[near]], node[j[near]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = block_pairs(materialize(rest, "unlinked"), ["key"], "node", block)
    others = compare_groups(dealt, ["key"], compare, "a long, b long").distinct().join(first.hint("shuffle_merge"), ["a", "b"], "left_anti")
    others = materialize(_likely(materialize(others, "other-pairs"), distinct, share), "others-likely")
    found = components(links.unionByName(_verified(others, texts, share, shingle)))
    grouped = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node"), materialize(grouped.join(least, "component").select("node", "component", "component_id"), "named")


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of the distinct ``hashes`` falls on each of ``bits``, as 64-bit words."""
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).view(np.int64)


def _likely(pairs: DataFrame, distinct: DataFrame, share: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sizes and parities do not rule out that they are ``share`` percent alike."""

    def fold(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def near(x: Column, y: Column) -> Column:
        bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
        return bits * (100 + share) <= (F.col("n_a") + F.col("n_b")) * (100 - share)

    def side(name: str) -> DataFrame:
        return distinct.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"p_{name}"), F.col("wide").alias(f"w_{name}")).hint("shuffle_merge")

    found = pairs.join(side("a"), "a").join(side("b"), "b")
    found = found.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * share).where(near(F.col("p_a"), F.col("p_b")))
    x, y = F.col("w_a"), F.col("w_b")
    # sets that similar differ in size by less than half, so one fold is enough
    x, y = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    return found.where(F.col("w_a").isNull() | F.col("w_b").isNull() | near(x, y)).select("a", "b")


def _set(h: np.ndarray) -> np.ndarray:
    """The distinct hashes in order; without any, zero alone, so that all such texts are alike."""
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def _common_shingles(texts: DataFrame, shingle: int, sample: int = 8192, most: int = 100_000) -> np.ndarray:
    """Hashes, in order and closed by the largest, of shingles in three or more of about ``sample`` texts.

    They only put keys in order; no pair hangs on them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["text"]:
                yield pd.DataFrame({"h": _set(_hashes(t, shingle)).view(np.int64)})

    rows = texts.count()
    some = texts.select("text").sample(min(1.0, sample / max(1, rows)), SEED).mapInPandas(run, "h long")
    found = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).select("h").toPandas()
    return np.append(np.sort(found["h"].to_numpy(np.int64).view(np.uint64)), np.uint64(2**64 - 1))


def _verified(pairs: DataFrame, texts: DataFrame, share: int, shingle: int) -> DataFrame:
    """The ``pairs`` (a, b: nodes of ``texts``) whose sets of hashed shingles are ``share`` percent alike or more."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([_set(_hashes(t, shingle)).view(np.int64) for t in texts], dtype=object)

    needed = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "needed")
    read = join_small(texts, needed, ["node"], "left_semi").dropDuplicates(["node"])
    sets = materialize(read.select("node", shingles("text").alias("set")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("shuffle_merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("shuffle_merge"), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("all"), F.size(F.array_intersect("x", "y")).alias("held"))
    return materialize(both.where(F.col("held") * 100 >= share * (F.col("all") - F.col("held"))).select("a", "b"), "links")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, and all rows without copies.

    Rows are told apart by id and text, so texts of one id that are not alike all stay, whatever
    the id, null ids too. Of a group the row of least id stays (null ids last, then by the hash of
    the text), and of rows alike in id and text one.
    """
    rows, named = similar_texts(docs, id_col, text_col, **options)
    rows = materialize(rows.groupBy("doc_id", "node").agg(F.count("*").alias("rows")), "rows")
    grouped = rows.join(named.select("node", "component").hint("shuffle_merge"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first")
    keeper = grouped.groupBy("component").agg(first)
    gone = grouped.join(keeper, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))))
    gone = materialize(gone.select(F.col("doc_id").alias("__doc"), F.col("node").alias("__node")), "gone")
    here = (F.col(id_col).cast("long").eqNullSafe(F.col("__doc"))) & (F.xxhash64(text_col) == F.col("__node"))
    keyed = lambda right, n: F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("shuffle_merge")
    kept = docs.join(keyed(gone, gone.count()), here, "left_anti")
    twice = materialize(rows.where("rows > 1").select(F.col("doc_id").alias("__doc"), F.col("node").alias("__node")), "repeated-rows")
    if not (n := twice.count()):
        return kept
    again = kept.join(keyed(twice, n), here, "left_semi").withColumn("__node", F.xxhash64(text_col)).dropDuplicates([id_col, "__node"]).drop("__node")
    return kept.join(keyed(twice, n), here, "left_anti").unionByName(again)
