"""Packing documents into fixed-length sequences by a linear grouping scheme.

The plan needs only how many pieces there are of each length, so it is made from a table of at
most ``capacity`` rows, whatever the corpus. Large lengths are sorted, cut into groups of equal
cardinality and rounded up within each group; configurations of the few rounded sizes are
optimised as a linear program by column generation; actual lengths then take the place of the
rounded ones, and what remains (small pieces, and large ones left by rounding the program down)
goes best-fit into the gaps. The plan says, for each length and range of ranks, which sequences
and offsets the pieces take; every piece finds its place from its length and its rank among
pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

#: Texts that a task holds as Python strings at a time.
TEXTS = 256
#: Rows of a plan: length, first rank, pieces, first sequence, offset.
Plan = list[tuple[int, int, int, int, int]]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Columns (configurations) and how often to use each, by column generation over ``sizes``."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(np.float64))
    use = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
        order = np.argsort(sizes)
        s, w = sizes[order], worth[order]
        for c in range(1, capacity + 1):
            m = np.searchsorted(s, c, "right")
            best[c] = best[c - 1]
            if m:
                gain = best[c - s[:m]] + w[:m]
                i = int(gain.argmax())
                if gain[i] > best[c] + 1e-12:
                    best[c], took[c] = gain[i], order[i]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= int(sizes[took[c]])
        step = np.linalg.solve(basis, column)
        ok = step > 1e-9
        ratio = np.full(k, np.inf)
        ratio[ok] = np.maximum(use[ok], 0) / step[ok]
        out = int(ratio.argmin())
        use = use - ratio[out] * step
        use[out] = ratio[out]
        basis[:, out] = column
    return basis.astype(np.int64), use


def plan_packing(counts: dict[int, int], capacity: int = 1024, groups: int = 64, small: int = 8, loose: int = 0) -> Plan:
    """A plan for pieces of lengths 1 to ``capacity``; pieces of up to ``capacity // small`` are small.

    ``loose``: so many of the least pieces of a configuration are left to the best-fit step, which
    knows the actual gaps; the others keep the places that the configuration gives them.
    """
    plan: Plan = []
    made = 0
    if counts.get(capacity):
        plan.append((capacity, 0, counts[capacity], 0, 0))
        made = counts[capacity]
    left = {n: c for n, c in counts.items() if n < capacity and c}
    rank = dict.fromkeys(left, 0)
    # gaps: by free space, the runs of sequences that have it: [sequences, [(length, first rank), ...]]
    gaps: dict[int, list] = {}
    free: list[int] = []
    done: list[list] = []

    def keep(space: int, run: list) -> None:
        if not run[0]:
            return
        if space <= 0:
            done.append(run)
            return
        if space not in gaps:
            gaps[space] = []
            insort(free, space)
        gaps[space].append(run)

    lengths = np.array(sorted((n for n in left if n > capacity // small), reverse=True), np.int64)
    if len(lengths):
        number = np.array([left[int(n)] for n in lengths], np.int64)
        ends = np.cumsum(number)
        total = int(ends[-1])
        k = min(groups, len(lengths), total)
        bounds = np.unique(np.round(np.linspace(0, total, k + 1)).astype(np.int64))
        size_of = lengths[np.searchsorted(ends, bounds[:-1], "right")]
        # neighbours that round to the same size are one group
        first = np.concatenate([[True], size_of[1:] != size_of[:-1]])
        sizes, begin = size_of[first], bounds[:-1][first]
        demand = np.diff(np.append(begin, total))
        basis, use = configurations(sizes, demand.astype(np.float64), capacity)
        used = begin.copy()
        limit = np.append(begin[1:], total)
        for c in np.argsort(-use, kind="stable"):
            column = basis[:, c]
            kinds = np.flatnonzero(column)
            times = int(min(np.floor(use[c] + 1e-6), min((limit[g] - used[g]) // column[g] for g in kinds)))
            if times <= 0:
                continue
            slots = []
            spare = min(loose, int(column.sum()) - 1)
            for g in kinds:
                held = max(0, column[g] - max(0, spare - int(column[kinds[kinds > g]].sum())))
                for _ in range(held):
                    slots.append(int(used[g]))
                    used[g] += times
            cuts = {0, times}
            for p in slots:
                inner = ends[(ends > p) & (ends < p + times)] - p
                cuts.update(int(x) for x in inner)
            edges = sorted(cuts)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                parts, space = [], capacity
                for p in slots:
                    i = int(np.searchsorted(ends, p + a, "right"))
                    parts.append((int(lengths[i]), p + a - int(ends[i] - number[i])))
                    space -= int(lengths[i])
                keep(space, [b - a, parts])
        # ranks of each large length that no configuration took, as ranges
        rest: dict[int, list[tuple[int, int]]] = {}
        for g in range(len(sizes)):
            p, q = int(used[g]), int(limit[g])
            while p < q:
                i = int(np.searchsorted(ends, p, "right"))
                m = int(min(q, ends[i])) - p
                rest.setdefault(int(lengths[i]), []).append((p - int(ends[i] - number[i]), m))
                p += m
    else:
        rest = {}
    for n in left:
        if n <= capacity // small:
            rest[n] = [(0, left[n])]

    for n in sorted(rest, reverse=True):
        for lo, m in rest[n]:
            while m:
                i = bisect_left(free, n)
                if i < len(free):
                    space = free[i]
                    run = gaps[space].pop()
                    if not gaps[space]:
                        del gaps[space], free[i]
                    t = min(m, run[0])
                    if t < run[0]:
                        keep(space, [run[0] - t, [(l, r + t) for l, r in run[1]]])
                    keep(space - n, [t, [*run[1], (n, lo)]])
                    lo, m = lo + t, m - t
                else:
                    fit = capacity // n
                    whole = m // fit
                    if whole:
                        keep(capacity - fit * n, [whole, [(n, lo + j * whole) for j in range(fit)]])
                    extra = m - whole * fit
                    if extra:
                        keep(capacity - extra * n, [1, [(n, lo + whole * fit + j) for j in range(extra)]])
                    m = 0
    for runs in (done, *(gaps[s] for s in free)):
        for times, parts in runs:
            offset = 0
            for n, r in sorted(parts, reverse=True):
                plan.append((n, r, times, made, offset))
                offset += n
            made += times
    return plan


def sequences_of(plan: Plan) -> int:
    return max((s + m for _, _, m, s, _ in plan), default=0)


#: Groups, divisor of the small limit and loose pieces of the plans that are tried.
VARIANTS = ((40, 2, 0), (40, 3, 1), (80, 6, 2))


def best_plan(counts: dict[int, int], capacity: int, variants: tuple[tuple[int, int, int], ...] = VARIANTS) -> Plan:
    """The plan with fewest sequences over several groupings; stops at the lower bound."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best: Plan | None = None
    for groups, small, loose in variants:
        plan = plan_packing(counts, capacity, groups, small, loose)
        if best is None or sequences_of(plan) < sequences_of(best):
            best = plan
        if sequences_of(best) <= least:
            break
    return best or []


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; the first may be shorter."""

    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.llm.tokens import encoder

        enc, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # few texts at a time as Python strings
                rows = []
                some = batch.slice(at, TEXTS)
                for key, text in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    raw = enc.ids(text or "") + end
                    n = len(raw) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(key, p, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset, in as few sequences as the plan finds.

    Null texts count as empty (one end id). Null and repeated ids are kept; equal pieces may swap
    places. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    buckets = max(256, pieces.count() // 50_000)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    counts = materialize(pieces.groupBy("length", "bucket").count(), "counts")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = best_plan(histogram, capacity)
    table: dict[int, np.ndarray] = {}
    rows = np.array(sorted(plan), np.int64).reshape(-1, 5)
    for n in np.unique(rows[:, 0]):
        table[int(n)] = rows[rows[:, 0] == n, 1:]
    shared = spark.sparkContext.broadcast(table)  # grows with the capacity, not with the corpus

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), table[int(n)]
                i = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                sequence[at] = rows[i, 2] + rank[at] - rows[i, 0]
                offset[at] = rows[i, 3]
            yield pdf.assign(sequence_id=sequence, offset=offset, doc_id=pdf["doc_id"].mask(pdf["none"]).astype("Int64"))[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("local", local - 1).join(base.hint("shuffle_merge"), ["length", "bucket"])
    ranked = ranked.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
