"""Shards of near equal bytes by a k-d tree over the metadata of distinct texts.

Texts are first reduced to points: one row for each distinct text, with the bytes of all its
copies and the metadata of the copy of least id. Only a text whose copies hold more than a part of
a shard, and more than the largest row, is dealt into several points, by the hash of its rows' ids. A node of the tree that is to
become several shards is split along its widest metadata dimension at the weighted median (the
quantile at the share of shards that go left), until a leaf is one shard of the target bytes.

Medians come from histograms: all points are binned by node and the leading bits of their key, and
the bin with the median is looked into with more bits until what is in it no longer counts. So
points are never shuffled for a split; a level of the tree is a few scans of a narrow table whose
partial sums are at most (nodes x bins) rows. Keys are the coordinate followed by bits of the
text's hash, so any quantile can be met even if all coordinates are equal. The thresholds of a
level, one a node, are all that the driver holds; points find their child by looking them up in
arrays, inside generated code, and are written with it once a level, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize
from quire.operators.numbering import numbered_rows

#: Bytes that a row costs beside its text.
ROW_BYTES = 16
#: Coordinates and their tie-breaking hashes have so many bits.
COORD_BITS, TIE_BITS = 31, 32
#: Bits of the key that one histogram tells apart.
STEP_BITS = 10
#: Copies of a text stay together up to this share of a shard's bytes, or the bytes of the largest row.
GROUP_SHARE = 0.02
#: A split is near enough when what lies between it and the exact quantile is this share of a shard.
SLACK = 0.001
DIMENSIONS = ("size", "doc_id", "source", "lang")


def sizes(text: Column) -> Column:
    """Bytes of the text in UTF-8 and those of a row; null texts have none of their own."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _lookup(values: list[int], at: Column) -> Column:
    """The value at a place (from 0) of a list that the driver knows, a constant of the query."""
    known = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    return F.element_at(known, (at + 1).cast("int"))


def _prefix(low: str | None, high: str | None) -> int:
    """Characters that all strings between two share at their beginning."""
    n = 0
    while low and high and n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return n


def _coordinates(points: DataFrame) -> DataFrame:
    """``points`` with coords: for each dimension a whole number of COORD_BITS bits in its order, 0 for null.

    Sizes count by their logarithm; of names the seven bytes behind what all begin with count.
    """
    names = ("source", "lang")
    edges = points.agg(*(f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max)))).first()
    raw = {"size": F.log(F.col("bytes").cast("double")), "doc_id": F.col("doc_id").cast("double")}
    for c in names:
        rest = F.substring(F.col(c), _prefix(edges[f"low_{c}"], edges[f"high_{c}"]) + 1, 7).cast("binary")
        raw[c] = F.conv(F.rpad(F.substring(F.hex(rest), 1, 14), 14, "0"), 16, 10).cast("double")
    wide = points.select("*", *(v.alias(f"raw_{c}") for c, v in raw.items()))
    ends = wide.agg(*(f(f"raw_{c}").alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("low", F.min), ("high", F.max)))).first()
    most = (1 << COORD_BITS) - 1

    def scaled(c: str) -> Column:
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        if low is None:
            return F.lit(0).cast("long")
        width = (high - low) or 1.0
        return F.coalesce(1 + F.floor((F.col(f"raw_{c}") - F.lit(low)) / F.lit(width) * (most - 2)), F.lit(0)).cast("long")

    return wide.select(*points.columns, F.array(*map(scaled, DIMENSIONS)).alias("coords"))


def _key(dimension: Column) -> Column:
    """The key of a point along a dimension given by its number."""
    return F.shiftleft(F.element_at("coords", (dimension + 1).cast("int")), TIE_BITS).bitwiseOR(F.col("tie"))


def _descend(points: DataFrame, level: list[tuple[int, int]]) -> DataFrame:
    """``points`` at their children in the next level; ``level`` has dimension and threshold of each node."""
    keyed = points.withColumn("dim", _lookup([d for d, _ in level], F.col("node"))).withColumn("key", _key(F.col("dim")))
    right = F.col("key") >= _lookup([t for _, t in level], F.col("node"))
    return keyed.withColumn("node", F.col("node") * 2 + right.cast("long")).drop("dim", "key")


def _medians(points: DataFrame, nodes: dict[int, tuple[int, int]], level: list[int], slack: float) -> dict[int, int]:
    """Thresholds of nodes: node to the least key that goes right.

    ``nodes``: node to dimension and bytes that are to go left; ``level``: dimension by node.
    """
    bits = COORD_BITS + TIE_BITS
    low = dict.fromkeys(nodes, 0)  # what is left of the bins looked into
    base = dict.fromkeys(nodes, 0)  # their first key
    found: dict[int, int] = {}
    shift = bits
    own = points.withColumn("dim", _lookup(level, F.col("node"))).withColumn("key", _key(F.col("dim")))
    while len(found) < len(nodes):
        width = min(STEP_BITS, shift)
        shift -= width
        # a node is still looked into where its threshold is not found
        first = [base[n] if n in nodes and n not in found else -1 for n in range(len(level))]
        seen = own.withColumn("start", _lookup(first, F.col("node"))).where("start >= 0 AND key >= start")
        seen = seen.withColumn("bin", F.shiftright(F.col("key") - F.col("start"), shift)).where(F.col("bin") < (1 << width))
        rows = seen.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        held: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r.node, r.bin)):
            held.setdefault(r.node, []).append(r)
        for n in [n for n in nodes if n not in found]:
            before, want = low[n], nodes[n][1]
            for r in held.get(n, []):
                if before + r.w > want:
                    break
                before += r.w
            else:
                found[n] = base[n] + (1 << (shift + width))  # rounding put it behind all
                continue
            at = base[n] + (r.bin << shift)
            if r.n == 1 or r.w <= slack or shift == 0:
                # the bin goes to the side that leaves the smaller error
                found[n] = at + (1 << shift) if want - before > before + r.w - want else at
            else:
                low[n], base[n] = before, at
    return found


def grown(points: DataFrame, shards: int, total: int) -> DataFrame:
    """``points`` (weight, tie and coordinates) with the shard of their leaf, in order of leaves.

    Nodes of a level are numbered by their way from the root. A node of one shard goes on to the
    left as it is.
    """
    counts = [shards]
    now = points.withColumn("node", F.lit(0).cast("long"))
    over = (1 << (COORD_BITS + TIE_BITS)) - 1
    while max(counts) > 1:
        spans = [F.max(F.col("coords")[i]) - F.min(F.col("coords")[i]) for i in range(len(DIMENSIONS))]
        boxes = now.groupBy("node").agg(F.sum("weight").alias("w"), *(s.alias(f"span_{c}") for s, c in zip(spans, DIMENSIONS, strict=True))).collect()
        want: dict[int, tuple[int, int]] = {}
        dims = [0] * len(counts)
        for box in boxes:
            if (k := counts[box.node]) > 1:
                span = [box[f"span_{c}"] for c in DIMENSIONS]
                dims[box.node] = span.index(max(span))
                want[box.node] = (dims[box.node], box.w * (k // 2) // k)
        cuts = _medians(now, want, dims, total / shards * SLACK)
        level = [(dims[n], min(cuts.get(n, over), over)) if k > 1 else (0, over) for n, k in enumerate(counts)]
        now = materialize(_descend(now, level), "level")
        counts = [c for k in counts for c in ((k // 2, k - k // 2) if k > 1 else (k, 0))]
    number, at = [], 0
    for k in counts:
        number.append(at)
        at += k
    return now.withColumn("shard", _lookup(number, F.col("node")).cast("int")).drop("node")


def shards(docs: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """id, size, text_crc32, shard (0 to ``count`` - 1) and slot (from 0, by id) of every row.

    Shards hold near equal bytes. Equal texts are in one shard unless their bytes are over
    GROUP_SHARE of a shard and over those of the largest row; those of larger groups are dealt by the hash of their ids, so rows
    alike in id and text stay together. Null ids, sources and languages come first in their
    dimension; a null text has the size and crc32 of an empty one. Repeated rows are all returned,
    extra columns are not. With fewer points than shards, shards are left empty; an empty table
    gives no rows.
    """
    col = lambda c: F.col(f"`{c}`")
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), col(lang_col).cast("string").alias("lang"),
        sizes(col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.hash(text, F.lit(1)).alias("h2"),
    )
    rows = materialize(rows, "sizes")
    figures = rows.agg(F.sum("size").alias("total"), F.max("size").alias("most")).first()
    total = figures["total"] or 0
    most = max(1, int(total / count * GROUP_SHARE), figures["most"] or 0)
    # at most count / GROUP_SHARE texts have so many bytes
    large = rows.groupBy("h1", "h2").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where((F.col("w") > most) & (F.col("n") > 1))
    large = materialize(large.select("h1", "h2", F.ceil(F.col("w") / most).alias("pieces")), "large")
    rows = join_small(rows, large, ["h1", "h2"], "left")
    rows = rows.withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("pieces")))).drop("pieces")
    points = rows.groupBy("h1", "h2", "piece").agg(F.sum("size").alias("weight"), F.max("size").alias("bytes"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    points = points.select("h1", "h2", "piece", "weight", "bytes", "first.*", F.xxhash64("h1", "h2", "piece").bitwiseAND((1 << TIE_BITS) - 1).alias("tie"))
    points = materialize(_coordinates(materialize(points, "points")), "coordinates")
    leaves = grown(points, count, total).select("h1", "h2", "piece", "shard")
    out = rows.join(leaves, ["h1", "h2", "piece"]).select("doc_id", "size", "text_crc32", "shard", "h1")
    out = numbered_rows(out, "shard", "doc_id", "h1", name="slot")
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, found: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` as Parquet by shard, in order of slot; ``found`` is what ``shards`` gives for them.

    A shard is written by as many tasks as its rows take, so it may be larger than a task.
    """
    named = found.groupBy(F.col(id_col).alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size")).agg(F.min("shard").alias("shard"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    keyed = docs.join(named, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (crc == F.col("__crc")) & (sizes(F.col(text_col)) == F.col("__size"))).drop("__id", "__crc", "__size")
    keyed.repartitionByRange("shard", id_col).sortWithinPartitions("shard", id_col).write.partitionBy("shard").parquet(path)
