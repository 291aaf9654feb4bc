"""Merkle manifest of a dataset: levels by windows, one tree a group and one over the groups' roots.

Every row is a leaf, the hash of its fields. The leaves of a group, in order of id, are hashed by
runs of eight until one node is left, its subroot; subroots, in order of group, likewise give the
root. A level is one window by (group, place of the parent): its ordered list of the whole frame is
at once what the parent hashes and where the siblings are, and one row of each run goes on as the
parent. Proofs are put together downwards, so each level is joined once with the next smaller one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize
from quire.operators.numbering import numbered_rows

#: Nodes that make one parent.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as it is hashed: its bytes in UTF-8, a colon and the value, or a hyphen for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Parents by level: tree, place, hash and children (their hashes in order).

    ``nodes``: tree, place (from 0), hash. A tree of one node has no parents, and a tree ends with
    its one parent of the last level; the driver learns one number a level, the largest place.
    """
    out: list[DataFrame] = []
    while (nodes.agg(F.max("place")).first()[0] or 0) > 0:
        run = Window.partitionBy("tree", F.floor(F.col("place") / FAN)).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = nodes.withColumns({"children": F.collect_list("hash").over(run), "parent": F.floor(F.col("place") / FAN)})
        alone = (F.col("parent") == 0) & (F.size("children") == 1)  # the one node of a tree that has ended
        parents = seen.where((F.col("place") % FAN == 0) & ~alone)
        nodes = materialize(parents.select("tree", F.col("parent").alias("place"), F.sha2(F.array_join("children", ""), 256).alias("hash"), "children"), "level")
        out.append(nodes)
    return out


def _step(children: Column, place: Column) -> Column:
    """The hashes before and after a node among the children of its parent, each joined."""
    at = (place % FAN).cast("int")
    before = F.array_join(F.slice(children, F.lit(1), at), "")
    return F.struct(before.alias("before"), F.array_join(F.slice(children, at + 2, F.lit(FAN)), "").alias("after"))


def _paths(levels: list[DataFrame], top: DataFrame | None) -> DataFrame | None:
    """The lowest parents with children and the path from them to the root.

    ``top``: tree and the path from the tree's own root on.
    """
    found: DataFrame | None = None
    for level in reversed(levels):
        here = level.select("tree", "place", "children")
        if top is not None:
            here = here.join(top.withColumnRenamed("path", "end"), "tree", "left")
        end = F.coalesce("end", F.array().cast(_PATH)) if top is not None else F.array().cast(_PATH)
        if found is None:
            found = here.select("tree", "place", "children", end.alias("path"))
            continue
        above = found.select(F.col("tree").alias("__t"), F.col("place").alias("__p"), F.col("children").alias("__c"), F.col("path").alias("__path"))
        joined = here.join(above, (F.col("tree") == F.col("__t")) & (F.floor(F.col("place") / FAN) == F.col("__p")), "left")
        up = F.concat(F.array(_step(F.col("__c"), F.col("place"))), F.col("__path"))
        found = joined.select("tree", "place", "children", F.when(F.col("__t").isNull(), end).otherwise(up).alias("path"))
    return found


def folded(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf_hash, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """id, leaf, subroot, root, path and, with ``tampered``, other_leaf of every row.

    Leaves of a group are in order of id, null ids first; rows of one id are in order of their
    leaves, and a null group comes first. Equal rows are leaves each, in any order, as their
    hashes are the same. ``tampered`` is the text put in place of ``text_col`` for other_leaf,
    null where the text was not tampered with. ``path`` has, from the leaf up, the joined hashes
    before and after a node in its run (empty where a node stands alone), through the subroot to
    the root. Other columns of ``rows`` are ignored; an empty table gives no rows.
    """
    value = lambda c: F.col(f"`{c}`")
    own = leaf(*(value(c) for c in fields))
    other = F.when(tampered.isNotNull(), leaf(*(tampered if c == text_col else value(c) for c in fields))) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), value(group_col).cast("string")), F.lit("0"))  # null first, then bytewise
    leaves = materialize(rows.select(value(id_col).alias("id"), tree.alias("tree"), own.alias("hash"), other.alias("other")), "leaves")
    leaves = materialize(numbered_rows(leaves, "tree", "id", "hash", name="place"), "places")
    levels = _levels(leaves.select("tree", "place", "hash"))
    firsts = [level.where("place = 0").select("tree", "hash", F.lit(i).alias("height")) for i, level in enumerate([leaves, *levels])]
    roots = reduce(DataFrame.unionByName, firsts).groupBy("tree").agg(F.max_by("hash", "height").alias("hash"))
    roots = materialize(roots, "subroots")
    named = numbered_rows(roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "hash"), "tree", "own", name="place")
    named = materialize(named, "subroot-places")
    over = _levels(named.select("tree", "place", "hash"))
    root = over[-1].select(F.col("hash").alias("root")) if over else named.select(F.col("hash").alias("root"))
    up = _paths(over, None)
    top = named.select(F.col("own").alias("tree"), F.col("hash").alias("subroot"), "place")
    if up is None:
        top = top.select("tree", "subroot", F.array().cast(_PATH).alias("end"))
    else:
        above = up.select(F.col("place").alias("__p"), "children", F.col("path").alias("__path"))
        top = top.join(above, F.floor(F.col("place") / FAN) == F.col("__p")).select("tree", "subroot", F.concat(F.array(_step(F.col("children"), F.col("place"))), F.col("__path")).alias("end"))
    top = materialize(top.withColumn("root", root.scalar()), "roots")
    below = _paths(levels, top.select("tree", F.col("end").alias("path")))
    out = join_small(leaves, top, ["tree"])
    path = F.col("end")
    if below is not None:
        above = below.select(F.col("tree").alias("__t"), F.col("place").alias("__p"), "children", F.col("path").alias("__path"))
        out = out.join(above, (F.col("tree") == F.col("__t")) & (F.floor(F.col("place") / FAN) == F.col("__p")), "left")
        path = F.when(F.col("__t").isNull(), path).otherwise(F.concat(F.array(_step(F.col("children"), F.col("place"))), F.col("__path")))
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", path.alias("path"), F.col("other").alias("other_leaf"))


def audit(docs: DataFrame, tampered: Column, id_col: str = "doc_id", **options) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; see ``manifest``."""
    found = manifest(docs, tampered, id_col, **options)
    again = folded(F.coalesce("other_leaf", "leaf"), F.col("path"))
    out = found.select(id_col, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def write_manifest(found: DataFrame, path: str) -> None:
    """The rows of ``manifest`` as Parquet files by subroot, so that a group is checked by itself."""
    found.write.partitionBy("subroot").parquet(path)
