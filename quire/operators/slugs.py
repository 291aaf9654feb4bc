"""Slugs made unique by the smallest free number, stored ones and natural numbers included.

In order of arrival a row takes its slug if that is free, else the slug with the smallest free
number from 2 on. Numbers that rows of one slug take only grow, so the k-th row that needs one gets
the k-th number that is neither stored nor claimed: a slug that ends in a number by itself claims
that number of its stem, if fewer rows of the stem came before than there are free numbers below.
Counts of rows before come from sums over ranges of the order; only the claims and stored numbers
of a stem are folded one after the other, never its rows. What is taken is kept as islands of
consecutive numbers, so a long run of stored ones is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.numbering import running_before
from quire.shared import materialize

_NUMBERED = r"(?s)^(.*)-([1-9][0-9]{0,8})$"


def _stem(slug: Column) -> Column:
    """stem and number of a slug that ends in a number from 2 on, else nulls."""
    number = F.regexp_extract(slug, _NUMBERED, 2)
    n = F.when(number != "", number.cast("long"))
    return F.struct(F.when(n >= 2, F.regexp_extract(slug, _NUMBERED, 1)).alias("stem"), F.when(n >= 2, n).alias("n"))


def _claimed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds the numbers of each stem, in ascending order: which claims hold, and the islands of taken ones.

    A part is whole stems, sorted by stem and number; stored numbers come before claims of theirs.
    """
    stem, gone, last, islands = None, 0, None, {}

    def closed() -> dict:
        xs = sorted(islands)
        ends = pd.Series([islands[x] for x in xs], dtype="int64").cumsum().tolist()
        return {"stem": stem, "base": None, "islands": [{"x": x, "taken": t} for x, t in zip(xs, ends, strict=True)]}

    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            if r.stem != stem:
                if stem is not None:
                    out.append(closed())
                stem, gone, last, islands = r.stem, 0, None, {}
            claims = r.base is not None
            if r.n == last or (claims and r.ahead >= r.n - 1 - gone):  # stored, or a row of the stem has it
                continue
            if claims:
                out.append({"stem": None, "base": r.base, "islands": None})
            x = r.n - 2 - gone
            islands[x] = islands.get(x, 0) + 1
            gone, last = gone + 1, r.n
        yield pd.DataFrame(out, columns=["stem", "base", "islands"])
    if stem is not None:
        yield pd.DataFrame([closed()], columns=["stem", "base", "islands"])


def free_slugs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` (ord, slug and more; ord is a unique integer) with ``free``, the slug each row gets; ``stored``: slug."""
    rows = materialize(incoming.select("ord", F.col("slug").alias("base")), "slugs")
    taken = materialize(stored.select("slug").distinct().select("slug", _stem(F.col("slug")).alias("s")).select("slug", "s.stem", "s.n"), "taken")
    bases = rows.groupBy("base").agg(F.min("ord").alias("first")).withColumn("s", _stem(F.col("base"))).select("base", "first", "s.stem", "s.n")
    bases = bases.join(taken.select(F.col("slug").alias("base"), F.lit(True).alias("kept")), "base", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    parents = bases.select(F.col("base").alias("stem"), F.col("first").alias("stem_first"))
    bases = materialize(bases.join(parents, "stem", "left"), "bases")
    # rows of a slug before each of its rows, and before each claim on one of its numbers
    claims = bases.where("stem_first IS NOT NULL").select("first", "stem")
    both = rows.select("ord", "base", F.lit(1).alias("w")).unionByName(claims.select(F.col("first").alias("ord"), F.col("stem").alias("base"), F.lit(0).alias("w")))
    placed = materialize(running_before(both, "base", "ord", F.col("w"), "before", rows), "placed")
    ahead = placed.where("w = 0").select(F.col("ord").alias("first"), F.col("base").alias("stem"), "before")
    bases = materialize(bases.join(ahead, ["first", "stem"], "left"), "claims")
    # who keeps its own slug: first those that claim nothing, then those whose stem is known
    known = materialize(bases.where("stem_first IS NULL").select("base", (~F.col("kept")).alias("own")), "own")
    level, islands = known, None
    while True:
        here = bases.where("stem_first IS NOT NULL").join(level.select(F.col("base").alias("stem"), F.col("own").alias("stem_own")), "stem")
        late = F.col("before") - (F.col("stem_own") & (F.col("stem_first") < F.col("first"))).cast("long")
        asked = here.where("NOT kept").select("stem", "n", "base", late.alias("ahead"))
        stems = level.select(F.col("base").alias("stem"))
        held = taken.where("n IS NOT NULL").join(stems, "stem", "left_semi").select("stem", "n", F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("ahead"))
        dealt = asked.unionByName(held).repartition("stem").sortWithinPartitions("stem", "n", F.col("base").isNotNull())
        found = materialize(dealt.mapInPandas(_claimed, "stem string, base string, islands array<struct<x:long,taken:long>>"), "claimed")
        new = found.where("stem IS NOT NULL").select("stem", "islands")
        islands = new if islands is None else islands.unionByName(new)
        level = here.select("base").join(found.where("base IS NOT NULL").select("base", F.lit(True).alias("own")), "base", "left").withColumn("own", F.coalesce("own", F.lit(False)))
        level = materialize(level, "own")
        if not level.head(1):
            break
        known = known.unionByName(level)
    at = placed.where("w = 1").select("ord", "base", "before").join(known, "base").join(islands.withColumnRenamed("stem", "base"), "base", "left")
    k = F.col("before") + 1 - F.col("own").cast("long")
    passed = F.coalesce(F.array_max(F.transform(F.filter("islands", lambda i: i["x"] < k), lambda i: i["taken"])), F.lit(0))
    free = F.when(F.col("own") & (F.col("before") == 0), F.col("base")).otherwise(F.concat("base", F.lit("-"), k + 1 + passed))
    return incoming.join(at.select("ord", free.alias("free")), "ord")
