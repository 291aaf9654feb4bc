"""Merges that take effect one after the other: who is absorbed into whom, and the fold of each tree.

A merge (ord, gone, into) takes effect if neither side has been absorbed before. Merges are
decided in rounds, many at a time: one is decided once no undecided merge that comes before it
could absorb either side. A round is an aggregate and two joins of the undecided merges; there are
as many rounds as the longest chain of people each absorbed before the next, and hubs that absorb
many need one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import names, text
from quire.shared import materialize


def absorptions(merges: DataFrame) -> DataFrame:
    """The merges (ord, gone, into) that take effect; ord is unique, merges into oneself never do."""
    left = materialize(merges.where("gone <> into").select("ord", "gone", "into"), "merges")
    done = [left.where(F.lit(False))]
    while left.head(1):
        first = left.groupBy(F.col("gone").alias("who")).agg(F.min("ord").alias("first"))
        mine = left.join(first.withColumnRenamed("who", "gone"), "gone").where("ord = first").drop("first")
        other = mine.join(first, F.col("into") == F.col("who"), "left").where("first IS NULL OR first > ord")
        effective = materialize(other.select("ord", "gone", "into"), "effective")
        done.append(effective)
        dead = effective.select(F.col("gone").alias("who"), F.col("ord").alias("died"))
        rest = left.join(dead, F.col("gone") == F.col("who"), "left_anti").join(dead, (F.col("into") == F.col("who")) & (F.col("ord") > F.col("died")), "left_anti")
        left = materialize(rest, "undecided")
    return reduce(DataFrame.unionByName, done)


def trees(effective: DataFrame) -> DataFrame:
    """id, root and path of everyone absorbed; path has the ords of the merges from the root down.

    In order of path, people come as they do when each tree is folded merge by merge. Roots are
    found by doubling, so rounds are the logarithm of the longest chain.
    """
    now = materialize(effective.select(F.col("gone").alias("id"), F.col("into").alias("root"), F.array("ord").alias("path")), "trees")
    while True:
        up = now.select(F.col("id").alias("__id"), F.col("root").alias("__root"), F.col("path").alias("__path"))
        joined = now.join(up, F.col("root") == F.col("__id"), "left")
        further = joined.where("__id IS NOT NULL").head(1)
        if not further:
            return now
        now = materialize(joined.select("id", F.coalesce("__root", "root").alias("root"), F.when(F.col("__id").isNull(), F.col("path")).otherwise(F.concat("__path", "path")).alias("path")), "trees")


def _members(people: DataFrame, merges: DataFrame) -> DataFrame:
    """``people`` with root (themselves, if they stay) and path (empty for roots); merges of unknown people count for nothing."""
    known = people.select("id")
    real = merges.join(known.withColumnRenamed("id", "gone"), "gone", "left_semi").join(known.withColumnRenamed("id", "into"), "into", "left_semi")
    placed = trees(absorptions(real))
    return people.join(placed, "id", "left").withColumns({"root": F.coalesce("root", "id"), "path": F.coalesce("path", F.array().cast("array<bigint>"))})


def reconciled(people: DataFrame, merges: DataFrame) -> DataFrame:
    """``people`` (id, name, aliases) after confirmed pairs of forms of one person, in their order.

    The absorbed person's name and aliases join those of the fuller name; united lists are sorted,
    without the name itself. People who absorb nobody keep their list as it is.
    """
    rows = _members(people, merges)
    forms = rows.where(F.size("path") > 0).select("root", F.explode(F.concat(F.array("name"), "aliases")).alias("form")).distinct()
    united = forms.groupBy("root").agg(F.collect_set("form").alias("__more"))
    kept = rows.where(F.size("path") == 0).drop("root", "path").join(united, F.col("id") == F.col("root"), "left")
    both = F.array_sort(F.array_distinct(F.concat("aliases", "__more")))
    aliases = F.when(F.col("__more").isNull(), F.col("aliases")).otherwise(F.filter(both, lambda a: a != F.col("name")))
    return kept.select(*(aliases.alias(c) if c == "aliases" else F.col(c) for c in people.columns))


def merged_people(people: DataFrame, merges: DataFrame, total_sections: int) -> DataFrame:
    """``people`` after merges by hand in their order, chains included; absorbed people are gone.

    ``people``: id, name, aliases, note, tier, reason, locked, edited, mentions, speech, sections
    (their number), chapters (which), first_section, last_section (0 is unknown). The name is the
    fullest of all forms, other names become aliases in order of the merges, chapters are united
    and counted, other counts add up. Merged people get the tier of their joint evidence unless
    locked, the first note there is, and count as edited.
    """
    rows = _members(people, merges)
    groups = rows.groupBy("root").agg(F.count("*").alias("n"))
    merged = rows.join(groups.where("n > 1").select("root"), "root", "left_semi")
    zero = F.lit(0)
    in_order = F.array_sort(F.collect_list(F.struct("path", "name", "aliases", "note")))
    root_of = lambda c: F.max(F.when(F.size("path") == 0, F.col(c))).alias(c)
    folded = merged.groupBy("root").agg(
        in_order.alias("m"), F.sum("mentions").alias("mentions"), F.sum("speech").alias("speech"), F.max("sections").alias("most"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chapters")))).alias("chapters"),
        F.coalesce(F.min(F.nullif("first_section", zero)), zero).alias("first_section"), F.max("last_section").alias("last_section"), root_of("tier"), root_of("locked"),
    )
    folded = folded.withColumn("name", names.display(F.transform("m", lambda x: x["name"])))
    forms = F.flatten(F.transform("m", lambda x: F.when(F.size(x["path"]) == 0, F.concat(x["aliases"], F.array(x["name"]))).otherwise(F.concat(F.array(x["name"]), x["aliases"]))))
    sections = F.coalesce(F.nullif(F.size("chapters"), zero), F.col("most").cast("int"))
    notes = F.filter(F.transform("m", lambda x: F.coalesce(x["note"], F.lit(""))), lambda x: x != "")
    spread = sections / F.lit(max(1, total_sections))
    reason = F.concat(F.lit("in "), F.bround(spread * 100, 0).cast("long"), F.lit("% of sections, "), "speech", F.lit(" spoken, "), "mentions", F.lit(" mentions; merged"))
    made = folded.select(
        F.col("root").alias("id"), "name", text.first_spellings(forms, F.col("name")).alias("aliases"), F.coalesce(F.try_element_at(notes, F.lit(1)), F.lit("")).alias("note"),
        F.when(F.col("locked"), F.col("tier")).otherwise(names.tier(spread, F.col("speech"), F.col("mentions"))).alias("tier"), reason.alias("reason"), "locked", F.lit(True).alias("edited"),
        "mentions", "speech", sections.cast("long").alias("sections"), "chapters", "first_section", "last_section",
    )
    columns = ["id", "name", "aliases", "note", "tier", "reason", "locked", "edited", "mentions", "speech", "sections", "chapters", "first_section", "last_section"]
    return rows.join(groups.where("n = 1").select("root"), "root", "left_semi").select(*columns).unionByName(made.select(*columns))
