"""Upserts of rules, entities, quests and people with their whole payload; roll-ups and replies about names.

Stored and incoming tables hold each key once. ``aliases`` is an array of strings, ``citations`` an
array of (chunk, chapter). Curation stays: status never changes, edited text is not replaced; aliases
and citations are united even then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.merging import OUTCOMES, vocabulary_index
from quire.operators.numbering import in_ranges
from quire.shared import materialize

QUEST_FIELDS = "objective giver requirements reward penalty deadline".split()


def united_aliases(name: Column, stored: Column, incoming: Column) -> Column:
    """Stored aliases, then incoming ones in order, the first spelling of each, never the name itself."""
    seen = F.concat(F.array(F.lower(name)), F.transform(stored, F.lower))
    lower = F.transform(incoming, F.lower)
    fresh = F.filter(incoming, lambda a, i: ~F.array_contains(seen, F.lower(a)) & (F.array_position(lower, F.lower(a)) == i + 1))
    return F.concat(stored, fresh)


def _joined(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, Column, dict[str, Column]]:
    """The full join by key, whether a row is new, and the columns that all upserts share."""
    both = stored.alias("s").join(incoming.alias("i"), F.col("s.key") == F.col("i.key"), "full")
    new = F.col("s.key").isNull()
    none, uncited = F.array().cast("array<string>"), F.array().cast(stored.schema["citations"].dataType)
    name = F.coalesce("s.name", "i.name")
    old = F.coalesce("s.citations", uncited)
    shared = {
        "key": F.coalesce("s.key", "i.key"), "name": name,
        "aliases": united_aliases(name, F.coalesce("s.aliases", none), F.coalesce("i.aliases", none)),
        "citations": F.concat(old, F.array_except(F.coalesce("i.citations", uncited), old)),
        "status": F.coalesce("s.status", F.lit("proposed")), "edited": F.coalesce("s.edited", F.lit(False)),
        "action": F.when(new, "inserted").when(F.col("i.key").isNull(), "untouched").otherwise("updated"),
    }
    return both, new, shared


def _longer(field: str, new: Column) -> Column:
    """The incoming text where the row is new, or not edited and the text longer."""
    better = ~F.col("s.edited") & (F.length(F.col(f"i.{field}")) > F.length(F.coalesce(f"s.{field}", F.lit(""))))
    return F.when(new | F.coalesce(better, F.lit(False)), F.col(f"i.{field}")).otherwise(F.col(f"s.{field}"))


def upsert_entities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities after incoming ones: the longer summary unless edited."""
    both, new, shared = _joined(stored, incoming)
    return both.select(*(c.alias(n) for n, c in shared.items()), _longer("summary", new).alias("summary"))


def upsert_rules(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rules after incoming ones, with kind, scope, applies_to, statement, formula, confidence, evidence.

    An incoming statement takes the place of one that is not edited if it is the first that is stated
    outright, or as sure and longer; formula and evidence come along where it has them. Kind and scope
    stay those of the stored rule.
    """
    both, new, shared = _joined(stored, incoming)
    surer = (F.col("i.confidence") == "stated") & (F.col("s.confidence") != "stated")
    longer = (F.col("i.confidence") == F.col("s.confidence")) & (F.length("i.statement") > F.length(F.coalesce("s.statement", F.lit(""))))
    taken = new | F.coalesce(~F.col("s.edited") & (surer | longer), F.lit(False))
    first = lambda c: F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    pick = lambda c: F.when(taken, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    filled = lambda c: F.when(new | (taken & (F.coalesce(f"i.{c}", F.lit("")) != "")), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(*(c.alias(n) for n, c in shared.items()), *map(first, ("kind", "scope", "applies_to")), *map(pick, ("statement", "confidence")), *map(filled, ("formula", "evidence")))


def upsert_quests(stored: DataFrame, incoming: DataFrame, fields: list[str] = QUEST_FIELDS) -> DataFrame:
    """Quests after incoming ones: longer fields, first known kind and later outcome unless edited,
    the earliest known chapter always (0 is unknown)."""
    both, new, shared = _joined(stored, incoming)
    free = ~F.col("s.edited")
    kind = F.when(new | F.coalesce(free & (F.col("s.kind") == "unknown") & (F.col("i.kind") != "unknown"), F.lit(False)), F.col("i.kind")).otherwise(F.col("s.kind"))
    later = free & (vocabulary_index(F.col("i.outcome"), OUTCOMES) > vocabulary_index(F.col("s.outcome"), OUTCOMES))
    outcome = F.when(new | F.coalesce(later, F.lit(False)), F.col("i.outcome")).otherwise(F.col("s.outcome"))
    zero = F.lit(0)
    chapter = F.coalesce(F.least(F.nullif(F.col("s.first_chapter"), zero), F.nullif(F.col("i.first_chapter"), zero)), zero)
    return both.select(*(c.alias(n) for n, c in shared.items()), *(_longer(f, new).alias(f) for f in fields), kind.alias("kind"), outcome.alias("outcome"), chapter.alias("first_chapter"))


def _landed(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """ord, gen, row: where each of ``incoming`` (ord, key, name, aliases) lands if they come one by one.

    gen 0 and the id of a stored person, or gen 1 and the ord of the newcomer that made the row,
    which is one's own for those who are new. A person goes to the row of its key, else to the first
    row (stored ones first) that holds any of its names by then: a row holds its first name and the
    aliases of all who landed there. Places are guessed, all people being new, and worked out anew
    from the guesses for those before until none changes; as a place depends on earlier people
    alone, that is the one answer, and there are as many rounds as people in the longest chain of
    changed places. Earlier people's rows are looked up by running minima over ranges of ord, so a
    name shared by many is not read in one task.
    """
    low = lambda c: F.lower(F.trim(c))
    own = F.struct(F.lit(1).alias("gen"), F.col("ord").cast("long").alias("row"))
    kept = F.struct(F.lit(0).alias("gen"), F.col("id").cast("long").alias("row"))
    names = lambda d, k: d.select(*k, F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), low))).alias("form")).where("form <> ''")
    held = names(stored.select(kept.alias("place"), "name", "aliases"), ["place"]).groupBy("form").agg(F.min("place").alias("held"))
    keys = stored.groupBy("key").agg(F.min(kept).alias("kept"))
    people = materialize(in_ranges(incoming.where("key <> ''").select("ord", "key", "name", "aliases"), "ord", "part").join(keys, "key", "left"), "people")
    asked = names(people, ["ord", "part", "aliases"]).withColumn("alias", F.exists("aliases", lambda a: low(a) == F.col("form"))).drop("aliases")
    asked = materialize(asked.join(held, "form", "left"), "asked")
    now = materialize(people.select("ord", F.coalesce("kept", own).alias("place")), "places")
    while True:
        known = asked.join(now, "ord")
        # what a person brings to its row: aliases, and its name if the row is its own
        known = known.withColumn("brings", F.when(F.col("alias") | (F.col("place") == own), F.col("place")))
        first = known.groupBy("form", "part").agg(F.min("brings").alias("least"))
        ahead = Window.partitionBy("form").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        first = first.select(F.col("form").alias("__f"), F.col("part").alias("__p"), F.min("least").over(ahead).alias("ahead"))
        inside = Window.partitionBy("form", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        seen = known.withColumn("inside", F.min("brings").over(inside)).join(first, (F.col("form") == F.col("__f")) & (F.col("part") == F.col("__p")))
        by_name = seen.groupBy("ord").agg(F.min(F.least("held", "inside", "ahead")).alias("by_name"))
        # the one newcomer that made the row of this key before
        made = now.where(F.col("place") == own).join(people.select("ord", "key"), "ord").groupBy("key").agg(F.min("ord").alias("maker"))
        again = people.join(by_name, "ord", "left").join(made, "key", "left")
        by_key = F.when(F.col("maker") < F.col("ord"), F.struct(F.lit(1).alias("gen"), F.col("maker").cast("long").alias("row")))
        then = materialize(again.select("ord", F.coalesce("kept", by_key, "by_name", own).alias("place")), "places")
        changed = then.join(now.withColumnRenamed("place", "before"), "ord").where(F.col("place") != F.col("before")).head(1)
        if not changed:
            return then.select("ord", "place.gen", "place.row")
        now = then


def upsert_people(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """People after a new census, as if it came in one by one: counts and reason are always the incoming ones.

    ``stored``: id, key, name, aliases, note, tier, reason, mentions, speech, sections, status,
    edited, locked; ``incoming``: ord, key, name, aliases, note, tier, reason, mentions, speech,
    sections. An incoming person goes to the row of its key, else to the first that shares any
    name with it, so that merges by hand stay; rows that earlier newcomers made count like stored
    ones. Of several that land on a row, the last by ``ord`` gives the figures. The tier stays if
    locked, the note if edited or none comes in. People with an empty key are left out.
    """
    landed = incoming.join(_landed(stored, incoming), "ord")
    payload = ["key", "name", "aliases", "note", "tier", "reason", "mentions", "speech", "sections"]
    old = stored.select(F.lit(0).alias("gen"), F.col("id").cast("long").alias("row"), *payload, "status", "edited", "locked")
    first = (F.col("gen") == 1) & (F.col("row") == F.col("ord"))
    made = landed.where(first).select("gen", "row", *payload, F.lit("proposed").alias("status"), F.lit(False).alias("edited"), F.lit(False).alias("locked"))
    last = lambda c: F.max_by(c, "ord").alias(f"i_{c}")
    note = F.max_by(F.when(F.col("note") != "", F.col("note")), F.when(F.col("note") != "", F.col("ord"))).alias("i_note")
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "aliases"))), lambda s: s["aliases"])).alias("i_aliases")
    news = landed.where(~first).groupBy("gen", "row").agg(*(last(c) for c in ("tier", "reason", "mentions", "speech", "sections")), note, lists)
    met = F.col("i_mentions").isNotNull()
    pick = lambda c, free=None: F.when(met if free is None else met & free, F.col(f"i_{c}")).otherwise(F.col(c)).alias(c)
    return old.unionByName(made).join(news, ["gen", "row"], "left").select(
        "key", "name", F.when(met, united_aliases(F.col("name"), F.col("aliases"), F.col("i_aliases"))).otherwise(F.col("aliases")).alias("aliases"),
        pick("note", ~F.col("edited") & F.col("i_note").isNotNull()), pick("tier", ~F.col("locked")), *(pick(c) for c in ("reason", "mentions", "speech", "sections")),
        "status", F.when(F.col("gen") == 1, "inserted").when(met, "updated").otherwise("untouched").alias("action"),
    )


def fact_counts(people: DataFrame, facts: DataFrame, owner: str) -> DataFrame:
    """``people`` with the number of their facts that are not discarded, 0 without any."""
    counts = facts.where("status <> 'discarded'").groupBy(owner).agg(F.count("*").alias("facts"))
    return people.join(counts, owner, "left").withColumn("facts", F.coalesce("facts", F.lit(0)))


def _by_kind(rows: DataFrame, group: str) -> DataFrame:
    counts = rows.groupBy(group, "kind").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))


def rule_counts(rules: DataFrame, group: str) -> DataFrame:
    """Rules of the system and of instances, confidence over both, kinds over those of the system."""
    count = lambda c, v, name: F.count_if(F.col(c) == v).alias(name)
    totals = rules.groupBy(group).agg(count("scope", "system", "rules"), count("scope", "instance", "instance_rules"), count("confidence", "stated", "stated"), count("confidence", "implied", "implied"))
    return totals.join(_by_kind(rules.where("scope = 'system'"), group), group, "left")


def journey_counts(quests: DataFrame, group: str) -> DataFrame:
    """Quests by kind, and how many have a reward or a penalty."""
    has = lambda c: F.count_if(F.coalesce(c, F.lit("")) != "").alias(f"with_{c}")
    return quests.groupBy(group).agg(F.count("*").alias("quests"), has("reward"), has("penalty")).join(_by_kind(quests, group), group)


def known_people(replies: DataFrame, known: DataFrame) -> DataFrame:
    """People of replies under names that were asked about: ord, name (the fullest form), aliases.

    ``replies``: ord, name, aliases; ``known``: name. Forms nobody asked about are dropped, and
    people without another; spelling is that of ``known``.
    """
    forms = replies.select("ord", F.posexplode(F.concat(F.array("name"), "aliases")).alias("i", "form"))
    met = forms.join(known.select(F.col("name").alias("known")), F.lower("form") == F.lower("known")).groupBy("ord", "known").agg(F.min("i").alias("i"))
    kept = met.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("i", "known"))).alias("kept"))
    fullest = F.array_max(F.transform("kept", lambda s: F.struct(F.length(s["known"]).alias("n"), (-s["i"]).alias("i"), s["known"].alias("known"))))["known"]
    return kept.select("ord", fullest.alias("name"), F.filter(F.transform("kept", lambda s: s["known"]), lambda k: k != fullest).alias("aliases"))


def unaccounted(known: DataFrame, replies: DataFrame) -> DataFrame:
    """Names that no reply accounts for."""
    forms = replies.select(F.explode(F.concat(F.array("name"), "aliases")).alias("form")).select(F.lower("form").alias("form")).distinct()
    return known.join(forms, F.lower("name") == F.col("form"), "left_anti")


def confirmed_pairs(confirmed: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked pairs (a, b) that were confirmed, in either order and whatever the case."""
    low, high = F.least(F.lower("a"), F.lower("b")), F.greatest(F.lower("a"), F.lower("b"))
    return asked.withColumns({"low": low, "high": high}).join(confirmed.select(low.alias("low"), high.alias("high")).distinct(), ["low", "high"], "left_semi").select("a", "b")
