"""Order-sensitive merges of extracted rows, and upserts of them into stored tables.

All inputs carry an explicit ordinal ``ord``. A group is first reduced to the rows that can matter
(the first of each length, the first of each spelling, the first of each citation), so a key that
holds many rows is folded from few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed vocabularies in their order.
RULE_KINDS = "xp level attribute skill class currency cap penalty mechanic".split()
CONFIDENCE = ("stated", "implied")
SCOPES = ("system", "instance")
ENTITY_KINDS = "location faction system artefact history term".split()
QUEST_KINDS = "main side hidden optional tutorial unknown".split()
OUTCOMES = "unknown accepted ongoing declined failed completed".split()  # later wins
TIERS = ("primary", "secondary", "filler")
STATUS = ("proposed", "kept", "discarded")


def vocabulary_index(value: Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(w) for w in words)), value)


def coerced(value: Column, words: list[str] | tuple[str, ...], default: str) -> Column:
    """The value in a closed vocabulary, or the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*words), v).otherwise(F.lit(default))


def alias_union(rows: DataFrame, key: str, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """key, name (of the first row) and aliases: first spellings in order, never the name itself."""
    first = rows.groupBy(key).agg(F.min_by(name, "ord").alias("name"))
    spelled = rows.select(key, "ord", F.posexplode(aliases).alias("i", "alias")).withColumn("low", F.lower("alias"))
    once = spelled.groupBy(key, "low").agg(F.min(F.struct("ord", "i", "alias")).alias("s"))
    kept = once.join(first, key).where(F.col("low") != F.lower("name"))
    lists = kept.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s")).select(key, F.transform("s", lambda s: s["alias"]).alias("aliases"))
    return first.join(lists, key, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def citation_union(rows: DataFrame, key: str, citations: str = "citations") -> DataFrame:
    """key and citations: each once, in the order in which they were first met.

    ``citations`` is an array of structs; a citation is the same if all its fields are. Each task
    keeps one row a key and citation, so what is listed in the end is what the list must hold.
    """
    met = rows.select(key, "ord", F.posexplode(citations).alias("i", "c"))
    once = met.groupBy(key, "c").agg(F.min(F.struct("ord", "i")).alias("at"))
    listed = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("l")).select(key, F.transform("l", lambda x: x["c"]).alias("citations"))
    every = rows.select(key).distinct().join(listed, key, "left")
    return every.withColumn("citations", F.coalesce("citations", F.array().cast(rows.schema[citations].dataType)))


def _united(rows: DataFrame) -> DataFrame:
    """key, name of the first row, aliases and citations."""
    return alias_union(rows, "key").join(citation_union(rows, "key"), "key")


def longest(value: str) -> Column:
    """The first of the longest values."""
    return F.max_by(value, F.struct(F.length(value), -F.col("ord")))


def merge_entities(rows: DataFrame) -> DataFrame:
    """key, kind, name, aliases, citations, summary; ``rows``: key, ord, kind, name, aliases, citations, summary.

    Kind and name are those of the first row, the summary is the first of the longest.
    """
    best = rows.groupBy("key").agg(F.min_by("kind", "ord").alias("kind"), longest("summary").alias("summary"))
    return _united(rows).join(best, "key")


def merge_rules(rows: DataFrame) -> DataFrame:
    """key, name, aliases, citations, kind, scope, applies_to, statement, confidence, formula, evidence.

    A stated rule replaces an implied one, a longer statement a shorter one of the same
    confidence; formula and evidence are taken over only with the statement, and only if there is
    one. Name, kind, scope and applies_to are those of the first row. Only the first row of each
    length and confidence can replace anything, so a key is folded from those.
    """
    texts = ("statement", "formula", "evidence")
    few = rows.groupBy("key", "confidence", F.length("statement").alias("n")).agg(F.min(F.struct("ord", *texts)).alias("r"))
    few = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r.ord", "confidence", "n", *(f"r.{t}" for t in texts)))).alias("rows"))
    start = F.struct(F.lit(False).alias("any"), F.lit("").alias("confidence"), *(F.lit("").alias(t) for t in texts))

    def step(s: Column, r: Column) -> Column:
        stated = (r["confidence"] == "stated") & (s["confidence"] != "stated")
        longer = (r["confidence"] == s["confidence"]) & (r["n"] > F.length(s["statement"]))
        take = ~s["any"] | stated | longer
        pick = lambda f: F.when(take, r[f]).otherwise(s[f]).alias(f)
        filled = lambda f: F.when(take & (F.coalesce(r[f], F.lit("")) != ""), r[f]).otherwise(s[f]).alias(f)
        return F.struct(F.lit(True).alias("any"), pick("confidence"), pick("statement"), filled("formula"), filled("evidence"))

    folded = few.select("key", F.aggregate("rows", start, step).alias("m")).select("key", "m.statement", "m.confidence", "m.formula", "m.evidence")
    first = rows.groupBy("key").agg(*(F.min_by(c, "ord").alias(c) for c in ("kind", "scope", "applies_to")))
    return _united(rows).join(first, "key").join(folded, "key")


def merge_quests(rows: DataFrame, fields: list[str]) -> DataFrame:
    """key, name, aliases, citations, longest non-empty value of each field, kind, best outcome, first_chapter.

    A known kind is kept once seen; chapter 0 means unknown and never wins over a known one.
    """
    rank = vocabulary_index(F.col("outcome"), OUTCOMES)
    folded = rows.groupBy("key").agg(
        *(F.coalesce(longest(f), F.lit("")).alias(f) for f in fields),
        F.coalesce(F.min_by(F.when(F.col("kind") != "unknown", F.col("kind")), F.when(F.col("kind") != "unknown", F.col("ord"))), F.lit("unknown")).alias("kind"),
        F.max_by("outcome", rank).alias("outcome"),
        F.coalesce(F.min(F.nullif(F.col("first_chapter"), F.lit(0))), F.lit(0)).alias("first_chapter"),
    )
    return _united(rows).join(folded, "key")


def merge_series(rows: DataFrame) -> DataFrame:
    """key, name, aliases, best tier and its reason, longest note, summed evidence of characters over books.

    The reason says so if a later book gave the better tier; first and last section are those of
    the first book, as sections are numbered anew in each. Empty keys are left out.
    """
    rank = F.coalesce(F.nullif(vocabulary_index(F.col("tier"), TIERS), F.lit(0)), F.lit(len(TIERS) + 1))
    named = rows.where("key <> ''")
    folded = named.groupBy("key").agg(
        F.min_by(F.struct("tier", "reason", "ord"), F.struct(rank, F.col("ord"))).alias("best"), longest("note").alias("note"), F.min("ord").alias("__first"),
        *(F.sum(c).alias(c) for c in ("mentions", "speech", "sections")), *(F.min_by(c, "ord").alias(c) for c in ("first_section", "last_section")),
    )
    reason = F.when(F.col("best.ord") == F.col("__first"), F.col("best.reason")).otherwise(F.concat("best.reason", F.lit(" (best across books)")))
    folded = folded.select("key", F.col("best.tier").alias("tier"), reason.alias("reason"), "note", "mentions", "speech", "sections", "first_section", "last_section")
    return alias_union(named, "key").join(folded, "key")


def conflicts(rows: DataFrame) -> DataFrame:
    """Keys that were filed under more than one kind."""
    found = rows.select("key", "kind").distinct().groupBy("key").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))
    return found.where(F.size("kinds") > 1)


def upsert_rules(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows after incoming ones (each key once), with ``action``.

    An edited row keeps its statement; status never changes, so a discarded rule stays so.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    better = ((F.col("i.confidence") == "stated") & (F.col("s.confidence") != "stated")) | ((F.col("i.confidence") == F.col("s.confidence")) & (F.length("i.statement") > F.length("s.statement")))
    take = F.col("s.key").isNull() | (F.col("i.key").isNotNull() & ~F.col("s.edited") & better)
    return s.join(i, F.col("s.key") == F.col("i.key"), "full").select(
        F.coalesce("s.key", "i.key").alias("key"), *(F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ("statement", "confidence")),
        F.coalesce("s.status", F.lit("proposed")).alias("status"),
        F.when(F.col("s.key").isNull(), "inserted").when(F.col("i.key").isNull(), "untouched").otherwise("updated").alias("action"),
    )


def upsert_facts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Facts by (owner, key): the stored text stays, the chapter moves to an earlier known one."""
    rows = stored.withColumn("gen", F.lit(0)).unionByName(incoming.withColumn("gen", F.lit(1)))
    return rows.groupBy("owner", "key").agg(F.min_by("text", F.struct("gen", "ord")).alias("text"), F.coalesce(F.min(F.nullif(F.col("chapter"), F.lit(0))), F.lit(0)).alias("chapter"), (F.min("gen") == 1).alias("inserted"))


def any_name_match(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming id to the first stored id that shares a name or alias, whatever the case."""
    forms = lambda d, c: d.select(F.col("id").alias(c), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.lower))).alias("form"))
    return forms(incoming, "incoming_id").join(forms(stored, "stored_id"), "form").groupBy("incoming_id").agg(F.min("stored_id").alias("stored_id"))


def manual_merge(people: DataFrame, absorbed: DataFrame) -> DataFrame:
    """People after merges by hand; ``people``: id, name, mentions, speech, chapter (a row each),
    ``absorbed``: id, into. Counts of chapters come from the union of chapters."""
    to = people.join(absorbed, "id", "left").withColumn("id", F.coalesce("into", "id"))
    return to.groupBy("id").agg(F.sum("mentions").alias("mentions"), F.sum("speech").alias("speech"), F.countDistinct("chapter").alias("chapters"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))


def overlay(base: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` under the latest entry of an edit log for each key; null edits leave the value."""
    latest = log.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"__{c}") for c in columns))
    joined = base.join(latest, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def clear_proposed(rows: DataFrame, everything: bool = False) -> DataFrame:
    """What stays: all but proposed rows that nobody edited and, where rows have ``locked``, nobody locked."""
    locked = F.coalesce("locked", F.lit(False)) if "locked" in rows.columns else F.lit(False)
    return rows.where(F.lit(False)) if everything else rows.where(~((F.col("status") == "proposed") & ~F.coalesce("edited", F.lit(False)) & ~locked))
