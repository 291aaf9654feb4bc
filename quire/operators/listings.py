"""Lists in their fixed orders, tiers set by hand, whole books replaced or deleted, hand-off of a cast.

Rows carry an ``id``, the last word on ties in any order, so that reruns list alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import dossiers as sheets
from quire.operators.merging import ENTITY_KINDS, RULE_KINDS, TIERS, vocabulary_index

#: Fields of a sheet that a character card sums up; appearance goes to the looks alone.
CARD_FIELDS = "role personality motivation speech quirks".split()


def _tier_rank() -> Column:
    """Places of the tiers; unknown ones count as the last."""
    place = vocabulary_index(F.col("tier"), TIERS)
    return F.when(place > 0, place).otherwise(len(TIERS))


def _by_citations(kind: Column) -> list[Column]:
    return [F.desc("citations"), kind, F.lower("name")]


#: The order of each list, made when used, as columns need a session.
ORDERS = {
    "rules": lambda: _by_citations(F.col("kind")),
    "entries": lambda: _by_citations(F.col("kind")),
    "merged_rules": lambda: _by_citations(vocabulary_index(F.col("kind"), RULE_KINDS)),
    "merged_entities": lambda: _by_citations(vocabulary_index(F.col("kind"), ENTITY_KINDS)),
    "quests": lambda: [F.col("first_chapter"), F.lower("name")],
    "people": lambda: [_tier_rank(), F.desc("speech"), F.desc("mentions")],
    "census": lambda: [_tier_rank(), F.desc("speech"), F.lower("name")],
    "harvest": lambda: [F.desc("mentions"), F.col("name")],
    "facts": lambda: [F.col("owner"), F.col("field"), F.col("chapter")],
    "jobs": lambda: [F.desc("id")],
    "books": lambda: [F.desc("id")],
}


def listed(rows: DataFrame, order: str, **equal: object) -> DataFrame:
    """``rows`` whose columns equal the given values (None: any), in the order of a list.

    Citations count by their number, whether they come as that or as an array.
    """
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if "citations" in rows.columns and isinstance(rows.schema["citations"].dataType, T.ArrayType):
        counted = rows.withColumns({"__citations": F.col("citations"), "citations": F.size("citations")}).orderBy(*ORDERS[order](), F.col("id"))
        return counted.withColumn("citations", F.col("__citations")).drop("__citations")
    return rows.orderBy(*ORDERS[order](), F.col("id"))


def with_tiers(people: DataFrame, edits: DataFrame) -> DataFrame:
    """``people`` (id, tier, reason, locked) under the tiers set by hand, which lock them.

    ``edits``: id, ord, tier; of several the last known tier counts, unknown tiers never do.
    """
    last = edits.where(F.col("tier").isin(*TIERS)).groupBy("id").agg(F.max_by("tier", "ord").alias("__tier"))
    joined = people.join(last, "id", "left")
    by_hand = F.col("__tier").isNotNull()
    changed = {"tier": F.coalesce("__tier", "tier"), "reason": F.when(by_hand, F.lit("set by hand")).otherwise(F.col("reason")), "locked": by_hand | F.col("locked")}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in people.columns))


def without_books(rows: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """``rows`` of no book among ``books``; a null key is a book of its own."""
    gone = books.select(F.col(key).alias("__gone")).distinct()
    return rows.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")


def replace_books(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``stored`` with all rows of each book that comes in replaced by the incoming ones."""
    return without_books(stored, incoming, key).unionByName(incoming.select(*stored.columns))


def cast_list(people: DataFrame, found: DataFrame, tiers: tuple[str, ...] = ("primary", "secondary")) -> DataFrame:
    """id, tier, usable, reason of everyone a cast asks for; nobody is left out silently.

    ``people``: id, tier, status; ``found``: id, problems of the dossier (empty if it is usable).
    Discarded people and other tiers are not asked for; people without a dossier are unusable.
    """
    asked = people.where(F.col("tier").isin(*tiers) & (F.coalesce("status", F.lit("")) != "discarded"))
    reason = F.coalesce("problems", F.lit("no sheet"))
    return asked.join(found.select("id", "problems"), "id", "left").select("id", "tier", (reason == "").alias("usable"), reason.alias("reason"))


def dropped_looks(facts: DataFrame) -> DataFrame:
    """The appearance facts that looks leave out for an expression, a row each."""
    return facts.where((F.col("field") == "appearance") & F.rlike("text", F.lit(sheets.EXPRESSION)))


def persona_seeds(facts: DataFrame, people: DataFrame) -> DataFrame:
    """owner, tier, looks, dropped (their number), one column for each field of the card, and the plan.

    ``facts``: owner, field, chapter, ord, text, as far as they are visible; ``people``: owner, tier.
    The first fact of a field stands for it; fields without one are null, looks without one empty.
    """
    first = lambda f: F.nullif(F.min_by(F.trim("text"), F.when(F.col("field") == f, F.struct("chapter", "ord"))), F.lit(""))
    cards = facts.groupBy("owner").agg(*(first(f).alias(f) for f in CARD_FIELDS))
    shown = sheets.looks(facts.where("field = 'appearance'"), "owner")
    dropped = dropped_looks(facts).groupBy("owner").agg(F.count("*").alias("dropped"))
    seeds = people.join(cards, "owner").join(shown, "owner", "left").join(dropped, "owner", "left")
    return seeds.select(
        "owner", "tier", F.coalesce("looks", F.lit("")).alias("looks"), F.coalesce("dropped", F.lit(0)).alias("dropped"),
        *CARD_FIELDS, *(c.alias(n) for n, c in sheets.plan(F.col("tier")).items()),
    )
