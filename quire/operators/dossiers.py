"""Facts as of a section, dossiers and their hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sheet and hand-off contract.
FIELDS = "role appearance personality motivation speech quirks relationship".split()
TIER_FIELDS = {"primary": FIELDS, "secondary": ["role", "appearance", "speech", "relationship", "motivation"]}
TIER_PASSAGES = {"primary": 10, "secondary": 4}
PLAN = {"primary": ("expressions", None, True), "secondary": (None, 8, True), "filler": (None, 1, False)}
VERSION, KIND, FALLBACK = "1.0", "character-dossier", "neutral"
EXPRESSION = (
    r"(?i)\b(smil\w*|grin\w*|frown\w*|scowl\w*|glar\w*|smirk\w*|laugh\w*|cry\w*|cried|weep\w*|wept|sneer\w*|pout\w*|"
    r"blush\w*|wink\w*|gasp\w*|snarl\w*|beam\w*|expression|angry|sad|happy|furious|delighted)\b"
)


def as_of(facts: DataFrame, chapter: int | None) -> DataFrame:
    """Facts known at a chapter; facts without one are always known, null means all."""
    return facts if chapter is None else facts.where(F.coalesce("chapter", F.lit(0)) <= chapter)


def grouped(facts: DataFrame, owner: str) -> DataFrame:
    """owner, field, facts (text in order of chapter and ord), first and last chapter."""
    ordered = F.array_sort(F.collect_list(F.struct("chapter", "ord", "text")))
    return facts.groupBy(owner, "field").agg(ordered.alias("rows"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))


def dossiers(facts: DataFrame, owner: str, chapter: int | None) -> DataFrame:
    """One row for each owner: visible and withheld facts, fields with facts, contract stamp."""
    seen = F.lit(True) if chapter is None else F.coalesce("chapter", F.lit(0)) <= chapter
    return facts.groupBy(owner).agg(
        F.count_if(seen).alias("visible_facts"), F.count_if(~seen).alias("withheld_facts"),
        F.array_join(F.array_sort(F.collect_set(F.when(seen, F.col("field")))), ",").alias("fields"),
    ).withColumns({"as_of_chapter": F.lit(chapter).cast("int"), "contract_version": F.lit(VERSION)})


def sheet_summary(facts: DataFrame, owner: str) -> DataFrame:
    """owner, facts, by_field (map of a field to its facts), first and last chapter (null if none is known)."""
    chapter = F.nullif(F.col("chapter"), F.lit(0))
    fields = facts.groupBy(owner, "field").agg(F.count("*").alias("n"), F.min(chapter).alias("first"), F.max(chapter).alias("last"))
    by_field = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "n")))).alias("by_field")  # a field once, and there are few
    return fields.groupBy(owner).agg(F.sum("n").alias("facts"), by_field, F.min("first").alias("first_chapter"), F.max("last").alias("last_chapter"))


def problems(version: Column, name: Column, has_as_of: Column, fields: Column, kind: Column | None = None) -> Column:
    """What makes a dossier unusable, worst first; empty if nothing does. A null kind passes."""
    v = F.coalesce(version, F.lit(""))
    kind = F.lit(None).cast("string") if kind is None else kind
    return F.concat_ws(
        "; ",
        F.when(v == "", "no contract version").when(F.split_part(v, F.lit("."), F.lit(1)) != VERSION.split(".")[0], F.concat(F.lit("unreadable contract version "), v)),
        F.when(kind != KIND, F.concat(F.lit("kind is "), kind)),
        F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "no name"),
        F.when(~has_as_of, "no as-of chapter"),
        F.when(F.coalesce(fields, F.lit("")) == "", "no fields"),
    )


def looks(facts: DataFrame, owner: str, limit: int = 12) -> DataFrame:
    """Appearance facts without expressions as one text, each ending as a sentence."""
    from pyspark.sql import Window

    text = F.trim("text")
    kept = facts.where((text != "") & ~F.rlike(text, F.lit(EXPRESSION))).withColumn("text", F.when(F.rlike(text, F.lit("[.!?]$")), text).otherwise(F.concat(text, F.lit("."))))
    ranked = kept.withColumn("i", F.row_number().over(Window.partitionBy(owner).orderBy("chapter", "ord"))).where(F.col("i") <= limit)
    return ranked.groupBy(owner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), " ").alias("looks"))


def plan(tier: Column) -> dict[str, Column]:
    """What a tier earns; unknown tiers count as filler."""
    known = F.when(tier.isin(*PLAN), tier).otherwise("filler")
    pick = lambda i, kind: F.coalesce(*(F.when(known == t, F.lit(v[i]).cast(kind)) for t, v in PLAN.items()))
    return {"pose_preset": pick(0, "string"), "expressions": pick(1, "int"), "train": pick(2, "boolean"), "fallback_expression": F.lit(FALLBACK)}
