"""From items of model replies to clean rows: rules, entities, quests and facts.

``items`` has the item as JSON text, and where the passage comes from (``keep``): those columns are
carried, never read from the reply. Items that are no object or lack what they must have are left
out; null items too. A text that came as a number, list or object is taken as its JSON text; what is
not there is empty. Values outside a closed vocabulary get its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.dossiers import TIER_FIELDS
from quire.operators.merging import CONFIDENCE, ENTITY_KINDS, OUTCOMES, QUEST_KINDS, RULE_KINDS, SCOPES, coerced

# The longest a text may be.
NAME, STATEMENT, EVIDENCE, FORMULA, SUMMARY, FIELD, FACT, SUBJECT = 60, 300, 200, 120, 600, 300, 240, 60
ALIASES = 12


def _objects(items: DataFrame, item: str) -> DataFrame:
    read = items.withColumn("__v", F.try_parse_json(item))
    return read.where(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")))


def field(name: str, cap: int) -> Column:
    """A field of the item as collapsed text of at most ``cap`` characters, '' without it."""
    return tx.collapsed(F.try_variant_get("__v", f"$.{name}", "string"), cap)


def alias_list(owner: Column) -> Column:
    """The item's aliases, a list or text with commas: clean, each once, not the owner's name, 12 at most."""
    raw = F.try_variant_get("__v", "$.aliases", "variant")
    kind = F.coalesce(F.schema_of_variant(raw), F.lit(""))
    listed = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("__v", "$.aliases", "array<string>")).when(kind == "STRING", F.split(F.try_variant_get("__v", "$.aliases", "string"), ","))
    plain = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda a: tx.collapsed(a, NAME))
    return F.slice(tx.first_spellings(plain, owner), 1, ALIASES)


def _keyed(rows: DataFrame, key: Column) -> DataFrame:
    return rows.withColumn("key", key).withColumn("id", tx.short_id(F.col("key")))


def _kind_and_name() -> Column:
    return F.concat("kind", F.lit(":"), tx.slug(F.col("name")))


def valid_rules(items: DataFrame, *keep: str, item: str = "item") -> DataFrame:
    """``keep``, kind, name, aliases, scope, applies_to, statement, formula, confidence, evidence, key, id.

    A rule needs a name and a statement. One that names what it applies to is an instance's.
    """
    rows = _objects(items, item).select(
        *keep, coerced(field("kind", 20), RULE_KINDS, "mechanic").alias("kind"), field("name", NAME).alias("name"), alias_list(field("name", NAME)).alias("aliases"),
        F.when(field("applies_to", NAME) != "", "instance").otherwise(coerced(field("scope", 10), SCOPES, "system")).alias("scope"), field("applies_to", NAME).alias("applies_to"),
        field("statement", STATEMENT).alias("statement"), field("formula", FORMULA).alias("formula"), coerced(field("confidence", 10), CONFIDENCE, "implied").alias("confidence"),
        field("evidence_excerpt", EVIDENCE).alias("evidence"),
    ).where("name <> '' AND statement <> ''")
    return _keyed(rows, _kind_and_name())


def valid_entities(items: DataFrame, *keep: str, item: str = "item") -> DataFrame:
    """``keep``, kind, name, aliases, summary, key, id. An entity needs a name and a summary."""
    rows = _objects(items, item).select(
        *keep, coerced(field("kind", 20), ENTITY_KINDS, "term").alias("kind"), field("name", NAME).alias("name"), alias_list(field("name", NAME)).alias("aliases"), field("summary", SUMMARY).alias("summary")
    ).where("name <> '' AND summary <> ''")
    return _keyed(rows, _kind_and_name())


def valid_quests(items: DataFrame, *keep: str, chapter: str = "chapter", item: str = "item") -> DataFrame:
    """``keep``, kind, name, aliases, six texts, outcome, first_chapter, key, id. A quest needs a name and an objective."""
    texts = {"objective": FIELD, "giver": NAME, "requirements": FIELD, "reward": FIELD, "penalty": FIELD, "deadline": NAME}
    rows = _objects(items, item).select(
        *keep, coerced(field("kind", 12), QUEST_KINDS, "unknown").alias("kind"), field("name", NAME).alias("name"), alias_list(field("name", NAME)).alias("aliases"),
        *(field(t, cap).alias(t) for t, cap in texts.items()), coerced(field("outcome", 12), OUTCOMES, "unknown").alias("outcome"), F.coalesce(chapter, F.lit(0)).alias("first_chapter"),
    ).where("name <> '' AND objective <> ''")
    return _keyed(rows, tx.slug(F.col("name")))


def valid_facts(items: DataFrame, *keep: str, tier: str = "tier", chapter: str = "chapter", item: str = "item") -> DataFrame:
    """``keep``, field, text, subject, chapter, fact_key.

    The field must be one that the owner's tier earns, and there must be a text. Only relationships
    have a subject, and need one.
    """
    earned = F.lit(False)
    name = F.lower(field("field", 20))
    for of, fields in TIER_FIELDS.items():
        earned = earned | ((F.col(tier) == of) & name.isin(fields))
    tied = name == "relationship"
    rows = _objects(items, item).where(F.coalesce(earned, F.lit(False))).select(
        *keep, name.alias("field"), field("text", FACT).alias("text"), F.when(tied, field("subject", SUBJECT)).otherwise("").alias("subject"), F.coalesce(chapter, F.lit(0)).alias("chapter")
    )
    return rows.where("text <> '' AND (field <> 'relationship' OR subject <> '')").withColumn("fact_key", tx.fact_key(F.col("field"), F.col("text"), F.col("subject")))
