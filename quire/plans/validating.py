"""Replies of models, made of the rows of tables, and the valid rows read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import validating
from quire.plans.registry import query, table
from quire.sources.replies import parsed


def _items(rows: DataFrame, key: str, item: dict[str, Column], *keep: str) -> DataFrame:
    """Each row as a reply in a fence, with a stray number and a trailing comma beside the item, read back.

    Rows are dealt out first: reading replies costs far more than the few bytes a row has in its
    file, so the splits of a file are no measure of the work. They are dealt out by the first of ``keep``.
    """
    body = F.to_json(F.struct(*(c.alias(n) for n, c in item.items())))
    reply = F.concat(F.lit(f'Here:\n```json\n{{"{key}": [5, '), body, F.lit(", ]}\n```"))
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), keep[0])
    return dealt.select(*keep, F.explode(parsed(reply, key)["items"]).alias("item"))


def _turn(c: Column, *values) -> Column:
    """One of the values (None for none), by turns."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(c % len(values) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _joined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("aliases", F.array_join("aliases", "|"))


SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""
WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'xp' WHEN 1 THEN 'skill' ELSE 'mechanic' END AS kind, p_name || ' ' || p_brand AS name,
  CASE p_partkey % 2 WHEN 0 THEN 'A1|' || p_brand ELSE 'k0|k1|k2|k3|k4|k5|k6|k7|k8|k9|k10|k11' END AS aliases,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 1 THEN 'instance' ELSE 'system' END AS scope, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS applies_to,
  p_type || ' costs ' || p_size AS statement, substr(repeat(p_brand || ' ', 20), 1, 120) AS formula, CASE WHEN p_partkey % 3 = 0 THEN 'stated' ELSE 'implied' END AS confidence, p_size::VARCHAR AS evidence
  FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 7 <> 0)
SELECT *, kind || ':' || {SLUG.format("name")} AS key, substr(sha1(kind || ':' || {SLUG.format("name")}), 1, 12) AS id FROM r""")
def valid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of replies; every part makes a reply, some without a name or a statement."""
    p = F.col("p_partkey")
    long = F.concat(F.lit('["k0'), *(F.lit(f'","k{i}') for i in range(1, 20)), F.lit('"]'))
    commas = F.concat(F.lit(" A1 ,a1,,"), "p_brand", F.lit(","), F.lower("p_brand"), F.lit(", "), F.upper("p_name"), F.lit("  "), "p_brand")
    item = {
        "kind": _turn(p, " XP ", "Skill", "sorcery"), "name": F.when(p % 10 == 9, " \n ").otherwise(F.concat(F.lit("  "), "p_name", F.lit("\n\t "), "p_brand", F.lit(" "))),
        "scope": _turn(p, "system", " INSTANCE", None, "world"), "applies_to": F.when(p % 5 == 0, F.col("p_brand")), "statement": F.when(p % 7 != 0, F.concat("p_type", F.lit("\t costs  "), "p_size")),
        "formula": F.repeat(F.concat("p_brand", F.lit("  ")), 20), "confidence": _turn(p, "STATED", "maybe", None), "evidence_excerpt": F.col("p_size"),
    }
    texts = _items(table(spark, sf_dir, "part"), "rules", item | {"aliases": commas}, "p_partkey").where(p % 2 == 0)
    lists = _items(table(spark, sf_dir, "part"), "rules", item | {"aliases": F.from_json(long, "array<string>")}, "p_partkey").where(p % 2 == 1)
    return _joined(validating.valid_rules(texts.unionByName(lists), "p_partkey"))


@query(f"""
WITH e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'artefact' ELSE 'term' END AS kind, c_name AS name, c_mktsegment || ' of ' || c_nationkey AS summary FROM customer WHERE c_custkey % 11 <> 0)
SELECT *, 'the ' || c_custkey || '|' || c_custkey AS aliases, kind || ':' || {SLUG.format("name")} AS key, substr(sha1(kind || ':' || {SLUG.format("name")}), 1, 12) AS id FROM e""")
def valid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of replies; every customer makes a reply, some without a summary."""
    c = F.col("c_custkey")
    the = F.concat(F.lit("the "), c)
    item = {
        "kind": _turn(c, "Location", " artefact ", None), "name": F.col("c_name"), "aliases": F.array(F.lower("c_name"), F.concat(F.lit(" "), the), F.upper(the), F.lit(" "), c.cast("string")),
        "summary": F.when(c % 11 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit("\n of  "), "c_nationkey")),
    }
    return _joined(validating.valid_entities(_items(table(spark, sf_dir, "customer"), "entities", item, "c_custkey"), "c_custkey"))


@query(f"""
WITH q AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'side' ELSE 'unknown' END AS kind, 'Quest ' || o_custkey AS name, 'spend ' || o_orderkey AS objective, '' AS giver, o_orderpriority AS requirements,
  CASE WHEN o_orderkey % 2 = 0 THEN 'gold' ELSE '' END AS reward, '' AS penalty, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' ELSE 'unknown' END AS outcome, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_custkey END AS first_chapter FROM orders WHERE o_orderkey % 13 <> 0)
SELECT *, repeat('ab', 30) AS deadline, '' AS aliases, {SLUG.format("name")} AS key, substr(sha1({SLUG.format("name")}), 1, 12) AS id FROM q""")
def valid_quests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quests of replies; every order makes a reply, some without an objective or a section."""
    o = F.col("o_orderkey")
    item = {
        "kind": _turn(o, "MAIN", "side", "epic", None), "name": F.concat(F.lit(" Quest "), "o_custkey"), "objective": F.when(o % 13 != 0, F.concat(F.lit("spend "), o)), "requirements": F.col("o_orderpriority"),
        "reward": F.when(o % 2 == 0, " gold"), "deadline": F.repeat(F.lit("ab"), 40), "outcome": F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "ongoing").otherwise("lost"),
    }
    rows = table(spark, sf_dir, "orders").withColumn("chapter", F.when(o % 6 != 0, F.col("o_custkey")))
    return _joined(validating.valid_quests(_items(rows, "quests", item, "o_orderkey", "chapter"), "o_orderkey"))


@query(r"""
WITH f AS (SELECT event_id, user_id, ['role', 'appearance', 'quirks', 'relationship', 'mood'][event_id % 5 + 1] AS field, event_type || ' at ' || value || ' with care' AS text,
  CASE WHEN event_id % 5 = 3 AND event_id % 4 <> 0 THEN 'User ' || (user_id + 1) ELSE '' END AS subject, CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id % 40 END AS chapter, ['primary', 'secondary', 'filler'][user_id % 3 + 1] AS tier FROM events),
v AS (SELECT * EXCLUDE (tier) FROM f WHERE (tier = 'primary' AND field <> 'mood' OR tier = 'secondary' AND field NOT IN ('mood', 'quirks')) AND (field <> 'relationship' OR subject <> ''))
SELECT *, substr(field || ':' || lower(subject) || ':' || array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g'), ' '), lambda w: length(w) > 3)), ' '), 1, 300) AS fact_key FROM v""")
def valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of replies; every event makes a reply about its user, whose tier says which fields count."""
    e = F.col("event_id")
    item = {
        "field": _turn(e, "Role ", "appearance", "quirks", "relationship", "mood"), "text": F.concat("event_type", F.lit("  at "), F.col("value"), F.lit(" with\ncare")),
        "subject": F.when(e % 4 != 0, F.concat(F.lit("User "), F.col("user_id") + 1)), "chapter": F.lit(999),
    }
    rows = table(spark, sf_dir, "events").select("*", _turn(F.col("user_id"), "primary", "secondary", "filler").alias("tier"), F.when(e % 8 != 0, e % 40).alias("chapter"))
    return validating.valid_facts(_items(rows, "facts", item, "event_id", "user_id", "tier", "chapter"), "event_id", "user_id")
