"""Upserts, roll-ups and replies about names over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import stores
from quire.plans.registry import query, table


def _slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _united(stored: str, incoming: str, name: str) -> str:
    """SQL of stored aliases and the incoming ones that are not among them."""
    return (
        f"array_to_string(list_concat(coalesce({stored}, []), list_filter(coalesce({incoming}, []), lambda a: lower(a) <> lower({name}) "
        f"AND NOT list_contains(list_transform(coalesce({stored}, []), lambda b: lower(b)), lower(a)))), '|')"
    )


ACTION = "CASE WHEN s.key IS NULL THEN 'inserted' WHEN i.key IS NULL THEN 'untouched' ELSE 'updated' END AS action"
CITED = "array_to_string(list_transform(list_concat(coalesce(s.citations, []), list_filter(coalesce(i.citations, []), lambda c: NOT list_contains(coalesce(s.citations, []), c))), lambda c: c.chunk || ':' || c.chapter), ',') AS citations"


def _cited(citations: str) -> Column:
    return F.array_join(F.transform(citations, lambda c: F.concat_ws(":", c["chunk"], c["chapter"])), ",").alias("citations")


# Parts are mentions of the entity (brand, type): those up to size 25 are stored, larger ones come in.
ENTITY_SIDE = f"""SELECT {_slug("p_brand || ' ' || p_type")} AS key, min(p_brand || ' ' || p_type) AS name, list_sort(list(DISTINCT p_name)) AS aliases, max(p_name || ' ' || floor(p_retailprice)::BIGINT) AS summary,
  list_sort(list(DISTINCT {{'chunk': p_partkey, 'chapter': p_size}})) AS citations, min(p_partkey) % 4 = 0 AS edited, CASE WHEN min(p_partkey) % 5 = 0 THEN 'kept' ELSE 'proposed' END AS status FROM part"""


@query(f"""WITH s AS ({ENTITY_SIDE} WHERE p_size <= 25 GROUP BY 1), i AS ({ENTITY_SIDE} WHERE p_size > 25 GROUP BY 1)
SELECT coalesce(s.key, i.key) AS key, coalesce(s.name, i.name) AS name, {_united("s.aliases", "i.aliases", "coalesce(s.name, i.name)")} AS aliases, {CITED}, coalesce(s.status, 'proposed') AS status,
  CASE WHEN s.key IS NULL OR (NOT s.edited AND length(i.summary) > length(s.summary)) THEN i.summary ELSE s.summary END AS summary, {ACTION} FROM s FULL JOIN i ON s.key = i.key""")
def upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming entities over stored ones with aliases and citations."""
    name = F.concat_ws(" ", "p_brand", "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", text.slug(name).alias("key"), name.alias("name"), F.concat_ws(" ", "p_name", F.floor("p_retailprice")).alias("summary"))

    def side(part: DataFrame) -> DataFrame:
        cited = F.array_sort(F.collect_set(F.struct(F.col("p_partkey").alias("chunk"), F.col("p_size").alias("chapter"))))
        return part.groupBy("key").agg(
            F.min("name").alias("name"), F.array_sort(F.collect_set("p_name")).alias("aliases"), F.max("summary").alias("summary"), cited.alias("citations"),
            (F.min("p_partkey") % 4 == 0).alias("edited"), F.when(F.min("p_partkey") % 5 == 0, "kept").otherwise("proposed").alias("status"),
        )

    found = stores.upsert_entities(side(rows.where("p_size <= 25")), side(rows.where("p_size > 25")))
    return found.select("key", "name", F.array_join("aliases", "|").alias("aliases"), _cited("citations"), "status", "summary", "action")


# Parts of a brand and type state one rule: those up to size 25 are stored, larger ones come in.
RULE_SIDE = f"""SELECT 'skill:' || {_slug("p_brand || ' ' || p_type")} AS key, min(p_brand || ' ' || p_type) AS name, list_sort(list(DISTINCT p_name)) AS aliases, max(p_name || ' ' || floor(p_retailprice)::BIGINT) AS statement,
  list_sort(list(DISTINCT {{'chunk': p_partkey, 'chapter': p_size}})) AS citations, min(p_partkey) % 4 = 0 AS edited, CASE WHEN min(p_partkey) % 5 = 0 THEN 'discarded' ELSE 'proposed' END AS status,
  CASE WHEN max(p_partkey) % 3 = 0 THEN 'stated' ELSE 'implied' END AS confidence, CASE WHEN max(p_partkey) % 2 = 0 THEN min(p_name) ELSE '' END AS formula, CASE WHEN min(p_partkey) % 3 = 0 THEN NULL ELSE max(p_name) END AS evidence,
  CASE WHEN min(p_size) % 2 = 0 THEN 'system' ELSE 'instance' END AS scope, CASE WHEN min(p_size) % 2 = 0 THEN '' ELSE min(p_brand) END AS applies_to FROM part"""


@query(f"""WITH s AS ({RULE_SIDE} WHERE p_size <= 25 GROUP BY 1), i AS ({RULE_SIDE} WHERE p_size > 25 GROUP BY 1),
j AS (SELECT coalesce(s.key, i.key) AS key, coalesce(s.name, i.name) AS name, {_united("s.aliases", "i.aliases", "coalesce(s.name, i.name)")} AS aliases, {CITED}, coalesce(s.status, 'proposed') AS status, {ACTION}, s.key IS NULL AS fresh,
  s.key IS NULL OR coalesce(NOT s.edited AND (i.confidence > s.confidence OR i.confidence = s.confidence AND length(i.statement) > length(s.statement)), false) AS taken,
  s.statement AS s1, i.statement AS i1, s.confidence AS s2, i.confidence AS i2, s.formula AS s3, i.formula AS i3, s.evidence AS s4, i.evidence AS i4, s.scope AS s5, i.scope AS i5, s.applies_to AS s6, i.applies_to AS i6 FROM s FULL JOIN i ON s.key = i.key)
SELECT key, name, aliases, citations, status, action, if(taken, i1, s1) AS statement, if(taken, i2, s2) AS confidence, if(fresh OR taken AND coalesce(i3, '') <> '', i3, s3) AS formula, if(fresh OR taken AND coalesce(i4, '') <> '', i4, s4) AS evidence,
  if(fresh, i5, s5) AS scope, if(fresh, i6, s6) AS applies_to FROM j""")
def upsert_whole_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rules over stored ones with all they carry."""
    name = F.concat_ws(" ", "p_brand", "p_type")
    rows = table(spark, sf_dir, "part").withColumns({"key": F.concat(F.lit("skill:"), text.slug(name)), "name": name, "statement": F.concat_ws(" ", "p_name", F.floor("p_retailprice"))})
    low, high, even = F.min("p_partkey"), F.max("p_partkey"), F.min("p_size") % 2 == 0

    def side(part: DataFrame) -> DataFrame:
        cited = F.array_sort(F.collect_set(F.struct(F.col("p_partkey").alias("chunk"), F.col("p_size").alias("chapter"))))
        return part.groupBy("key").agg(
            F.min("name").alias("name"), F.array_sort(F.collect_set("p_name")).alias("aliases"), F.max("statement").alias("statement"), cited.alias("citations"), F.lit("skill").alias("kind"),
            (low % 4 == 0).alias("edited"), F.when(low % 5 == 0, "discarded").otherwise("proposed").alias("status"), F.when(high % 3 == 0, "stated").otherwise("implied").alias("confidence"),
            F.when(high % 2 == 0, F.min("p_name")).otherwise("").alias("formula"), F.when(low % 3 != 0, F.max("p_name")).alias("evidence"),
            F.when(even, "system").otherwise("instance").alias("scope"), F.when(even, "").otherwise(F.min("p_brand")).alias("applies_to"),
        )

    found = stores.upsert_rules(side(rows.where("p_size <= 25")), side(rows.where("p_size > 25")))
    return found.select("key", "name", F.array_join("aliases", "|").alias("aliases"), _cited("citations"), *"status action statement confidence formula evidence scope applies_to".split())


# Orders of a customer and priority are one quest: those before 1996 are stored, later ones come in.
QUEST_SIDE = """SELECT o_custkey || '-' || o_orderpriority AS key, min('Quest ' || o_custkey) AS name, list_sort(list(DISTINCT o_orderstatus)) AS aliases, max(repeat('r', (o_orderkey % 9)::BIGINT)) AS reward, max(repeat('p', (o_orderkey % 4)::BIGINT)) AS penalty,
  list_sort(list(DISTINCT {'chunk': o_orderkey, 'chapter': o_orderkey % 40})) AS citations, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'unknown' WHEN min(o_orderkey) % 3 = 1 THEN 'main' ELSE 'side' END AS kind,
  ['unknown', 'accepted', 'ongoing', 'declined', 'failed', 'completed'][1 + max(o_orderkey % 6)] AS outcome, coalesce(min(nullif(o_orderkey % 40, 0)), 0) AS first_chapter, min(o_orderkey) % 4 = 0 AS edited, 'proposed' AS status FROM orders"""


@query(f"""WITH s AS ({QUEST_SIDE} WHERE year(o_orderdate) < 1996 GROUP BY 1), i AS ({QUEST_SIDE} WHERE year(o_orderdate) >= 1996 GROUP BY 1),
j AS (SELECT s.key IS NULL AS fresh, coalesce(s.key, i.key) AS key, coalesce(s.name, i.name) AS name, {_united("s.aliases", "i.aliases", "coalesce(s.name, i.name)")} AS aliases, {CITED}, {ACTION},
  CASE WHEN s.key IS NULL OR (NOT s.edited AND length(i.reward) > length(s.reward)) THEN i.reward ELSE s.reward END AS reward, CASE WHEN s.key IS NULL OR (NOT s.edited AND length(i.penalty) > length(s.penalty)) THEN i.penalty ELSE s.penalty END AS penalty,
  CASE WHEN s.key IS NULL OR (NOT s.edited AND s.kind = 'unknown' AND i.kind <> 'unknown') THEN i.kind ELSE s.kind END AS kind,
  CASE WHEN s.key IS NULL OR (NOT s.edited AND list_position(['unknown', 'accepted', 'ongoing', 'declined', 'failed', 'completed'], i.outcome) > list_position(['unknown', 'accepted', 'ongoing', 'declined', 'failed', 'completed'], s.outcome)) THEN i.outcome ELSE s.outcome END AS outcome,
  coalesce(least(nullif(s.first_chapter, 0), nullif(i.first_chapter, 0)), 0) AS first_chapter FROM s FULL JOIN i ON s.key = i.key)
SELECT key, name, aliases, citations, reward, penalty, kind, outcome, first_chapter, action FROM j""")
def upsert_quests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming quests over stored ones: longer fields, later outcomes, earliest chapter."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({"key": F.concat_ws("-", "o_custkey", "o_orderpriority"), "name": F.concat(F.lit("Quest "), "o_custkey")})

    def side(part: DataFrame) -> DataFrame:
        least, outcomes = F.min(k), F.array(*(F.lit(o) for o in stores.OUTCOMES))
        return part.groupBy("key").agg(
            F.min("name").alias("name"), F.array_sort(F.collect_set("o_orderstatus")).alias("aliases"), F.max(F.repeat(F.lit("r"), (k % 9).cast("int"))).alias("reward"), F.max(F.repeat(F.lit("p"), (k % 4).cast("int"))).alias("penalty"),
            F.array_sort(F.collect_set(F.struct(k.alias("chunk"), (k % 40).alias("chapter")))).alias("citations"), F.when(least % 3 == 0, "unknown").when(least % 3 == 1, "main").otherwise("side").alias("kind"),
            F.element_at(outcomes, (1 + F.max(k % 6)).cast("int")).alias("outcome"), F.coalesce(F.min(F.nullif(k % 40, F.lit(0))), F.lit(0)).alias("first_chapter"), (least % 4 == 0).alias("edited"), F.lit("proposed").alias("status"),
        )

    found = stores.upsert_quests(side(rows.where(F.year("o_orderdate") < 1996)), side(rows.where(F.year("o_orderdate") >= 1996)), ["reward", "penalty"])
    return found.select("key", "name", F.array_join("aliases", "|").alias("aliases"), _cited("citations"), "reward", "penalty", "kind", "outcome", "first_chapter", "action")


# Customers are stored people, suppliers come in one by one; three suppliers share an alias, and some that of a customer.
@query("""
WITH RECURSIVE s AS (SELECT c_custkey AS id, 'person-' || c_custkey AS key, c_name AS name, [c_mktsegment || ' ' || c_nationkey || '/' || (c_custkey // 10), 'P' || c_custkey] AS aliases, 'n' || c_custkey AS note, 'filler' AS tier, 'stored' AS reason, c_custkey % 50 AS mentions,
    c_custkey % 5 AS speech, c_custkey % 9 AS sections, 'kept' AS status, c_custkey % 3 = 0 AS edited, c_custkey % 4 = 0 AS locked FROM customer),
i AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 2 = 0 THEN 'person-' || s_suppkey * 3 WHEN s_suppkey % 7 = 0 THEN 'shared-' || s_suppkey // 21 ELSE 'supplier-' || s_suppkey END AS key, s_name AS name,
    [CASE WHEN s_suppkey % 4 = 1 THEN 'p' || s_suppkey * 5 ELSE 'q' || s_suppkey % 50 END, 'S' || s_suppkey // 3] AS aliases, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'note ' || s_suppkey END AS note,
    'secondary' AS tier, 'census' AS reason, s_suppkey % 70 AS mentions, s_suppkey % 6 AS speech, s_suppkey % 8 AS sections FROM supplier),
f AS (SELECT id, lower(name) AS form FROM s UNION SELECT id, lower(unnest(aliases)) FROM s),
g AS (SELECT ord, lower(name) AS form FROM i UNION SELECT ord, lower(unnest(aliases)) FROM i),
h AS (SELECT ord, min(id) AS held FROM g JOIN f ON f.form = g.form GROUP BY ord),
n AS (SELECT i.ord, i.key, row_number() OVER (ORDER BY i.ord) AS n, s.id AS kept, held, lower(i.name) AS low, list_transform(i.aliases, lambda a: lower(a)) AS lows FROM i LEFT JOIN s ON s.key = i.key LEFT JOIN h ON h.ord = i.ord),
w AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::STRUCT(g INT, r BIGINT) AS place, []::STRUCT(f VARCHAR, g INT, r BIGINT)[] AS forms, []::STRUCT(k VARCHAR, r BIGINT)[] AS keys
  UNION ALL
  SELECT n, ord, place, list_concat(forms, list_transform(CASE WHEN place.g = 1 AND place.r = ord THEN list_append(lows, low) ELSE lows END, lambda x: {'f': x, 'g': place.g, 'r': place.r})),
    CASE WHEN place.g = 1 AND place.r = ord THEN list_append(keys, {'k': key, 'r': ord}) ELSE keys END
  FROM (SELECT n.n, n.ord, n.key, low, lows, forms, keys, coalesce(CASE WHEN kept IS NOT NULL THEN {'g': 0, 'r': kept} END, list_transform(list_filter(keys, lambda x: x.k = n.key), lambda x: {'g': 1, 'r': x.r})[1],
      list_sort(list_concat(CASE WHEN held IS NULL THEN [] ELSE [{'g': 0, 'r': held}] END, list_transform(list_filter(forms, lambda x: x.f = low OR list_contains(lows, x.f)), lambda x: {'g': x.g, 'r': x.r})))[1], {'g': 1, 'r': n.ord}) AS place
    FROM w JOIN n ON n.n = w.n + 1)),
t AS (SELECT i.*, place.g AS g, place.r AS r FROM w JOIN i ON i.ord = w.ord),
b AS (SELECT 0 AS g, id AS r, key, name, aliases, note, tier, reason, mentions, speech, sections, status, edited, locked FROM s
  UNION ALL SELECT g, r, key, name, aliases, note, tier, reason, mentions, speech, sections, 'proposed', false, false FROM t WHERE g = 1 AND r = ord),
l AS (SELECT g, r, arg_max(tier, ord) AS tier, arg_max(reason, ord) AS reason, arg_max(mentions, ord) AS mentions, arg_max(speech, ord) AS speech, arg_max(sections, ord) AS sections, arg_max(note, ord) FILTER (note <> '') AS note,
    flatten(list(aliases ORDER BY ord)) AS aliases FROM t WHERE NOT (g = 1 AND r = ord) GROUP BY g, r)
SELECT key, name, array_to_string(CASE WHEN l.r IS NULL THEN b.aliases ELSE list_concat(b.aliases, list_filter(l.aliases, lambda a, p: lower(a) <> lower(name) AND NOT list_contains(list_transform(b.aliases, lambda c: lower(c)), lower(a))
    AND list_position(list_transform(l.aliases, lambda c: lower(c)), lower(a)) = p)) END, '|') AS aliases,
  CASE WHEN l.r IS NOT NULL AND NOT edited AND l.note IS NOT NULL THEN l.note ELSE b.note END AS note, CASE WHEN l.r IS NOT NULL AND NOT locked THEN l.tier ELSE b.tier END AS tier, coalesce(l.reason, b.reason) AS reason,
  coalesce(l.mentions, b.mentions) AS mentions, coalesce(l.speech, b.speech) AS speech, coalesce(l.sections, b.sections) AS sections, status, CASE WHEN b.g = 1 THEN 'inserted' WHEN l.r IS NULL THEN 'untouched' ELSE 'updated' END AS action
FROM b LEFT JOIN l ON b.g = l.g AND b.r = l.r""")
def upsert_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new census over stored people and the newcomers before, matched by key, else by any name."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    stored = table(spark, sf_dir, "customer").select(
        c.alias("id"), F.concat(F.lit("person-"), c).alias("key"), F.col("c_name").alias("name"), F.array(F.concat("c_mktsegment", F.lit(" "), "c_nationkey", F.lit("/"), F.floor(c / 10)), F.concat(F.lit("P"), c)).alias("aliases"),
        F.concat(F.lit("n"), c).alias("note"), F.lit("filler").alias("tier"), F.lit("stored").alias("reason"), (c % 50).alias("mentions"), (c % 5).alias("speech"), (c % 9).alias("sections"),
        F.lit("kept").alias("status"), (c % 3 == 0).alias("edited"), (c % 4 == 0).alias("locked"),
    )
    key = F.when(s % 2 == 0, F.concat(F.lit("person-"), s * 3)).when(s % 7 == 0, F.concat(F.lit("shared-"), F.floor(s / 21))).otherwise(F.concat(F.lit("supplier-"), s))
    alias = F.when(s % 4 == 1, F.concat(F.lit("p"), s * 5)).otherwise(F.concat(F.lit("q"), s % 50))
    incoming = table(spark, sf_dir, "supplier").select(
        s.alias("ord"), key.alias("key"), F.col("s_name").alias("name"), F.array(alias, F.concat(F.lit("S"), F.floor(s / 3))).alias("aliases"),
        F.when(s % 3 == 0, "").otherwise(F.concat(F.lit("note "), s)).alias("note"), F.lit("secondary").alias("tier"), F.lit("census").alias("reason"), (s % 70).alias("mentions"), (s % 6).alias("speech"), (s % 8).alias("sections"),
    )
    return stores.upsert_people(stored, incoming).withColumn("aliases", F.array_join("aliases", "|"))


@query("""SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus <> 'P')::BIGINT AS facts FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every person that are not discarded; orders are facts, pending ones discarded."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "discarded").otherwise("proposed").alias("status"))
    return stores.fact_counts(table(spark, sf_dir, "customer").select("c_custkey"), facts, "c_custkey")


def _kinds(by_kind: str) -> Column:
    return F.array_join(F.transform(F.map_entries(by_kind), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("by_kind")


@query("""
WITH r AS (SELECT p_brand, CASE WHEN p_size % 4 = 0 THEN 'instance' ELSE 'system' END AS scope, CASE WHEN p_size > 25 THEN 'stated' ELSE 'implied' END AS confidence, string_split(p_type, ' ')[1] AS kind FROM part),
k AS (SELECT p_brand, string_agg(kind || ':' || n, ',' ORDER BY kind) AS by_kind FROM (SELECT p_brand, kind, count(*) AS n FROM r WHERE scope = 'system' GROUP BY p_brand, kind) GROUP BY p_brand)
SELECT r.p_brand, count(*) FILTER (scope = 'system')::BIGINT AS rules, count(*) FILTER (scope = 'instance')::BIGINT AS instance_rules, count(*) FILTER (confidence = 'stated')::BIGINT AS stated, count(*) FILTER (confidence = 'implied')::BIGINT AS implied, any_value(by_kind) AS by_kind
FROM r LEFT JOIN k ON r.p_brand = k.p_brand GROUP BY r.p_brand""")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a rules document; parts are rules, brands are books."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") % 4 == 0, "instance").otherwise("system").alias("scope"), F.when(F.col("p_size") > 25, "stated").otherwise("implied").alias("confidence"), F.split("p_type", " ")[0].alias("kind"))
    return stores.rule_counts(rows, "p_brand").select("p_brand", "rules", "instance_rules", "stated", "implied", _kinds("by_kind"))


@query("""
WITH q AS (SELECT o_custkey, o_orderpriority AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'gold' ELSE '' END AS reward, CASE WHEN o_orderkey % 3 = 0 THEN 'loss' END AS penalty FROM orders),
k AS (SELECT o_custkey, string_agg(kind || ':' || n, ',' ORDER BY kind) AS by_kind FROM (SELECT o_custkey, kind, count(*) AS n FROM q GROUP BY o_custkey, kind) GROUP BY o_custkey)
SELECT q.o_custkey, count(*)::BIGINT AS quests, count(*) FILTER (reward <> '')::BIGINT AS with_reward, count(*) FILTER (coalesce(penalty, '') <> '')::BIGINT AS with_penalty, any_value(by_kind) AS by_kind FROM q JOIN k ON q.o_custkey = k.o_custkey GROUP BY q.o_custkey""")
def journey_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a journey; orders are quests, customers are books."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("kind"), F.when(k % 2 == 0, "gold").otherwise("").alias("reward"), F.when(k % 3 == 0, "loss").alias("penalty"))
    return stores.journey_counts(rows, "o_custkey").select("o_custkey", "quests", "with_reward", "with_penalty", _kinds("by_kind"))


# Replies about names: every customer is asked about; urgent orders name two, other orders nobody who is known.
REPLIES = "WITH r AS (SELECT o_orderkey AS ord, CASE WHEN o_orderpriority LIKE '1%' THEN [upper(c_name), 'Nobody ' || o_orderkey, 'customer#' || lpad((o_custkey * 7)::VARCHAR, 9, '0')] ELSE ['nobody', 'Nobody ' || o_orderkey, ''] END AS forms FROM orders JOIN customer ON o_custkey = c_custkey)"


def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    other = F.when(F.col("urgent"), F.concat(F.lit("customer#"), F.lpad((F.col("c_custkey") * 7).cast("string"), 9, "0"))).otherwise("")
    rows = orders.join(people, "c_custkey").select("ord", F.when(F.col("urgent"), F.upper("name")).otherwise("nobody").alias("name"), F.array(F.concat(F.lit("Nobody "), "ord"), other).alias("aliases"))
    return rows, people.select("name")


# Every order's reply names its customer and the next one.
NAMING = "WITH r AS (SELECT o_orderkey AS ord, [upper(c_name), 'Nobody ' || o_orderkey, 'customer#' || lpad((o_custkey + 1)::VARCHAR, 9, '0')] AS forms FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(NAMING + """, f AS (SELECT ord, unnest(forms) AS form, generate_subscripts(forms, 1) AS i FROM r), k AS (SELECT ord, c_name AS known, min(i) AS i FROM f JOIN customer ON lower(form) = lower(c_name) GROUP BY ord, c_name),
b AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY length(known) DESC, i) AS n FROM k)
SELECT ord, max(known) FILTER (n = 1) AS name, coalesce(string_agg(known, '|' ORDER BY i) FILTER (n > 1), '') AS aliases FROM b GROUP BY ord""")
def known_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of replies under the names that were asked about."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("c_custkey"))
    after = F.concat(F.lit("customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0"))
    replies = orders.join(people, "c_custkey").select("ord", F.upper("name").alias("name"), F.array(F.concat(F.lit("Nobody "), "ord"), after).alias("aliases"))
    return stores.known_people(replies, people.select("name")).withColumn("aliases", F.array_join("aliases", "|"))


@query(REPLIES + " SELECT c_name AS name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(unnest(forms)) FROM r)")
def unaccounted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no reply accounts for."""
    replies, known = _replies(spark, sf_dir)
    return stores.unaccounted(known, replies)


@query("""
WITH asked AS (SELECT DISTINCT 'C' || o_custkey AS a, 'C' || (o_custkey + o_orderkey % 3) AS b FROM orders), said AS (SELECT 'c' || (l_suppkey + l_linenumber % 3) AS a, 'c' || l_suppkey AS b FROM lineitem)
SELECT a, b FROM asked WHERE (lower(a), lower(b)) IN (SELECT (a, b) FROM said) OR (lower(b), lower(a)) IN (SELECT (a, b) FROM said)""")
def confirmed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked pairs of names that replies confirm, in either order."""
    name = lambda mark, c: F.concat(F.lit(mark), c)
    asked = table(spark, sf_dir, "orders").select(name("C", F.col("o_custkey")).alias("a"), name("C", F.col("o_custkey") + F.col("o_orderkey") % 3).alias("b")).distinct()
    said = table(spark, sf_dir, "lineitem").select(name("c", F.col("l_suppkey") + F.col("l_linenumber") % 3).alias("a"), name("c", F.col("l_suppkey")).alias("b"))
    return stores.confirmed_pairs(said, asked)
