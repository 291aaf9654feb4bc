"""Lists, tiers by hand, books replaced and deleted, casts and seeds over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import dossiers as sheets
from quire.operators import listings
from quire.operators.merging import RULE_KINDS
from quire.plans.curating import FACTS, _facts
from quire.plans.registry import query, table


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# -- rules: a part is a rule, the orders that hold it cite it --------------------------------------
RULES = f"""
WITH cited AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS citations FROM lineitem GROUP BY l_partkey),
r AS (SELECT p_partkey AS id, {_words(RULE_KINDS)}[p_size % 9 + 1] AS kind, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'proposed' ELSE 'discarded' END AS status,
  coalesce(citations, 0)::BIGINT AS citations FROM part LEFT JOIN cited ON p_partkey = l_partkey)
"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("citations"))
    kind = F.element_at(F.array(*(F.lit(k) for k in RULE_KINDS)), F.col("p_size") % 9 + 1)
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").join(cited, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"),
        F.when(k == 0, "kept").when(k == 1, "proposed").otherwise("discarded").alias("status"), F.coalesce("citations", F.lit(0)).alias("citations"),
    )


@query(RULES + "SELECT id, kind, name, citations FROM r WHERE status = 'kept' ORDER BY citations DESC, kind, lower(name), id")
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rules, the most cited first, kinds by letter."""
    return listings.listed(_rules(spark, sf_dir), "rules", status="kept").select("id", "kind", "name", "citations")


@query(RULES + f"SELECT id, kind, name, citations FROM r ORDER BY citations DESC, list_position({_words(RULE_KINDS)}, kind), lower(name), id")
def merged_rule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, the most cited first, kinds in the order of their vocabulary."""
    return listings.listed(_rules(spark, sf_dir), "merged_rules").select("id", "kind", "name", "citations")


@query("SELECT o_orderkey AS id, day(o_orderdate)::INT AS first_chapter, o_orderpriority AS name FROM orders ORDER BY first_chapter, lower(name), id")
def list_quests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quests in the order of a journey."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").alias("first_chapter"), F.col("o_orderpriority").alias("name"))
    return listings.listed(rows, "quests")


# -- people: a customer is a person -----------------------------------------------------------------
PEOPLE = """
WITH p AS (SELECT c_custkey AS id, c_mktsegment || ' ' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'filler' ELSE 'extra' END AS tier,
  c_nationkey AS speech, floor(c_acctbal / 100)::BIGINT AS mentions FROM customer)
"""
TIER_RANK = "CASE tier WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 ELSE 3 END"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", "c_custkey").alias("name"),
        F.when(k == 0, "primary").when(k == 1, "secondary").when(k == 2, "filler").otherwise("extra").alias("tier"),
        F.col("c_nationkey").alias("speech"), F.floor(F.col("c_acctbal") / 100).alias("mentions"),
    )


@query(PEOPLE + f"SELECT id, tier, speech, mentions FROM p ORDER BY {TIER_RANK}, speech DESC, mentions DESC, id")
def list_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by tier, then those who speak most."""
    return listings.listed(_people(spark, sf_dir), "people").select("id", "tier", "speech", "mentions")


@query(PEOPLE + f"SELECT id, tier, speech, name FROM p ORDER BY {TIER_RANK}, speech DESC, lower(name), id")
def census_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People as a census gives them: ties by name."""
    return listings.listed(_people(spark, sf_dir), "census").select("id", "tier", "speech", "name")


@query(PEOPLE + "SELECT id, mentions, name FROM p ORDER BY mentions DESC, name, id")
def harvest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a harvest gives them: the most mentioned first."""
    return listings.listed(_people(spark, sf_dir), "harvest").select("id", "mentions", "name")


@query(FACTS + " SELECT owner, field, chapter, ord AS id FROM f WHERE chapter <= 10 ORDER BY owner, field, chapter, id")
def list_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts known at chapter 10 by owner, field and chapter."""
    known = sheets.as_of(_facts(spark, sf_dir), 10).withColumnRenamed("ord", "id")
    return listings.listed(known, "facts").select("owner", "field", "chapter", "id")


@query(PEOPLE + """, e AS (SELECT o_custkey AS id, o_orderkey AS ord, ['primary', 'secondary', 'filler', 'hero', 'hero'][left(o_orderpriority, 1)::INT] AS tier FROM orders),
l AS (SELECT id, arg_max(tier, ord) AS tier FROM e WHERE tier <> 'hero' GROUP BY id)
SELECT p.id, coalesce(l.tier, p.tier) AS tier, CASE WHEN l.id IS NULL THEN 'by counts' ELSE 'set by hand' END AS reason, l.id IS NOT NULL OR p.id % 10 = 0 AS locked FROM p LEFT JOIN l ON p.id = l.id""")
def tier_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of people under those set by hand, each order an edit."""
    people = _people(spark, sf_dir).select("id", "tier", F.lit("by counts").alias("reason"), (F.col("id") % 10 == 0).alias("locked"))
    tiers = F.array(*(F.lit(t) for t in ("primary", "secondary", "filler", "hero", "hero")))
    edits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.element_at(tiers, F.left("o_orderpriority", F.lit(1)).cast("int")).alias("tier"))
    return listings.with_tiers(people, edits)


# -- books: an order is a book, its lines are sections -----------------------------------------------
@query("""
SELECT l_orderkey AS book, l_linenumber AS position, l_partkey AS ref FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def replace_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections after some books were parsed anew, all of each at once."""
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("ref"))
    incoming = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("book"), F.lit(1).alias("position"), F.col("o_custkey").alias("ref"))
    return listings.replace_books(stored, incoming, "book")


@query("""SELECT l_orderkey AS book, count(*)::BIGINT AS sections FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY l_orderkey""")
def delete_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by book that stay when books are deleted with all that is theirs."""
    gone = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("book"))
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"))
    return listings.without_books(sections, gone, "book").groupBy("book").agg(F.count("*").alias("sections"))


@query(rf"""SELECT source, to_json(struct_pack(book := struct_pack(slug := trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-')),
  parse := struct_pack(chapters := count(*), words := sum(coalesce(len(regexp_extract_all(text, {_sql("[^ " + chr(92) + "x09-" + chr(92) + "x0D]+")})), 0))::BIGINT)))::VARCHAR AS manifest
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def book_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was parsed of each book, as JSON; its sections are a table of their own."""
    totals = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("chapters"), F.sum(text.words(F.col("text"))).alias("words"))
    return totals.select("source", F.to_json(F.struct(F.struct(text.slug(F.col("source")).alias("slug")).alias("book"), F.struct("chapters", "words").alias("parse"))).alias("manifest"))


CAST = FACTS + """, o AS (SELECT DISTINCT owner FROM f), s AS (SELECT owner, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (chapter <= 1), '') AS fields FROM f GROUP BY owner),
d AS (SELECT owner AS id, concat_ws('; ', CASE WHEN owner % 4 = 1 THEN 'unreadable contract version 2.1' END, CASE WHEN fields = '' THEN 'no fields' END) AS problems FROM s WHERE owner % 11 <> 0),
c AS (SELECT owner AS id, CASE owner % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'filler' END AS tier, coalesce(problems, 'no sheet') AS reason
  FROM o LEFT JOIN d ON owner = d.id WHERE owner % 3 <> 2 AND owner % 5 <> 0)
"""


def _cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, o = _facts(spark, sf_dir), F.col("owner")
    people = facts.select("owner").distinct().select(
        o.alias("id"), F.when(o % 3 == 0, "primary").when(o % 3 == 1, "secondary").otherwise("filler").alias("tier"), F.when(o % 5 == 0, "discarded").otherwise("kept").alias("status"),
    )
    problems = sheets.problems(F.when(o % 4 == 1, "2.1").otherwise("1.3"), F.concat(F.lit("user "), o.cast("string")), F.lit(True), F.col("fields"))
    found = sheets.dossiers(facts, "owner", 1).where(o % 11 != 0).select(o.alias("id"), problems.alias("problems"))
    return listings.cast_list(people, found)


@query(CAST + "SELECT id, tier, reason = '' AS usable, reason FROM c")
def cast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone a cast asks for, usable or not, and why not; some have no sheet."""
    return _cast(spark, sf_dir)


@query(CAST + "SELECT tier, count(*) FILTER (reason = '')::BIGINT AS usable, count(*) FILTER (reason <> '')::BIGINT AS unusable FROM c GROUP BY tier")
def cast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable and unusable dossiers by tier."""
    return _cast(spark, sf_dir).groupBy("tier").agg(F.count_if("usable").alias("usable"), F.count_if(~F.col("usable")).alias("unusable"))


# -- sheets: a section is a fact of its book, some lines of which tell an expression ------------------
SHEETS = f"""
WITH f AS (SELECT p_size AS owner, {_words(sheets.FIELDS)}[p_partkey % 7 + 1] AS field, p_partkey % 30 AS chapter, p_partkey AS ord,
  CASE WHEN p_partkey % 10 = 1 THEN p_name || ', smiling' ELSE p_name END AS text FROM part),
x AS (SELECT * FROM f WHERE field = 'appearance'),
k AS (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY chapter, ord) AS n, CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN trim(text) ELSE trim(text) || '.' END AS text
  FROM x WHERE NOT regexp_matches(text, {_sql(sheets.EXPRESSION)})),
l AS (SELECT owner, string_agg(text, ' ' ORDER BY n) AS looks FROM k WHERE n <= 12 GROUP BY owner),
n AS (SELECT owner, count(*)::BIGINT AS dropped FROM x WHERE regexp_matches(text, {_sql(sheets.EXPRESSION)}) GROUP BY owner),
o AS (SELECT *, row_number() OVER (PARTITION BY owner, field ORDER BY chapter, ord) AS n FROM f),
c AS (SELECT owner, {", ".join(f"max(trim(text)) FILTER (field = '{f}' AND n = 1) AS {f}" for f in listings.CARD_FIELDS)} FROM o GROUP BY owner)
"""


@query(SHEETS + f"""SELECT c.owner, CASE WHEN c.owner % 2 = 0 THEN 'primary' ELSE 'secondary' END AS tier, coalesce(looks, '') AS looks, coalesce(dropped, 0)::BIGINT AS dropped,
  {", ".join(f"coalesce({f}, '') AS {f}" for f in listings.CARD_FIELDS)} FROM c LEFT JOIN l ON c.owner = l.owner LEFT JOIN n ON c.owner = n.owner""")
def persona_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opens a project for each person: looks, first facts, how many facts were dropped."""
    field = F.element_at(F.array(*(F.lit(f) for f in sheets.FIELDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    told = F.when(F.col("p_partkey") % 10 == 1, F.concat("p_name", F.lit(", smiling"))).otherwise(F.col("p_name"))
    facts = table(spark, sf_dir, "part").select(F.col("p_size").alias("owner"), field.alias("field"), (F.col("p_partkey") % 30).alias("chapter"), F.col("p_partkey").alias("ord"), told.alias("text"))
    people = facts.select("owner").distinct().withColumn("tier", F.when(F.col("owner") % 2 == 0, "primary").otherwise("secondary"))
    seeds = listings.persona_seeds(facts, people)
    return seeds.select("owner", "tier", "looks", "dropped", *(F.coalesce(f, F.lit("")).alias(f) for f in listings.CARD_FIELDS))
