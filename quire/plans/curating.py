"""Merges, upserts, curation, facts and dossiers over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import dossiers as sheets
from quire.operators import merging
from quire.plans.registry import query, table


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _unions(rows: str) -> str:
    """SQL of the aliases and citations of each key of ``rows`` (key, ord, name, aliases, citations)."""
    return f"""
named AS (SELECT key, arg_min(name, ord) AS name FROM {rows} GROUP BY key),
spelled AS (SELECT r.key, arg_min(alias, (ord, i)) AS alias, min((ord, i)) AS seat FROM (SELECT key, ord, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS i FROM {rows}) r JOIN named n ON r.key = n.key WHERE lower(alias) <> lower(name) GROUP BY r.key, lower(alias)),
listed AS (SELECT key, string_agg(alias, '|' ORDER BY seat) AS aliases FROM spelled GROUP BY key),
once AS (SELECT key, c, min((ord, i)) AS seat FROM (SELECT key, ord, unnest(citations) AS c, generate_subscripts(citations, 1) AS i FROM {rows}) GROUP BY key, c),
cited AS (SELECT key, string_agg(c.chunk || ':' || c.chapter, ',' ORDER BY seat) AS citations FROM once GROUP BY key),
united AS (SELECT n.key, n.name, coalesce(aliases, '') AS aliases, coalesce(citations, '') AS citations FROM named n LEFT JOIN listed l ON n.key = l.key LEFT JOIN cited c ON n.key = c.key)"""


def _first_longest(field: str, rows: str) -> str:
    return f"(SELECT key, arg_min({field}, ord) AS {field} FROM (SELECT *, max(length({field})) OVER (PARTITION BY key) AS most FROM {rows}) WHERE length({field}) = most GROUP BY key)"


def _lists(found: DataFrame) -> DataFrame:
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["chunk"], c["chapter"])), ",") if "citations" in found.columns else None
    found = found.withColumn("aliases", F.array_join("aliases", "|"))
    return found if cited is None else found.withColumn("citations", cited)


def _cited(chunk: F.Column, *chapters: F.Column) -> F.Column:
    return F.array(*(F.struct(chunk.alias("chunk"), c.alias("chapter")) for c in chapters))


# -- entities: part rows as mentions of the entity (brand); some cite two chapters ---------------
@query(f"""
WITH r AS (SELECT 'term:' || {_slug("p_brand")} AS key, p_partkey AS ord, CASE WHEN p_size > 25 THEN 'location' ELSE 'term' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS name, [p_type, lower(p_brand), upper(p_type)] AS aliases,
  p_name AS summary, [{{'chunk': p_partkey // 4, 'chapter': p_size % 5}}, {{'chunk': p_partkey // 4, 'chapter': p_size % 3}}] AS citations FROM part), {_unions("r")}
SELECT u.*, arg_min(kind, ord) AS kind, any_value(l.summary) AS summary FROM united u JOIN r ON u.key = r.key JOIN {_first_longest("summary", "r")} l ON u.key = l.key GROUP BY ALL""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities folded by key: longest summary, union of aliases and citations."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("term:"), text.slug(F.col("p_brand"))).alias("key"), k.alias("ord"), F.when(size > 25, "location").otherwise("term").alias("kind"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("name"),
        F.array("p_type", F.lower("p_brand"), F.upper("p_type")).alias("aliases"), F.col("p_name").alias("summary"), _cited(F.floor(k / 4), size % 5, size % 3).alias("citations"),
    )
    return _lists(merging.merge_entities(rows))


# -- rules: part rows as statements, stated for large sizes ------------------------------------
@query(f"""
WITH RECURSIVE r AS (SELECT 'skill:' || {_slug("p_brand")} AS key, p_partkey AS ord, 'skill' AS kind, p_brand AS name, [p_type, p_name] AS aliases, p_name AS statement, CASE WHEN p_size > 25 THEN 'stated' ELSE 'implied' END AS confidence,
    CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS formula, CASE WHEN p_partkey % 2 = 0 THEN p_name || '!' ELSE '' END AS evidence, CASE WHEN p_partkey % 4 = 0 THEN 'instance' ELSE 'system' END AS scope, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS applies_to,
    [{{'chunk': p_partkey // 5, 'chapter': p_size}}] AS citations FROM part), {_unions("r")},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM r),
fold AS (SELECT key, i, kind, scope, applies_to, statement, confidence, formula, evidence FROM n WHERE i = 1
  UNION ALL SELECT f.key, n.i, f.kind, f.scope, f.applies_to, CASE WHEN take THEN n.statement ELSE f.statement END, CASE WHEN take THEN n.confidence ELSE f.confidence END,
    CASE WHEN take AND n.formula <> '' THEN n.formula ELSE f.formula END, CASE WHEN take AND n.evidence <> '' THEN n.evidence ELSE f.evidence END
  FROM (SELECT f.*, (n2.confidence = 'stated' AND f.confidence <> 'stated') OR (n2.confidence = f.confidence AND length(n2.statement) > length(f.statement)) AS take
    FROM fold f JOIN n n2 ON f.key = n2.key AND n2.i = f.i + 1) f JOIN n ON f.key = n.key AND n.i = f.i + 1),
last AS (SELECT key, max(i) AS i FROM n GROUP BY key)
SELECT u.*, kind, scope, applies_to, statement, confidence, formula, evidence FROM fold f JOIN last l ON f.key = l.key AND f.i = l.i JOIN united u ON f.key = u.key""")
def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules folded by key: stated beats implied, then the longer; formulas and evidence follow."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("skill:"), text.slug(F.col("p_brand"))).alias("key"), k.alias("ord"), F.lit("skill").alias("kind"), F.col("p_brand").alias("name"), F.array("p_type", "p_name").alias("aliases"), F.col("p_name").alias("statement"),
        F.when(size > 25, "stated").otherwise("implied").alias("confidence"), F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("formula"), F.when(k % 2 == 0, F.concat("p_name", F.lit("!"))).otherwise("").alias("evidence"),
        F.when(k % 4 == 0, "instance").otherwise("system").alias("scope"), F.when(k % 4 == 0, F.col("p_name")).otherwise("").alias("applies_to"), _cited(F.floor(k / 5), size).alias("citations"),
    )
    return _lists(merging.merge_rules(rows))


# -- quests: orders of a customer as mentions of one quest -------------------------------------
QUEST_FIELDS = {"objective": ("o_orderpriority", 2), "giver": ("concat('Clerk ', o_orderkey % 30)", 3), "requirements": ("o_orderstatus || o_orderkey", 4), "reward": ("o_orderpriority || ' gold'", 5), "penalty": ("repeat('x', (o_orderkey % 13)::INT)", 1), "deadline": ("o_orderdate::DATE::VARCHAR", 6)}


@query(f"""
WITH r AS (SELECT o_custkey::VARCHAR AS key, o_orderkey AS ord, 'Customer ' || o_custkey AS name, [o_orderpriority, lower(o_orderpriority), concat('Clerk ', o_orderkey % 30)] AS aliases, {", ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN {v} ELSE '' END AS {f}" for f, (v, n) in QUEST_FIELDS.items())},
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' ELSE 'accepted' END AS outcome, CASE WHEN o_orderkey % 5 = 0 THEN 'side' WHEN o_orderkey % 7 = 0 THEN 'main' ELSE 'unknown' END AS kind,
    o_orderkey % 40 AS chapter, [{{'chunk': o_orderkey // 100, 'chapter': o_orderkey % 40}}] AS citations FROM orders), {_unions("r")}
SELECT u.*, {", ".join(f"any_value({f}.{f}) AS {f}" for f in QUEST_FIELDS)}, coalesce(arg_min(kind, ord) FILTER (kind <> 'unknown'), 'unknown') AS kind,
  arg_max(outcome, list_position(['unknown', 'accepted', 'ongoing', 'declined', 'failed', 'completed'], outcome)) AS outcome, coalesce(min(nullif(chapter, 0)), 0)::BIGINT AS first_chapter
FROM united u JOIN r ON u.key = r.key {" ".join(f"JOIN {_first_longest(f, 'r')} {f} ON u.key = {f}.key" for f in QUEST_FIELDS)} GROUP BY ALL""")
def quest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quests folded by key: longest fields, first known kind, best outcome, earliest chapter, aliases, citations."""
    k = F.col("o_orderkey")
    made = {f: F.expr(v.replace("::INT", "").replace("::DATE::VARCHAR", "").replace("repeat('x', (o_orderkey % 13))", "repeat('x', cast(o_orderkey % 13 AS INT))")) for f, (v, _) in QUEST_FIELDS.items()}
    made["deadline"] = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), k.alias("ord"), F.concat(F.lit("Customer "), "o_custkey").alias("name"), F.array("o_orderpriority", F.lower("o_orderpriority"), F.concat(F.lit("Clerk "), k % 30)).alias("aliases"),
        *(F.when(k % n == 0, made[f]).otherwise("").alias(f) for f, (_, n) in QUEST_FIELDS.items()),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "ongoing").otherwise("accepted").alias("outcome"),
        F.when(k % 5 == 0, "side").when(k % 7 == 0, "main").otherwise("unknown").alias("kind"), (k % 40).alias("first_chapter"), _cited(F.floor(k / 100), k % 40).alias("citations"),
    )
    return _lists(merging.merge_quests(rows, list(QUEST_FIELDS)))


@query(f"""
WITH r AS (SELECT {_slug("c_mktsegment || ' ' || c_nationkey")} AS key, c_custkey AS ord, c_mktsegment || ' ' || c_nationkey AS name, [c_name, lower(c_mktsegment), c_mktsegment] AS aliases, []::STRUCT(chunk BIGINT, chapter BIGINT)[] AS citations,
    CASE WHEN c_acctbal > 9000 THEN 'primary' WHEN c_acctbal > 5000 THEN 'secondary' ELSE 'filler' END AS tier, 'by ' || c_custkey AS reason, repeat('n', (c_custkey % 7)::BIGINT) || c_name AS note, c_custkey % 11 AS mentions, c_custkey % 3 AS speech,
    c_custkey % 20 AS first_section, c_custkey % 20 + 5 AS last_section FROM customer), {_unions("r")},
t AS (SELECT key, ['primary', 'secondary', 'filler'][min(list_position(['primary', 'secondary', 'filler'], tier))] AS tier FROM r GROUP BY key)
SELECT u.key, u.name, u.aliases, t.tier, arg_min(reason, ord) FILTER (r.tier = t.tier) || CASE WHEN min(ord) FILTER (r.tier = t.tier) > min(ord) THEN ' (best across books)' ELSE '' END AS reason, any_value(l.note) AS note,
  sum(mentions)::BIGINT AS mentions, sum(speech)::BIGINT AS speech, count(*)::BIGINT AS sections, arg_min(first_section, ord) AS first_section, arg_min(last_section, ord) AS last_section
FROM united u JOIN r ON u.key = r.key JOIN t ON u.key = t.key JOIN {_first_longest("note", "r")} l ON r.key = l.key GROUP BY ALL""")
def series_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters over books: best tier and its reason, longest note, sums, aliases."""
    name, k = F.concat_ws(" ", "c_mktsegment", "c_nationkey"), F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        text.slug(name).alias("key"), k.alias("ord"), name.alias("name"), F.array("c_name", F.lower("c_mktsegment"), "c_mktsegment").alias("aliases"),
        F.when(F.col("c_acctbal") > 9000, "primary").when(F.col("c_acctbal") > 5000, "secondary").otherwise("filler").alias("tier"), F.concat(F.lit("by "), k).alias("reason"),
        F.concat(F.repeat(F.lit("n"), (k % 7).cast("int")), "c_name").alias("note"), (k % 11).alias("mentions"), (k % 3).alias("speech"), F.lit(1).alias("sections"), (k % 20).alias("first_section"), (k % 20 + 5).alias("last_section"),
    )
    return _lists(merging.merge_series(rows))


@query(f"""SELECT {_slug("p_brand")} AS key, string_agg(DISTINCT string_split(p_type, ' ')[1], ',' ORDER BY string_split(p_type, ' ')[1]) AS kinds FROM part GROUP BY 1 HAVING count(DISTINCT string_split(p_type, ' ')[1]) > 1""")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names filed under several kinds."""
    rows = table(spark, sf_dir, "part").select(text.slug(F.col("p_brand")).alias("key"), F.split("p_type", " ")[0].alias("kind"))
    return merging.conflicts(rows).select("key", F.array_join("kinds", ",").alias("kinds"))


# -- upserts: events of the first 15 days are stored, later ones come in, by user and hour --------
RULES = """
WITH e AS (SELECT *, user_id * 100 + hour(ts) AS key FROM events),
s AS (SELECT key, arg_max(props, event_id) AS statement, CASE WHEN max(value) > 400 THEN 'stated' ELSE 'implied' END AS confidence, key % 7 = 0 AS edited, CASE WHEN key % 5 = 0 THEN 'discarded' ELSE 'proposed' END AS status
  FROM e WHERE day(ts) <= 15 GROUP BY key),
i AS (SELECT key, arg_max(props || event_type, event_id) AS statement, CASE WHEN max(value) > 450 THEN 'stated' ELSE 'implied' END AS confidence FROM e WHERE day(ts) > 15 GROUP BY key)
"""


@query(RULES + """, j AS (SELECT coalesce(s.key, i.key) AS key, s.key IS NULL AS fresh, i.key IS NULL AS idle, s.statement AS ss, s.confidence AS sc, i.statement AS ist, i.confidence AS ic, coalesce(status, 'proposed') AS status,
  s.key IS NULL OR (i.key IS NOT NULL AND NOT s.edited AND ((i.confidence = 'stated' AND s.confidence <> 'stated') OR (i.confidence = s.confidence AND length(i.statement) > length(s.statement)))) AS take
  FROM s FULL JOIN i ON s.key = i.key)
SELECT key, CASE WHEN take THEN ist ELSE ss END AS statement, CASE WHEN take THEN ic ELSE sc END AS confidence, status, CASE WHEN fresh THEN 'inserted' WHEN idle THEN 'untouched' ELSE 'updated' END AS action FROM j""")
def upsert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rules over stored ones; edits and curation stay."""
    events = table(spark, sf_dir, "events").withColumn("key", F.col("user_id") * 100 + F.hour("ts"))
    state = lambda limit: F.when(F.max("value") > limit, "stated").otherwise("implied").alias("confidence")
    stored = events.where(F.dayofmonth("ts") <= 15).groupBy("key").agg(F.max_by("props", "event_id").alias("statement"), state(400))
    stored = stored.withColumns({"edited": F.col("key") % 7 == 0, "status": F.when(F.col("key") % 5 == 0, "discarded").otherwise("proposed")})
    incoming = events.where(F.dayofmonth("ts") > 15).groupBy("key").agg(F.max_by(F.concat("props", "event_type"), "event_id").alias("statement"), state(450))
    return merging.upsert_rules(stored, incoming)


@query("""
WITH r AS (SELECT user_id AS owner, event_type AS key, event_id AS ord, props AS text, day(ts)::INT % 10 AS chapter, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS gen FROM events)
SELECT owner, key, arg_min(text, gen * 1000000000000 + ord) AS text, coalesce(min(nullif(chapter, 0)), 0) AS chapter, min(gen) = 1 AS inserted FROM r GROUP BY owner, key""")
def upsert_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by owner and key: first text, earliest known chapter."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.col("props").alias("text"), (F.dayofmonth("ts") % 10).alias("chapter"), (F.dayofmonth("ts") <= 15).alias("old"))
    return merging.upsert_facts(rows.where("old").drop("old"), rows.where("NOT old").drop("old"))


@query("""
WITH f AS (SELECT c_custkey AS id, c_custkey % 2 AS side, unnest(list_distinct([lower(c_name), lower(c_mktsegment || '-' || (c_custkey // 20))])) AS form FROM customer)
SELECT a.id AS incoming_id, min(b.id) AS stored_id FROM f a JOIN f b ON a.form = b.form AND a.side = 1 AND b.side = 0 GROUP BY a.id""")
def any_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming people by name or alias to the first stored person who shares one."""
    alias = F.concat(F.col("c_mktsegment"), F.lit("-"), F.floor(F.col("c_custkey") / 20))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(alias).alias("aliases"))
    return merging.any_name_match(people.where("id % 2 = 0"), people.where("id % 2 = 1"))


@query("""
WITH p AS (SELECT CASE WHEN user_id % 10 = 3 THEN user_id - 1 ELSE user_id END AS id, day(ts) AS chapter, count(*) AS mentions, count(*) FILTER (event_type = 'click') AS speech FROM events GROUP BY user_id, day(ts))
SELECT id, sum(mentions)::BIGINT AS mentions, sum(speech)::BIGINT AS speech, count(DISTINCT chapter)::BIGINT AS chapters, min(chapter)::INT AS first_chapter, max(chapter)::INT AS last_chapter FROM p GROUP BY id""")
def manual_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People after merges by hand, chapters counted once."""
    events = table(spark, sf_dir, "events")
    people = events.groupBy(F.col("user_id").alias("id"), F.dayofmonth("ts").alias("chapter")).agg(F.count("*").alias("mentions"), F.count_if(F.col("event_type") == "click").alias("speech"))
    absorbed = events.where("user_id % 10 = 3").select(F.col("user_id").alias("id"), (F.col("user_id") - 1).alias("into")).distinct()
    return merging.manual_merge(people, absorbed)


# -- curation: labels decide the status of sections ---------------------------------------------
STATUS = """
WITH s AS (SELECT d.doc_id, source, CASE WHEN toxic = 1 THEN 'discarded' WHEN quality = 1 THEN 'kept' ELSE 'proposed' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    found = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return found.withColumn("status", F.when(F.col("toxic") == 1, "discarded").when(F.col("quality") == 1, "kept").otherwise("proposed"))


@query(STATUS + """SELECT source, count(*) FILTER (status = 'proposed')::BIGINT AS proposed, count(*) FILTER (status = 'kept')::BIGINT AS kept, count(*) FILTER (status = 'discarded')::BIGINT AS discarded,
  count(*)::BIGINT AS total, count(*) FILTER (status <> 'discarded')::BIGINT AS wanted FROM s GROUP BY source""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each curation status, zero where there are none."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in merging.STATUS]
    return _status(spark, sf_dir).groupBy("source").agg(*counts, F.count("*").alias("total"), F.count_if(F.col("status") != "discarded").alias("wanted"))


@query("""
WITH log AS (SELECT doc_id, doc_id * 2 AS ord, CASE WHEN quality = 1 THEN 'kept' END AS status, NULL AS lang FROM labels
  UNION ALL SELECT doc_id, doc_id * 2 + 1, CASE WHEN toxic = 1 THEN 'discarded' END, CASE WHEN quality = 0 THEN 'xx' END FROM labels),
l AS (SELECT doc_id, arg_max(status, ord) AS status, arg_max(lang, ord) AS lang FROM log GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.lang, d.lang) AS lang, coalesce(l.status, 'proposed') AS status FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id""")
def curation_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under the latest status and edit of a curation log."""
    labels = table(spark, sf_dir, "labels")
    none = F.lit(None).cast("string")
    log = labels.select("doc_id", (F.col("doc_id") * 2).alias("ord"), F.when(F.col("quality") == 1, "kept").alias("status"), none.alias("lang"))
    log = log.unionByName(labels.select("doc_id", (F.col("doc_id") * 2 + 1).alias("ord"), F.when(F.col("toxic") == 1, "discarded").alias("status"), F.when(F.col("quality") == 0, "xx").alias("lang")))
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("proposed").alias("status"))
    return merging.overlay(base, log, "doc_id", ["lang", "status"])


@query(STATUS + "SELECT doc_id, status FROM s WHERE NOT (status = 'proposed' AND doc_id % 4 <> 0 AND doc_id % 9 <> 0)")
def clear_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clear leaves: curated, edited and locked rows."""
    rows = _status(spark, sf_dir).withColumns({"edited": F.col("doc_id") % 4 == 0, "locked": F.col("doc_id") % 9 == 0})
    return merging.clear_proposed(rows).select("doc_id", "status")


@query(STATUS + ", n AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT n.doc_id, ((i - 1) // 25)::BIGINT AS batch FROM n JOIN s ON n.doc_id = s.doc_id WHERE status <> 'discarded'")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 25 consecutive sections of a book, without discarded sections."""
    from quire.operators.numbering import numbered

    return numbered(_status(spark, sf_dir).select("doc_id", "source", "status"), "source", "doc_id", "i").where("status <> 'discarded'").select("doc_id", F.floor((F.col("i") - 1) / 25).alias("batch"))


# -- facts: an event is a fact of its user, known from its day on --------------------------------
FACTS = "WITH f AS (SELECT user_id AS owner, event_type AS field, event_id AS ord, props AS text, day(ts)::INT AS chapter FROM events)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("field"), F.col("event_id").alias("ord"), F.col("props").alias("text"), F.dayofmonth("ts").alias("chapter"))


@query(FACTS + " SELECT owner, field, ord, chapter FROM f WHERE coalesce(chapter, 0) <= 10")
def facts_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts known at chapter 10."""
    return sheets.as_of(_facts(spark, sf_dir), 10).select("owner", "field", "ord", "chapter")


@query(FACTS + " SELECT owner, field, count(*)::BIGINT AS facts, md5(string_agg(text, '|' ORDER BY chapter, ord)) AS digest, min(chapter) AS first_chapter, max(chapter) AS last_chapter FROM f GROUP BY owner, field")
def facts_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by owner and field in order of chapter."""
    found = sheets.grouped(_facts(spark, sf_dir), "owner")
    joined = F.array_join(F.transform("rows", lambda r: r["text"]), "|")
    return found.select("owner", "field", F.size("rows").cast("long").alias("facts"), F.md5(joined.cast("binary")).alias("digest"), "first_chapter", "last_chapter")


@query(FACTS + """, n AS (SELECT owner, field, count(*) AS n, min(nullif(chapter, 0)) AS a, max(nullif(chapter, 0)) AS b FROM f GROUP BY owner, field)
SELECT owner, sum(n)::BIGINT AS facts, string_agg(field || ':' || n, ',' ORDER BY field) AS by_field, min(a) AS first_chapter, max(b) AS last_chapter FROM n GROUP BY owner""")
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each owner, in all and by field, and the chapters they span."""
    found = sheets.sheet_summary(_facts(spark, sf_dir), "owner")
    return found.withColumn("by_field", F.array_join(F.transform(F.map_entries("by_field"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@query(FACTS + """ SELECT owner, count(*) FILTER (chapter <= 10)::BIGINT AS visible_facts, count(*) FILTER (chapter > 10)::BIGINT AS withheld_facts,
  coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (chapter <= 10), '') AS fields, 10 AS as_of_chapter, '1.0' AS contract_version FROM f GROUP BY owner""")
def dossier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers as of chapter 10, with what is withheld."""
    return sheets.dossiers(_facts(spark, sf_dir), "owner", 10)


@query(FACTS + """, d AS (SELECT owner, CASE owner % 4 WHEN 0 THEN '' WHEN 1 THEN '2.1' ELSE '1.3' END AS version, CASE WHEN owner % 5 = 0 THEN ' ' ELSE 'user ' || owner END AS name, owner % 7 <> 0 AS has,
  coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (chapter <= 1), '') AS fields FROM f GROUP BY owner)
SELECT owner, concat_ws('; ', CASE WHEN version = '' THEN 'no contract version' WHEN split_part(version, '.', 1) <> '1' THEN 'unreadable contract version ' || version END,
  CASE WHEN owner % 6 = 2 THEN 'kind is card' END, CASE WHEN trim(name) = '' THEN 'no name' END, CASE WHEN NOT has THEN 'no as-of chapter' END, CASE WHEN fields = '' THEN 'no fields' END) AS problems FROM d""")
def handoff_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of dossiers with holes."""
    rows = sheets.dossiers(_facts(spark, sf_dir), "owner", 1)
    o = F.col("owner")
    version = F.when(o % 4 == 0, "").when(o % 4 == 1, "2.1").otherwise("1.3")
    name = F.when(o % 5 == 0, " ").otherwise(F.concat(F.lit("user "), o.cast("string")))
    kind = F.when(o % 6 == 2, "card").when(o % 6 == 3, sheets.KIND)
    return rows.select("owner", sheets.problems(version, name, o % 7 != 0, F.col("fields"), kind).alias("problems"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, CASE WHEN regexp_matches(trim(t), '[.!?]$') THEN trim(t) ELSE trim(t) || '.' END AS t FROM l WHERE trim(t) <> '' AND NOT regexp_matches(trim(t), {_sql(sheets.EXPRESSION)})),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k)
SELECT doc_id, md5(string_agg(t, ' ' ORDER BY n)) AS digest, count(*)::BIGINT AS facts FROM r WHERE n <= 12 GROUP BY doc_id""")
def looks_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as appearance facts: those without expressions, joined as sentences."""
    facts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("chapter", F.lit(1))
    made = sheets.looks(facts, "doc_id")
    few = facts.where((F.trim("text") != "") & ~F.rlike(F.trim("text"), F.lit(sheets.EXPRESSION))).groupBy("doc_id").agg(F.least(F.count("*"), F.lit(12)).alias("facts"))
    return made.join(few, "doc_id").select("doc_id", F.md5(F.col("looks").cast("binary")).alias("digest"), "facts")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'expressions' END AS pose_preset, CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN '8' ELSE '1' END AS expressions, c_custkey % 4 < 2 AS train, 'neutral' AS fallback_expression FROM customer""")
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tier earns; unknown tiers count as filler."""
    k = F.col("c_custkey") % 4
    tier = F.when(k == 0, "primary").when(k == 1, "secondary").when(k == 2, "filler").otherwise("extra")
    return table(spark, sf_dir, "customer").select("c_custkey", *((F.coalesce(c.cast("string"), F.lit("all")) if n == "expressions" else c).alias(n) for n, c in sheets.plan(tier).items()))


@query(r"""SELECT p_partkey, substr('role:' || lower(trim(p_brand)) || ':' || array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) > 3)), ' '), 1, 300) AS fact_key FROM part""")
def fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of facts whatever the order of their words."""
    return table(spark, sf_dir, "part").select("p_partkey", text.fact_key(F.lit("role"), F.concat_ws(" ", "p_name", "p_type"), F.col("p_brand")).alias("fact_key"))
