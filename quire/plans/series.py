"""Rows of several books united, merged and compiled, over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import books
from quire.plans.curating import _first_longest, _slug, _unions
from quire.plans.registry import query, table

# Books 2, 0 and 1 in this order: parts are entities, orders quests, nations rules, customers people.
STATUS = "CASE {k} % 7 WHEN 0 THEN 'discarded' WHEN 1 THEN 'kept' ELSE 'proposed' END"
SETS = f"""
books AS (SELECT unnest([2, 0, 1]) AS book, unnest([0, 1, 2]) AS place),
e0 AS (SELECT p_size % 3 AS book, p_partkey AS id, CASE WHEN p_size > 25 THEN 'location' ELSE 'term' END AS kind, p_brand AS name, [p_type] AS aliases, p_name AS summary, [{{'chunk': p_partkey // 4, 'chapter': p_size % 5}}] AS citations, {STATUS.format(k="p_partkey")} AS status FROM part),
q0 AS (SELECT o_custkey % 3 AS book, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'main' ELSE 'unknown' END AS kind, 'Quest ' || o_custkey // 10 AS name, [o_orderpriority] AS aliases, o_orderpriority AS objective, CASE WHEN o_orderkey % 2 = 0 THEN 'gold ' || o_orderkey % 9 ELSE '' END AS reward,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'unknown' ELSE 'ongoing' END AS outcome, o_orderkey % 40 + 1 AS first_chapter, [{{'chunk': o_orderkey // 50, 'chapter': o_orderkey % 40}}] AS citations, {STATUS.format(k="o_orderkey")} AS status FROM orders),
r0 AS (SELECT n_regionkey % 3 AS book, n_nationkey AS id, 'skill' AS kind, left(n_name, 1) || 'law' AS name, [n_name] AS aliases, n_name || ' rules' AS statement, CASE WHEN n_nationkey % 2 = 0 THEN 'stated' ELSE 'implied' END AS confidence, CASE WHEN n_nationkey % 3 = 0 THEN 'x + ' || n_nationkey ELSE '' END AS formula,
  [{{'chunk': n_nationkey, 'chapter': n_regionkey}}] AS citations, {STATUS.format(k="n_nationkey")} AS status FROM nation),
c0 AS (SELECT c_nationkey % 3 AS book, c_custkey AS id, c_mktsegment || ' ' || c_nationkey AS name, [c_name] AS aliases, CASE WHEN c_acctbal > 9000 THEN 'primary' WHEN c_acctbal > 5000 THEN 'secondary' ELSE 'filler' END AS tier, CASE WHEN c_nationkey % 4 = 0 THEN ' ' ELSE c_name END AS note, c_custkey % 11 AS mentions, c_custkey % 3 AS speech,
  []::STRUCT(chunk BIGINT, chapter BIGINT)[] AS citations, {STATUS.format(k="c_custkey")} AS status FROM customer),
e AS (SELECT e0.*, kind || ':' || {_slug("name")} AS key, row_number() OVER (ORDER BY place, kind, lower(name), id) - 1 AS ord FROM e0 JOIN books USING (book) WHERE status <> 'discarded'),
q AS (SELECT q0.*, {_slug("name")} AS key, row_number() OVER (ORDER BY place, first_chapter, lower(name), id) - 1 AS ord FROM q0 JOIN books USING (book) WHERE status <> 'discarded'),
r AS (SELECT r0.*, kind || ':' || {_slug("name")} AS key, row_number() OVER (ORDER BY place, kind, lower(name), id) - 1 AS ord FROM r0 JOIN books USING (book) WHERE status <> 'discarded'),
c AS (SELECT c0.*, {_slug("name")} AS key, row_number() OVER (ORDER BY place, list_position(['primary', 'secondary', 'filler'], tier), -speech, -mentions, id) - 1 AS ord FROM c0 JOIN books USING (book) WHERE status <> 'discarded' AND tier <> 'filler')"""


def _sets(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    part, orders, nation, customer = (table(spark, sf_dir, t) for t in ("part", "orders", "nation", "customer"))
    places = spark.createDataFrame([(2, 0), (0, 1), (1, 2)], "book int, place int")
    p, o, n, c = F.col("p_partkey"), F.col("o_orderkey"), F.col("n_nationkey").cast("long"), F.col("c_custkey")
    status = lambda k: F.when(k % 7 == 0, "discarded").when(k % 7 == 1, "kept").otherwise("proposed").alias("status")
    cite = lambda a, b: F.array(F.struct(a.cast("long").alias("chunk"), b.cast("long").alias("chapter"))).alias("citations")
    empty, name = F.lit(""), F.lower("name")

    def keyed(rows: DataFrame, *order: Column, kinds: bool) -> DataFrame:
        key = text.slug(F.col("name"))
        return books.united(rows.withColumn("key", F.concat("kind", F.lit(":"), key) if kinds else key), places, list(order), only=only)

    entities = part.select(
        (F.col("p_size") % 3).alias("book"), p.alias("id"), F.when(F.col("p_size") > 25, "location").otherwise("term").alias("kind"), F.col("p_brand").alias("name"), F.array("p_type").alias("aliases"),
        F.col("p_name").alias("summary"), cite(F.floor(p / 4), F.col("p_size") % 5), status(p),
    )
    quests = orders.select(
        (F.col("o_custkey") % 3).cast("int").alias("book"), o.alias("id"), F.when(o % 4 == 0, "main").otherwise("unknown").alias("kind"), F.concat(F.lit("Quest "), F.floor(F.col("o_custkey") / 10)).alias("name"), F.array("o_orderpriority").alias("aliases"),
        F.col("o_orderpriority").alias("objective"), F.when(o % 2 == 0, F.concat(F.lit("gold "), o % 9)).otherwise("").alias("reward"), *(empty.alias(f) for f in ("giver", "requirements", "penalty", "deadline")),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "unknown").otherwise("ongoing").alias("outcome"), (o % 40 + 1).alias("first_chapter"), cite(F.floor(o / 50), o % 40), status(o),
    )
    rules = nation.select(
        (F.col("n_regionkey") % 3).cast("int").alias("book"), n.alias("id"), F.lit("skill").alias("kind"), F.concat(F.substring("n_name", 1, 1), F.lit("law")).alias("name"), F.array("n_name").alias("aliases"), F.concat("n_name", F.lit(" rules")).alias("statement"),
        F.when(n % 2 == 0, "stated").otherwise("implied").alias("confidence"), F.when(n % 3 == 0, F.concat(F.lit("x + "), n)).otherwise("").alias("formula"), empty.alias("evidence"), F.lit("system").alias("scope"), empty.alias("applies_to"),
        cite(n, F.col("n_regionkey")), status(n),
    )
    people = customer.select(
        (F.col("c_nationkey") % 3).cast("int").alias("book"), c.alias("id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("name"), F.array("c_name").alias("aliases"),
        F.when(F.col("c_acctbal") > 9000, "primary").when(F.col("c_acctbal") > 5000, "secondary").otherwise("filler").alias("tier"), empty.alias("reason"), F.when(F.col("c_nationkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("note"),
        (c % 11).alias("mentions"), (c % 3).alias("speech"), F.lit(1).alias("sections"), F.lit(1).alias("first_section"), F.lit(1).alias("last_section"), status(c),
    )
    rank = F.when(F.col("tier") == "primary", 1).otherwise(2)
    return (
        keyed(entities, F.col("kind"), name, kinds=True), keyed(quests, F.col("first_chapter"), name, kinds=False),
        keyed(rules, F.col("kind"), name, kinds=True), keyed(people.where("tier <> 'filler'"), rank, -F.col("speech"), -F.col("mentions"), kinds=False),
    )


@query("WITH " + SETS.removeprefix("\n") + """
SELECT 'entity' AS section, ord, book, id, key FROM e UNION ALL SELECT 'quest', ord, book, id, key FROM q UNION ALL SELECT 'rule', ord, book, id, key FROM r UNION ALL SELECT 'character', ord, book, id, key FROM c""")
def multi_book_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted rows of all four kinds from several books, in the order of the books and their lists."""
    out = None
    for section, rows in zip(("entity", "quest", "rule", "character"), _sets(spark, sf_dir, ["book", "id", "key"]), strict=True):
        part = rows.select(F.lit(section).alias("section"), "ord", "book", "id", "key")
        out = part if out is None else out.unionByName(part)
    return out


def _prefixed(rows: str) -> str:
    out = _unions(rows)
    for name in ("named", "spelled", "listed", "once", "cited", "united"):
        out = out.replace(f"{name} AS (SELECT", f"{rows}_{name} AS (SELECT").replace(f"JOIN {name} ", f"JOIN {rows}_{name} ").replace(f"FROM {name} ", f"FROM {rows}_{name} ")
    return out


KEYS = "list_filter(ks, lambda x, i: x <> '' AND list_position(list_transform(ks, lambda y: lower(y)), lower(x)) = i)"
CLEAN = r"lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[,;]+|[,;]+$', '', 'g')"


@query("WITH " + SETS.removeprefix("\n") + f""", {_prefixed("e")}, {_prefixed("q")}, {_prefixed("r")}, {_prefixed("c")},
rule_best AS (SELECT key, arg_min(statement, ord) AS statement, arg_min(confidence, ord) AS confidence FROM (SELECT *, max(length(statement)) FILTER (confidence = sure) OVER (PARTITION BY key) AS most FROM (SELECT *, max(confidence) OVER (PARTITION BY key) AS sure FROM r)) WHERE confidence = sure AND length(statement) = most GROUP BY key),
lists AS (
  SELECT 1 AS s, -len(string_split(citations, ','))::BIGINT AS o1, list_position(['location', 'faction', 'system', 'artefact', 'history', 'term'], kind)::BIGINT AS o2, lower(name) AS o3, e_united.key, kind, name, aliases, summary AS content, '' AS note
    FROM e_united JOIN (SELECT key, any_value(kind) AS kind FROM e GROUP BY key) k USING (key) JOIN {_first_longest("summary", "e")} l USING (key)
  UNION ALL SELECT 2, first_chapter, 0, lower(name), q_united.key, 'quest', name, aliases, concat_ws(chr(10), nullif(objective, ''), CASE WHEN trim(reward) <> '' THEN 'Reward: ' || trim(reward) END, CASE WHEN outcome <> 'unknown' THEN 'Outcome: ' || outcome END), kind
    FROM q_united JOIN {_first_longest("objective", "q")} a USING (key) JOIN {_first_longest("reward", "q")} b USING (key) JOIN (SELECT key, min(first_chapter) AS first_chapter, arg_max(outcome, list_position(['unknown', 'accepted', 'ongoing', 'declined', 'failed', 'completed'], outcome)) AS outcome, coalesce(arg_min(kind, ord) FILTER (kind <> 'unknown'), 'unknown') AS kind FROM q GROUP BY key) d USING (key)
  UNION ALL SELECT 3, -len(string_split(citations, ',')), 5, lower(name), u.key, 'system', name, aliases || CASE WHEN regexp_matches(name, '[a-z][A-Z]') THEN '|' || regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g') ELSE '' END,
      concat_ws(chr(10), statement, CASE WHEN formula <> '' THEN 'Formula: ' || formula END), 'skill, ' || confidence
    FROM r_united u JOIN rule_best USING (key) JOIN rule_formula USING (key)
  UNION ALL SELECT 4, list_position(['primary', 'secondary', 'filler'], tier), -speech, lower(name), c_united.key, 'character', name, aliases, trim(note), tier
    FROM c_united JOIN {_first_longest("note", "c")} l USING (key) JOIN (SELECT key, max(tier) FILTER (tier = 'secondary') AS second, CASE WHEN bool_or(tier = 'primary') THEN 'primary' ELSE 'secondary' END AS tier, sum(speech)::BIGINT AS speech FROM c GROUP BY key) d USING (key)),
k AS (SELECT *, list_transform(list_prepend(name, CASE WHEN aliases = '' THEN []::VARCHAR[] ELSE string_split(aliases, '|') END), {CLEAN}) AS ks FROM lists),
n AS (SELECT *, {KEYS} AS keys, row_number() OVER (ORDER BY s, o1, o2, o3, key) - 1 AS uid FROM k WHERE s <> 4 OR content <> '')
SELECT uid, to_json({{'uid': uid, 'key': keys, 'keysecondary': []::VARCHAR[], 'comment': kind || ': ' || name || CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END, 'content': left(trim(content), 1200), 'constant': false, 'selective': true,
  'order': CASE kind WHEN 'system' THEN 100 WHEN 'character' THEN 98 WHEN 'quest' THEN 95 WHEN 'location' THEN 80 ELSE 50 END, 'position': 0, 'disable': false, 'displayIndex': uid, 'addMemo': true, 'group': '', 'groupOverride': false, 'groupWeight': 100,
  'sticky': 0, 'cooldown': 0, 'delay': 0, 'probability': 100, 'depth': 4, 'useProbability': true, 'role': 0, 'vectorized': false, 'excludeRecursion': false, 'preventRecursion': false, 'delayUntilRecursion': false, 'scanDepth': NULL, 'caseSensitive': NULL,
  'matchWholeWords': NULL, 'useGroupScoring': NULL, 'automationId': ''}})::VARCHAR AS entry FROM n""".replace("lists AS (", """taken_ AS (SELECT key, ord, formula, confidence, length(statement) AS len, max(CASE WHEN confidence = 'stated' THEN 1 ELSE 0 END) OVER before AS had_stated, max(length(statement)) FILTER (confidence = 'stated') OVER before AS stated_most, max(length(statement)) OVER before AS any_most, count(*) OVER before AS prior
  FROM r WINDOW before AS (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rule_formula AS (SELECT key, coalesce(arg_max(formula, ord) FILTER (formula <> '' AND (prior = 0 OR CASE WHEN confidence = 'stated' THEN coalesce(had_stated, 0) = 0 OR len > stated_most ELSE coalesce(had_stated, 0) = 0 AND len > any_most END)), '') AS formula FROM taken_ GROUP BY key),
lists AS ("""))
def series_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries of a series: rows of all books merged by key, every field there."""
    return books.entry_json(books.compiled_series(*_sets(spark, sf_dir))[0])
