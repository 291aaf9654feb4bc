"""Merges of people in order, by confirmed pairs and by hand, over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import absorbing
from quire.plans.registry import query, table

# Every customer is to go into those of half and of a third of its number, in scrambled order.
MERGES = """
pairs AS (SELECT c_custkey AS gone, greatest(1, c_custkey // (2 + j)) AS into_, (c_custkey * 7919 + j * 104729) % 1000003 * 2 + j AS ord FROM customer, (SELECT unnest([0, 1]) AS j)),
steps AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM pairs WHERE gone <> into_),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS dead, NULL::BIGINT AS gone, NULL::BIGINT AS into_, NULL::BIGINT AS ord
  UNION ALL
  SELECT s.i, CASE WHEN list_contains(dead, s.gone) OR list_contains(dead, s.into_) THEN dead ELSE list_append(dead, s.gone) END,
    CASE WHEN list_contains(dead, s.gone) OR list_contains(dead, s.into_) THEN NULL ELSE s.gone END, s.into_, s.ord FROM walk w JOIN steps s ON s.i = w.i + 1),
took AS (SELECT gone, into_, ord FROM walk WHERE gone IS NOT NULL),
tree AS (
  SELECT c_custkey AS id, c_custkey AS root, []::BIGINT[] AS path FROM customer
  UNION ALL SELECT t.id, k.into_, list_prepend(k.ord, t.path) FROM tree t JOIN took k ON t.root = k.gone),
placed AS (SELECT id, arg_max(root, len(path)) AS root, arg_max(path, len(path)) AS path FROM tree GROUP BY id)"""


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, j = F.col("c_custkey"), F.col("j")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return rows.select(((c * 7919 + j * 104729) % 1000003 * 2 + j).alias("ord"), c.alias("gone"), F.greatest(F.lit(1), F.floor(c / (2 + j))).alias("into"))


@query(f"""WITH RECURSIVE {MERGES},
n AS (SELECT c_custkey AS id, c_name AS name, [lower(c_name), c_mktsegment] AS aliases FROM customer),
f AS (SELECT DISTINCT p.root, unnest(list_prepend(name, aliases)) AS form FROM placed p JOIN n ON n.id = p.id WHERE len(path) > 0),
u AS (SELECT root, list(form) AS more FROM f GROUP BY root)
SELECT n.id, n.name, array_to_string(CASE WHEN more IS NULL THEN aliases ELSE list_filter(list_sort(list_distinct(list_concat(aliases, more))), lambda a: a <> n.name) END, '|') AS aliases
FROM n JOIN placed p ON n.id = p.id AND len(path) = 0 LEFT JOIN u ON u.root = n.id""")
def reconcile_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People after confirmed pairs: who was absorbed blocks later pairs, chains end at the last one."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lower("c_name"), F.col("c_mktsegment")).alias("aliases"))
    return absorbing.reconciled(people, _merges(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""WITH RECURSIVE {MERGES},
n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Subject ' || c_name WHEN c_custkey % 3 = 0 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS name, [c_mktsegment || c_custkey // 4, 'p' || c_custkey] AS aliases,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'n' || c_custkey END AS note, c_custkey % 4 = 0 AS locked, c_custkey % 50 AS mentions, c_custkey % 5 AS speech, list_sort(list_distinct([c_custkey % 40 + 1, c_custkey % 17 + 1])) AS chapters FROM customer),
m AS (SELECT n.*, p.root, p.path, string_split(name, ' ') AS t FROM n JOIN placed p ON n.id = p.id),
r AS (SELECT root, count(*) AS k, sum(mentions)::BIGINT AS mentions, sum(speech)::BIGINT AS speech, list_sort(list_distinct(flatten(list(chapters)))) AS chapters, bool_or(locked) FILTER (len(path) = 0) AS locked,
  coalesce(min(nullif(note, '')) FILTER (note <> '' AND path = lowest), '') AS note FROM (SELECT *, min(path) FILTER (note <> '') OVER (PARTITION BY root) AS lowest FROM m) GROUP BY root),
d AS (SELECT root, arg_max(CASE WHEN t[1] = 'Subject' THEN array_to_string(t[2:], ' ') ELSE name END, (t[1] <> 'Subject', CASE WHEN t[1] = 'Subject' THEN len(t) - 1 ELSE len(t) END, length(CASE WHEN t[1] = 'Subject' THEN array_to_string(t[2:], ' ') ELSE name END), -place)) AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM m) GROUP BY root),
e AS (SELECT root, form, row_number() OVER (PARTITION BY root ORDER BY path, i) AS seat FROM (SELECT root, path, unnest(CASE WHEN len(path) = 0 THEN list_append(aliases, name) ELSE list_prepend(name, aliases) END) AS form,
  unnest([1, 2, 3]) AS i FROM m)),
a AS (SELECT e.root, arg_min(form, seat) AS form, min(seat) AS seat FROM e JOIN d ON d.root = e.root WHERE lower(form) <> lower(d.name) GROUP BY e.root, lower(form)),
l AS (SELECT root, string_agg(form, '|' ORDER BY seat) AS aliases FROM a GROUP BY root),
x AS (SELECT r.*, len(chapters) / 40.0 AS spread FROM r)
SELECT x.root AS id, CASE WHEN k = 1 THEN n.name ELSE d.name END AS name, CASE WHEN k = 1 THEN array_to_string(n.aliases, '|') ELSE coalesce(l.aliases, '') END AS aliases, x.note,
  CASE WHEN k = 1 OR x.locked THEN 'stored' WHEN spread >= 0.25 AND x.speech >= 3 THEN 'primary' WHEN x.speech >= 15 THEN 'primary' WHEN x.speech >= 3 THEN 'secondary' WHEN spread >= 0.15 AND x.mentions >= 15 THEN 'secondary' ELSE 'filler' END AS tier,
  x.mentions, x.speech, len(x.chapters)::BIGINT AS sections, x.chapters[1]::BIGINT AS first_section, x.chapters[-1]::BIGINT AS last_section, k > 1 AS edited
FROM x JOIN n ON n.id = x.root JOIN d ON d.root = x.root LEFT JOIN l ON l.root = x.root""")
def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People after merges by hand with all they carry: names, aliases, notes, chapters, tiers, locks."""
    c = F.col("c_custkey")
    chapters = F.array_sort(F.array_distinct(F.array(c % 40 + 1, c % 17 + 1)))
    people = table(spark, sf_dir, "customer").select(
        c.alias("id"), F.when(c % 5 == 0, F.concat(F.lit("Subject "), "c_name")).when(c % 3 == 0, F.concat_ws(" ", "c_name", "c_mktsegment")).otherwise(F.col("c_name")).alias("name"),
        F.array(F.concat("c_mktsegment", F.floor(c / 4)), F.concat(F.lit("p"), c)).alias("aliases"), F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("n"), c)).alias("note"), F.lit("stored").alias("tier"), F.lit("").alias("reason"),
        (c % 4 == 0).alias("locked"), F.lit(False).alias("edited"), (c % 50).alias("mentions"), (c % 5).alias("speech"), F.size(chapters).cast("long").alias("sections"), chapters.alias("chapters"),
        F.array_min(chapters).alias("first_section"), F.array_max(chapters).alias("last_section"),
    )
    found = absorbing.merged_people(people, _merges(spark, sf_dir), 40)
    return found.select("id", "name", F.array_join("aliases", "|").alias("aliases"), "note", "tier", "mentions", "speech", "sections", "first_section", "last_section", "edited")
