"""Names, evidence, tiers and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import names
from quire.operators import harvest as harvesting
from quire.operators import passages as passing
from quire.plans.registry import query, table
from quire.plans.retrieval import MASK, WINDOWS


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


STOP = "[" + ", ".join(f"'{w}'" for w in names.STOP) + "]"


def _normal(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({c}), {_sql(names.TITLE)}, ''), {_sql(chr(91) + chr(39) + '’]s' + chr(92) + 'b')}, '', 'g')"
    bare = f"regexp_replace(regexp_replace({bare}, '\\s+', ' ', 'g'), {_sql('^[ ' + chr(39) + '’' + chr(92) + '-]+|[ ' + chr(39) + '’' + chr(92) + '-]+$')}, '', 'g')"
    return bare


# name parts w, and the place of the first that is no stop word
HARVEST = rf"""
WITH m AS (SELECT source, doc_id, {MASK} AS t FROM documents),
raw AS (SELECT source, doc_id, 0 AS spoke, unnest(regexp_extract_all(t, {_sql(rf"\b({names.NAME})\b")}, 1)) AS name FROM m
  UNION ALL SELECT source, doc_id, 1, unnest(regexp_extract_all(t, {_sql(names.SPEECH[0])}, 1)) FROM m
  UNION ALL SELECT source, doc_id, 1, unnest(regexp_extract_all(t, {_sql(names.SPEECH[1])}, 1)) FROM m),
cleaned AS (SELECT source, doc_id, spoke, string_split({_normal("name")}, ' ') AS w FROM raw),
placed AS (SELECT *, coalesce(list_position(list_transform(w, lambda x: NOT list_contains({STOP}, lower(x))), true), 0) AS i FROM cleaned),
named AS (SELECT source, doc_id, spoke, array_to_string(w[CASE WHEN i = 0 THEN len(w) ELSE i END:], ' ') AS name, i FROM placed),
kept AS (SELECT source, name, count(*) AS mentions, count(DISTINCT doc_id) AS sections, min(doc_id) AS first_section, max(doc_id) AS last_section
  FROM named WHERE spoke = 0 AND length(name) >= 2 AND i > 0 AND NOT regexp_matches(name, {_sql(names.CONTRACTION)}) GROUP BY source, name),
said AS (SELECT source, name, count(*) AS speech FROM named WHERE spoke = 1 GROUP BY source, name),
harvest AS (SELECT k.*, coalesce(s.speech, 0)::BIGINT AS speech FROM kept k LEFT JOIN said s ON k.source = s.source AND k.name = s.name
  WHERE mentions >= 3 OR coalesce(s.speech, 0) > 0)
"""


def _harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvesting.harvest(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))


@query(HARVEST + "SELECT source, name, mentions, sections, first_section, last_section, speech FROM harvest")
def name_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each book with their evidence."""
    return _harvest(spark, sf_dir)


@query(HARVEST + """SELECT source, string_split(name, ' ')[1] AS person, count(*)::BIGINT AS forms, sum(mentions)::BIGINT AS mentions, sum(speech)::BIGINT AS speech,
  min(first_section) AS first_section, max(last_section) AS last_section FROM harvest GROUP BY ALL""")
def evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of people over all their forms; here forms share their first word."""
    found = _harvest(spark, sf_dir)
    people = found.select("source", F.split("name", " ")[0].alias("person"), F.col("name").alias("form"))
    return harvesting.evidence(found, people)


TIERS = HARVEST + """, totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
tiers AS (SELECT h.source, name, mentions, sections, speech, CASE WHEN sections / total >= 0.25 AND speech >= 3 THEN 'primary' WHEN speech >= 15 THEN 'primary'
    WHEN speech >= 3 THEN 'secondary' WHEN sections / total >= 0.15 AND mentions >= 15 THEN 'secondary' ELSE 'filler' END AS tier,
  'in ' || round_even(sections / total * 100, 0)::BIGINT || '% of sections, ' || speech || ' spoken, ' || mentions || ' mentions' AS reason
  FROM harvest h JOIN totals t ON h.source = t.source)
"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    totals = docs.groupBy("source").agg(F.count("*").alias("total_sections"))
    return harvesting.tiered(_harvest(spark, sf_dir), totals)


@query(TIERS + "SELECT source, name, tier, reason FROM tiers")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of each name, with the figures it rests on."""
    return _tiers(spark, sf_dir).select("source", "name", "tier", "reason")


@query(TIERS + """SELECT source, count(*)::BIGINT AS total, count(*) FILTER (tier = 'primary')::BIGINT AS n_primary, count(*) FILTER (tier = 'secondary')::BIGINT AS n_secondary,
  count(*) FILTER (tier = 'filler')::BIGINT AS n_filler, count(*) FILTER (speech > 0)::BIGINT AS speakers FROM tiers GROUP BY source""")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each tier and speakers by book."""
    count = lambda t: F.count_if(F.col("tier") == t).alias(f"n_{t}")
    return _tiers(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), count("primary"), count("secondary"), count("filler"), F.count_if(F.col("speech") > 0).alias("speakers"))


@query(HARVEST + """SELECT a.source, a.name AS shorter, b.name AS longer FROM harvest a JOIN harvest b ON a.source = b.source AND a.name <> b.name
  AND contains(' ' || b.name || ' ', ' ' || a.name || ' ')""")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of which one holds the other as whole words."""
    return harvesting.containment(_harvest(spark, sf_dir))


@query(HARVEST + """, pool AS (SELECT source, string_split(name, ' ')[1] AS person, name FROM harvest)
SELECT source, person, arg_max(name, (len(string_split(name, ' ')) * 1000 + length(name)) * 1000000 - rank) AS display FROM (
  SELECT *, row_number() OVER (PARTITION BY source, person ORDER BY name) AS rank FROM pool
  WHERE NOT list_contains(['""" + "', '".join(names.LABELS) + """'], lower(person))) GROUP BY source, person""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form under which a person is shown: most words, then most letters."""
    forms = _harvest(spark, sf_dir).groupBy("source", F.split("name", " ")[0].alias("person")).agg(F.array_sort(F.collect_set("name")).alias("forms"))
    return forms.where(~F.lower("person").isin(*names.LABELS)).select("source", "person", names.display(F.col("forms")).alias("display"))


# Forms: single capitalised words of the conversations, with five or more hits.
FORMS = rf"""
WITH c AS (SELECT conv_id, turn, text AS raw, {MASK} AS t FROM conversations),
forms AS (SELECT form FROM (SELECT unnest(regexp_extract_all(t, '\b([A-Z][a-z]+)\b', 1)) AS form FROM c) GROUP BY form HAVING count(*) >= 5),
hits AS (SELECT conv_id, turn, form, raw, t, string_split_regex(t, '\b' || form || '\b') AS pieces FROM c JOIN forms ON contains(t, form) WHERE regexp_matches(t, '\b' || form || '\b'))
"""


def _forms(talk: DataFrame) -> DataFrame:
    found = talk.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1))).alias("form"))
    return found.groupBy("form").count().where("count >= 5").select("form")


@query(FORMS + r""", places AS (SELECT conv_id, turn, form, raw, unnest(list_transform(range(1, len(pieces)),
    lambda k: list_sum(list_transform(pieces[1:k], lambda p: length(p))) + (k - 1) * length(form)))::BIGINT AS pos FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY conv_id, turn, pos) AS rank FROM places)
SELECT form, rank::INT AS rank, conv_id, turn, pos::INT AS pos,
  trim(regexp_replace(substr(raw, (greatest(0, pos - 110) + 1)::BIGINT, 220), '\s+', ' ', 'g')) AS snippet FROM ranked WHERE rank <= 3""")
def mention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 windows of text around each known form."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = harvesting.mentions(talk, _forms(talk), ["conv_id", "turn"])
    return harvesting.mention_windows(found, ["conv_id", "turn"], 3, 220).withColumnRenamed("at", "pos")


@query(WINDOWS + rf""", m AS (SELECT source, doc_id, number, text AS raw, {MASK} AS t FROM cut),
forms AS (SELECT source, form FROM (SELECT source, unnest(regexp_extract_all(t, '\b([A-Z][a-z]+)\b', 1)) AS form FROM m) GROUP BY source, form
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, form) <= 5),
tiers AS (SELECT source, form, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, form) <= 2 THEN 'primary' ELSE 'secondary' END AS tier FROM (SELECT source, unnest(regexp_extract_all(t, '\b([A-Z][a-z]+)\b', 1)) AS form FROM m) GROUP BY source, form),
hits AS (SELECT m.source, form, doc_id, number, length(raw) AS n, len(regexp_extract_all(t, '\b' || form || '\b')) AS hits FROM m JOIN forms ON m.source = forms.source AND contains(t, form)),
ranked AS (SELECT *, round(hits * 1000.0 / n, 4) AS density, row_number() OVER (PARTITION BY source, form ORDER BY round(hits * 1000.0 / n, 4) DESC, hits DESC, doc_id, number) AS rank FROM hits WHERE hits > 0)
SELECT source, form, tier, rank::INT AS rank, (row_number() OVER (PARTITION BY source, form ORDER BY doc_id, number))::INT AS place, doc_id, number, hits::INT AS hits, density::DOUBLE AS density FROM ranked JOIN tiers USING (source, form) WHERE rank <= CASE tier WHEN 'primary' THEN 10 ELSE 4 END""")
def density_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages densest in a book's 5 most frequent forms, 10 for the first two, 4 for the others, in reading order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = passing.passages(docs).join(docs.select("doc_id", "source"), "doc_id")
    # forms are single words, so one count of the capitalised words of each passage serves for both steps
    word = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)(?<!\w)([A-Z][a-z]+)(?!\w)"), F.lit(1)))
    hits = found.select("source", "doc_id", "number", F.char_length("text").alias("n"), word.alias("form")).groupBy("source", "doc_id", "number", "n", "form").agg(F.count("*").cast("int").alias("hits"))
    counted = hits.groupBy("source", "form").agg(F.sum("hits").alias("count"))
    top = counted.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("count"), "form"))).where("i <= 5")
    tiers = top.select("source", "form", F.when(F.col("i") <= 2, "primary").otherwise("secondary").alias("tier"))
    chosen = harvesting.chosen_passages(hits.join(tiers, ["source", "form"]), ["source", "form"], ["doc_id", "number"])
    return chosen.select("source", "form", "tier", "rank", "place", "doc_id", "number", "hits", "density")
