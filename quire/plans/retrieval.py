"""Sections, passages, citations, search and signals over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import signals, text
from quire.operators import passages as passing
from quire.operators.numbering import numbered, running_before
from quire.operators.search import cosine, top_of_questions, top_passages
from quire.plans.registry import query, table

COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""
SELECT vec_id, label, round({COSINE}, 4) AS score,
  'ch. ' || label || ' · passage ' || vec_id AS citation, (SELECT count(*) FROM embeddings)::BIGINT AS searched
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {COSINE} DESC, vec_id LIMIT 6""".replace("vec_id, label, round", "a.vec_id, a.label, round"))
def cited_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 6 passages nearest to a question vector, cited."""
    vectors = table(spark, sf_dir, "embeddings")
    question = vectors.where("vec_id = 0").first()["embedding"]
    found = top_passages(vectors, question, 6, "embedding", "vec_id")
    cited = F.concat_ws(" · ", F.concat(F.lit("ch. "), F.col("label")), F.concat(F.lit("passage "), F.col("vec_id")))
    return found.select("vec_id", "label", F.round("score", 4).alias("score"), cited.alias("citation"), F.lit(vectors.count()).cast("long").alias("searched"))


@query(f"""
WITH p AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents),
s AS (SELECT q.vec_id AS question, a.vec_id, {COSINE} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT question, rank::INT AS rank, vec_id, round(score, 4) AS score, 'ch. ' || position || ' · “' || source || '” · chars 0–' || n AS citation FROM r LEFT JOIN p ON p.doc_id = r.vec_id WHERE rank <= 6""")
def cited_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 6 nearest rows to every question (ids divisible by 20), with the citation of their section."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    found = top_of_questions(vectors, asked, 6).withColumnRenamed("position", "vec_id")
    places = numbered(docs.select("doc_id", "source", F.char_length("text").alias("n")), "source", "doc_id")
    cited = found.join(places, F.col("vec_id") == F.col("doc_id"), "left")
    line = F.when(F.col("doc_id").isNotNull(), text.citation(F.col("position"), F.col("source"), F.lit(""), F.lit(0), F.col("n")))
    return cited.select("question", "rank", "vec_id", F.round("score", 4).alias("score"), line.alias("citation"))


@query(f"""
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
s AS (SELECT a.label, a.vec_id, {COSINE} AS score FROM embeddings a JOIN q ON a.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, rank::INT AS rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 3""")
def topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest passages to the first passage of each chapter."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("asked"))
    scored = vectors.join(asked, "label").select("label", "vec_id", cosine(F.col("embedding"), F.col("asked")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where("rank <= 3").select("label", "rank", "vec_id", F.round("score", 4).alias("score"))


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS position FROM documents""")
def section_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of sections in their book."""
    return numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\w)-\n(\w)', '\1\2', 'g'), '\n\n+', chr(1), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n', ' ', 'g'), '[ \t][ \t]+', ' ', 'g') AS t FROM b)
SELECT doc_id, md5(regexp_replace(replace(t, chr(1), chr(10) || chr(10)), '^\s+|\s+$', '', 'g')) AS digest FROM c""")
def section_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned section texts, as digests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cleaned(F.col("text")).cast("binary")).alias("digest"))


@query(r"""
WITH w AS (SELECT source, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT source, count(*)::BIGINT AS sections, sum(n)::BIGINT AS words, min(n)::BIGINT AS least_words, max(n)::BIGINT AS most_words,
  count(*) FILTER (n < 120)::BIGINT AS short_sections FROM w GROUP BY source""")
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and words of each book."""
    counted = table(spark, sf_dir, "documents").select("source", text.words(F.col("text")).alias("n"))
    return counted.groupBy("source").agg(
        F.count("*").alias("sections"), F.sum("n").alias("words"), F.min("n").alias("least_words"), F.max("n").alias("most_words"), F.count_if(F.col("n") < 120).alias("short_sections")
    )


# The last place of a mark in a window w that starts at offset f, or -1.
def _last(mark: str) -> str:
    return f"CASE WHEN strpos(reverse(w), reverse({mark})) = 0 THEN -1 ELSE f + length(w) - strpos(reverse(w), reverse({mark})) - length({mark}) + 1 END"


_MARKS = ["'. '", "'! '", "'? '", "'.' || chr(10)", "chr(10)"]
WINDOWS = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
d AS (SELECT doc_id, source, t, length(t) AS n FROM t WHERE t <> ''),
step(doc_id, source, k, a, b) AS (
  SELECT doc_id, source, 0, 0, 0 FROM d
  UNION ALL
  SELECT doc_id, source, k + 1, a2, CASE WHEN e < n AND cut > a2 THEN cut ELSE e END FROM (
    SELECT doc_id, source, k, a2, e, n,
      CASE WHEN p0 >= 0 THEN p0 WHEN greatest({", ".join(f"p{i + 1}" for i in range(5))}) >= 0 THEN greatest({", ".join(f"p{i + 1}" for i in range(5))}) + 1 ELSE p6 END AS cut
    FROM (SELECT doc_id, source, k, a2, e, n, {_last("chr(10) || chr(10)")} AS p0, {", ".join(f"{_last(m)} AS p{i + 1}" for i, m in enumerate(_MARKS))}, {_last("' '")} AS p6
      FROM (SELECT doc_id, source, k, a2, e, n, a2 + 1600 * 2 // 3 AS f, substr(t, (a2 + 1600 * 2 // 3 + 1)::BIGINT, (e - (a2 + 1600 * 2 // 3))::BIGINT) AS w
        FROM (SELECT s.doc_id, s.source, k, n, t, CASE WHEN k = 0 THEN 0 ELSE greatest(b - 200, a + 1) END AS a2,
            least(CASE WHEN k = 0 THEN 0 ELSE greatest(b - 200, a + 1) END + 1600, n) AS e
          FROM step s JOIN d ON s.doc_id = d.doc_id WHERE k = 0 OR b < n)))))
, cut AS (SELECT s.doc_id, s.source, (row_number() OVER (PARTITION BY s.doc_id ORDER BY k) - 1)::BIGINT AS number, a::BIGINT AS char_start, b::BIGINT AS char_end,
    regexp_replace(substr(t, a + 1, b - a), '^\s+|\s+$', '', 'g') AS text
  FROM step s JOIN d ON s.doc_id = d.doc_id WHERE k > 0 AND regexp_replace(substr(t, a + 1, b - a), '^\s+|\s+$', '', 'g') <> '')
"""


@query(WINDOWS + "SELECT doc_id, number, char_start, char_end, length(text)::BIGINT AS chars, md5(text) AS digest FROM cut")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping passages of all sections with offsets."""
    found = passing.passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "number", "char_start", "char_end", F.char_length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(WINDOWS + "SELECT source, doc_id, number, (row_number() OVER (PARTITION BY source ORDER BY doc_id, number) - 1)::BIGINT AS position FROM cut")
def passage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book-wide positions of passages, from 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = passing.passages(docs).select("doc_id", "number")
    per_doc = found.groupBy("doc_id").count().join(docs.select("doc_id", "source"), "doc_id")
    before = running_before(per_doc, "source", "doc_id", F.col("count"), "before", docs).select("doc_id", "source", "before")
    return found.join(before, "doc_id").select("source", "doc_id", "number", (F.col("before") + F.col("number")).alias("position"))


@query(WINDOWS + """SELECT d.source, count(DISTINCT d.doc_id)::BIGINT AS sections, count(c.number)::BIGINT AS passages, round(coalesce(avg(length(c.text)), 0), 1) AS mean_chars,
  coalesce(min(length(c.text)), 0)::BIGINT AS least_chars, coalesce(max(length(c.text)), 0)::BIGINT AS most_chars
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id GROUP BY d.source""")
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and their lengths by book; books and sections without passages count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    n = F.char_length("text")
    lengths = passing.passages(docs).groupBy("doc_id").agg(F.count("*").alias("p"), F.sum(n).alias("chars"), F.min(n).alias("least"), F.max(n).alias("most"))
    return docs.select("doc_id", "source").join(lengths, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("sections"), F.coalesce(F.sum("p"), F.lit(0)).alias("passages"), F.round(F.coalesce(F.sum("chars") / F.sum("p"), F.lit(0.0)), 1).alias("mean_chars"),
        F.coalesce(F.min("least"), F.lit(0)).cast("long").alias("least_chars"), F.coalesce(F.max("most"), F.lit(0)).cast("long").alias("most_chars"),
    )


@query(WINDOWS + """, p AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents)
SELECT c.doc_id, number, 'ch. ' || position || ' · “' || source || '” · chars ' || char_start || '–' || char_end AS citation
FROM cut c JOIN p ON c.doc_id = p.doc_id""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of all passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    places = numbered(docs.select("doc_id", "source"), "source", "doc_id")
    found = passing.passages(docs).select("doc_id", "number", "char_start", "char_end").join(places, "doc_id")
    return found.select("doc_id", "number", text.citation(F.col("position"), F.col("source"), F.lit(""), F.col("char_start"), F.col("char_end")).alias("citation"))


# Non-ASCII letters become a word character that no pattern names, as word edges are ASCII there.
MASK = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{373}\x{376}-\x{1FFF}]', '0', 'g')"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("(?md)", "(?m)").replace("(?mdi)", "(?mi)").replace("'", "''") + "'"


SCORES = rf"""
WITH m AS (SELECT doc_id, source, {MASK} AS t FROM documents),
h AS (SELECT doc_id, source, len(list_distinct(list_transform(regexp_extract_all(t, {_sql(signals.TERM)}, 1), lambda x: lower(x)))) AS terms,
  {", ".join(f"len(regexp_extract_all(t, {_sql(p)})) AS {k}" for k, p in (("callouts", signals.CALLOUT), ("labels", signals.LABEL), ("awards", signals.AWARD), ("shouts", signals.SHOUT), ("rules", signals.RULE)))}
  FROM m),
s AS (SELECT *, round({" + ".join(f"least({w} * {k}, {cap})" for k, (w, cap) in signals.WEIGHTS.items())}, 2)::DOUBLE AS score,
  concat_ws(', ', {", ".join(f"CASE WHEN {k} > 0 THEN {k} || ' {k}' END" for k in signals.WEIGHTS)}) AS reasons FROM h)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = signals.counts(F.col("masked"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", signals.masked(F.col("text")).alias("masked"))
    rows = rows.select("doc_id", "source", *(h.alias(k) for k, h in hits.items()))
    named = {k: F.col(k) for k in hits}
    return rows.select("doc_id", "source", signals.score(named).alias("score"), signals.reasons(named).alias("reasons"))


@query(SCORES + "SELECT doc_id, score, reasons FROM s")
def prefilter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal score of every section, with its reasons."""
    return _scored(spark, sf_dir).select("doc_id", "score", "reasons")


@query(SCORES + "SELECT doc_id, score FROM s WHERE score >= 2.0 ORDER BY score DESC, doc_id")
def prefilter_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that reach the threshold, best first."""
    return _scored(spark, sf_dir).where(F.col("score") >= signals.THRESHOLD).select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


@query(SCORES + """SELECT source, count(*)::BIGINT AS total, count(*) FILTER (score >= 2)::BIGINT AS selected, round(count(*) FILTER (score >= 2) / count(*), 3) AS rate,
  max(score) AS best, round(coalesce(avg(score) FILTER (score >= 2), 0), 2) AS mean_selected FROM s GROUP BY source""")
def prefilter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How selective the signals are in each book."""
    hit = F.col("score") >= signals.THRESHOLD
    return _scored(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(hit).alias("selected"), F.round(F.count_if(hit) / F.count("*"), 3).alias("rate"), F.max("score").alias("best"),
        F.round(F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)), 2).alias("mean_selected"),
    )


@query(SCORES + """SELECT s.doc_id, score, reasons, substr(regexp_replace(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), '^ | $', '', 'g'), 1, 240) AS preview
FROM s JOIN documents d ON s.doc_id = d.doc_id ORDER BY score DESC, s.doc_id LIMIT 20""")
def prefilter_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best sections with their beginnings."""
    best = _scored(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(20)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spaced = F.regexp_replace("text", r"[\t\n\f\r ]+", " ")
    preview = F.substring(F.regexp_replace(F.regexp_replace(spaced, r"^\p{Zs}+|\p{Zs}+$", ""), "^ | $", ""), 1, 240)
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", "reasons", preview.alias("preview"))  # 20 rows
