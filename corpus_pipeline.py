"""Corpus pipeline: language, recurring lines, near copies, mixture of sources, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``docs``, whatever these are beside doc_id, text, lang and source.
Stages are written as Parquet and read again, so a lost executor costs at most the stage that runs.
Empty tables give no rows in any stage; null and repeated ids are kept as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, line_templates, mixing, packing, queries, simhash
from quire.llm.common import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; learned from their own labels.

    Null and empty texts and texts without a letter go. Without a labelled text there is no model,
    and all documents stay.
    """
    model = langid.fit(docs.select("text", "lang"), F.lit(True))
    if model is None:
        return docs
    return langid.predict(docs, model).where("NOT rejected").select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents of which no line is left go.

    Null texts stay. ``n_chars``, if there is such a column, follows the text.
    """
    counts = [F.col(f"`{c}`").alias(f"__{c}") for c in ("n_lines", "n_dropped") if c in docs.columns]
    found = line_templates.drop_templates(docs.select("*", *counts)).where("n_dropped = 0 OR n_dropped < n_lines")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*(F.col(f"`__{c}`").alias(c) if c in ("n_lines", "n_dropped") else F.col(f"`{c}`") for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id, null ids last.

    Rows are told apart by id and text, so unlike texts all stay, whatever their ids. Texts
    without a word are copies of one another; of rows alike in id and text one stays.
    """
    return simhash.without_copies(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass, the last of a source cut to its quota.

    They come by shard and slot. Documents without a word are in no mix; null sources are one source.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 1024 ids; repeated documents are pieces each.

    Null texts count as empty and give the end id alone.
    """
    return packing.pack_documents(docs, queries.vocabulary(), end_id=2, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit_packing),
]

#: Models, fingerprints and draws are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
