"""Compiling curated rows into one keyed lookup document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.numbering import in_ranges

# Priority of each kind of entry, and the order in which kinds are numbered.
PRIORITY = {"system": 100, "character": 98, "quest": 95, "faction": 90, "location": 80, "artefact": 70, "history": 60, "term": 50}
MAX_CONTENT = 1200
SECTIONS = ("entity", "quest", "rule", "character")


def entry(kind: Column, name: Column, aliases: Column, content: Column, note: Column) -> list[Column]:
    """kind, keys (first spellings), content, comment and priority of an entry."""
    keys = text.first_spellings(F.transform(F.concat(F.array(name), aliases), text.key_text))
    order = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in PRIORITY.items()), F.lit(50))
    comment = F.concat(kind, F.lit(": "), name, F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))
    return [kind.alias("kind"), keys.alias("keys"), F.substring(F.trim(content), 1, MAX_CONTENT).alias("content"), comment.alias("comment"), order.alias("priority")]


def quest_content(objective: Column, terms: dict[str, Column], outcome: Column) -> Column:
    lines = [F.nullif(objective, F.lit(""))]
    lines += [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in terms.items()]
    lines.append(F.when(outcome != "unknown", F.concat(F.lit("Outcome: "), outcome)))
    return F.concat_ws("\n", *lines)


def rule_content(statement: Column, formula: Column) -> Column:
    return F.concat_ws("\n", statement, F.when(F.trim(formula) != "", F.concat(F.lit("Formula: "), F.trim(formula))))


def compiled(rows: DataFrame) -> DataFrame:
    """Entries with keys (characters: with content, too) numbered in order of section and ord.

    Numbers come from counts of ranges of ord, not from one sort of all entries; ord is an integer,
    unique in its section.
    """
    kept = rows.where((F.size("keys") > 0) & ((F.col("section") != "character") | (F.col("content") != "")))
    place = F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), F.col("section"))
    cut = in_ranges(kept.withColumn("__s", place), "ord", "__b", rows)
    local = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("ord"))
    totals = cut.groupBy("__s", "__b").count()
    ahead = Window.orderBy("__s", "__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each section and range
    base = totals.select("__s", "__b", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__base"))
    return cut.withColumn("__n", local).join(base, ["__s", "__b"]).select(*rows.columns, (F.col("__base") + F.col("__n") - 1).cast("long").alias("uid"))


def summary(entries: DataFrame) -> DataFrame:
    """Entries by kind, keys and their mean, entries of one key."""
    return entries.groupBy(F.split_part("comment", F.lit(":"), F.lit(1)).alias("kind")).agg(
        F.count("*").alias("entries"), F.sum(F.size("keys")).cast("long").alias("keys_total"),
        F.round(F.sum(F.size("keys")) / F.count("*"), 2).alias("keys_mean"), F.count_if(F.size("keys") == 1).alias("single_key"),
    )
