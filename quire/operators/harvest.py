"""Names in sections: harvest, evidence, tiers, containment, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import names, text
from quire.operators.dossiers import TIER_PASSAGES


def harvest(sections: DataFrame, group: str = "source", section: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each name of a group: mentions, sections, first_section, last_section, speech.

    Names with fewer than three mentions stay only if they speak. Hits are summed for each
    section first, so a common name moves one row for each section.
    """

    def per_section(column, label: str) -> DataFrame:
        rows = sections.select(group, section, F.explode(column).alias("raw")).groupBy(group, section, "raw").count()
        rows = rows.select(group, section, names.normal(F.col("raw")).alias("name"), "count")
        return rows.groupBy(group, section, "name").agg(F.sum("count").alias(label))

    seen = per_section(names.found(F.col(text_col)), "hits").where(names.plausible(F.col("name")))
    spoke = per_section(names.speakers(F.col(text_col)), "spoken").groupBy(group, "name").agg(F.sum("spoken").alias("speech"))
    found = seen.groupBy(group, "name").agg(
        F.sum("hits").alias("mentions"), F.count("*").alias("sections"), F.min(section).alias("first_section"), F.max(section).alias("last_section")
    )
    joined = found.join(spoke, [group, "name"], "left").withColumn("speech", F.coalesce("speech", F.lit(0)).cast("long"))
    return joined.where((F.col("mentions") >= names.MIN_MENTIONS) | (F.col("speech") > 0))


def evidence(found: DataFrame, people: DataFrame, group: str = "source") -> DataFrame:
    """Counts of a person from all forms that were found; ``people``: group, person, form."""
    forms = people.withColumn("__form", F.lower("form")).join(found.withColumn("__form", F.lower("name")), [group, "__form"])
    return forms.groupBy(group, "person").agg(
        F.count("*").alias("forms"), F.sum("mentions").alias("mentions"), F.sum("speech").alias("speech"),
        F.min("first_section").alias("first_section"), F.max("last_section").alias("last_section"),
    )


def tiered(found: DataFrame, totals: DataFrame, group: str = "source") -> DataFrame:
    """``found`` with spread over the group's sections, tier and the reason in figures."""
    spread = F.col("sections") / F.col("total_sections")
    reason = F.concat(F.lit("in "), F.bround(spread * 100, 0).cast("long"), F.lit("% of sections, "), F.col("speech"), F.lit(" spoken, "), F.col("mentions"), F.lit(" mentions"))
    return found.join(totals, group).withColumn("tier", names.tier(spread, F.col("speech"), F.col("mentions"))).withColumn("reason", reason)


def containment(found: DataFrame, group: str = "source") -> DataFrame:
    """Pairs of names where the shorter is a run of whole words of the longer.

    Runs of the longer name's words are joined with names, so work follows the number of words.
    """
    parts = F.split("name", " ")
    n = F.size(parts)
    lengths = F.sequence(F.lit(1), n - 1)
    runs = F.array_distinct(F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " ")))))
    longer = found.select(group, F.col("name").alias("longer")).withColumn("name", F.col("longer")).where(n > 1).select(group, "longer", F.explode(runs).alias("shorter"))
    return longer.join(found.select(group, F.col("name").alias("shorter")), [group, "shorter"]).select(group, "shorter", "longer")


def whole_words(form: Column) -> Column:
    """Pattern of the form as it stands, with no letter or digit right before or after it."""
    quoted = F.replace(form, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), quoted, F.lit(r"\E(?!\w)"))


def mentions(texts: DataFrame, forms: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Texts x forms by whole words: id columns, form, hits, text.

    The first word inside a form is joined with the words of the texts; only those pairs are
    matched. Letters of all scripts are words; forms without any letter or digit are in no text.
    """
    first = F.regexp_extract("form", r"(?U)\w+", 0)
    words = texts.select(*id_cols, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("__w"))
    pairs = words.join(forms.select("form", first.alias("__w")).where("__w <> ''"), "__w").select(*id_cols, "form")
    whole = whole_words(F.col("form"))
    return texts.select(*id_cols, text_col).join(pairs, id_cols).withColumn("hits", F.regexp_count(F.col(text_col), whole)).where("hits > 0")


def mention_windows(found: DataFrame, order: list[str], limit: int, width: int, text_col: str = "text") -> DataFrame:
    """The first ``limit`` windows around each form in the order of the id columns, then place."""
    pieces = F.split(F.col(text_col), whole_words(F.col("form")), -1)
    heads = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    seen = F.aggregate(
        heads, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, p: F.struct((s["at"] + F.length(p) + F.length(F.col("form"))).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(p))).alias("all")),
    )["all"]
    rows = found.select(*order, "form", text_col, F.explode(F.slice(seen, 1, limit)).alias("at"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy(*order, "at"))).where(F.col("rank") <= limit)
    begin = F.greatest(F.lit(0), F.col("at") - width // 2)
    return ranked.select("form", "rank", *order, "at", text.collapsed(F.substring(F.col(text_col), begin + 1, F.lit(width))).alias("snippet"))


def chosen_passages(pairs: DataFrame, who: list[str], position: list[str]) -> DataFrame:
    """The densest passages of each person, as many as the tier earns, numbered in reading order as ``place``.

    ``pairs``: the columns of ``who`` and ``position``, tier, hits, n (characters). Density is hits
    a thousand characters to four places; ties go to more hits, then to the earlier passage. Tiers
    without a number of passages have none.
    """
    earned = F.coalesce(*(F.when(F.col("tier") == t, F.lit(n)) for t, n in TIER_PASSAGES.items()), F.lit(0))
    dense = pairs.where("hits > 0 AND n > 0").withColumn("density", F.round(F.col("hits") * 1000.0 / F.col("n"), 4))
    rank = F.row_number().over(Window.partitionBy(*who).orderBy(F.desc("density"), F.desc("hits"), *position))
    kept = dense.withColumn("rank", rank).where(F.col("rank") <= earned)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*who).orderBy(*position)))
