"""Capitalised names: patterns, normal form, plausibility, display form, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide what counts as a name.
VERBS = (
    "said asked replied answered shouted whispered muttered murmured growled snapped called added continued "
    "explained admitted offered insisted repeated sighed laughed yelled hissed breathed declared demanded "
    "observed remarked responded retorted"
).split()
STOP = (
    "the a an and but or if so then when while after before because though although since until unless as at "
    "by for from in into of on onto out over to up with without he she it they we you i his her its their our "
    "your my this that these those there here what which who whom whose why how not no yes all any both each "
    "few more most other some such only own same than too very can will just now well even still back down "
    "off again once one two three first last next chapter prologue epilogue part book god lord sir madam "
    "mister missus doctor captain system level quest skill status okay oh ah hey yeah maybe please thanks "
    "good great right left new old long little big monday tuesday wednesday thursday friday saturday sunday "
    "january february march april may june july august september october november december"
).split()
TITLES = (
    "mr mrs ms miss sir lady lord dame dr doctor professor captain commander sergeant lieutenant general king "
    "queen prince princess duke duchess father mother brother sister saint master mistress"
).split()
LABELS = (
    "subject target host player user patient client candidate participant contestant operator owner holder "
    "name status current primary secondary designation identity"
).split()
NAME = r"[A-Z][a-z’'\-]+(?:\s+[A-Z][a-z’'\-]+){0,2}"
SPEECH = (rf"\b({NAME})\s+(?:{'|'.join(VERBS)})\b", rf"\b(?:{'|'.join(VERBS)})\s+({NAME})\b")
TITLE = rf"(?i)^({'|'.join(TITLES)})\.?\s+"
CONTRACTION = r"(?i)['’](d|m|s|ll|re|ve|t)\b"
MIN_MENTIONS = 3


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\b({NAME})\b"), F.lit(1))


def speakers(text: Column) -> Column:
    """Names beside a verb of speech, in either order."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SPEECH))


def normal(name: Column) -> Column:
    """Without title, possessive, edge marks, and leading stop words while words follow."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), TITLE, ""), r"['’]s\b", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ '’\-]+|[ '’\-]+$", "")
    parts = F.split(bare, " ")
    at = F.array_position(F.transform(parts, lambda w: ~F.lower(w).isin(*STOP)), F.lit(True)).cast("int")
    return F.array_join(F.slice(parts, F.when(at == 0, F.size(parts)).otherwise(at), F.size(parts)), " ")


def plausible(name: Column) -> Column:
    known = F.forall(F.split(name, " "), lambda w: F.lower(w).isin(*STOP))
    return (F.length(name) >= 2) & ~F.rlike(name, F.lit(CONTRACTION)) & ~known


def display(forms: Column) -> Column:
    """The form with most words, then letters; forms led by a label only without their labels."""
    labels = F.array(*(F.lit(w) for w in LABELS))
    clean = F.filter(forms, lambda f: ~F.array_contains(labels, F.lower(F.element_at(F.split(f, " "), 1))))
    bare = F.transform(forms, lambda f: F.coalesce(F.nullif(F.array_join(F.filter(F.split(f, " "), lambda t: ~F.array_contains(labels, F.lower(t))), " "), F.lit("")), f))
    pool = F.when(F.size(clean) > 0, clean).otherwise(bare)
    best = F.array_max(F.transform(pool, lambda f, i: F.struct(F.size(F.split(f, " ")).alias("w"), F.length(f).alias("n"), (-i).alias("i"), f.alias("form"))))
    return F.coalesce(best["form"], F.lit(""))


def tier(spread: Column, speech: Column, mentions: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when((spread >= 0.25) & (speech >= 3), "primary").when(speech >= 15, "primary").when(speech >= 3, "secondary")
        .when((spread >= 0.15) & (mentions >= 15), "secondary").otherwise("filler")
    )
