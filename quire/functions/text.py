"""Text expressions: cleaning, slugs, citations, ordered distinct, keys."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters whose decomposition starts with one ASCII letter, and those letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cleaned(text: Column) -> Column:
    """Line ends unified, words joined across line breaks, paragraphs kept, white space collapsed."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def collapsed(text: Column, cap: int | None = None) -> Column:
    """White space runs to one space, trimmed, cut at ``cap``; null becomes empty."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " "))
    return F.substring(t, 1, cap) if cap else t


def words(text: Column) -> Column:
    """Number of white-space separated words."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("long")


def slug(name: Column) -> Column:
    """Merge key: lower case, runs of other characters than a-z and 0-9 to one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def folder_slug(name: Column, cap: int = 64, default: str = "book") -> Column:
    """Slug after accents are taken off, cut, never empty."""
    plain = F.regexp_replace(F.translate(name, _FROM, _TO), r"[^\x00-\x7F]", "")
    cut = F.substring(F.lower(F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), 1, cap)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def file_name(title: Column, fallback: Column, cap: int = 48) -> Column:
    """Title up to its subtitle as a slug of at most ``cap`` characters, cut between words."""
    text = trimmed(F.coalesce(F.nullif(title, F.lit("")), F.nullif(fallback, F.lit("")), F.lit("untitled")))
    head = trimmed(F.element_at(F.split(text, r"\s+[-—:]\s+"), 1))
    made = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(head, F.lit("")), text), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    short = F.substring(made, 1, cap)
    at_word = F.regexp_replace(short, "-[^-]*$", "")
    cut = F.when(F.length(made) > cap, F.coalesce(F.nullif(at_word, F.lit("")), short)).otherwise(made)
    return F.coalesce(F.nullif(cut, F.lit("")), F.nullif(fallback, F.lit("")), F.lit("untitled"))


def citation(section: Column, title: Column, ref: Column, start: Column, end: Column) -> Column:
    """Parts that are there, joined by middle dots."""
    return F.concat_ws(
        " · ",
        F.concat(F.lit("ch. "), section.cast("string")),
        F.when(title != "", F.concat(F.lit("“"), title, F.lit("”"))),
        F.when(ref != "", ref),
        F.concat(F.lit("chars "), start.cast("string"), F.lit("–"), end.cast("string")),
    )


def merged_refs(first: Column, second: Column) -> Column:
    """One reference that covers both: page ranges widen, others are listed."""
    form = r"^pages (\d+)-(\d+)$"
    edge = lambda c, g: F.regexp_extract(c, form, g).cast("int")
    pages = F.concat(F.lit("pages "), F.least(edge(first, 1), edge(second, 1)), F.lit("-"), F.greatest(edge(first, 2), edge(second, 2)))
    both = F.when(F.rlike(first, F.lit(form)) & F.rlike(second, F.lit(form)), pages).otherwise(F.concat(first, F.lit("; "), second))
    return F.when(F.coalesce(first, F.lit("")) == "", second).when((F.coalesce(second, F.lit("")) == "") | (first == second), first).otherwise(both)


def first_spellings(items: Column, owner: Column | None = None) -> Column:
    """Items in order, one for each lower-cased form, without blanks and the owner's form.

    Forms are sorted and each compared with the one before it. What a lambda takes from outside is
    evaluated for every item, so the sorted list and the owner's form are bound first.
    """
    forms = F.array_sort(F.filter(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))), lambda e: e["x"] != ""))
    bound = F.array(F.struct(forms.alias("forms"), (F.lit("") if owner is None else F.lower(owner)).alias("own")))

    def kept(b: Column) -> Column:
        first = F.filter(b["forms"], lambda e, i: ~F.get(b["forms"], i - 1)["low"].eqNullSafe(e["low"]) & (e["low"] != b["own"]))
        return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])

    return F.transform(bound, kept)[0]


def key_text(text: Column) -> Column:
    """A trigger key: collapsed, without commas and semicolons at its ends."""
    return F.regexp_replace(collapsed(text), "^[,;]+|[,;]+$", "")


def camel_spaced(name: Column) -> Column:
    return F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")


def fact_key(field: Column, text: Column, subject: Column) -> Column:
    """Identity of a fact: its longer words in sorted order, so that rewordings meet."""
    plain = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""), " +", " ")), " ")
    long_words = F.array_join(F.array_sort(F.filter(plain, lambda w: F.length(w) > 3)), " ")
    return F.substring(F.concat(field, F.lit(":"), F.trim(F.lower(subject)), F.lit(":"), long_words), 1, 300)


def short_id(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 12)


# The forms of headings.
NAMED_HEADING = (
    r"(?i)^\s*((chapter|chap\.?|part|book|section|act)\s+([0-9]{1,3}|[ivxlcdm]{1,7}|[a-z\-]{3,12})"
    r"|prologue|epilogue|foreword|preface|introduction|afterword|interlude|appendix)\s*[:.|—-]?\s*(.{0,60})?$"
)
NUMERIC_HEADING = r"^\s*[0-9]{1,3}\s*[.|—-]?\s*[A-Z][A-Za-z' ’-]{0,60}\s*$"
HEADING_LENGTH = 70


def is_heading(line: Column, form: str) -> Column:
    return (F.length(line) <= HEADING_LENGTH) & (line != "") & F.rlike(line, F.lit(form))
