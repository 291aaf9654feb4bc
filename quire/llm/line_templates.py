"""Line dedup by a log-template tree, in DataFrame functions alone.

A line goes down a tree of fixed depth: number of tokens, then its leading tokens. In a line with
enough tokens that are no numbers, each token with a digit is a variable field. In each leaf, a
token at a position stays constant if lines with it there occur in enough documents; other tokens
become variable fields too. What is left is the line's template; a line of few tokens, or mostly of
numbers, is only alike to one of the same tokens. Templates that recur across documents are dropped
from all of them but the one of least id.

Lines are told by two 64-bit hashes, of the line and of its leaf; only lines of leaves that may hold
a template beyond the line itself are read as tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize

SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"


def tokens(line: Column, min_tokens: int = 4, words: int = 3, word_share: float = 0.5) -> Column:
    """Tokens between ASCII white space; one empty token for a blank line.

    In lines of ``min_tokens`` or more, of which ``words`` and a ``word_share`` at least are words
    (with a letter, without a digit), tokens with a digit are ``<*>``.
    """
    split = F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), SPACE)
    plain = F.size(F.filter(split, lambda t: F.rlike(t, F.lit(r"\p{L}")) & ~F.rlike(t, F.lit("[0-9]"))))
    general = (F.size(split) >= min_tokens) & (plain >= F.greatest(F.lit(words), F.size(split) * word_share))
    fields = F.transform(split, lambda t: F.when(F.rlike(t, F.lit("[0-9]")), F.lit(FIELD)).otherwise(t))
    return F.when(F.rlike(line, F.lit("[0-9]")) & general, fields).otherwise(split)


def marked(split: Column, depth: int, min_tokens: int, min_chars: int) -> Column:
    """Number of tokens, whether they are few and short, hash and leaf of each line of an array of lines."""

    def told(t: Column) -> Column:
        short = (F.size(t) < min_tokens) & (F.char_length(F.array_join(F.slice(t, 1, min_tokens), " ")) < min_chars)
        return F.struct(F.size(t).alias("n"), short.alias("short"), F.xxhash64(t).alias("lh"), F.xxhash64(F.size(t), F.slice(t, 1, depth)).alias("leaf"))

    return F.transform(F.transform(split, lambda line: tokens(line, min_tokens)), told)


def drop_templates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_docs: int = 3, min_tokens: int = 4, depth: int = 3, min_constant: int = 5, constant_share: float = 0.75, min_chars: int = 20, short_every: int = 100,
) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and n_lines and n_dropped added.

    A template recurs if it occurs in ``min_docs`` or more documents. Numbers are fields only in
    lines of ``min_tokens`` or more tokens of which three and half at least are words; all other
    lines recur only with the same tokens. A line of fewer than ``min_tokens`` tokens and
    ``min_chars`` characters must occur in one of every ``short_every`` documents, too, as headings
    and single words do not tell a copied line. Blank lines stay. A template with fields other
    than numbers needs ``min_constant`` words that are constant, and a ``constant_share`` of its
    tokens. The document of least id (null first, then by hash) keeps its lines. Null texts stay
    null with no lines; empty ones have one line; repeated rows count as one document and are all
    returned; columns of other names pass through, and columns named n_lines or n_dropped are
    replaced. An empty table gives no rows.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    # Lines are read inside their documents, once; only figures leave them.
    found = docs.where(F.col(text_col).isNotNull()).select(key.alias("row"), F.col(id_col).cast("long").alias("id"), F.posexplode(marked(F.split(text_col, "\n"), depth, min_tokens, min_chars)).alias("pos", "line"))
    blank = F.xxhash64(F.lit(1), F.array(F.lit("")))
    short = materialize(found.select("row", "id", "pos", "line.n", "line.short", "line.lh", "line.leaf").where(F.col("leaf") != blank), "lines")

    # Documents of each line; lines in enough of them recur as they stand.
    seen = short.groupBy("lh", "leaf", "n", "short", "row").agg(F.lit(1).alias("one"))
    counts = materialize(seen.groupBy("lh", "leaf", "n", "short").agg(F.count("*").alias("docs")), "line-counts")
    many = max(min_docs, -(-docs.where(F.col(text_col).isNotNull()).count() // short_every))
    rare = F.when(F.col("docs") < min_docs, F.col("docs")).otherwise(0)
    leaves = counts.where(F.col("n") > min_constant).groupBy("leaf").agg(F.sum(rare).alias("rare"), F.count("*").alias("kinds"))
    leaves = materialize(leaves.where((F.col("rare") >= min_docs) & (F.col("kinds") > 1)).select("leaf"), "leaves")

    # Tokens of the distinct lines of those leaves, each read in one document, and which are constant.
    samples = join_small(short.where(F.col("n") > min_constant), leaves, ["leaf"], "left_semi").groupBy("lh", "leaf").agg(F.min(F.struct("row", "pos")).alias("at"))
    samples = materialize(samples.select("lh", "leaf", "at.row", "at.pos"), "samples")
    lines = docs.where(F.col(text_col).isNotNull()).select(key.alias("row"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    read = join_small(lines, samples, ["row", "pos"]).select("lh", "leaf", tokens(F.col("line"), min_tokens).alias("t"))
    told = read.groupBy("lh", "leaf").agg(F.first("t").alias("t"))  # equal rows would bring a line twice
    told = materialize(told.join(counts.select("lh", "leaf", "docs", "n"), ["lh", "leaf"]), "told")
    cells = told.select("lh", "leaf", "n", "docs", F.posexplode("t").alias("at", "token"))
    constant = cells.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs)
    constant = materialize(constant.select("leaf", "at", "token", F.lit(True).alias("constant")), "constants")
    cells = join_small(cells, constant, ["leaf", "at", "token"], "left")
    fixed = F.coalesce("constant", F.lit(False)) & (F.col("token") != FIELD) & F.rlike(F.col("token"), F.lit(r"\p{L}"))
    shaped = cells.groupBy("lh", "leaf", "n", "docs").agg(
        F.sum(fixed.cast("int")).alias("held"), F.bit_xor(F.xxhash64("at", F.when(F.coalesce("constant", F.lit(False)), F.col("token")).otherwise(FIELD))).alias("shape")
    )
    wide = (F.col("held") >= min_constant) & (F.col("held") >= constant_share * F.col("n"))
    shaped = materialize(shaped.where(wide).select("lh", "leaf", F.xxhash64("leaf", "shape").alias("template"), "docs"), "shapes")
    often = shaped.groupBy("leaf", "template").agg(F.sum("docs").alias("most"), F.count("*").alias("kinds")).where((F.col("most") >= min_docs) & (F.col("kinds") > 1))
    shaped = materialize(shaped.join(often.select("leaf", "template"), ["leaf", "template"], "left_semi").select("lh", "leaf", "template"), "templates")
    own = counts.where(F.col("docs") >= F.when(F.col("short"), F.lit(many)).otherwise(F.lit(min_docs))).select("lh", "leaf")
    own = own.join(shaped.select("lh", "leaf"), ["lh", "leaf"], "left_anti").select("lh", "leaf", F.col("lh").alias("template"))
    known = materialize(shaped.unionByName(own), "known")

    # Where templates occur, and what goes.
    hits = materialize(join_small(short.select("row", "id", "pos", "lh", "leaf"), known, ["lh", "leaf"]).select("row", "id", "pos", "template", "leaf"), "hits")
    per_doc = hits.groupBy("template", "leaf", "row").agg(F.min("id").alias("id"))
    recurring = per_doc.groupBy("template", "leaf").agg(F.count("*").alias("docs"), F.min(F.struct("id", "row")).alias("first")).where(F.col("docs") >= min_docs)
    recurring = materialize(recurring.select("template", "leaf", F.col("first.row").alias("keeper")), "recurring")
    gone = join_small(hits, recurring, ["template", "leaf"]).where("row <> keeper").select("row", "pos")
    gone = materialize(gone.groupBy("row").agg(F.collect_set("pos").alias("gone")), "gone")

    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    split = F.split(text_col, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone")), lambda i: F.get(split, i))
    named = gone.select(F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    out = docs.select(*(F.col(f"`{c}`") for c in keep), key.alias("__row")).join(named.hint("shuffle_merge"), "__row", "left")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return out.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
    )
