"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is rendered as ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline. The parser is
deterministic: it splits at the start mark, takes the role up to the first newline and the text up
to the end mark, and removes one level of escapes. Every conversation is first rendered as it is
and parsed; turns that do not come back identical (they hold a mark, or something that reads like
an escape) are escaped, and the conversation is rendered and parsed again until it is.

An escape puts one more backslash between ``<`` and ``|`` wherever these stand together or with
backslashes between; parsing takes one away. In a role, newlines become ``<|n|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As in texts; then newlines, which would end the role, as a mark that no escaped role holds."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def render(turns: Column) -> Column:
    """One string of all turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered string: roles end at the first newline, texts at the first end mark."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring_index(F.regexp_replace(part, r"\A[^\n]*\n?", ""), END, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def gather(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation with its turns in order; null roles and texts are empty.

    Ties of turn go by role, then text; null turns come first. Null ids are one conversation.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63))).alias("turn"), role.alias("role"), text.alias("text"))))
    grouped = rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(ordered.alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(rows: DataFrame, rounds: int = 2, **columns: str) -> DataFrame:
    """conv_id, formatted and parsed turns of each conversation; an empty table gives no rows.

    A conversation goes through at most ``rounds`` renderings: as it is, then with the conflicting
    turns escaped, which always comes back identical (it is an error if one does not).
    """
    out = gather(rows, **columns).withColumn("sent", F.col("turns"))
    for _ in range(rounds - 1):
        # a turn's own rendering is in conflict if parsing it alone gives anything but the turn
        sent = F.transform(
            F.arrays_zip("turns", "sent"),
            lambda p: F.when(
                parse(render(F.array(p["sent"]))) == F.array(p["turns"]), p["sent"]
            ).otherwise(F.struct(escape_role(p["sent"]["role"]).alias("role"), escape(p["sent"]["text"]).alias("text"))),
        )
        out = out.withColumn("sent", sent)
    out = out.withColumn("formatted", render(F.col("sent"))).withColumn("parsed", parse(F.col("formatted")))
    same = F.col("parsed") == F.col("turns")
    checked = F.when(same, F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not come back from its rendering")).cast(TURNS))
    return out.select("conv_id", "formatted", checked.alias("parsed"))


def loss_text(parsed: Column) -> Column:
    """What the loss mask covers: the texts of the assistant's turns, in order."""
    return F.array_join(F.transform(F.filter(parsed, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Figures of each conversation, read back from its rendering."""
    flat = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = loss_text(F.col("parsed"))
    return formatted.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
