"""Curated rows of several books, united in the order of the books, merged, and compiled into whole entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import codex, listings, merging
from quire.operators.numbering import numbered_rows, parts_for
from quire.shared import materialize

# The fields of an entry beside those compiled from a row, and what they start with.
QUIET = {
    "selective": True, "disable": False, "addMemo": True, "group": "", "groupOverride": False, "groupWeight": 100, "sticky": 0, "cooldown": 0,
    "delay": 0, "probability": 100, "depth": 4, "useProbability": True, "role": 0, "vectorized": False, "excludeRecursion": False,
    "preventRecursion": False, "delayUntilRecursion": False, "scanDepth": None, "caseSensitive": None, "matchWholeWords": None,
    "useGroupScoring": None, "automationId": "",
}
FIELDS = (
    "uid key keysecondary comment content constant selective order position disable displayIndex addMemo group groupOverride groupWeight sticky cooldown "
    "delay probability depth useProbability role vectorized excludeRecursion preventRecursion delayUntilRecursion scanDepth caseSensitive matchWholeWords useGroupScoring automationId"
).split()
QUEST_TERMS = {"giver": "Given by", "requirements": "Requires", "reward": "Reward", "penalty": "Penalty on failure", "deadline": "Deadline"}


def wanted(rows: DataFrame, kept_only: bool = False) -> DataFrame:
    """Rows that are kept, or proposed unless only kept ones are asked for; never discarded ones."""
    return rows.where(F.col("status").isin(["kept"] if kept_only else ["kept", "proposed"]))


def united(rows: DataFrame, books: DataFrame, order: list[Column], kept_only: bool = False, only: list[str] | None = None) -> DataFrame:
    """The wanted ``rows`` of all ``books`` (book, place), with ``ord`` from 0 by place, ``order`` and id.

    Every row of a book that was asked for is there, equal ones too; a book of no place is left out.
    With ``only``, rows have those columns and ``ord``, and no others are sorted and written.
    """
    keyed = wanted(rows, kept_only).join(books, "book").withColumns({"__all": F.lit(0)} | {f"__o{i}": c for i, c in enumerate(order)})
    named = [f"__o{i}" for i in range(len(order))]
    if only is not None:
        keyed = keyed.select(*dict.fromkeys([*only, "id", "__all", "place", *named]))
    placed = numbered_rows(keyed, "__all", "place", *named, "id", name="ord", parts=parts_for(keyed.count(), keyed)).drop("__all", "place", *named)
    return placed if only is None else placed.select(*only, "ord")


def _policy(rows: DataFrame) -> DataFrame:
    """``rows`` with the policy of their kind: order, position, constant; unknown kinds have that of a term."""
    kinds = rows.sparkSession.createDataFrame([(k, v, 0, False) for k, v in codex.PRIORITY.items()], "kind string, order int, position int, constant boolean")
    joined = rows.join(F.broadcast(kinds), "kind", "left")  # one row a kind, eight in all
    return joined.withColumns({"order": F.coalesce("order", F.lit(50)), "position": F.coalesce("position", F.lit(0)), "constant": F.coalesce("constant", F.lit(False))})


def _rank(vocabulary: tuple | list) -> Column:
    place = merging.vocabulary_index(F.col("kind"), vocabulary)
    return F.when(place > 0, place).otherwise(99)


def compiled_series(entities: DataFrame, quests: DataFrame, rules: DataFrame, people: DataFrame, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """Whole entries (uid and all FIELDS) of four united row sets, and the names of people left out for want of a note.

    The sets are as ``united`` gives them: ord and what the merges of ``merging`` take. With
    ``merge``, as for more than one book, rows of one key become one first. Sections come one after
    the other, each in its list's order; entries without a key are left out, and people without
    content, who are told of in the second result.
    """
    if merge:
        entities, quests, rules, people = merging.merge_entities(entities), merging.merge_quests(quests, ["objective", *QUEST_TERMS]), merging.merge_rules(rules), merging.merge_series(people)
        cited = -F.size("citations")
        orders = {"entity": [cited, _rank(merging.ENTITY_KINDS), F.lower("name")], "quest": [F.col("first_chapter"), F.lower("name")], "rule": [cited, _rank(merging.RULE_KINDS), F.lower("name")], "character": [listings._tier_rank(), -F.col("speech"), F.lower("name")]}
    else:
        orders = dict.fromkeys(codex.SECTIONS, [F.col("ord")])
    system, named = F.lit("system"), F.col("name")
    spaced = F.concat("aliases", F.when(text.camel_spaced(named) != named, F.array(text.camel_spaced(named))).otherwise(F.array().cast("array<string>")))
    terms = {label: F.col(field) for field, label in QUEST_TERMS.items()}
    sets = {
        "entity": (entities, F.col("kind"), F.col("aliases"), F.col("summary"), F.lit("")),
        "quest": (quests, F.lit("quest"), F.col("aliases"), codex.quest_content(F.col("objective"), terms, F.col("outcome")), F.col("kind")),
        "rule": (rules, system, spaced, codex.rule_content(F.col("statement"), F.col("formula")), F.concat("kind", F.lit(", "), "confidence")),
        "character": (people, F.lit("character"), F.col("aliases"), F.trim(F.coalesce("note", F.lit(""))), F.col("tier")),
    }
    all_: DataFrame | None = None
    for place, (section, (rows, kind, aliases, content, note)) in enumerate(sets.items()):
        *numbers, last = orders[section] if merge else [*orders[section], F.lit("")]
        seats = [F.lpad((c + 10**12).cast("string"), 16, "0") for c in numbers] + [F.lit("")] * (2 - len(numbers)) + [last]
        made = rows.select(F.lit(place).alias("__s"), *(c.alias(f"__o{i}") for i, c in enumerate(seats)), F.col("key").alias("__key"), F.lit(section).alias("section"), *codex.entry(kind, named, aliases, content, note), named.alias("name"))
        all_ = made if all_ is None else all_.unionByName(made)
    skipped = all_.where("section = 'character' AND content = ''").select("name")
    kept = _policy(all_.where((F.size("keys") > 0) & ((F.col("section") != "character") | (F.col("content") != ""))).withColumn("__all", F.lit(0)))
    kept = materialize(kept, "compiled")  # numbering reads its rows twice, and these are the outcome of all merges
    numbered = numbered_rows(kept, "__all", "__s", "__o0", "__o1", "__o2", "__key", name="uid", parts=parts_for(kept.count(), kept))
    fields = {"key": F.col("keys"), "keysecondary": F.array().cast("array<string>"), "displayIndex": F.col("uid")} | {k: F.lit(v) if v is not None else F.lit(None).cast("boolean") for k, v in QUIET.items()}
    return numbered.select(*(fields.get(f, F.col(f)).alias(f) for f in FIELDS)), skipped


def entry_json(entries: DataFrame) -> DataFrame:
    """uid and the entry as JSON with every field, nulls too."""
    return entries.select("uid", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("entry"))
