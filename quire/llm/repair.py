"""Repair of conversations by composing three weighted machines and taking the shortest path.

The input acceptor reads a conversation's rows in order. The edit transducer keeps, re-roles or
deletes a row and inserts empty turns between rows, each at a cost. The grammar of roles accepts
``(s?(ua)+)?``. Their composition is built as rows come: a state is the number of rows read and
the grammar's state, of which there are four, so a layer is all that is held. Weights are pairs of
cost and label string, compared in that order, and layers come in topological order, so one pass
finds the cheapest edits, the least string among equals.

Two label strings of one layer, before inserts, are equal or differ at some place, as both end with
the label of the same row, and equal strings cost the same. So layers keep ranks of the strings,
and strings themselves are chains of labels, read once at the end. Paths carry the hash of what
they have written, so texts are not held either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import spread

#: The acceptor of ``(s?(ua)+)?``: for each state, where a role's initial leads.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edit transducer; CUT is added for a truncated row that is not deleted.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


class Path(NamedTuple):
    """The best way to a state: cost, rank of its labels in the layer, labels since, chain of labels, hash, what is not yet hashed."""

    cost: int
    rank: int
    labels: str
    chain: tuple | None
    written: hashlib._Hash | None
    pending: tuple[str, ...]

    @property
    def key(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.labels


def arcs(role: str, fault: str | None, state: int) -> Iterator[tuple[str, int, int, str | None]]:
    """Arcs of edit transducer and grammar over one row: label, cost, next state, role written."""
    yield "D", DELETE, state, None
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT if fault == TRUNCATED else 0
    onward = GRAMMAR[state]
    if (to := onward.get(role[:1])) is not None:
        yield "K", more, to, role
    for initial, name in ROLES.items():
        if initial in onward:
            yield "R", REROLE + more, onward[initial], name


def with_inserts(layer: dict[int, Path]) -> dict[int, Path]:
    """The layer after any inserts; two are enough, as a third would lead to a state left before."""
    best, edge = dict(layer), layer
    for _ in range(2):
        found: dict[int, Path] = {}
        for state, path in edge.items():
            for initial, name in ROLES.items():
                if (to := GRAMMAR[state].get(initial)) is not None:
                    longer = path._replace(cost=path.cost + INSERT, labels=path.labels + "I", pending=(*path.pending, f"{name}:"))
                    if to not in best or longer.key < best[to].key:
                        found[to] = best[to] = longer
        edge = found
    return best


def _hashed(path: Path) -> hashlib._Hash | None:
    if not path.pending:
        return path.written
    digest = path.written.copy() if path.written else hashlib.sha256()
    said = "\n".join(path.pending)
    digest.update((f"\n{said}" if path.written else said).encode())
    return digest


class Conversation:
    """What is known of a conversation from the rows read so far."""

    def __init__(self) -> None:
        self.layer = {0: Path(0, 0, "", None, None, ())}
        self.seen: set[bytes] = set()
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def fault(self, role: str, text: str) -> str | None:
        body = text.strip(_SPACE)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=20).digest()
        again = key in self.seen
        self.seen.add(key)
        return BLANK if not body else DUPLICATE if again else TRUNCATED if body[-1] not in ".!?" else None

    def read(self, turn: int | None, role: str, text: str) -> None:
        fault = self.fault(role, text)
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        best: dict[int, Path] = {}
        for state, path in with_inserts(self.layer).items():
            for label, cost, to, name in arcs(role, fault, state):
                key = (path.cost + cost, path.rank, path.labels + label)
                if to not in best or key < best[to].key:
                    best[to] = Path(*key, path.chain, path.written, path.pending if name is None else (*path.pending, f"{name}:{text}"))
        order = {key: i for i, key in enumerate(sorted({(p.rank, p.labels) for p in best.values()}))}
        self.layer = {q: Path(p.cost, order[p.rank, p.labels], "", (p.chain, p.labels), _hashed(p), ()) for q, p in best.items()}

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = with_inserts(self.layer)
        path = min((ends[q] for q in FINAL if q in ends), key=lambda p: p.key)
        labels, chain = [path.labels], path.chain
        while chain is not None:
            chain, label = chain
            labels.append(label)
        digest = _hashed(path) or hashlib.sha256()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, path.cost, "".join(reversed(labels)), digest.hexdigest()


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rows(rows: DataFrame, id_col: str, turn_col: str, gone: Column | None) -> DataFrame:
    said = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(f"__{c}")
    return rows.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{turn_col}`").cast("long").alias("__turn"), said("role"), said("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("__gone"))


def _names(items: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in items:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", gone: Column | None = None) -> DataFrame:
    """id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` has id, turn, role and text; null roles and texts count as one space, null turns come
    first, rows of one turn are in order of role and text. Rows where ``gone`` holds are not read,
    but their conversation is named; one without other rows has zeros, an empty audit and the hash
    of nothing. A null id is a conversation of its own. Other columns are ignored, an empty table
    gives no rows. Partitions are sorted by conversation and read as a stream; a conversation costs
    a hash and a few labels a row, however long its texts.
    """
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, talk = None, None

        def out() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else ((),) * 9
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        id_type = pa.int64()
        names = [id_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        for batch in batches:
            id_type = batch.schema.field("__id").type
            for key, turn, role, text, away in _names(iter([batch]), ("__id", "__turn", "__role", "__text", "__gone")):
                if talk is None or key != now:
                    if talk is not None:
                        made.append((now, *talk.result()))
                    now, talk = key, Conversation()
                if not away:
                    talk.read(turn, role, text)
            if len(made) >= 4096:
                yield out()
                made.clear()
        if talk is not None:
            made.append((now, *talk.result()))
            yield out()

    schema = T.StructType([T.StructField(id_col, kind)])
    for part in _OUT.split(", "):
        schema = schema.add(*part.split())
    dealt = spread(_rows(rows, id_col, turn_col, gone), "__id").sortWithinPartitions("__id", "__turn", "__role", "__text")
    return dealt.mapInArrow(run, schema)


def repaired(rows: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", gone: Column | None = None) -> DataFrame:
    """The conversations after their audits: id, place (from 0), role, text and edit of every row left.

    ``audits`` is what ``repair`` gives for the same ``rows``; its row comes before the others of
    its conversation in one sorted stream, so no row carries a copy of the edits.
    """
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits: list[str] = []
        at = place = system = 0
        key = None
        for batch in batches:
            made: list[tuple] = []

            def inserts() -> None:
                nonlocal at, place
                while at < len(edits) and edits[at] == "I":
                    made.append((key, place, "assistant" if (place - system) % 2 else "user", "", "insert"))  # noqa: B023
                    at, place = at + 1, place + 1

            for id_, audit, role, text in _names(iter([batch]), ("__id", "__audit", "__role", "__text")):
                if audit is not None:
                    key, edits, at, place, system = id_, list(audit), 0, 0, 0
                else:
                    edit = edits[at]
                    at += 1
                    if edit != "D":
                        system |= edit == "K" and role[:1] == "s"
                        by_place = "assistant" if (place - system) % 2 else "user"
                        made.append((id_, place, role if edit == "K" else by_place, text, "keep" if edit == "K" else "rerole"))
                        place += 1
                inserts()
            columns = zip(*made, strict=True) if made else ((),) * 5
            types = [batch.schema.field("__id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "place", "role", "text", "edit"])

    schema = T.StructType([T.StructField(id_col, kind)]).add("place", "long").add("role", "string").add("text", "string").add("edit", "string")
    own = _rows(rows, id_col, turn_col, gone).where("NOT __gone").withColumn("__audit", F.lit(None).cast("string")).drop("__gone")
    heads = audits.select(F.col(f"`{id_col}`").alias("__id"), F.lit(None).cast("long").alias("__turn"), F.lit(None).cast("string").alias("__role"), F.lit(None).cast("string").alias("__text"), F.col("audit").alias("__audit"))
    dealt = spread(heads.unionByName(own), "__id").sortWithinPartitions("__id", F.col("__audit").isNull(), "__turn", "__role", "__text")
    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the contract's damage, by crc32 of ``conv_id:turn``, and ``gone``.

    Nulls are one space in role, text and the hashed key. Of twenty remainders, 0 drops a row (it
    is marked as gone), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")
