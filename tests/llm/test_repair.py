"""Repairs against an exhaustive search over edit sequences, and the registered query against its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, gone2 boolean"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) by trying every sequence of edits, with at most two inserts between rows."""
    found, best = faults(rows), (2 * len(rows), "D" * len(rows), ())  # all deleted is always allowed

    def go(i, roles, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, out))
        if not audit.endswith("II"):
            for r in ("user", "assistant"):
                go(i, roles + r[0], cost + 5, audit + "I", (*out, f"{r}:"))
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, roles, cost + 2, audit + "D", out)
        if found[i] in ("blank", "duplicate"):
            return
        more = 5 if found[i] == "truncated" else 0
        if role and not (set(roles + role[0]) - set("sua")) and re.match("s?(u|a|$)", roles + role[0]):
            go(i + 1, roles + role[0], cost + more, audit + "K", (*out, f"{role}:{text}"))
        for r in ("user", "assistant"):
            go(i + 1, roles + r[0], cost + 1 + more, audit + "R", (*out, f"{r}:{text}"))

    go(0, "", 0, "", ())
    return best


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    """``rows``: (turn, role, text) without nulls in role and text, in order."""
    cost, audit, out = cheapest(rows)
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest(out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], SCHEMA)


def check(spark, talks):
    rows = [(i, *r) for i, talk in enumerate(talks) for r in talk]
    got = {r[0]: tuple(r)[1:] for r in repair.repair(frame(spark, rows)).collect()}
    for i, talk in enumerate(talks):
        plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in talk]
        plain.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[i] == expected(plain), talk
    return rows, got


def test_small_talks_against_all_edits(spark):
    rng = random.Random(5)
    talks = []
    for _ in range(150):
        n = rng.randint(1, 5)
        talks.append([(t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "ukulele", "", None]), rng.choice(["Yes.", "No!", "cut", "", " \t", "Why?", "A. ", None])) for t in range(n)])
    rows, got = check(spark, talks)
    made = {}
    df = frame(spark, rows)
    for r in repair.repaired(df, repair.repair(df)).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for i, result in got.items():
        assert digest(made.get(i, [])) == result[-1]


def test_ties_nulls_and_gaps(spark):
    talks = [
        [(None, "user", "One."), (None, "assistant", "Two."), (7, "user", "Three."), (9, "assistant", "Four.")],
        [(None, None, None), (None, "user", "a.")],
        [(3, "user", "b."), (3, "user", "a."), (3, "assistant", "c.")],
        [(-5, "system", "s."), (10**12, "assistant", "c.")],
        [(1, "system", "only.")],
        [(1, "user", "same."), (2, "assistant", "same."), (3, "user", "same."), (4, "assistant", "same.")],
    ]
    check(spark, talks)


def test_gone_rows_name_their_conversation(spark):
    df = frame(spark, [(1, 0, "user", "a."), (2, 0, "user", "a."), (2, 1, "assistant", "b."), (None, 0, "user", "a.")])
    got = {r.conv_id: r for r in repair.repair(df, gone=F.col("conv_id").isNull() | (F.col("conv_id") == 1)).collect()}
    assert set(got) == {1, 2, None}
    for key in (1, None):
        assert tuple(got[key])[1:] == (0, 0, 0, 0, 0, 0, "", digest([]))
    assert got[2].audit == "KK" and got[2].cost == 0
    assert repair.repair(df.where("conv_id = 99")).count() == 0


def test_long_talk_is_read_once(spark):
    """A long conversation in which roles slip once, and one very long text."""
    rows = [(1, t, "user" if t % 2 == (t > 9000) else "assistant", f"Text {t}.") for t in range(20_000)] + [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "ok.")]
    got = {r.conv_id: r for r in repair.repair(frame(spark, rows)).collect()}
    assert len(got[1].audit) == 20_000 and got[1].cost == 4 and got[1].illegal == 1
    assert got[2].cost == 0


def test_damage_is_that_of_the_contract(spark):
    rows = [(c, t, ["user", "assistant", None][t % 3], [f"Text. {c}!", None][t % 2]) for c in range(40) for t in range(8)]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damaged(frame(spark, rows).select("conv_id", "turn", "role", "text")).collect()]
    assert sorted(got) == sorted(want) and any(w[4] for w in want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    got = sorted(map(tuple, queries.QUERIES["op12_structure_repair"](spark, data).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op12_structure_repair"]).fetchall()
    assert got == sorted(want) and len({r[7] for r in got}) > 5
