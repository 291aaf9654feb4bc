"""Orders of lists row by row, and edge cases of tiers by hand, replaced books and casts."""

import duckdb
import pytest

from quire import catalog
from quire.operators import listings
from tests.test_queries import DATA

ORDERED = "list_rules merged_rule_order list_quests list_people census_order harvest_order list_facts".split()


@pytest.mark.parametrize("name", ORDERED)
def test_rows_come_in_the_order_of_the_list(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("part", "lineitem", "orders", "customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = [tuple(r) for r in catalog.QUERIES[name](spark, DATA).collect()]
    assert got == con.sql(catalog.ORACLES[name]).fetchall()


def test_list_filters(spark):
    rows = spark.createDataFrame([(1, "a", "kept"), (2, "a", "proposed"), (3, "b", "kept"), (4, None, "kept")], "id long, book string, status string")
    assert [r.id for r in listings.listed(rows, "books", book="a", status=None).collect()] == [2, 1]
    assert [r.id for r in listings.listed(rows, "books", status="kept").collect()] == [4, 3, 1]


def test_tier_by_hand(spark):
    people = spark.createDataFrame([(1, "filler", "r", False), (2, "primary", "r", True), (3, None, None, False)], "id long, tier string, reason string, locked boolean")
    edits = spark.createDataFrame([(1, 1, "primary"), (1, 2, "secondary"), (1, 3, "hero"), (3, 1, None), (9, 1, "primary")], "id long, ord long, tier string")
    got = {r.id: tuple(r)[1:] for r in listings.with_tiers(people, edits).collect()}
    assert got == {1: ("secondary", "set by hand", True), 2: ("primary", "r", True), 3: (None, None, False)}


def test_replaced_books(spark):
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "book string, n int")
    incoming = spark.createDataFrame([(7, "a"), (8, None), (9, "c")], "n int, book string")
    got = sorted(listings.replace_books(stored, incoming, "book").collect(), key=str)
    assert got == sorted([("a", 7), ("b", 1), (None, 8), ("c", 9)], key=str)
    assert listings.replace_books(stored, incoming.limit(0), "book").count() == 4


def test_cast_names_everyone(spark):
    people = spark.createDataFrame([(1, "primary", "kept"), (2, "primary", "discarded"), (3, "filler", "kept"), (4, "secondary", None), (5, "secondary", "kept")], "id long, tier string, status string")
    found = spark.createDataFrame([(1, ""), (2, ""), (3, ""), (5, "no name")], "id long, problems string")
    got = sorted(tuple(r) for r in listings.cast_list(people, found).collect())
    assert got == [(1, "primary", True, ""), (4, "secondary", False, "no sheet"), (5, "secondary", False, "no name")]


def test_seeds(spark):
    rows = [(1, "appearance", 1, 1, "tall"), (1, "appearance", 2, 2, "always smiling"), (1, "role", 5, 3, "guard"), (1, "role", 2, 4, " scout "), (2, "speech", 1, 5, None), (3, "appearance", 1, 6, "frowning")]
    facts = spark.createDataFrame(rows, "owner long, field string, chapter int, ord long, text string")
    people = spark.createDataFrame([(1, "primary"), (2, "secondary"), (3, "odd"), (4, "primary")], "owner long, tier string")
    got = {r.owner: r for r in listings.persona_seeds(facts, people).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].looks, got[1].dropped, got[1].role, got[1].pose_preset) == ("tall.", 1, "scout", "expressions")
    assert (got[2].looks, got[2].dropped, got[2].speech, got[2].role) == ("", 0, None, None)
    assert (got[3].looks, got[3].dropped, got[3].expressions, got[3].train) == ("", 1, 1, False)


def test_series_entries_skip_and_order(spark):
    """One book goes in unmerged; people without a note are told of; kinds have their policy."""
    from pyspark.sql import functions as F

    from quire.operators import books

    kinds = spark.createDataFrame([(0, 1, "k1", "location", "Gate", ["gate", "The Gate,"], "A gate.", [(1, 1)], "kept"), (0, 2, "k2", "odd", "Thing", [], "x" * 2000, [(1, 2)], "proposed"), (0, 3, "k3", "term", "Gone", [], "y", [(1, 3)], "discarded"), (5, 4, "k4", "term", "Other book", [], "y", [(1, 3)], "kept")], "book int, id long, key string, kind string, name string, aliases array<string>, summary string, citations array<struct<chunk:int,chapter:int>>, status string")
    places = spark.createDataFrame([(0, 0)], "book int, place int")
    entities = books.united(kinds, places, [F.lower("name")])
    assert [(r.id, r.ord) for r in entities.orderBy("ord").collect()] == [(1, 0), (2, 1)]
    assert [r.id for r in books.united(kinds, places, [F.lower("name")], kept_only=True).collect()] == [1]
    none = lambda schema: spark.createDataFrame([], schema)
    quests = none("ord long, key string, kind string, name string, aliases array<string>, objective string, giver string, requirements string, reward string, penalty string, deadline string, outcome string, first_chapter long, citations array<struct<chunk:int,chapter:int>>")
    rules = none("ord long, key string, kind string, name string, aliases array<string>, scope string, applies_to string, statement string, confidence string, formula string, evidence string, citations array<struct<chunk:int,chapter:int>>")
    people = spark.createDataFrame([(0, "ann", "Ann", ["A"], "primary", "", "brave", 1, 1, 1, 1, 1), (1, "bob", "Bob", [], "primary", "", "  ", 1, 1, 1, 1, 1)], "ord long, key string, name string, aliases array<string>, tier string, reason string, note string, mentions long, speech long, sections long, first_section long, last_section long")
    for merge in (False, True):
        made, skipped = books.compiled_series(entities, quests, rules, people, merge=merge)
        got = made.orderBy("uid").collect()
        assert [(r.uid, r.comment, r["order"], len(r.content)) for r in got] == [(0, "location: Gate", 80, 7), (1, "odd: Thing", 50, 1200), (2, "character: Ann (primary)", 98, 5)]
        assert got[0].key == ["Gate", "The Gate"] and got[0].displayIndex == 0 and len(got[0]) == 31 and got[0].scanDepth is None
        assert [r.name for r in skipped.collect()] == ["Bob"]


def test_citation_arrays_order_by_their_length(spark):
    from quire.operators.listings import listed

    rows = spark.createDataFrame([(1, "skill", "b", [1]), (2, "skill", "a", [1, 2, 3]), (3, "cap", "c", [1]), (4, "cap", "d", None)], "id int, kind string, name string, citations array<int>")
    found = listed(rows, "rules")
    assert [r.id for r in found.collect()] == [2, 3, 1, 4] and found.columns == rows.columns
