"""Rules over stored ones, case by case."""

from quire.operators import stores

TYPE = "key string, name string, aliases array<string>, citations array<struct<chunk:int,chapter:int>>, kind string, scope string, applies_to string, statement string, formula string, confidence string, evidence string"


def side(spark, rows, stored):
    full = [(k, k.upper(), a, c, kind, "system", "", s, f, conf, e, *((status, edited) if stored else ())) for k, a, c, kind, s, f, conf, e, status, edited in rows]
    return spark.createDataFrame(full, TYPE + (", status string, edited boolean" if stored else ""))


def test_rules_over_stored_ones(spark):
    old = [(k, ["x"], [(1, 1)], "xp", "long text", "f", conf, "e", status, edited) for k, conf, status, edited in (
        ("surer", "implied", "proposed", False), ("longer", "implied", "discarded", False), ("less", "stated", "kept", False), ("edited", "implied", "kept", True), ("alone", "stated", "kept", False))]
    new = [("surer", ["X", "y", "Y", "SURER"], [(1, 1), (2, 1)], "cap", "s", "", "stated", None, 0, 0), ("longer", [], [], "xp", "longer text", "g", "implied", "h", 0, 0), ("less", [], [(1, 1)], "xp", "a much longer text", "g", "implied", "h", 0, 0),
           ("edited", ["z"], [(3, 3)], "xp", "a much longer text", "g", "stated", "h", 0, 0), ("fresh", ["w"], [(9, 9)], "cap", "t", None, "stated", None, 0, 0)]
    got = {r.key: r for r in stores.upsert_rules(side(spark, old, True), side(spark, new, False)).collect()}
    text = {k: (r.statement, r.confidence, r.formula, r.evidence, r.kind, r.status, r.action) for k, r in got.items()}
    assert text == {
        "surer": ("s", "stated", "f", "e", "xp", "proposed", "updated"), "longer": ("longer text", "implied", "g", "h", "xp", "discarded", "updated"),
        "less": ("long text", "stated", "f", "e", "xp", "kept", "updated"), "edited": ("long text", "implied", "f", "e", "xp", "kept", "updated"),
        "alone": ("long text", "stated", "f", "e", "xp", "kept", "untouched"), "fresh": ("t", "stated", None, None, "cap", "proposed", "inserted"),
    }
    assert got["surer"].aliases == ["x", "y"] and got["edited"].aliases == ["x", "z"]
    assert [tuple(c) for c in got["surer"].citations] == [(1, 1), (2, 1)] and [tuple(c) for c in got["edited"].citations] == [(1, 1), (3, 3)]
    empty = side(spark, [], True)
    assert stores.upsert_rules(empty, side(spark, new, False)).count() == 5 and stores.upsert_rules(empty, side(spark, [], False)).count() == 0
