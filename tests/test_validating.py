"""Edge cases of items in replies: what is no object, what lacks a text, other types, caps."""

from quire.operators import validating


def items(spark, *rows):
    return spark.createDataFrame([(i, r, 3, t) for i, (r, t) in enumerate(rows)], "ord int, item string, chapter int, tier string")


def test_items_that_are_no_rules(spark):
    bad = [None, "", "not json", "5", "[1]", "null", "{}", '{"name": "n"}', '{"statement": "s"}', '{"name": " ", "statement": "s"}']
    df = items(spark, *((b, None) for b in bad))
    assert validating.valid_rules(df, "ord").count() == 0
    assert validating.valid_entities(df, "ord").count() == validating.valid_quests(df, "ord").count() == validating.valid_facts(df, "ord").count() == 0


def test_other_types_and_caps(spark):
    rule = '{"name": 12, "statement": "%s", "aliases": [" B ", "b", null, 12, "12", "%s"], "kind": ["xp"], "scope": "system", "applies_to": " Cap  of\\u00a0X "}' % ("é" * 400, "y" * 80)
    r = validating.valid_rules(items(spark, (rule, None)), "ord").first()
    assert (r.name, r.kind, r.scope, r.applies_to, r.confidence, r.formula) == ("12", "mechanic", "instance", "Cap of X", "implied", "")
    assert r.statement == "é" * 300 and r.aliases == ["B", "y" * 60] and r.key == "mechanic:12" and len(r.id) == 12


def test_aliases_of_one_text_or_another_type(spark):
    df = items(spark, ('{"name": "N", "summary": "s", "aliases": "a, ,A,n, b"}', None), ('{"name": "N", "summary": "s", "aliases": {"a": 1}}', None))
    assert [x.aliases for x in validating.valid_entities(df, "ord").orderBy("ord").collect()] == [["a", "b"], []]


def test_sections_come_from_the_passage(spark):
    df = items(spark, ('{"name": "Q", "objective": "o", "chapter": 9, "first_chapter": 9}', None)).withColumn("chapter", __import__("pyspark").sql.functions.lit(None).cast("int"))
    assert validating.valid_quests(df, "ord").first().first_chapter == 0


def test_fields_by_tier(spark):
    role, quirk = '{"field": " ROLE", "text": "a smith", "subject": "x"}', '{"field": "quirks", "text": "hums"}'
    tie, alone = '{"field": "relationship", "text": "t", "subject": " Ann "}', '{"field": "relationship", "text": "t"}'
    rows = [(x, t) for t in ("primary", "secondary", "filler", None) for x in (role, quirk, tie, alone)]
    got = [(r.ord, r.field, r.subject) for r in validating.valid_facts(items(spark, *rows), "ord").orderBy("ord").collect()]
    assert got == [(0, "role", ""), (1, "quirks", ""), (2, "relationship", "Ann"), (4, "role", ""), (6, "relationship", "Ann")]
