"""Smallest free numbers against taking them one by one."""

import random

from quire.operators.slugs import free_slugs


def one_by_one(incoming, stored):
    used, out = set(stored), {}
    for o, slug in sorted(incoming):
        free, n = slug, 2
        while free in used:
            free, n = f"{slug}-{n}", n + 1
        used.add(free)
        out[o] = free
    return out


def run(spark, incoming, stored):
    rows = spark.createDataFrame([(o, s, "x") for o, s in incoming], "ord long, slug string, more string")
    got = free_slugs(rows, spark.createDataFrame([(s,) for s in stored], "slug string"))
    return {r.ord: r.free for r in got.collect()}


def test_holes_are_filled(spark):
    incoming = [(i, "book") for i in range(6)] + [(10, "new"), (11, "new")]
    assert run(spark, incoming, ["book", "book-2", "book-4", "book-5", "new-2"]) == {0: "book-3", 1: "book-6", 2: "book-7", 3: "book-8", 4: "book-9", 5: "book-10", 10: "new", 11: "new-3"}
    assert run(spark, [], ["a"]) == {}


def test_random_arrivals_with_natural_numbers(spark):
    rng = random.Random(8)
    pool = ["a", "a-2", "a-3", "a-2-2", "a-02", "a-1", "b", "b-5", "", "a-2-2-3"]
    for size, kept in ((14, 3), (60, 8), (400, 30)):
        incoming = [(o * 7 % 1009, rng.choice(pool + ["a"] * 6)) for o in range(size)]
        stored = [f"{rng.choice(pool)}-{rng.randint(1, 12)}" if rng.random() < 0.7 else rng.choice(pool) for _ in range(kept)]
        assert run(spark, incoming, stored) == one_by_one(incoming, stored)
