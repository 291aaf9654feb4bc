"""Parts of the methods against plain versions of the same thing."""

import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import caps, hashing_search, langid, mixing, packing, queries, simhash, token_blocks, toxicity
from quire.llm.components import components, contract
from quire.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet' ORDER BY doc_id").df()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary())


@pytest.fixture(scope="module")
def memo():
    return Encoder(queries.vocabulary(), memo=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdtrevml.,!?ABcé ß1½²_-<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_librarys(t):
    own, library = _pair()
    assert np.frombuffer(own.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


_KEPT = []


def _pair():
    if not _KEPT:
        _KEPT.append((Encoder(queries.vocabulary(), memo=50), Tokenizer.from_file(queries.vocabulary())))
    return _KEPT[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 60)), max_size=1300))
def test_blocks_round_trip(values):
    v = np.array(values, np.uint32)
    blocks, sizes = token_blocks.pack(v)
    data = memoryview(b"".join(blocks))
    assert token_blocks.unpack(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), len(v)).tolist() == v.tolist()


def test_segments_and_single_documents():
    rng = np.random.default_rng(0)
    writer = token_blocks.SegmentWriter(3, 4, chunk=1024)
    docs = [rng.integers(0, 50_257, n).astype("<u4") for n in (0, 5, 3000, 511, 512, 513, 0, 1)]
    for i, d in enumerate(docs):
        writer.add(None if i == 1 else i, d.tobytes())
    content = writer.bytes()
    p, s, ids, ends, values = token_blocks.read_segment(content)
    assert (p, s) == (3, 4) and ids[1] == token_blocks.NULL_ID and ends.tolist() == np.cumsum([len(d) for d in docs]).tolist()
    assert values.tolist() == np.concatenate(docs).tolist()
    assert all(token_blocks.read_document(content, i).tolist() == d.tolist() for i, d in enumerate(docs))


def test_token_query_against_brute_force(spark, texts, library):
    got = queries.QUERIES["op6_token_blocks"](spark, DATA).toPandas().sort_values("doc_id")
    start = 0
    for r, text in zip(got.itertuples(), texts["text"], strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_plans_hold_every_piece_once(counts):
    plan = packing.best_plan(counts, 64, ((8, 2, 0), (8, 4, 0), (8, 6, 2)))
    places: dict[int, list] = {}
    fill = np.zeros(packing.sequences_of(plan), int)
    for n, rank, times, first, offset in sorted(plan, key=lambda p: p[4]):
        places.setdefault(n, []).append((rank, times))
        assert (fill[first : first + times] == offset).all()
        fill[first : first + times] += n
    assert fill.max() <= 64
    for n, c in counts.items():
        ranks = sorted(r for a, m in places[n] for r in range(a, a + m))
        assert ranks == list(range(c))


def test_packing_query(spark, texts, library):
    got = queries.QUERIES["op10_best_fit_packing"](spark, DATA).toPandas()
    total = 0
    for doc_id, part in got.groupby("doc_id"):
        ids = np.array([*library.encode(texts["text"][doc_id], add_special_tokens=False).ids, 2], "<u4")
        for r in part.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert part["length"].sum() == len(ids)
        total += len(ids)
    assert got["doc_id"].nunique() == len(texts)
    assert got["sequence_id"].nunique() <= 1.03 * -(-total // 1024)


def test_configurations_beat_one_size_a_sequence():
    basis, use = packing.configurations(np.array([60, 40, 30]), np.array([10.0, 10.0, 10.0]), 100)
    assert use.sum() <= 13.4 and (basis.T @ [60, 40, 30] <= 100).all()
    assert np.allclose(basis @ use, 10)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \n\x0b\x1c ABé.ab", max_size=60))
def test_fingerprints(t):
    assert simhash.fingerprint(t) == plain_fingerprint(t)


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_similar_documents_against_brute_force(spark, texts):
    rng = np.random.default_rng(5)
    rows = list(texts["text"][:120])
    for k in range(40):
        base = [f"w{v}" for v in rng.integers(0, 5000, rng.integers(20, 300))]
        for changed in rng.integers(1, 1 + len(base) // 20 + k % 3, 3):
            copy = list(base)
            for at in rng.choice(len(base), changed, replace=False):
                copy[at] = f"x{rng.integers(0, 5000)}"
            rows.append(" ".join(copy))
        rows.append(" ".join(base))
    exact = [f"e{v}" for v in range(49)]  # 45 shingles; five more words add five: 45 of 50, then 45 of 56, 45 of 57
    rows += [" ".join(exact + [f"{c}{v}" for v in range(n)]) for c, n in (("f", 0), ("g", 11), ("h", 12))]
    sets = [shingle_set(t) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])]
    want = contract(np.array([a for a, _ in links]), np.array([b for _, b in links]), len(rows))
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), block=8).toPandas().sort_values("doc_id")
    assert got["component_id"].tolist() == want.tolist()
    assert len(links) > 20 and want[-2] == len(rows) - 3 and want[-1] != want[-3]


def test_parities_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for k in range(300):
        n = int(rng.integers(1, 3000))
        shared = rng.integers(0, 2**63, n, dtype=np.uint64)
        extra = rng.integers(0, n // 2 + 2, 2)
        a, b = (np.unique(np.append(shared, rng.integers(0, 2**63, m, dtype=np.uint64))) for m in extra)
        if len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b)):
            want.append((2 * k, 2 * k + 1))
        for i, x in enumerate((a, b)):
            wide = simhash._parity(x, max(1024, 1 << (2 * len(x) - 1).bit_length()))
            rows.append((2 * k + i, len(x), simhash._parity(x, 1024).tolist(), wide.tolist() if len(wide) > 16 else None))
    distinct = spark.createDataFrame(rows, "node long, n int, parity array<long>, wide array<long>")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(300)], "a long, b long")
    got = {(r.a, r.b) for r in simhash._likely(pairs, distinct, 80).collect()}
    assert set(want) <= got and len(got) < 1.3 * len(want)


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64)) for b in np.repeat(base, 12)]
    crowd = [base[0] ^ np.uint64(v) for v in range(300)]
    fp = np.unique(np.concatenate([base, near, crowd]).astype(np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    got = {r.node: r.component for r in components(simhash.link_fingerprints(df, block=64)).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    label = contract(i, j, len(fp))
    want: dict[int, set] = {}
    mine: dict[int, set] = {}
    for k, v in enumerate(fp.view(np.int64).tolist()):
        want.setdefault(int(label[k]), set()).add(v)
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_pivot_filter_never_discards_a_near_pair():
    rng = np.random.default_rng(3)
    pivots = simhash.Pivots()
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x.copy()
    for k in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    a, b = pivots.table(x).astype(int), pivots.table(y).astype(int)
    assert np.abs(a - b).max() <= 4
    assert (pivots.keys(pivots.table(x)) == pivots.keys(pivots.table(y))).any(1).all()


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (205, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[205] == 203


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 32))
    near = np.repeat(x, 20, 0) + 0.03 * rng.normal(size=(800, 32))
    crowd = x[0] + 0.02 * rng.normal(size=(700, 32))
    v = np.concatenate([x, near, crowd, x[:10]]).astype(np.float32)
    label = np.arange(len(v)) % 2
    df = spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = caps.near_vectors(df, block=128).toPandas().sort_values("vec_id")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(g, False)
    assert got["n_links"].tolist() == g.sum(1).tolist()
    i, j = np.nonzero(np.triu(g))
    assert got["component_id"].tolist() == contract(i, j, len(v)).tolist()


@pytest.mark.parametrize("dims", [3, 64, 384])
def test_sketches_lose_no_pair(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(4000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * turn
    sketch = caps.Sketch(dims)
    a, b = sketch.of(x).astype(float), sketch.of(y).astype(float)
    assert (np.square(a - b).sum(1) <= caps.Sketch.reach(0.98)).all()
    if dims > 3:
        assert (np.square(a - np.roll(a, 1, 0)).sum(1) <= caps.Sketch.reach(0.98)).mean() < 0.01


def test_near_vectors_at_the_edge(spark):
    """Pairs just above and below 0.98, each to be linked or not; one label in groups of one direction."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = np.where(np.arange(600) % 2 == 0, 0.9805, 0.9795)[:, None]
    v = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * turn]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), "a") for i, r in enumerate(v)], "vec_id long, embedding array<float>, label string")
    got = caps.near_vectors(df).toPandas().set_index("vec_id")["component_id"].sort_index()
    linked = got.loc[600:].to_numpy() == np.arange(600)
    assert linked[::2].mean() >= 0.99 and not linked[1::2].any()


def test_lists_hold_all_exceeding_directions():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = caps.ProductCode(16, parts=2, words=32)
    every = (code._half(x, range(1))[:, :, None] + code._half(x, range(1, 2))[:, None, :]).reshape(50, -1)
    for row, got in zip(every, code.decode(x, 2.5, 6), strict=True):
        limit = min(2.5 * np.sqrt(2 / 16), np.sort(row)[-6])
        assert got.tolist() == np.flatnonzero(row >= limit).tolist()


@pytest.mark.parametrize("reach", [0, 1, 3, 16])
def test_probes_find_all_codes_within_the_radius(reach):
    rng = np.random.default_rng(6)
    words = rng.integers(0, 2**63, (400, 2), dtype=np.uint64)
    words[100:200] = words[0] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2)).astype(np.uint64))
    parts = words.view(np.uint16).astype(np.int64)
    found = set()
    for j in range(8):
        index = hashing_search.SubstringIndex(parts[:, j], 16)
        rows = index.probe(int(parts[0, j]), reach)
        assert sorted(rows.tolist()) == np.flatnonzero(np.bitwise_count(parts[:, j] ^ parts[0, j]) <= reach).tolist()
        assert index.probed == len(rows) and (reach > 1 or index.probed < 250)
        found.update(rows.tolist())
    distance, _ = hashing_search.apart(words, words[:1])
    assert set(np.flatnonzero(distance <= 8 * (reach + 1) - 1)) <= found


def test_search_of_clusters_probes_few_rows_and_ties_go_by_id(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 32))
    x = (np.repeat(centers, 40, 0) + 0.15 * rng.normal(size=(2400, 32))).astype(np.float32)
    x[1000:1400] = x[7]  # a large group of copies, asked by many
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = hashing_search.nearest(df, df.where("vec_id % 50 = 0"), k=5, block_rows=256).toPandas()
    u = x.astype(np.float64)
    n = np.sqrt((u * u).cumsum(1)[:, -1])
    hits = 0
    for q, part in got.groupby("query_id"):
        s = (u * u[q]).cumsum(1)[:, -1] / (n * n[q])
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:5]) & set(part["vec_id"]))
        if 1000 <= q < 1400:
            assert part.sort_values("rank")["vec_id"].tolist() == [i for i in (7, *range(1000, 1010)) if i != q][:5] and part["score"].nunique() == 1
    assert len(got) == 5 * len(x[::50]) and hits >= 0.95 * len(got)
    codes = hashing_search.fit(df.select(F.col("embedding").alias("v")), 5)[32]
    words = codes.of(u / n[:, None]).view(np.uint16).astype(np.int64)
    probed = sum(len(hashing_search.SubstringIndex(words[:, j], 16).probe(int(words[0, j]), codes.reach)) for j in range(16))
    assert codes.reach <= 3 and probed < 0.3 * 16 * len(x)


def test_search_recall(spark):
    got = queries.QUERIES["op1_multi_index_hashing"](spark, DATA).toPandas()
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY 1").df()
    x = np.stack(e["embedding"]).astype(float)
    n = np.linalg.norm(x, axis=1)
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q] / (n * n[q])
        s[q] = -2
        hits += len(set(np.argsort(-s, kind="stable")[:5]) & set(part["vec_id"]))
        assert np.allclose(part.sort_values("rank")["score"], s[part.sort_values("rank")["vec_id"]], atol=1e-12)
    assert hits >= 0.9 * len(got) and len(got) == 5 * len(x[::50])


def test_languages_held_out(spark, texts):
    got = queries.QUERIES["op5_language_id"](spark, DATA).toPandas().merge(texts, on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]


def test_features_do_not_depend_on_cuts(monkeypatch):
    text = "Über den Zäunen läuft der Fuchs, 12 mal! " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert np.array_equal(whole, langid.features(text))
    assert langid.features("12 ... 3") is None


def test_toxicity_held_out(spark):
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df()
    got = queries.QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").toPandas().merge(labels, on="doc_id")
    held = got[got["held_out"]]
    right = held[held["toxic"] == 1]
    assert right["predicted"].mean() > 0.75 and held[held["toxic"] == 0]["predicted"].mean() < 0.03


def test_grammar_marks_scopes():
    o, t, n, r, i, h = toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.THREAT
    run = toxicity.GRAMMAR.run
    assert run([t, o, i]) == [t, o, i + toxicity.AIMED]
    assert run([n, o, h]) == [n, o, h + toxicity.NEGATED]
    assert run([n, o, o, o, i])[-1] == i
    assert run([r, t, n, i])[-1] == i + (toxicity.REPORTED | toxicity.AIMED | toxicity.NEGATED)
    # a negated report is a denial: what it says is reported and negated, however far it stands
    assert run([n, r, o, o, o, o, i]) == [n, toxicity.DENIAL, o, o, o, o, i + (toxicity.REPORTED | toxicity.NEGATED)]
    assert run([r, o, o, o, o, i])[-1] == i + toxicity.REPORTED


def test_each_machine_changes_scores():
    model, text = toxicity.Model(), "they never said you are an idiot"
    full = model.score(model.features(text))
    assert full < model.score(model.features("you are an idiot"))
    parts = {"negation": toxicity.negation(), "reporting": toxicity.reporting(), "aiming": toxicity.aiming()}
    for left_out, told in (("negation", text), ("reporting", text), ("aiming", "you i kill")):
        a, b = (m for name, m in parts.items() if name != left_out)
        assert model.score(model.features(told, a.compose(b))) != model.score(model.features(told))
    once, twice = model.features("you idiot and idiot"), model.features("you idiot. you idiot")
    assert once.max() < twice.max()  # clauses count, not words


def test_threats_are_learned(spark):
    name = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}x"
    rows = [(i, f"{name(i)} i will zerbl {name(i)} and {name(i)} quexy {name(i + 1)}", 1) for i in range(150)] + [(1000 + i, f"and i will go {name(i)}", 0) for i in range(150)]
    insults, threats = toxicity.learn_patterns(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert any(w.startswith("zerb") for w in threats) and any(w.startswith("quex") for w in insults) and not any(w.startswith("zerb") for w in insults)


def plain_targets(size, weight):
    """Targets by resharing the excess in rounds."""
    left, target, capped = sum(size), [0.0] * len(size), [False] * len(size)
    for _ in range(len(size) + 1):
        rest = left - sum(3 * s for s, c in zip(size, capped) if c)
        total = sum(w for w, c in zip(weight, capped) if not c)
        target = [3 * s if c else rest * w / total for s, w, c in zip(size, weight, capped)]
        over = [not c and t > 3 * s for s, t, c in zip(size, target, capped)]
        if not any(over):
            return target
        capped = [a or b for a, b in zip(capped, over)]
    return target


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    got = mixing.targets(pd.DataFrame({"source": [f"s{i:02d}" for i in range(len(sizes))], "size": sizes}))
    assert np.allclose(got["target"], plain_targets(sizes, [1 + i % 3 for i in range(len(sizes))]))


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 0, 37, 5])
    split = mixing.split_quotas(quotas, 7, 1)
    assert split.sum(0).tolist() == quotas.tolist() and np.ptp(split.sum(1)) <= 2
    assert (split == mixing.split_quotas(quotas, 7, 1)).all()


def test_mixture_meets_targets_with_disjoint_blocks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    runs, figures = mixing.mixture(docs)
    got = mixing.taken(runs, figures).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by["taken"] - by["target"]) <= 0.01 * by["size"] + 2).all()
    block = runs.groupBy("source", "index").agg(F.countDistinct("shard").alias("shards")).where("shards > 1")
    assert block.count() == 0
    over = runs.groupBy("row_key", "pass").agg(F.sum("n_words").alias("n"), F.max("size").alias("size")).where("n > size")
    assert over.count() == 0


def plan_of(docs, seed=42):
    """Sources in order, their block lengths and quotas, in plain Python."""
    docs = docs.assign(size=[len(t.split()) for t in docs["text"]])
    plan = mixing.targets(docs.groupby("source", as_index=False)["size"].sum())
    block = [min(max(n // 1024, 1), 256) for n in plan["size"]]
    quota = [min(round(t / b), 3 * -(-n // b)) for t, b, n in zip(plan["target"], block, plan["size"])]
    return plan["source"].tolist(), block, quota


def test_mixture_against_plain_python(spark, texts):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    runs, figures = mixing.mixture(df)
    got = mixing.taken(runs, figures).toPandas().set_index("doc_id")["taken"]
    key = df.select("doc_id", "source", mixing.row_key("doc_id", "text", "source").alias("k"), *(F.xxhash64(mixing.row_key("doc_id", "text", "source"), F.lit(1).cast("long"), F.lit(p), F.lit(42)).alias(f"h{p}") for p in range(3))).toPandas()
    size = {i: len(t.split()) for i, t in zip(texts["doc_id"], texts["text"])}
    want = dict.fromkeys(size, 0)
    for source, block, quota in zip(*plan_of(texts)):
        own = key[(key["source"] == source) & (key["doc_id"].map(size) > 0)]
        per_pass = -(-sum(size[i] for i in own["doc_id"]) // block)
        for p in range(3):
            left = max(0, min(quota - p * per_pass, per_pass)) * block
            for _, _, _, i in sorted((int(h) >> 20 & 63, int(h), int(k), i) for h, k, i in zip(own[f"h{p}"], own["k"], own["doc_id"])):
                want[i] += min(left, size[i])
                left -= min(left, size[i])
    assert got.to_dict() == want


def test_shards_hold_what_the_tree_gives_them(spark, texts, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    names, _, quota = plan_of(texts)
    split = mixing.split_quotas(np.array(quota), 4, 42)
    held = mixing.mixture(df, shards=4)[0].groupBy("source", "shard").agg(F.countDistinct("index").alias("n")).collect()
    assert {(r.source, r.shard): r.n for r in held} == {(names[j], i): int(split[i, j]) for i in range(4) for j in range(len(names)) if split[i, j]}
    places = mixing.mixture(df, shards=4)[0].where("source = 'src_00'" if "src_00" in names else F.lit(True)).orderBy("source", "index").select("shard").toPandas()["shard"]
    assert (np.diff(places) < 0).any()  # a shard's blocks are not one slice of the stream
    before = [r.doc_id for r in mixing.mixed_documents(df, shards=4).collect()]
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: np.array([q // 2, q * 0, q * 0, q * 0]))
    after = [r.doc_id for r in mixing.mixed_documents(df, shards=4).collect()]
    assert len(after) < len(before) and mixing.mixture(df, shards=4)[0].where("shard > 0").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 50))
def test_blocks_are_permuted(n, seed):
    factor, shift = mixing.bijection(n, [seed])
    assert sorted((factor * i + shift) % n for i in range(n)) == list(range(n))


@pytest.mark.parametrize("name", ["op4_line_templates", "op9_chat_round_trip"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    key = list(want.columns)
    assert sorted(map(tuple, got[key].astype(str).to_numpy())) == sorted(map(tuple, want[key].astype(str).to_numpy()))


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.columns == list(texts.columns)
        kept[name] = docs.toPandas()
    assert set(kept["language_id"]["doc_id"]) == set(texts["doc_id"])
    assert kept["line_dedup"]["text"].notna().all()
    left = kept["simhash_near_dedup"]

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    s = [shingles(t) for t in left["text"]]
    alike = sum(len(a & b) >= 0.9 * len(a | b) for i, a in enumerate(s) for b in s[:i])
    assert alike == 0
    before = [shingles(t) for t in kept["line_dedup"]["text"]]
    gone = [x for x, i in zip(before, kept["line_dedup"]["doc_id"], strict=True) if i not in set(left["doc_id"])]
    assert all(max(len(g & a) / len(g | a) for a in s) > 0.4 for g in gone)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, DATA)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, DATA).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
