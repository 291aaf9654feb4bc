"""Queries against their SQL on small tables of odd values."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.operators import books, search
from quire.operators import passages as passing
from quire.operators.numbering import SORTED, parts_for
from quire.plans import validating
from quire.sources import sections
from tests.test_queries import DATA, rows


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, data in tables.items():
        pq.write_table(pa.table(data), f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
    return got


TEXTS = [
    "CIÓN NBOADO!!\nÉRÉ, OUENÈ!!\nÑMI LA LOS", "ÉTÉ +5 xp中level 4   must", "\x0bMANA: 5\n\x0bSTATS OF ALL\nx", "　 Skill\x0b  rank  ", "plain", "",
]


@pytest.mark.parametrize("name", ["prefilter_score", "prefilter_select", "prefilter_summary", "prefilter_preview"])
def test_signals_beyond_ascii(spark, tmp_path, name):
    same(spark, tmp_path, name, documents={"doc_id": list(range(len(TEXTS))), "source": ["s"] * len(TEXTS), "text": TEXTS})


def test_pages_with_open_references(spark, tmp_path):
    html = ["<h1>Gest&&amp</h1><p>a&ampb &amp;amp; &copy &middot;&</p>", "<h1>T</h1>x & y &quot;&amp;quot;"]
    got = same(spark, tmp_path, "page_texts", pages={"page_id": [1, 2], "html": html})
    assert sorted(got.title) == ["Gest&&amp", "T"]
    assert sections.html_text("<p>&#65;&#x42; &eacute;&nosuch; &#65 &notit;</p>")[1] == "AB é&nosuch; &#65 &notit;"


def test_page_texts_by_the_marks_of_their_sql(spark, tmp_path):
    html = ["<h1>No. 555-</h1>555-<b>0123</b> a&nbsp;b &lt;c", "x\u00a0 y\t\tz\x0b", "<h1>zz</h1>", "<h1>aa</h1>longer text", "<script>open < 5 <h2\n>T<i>i</i> &amp;\n t</h3>", "p<script>q</style >r<!-- s", ""]
    got = same(spark, tmp_path, "page_texts", pages={"page_id": [1, 2, 4, 4, 5, 6, 7], "html": html})
    assert len(got) == 6 and set(got.title) == {"No. 555-", "", "zz", "Ti & t"}


def test_page_texts_of_nulls(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array([None, None, 1, 1, 2], pa.int64()), "html": ["<h2>a</h2>", "b-\nb", None, "c", None]}), f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.sql(catalog.ORACLES["page_texts"]).fetchall()}
    got = [tuple(r) for r in catalog.QUERIES["page_texts"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 and {r[0]: r[1:] for r in got} == want and want[2] == (None,) * 3


def test_vectors_rounded_in_single_precision(spark, tmp_path):
    values = ((np.arange(640) - 320 + 0.5) / 1000).astype(np.float32).reshape(10, 64)
    same(spark, tmp_path, "vector_write_back", embeddings={"vec_id": pa.array(range(10), pa.int64()), "label": pa.array([0] * 10, pa.int32()), "embedding": pa.array(list(values), pa.list_(pa.float32()))})


def test_searches_in_small_slices(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    asked = table.where("vec_id < 20").selectExpr("vec_id AS question", "embedding AS vector")
    whole = sorted(search.top_of_questions(table, asked, 7).collect())
    monkeypatch.setattr(search, "HELD", 64)
    assert sorted(search.top_of_questions(table, asked, 7).collect()) == whole and len(whole) == 140
    unit = lambda v: np.array(v) / (np.sqrt(np.dot(v, v)) or 1)
    for q in range(20):
        best = sorted((-round(float(unit(vectors[q][1]) @ unit(v)), 9), i) for i, v in vectors if v is not None)[:7]
        assert [(-round(r.score, 9), r.position) for r in whole if r.question == q] == best


def test_passages_in_small_slices(spark, monkeypatch):
    texts = [" ".join(f"w{i * j}" for j in range(3000)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(passing, "HELD", 2000)
    got = sorted(passing.passages(df).collect())
    assert got == sorted((i, n, a, b, t[a:b].strip()) for i, t in enumerate(texts) for n, (a, b) in enumerate(passing.windows(t)))


def test_replies_of_one_file_are_read_by_many_tasks(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    assert part.rdd.getNumPartitions() == 1
    assert validating._items(part, "rules", {"name": F.col("p_name")}, "p_partkey").rdd.getNumPartitions() == 8


def test_united_rows_in_more_ranges_and_without_payload(spark):
    rows = spark.createDataFrame([(1, i, "x", "kept") for i in range(9)], "book int, id long, payload string, status string")
    assert parts_for(9, rows) == 8 and parts_for(100 * SORTED + 1, rows) == 101
    places = spark.createDataFrame([(1, 0)], "book int, place int")
    got = books.united(rows, places, [-F.col("id")], only=["id"])
    assert got.columns == ["id", "ord"] and {(r.id, r.ord) for r in got.collect()} == {(i, 8 - i) for i in range(9)}


def test_every_order_names_somebody(spark):
    assert catalog.QUERIES["known_people"](spark, DATA).count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
