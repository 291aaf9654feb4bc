import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.text import citation
from quire.operators.numbering import in_ranges, numbered, numbered_rows
from quire.operators.merging import any_name_match, merge_rules
from quire.operators.passages import passages
from quire.operators.search import top_passages
from quire.sources import sections
from quire.streaming import increments


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "B", "chapters": [{"text": "one", "position": 2}, {"content": "two", "name": "T", "position": 1}, {"text": 5}, {"body": " "}]}')
    (tmp_path / "b.json").write_text('{"text": "x", "url": "u"}\nnot json\n{"text": "y"}\n')
    (tmp_path / "c.json").write_text('[{"text": "p"}, 3, {"text": "q", "title": "Q"}]')
    got = {}
    for r in sections.read_json(spark, str(tmp_path)).collect():
        got.setdefault(r.file[-6:], []).append((r.number, r.title, r.text, r.ref))
    assert sorted(got["a.json"]) == [(1, "T", "two", ""), (2, "Chapter 2", "one", "")]
    assert sorted(got["b.json"]) == [(1, "Chapter 1", "x", "u"), (2, "Chapter 2", "y", "")]
    assert [x[1:3] for x in sorted(got["c.json"])] == [("Chapter 1", "p"), ("Q", "q")]


def test_text_headings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("intro\nChapter 1\nfirst\nmore\nChapter 2: Gate\nsecond")
    got = [(r.number, r.title, r.first, r.last) for r in sections.text_ranges(spark, str(tmp_path)).orderBy("number").collect()]
    assert got == [(1, "Front matter", 0, 0), (2, "Chapter 1", 2, 3), (3, "Chapter 2: Gate", 5, 5)]


def test_paged(spark):
    pages = [(1, i, f"run\nChapter {i}\ntext" if i % 2 else "body") for i in range(1, 8)] + [(2, i, "plain") for i in range(1, 26)]
    df = spark.createDataFrame(pages, "id long, page int, text string")
    got = {(r.id, r.number): (r.title, r.first_page, r.last_page) for r in sections.paged_sections(df, "id").collect()}
    assert got[1, 1] == ("Chapter 1", 1, 2) and got[1, 4] == ("Chapter 7", 7, 7)
    assert got[2, 1] == ("Pages 1-20", 1, 20) and got[2, 2] == ("Pages 21-25", 21, 25)


def test_epub(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<p xmlns="x"><manifest><item id="a" href="b.xhtml"/><item id="c" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="c"/></spine></p>')
        z.writestr("o/a.xhtml", "<html><style>x</style><h1>Two <b>B</b></h1><p>t</p></html>")
        z.writestr("o/b.xhtml", "<html><script>no</script><p>plain &amp; simple</p></html>")
    (tmp_path / "x.epub").write_bytes(box.getvalue())
    got = [(r.ord, r.title, r.text) for r in sections.epub_documents(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(0, "", "plain & simple"), (1, "Two B", "Two B t")]
    (tmp_path / "y.epub").write_bytes(b"PK no archive")
    assert [(r.warning is None, r.text is None) for r in sections.epub_documents(spark, str(tmp_path)).orderBy("file", "ord").collect()] == [(True, False), (True, False), (False, True)]
    (tmp_path / "y.epub").unlink()
    assert [tuple(r)[1:] for r in sections.read_epub(spark, str(tmp_path), least=3).collect()] == [(1, "Chapter 1", "plain & simple", "o/b.xhtml", 3), (2, "Two B", "Two B t", "o/a.xhtml", 3)]
    assert spark.read.format("binaryFile").load(str(tmp_path)).select(sections.sniff(*map(__import__("pyspark").sql.functions.col, ("path", "content"))).alias("k")).first()["k"] == "epub"


def test_folding(spark):
    def fold(words):
        rows = [("b", i, f"t{i}", f"x{i}", f"pages {i}-{i}", w) for i, w in enumerate(words)]
        df = spark.createDataFrame(rows, "id string, ord int, title string, text string, ref string, words long")
        return [(r.title, r.text, r.ref) for r in sections.fold_short(df, "id").orderBy("number").collect()]

    assert fold([10, 200]) == [("t1", "x0\n\nx1", "pages 0-1")]
    assert fold([200, 10]) == [("t0", "x0\n\nx1", "pages 0-1")]
    assert fold([50, 60, 300]) == [("t2", "x0\n\nx1\n\nx2", "pages 0-2")]
    assert fold([10]) == [("t0", "x0", "pages 0-0")]
    assert fold([300, 300]) == [("t0", "x0", "pages 0-0"), ("t1", "x1", "pages 1-1")]


def test_numbering_over_buckets(spark):
    df = spark.range(0, 30_000, 3).selectExpr("id", "if(id % 2 = 0, 'a', null) AS g")
    got = numbered(df, "g", "id").toPandas().sort_values("id")
    for _, part in got.groupby("g", dropna=False):
        assert part["position"].tolist() == list(range(1, len(part) + 1))


def test_ranges_are_blind_to_values(spark):
    """Hashed ids, a hot group and ids crowded in one corner: no range holds more than a few times the mean."""
    df = spark.range(40_000).select(F.xxhash64("id").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    crowded = spark.range(40_000).select(F.when(F.col("id") < 100, F.col("id") * 10**15).otherwise(-F.col("id")).alias("id"), F.lit("one").alias("g"))
    for rows in (df, crowded):
        sizes = in_ranges(rows, "id", "b").groupBy("b").count().toPandas()["count"]
        assert len(sizes) >= 6 and sizes.max() <= 2 * 40_000 / 8
        got = numbered(rows, "g", "id").toPandas().sort_values("id")
        for _, part in got.groupby("g"):
            assert part["position"].tolist() == list(range(1, len(part) + 1))


def test_rows_of_any_order_are_numbered(spark):
    rows = [("a", None, "x"), ("a", "k", "y"), ("a", "k", "y"), (None, "z", "y"), (None, None, None), ("b", "", "")] + [("hot", "same", "same")] * 500
    got = numbered_rows(spark.createDataFrame(rows, "g string, o string, t string"), "g", "o", "t").toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["position"]) == list(range(len(part)))
    assert got[got["g"] == "a"].sort_values("position")["o"].isna().tolist() == [True, False, False]


def test_rule_fold_follows_order(spark):
    rows = [(0, "n", ["A"], "aaaa", "implied", "", "e0", [(1, 1)]), (1, "other", ["a", "N", "b"], "bb", "stated", "f1", "", [(1, 1), (7, 7)]), (2, "n", ["B", "c"], "cc", "stated", "f2", "e2", [(2, 1)]), (3, "n", [], "ddd", "stated", "", "e3", [(2, 2)]), (4, "n", ["A"], "eeeeee", "implied", "f3", "e4", [(3, 1), (1, 1)])]
    df = spark.createDataFrame([("k", "skill", "system", "", *r) for r in rows], "key string, kind string, scope string, applies_to string, ord int, name string, aliases array<string>, statement string, confidence string, formula string, evidence string, citations array<struct<chunk:int,chapter:int>>")
    r = merge_rules(df).first()
    assert (r.statement, r.confidence, r.formula, r.evidence) == ("ddd", "stated", "f1", "e3")
    assert (r.name, r.aliases, [tuple(c) for c in r.citations]) == ("n", ["A", "b", "c"], [(1, 1), (7, 7), (2, 1), (2, 2), (3, 1)])


def test_any_name(spark):
    stored = spark.createDataFrame([(1, "Ann", ["Annie"]), (2, "annie", [])], "id long, name string, aliases array<string>")
    new = spark.createDataFrame([(9, "ANNIE", []), (8, "Zed", [])], "id long, name string, aliases array<string>")
    assert [tuple(r) for r in any_name_match(stored, new).collect()] == [(9, 1)]


def test_jobs_end_once(spark):
    rows = [(1, 1, 10, "queued"), (1, 3, 11, "done"), (1, 4, 12, "running"), (1, 2, 13, "running"), (2, 1, 14, "queued"), (2, 2, 15, "running")]
    df = spark.createDataFrame(rows, "job int, ts int, event_id int, state string")
    assert {r.job: r.state for r in increments.job_states(df).collect()} == {1: "done", 2: "running"}


def test_files_to_cited_search(spark, tmp_path):
    """Text, JSON and EPUB files become sections of one schema, passages under their keys, and cited hits."""
    story = {"Chapter 1": "the lamp burns " * 150, "Chapter 2": "a river runs " * 150}
    (tmp_path / "a.txt").write_text("intro\n" + "\n".join(f"{t}\n{x}" for t, x in story.items()))
    (tmp_path / "b.json").write_text('[{"title": "J", "text": "the moon sets"}]')
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "plain.txt").write_text("only words")
    made = [sections.read(spark, f"{tmp_path}/{p}", k) for p, k in (("*.txt", "txt"), ("b.json", "json"))]
    assert made[0].columns == made[1].columns == ["file", "number", "title", "text", "ref", "words"]
    book = made[0].union(made[1])
    got = sorted((r.file.rsplit("/", 1)[1], r.number, r.title, r.ref, r.words) for r in book.collect())
    assert got == [("a.txt", 1, "Chapter 1", "lines 1-1; lines 2-3", 451), ("a.txt", 2, "Chapter 2", "lines 4-5", 450), ("b.json", 1, "J", "", 3), ("plain.txt", 1, "plain", "whole file", 2)]
    cut = passages(book.withColumnRenamed("number", "section"), ["file", "section"])
    assert dict(cut.dtypes)["file"] == "string" and cut.count() == 2 * 2 + 2
    words = ["lamp", "river", "moon"]
    vectors = cut.withColumn("v", F.array(*(F.regexp_count("text", F.lit(w)).cast("float") for w in words))).join(book.select("file", F.col("number").alias("section"), "title", "ref"), ["file", "section"])
    top = top_passages(vectors.withColumn("at", F.struct("file", "section", "number")), [0.0, 1.0, 0.0], 1, "v", "at")
    cited = top.select("score", citation(F.col("section"), F.col("title"), F.col("ref"), F.col("char_start"), F.col("char_end")).alias("c")).first()
    assert cited.score == 1.0 and cited.c.startswith("ch. 2 · “Chapter 2” · lines 4-5 · chars 0–")


def test_paged_texts(spark):
    pages = [("b", i, f"Chapter {i}\n" + "word " * 130 if i % 2 else "short page") for i in range(1, 8)] + [("s", 1, None), ("s", 2, "two words")]
    df = spark.createDataFrame(pages, "id string, page int, text string")
    got = [(r.id, r.number, r.title, r.ref, r.words) for r in sections.paged_texts(df, "id").orderBy("id", "number").collect()]
    assert got == [("b", i, f"Chapter {2 * i - 1}", f"pages {2 * i - 1}-{min(7, 2 * i)}", 134 if i < 4 else 132) for i in range(1, 5)] + [("s", 1, "Pages 1-2", "pages 1-2", 2)]
    assert sorted(tuple(r) for r in sections.page_report(df, "id").collect()) == [("b", 7, 0, 4 * 132 + 6, False), ("s", 2, 1, 2, True)]
    assert sections.paged_texts(df.where("id = ''"), "id").count() == 0


def test_passages_keep_keys_exactly(spark):
    df = spark.createDataFrame([(2**53 + 1, "a"), (None, "b c"), (5, None)], "doc_id long, text string")
    assert sorted(passages(df).collect(), key=str) == sorted([(2**53 + 1, 0, 0, 1, "a"), (None, 0, 0, 3, "b c")], key=str)
    with pytest.raises(ValueError):
        passages(df.withColumnRenamed("doc_id", "number"), "number")


def test_sniffed_kinds(spark):
    files = [("a.bin", b"%PDF-1"), ("a.txt", b"\xef\xbb\xbf {1}"), ("b.md", b"\xff\xfe"), ("c", b"plain \xc3\xa9"), ("d", b"\xff\xfex"), ("e", b"x\x00"), ("f", b"PK" + b"x" * 5000 + b"o/p.opf"), ("g.txt", b"PK zip"), ("h", b"x" * 4095 + "é".encode()), ("i", b"")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files], "name string, content binary")
    got = {r.name: r.k for r in df.select("name", sections.sniff(F.col("name"), F.col("content")).alias("k")).collect()}
    assert got == {"a.bin": "pdf", "a.txt": "json", "b.md": "txt", "c": "txt", "d": "", "e": "", "f": "epub", "g.txt": "", "h": "txt", "i": "txt"}
