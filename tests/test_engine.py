"""Files to index to answers, and the retrieval operators against plain versions."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

import samples
from lodestone import cli
from lodestone.functions import constants as c
from lodestone.functions import questions as q
from lodestone.operators import documents as d
from lodestone.operators import ranked, rerank, shards, vectors
from lodestone.plans import engine, index
from lodestone.session import scratch_table
from lodestone.sources import files, web


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    samples.write_all(root / "raw")
    (root / "raw/markdown/copy.md").write_text(samples.NOTE.upper() + "  \n", encoding="utf-8")
    (root / "raw/markdown/ignored.txt").write_text("no")
    (root / "raw/markdown/empty.md").write_text(" \n")
    (root / "raw/word/broken.docx").write_bytes(b"not a zip")
    result = index.build(spark, str(root / "raw"), str(root / "index"), str(root / "processed"))
    return root, result


def test_build(spark, built):
    root, result = built
    assert {k: result[k] for k in ("documents", "indexed_documents", "chunks", "skipped", "duplicates")} == {"documents": 5, "indexed_documents": 4, "chunks": 4, "skipped": 2, "duplicates": 1}
    assert [tuple(r) for r in index.duplicate_rows(spark, str(root / "index")).collect()] == [("markdown/tides.md", "markdown/copy.md")]
    ids = {r["file_path"]: r["doc_id"] for r in index.Index(spark, str(root / "index")).table("documents").collect()}
    assert ids == {"excel/metals.xlsx": "doc_0001", "markdown/copy.md": "doc_0002", "markdown/tides.md": "doc_0003", "pdf/rivers.pdf": "doc_0004", "word/volcano.docx": "doc_0005"}
    lines = [json.loads(x) for f in sorted((root / "processed/chunks.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["chunk_id"] for x in lines] == ["doc_0001_0001", "doc_0002_0001", "doc_0004_0001", "doc_0005_0001"] and set(lines[0]) == {"chunk_id", "doc_id", "chunk_index", "file_name", "file_path", "file_type", "embedding_model", "text"}


def test_sources_report(spark, built):
    report = index.sources(spark, str(built[0] / "index"))
    assert report["indexed"] and report["documents"] == 5 and report["duplicates"] == 1
    assert [(s["file_path"], s["chunk_count"]) for s in index.source_rows(spark, str(built[0] / "index")).collect()][1:3] == [("markdown/copy.md", 1), ("markdown/tides.md", 0)]
    assert index.sources(spark, str(built[0] / "nothing"))["indexed"] is False


def test_ask(spark, built):
    result = engine.ask(spark, str(built[0] / "index"), "Where does a delta form?")
    assert result["source_type"] == "knowledge_base" and result["sources"][0]["file"] == "rivers.pdf" and result["answer"].startswith(c.ANSWER_PREFIX)
    assert result["citations"][0]["quote"] == result["sources"][0]["citation"] and result["embedding_model"] == c.MODEL_LABEL
    assert engine.ask(spark, str(built[0] / "index"), "zzzz qqqq")["source_type"] == "none"
    assert engine.ask(spark, str(built[0] / "nothing"), "x")["answer"] == c.NO_INDEX
    many = engine.answers(spark, str(built[0] / "index"), [(7, "P waves and S waves"), (3, "火山灰")])
    assert "travel through solids" in many[0]["answer"] and many[1]["sources"][0]["file"] == "volcano.docx"


def test_cli(spark, built, capsys):
    root = built[0]
    assert cli.main([], spark) == 1
    assert cli.main(["sources", "--index", str(root / "index")], spark) == 0
    assert cli.main(["ask", "delta river", "--no-web", "--index", str(root / "index")], spark) == 0
    assert '"source_type": "knowledge_base"' in capsys.readouterr().out


def test_rebuild_refuses_other_folders(spark, built, tmp_path):
    with pytest.raises(RuntimeError):
        index.rebuild(spark, str(built[0] / "raw"), str(tmp_path / "elsewhere"), str(built[0] / "processed"), str(built[0]))
    again = index.rebuild(spark, str(built[0] / "raw"), str(built[0] / "index"), str(built[0] / "processed"), str(built[0]))
    assert again["rebuilt"] and again["documents"] == 5


def test_readers(tmp_path):
    assert files.read_text("﻿a\r\nb".encode()) == "a\nb" and files.read_text("中文".encode("gb18030")) == "中文"
    samples.docx(tmp_path / "a.docx", ["x"], "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:p/>")
    assert files.read_docx((tmp_path / "a.docx").read_bytes()) == "x\na\tb\nc"
    samples.xlsx(tmp_path / "a.xlsx")
    assert files.read_xlsx((tmp_path / "a.xlsx").read_bytes()).splitlines() == ["工作表 sheet1", "id | metal | melting_C", "A1 | tin | 232", "A2 | lead | 327", "inline | 7 | "]
    samples.pdf(tmp_path / "a.pdf", [r"a \(b\)", "c"])
    assert files.read_pdf((tmp_path / "a.pdf").read_bytes()).splitlines() == [r"a \(b\)", "c", "last", "word"]
    with pytest.raises(ValueError):
        files.read_document("odt", b"")


def test_duplicates_need_no_order(spark):
    rows = [(3, "c", "A b"), (1, "a", "ab"), (2, "b", "x")]
    found = {r["n"]: r["duplicate_of"] for r in d.mark_duplicates(spark.createDataFrame(rows, "i int, n string, text string"), "i", "n").collect()}
    assert found == {"a": None, "b": None, "c": "a"}


def retrieval(spark, texts):
    """The rows and the posting lists of texts, whose numbers are their chunk numbers."""
    chunks = scratch_table(spark.createDataFrame(list(enumerate(texts)), "chunk_no long, text string").repartition(3), "chunks")
    placed = shards.placed(chunks)
    made = {"rows": shards.rows(shards.sizes(placed)), "vectors": shards.vectors(placed, vectors.embed(chunks, key="chunk_no")), "tokens": shards.tokens(placed), "runs": shards.runs(placed), "chunks": chunks}
    made = {name: df if name == "chunks" else scratch_table(df, name) for name, df in made.items()}
    return made["rows"], made


def test_bm25_matches_sqlite(spark):
    texts = ["red fox jumps", "the red red fox", "Café user_id red", "fox red", "产生ATP和 red", "nothing here", "user id fox"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, search_text, tokenize='unicode61')")
    for x in texts:
        grams = [run[i : i + n] for run in q._cjk_run.findall(x) for n in (2, 3, 4) for i in range(len(run) - n + 1)]
        db.execute("insert into t values (?, ?)", (x, x + "\n" + " ".join(grams)))
    rows, lists = retrieval(spark, texts)
    asked = [(0, "red fox"), (1, "cafe user_id"), (2, "ATP"), (3, "产生"), (4, "?!")]
    found = ranked.bm25_topk(spark.createDataFrame(asked, "qid long, question string"), rows, lists["tokens"]).collect()
    for qid, text in asked:
        try:
            want = {i - 1: round(s, 6) for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (q.fts_query(text),))}
        except sqlite3.OperationalError:
            want = {}
        assert {r["chunk_no"]: round(r["fts_rank"], 6) for r in found if r["qid"] == qid} == want


def test_sparse_dot_and_parse(spark):
    df = spark.createDataFrame([("[[3,0.25],[5,0.5]]", "[[5,2.0]]"), ("", "[[1,1]]"), ("bad", None)], "a string, b string")
    found = [r[0] for r in df.select(vectors.sparse_dot(vectors.parse_embedding(F.col("a")), vectors.parse_embedding(F.col("b")))).collect()]
    assert found == [1.0, 0.0, 0.0]


def test_fusion_and_gates(spark):
    rows = spark.createDataFrame([(1, "a", -1.5, 0.5, 3, 1), (1, "b", None, 0.0, 6, 2), (1, "c", -3.0, 0.5, 3, 3), (2, "d", None, 0.1, 0, 1)], "qid long, chunk_no string, fts_rank double, semantic_score double, term_score int, arrival long")
    found = {r["chunk_no"]: r["rerank_score"] for r in rerank.fuse(rows).collect()}
    assert found == {"a": 0.482, "b": 0.34, "c": 0.455, "d": 0.048}
    better = {r["chunk_no"]: r["rerank_score"] for r in rerank.fuse(rows, corrected=True).collect()}
    assert better["c"] > better["a"]
    assert {r["chunk_no"] for r in rerank.gate(rerank.fuse(rows)).collect()} == {"a", "c"}


PAGE = '<div><a class="result__a" href="//duckduckgo.com/l/?uddg=http%3A%2F%2Fa.b">A &amp; <b>B</b></a><div class="result__snippet">one two</div><a class="result__a" href="http://lost">no snippet</a><a class="result__a" href="http://c.d">C</a><a class="result__snippet">three</a></div>'
LISTING = "1.  ## [First](https://www.bing.com/ck/a?u=a1aHR0cDovL2EuYg)\n\nsome text\n2.  ## [Second](http://x.y)\nmore"


def test_web_parsers():
    assert web.parse_results(PAGE) == [{"title": "A & B", "url": "http://a.b", "snippet": "one two"}, {"title": "C", "url": "http://c.d", "snippet": "three"}]
    assert web.parse_listing(LISTING) == [{"title": "First", "url": "http://a.b", "snippet": "some text"}, {"title": "Second", "url": "http://x.y", "snippet": "more"}]


def test_web_cascade():
    def recorded(pages):
        def get(url):
            for part, body in pages.items():
                if part in url:
                    return body
            raise OSError("unreachable")

        return get

    titles = json.dumps(["q", ["T"], [""], ["http://t"]])
    found = web.web_search("tides", get=recorded({"opensearch": titles, "summary": json.dumps({"extract": "about tides"})}))
    assert found["answer"] == c.WEB_PREFIX + "about tides。" and found["web_search_used"] and found["sources"][0]["url"] == "http://t"
    assert web.web_search("tides", get=recorded({"duckduckgo": PAGE}))["sources"][0]["title"] == "A & B"
    assert web.web_search("tides", get=recorded({"jina": LISTING}))["sources"][1]["title"] == "Second"
    assert web.web_search("tides", get=recorded({"duckduckgo": "<p>"}))["answer"] == c.WEB_NOTHING
    assert web.web_search("tides", get=recorded({}))["answer"].startswith(c.WEB_FAILED)
