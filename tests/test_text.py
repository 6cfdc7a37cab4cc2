"""Column functions, against values worked out by hand and against the single-string versions."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import constants as c
from lodestone.functions import questions as q
from lodestone.functions import text as t
from lodestone.functions import udfs
from lodestone.operators import citations
from lodestone.plans import catalogue


def column(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").coalesce(1)
    return [r[0] for r in df.select(fn(F.col("text")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_normalize_text(spark):
    assert column(spark, t.normalize_text, "a \t b\r\n\r\n\r\nc ", "　x　", None, "") == ["a b\n\nc", "x", None, ""]


def test_content_hash(spark):
    found = column(spark, t.content_hash, "A b\n", "ab", "a　B")
    assert set(found) == {"fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"}


@pytest.mark.parametrize(("text", "lengths"), [
    ("x" * 600 + "\n\n" + "y" * 298, [900]),
    ("x" * 600 + "\n\n" + "y" * 299, [600, 299]),
    ("a" * 1000, [900, 220]),
    ("a" * 500 + "." + "b" * 600, [501, 720]),
    ("a" * 1400 + "." + "b" * 99, [900, 621, 219]),
    ("", []),
    ("short", [5]),
])
def test_chunk_lengths(spark, text, lengths):
    (found,) = column(spark, t.chunk_text, text)
    assert [len(x) for x in found] == lengths


def test_chunks_cover_long_text(spark):
    text = " ".join(f"w{i}." if i % 7 == 0 else f"w{i}" for i in range(3000))
    (found,) = column(spark, t.chunk_text, text)
    assert max(map(len, found)) <= 900 and all(f"w{i}" in " ".join(found) for i in range(3000))


def test_overlap_must_be_under_half():
    with pytest.raises(ValueError):
        t.split_long(F.lit("a"), 100, 50)


def test_terms(spark):
    assert column(spark, t.embedding_terms, "café ATP 光合作") == [["caf", "atp", "光合", "合作", "光合作"]]
    assert column(spark, t.searchable_text, "a光合作b") == ["a光合作b\n光合 合作 光合作"]
    assert column(spark, t.index_tokens, "Café user_id 产生ATP和 Ñandú 12") == [["cafe", "user", "id", "产生atp和", "nandu", "12"]]
    assert q.embedding_terms("café ATP 光合作") == ["caf", "atp", "光合", "合作", "光合作"]


@pytest.mark.parametrize(("term", "idx", "weight"), [("atp", 23, -1.375), ("光合", 114, -1.25), ("hello_1", 186, -1.875)])
def test_hash(term, idx, weight):
    value = q.exact_hash(term)
    assert value % c.DIMS == idx and (1 if value >> 8 & 1 else -1) * (1 + min(len(term), 8) / 8) == weight


def test_candidate_terms():
    assert q.candidate_terms("光合作用") == ["光合作用", "合作用", "光合作", "合作", "光合"]
    assert q.fts_query("光合作用") == '"光合作用" OR "合作用" OR "光合作" OR "合作" OR "光合"'
    assert q.candidate_terms("Carbon Cycle now")[0] == "Carbon Cycle now" and "二氧化碳" in q.candidate_terms("carbon")
    assert "pass through" in q.candidate_terms("穿过岩石") and q.fts_terms("?! ") == ["?!"] and q.fts_query("") == '""'
    assert len(q.candidate_terms("一二三四五六七八九十甲乙")) == 32  # the shortest are left out


def test_keyword_score(spark):
    terms = q.candidate_terms("光合作用")
    assert q.keyword_score("光合作用。", terms) == 7
    df = spark.createDataFrame([("光合作用。", terms), ("x", []), ("The CELL", ["cell", "the", "zz"])], "text string, terms array<string>")
    assert [r[0] for r in df.select(t.keyword_score(F.col("text"), F.col("terms"))).collect()] == [7, 0, 4]


CLEAN = ["# T\n- a *b* [x](u) &amp; 1. c", "a\n2) b  `c`", "[[x](y) z", "**", "plain", "  \t#### h # - \n", "1. x\n\n* y_z ~w~"]


def test_human_text(spark):
    assert q.human_text(CLEAN[0]) == "T a b x & 1. c"
    clean = lambda x: t.human_text(udfs.unescape(x))
    assert column(spark, clean, *CLEAN) == [q.human_text(x) for x in CLEAN]
    assert column(spark, lambda x: t.human_text(x, 5), "abcdefghij", "abcd efgh") == ["abcd…", "abcd…"]
    assert column(spark, t.trim_terminal, "好的。！ ") == ["好的"] and q.trim_terminal("好的。！ ") == "好的"


def test_sentences(spark):
    texts = ["A cat sat. They ran. B dog.", "摘要\n甲乙。什么是丙？如何做。ok! done; x.y z.", "# 关键机制\n- a b. c\n\nd?"]
    split = lambda x: t.split_sentences(udfs.unescape(x))
    assert column(spark, split, *texts) == [q.split_sentences(x) for x in texts]
    assert q.split_sentences(texts[0]) == ["A cat sat.", "They ran.", "B dog."]


def test_simplified(spark):
    assert q.to_simplified("量子通訊與網線") == "量子通信与网线"
    assert column(spark, t.to_simplified, "量子通訊與網線") == ["量子通信与网线"]


def test_citation(spark):
    text = "A cat sat. They ran. Is it a cat? A dog."
    long = "cat " * 200
    cases = [(text, "cat", "A cat sat。"), (text, "ran cat", "A cat sat。 A cat sat。 They ran。"), (text, "zebra", text), ("P waves are fast. S waves are slow. Other.", "P waves and S waves", "P waves are fast. S waves are slow."), ("They cat. x", "cat", "They cat。"), ("", "cat", ""), (long, "cat", (long[:359].rstrip() + "…")), ("a &amp; cat; dog", "dog", "dog。")]
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i int, text string, question string").withColumn("terms", udfs.candidate_terms("question"))
    assert [r["citation"] for r in citations.with_citation(rows).orderBy("i").collect()] == [want for *_, want in cases]
    lists = [["a.", "", "b。", "c"], [], [""], ["甲。", "乙。", "丙", "丁"]]
    found = citations.with_answer(spark.createDataFrame(list(enumerate(lists)), "i int, citations array<string>")).orderBy("i").collect()
    assert [r["answer"] for r in found] == ["根据本地知识库，a；b。", c.NO_EVIDENCE, c.NO_EVIDENCE, c.ANSWER_PREFIX + "甲；乙；丙。"]


def test_exact_embedding(spark):
    """The registered query against hashes computed term by term."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["chunk_id"]: r["text"] for r in catalogue.queries()["chunk_documents"](spark, sf_dir).collect()}
    want = {(k, i, w) for k, x in texts.items() for i, w in plain_vector(x)}
    assert {tuple(r) for r in catalogue.queries()["exact_embedding"](spark, sf_dir).select("chunk_id", "idx", "w").collect()} == want


def plain_vector(text):
    sums = [0.0] * 384
    for term in re.findall("[a-z0-9_]{2,}", text.lower()):
        value = int(hashlib.blake2b(term.encode(), digest_size=8).hexdigest(), 16)
        sums[value % 384] += (1 if value & 256 else -1) * (1 + min(8, len(term)) / 8)
    norm = sum(x * x for x in sums) ** 0.5
    return [(i, round(x / norm, 6)) for i, x in enumerate(sums) if x and norm]


def test_answers_and_web_query():
    assert q.web_query("量子纠缠如何用于加密？") == "量子纠缠 加密" and q.web_query("plain words") == "plain words"


def test_urls(spark):
    links = ["//duckduckgo.com/l/?uddg=http%3A%2F%2Fa.b%2Fc&x=1", "http://a.b/", "https://duckduckgo.com/l/?x=1"]
    assert column(spark, t.unwrap_redirect, *links) == ["http://a.b/c", "http://a.b/", links[2]]
    links = ["https://www.bing.com/ck/a?u=a1aHR0cDovL2EuYg", "http://x.y/?u=a1aHR0cDovL2EuYg", "https://www.bing.com/ck/a?u=b1x"]
    assert column(spark, t.unwrap_bing, *links) == ["http://a.b", links[1], links[2]]


def test_vectors_have_unit_length():
    v = q.vector("some words 光合作用 and more")
    assert abs(sum(x * x for x in v.values()) - 1) < 1e-9 and q.vector("!") == {}
