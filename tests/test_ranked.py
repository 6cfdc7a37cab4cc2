"""Pruned retrieval against plain scores of every chunk."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import questions as q
from lodestone.operators import documents as d
from lodestone.operators import ranked, shards
from test_engine import retrieval

rng = random.Random(4)
SYLLABLES = "ka to mi ren sol ve ing the er a_b x9 光合 作用 呼吸 二氧化碳 Café É K".split()


def words(n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


TEXTS = [words(rng.randint(1, 60)) + rng.choice(["", "\n", ". "]) for _ in range(900)]
TEXTS += [TEXTS[0]] * 40 + ["", " ", "ka", "KA to\nmi", "ka  to", "ren sol ve " * 200]
ASKED = [(i, rng.choice(TEXTS)[:200]) for i in range(20)] + [(50, ""), (51, None), (52, "?!"), (53, "ka to mi"), (54, "二氧化碳 光合作用"), (55, "KA TO"), (56, "carbon dioxide"), (57, "zzz"), (58, TEXTS[0])]


@pytest.fixture(scope="module")
def made(spark):
    return retrieval(spark, TEXTS)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "qid long, question string")


def best(scores: dict, k: int, digits: int) -> list:
    order = sorted(scores, key=lambda i: (-round(scores[i], digits), i))
    return [(i, round(scores[i], 6)) for i in order if round(scores[i], digits) > 0][:k]


def listed(found, column: str, sign: int = 1) -> dict:
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["qid"], r["pos"])):
        out.setdefault(r["qid"], []).append((r["chunk_no"], round(sign * r[column], 6)))
    return out


@pytest.mark.parametrize(("rows", "block"), [(shards.SHARD_ROWS, None), (50, 600)])
def test_keywords_and_vectors_by_brute_force(spark, asked, monkeypatch, rows, block):
    monkeypatch.setattr(shards, "SHARD_ROWS", rows)
    if block:
        monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    table, lists = retrieval(spark, TEXTS)
    keyword = listed(ranked.keyword_topk(asked, table, lists["runs"], lists["chunks"]), "term_score")
    assert listed(ranked.keyword_topk(asked, table, lists["runs"], lists["chunks"], scan_terms=0), "term_score") == keyword
    semantic = listed(ranked.semantic_topk(asked, table, lists["vectors"]), "semantic_score")
    stored = [q.vector(x, digits=6) for x in TEXTS]
    for qid, text in ASKED:
        terms = q.candidate_terms(text or "")
        assert keyword.get(qid, []) == best({i: q.keyword_score(x, terms) for i, x in enumerate(TEXTS)}, 15, 0), qid
        vector = q.vector(text or "")
        want = best({i: sum(w * v.get(k, 0.0) for k, w in vector.items()) for i, v in enumerate(stored)}, 25, 12)
        assert semantic.get(qid, []) == want, qid


def test_blocks_of_questions_give_the_same_ranks(spark, made, asked, monkeypatch):
    rows, lists = made
    whole = listed(ranked.bm25_topk(asked, rows, lists["tokens"]), "fts_rank")
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 200)
    assert listed(ranked.bm25_topk(asked, rows, lists["tokens"]), "fts_rank") == whole and len(whole) > 15


def test_phrases_by_positions(spark, made):
    rows, lists = made
    phrases = [["ka"], ["ren", "sol"], ["sol", "ve", "ren"], ["ka", "to"], ["nothing", "here"]]
    found: dict = {}
    for r in ranked.phrase_hits(phrases, rows, lists["tokens"]).collect():
        found[r["term"]] = found.get(r["term"], 0) + sum(r["counts"])
    import re

    def count(text, phrase):
        tokens = [w for w in re.findall(r"[^\W_]+", text.lower().replace("é", "e"))]
        return sum(tokens[i : i + len(phrase)] == phrase for i in range(len(tokens)))

    grams = lambda text: [run[i : i + n] for run in q._cjk_run.findall(text) for n in (2, 3, 4) for i in range(len(run) - n + 1)]
    for term, phrase in enumerate(phrases):
        assert found.get(term, 0) == sum(count(x, phrase) + count(x + "\n" + " ".join(grams(x)), phrase) for x in TEXTS)


def test_few_rows_are_scored():
    """A row that shares one common list with the question isn't scored once better ones are known."""
    keys = np.arange(50_000)
    common, rare = np.arange(50_000), np.arange(0, 50_000, 100)
    held = ranked.Best(25, 9)
    ranked.search([(common, np.full(50_000, 0.1), 0.1), (rare, np.full(500, 2.0), 2.0)], keys, held)
    assert held.keys.tolist() == [100 * i for i in range(25)] and held.scored < 10_000


def test_share_of_rows_scored(spark):
    """On documents: under a fifth of the pairs of question and chunk are scored in full."""
    from lodestone.plans import catalogue

    sf_dir = "/root/testdata/sf0.01"
    asked = [(r["qid"], r["question"]) for r in catalogue._questions(spark, sf_dir).collect()]
    rows, lists = (catalogue._lists(spark, sf_dir, name) for name in ("rows", "vectors"))
    chunks, _ = ranked.corpus_stats(rows)
    share = ranked.share_scored(ranked.vector_hits(asked, rows, lists, 25, "native"), len(asked), chunks)
    assert 0 < share < 0.2


def test_numbers_of_files_and_chunks(spark):
    paths = [f"{a}/{b}.md" for a in ("a", "a-", "b c", "é", "") for b in range(30)] + ["z"]
    rng.shuffle(paths)
    found = d.number_files(spark.createDataFrame([(p, 1) for p in paths], "file_path string, x int").repartition(7))
    assert [r["file_path"] for r in found.orderBy("doc_no").collect()] == sorted(paths, key=lambda p: p.split("/"))
    assert sorted(r["doc_no"] for r in found.collect()) == list(range(1, len(paths) + 1))
    number = shards.chunk_no(F.col("a"), F.col("b"))
    df = spark.createDataFrame([(1, 2), (10_000, 1), (2_000, 12_345)], "a long, b int").select(shards.chunk_id_of(number).alias("id"), number.alias("no"))
    assert [r["id"] for r in df.orderBy("no").collect()] == ["doc_0001_0002", "doc_2000_12345", "doc_10000_0001"]
