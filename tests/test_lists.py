"""Vectors and posting lists against plain versions, and that no row of a term or cell is shuffled for them."""

from __future__ import annotations

from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import questions as q
from lodestone.functions import text as t
from lodestone.operators import shards, vectors
from test_ranked import TEXTS


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('lists')}/chunks"
    spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS[-150:], "ab", "光合作用 光", None])], "chunk_no long, text string").repartition(2).write.parquet(path)
    return shards.placed(spark.read.parquet(path))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def unfolded(row, name: str) -> list:
    return np.cumsum(row[name]).tolist()


def test_rounding_is_that_of_spark(spark):
    values = [1 / 128, -1 / 128, 3 / 128, 0.1234565, -0.1234565, 0.9999995, 0.5, 1 / 3, 4.9999999e-7, 0.0, *np.random.default_rng(2).normal(size=500).tolist()]
    want = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert vectors._rounded(np.array(values), 6).tolist() == want


def test_native_vectors_and_their_lists(spark, placed):
    made = vectors.embed(placed, "native", "chunk_no", also=("shard", "place"))
    assert "Exchange" not in plan(made) and "Generate" not in plan(shards.vectors(made))

    def vector(text) -> dict:
        sums: Counter = Counter()
        for term in q.embedding_terms(text or ""):
            value = q.md5_hash(term)
            sums[value % 384] += (1 if value >> 8 & 1 else -1) * (8 + min(len(term), 8)) / 8
        norm = sum(v * v for v in sums.values()) ** 0.5
        return {i: w for i, v in sums.items() if (w := float(Decimal(repr(v / norm)).quantize(Decimal("1e-6"), ROUND_HALF_UP)))}

    rows, cells = made.join(placed.select("chunk_no", "text"), "chunk_no").collect(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["place"]):
        assert [(b["idx"], b["w"]) for b in r["embedding"]] == sorted(vector(r["text"]).items())
        for b in r["embedding"]:
            cells[r["shard"], b["idx"]].append((r["place"], b["w"]))
    found = {(r["shard"], r["dim"]): r for r in shards.vectors(made).collect()}
    assert {k: list(zip(unfolded(r, "steps"), r["weights"])) for k, r in found.items()} == cells
    assert all((r["high"], r["low"]) == (max(r["weights"]), min(r["weights"])) for r in found.values())


def test_token_and_run_lists(spark, placed):
    assert "Generate" not in plan(shards.tokens(placed)) and "Generate" not in plan(shards.runs(placed))
    runs = F.array_distinct(F.concat(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all("text", F.lit(f"(?=({t.CJK}{{2}}))"), F.lit(1))))
    tokens, held, sizes = defaultdict(list), defaultdict(list), {}
    for r in placed.select("shard", "place", t.index_tokens(t.searchable_text(F.col("text"))).alias("tokens"), F.size(t.index_tokens(F.col("text"))).alias("n"), runs.alias("runs")).orderBy("place").collect():
        sizes[r["shard"], r["place"]] = (r["n"], r["n"] and r["n"] + len(r["tokens"]))
        for pos, x in enumerate(r["tokens"] or []):
            tokens[r["shard"], x].append((r["place"], pos))
        for x in r["runs"] or []:
            held[r["shard"], x].append(r["place"])

    def positions(row) -> list:
        out, places = [], unfolded(row, "steps")
        for i, gap in enumerate(row["gaps"]):
            out.append((places[i], gap + (out[-1][1] if i and places[i] == places[i - 1] else 0)))
        return out

    assert {(r["shard"], r["token"]): positions(r) for r in shards.tokens(placed).collect()} == tokens
    assert {(r["shard"], r["run"]): unfolded(r, "steps") for r in shards.runs(placed).collect()} == held
    assert {(r["shard"], r["place"]): (r["n_text"], r["n_tokens"]) for r in shards.sizes(placed).collect()} == sizes


def test_texts_of_ascii_alone_take_short_ways_to_the_same(spark):
    texts = ["  a \t b\r\n\r\n\r\n\r\nc\x1c", "A_b9-C\x1fd", "\tx", "", "a  b", "É a\u0085b  ", " ab　", "été X"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i")
    space, x = r"[\s\x1c-\x1f]", F.col("x")
    folded = F.lower(F.regexp_replace(F.translate(x, *t._folds()), r"\p{M}+", ""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\r\n|\r", "\n"), "[ \t]+", " "), "\n{3,}", "\n\n")
    want = df.select(F.regexp_replace(plain, rf"(?U)^{space}+|{space}+\z", ""), F.sha2(F.lower(F.regexp_replace(x, rf"(?U){space}+", "")), 256), F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))).collect()
    assert [tuple(r) for r in df.select(t.normalize_text(x), t.content_hash(x), t.index_tokens(x)).collect()] == [tuple(r) for r in want]
