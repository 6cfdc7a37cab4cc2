"""The pipeline's near-duplicate stage against brute force at a Jaccard similarity of 0.8."""

from __future__ import annotations

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestone.llm import near_copies  # noqa: E402


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    sets, top = [_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return sorted({min(i for (i, _), t in zip(rows, top) if t == k) for k in top})


def test_stage_matches_brute_force(spark):
    dice = random.Random(7)
    word = lambda: f"w{dice.randint(0, 5000)}"
    texts = []
    for size in (12, 40, 120, 400):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(base)
            for changes in (0, 1, size // 60, size // 40, size // 20):  # from copies to well below the threshold
                copy = list(base)
                for at in dice.sample(range(size), changes):
                    copy[at] = word()
                texts.append(copy)
        head = [word() for _ in range(size)]  # a passage that many share
        texts += [head + [word() for _ in range(size // 3)] for _ in range(10)]
    chain = [word() for _ in range(100)]
    for i in range(12):  # neighbours are near copies, the ends are not
        texts.append(chain[i * 5 :] + [word() for _ in range(i * 5)] if i else chain)
    rows = list(enumerate(map(" ".join, texts)))
    dice.shuffle(rows)
    rows += [(9000, ""), (9001, None), (9002, "two words"), (9003, "Two  words"), (9004, "two other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == _kept(sorted(rows))


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "d e f"), (None, "a b c"), (None, "x y z"), (None, "x y z"), (2, "d e f"), (None, "p q r")]
    docs = spark.createDataFrame([(i, t, 7, "q") for i, t in rows], "doc_id long, text string, _row int, component string")
    found = near_copies.keep_one(docs)
    assert sorted((r.text, r.doc_id) for r in found.collect()) == [("a b c", 1), ("d e f", 1), ("p q r", None), ("x y z", None)] and found.columns == docs.columns
    assert near_copies.keep_one(docs.where("false")).count() == 0


@pytest.mark.parametrize(("shared", "own"), [(60, 40), (200, 30), (90, 14)])
def test_common_passages_cost_no_pairs(spark, shared, own):
    """Many texts of one passage and some words of their own, at a Jaccard of up to 0.79: nothing is linked, and none of their pairs is looked at."""
    dice = random.Random(3)
    passage = [f"w{dice.randint(0, 10**6)}" for _ in range(shared)]
    rows = [(i, " ".join(passage + [f"v{dice.randint(0, 10**9)}" for _ in range(own)])) for i in range(400)]
    a, b = (set(near_copies.shingles(t).tolist()) for _, t in rows[:2])
    assert len(a & b) / len(a | b) < 0.8
    docs = spark.createDataFrame([(i, i, 0, t) for i, t in rows], "key long, root long, x int, text string")
    sets = spark.createDataFrame([(i, near_copies.shingles(t).view("int64").tolist()) for i, t in rows], "key long, found array<long>")
    nodes = docs.join(sets, "key").selectExpr("key", "cast(size(found) as long) n", "root")
    assert near_copies._meetings(near_copies._prefixes(nodes, sets)).count() == 0
    assert near_copies.keep_one(docs.selectExpr("key doc_id", "text")).count() == 400


def test_prefixes_lose_no_pair(spark):
    """Sets of all sizes: every pair at the threshold meets by a shingle of both's prefixes."""
    dice = random.Random(6)
    base = [[dice.randint(1, 400) for _ in range(dice.randint(1, 60))] for _ in range(12)]
    sets = [sorted({*(x for x in dice.choice(base) if dice.random() < 0.95), *(dice.randint(1, 400) for _ in range(dice.randint(0, 5)))} | {0}) for _ in range(250)]
    rows = [(i, len(s), i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, n long, root long, found array<long>")
    pairs = {(r.u, r.v) for r in near_copies._rare_pairs(df.select("key", "n", "root"), df.select("key", "found")).collect()}
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    assert len(near) > 100 and near <= pairs


def test_parity_bits_lose_no_link(spark):
    """Sets differ in at least as many shingles as parity bits, and the filter keeps all pairs at the threshold."""
    dice = np.random.default_rng(3)
    rows = []
    for n in (1, 9, 90, 900, 9_000):
        for cut in (0, n // 18, n // 9, n // 5, n):
            a = dice.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate((a[cut:], dice.integers(0, 1 << 63, cut, dtype=np.uint64)))
            bits = [near_copies._parity(s) for s in (a, b)]
            differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
            assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
            both = len(set(a.tolist()) & set(b.tolist()))
            rows.append((both >= near_copies.THRESHOLD * (2 * n - both), n, n, *[s.tolist() for s in bits]))
    kept = spark.createDataFrame(rows, "near boolean, n long, m long, a array<long>, b array<long>")
    found = kept.select("near", near_copies._near("a", "b", "n", "m").alias("passed")).collect()
    assert all(r.passed for r in found if r.near) and any(r.near for r in found)
    assert any(not r.passed for r in found)


def _edited(dice, base, edits):
    """The base with so many words replaced, far enough apart for each to change five shingles."""
    words = list(base)
    for k in range(edits):
        words[5 + dice.randrange(len(base) // edits // 5 - 1) * 5 + k * (len(base) // edits)] = f"x{dice.randint(0, 10**9)}"
    return " ".join(words)


def _star(spark, dice, edits):
    """Sets (key, n, root, found, parity) of a text, number 0, and of others with so many words replaced."""
    base = [f"w{dice.randint(0, 10**6)}" for _ in range(100)]
    texts = [" ".join(base)] + [_edited(dice, base, e) for e in edits]
    found = [near_copies.shingles(t) for t in texts]
    rows = [(i, len(s), i, s.view("int64").tolist(), near_copies._parity(s).tolist()) for i, s in enumerate(found)]
    sets = spark.createDataFrame(rows, "key long, n long, root long, found array<long>, parity array<long>")
    return [set(s.tolist()) for s in found], sets.select("key", "n", "root"), sets.select("key", "found", "parity")


def test_linked_copies_cost_no_pairs(spark):
    """150 linked copies of one text (Jaccard to it 0.81) and 150 others of it (0.73): neither those of one root nor those too far for their sizes meet."""
    _, nodes, sets = _star(spark, random.Random(9), [2] * 150 + [3] * 150)
    nodes = nodes.selectExpr("key", "n", "if(key <= 150, 0L, key) root")
    assert near_copies._meetings(near_copies._prefixes(nodes, sets)).count() <= 300


def test_leads_join_copies_before_pairs_do(spark, monkeypatch):
    """Copies of one text, none of them linked yet: the links are those of brute force, and few pairs meet for them."""
    dice, met, crossed = random.Random(4), [], near_copies._crossed
    found, nodes, sets = _star(spark, dice, [dice.randint(1, 4) for _ in range(250)])

    def counted(groups):
        rows = crossed(groups)
        met.append(rows.count())
        return rows

    monkeypatch.setattr(near_copies, "_crossed", counted)
    links = [(r.u, r.v) for r in near_copies._rest(nodes, sets).collect()]
    near = [(i, j) for i, a in enumerate(found) for j, b in enumerate(found[:i]) if len(a & b) >= 0.8 * len(a | b)]
    assert set(links) <= set(near) and len(near) > 1000 and sum(met) <= 4 * len(found)

    def classes(pairs):
        top = list(range(len(found)))
        for a, b in pairs:
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    assert classes(links) == classes(near)
