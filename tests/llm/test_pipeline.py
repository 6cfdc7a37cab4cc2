"""The pipeline against a plain Python version, on documents with null and repeated ids, repeated rows and odd texts."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestone.llm import quality_rules  # noqa: E402
from lodestone.llm.common import materialize, token_path, words_of  # noqa: E402

from test_near_copies import _set  # noqa: E402
from test_operators import _base, _kneser_ney, _targets  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, _row int, _doc string, position int, component string"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("", "na", "te", "so", "vi") for c in ("n", "r", "s", "l")]


def _text(dice, n):
    words = [dice.choice(WORDS) for _ in range(n)]
    return ".\n".join(" ".join(words[k : k + 9]) for k in range(0, n, 9))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and labels as Parquet, and the plain rows."""
    dice, out = random.Random(12), tmp_path_factory.mktemp("corpus")
    rows = [(i, _text(dice, dice.randint(60, 260)), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(150)]
    for k in range(0, 30, 3):  # near copies, some under the id of another document or none
        words = rows[k][1].split(" ")
        words[len(words) // 2] = "kavil"
        rows.append(((300 + k, 1, None)[k % 3 if k % 2 else 0], " ".join(words), "en", f"s{k % 4}"))
    rows += [(None, _text(dice, 120), "en", "s1") for _ in range(6)] + [(7, _text(dice, 130), "en", "s2") for _ in range(3)]
    rows += [(None, _text(dice, 90), None, None)] * 2 + [(400, rows[4][1], "en", "s3")] * 3
    rows += [(500, None, "en", "s0"), (501, "", None, "s0"), (502, "%&# zq " * 60, "en", "s0"), (503, "Qz##|| " * 90, "en", "s1"), (504, " ".join(WORDS[:40]), "en", "s1"), (505, "kan kan " * 100, "fr", "s2")]
    bad = {502, 503, 505}
    labels = [(i, 0 if i in bad else 1, 0) for i in [*range(120), *bad]] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame([(i, t, la, s, len(t or ""), 1, 2, "x", 3, "y") for i, t, la, s in rows], COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows, labels


def _classified(spark, rows, labels):
    """Rows that the model of trusted text keeps, by plain counts."""
    good = {i for i, y, toxic in labels if i is not None and y and not toxic} - {i for i, y, _ in labels if y == 0}
    held = {r.id for r in spark.range(600).where("pmod(xxhash64(id), 10) >= 8").collect()}
    p, n = _kneser_ney([(t or "").encode() for i, t, _, _ in rows if i in good and i not in held]), 5

    def bits(text):
        raw = text.encode()
        return -sum(np.log2(max(p((b"\0" * (n - 1) + raw)[k : k + n]), 1e-12)) for k in range(len(raw))) / len(raw)

    of = {t: bits(t) for t in {t for _, t, _, _ in rows if t}}
    at = lambda values, share: sorted(values)[max(0, math.ceil(share * len(values)) - 1)]
    shown = [(la, of[t], math.sqrt(len(t.encode()))) for i, t, la, _ in rows if i in good & held and t]
    middle = at([b for _, b, _ in shown], 0.5)
    most = at([(b - middle) * root for _, b, root in shown], 0.995)  # no language has 50 held-out documents
    return [r for r in rows if r[1] and of[r[1]] <= middle + most / math.sqrt(len(r[1].encode())) + 1e-9]


def _near_kept(rows):
    sets, top = [_set(t) for _, t, _, _ in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    groups = defaultdict(list)
    for row, t in zip(rows, top):
        groups[t].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _mixed(rows):
    """Rows as often as the mix takes them."""
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t or ""))
    target, out = _targets(sizes), []
    place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    for s in sizes:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (place(r[0]), r[0] is not None, r[0] or 0, len(words_of(r[1]))))
        whole, start = int(target[s] // sizes[s]), 0
        for r in own:
            n = len(words_of(r[1]))
            out += [r] * (whole + (start + n / 2 <= target[s] - whole * sizes[s]))
            start += n
    return out


def _plain(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_match_plain_versions(spark, folder):
    path, rows, labels = folder
    docs, marks = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    order = lambda rs: Counter(map(repr, rs))
    stages = dict(corpus_pipeline.STAGES)
    schema = docs.schema

    docs = materialize(stages["quality_classifier"](spark, docs, path), "t1")
    want = _classified(spark, rows, labels)
    assert docs.schema == schema and order(_plain(docs)) == order(want) and 140 < len(want) < len(rows)

    trees = quality_rules.train(docs, marks)
    good = lambda t: (b := _base(t))[0] >= 50 and 100 * b[4] <= 50 * b[0] and trees.probability(np.array([quality_rules.statistics(t)[1]]))[0] >= 0.5
    want = [r for r in want if good(r[1])]
    docs = materialize(stages["quality_rules"](spark, docs, path), "t2")
    assert docs.schema == schema and order(_plain(docs)) == order(want)

    want = _near_kept(want)
    docs = materialize(stages["simhash_near_dedup"](spark, docs, path), "t3")
    assert docs.schema == schema and order(_plain(docs)) == order(want)
    assert sum(r[0] is None for r in want) >= 6 and sum(r[0] == 7 for r in want) >= 3

    want = _mixed(want)
    docs = materialize(stages["source_mixing"](spark, docs, path), "t4")
    found = _plain(docs)
    assert docs.schema == schema and len(found) == len(want) and sum(len(words_of(r[1])) for r in found) == sum(len(words_of(r[1])) for r in want)
    ids = lambda rs: Counter(r[0] for r in rs if r[0] not in (None, 7))  # noqa: E731  ties by id are taken in the order of files
    assert ids(found) == ids(want)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in stages["packing"](spark, docs, path).collect():
        pieces[r.sequence_id].append(r)
    total = Counter()
    for parts in pieces.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
            total[r.doc_id, r.start, r.length, r.ids_crc32] += 1
        assert end <= 2048 and end & (end - 1) == 0
    assert sum(n * k[2] for k, n in total.items()) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, _, _ in found)
    encoded = defaultdict(list)
    for i, t, _, _ in found:
        encoded[i].append([*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    assert all(any(zlib.crc32(np.array(e[s : s + n], dtype="<u4").tobytes()) == crc for e in encoded[i]) for i, s, n, crc in total)


def test_sequences_follow_the_training_order(spark, folder):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows, but several files
    docs = materialize(dict(corpus_pipeline.STAGES)["source_mixing"](spark, spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 200 and doc_id <> 7 and doc_id <> 1"), ""), "t5")
    at = docs.selectExpr("doc_id", "cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as long) part").collect()
    parts = defaultdict(set)
    for r in at:
        parts[r.doc_id].add(r.part)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.part for r in at}) > 1
    for r in dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").collect():
        assert r.sequence_id >> 44 in parts[r.doc_id]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
