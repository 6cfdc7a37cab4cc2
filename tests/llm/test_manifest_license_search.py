"""Merkle manifest, license scan and ranked search against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodestone.llm import license_scan, merkle, queries, wand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, pos long, total long, node string, path string, block int, template int, n long, _id int"


def table(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, n, 1, 2, "x", "y", 3, 4, 5, 6) for i, t, lang, s, n in rows], COLUMNS)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each node the (left, right) siblings level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k : k + 16]
            for j in range(len(run)):
                for i in owners[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(digest("".join(run)))
            held.append([i for o in owners[k : k + 16] for i in o])
        nodes, owners = up, held
    return nodes[0], paths


def plain_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, crown = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, crown):
        for r, path in zip(own, paths):
            node, whole = leaf(r, r[1]), path + above
            folded = node
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                folded = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for left, right in whole:
                folded = digest(left + folded + right)
            out.append((r[0], node, subroot, root, digest("".join(a + b for a, b in whole)), folded, folded == root))
    return out


ODD = [(900, None, None, None, None), (901, "", "", "", 0), (None, "No Id", "en", "s0", 5), (None, "no id", "en", "s0", 5), (902, "X" * 300_000, "en", "s1", 300_000), (903, "Éa ÉB\x00 z", "fr", "é", 7), (904, "same", "en", "s1", 4), (904, "same", "en", "s1", 4), (905, "lone Row", "en", "only", 8)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_manifest_of_odd_rows_and_many_shapes(spark):
    rng = random.Random(3)
    sizes = {"a1": 1, "a2": 2, "a16": 16, "a17": 17, "a256": 256, "a257": 257, "hot": 4_500}  # hot: three traversals, last runs of one
    rows = [(i, f"Text {i} {rng.random()}", "en", s, i) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(20_000 + i, f"T{i}", "de", f"small{i}", 2) for i in range(40)]  # sources enough for two levels
    rows += ODD
    rng.shuffle(rows)
    found = merkle.verify(merkle.manifest(table(spark, rows).repartition(5)))
    assert in_order(map(tuple, found.collect())) == in_order(plain_manifest(rows))


def test_manifest_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_PATHS", 0)
    rows = [(i, f"Row {i}", "en", "s", 1) for i in range(600)] + [(i, "u", "en", None, 1) for i in range(600, 620)]
    assert in_order(map(tuple, merkle.verify(merkle.manifest(table(spark, rows))).collect())) == in_order(plain_manifest(rows))


def test_manifest_paths_fold_to_the_root(spark):
    rows = [(i, f"Row {i}", "en", f"s{i % 3}", 1) for i in range(400)]
    for r in merkle.manifest(table(spark, rows)).collect():
        node = r["leaf"]
        for level in r["path"]:
            node = digest(level["others"][: level["at"]] + node + level["others"][level["at"] :])
        assert node == r["root"]


def test_manifest_changes_with_one_row(spark):
    rows = [(i, f"Row {i}", "en", f"s{i % 3}", 1) for i in range(100)]
    root = lambda rs: merkle.manifest(table(spark, rs)).first()["root"]
    changed = [*rows[:50], (50, "row 50", "en", "s2", 1), *rows[51:]]
    assert root(rows) == root(rows[::-1]) != root(changed)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert merkle.verify(merkle.manifest(empty)).collect() == []
    assert license_scan.scan(empty).collect() == []
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert wand.search(empty, items).collect() == []
    assert wand.search(table(spark, ODD), items.limit(0)).collect() == []


def license_words(text):
    return re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    words, found = license_words(text), []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_license_base_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["under the MIT license", "Under-the\nMIT_License", "apache license, version 2.0", "CC BY-NC", "cc by nc cc by nc", "under the", "mit license", "étoile", "a b c", "apache license version", "ver 2", "UNDER THE MİT LICENSE"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "en", "s", 1) for i in range(300)] + ODD
    rows += [(950, "cc by nc " * 20_000, "en", "s", 1), (951, "under the mit license", "en", "s", 1), (951, "under the mit license", "en", "s", 1)]
    want = []
    for i, text, *_ in rows:
        n, places = base_places(text)
        want.append((i, n, len(places), places[0][0] if places else None, max(p for p, _ in places) if places else None, ",".join(sorted({label for _, label in places}))))
    got = license_scan.scan(table(spark, rows).repartition(4)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert in_order(map(tuple, got)) == in_order(want)


def test_license_notices_with_changed_words(spark):
    notice = license_scan.NOTICES[0][0].split()
    gpl = license_scan.NOTICES[5][0]
    changed, put_in, half = notice.copy(), notice.copy(), notice[: len(notice) // 2]
    changed[10] = "work"
    put_in[14:14] = ["gratis"]
    around = lambda words: "river stone morning " * 30 + " ".join(words) + " garden light water " * 30
    rows = [(1, around(notice), "en", "s", 1), (2, around(changed), "en", "s", 1), (3, around(put_in), "en", "s", 1), (4, around(half), "en", "s", 1), (5, around(reversed(notice)), "en", "s", 1), (6, around(notice) + around(gpl.upper().split()), "en", "s", 1), (7, "of this software and associated documentation", "en", "s", 1)]
    got = {r["doc_id"]: r for r in license_scan.scan(table(spark, rows)).collect()}
    assert [got[i]["labels"] for i in range(1, 8)] == ["mit", "mit", "mit", "", "", "gpl,mit", ""]
    assert got[1]["score"] == 1.0 and 0.8 <= got[2]["score"] < 1 and 0.8 <= got[3]["score"] < 1 and got[4]["score"] == 0
    assert all(r["n_base"] == 0 and r["base_labels"] == "" for r in got.values())


def test_license_rejects_short_templates(spark):
    with pytest.raises(ValueError):
        license_scan.scan(table(spark, ODD), phrases=(("mit license", "mit"),))


def ranked(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    size, total, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * size // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scores += [(-s, i is None, i or 0)] * (s > 0)
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("shard", [1, 500, wand.SHARD])
def test_search_by_brute_force(spark, shard):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "a1", "B2"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "-", "_"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(rng.randrange(10_000), text(rng.randint(1, 80))) for _ in range(1_500)]
    docs += [(20_000 + k, docs[0][1]) for k in range(30)][::-1]  # ties
    docs += [(None, docs[0][1]), (5, None), (6, ""), (7, "!?"), (30_000, "w1 " * 50_000), (30_001, "W1 w2"), (30_001, "W1 w2")]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(90, docs[0][1]), (91, None), (92, "unknown words"), (93, "w1 w1 w1 w2"), (94, "É"), (None, "w3 w4"), (95, "w59")]
    frame = table(spark, [(i, t, "en", "s", 1) for i, t in docs]).repartition(6)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    got = wand.search(frame, asked, block_bytes=900, shard=shard).collect()  # several blocks of queries
    assert in_order(map(tuple, got)) == in_order(ranked(docs, items))


def test_search_skips_documents():
    """Documents that can't reach the threshold aren't pivots: only some are scored."""
    import pyarrow as pa

    rng = random.Random(1)
    rows = [{"doc_id": i, "n": 20, "terms": [0, *rng.sample(range(2, 40), 3)] + [1] * (i < 12), "counts": [1] * (4 + (i < 12))} for i in range(20_000)]
    part = wand.Shard(pa.Table.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])), 20_000, 400_000)
    scored, plain = [], part._at
    part._at = lambda span, docs: (scored.append(len(docs)), plain(span, docs))[1]
    best = part.search([(0, 1), (1, 8_000)], [])
    assert [i for *_, i in best] == list(range(10))
    assert sum(scored) < 2_000


def test_queries_equal_their_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name in ("op11_merkle_manifest", "op12_license_scan", "op13_wand_search"):
        got = queries.queries()[name](spark, sf_dir)
        want = db.sql(queries.oracle_sql()[name])
        columns = got.columns
        assert in_order(map(tuple, got.collect())) == in_order(want.project(", ".join(columns)).fetchall()), name


def test_license_scan_is_native(spark):
    plan = license_scan.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
