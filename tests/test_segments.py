"""An index that follows its files, against one that is built anew."""

from __future__ import annotations

import os
import random

from lodestone.operators import shards
from lodestone.plans import engine, index

WORDS = "delta river tide moon ash lava basalt granite wave crust mantle plate fault ocean trench ridge sand silt 潮汐 火山".split()


def _text(seed, n=260):
    gen = random.Random(seed)
    return f"# Note {seed}\n\n" + " ".join(gen.choice(WORDS) + ("." if k % 9 == 8 else "") for k in range(n))


def _write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def _state(spark, where, ranked=True):
    """What a reader can see of an index: documents, chunks and, if `ranked`, answers."""
    held = index.Index(spark, where)
    docs = sorted((r.doc_id, r.file_path, r.content_hash, r.duplicate_of) for r in held.table("documents").collect())
    chunks = sorted((r.chunk_no, r.chunk_id, r.text) for r in held.table("chunks").collect())
    skipped = sorted((r.file_path, r.error) for r in held.table("skipped").collect())
    if not ranked:
        return docs, chunks, skipped
    asked = spark.createDataFrame([(1, "where does a river delta form?"), (2, "lava and ash of basalt"), (3, "火山 潮汐"), (4, "note 5"), (5, "changed quartz")], "qid long, question string")
    found = sorted((r.qid, r.rank, r.chunk_no, round(r.rerank_score, 6)) for r in engine.hybrid(engine.open_corpus(held), asked).collect())
    return docs, chunks, skipped, found


def test_updates_answer_like_a_new_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_ROWS", 4)
    raw, where = tmp_path / "raw", str(tmp_path / "index")
    for k in range(12):
        _write(raw, f"a/n{k:02d}.md", _text(k))
    _write(raw, "b/copy.md", _text(3).upper())
    _write(raw, "b/empty.md", " \n")
    (raw / "b/bad.docx").write_bytes(b"not a zip")
    index.update(spark, str(raw), where)  # nothing there yet: a build
    first = {r.segment for r in index.Index(spark, where).table("segments").collect()}

    _write(raw, "a/n00b [x]{y}*.md", _text(100))  # numbers of all later files move
    _write(raw, "b/copy2.md", _text(100).upper())
    counts = index.update(spark, str(raw), where)
    assert (counts["documents"], counts["duplicates"], counts["skipped"]) == (15, 2, 2)
    held = {r.segment: r.whole for r in index.Index(spark, where).table("segments").collect()}
    assert first < set(held) and held[min(first)] and len(held) == 2  # lists of the first build are read as they are

    os.remove(raw / "a/n03.md")  # its copy takes its place
    _write(raw, "a/n05.md", _text(5) + " changed quartz.")
    _write(raw, "b/empty.md", "no longer empty")
    index.update(spark, str(raw), where)
    index.build(spark, str(raw), str(tmp_path / "anew"))
    assert _state(spark, where) == _state(spark, str(tmp_path / "anew"))

    assert index.prune(spark, where) >= 2
    before = index.Index(spark, where).table("segments").collect()
    index.update(spark, str(raw), where)  # nothing has changed
    assert index.Index(spark, where).table("segments").collect() == before
    assert _state(spark, where, False) == _state(spark, str(tmp_path / "anew"), False)


def test_merging_keeps_segments_few():
    live, written = {}, 0
    for k in range(2_000):
        new = 1 + k % 3
        taken = index.merged(live, new)
        n = new + sum(live.pop(s) for s in taken)
        written += n
        live[f"s{k}"] = n
        assert len(live) <= 12
    assert sum(live.values()) == sum(1 + k % 3 for k in range(2_000)) and written <= 12 * sum(live.values())
