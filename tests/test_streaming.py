from __future__ import annotations

import shutil

from lodestone.streaming.ingest import stream_index


def _add(spark, source, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)


def _duplicates(spark, out):
    return {r.doc_id: r.duplicate_of for r in spark.read.parquet(f"{out}/documents").collect()}


def test_batches_share_hashes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "A b"), (2, "ab"), (3, None), (4, "x" * 1000), (None, "new")], [(5, "a B"), (6, "new"), (0, "AB"), (7, " \n")]):
        _add(spark, source, rows)
        stream_index(spark, source, out).awaitTermination(120)
    assert _duplicates(spark, out) == {1: None, 2: 1, 4: None, 5: 1, 6: None, 0: 1}  # 0 is smaller, but came later
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted((r.doc_id, r.chunk_index) for r in chunks.collect()) == [(1, 1), (4, 1), (4, 2), (6, 1)]


def test_batch_reads_its_own_files_and_can_be_run_again(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        _add(spark, str(source), [(10 * k + i, f"text {i if i < 3 else 10 * k + i}") for i in range(6)])
        query = stream_index(spark, str(source), out)
        query.awaitTermination(120)
        read = query.lastProgress["numInputRows"] if query.lastProgress else 0
        assert read in (0, 6)
    want = {10 * k + i: (i if i < 3 and k else None) for k in range(3) for i in range(6)}
    assert _duplicates(spark, out) == want
    commits = sorted((tmp_path / "out/progress/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1].name
    for name in (last, f".{last}.crc"):  # as if the driver had been lost before the last batch was done
        (tmp_path / "out/progress/commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / f"out/documents/batch={last}", ignore_errors=True)
    stream_index(spark, str(source), out).awaitTermination(120)
    assert _duplicates(spark, out) == want
