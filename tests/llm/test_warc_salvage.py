"""What the salvage reader keeps of damaged members and of other writers' records."""

from __future__ import annotations

import random
import time

from lodestone.llm import warc


def _records(n=6):
    dice = random.Random(5)
    return [warc.make_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:uuid:{i}>"}, dice.randbytes(30_000)) for i in range(n)]


def _ids(data):
    return [r.headers["warc-record-id"][10:-1] for r in warc.salvage(data).records]


def test_good_records_of_a_damaged_member():
    records = _records()
    spoilt = b"".join([*records[:2], records[2][:-9] + b"?" + records[2][-8:], *records[3:]])
    whole = warc.gzip_member(spoilt)
    found = warc.salvage(whole)
    assert _ids(whole) == list("01345") and found.gaps == [(0, len(whole), "block digest differs")]
    member = warc.gzip_member(b"".join(records))
    tail = warc.gzip_member(records[5])
    cut = member[: len(member) * 7 // 12]
    assert _ids(cut) == list("012") and warc.salvage(cut).gaps == [(0, len(cut), "gzip member not ended")]
    assert _ids(warc.gzip_member(b"".join(records[:5]))[:-8]) == list("01234")  # cut after the last record's bytes
    bad = bytearray(member)
    bad[-6] ^= 1  # the checksum
    assert _ids(bytes(bad) + tail) == list("0123455") and warc.salvage(bytes(bad) + tail).gaps == [(0, len(bad), "bad gzip member")]


def test_records_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"
    made = [
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:a>"}, b"software: x\r\n\r\n"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:b>"}, http + b"body"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:7>", "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(b"else")}, http + b"body"),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:uuid:c>", "WARC-Refers-To": "<urn:uuid:b>"}, http),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.gzip_member(warc.make_record(*m)) for m in made))
    found = {r.record_id: (r.page_id, r.payload_bytes, r.payload and bytes(r.payload), r.refers_to) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert found == {"<urn:uuid:a>": (None, 15, b"software: x\r\n\r\n", None), "<urn:uuid:b>": (None, 4, b"body", None), "<urn:uuid:c>": (None, 4, None, None)}
    assert [r.reason for r in warc.read_gaps(spark, str(tmp_path)).collect()] == ["payload digest differs"]


def test_files_are_cut_by_bytes_and_read_in_one_pass(spark, tmp_path):
    dice = random.Random(6)
    pages = [(i, f"http://x/{i}", dice.randbytes(20_000).hex()) for i in range(40)]
    warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a", row_bytes=50_000, rows_per_file=2)
    files = sorted(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-"))
    assert len(files) > 5 and all(p.stat().st_size < 160_000 for p in files)
    data = bytearray(files[1].read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "b").mkdir()
    for k, p in enumerate(files):
        (tmp_path / "b" / f"{k}.warc.gz").write_bytes(bytes(data) if k == 1 else p.read_bytes())
    found = warc.salvage_archives(spark, f"{tmp_path}/b").collect()
    ids, gaps = {r.page_id for r in found if r.reason is None}, [r for r in found if r.reason is not None]
    assert len(ids) == 39 and len(gaps) == 1 and gaps[0].length > 0 and gaps[0].path.endswith("1.warc.gz")
    assert {r.page_id: r.payload.decode() for r in found if r.payload} == {i: h for i, _, h in pages if i in ids}


def test_hostile_bytes_cost_no_more_than_others():
    """Lengths of thousands of digits, repeated version lines and magic bytes, headers without end: gaps, and the records after them."""
    dice = random.Random(2)
    good = _records(2)
    long = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <y>\r\nContent-Length: " + b"9" * 5_000 + b"\r\n\r\n"
    for junk in (long, b"WARC/1.1\r\n" * 100_000, b"WARC/1.1\r\nA: b\r\n" * 60_000, b"WARC/1.1\r\n" + b"x" * 4_000_000, b"\x1f\x8b\x08" * 300_000, dice.randbytes(2_000_000)):
        began = time.perf_counter()
        data = good[0] + junk + good[1]
        found = warc.salvage(data)
        assert [r.headers["warc-record-id"][10:-1] for r in found.records] == ["0", "1"]
        assert len(found.gaps) == 1 and found.gaps[0][0] == len(good[0]) and found.gaps[0][1] == len(junk)
        assert time.perf_counter() - began < 20
    for _ in range(200):
        junk = b"".join(dice.choice([b"WARC/1.1\r\n", b"\r\n\r\n", b"Content-Length: 5\r\n", b"\x1f\x8b", dice.randbytes(9), good[0][:60]]) for _ in range(30))
        assert {"0", "1"} <= set(_ids(good[0] + junk + good[1]))
