"""Token counts by a map-side two-tier lookup.

The vocabulary has no piece with a space mark anywhere but at its start and none with a line
feed beside another character, so no merge crosses the start of a run of spaces or of a line
feed: a text's count is the sum of its pre-tokens' counts. Lengths of frequent pre-tokens are
broadcast as one compact table; the rest are encoded once in each worker and kept in its cache.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, token_path

#: Entries of the broadcast table, and documents (a bounded sample) it is counted on; both only
#: decide what is fast, never a count.
FREQUENT = 32_768
SAMPLE_DOCS = 2_000
#: Pre-tokens that a worker's cache holds before it starts anew.
CACHE_WORDS = 500_000

_pre_tokens = re.compile(r"\n[^ \n]*| +[^ \n]*").findall
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text; their concatenation is the text after one space."""
    return _pre_tokens(" " + text.replace("▁", " ")) if text else []


class Lengths:
    """Tokens of pre-tokens: the broadcast table, then the worker's cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from sentencepiece import SentencePieceProcessor

        self._processor = SentencePieceProcessor(model_file=path)
        self._frequent, self._cache = frequent or {}, {}

    def _encode(self, new: list[str]) -> None:
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        # the library puts a space mark before what it is given: it stands for the first space,
        # and before a line feed it is one token too many
        found = self._processor.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        for p, ids in zip(new, found):
            self._cache[p] = 1 if p == " " else len(ids) - (p[0] == "\n")

    def count(self, text: str | None) -> int:
        parts = pre_tokens(text or "")
        found = list(map(self._frequent.get, parts))
        if None not in found:
            return sum(found)
        missed = [p for p, n in zip(parts, found) if n is None]
        total = sum(n for n in found if n is not None)
        try:
            return total + sum(map(self._cache.__getitem__, missed))
        except KeyError:
            if len(self._cache) > CACHE_WORDS:
                self._cache.clear()
            self._encode([p for p in dict.fromkeys(missed) if p not in self._cache])
            return total + sum(map(self._cache.__getitem__, missed))


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT, sample: int = SAMPLE_DOCS) -> bytes:
    """Compact table of the most frequent pre-tokens of at most `sample` documents: NUL-joined text, one byte each for the lengths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(p for p in pre_tokens(text or "") if "\0" not in p and len(p) < 64)
        lengths = Lengths(path)
        common = [p for p, _ in seen.most_common(size)]
        lengths._encode(common)
        common = [p for p in common if lengths._cache[p] < 256]
        yield pa.RecordBatch.from_arrays([pa.array(["\0".join(common).encode()], pa.binary()), pa.array([bytes(lengths._cache[p] for p in common)], pa.binary())], names=["text", "lengths"])

    # a limit alone would gather as many rows from every task as it lets through in all
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, 2 * sample / max(1, docs.count())) * (1 << 30))
    found = docs.where(part).select("text").limit(sample).coalesce(1).mapInArrow(count, "text binary, lengths binary").collect()
    return (bytes(found[0][0]), bytes(found[0][1])) if found else (b"", b"")


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_bytes, n_tokens, and whether these exceed `limit`.

    Counts are those of the library on the whole text without begin or end tokens. Null and empty
    texts have 0 of both. Null doc_ids and repeated rows are kept; other columns are ignored.
    """
    path = token_path(model)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, sizes = table.value
        lengths = Lengths(path, dict(zip(text.decode().split("\0"), sizes)) if sizes else {})
        for b in batches:
            counts = [lengths.count(t.as_py()) for t in b.column(1)]
            yield batch(COUNTS, [b.column(0), b.column(2), counts, [n > limit for n in counts]])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
