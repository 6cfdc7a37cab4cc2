"""Vector bin packing of examples into training sequences.

Each example has three demands: tokens, segments (one a piece) and loss-bearing tokens. A bin is a
training sequence with a limit on each. An example goes to the open bin with the largest dot
product of remaining capacity and demand, both as shares of the limits, among the bins that can
hold it: bins whose free room has the example's shape are used up evenly.

Packing is local to a partition: a partition has thousands of sequences and leaves no bin
part-filled (`pack_documents`, which cuts what has no segment left at a power of two and begins
anew with the rest) or a bounded number of them (`pack_examples`), so bringing
partitions together would buy nothing for a shuffle of the whole corpus. Ids are
partition number and local number, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, quiet_tokenizers, stable, token_path, words_of

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (2048, 64, 2048)
#: Bins open at a time in a task.
OPEN_BINS = 32
#: Words that a worker's cache holds before it starts anew, and texts encoded together.
CACHE_WORDS, TEXTS = 1_500_000, 128
#: Characters of these words, of which one without white space may have any number.
CACHE_CHARS = 64 << 20
#: Bits of a sequence's number for sequences and, with `ordered`, for both these and rows.
_COUNTER, _PART = 20, 44
#: Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
#: others by number from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: What lower-casing a whole text first could change: special tokens, final sigma, dotted I, odd separators.
_special = re.compile("<\\||[\u03a3\u0130\x1c-\x1f]").search

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of texts, by way of a bounded cache of words.

    The vocabulary never joins tokens across white space, so a text's ids are its words' ids. As it
    reads lower case, texts are lowered first where that can't make a difference; and as it splits
    letters from other characters, a new word with one mark behind it is put together from both.
    """

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._cache: dict[str, bytes] = {}
        self._chars = 0

    def _words(self, text: str) -> list[str]:
        if not _special(text) and is_normalized("NFC", text) and is_normalized("NFC", low := text.lower()):
            return low.split()
        # str.split() would also split at four separators that the vocabulary takes as characters
        return words_of(text)

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha() and w.lower() == w and is_normalized("NFC", w)]
        for w in plain:  # all letters and normal: one piece of the split, so it goes to the model as it is
            ids = [t.id for t in self._model.tokenize(w if w.isascii() else "".join([BYTE_CHARS[b] for b in w.encode()]))]
            self._cache[w] = pack(f"<{len(ids)}I", *ids)
        new = [w for w in new if w not in self._cache]
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            for w, e in zip(some, self._tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self._cache[w] = pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        lists = [self._words(t) if t else [] for t in texts]
        cache = self._cache
        if len(cache) > CACHE_WORDS or self._chars > CACHE_CHARS:
            cache.clear()
            self._chars = 0
        new = set().union(*lists).difference(cache)
        # lower-casing could move a mark of a capital (as of a dotted I) into the next piece
        marked = [w for w in new if w[-1] in ".,!?:;" and w[-2:-1].isalpha() and w.lower() == w]
        new.difference_update(marked)
        new.update(x for w in marked for x in (w[:-1], w[-1]) if x not in cache)
        self._chars += sum(map(len, new))
        self._learn(list(new))
        for w in marked:
            cache[w] = cache[w[:-1]] + cache[w[-1]]
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in lists]


class Bins:
    """Open bins under simultaneous limits, chosen by dot product."""

    def __init__(self, limits: tuple[int, ...], size: int):
        self.limits = np.asarray(limits, dtype=np.float64)
        self.free = np.zeros((size, len(limits)))
        self.open = np.zeros(size, dtype=bool)
        self.held: list[list] = [[] for _ in range(size)]

    def choose(self, demand: np.ndarray) -> int:
        """The bin that can hold `demand` with the largest dot product, or -1."""
        fits = self.open & (self.free >= demand).all(axis=1)
        if not fits.any():
            return -1
        score = (self.free / self.limits) @ (demand / self.limits)
        score[~fits] = -1.0
        return int(score.argmax())

    def new(self) -> int:
        """Open a bin, or -1 if all are open."""
        i = int(self.open.argmin())
        if self.open[i]:
            return -1
        self.open[i], self.free[i], self.held[i] = True, self.limits, []
        return i

    def put(self, i: int, item, demand: np.ndarray) -> None:
        self.free[i] -= demand
        self.held[i].append(item)

    def fullest(self) -> int:
        return int(np.where(self.open, self.free[:, 0], np.inf).argmin())

    def close(self, i: int) -> list:
        self.open[i] = False
        held, self.held[i] = self.held[i], []
        return held


def _loss(start: int, length: int) -> int:
    """The first id of a document has nothing before it to be predicted from."""
    return length - (start == 0)


def _demand(piece: tuple) -> np.ndarray:
    n = len(piece[2]) // 4
    return np.array([n, 1, _loss(piece[1], n)], dtype=np.float64)


def _cut(held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Pieces cut at the largest power of two of their ids, which needs no padding."""
    sizes = [len(p[2]) // 4 for p in held]
    room, first = 1 << (sum(sizes).bit_length() - 1), []
    for k, ((doc, start, ids, total), n) in enumerate(zip(held, sizes)):
        if n >= room:
            rest = [(doc, start + room, ids[4 * room :], total)] if n > room else []
            return [*first, (doc, start, ids[: 4 * room], total)], rest + held[k + 1 :]
        first.append(held[k])
        room -= n
    return first, []


class DocumentPacker:
    """Packs id streams that may be cut anywhere."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS, open_bins: int = OPEN_BINS, base: int = 0):
        self.limits, self.bins, self.next, self.rows = limits, Bins(limits, open_bins), base, []

    def _emit(self, held: list) -> None:
        offset = 0
        for doc, start, ids, total in held:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def _put(self, i: int, piece: tuple) -> None:
        self.bins.put(i, piece, _demand(piece))
        if self.bins.free[i][0] < 1:
            self._emit(self.bins.close(i))
        elif self.bins.free[i][1] < 1:  # no segment is left: what is over a power of two begins the bin anew
            first, rest = _cut(self.bins.close(i))
            self._emit(first)
            if rest:
                self.bins.open[i], self.bins.free[i] = True, self.bins.limits
                for p in rest:
                    self.bins.put(i, p, _demand(p))

    def add(self, doc, ids: bytes) -> None:
        total, at, most = len(ids) // 4, 0, self.limits[0]
        while total - at >= most and _loss(at, most) <= self.limits[2]:
            self._emit([(doc, at, ids[4 * at : 4 * (at + most)], total)])
            at += most
        while at < total:
            n = total - at
            i = self.bins.choose(np.array([n, 1, _loss(at, n)], dtype=np.float64))
            if i < 0:
                i = self.bins.new()
            if i < 0:  # all bins are open and none has room: cut the piece to fill the fullest
                i = self.bins.fullest()
            n = int(min(n, self.bins.free[i][0], self.bins.free[i][2] + (at == 0)))
            if n < 1:
                self._emit(self.bins.close(i))
                continue
            self._put(i, (doc, at, ids[4 * at : 4 * (at + n)], total))
            at += n

    def finish(self) -> None:
        """Pour what the open bins hold together; the rest becomes sequences of powers of two."""
        pieces = [p for i in np.flatnonzero(self.bins.open) for p in self.bins.close(int(i))]
        left = sum(len(p[2]) // 4 for p in pieces)
        held: list = []
        room = self._room(left)
        while pieces:
            doc, start, ids, total = pieces.pop()
            n = min(len(ids) // 4, room)
            held.append((doc, start, ids[: 4 * n], total))
            if n < len(ids) // 4:
                pieces.append((doc, start + n, ids[4 * n :], total))
            room, left = room - n, left - n
            if room and len(held) == self.limits[1]:
                held, rest = _cut(held)
                pieces += rest[::-1]
                left += sum(len(p[2]) // 4 for p in rest)
                room = 0
            if not room:
                self._emit(held)
                held, room = [], self._room(left)

    def _room(self, left: int) -> int:
        """Ids of the next sequence: a whole one, or the largest power of two."""
        most = min(self.limits[0], self.limits[2])
        return most if left >= most else 1 << (left.bit_length() - 1) if left else 0


def number_bits(files: list[str]) -> tuple[int, int]:
    """Bits of a sequence's number for sequences, and for these and rows: one less each where file numbers need it."""
    numbers = [int(m[1]) for f in files if (m := re.match("part-([0-9]{1,6})", f.rpartition("/")[2]))]
    less = max(numbers, default=0) >= 1 << (63 - _PART)
    return _COUNTER - less, _PART - less


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, limits: tuple[int, int, int] = LIMITS, open_bins: int = OPEN_BINS, ordered: bool = False) -> DataFrame:
    """Pack `docs` (doc_id, text) into sequences; one row per piece.

    A document's ids are its text's ids without special tokens and then `end_id`; each id lies in
    exactly one piece, and a sequence's pieces have gapless offsets from 0. Null and empty texts
    have just `end_id`. Repeated rows and null doc_ids are packed like any others. Other columns
    are ignored. An empty table gives no rows.

    With `ordered`, for rows whose order is that of numbered part files (as sorted rows are
    written), a sequence's number begins with its file's number and the row it was begun at, so
    sequences are in the order of their documents. A text, of 2 GB at most, is less than half a
    million sequences long, and a file has 16 million rows at most, so numbers don't meet.
    """
    path = token_path(tokenizer)
    docs = stable(docs) if ordered else docs
    counter, high = number_bits(docs.inputFiles() if ordered else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(path), np.array([end_id], dtype="<u4").tobytes()
        packer, file = DocumentPacker(limits, open_bins, TaskContext.get().partitionId() << 36), None
        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                some = b.slice(k, TEXTS)
                order = [c.to_pylist() for c in some.columns[2:]] or [[None] * some.num_rows] * 2
                for doc, ids, part, row in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), *order):
                    if part is not None and part != file:
                        packer.finish()
                        packer.next, file = (part << high) + (row << counter), part
                    packer.add(doc, ids + end)
                if len(packer.rows) >= 20_000:
                    yield batch(PIECES, list(zip(*packer.rows)))
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield batch(PIECES, list(zip(*packer.rows)))

    picked = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if ordered:
        at = docs.metadataColumn("_metadata")
        picked += [F.regexp_extract(at["file_name"], "^part-([0-9]{1,6})", 1).try_cast("long").alias("part"), at["row_index"].alias("row")]
    return docs.select(*picked).mapInArrow(run, PIECES_DDL)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = LIMITS, open_bins: int = 256) -> DataFrame:
    """Pack whole examples (example_id, tokens, loss_tokens); adds sequence_id and offset.

    An example larger than a limit gets a sequence of its own. Null counts are taken as 0. Rows
    that repeat are packed each.
    """
    schema = pa.schema([("example_id", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, number = Bins(limits, open_bins), TaskContext.get().partitionId() << 36

        def done(held: list) -> list:
            nonlocal number
            out, offset = [], 0
            for example, tokens, loss in held:
                out.append((example, tokens, loss, number, offset))
                offset += tokens
            number += 1
            return out

        for b in batches:
            rows: list = []
            items = zip(*(b.column(i).to_pylist() for i in range(3)))
            for item in sorted(((e, t or 0, w or 0) for e, t, w in items), key=lambda x: -x[1]):
                demand = np.array([item[1], 1, item[2]], dtype=np.float64)
                if (demand > bins.limits).any():
                    rows += done([item])
                    continue
                i = bins.choose(demand)
                if i < 0 and (i := bins.new()) < 0:
                    rows += done(bins.close(bins.fullest()))
                    i = bins.new()
                bins.put(i, item, demand)
            if rows:
                yield batch(schema, list(zip(*rows)))
        rows = [r for i in np.flatnonzero(bins.open) for r in done(bins.close(int(i)))]
        if rows:
            yield batch(schema, list(zip(*rows)))

    picked = examples.selectExpr("cast(example_id as long) example_id", "cast(tokens as long) tokens", "cast(loss_tokens as long) loss_tokens")
    return picked.mapInArrow(run, "example_id long, tokens long, loss_tokens long, sequence_id long, offset long")
