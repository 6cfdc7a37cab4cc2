"""Ranked lexical search of a query set over all documents: WAND on shards of documents.

One pass over the texts keeps, for each document, its length and how often it holds each term that
is asked for; that table gives the counts of the corpus and the terms' weights. It is then read in
shards of a bounded number of postings. A shard has each term's documents with their impacts and
the term's largest impact. Queries go through a shard window by window with the heap of the ten
best found so far by the task: lists are taken by falling largest impact until those left can't
reach the heap's threshold together; the documents of the lists taken are pivots if the largest
impacts of all lists that hold them reach it. Other documents are skipped, pivots scored in full.
The heaps of the tasks are merged in two steps.

Queries are dealt to blocks of BLOCK_BYTES of text. A block's terms and weights go to the tasks, so
what is broadcast is bounded by the block; each block reads the documents once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOP = 10
#: A term of a text whose A-Z are lower-cased, in UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of query texts that are searched for together, about.
BLOCK_BYTES = 4 << 20
#: Postings of a shard (about 40 bytes each while it is searched).
SHARD = 4_000_000
#: Documents of the first window of a shard; each next one is FACTOR times as long.
WINDOW, FACTOR = 256, 4
#: Tasks whose heaps are merged in the first step go to this many groups a query.
GROUPS = 64

_INDEX = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text; bytes.lower() changes A-Z alone."""
    return TERM.findall((text or "").encode().lower())


def impact(tf, m):
    """What `tf` occurrences in a document of relative length `m` give to a weight of 1."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def relative_length(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """25 and three quarters of a document's length in percent of the mean, rounded down."""
    if int(n.max(initial=0)) * 75 * documents < 1 << 63:
        return 25 + 75 * n * documents // words
    return np.array([25 + 75 * int(x) * documents // words for x in n], dtype=np.int64)


def _index(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, terms, counts, ends = [], [], [], [0]
            for text in b.column(1):
                words = terms_of(text.as_py())
                held = [(vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary]
                lengths.append(len(words))
                terms += [t for t, _ in held]
                counts += [n for _, n in held]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


class Shard:
    """Posting lists of a bounded number of documents, in the order of ids (null last)."""

    def __init__(self, table: pa.Table, documents: int, words: int):
        table = table.sort_by("doc_id").combine_chunks()
        self.ids = np.asarray(table["doc_id"].fill_null(-1))
        self.absent = np.asarray(table["doc_id"].is_null())
        lists = [table[c].combine_chunks() for c in ("terms", "counts")]
        sizes = np.asarray(lists[0].value_lengths())
        terms, counts = (np.asarray(x.flatten()) for x in lists)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, self.docs = terms[order], docs[order]
        m = relative_length(np.asarray(table["n"]), documents, words)
        self.impacts = impact(counts[order].astype(np.int64), m[self.docs])
        names, first = np.unique(terms, return_index=True)
        ends = np.append(first[1:], len(terms))
        largest = np.maximum.reduceat(self.impacts, first) if len(first) else first
        self.lists = {int(t): (int(a), int(z), int(most)) for t, a, z, most in zip(names, first, ends, largest)}

    def search(self, asked: list[tuple[int, int]], heap: list[tuple]) -> list[tuple]:
        """The TOP best (-score, absent, doc_id) of `heap` and this shard, in that order, for a query's (term, weight)."""
        found = [(*self.lists[t], w) for t, w in asked if t in self.lists and w > 0]
        found.sort(key=lambda x: -x[2] * x[3])
        bounds = np.array([most * w for *_, most, w in found], dtype=np.int64)
        left = np.append(np.cumsum(bounds[::-1])[::-1][1:], 0)  # what the lists after each can give together
        low, width = 0, WINDOW
        while low < len(self.ids) and found:
            high = min(low + width, len(self.ids))
            heap = self._window(found, bounds, left, low, high, heap)
            low, width = high, width * FACTOR
        return heap

    def _window(self, found: list[tuple], bounds: np.ndarray, left: np.ndarray, low: int, high: int, heap: list[tuple]) -> list[tuple]:
        threshold = -heap[-1][0] if len(heap) == TOP else 1
        spans = [(a + np.searchsorted(self.docs[a:z], low), a + np.searchsorted(self.docs[a:z], high)) for a, z, *_ in found]
        reach, taken = np.zeros(high - low, dtype=np.int64), 0
        while taken < len(found) and (left[taken - 1] if taken else bounds.sum()) >= threshold:
            a, z = spans[taken]
            reach[self.docs[a:z] - low] += bounds[taken]
            taken += 1
        rest = left[taken - 1] if taken else 0
        pivots = np.flatnonzero((reach > 0) & (reach + rest >= threshold))
        for k in range(taken, len(found)):
            if not len(pivots):
                return heap
            held, _ = self._at(spans[k], pivots + low)
            reach[pivots[held]] += bounds[k]
            pivots = pivots[reach[pivots] + left[k] >= threshold]
        scores = np.zeros(len(pivots), dtype=np.int64)
        for span, (*_, w) in zip(spans, found):
            held, at = self._at(span, pivots + low)
            scores[held] += w * self.impacts[at]
        keep = np.flatnonzero(scores >= threshold)
        if len(keep) > TOP:  # ties with the last one stay, the ids decide
            keep = keep[scores[keep] >= np.partition(scores[keep], -TOP)[-TOP]]
        best = [(-int(scores[i]), bool(self.absent[low + pivots[i]]), int(self.ids[low + pivots[i]])) for i in keep]
        return sorted(heap + best)[:TOP]

    def _at(self, span: tuple, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `docs` a stretch of a list holds, and where."""
        a, z = span
        at = np.searchsorted(self.docs[a:z], docs) + a
        held = np.flatnonzero(at < z)
        held = held[self.docs[at[held]] == docs[held]]
        return held, at[held]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of `most` postings at least, but for the last."""
    rows, size = [], 0
    for b in batches:
        rows.append(b)
        size += len(b.column(2).flatten())
        if size >= most:
            yield pa.Table.from_batches(rows)
            rows, size = [], 0
    if rows:
        yield pa.Table.from_batches(rows)


def _search(asked: list[list[tuple[int, int]]], documents: int, words: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in asked]
        for table in _shards(batches, shard):
            part = Shard(table, documents, words)
            heaps = [part.search(query, heap) for query, heap in zip(asked, heaps)]
        rows = [(i, None if absent else doc_id, -score) for i, heap in enumerate(heaps) for score, absent, doc_id in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: list[tuple], shard: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for a block of (item_id, text)."""
    spark = docs.sparkSession
    queries = [Counter(terms_of(text)) for _, text in items]
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*queries)))}
    index = materialize(docs.select(docs["`doc_id`"].cast("long"), docs["`text`"]).mapInArrow(_index(vocabulary), _INDEX), "wand-index")
    documents, words = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(map(tuple, index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()))  # a row for each of the block's terms at most
    asked = [[(vocabulary[t], n * weight(documents, holding[vocabulary[t]])) for t, n in query.items() if vocabulary[t] in holding] for query in queries]
    heaps = index.where(F.size("terms") > 0).mapInArrow(_search(asked, documents, max(words, 1), shard), "query int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("query", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).orderBy(*order)
    best = heaps.withColumn("_near", F.row_number().over(some)).where(F.col("_near") <= TOP)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= TOP)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "query int, item_id long")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id and score of the TOP documents (doc_id, text) of highest score for each item (item_id, text).

    Terms are letters and digits of ASCII and all other characters beyond it, A-Z lower-cased. Null
    and empty texts have no terms: such documents don't count, such items have no result. Only scores
    above 0 are listed; equal ones by ascending doc_id, null last; repeated rows are documents, or
    items, of their own. Texts may be of any length. Columns of other names are ignored. Without
    documents or items there are no rows.
    """
    items = items.select(items["`item_id`"].cast("long").alias("item_id"), items["`text`"].alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [_block(docs, [tuple(r) for r in items.where(place == k).orderBy("item_id", "text").collect()], shard) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)
