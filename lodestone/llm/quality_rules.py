"""Quality rules: gradient-boosted trees over document statistics.

Statistics are made in one pass over each whole text. Trees are fitted on the driver with
histograms of a bounded labelled sample, under monotonic constraints: more symbols, repetition,
duplicate lines, shouting or exclamation never raise the verdict. The trees are flattened into
numpy node arrays and walked for all documents of a batch at once.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Labelled documents the trees are fitted on (those with the lowest hashes of doc_id).
TRAIN_ROWS = 20_000
#: Documents with a lower probability of good quality are rejected.
LEAST_PROBABILITY = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Statistics that trees see, and the direction (-1 falling, 0 free) of the verdict in each.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "distinct_share": 0, "stutter_share": -1, "stops_per_word": 0, "exclamations_per_word": -1, "lines_per_word": 0, "digit_share": 0,
}
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    with np.errstate(over="ignore"):
        keys = h[:-2] * _MIX[0] + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * _MIX[1] + (h[2:] ^ (h[2:] >> np.uint64(31))) * _MIX[2]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The five counts of COUNTS and the values of FEATURES."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    chars, symbols = sum(map(len, words)), sum(map(text.count, SYMBOLS))
    dup, repeated = len(lines) - len(set(lines)), repeated_words(words)
    some = max(n, 1)
    values = [
        np.log1p(n), chars / some, symbols / some, dup / max(len(lines), 1), repeated / some, sum(map(str.isupper, words)) / some,
        len(set(words)) / some, sum(map(operator.eq, words, words[1:])) / some, text.count(".") / some, text.count("!") / some, len(lines) / some, sum(map(str.isdigit, words)) / some,
    ]
    return (n, chars, symbols, dup, repeated), values


@dataclass
class Trees:
    """Flattened trees. A leaf points at itself, so every row takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 15, ridge: float = 1.0) -> Trees:
    """Boost `trees` trees for the logistic loss.

    A split on a constrained feature must have its children's values in order, and the children's
    descendants stay on their side of the middle, so each tree and their sum are monotonic.
    """
    n, width = x.shape
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1) if n else np.zeros((0, width), int)
    nodes: list[list] = []
    roots: list[int] = []
    score = np.full(n, start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int, step: np.ndarray) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            gt, ht = g[rows].sum(), h[rows].sum()
            for f in range(width):
                if not len(edges[f]):
                    continue
                b = binned[rows, f]
                size = len(edges[f]) + 1
                gl, hl, cl = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gt - gl) / (ht - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (len(rows) - cl < least) | (directions[f] * (wr - wl) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, float(wl[k]), float(wr[k])))
        if best[1] is None:
            step[rows] = rate * value
            return me
        f, k, wl, wr = best[1]
        middle, way = (wl + wr) / 2, directions[f]
        goes = binned[rows, f] <= k
        a = grow(rows[goes], g, h, middle if way < 0 else low, middle if way > 0 else high, level + 1, step)
        b = grow(rows[~goes], g, h, middle if way > 0 else low, middle if way < 0 else high, level + 1, step)
        nodes[me] = [f, float(edges[f][k]), a, b, 0.0]
        return me

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(n)
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0, step))
        score += step
    columns = list(zip(*nodes)) or [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Trees(*(np.array(c, dtype=k) for c, k in zip(columns, kinds)), np.array(roots, dtype=np.int64), depth, start)


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [statistics(t.as_py())[1] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most `rows` labelled documents; ids with contradicting labels count as bad.

    With no labels, or of one class only, the trees are empty and the verdict is the prior's.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = texts.mapInArrow(_stats_rows, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    table = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    x = np.array(table["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, (table["y"].to_numpy() > 0).astype(np.float64), np.array(list(FEATURES.values())))


def _verdicts(model: Trees, texts: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, probability and kept of each text."""
    found = [statistics(t.as_py()) for t in texts]
    counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
    x = np.array([v for _, v in found], dtype=np.float64).reshape(-1, len(FEATURES))
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    p = model.probability(x)
    return counts, failed, p, ~failed & (p >= least)


def judge(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: float = LEAST_PROBABILITY, trees: Trees | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the counts, base_failed, probability, kept.

    Null and empty texts have no words and fail the base rule. Null doc_ids and repeated rows are
    judged like any others; other columns are ignored.
    """
    trees = trees or train(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            counts, failed, p, kept = _verdicts(model, b.column(1), least)
            columns = [b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(p), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    picked = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns, in one pass without a shuffle.

    Each row is judged by its own text, whatever its doc_id; null and empty texts go; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_verdicts(shared.value, b.column(at), least)[3]))

    return docs.mapInArrow(run, docs.schema)
