"""SimHash near-duplicates, linked by sharded BK-trees.

Equal fingerprints are one node, its number the smallest doc_id. Two fingerprints within `radius`
bits agree on one of radius + 1 blocks of bits at least, so each fingerprint goes to one shard per
block, named by block and value, and no link is lost. A shard is a BK-tree: children are keyed by
their Hamming distance to the parent, and a query follows only edges within the radius of its own
distance. Shards larger than `shard_rows` are cut again by their remaining bits, so a tree is
bounded and a row is copied a constant number of times. A shard's links are kept as a spanning
forest, never as pairs, and components are found by alternating large-star and small-star rounds
on Parquet tables.

All trees together grow with the corpus (16 bytes a fingerprint and shard), so they aren't
broadcast: each tree is built where its shard's rows meet, which are at the same time its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, materialize, stable, with_row_key, without_rows

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Rows of a shard at most, and (query, node) pairs that a task looks at together.
SHARD_ROWS, PAIRS = 4_096, 1_500_000
#: A document without a doc_id counts as one after all others.
NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; of a shorter text the one of all its words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, len(words)
    if not n:
        return np.zeros(0, dtype="<u8")
    return np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(max(1, n - width + 1))), dtype="<u8", count=max(1, n - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        some = hashes[k : k + 65_536]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, width))


def ids_and_texts(docs: DataFrame, keyed: bool) -> DataFrame:
    """doc_id and text of `docs`, with NO_ID for null ids, and the ROW_KEY if `keyed`."""
    picked = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")]
    return with_row_key(docs, *picked) if keyed else docs.select(*picked)


def fingerprints(docs: DataFrame, width: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), row by row, and the ROW_KEY if `keyed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *ROW_KEY[: b.num_columns - 2]])

    return ids_and_texts(docs, keyed).mapInArrow(run, "doc_id long, fp long" + (f", {ROW_KEY[0]} long, {ROW_KEY[1]} long" if keyed else ""))


class Forest:
    """BK-trees of many shards, grown and searched level by level for all at once.

    Row i of `fp` belongs to shard `shard[i]`; the first row of a shard is its root. Children of a
    node are stored together, ordered by their distance to it.
    """

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        n = len(fp)
        self.fp, self.root = fp, np.full(n, -1, dtype=np.int64)
        parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        _, group = np.unique(shard, return_inverse=True)
        rows = np.arange(n)
        first = np.full(group.max() + 1 if n else 0, n)
        np.minimum.at(first, group, rows)
        self.root = first[group]
        head = self.root.copy()  # the node below which a row is to be placed
        rows = rows[rows != self.root]
        while len(rows):
            d = np.bitwise_count(fp[rows] ^ fp[head[rows]]).astype(np.int64)
            slot = head[rows] * 65 + d
            _, where, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = rows[where][inverse]  # the first of the rows with one slot becomes its node
            settled = child == rows
            parent[rows[settled]], edge[rows[settled]] = head[rows[settled]], d[settled]
            head[rows] = child
            rows = rows[~settled]
        order = np.argsort(parent * 65 + edge, kind="stable")
        order = order[np.searchsorted(parent[order], 0) :] if n else order
        self.child, self.key = order, parent[order] * 65 + edge[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, node row) within the radius, level by level, itself included."""
        at, node = queries, self.root[queries]
        while len(at):
            d = np.bitwise_count(self.fp[at] ^ self.fp[node]).astype(np.int64)
            close = d <= radius
            yield at[close], node[close]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), side="left")
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            count = high - low
            total = int(count.sum())
            start = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) if total else np.zeros(0, dtype=np.int64)
            at, node = np.repeat(at, count), self.child[start + np.arange(total)]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the rows of each pair: labels become the smallest row reachable."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def shard_links(node: np.ndarray, fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) that span what is linked in each shard."""
    order = np.lexsort((node, shard))
    node, fp, shard = node[order], fp[order], shard[order]
    forest, label = Forest(fp, shard), np.arange(len(node))
    _, group, size = np.unique(shard, return_inverse=True, return_counts=True)
    queries = np.flatnonzero(size[group] > 1)
    weight = np.cumsum(size[group[queries]]) // PAIRS
    for part in np.split(queries, np.flatnonzero(np.diff(weight)) + 1) if len(queries) else []:
        for a, b in forest.near(part, radius):
            _join(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(node)))
    return node[linked], node[label[linked]]


def _cut(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """Rows (node, fp, shard, rest) once for each of `blocks` blocks of the `width` low bits of `rest`.

    The new shard has the old one's name and the block's number and value; the new rest lacks the
    block.
    """
    cuts = [round(width * i / blocks) for i in range(blocks + 1)]
    low = lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else c
    rest = F.col("rest")
    options = []
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        value = low(F.shiftrightunsigned(rest, lo), hi - lo)
        left = low(rest, lo) if hi >= 64 else low(rest, lo).bitwiseOR(F.shiftleft(F.shiftrightunsigned(rest, hi), lo))
        options.append(F.struct(F.xxhash64("shard", F.lit(i), value).alias("shard"), left.alias("rest"), F.lit(width - (hi - lo)).alias("width")))
    return rows.select("node", "fp", F.explode(F.array(*options)).alias("_o")).select("node", "fp", "_o.shard", "_o.rest", "_o.width")


def shards(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> list[DataFrame]:
    """Rows (node, fp, shard) of shards of at most `shard_rows` rows, such that any pair within `radius` bits shares one.

    A shard that is too large is cut again by the bits that its rows don't share yet: of radius + 1
    blocks of these a pair agrees on one at least. So a row is copied radius + 1 times for each
    cut, and the cuts end as shards run out of bits, however the fingerprints lie.
    """
    blocks, out = radius + 1, []
    rows = _cut(nodes.select("node", "fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest")), 64, blocks)
    for level in range(64):
        rows = rows if level == 0 else materialize(rows, "bk-rows")
        large = rows.groupBy("shard", "width").agg(F.count("*").alias("rows")).where((F.col("rows") > shard_rows) & (F.col("width") >= blocks))
        large = materialize(large.select("shard", "width"), "bk-large")
        widths = sorted(r.width for r in large.select("width").distinct().collect())  # two or three a level
        if not widths:
            return [*out, rows.select("node", "fp", "shard")]
        out.append(rows.join(large, ["shard", "width"], "left_anti").select("node", "fp", "shard"))
        again = rows.join(large, ["shard", "width"], "left_semi")
        parts = [_cut(again.where(F.col("width") == w), w, blocks) for w in widths]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
    raise AssertionError("shards of distinct fingerprints run out of bits")


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v), u > v: a spanning forest per shard of all pairs of `nodes` (node, fp) within `radius` bits."""
    every = shards(nodes, radius, shard_rows)
    rows = every[0]
    for part in every[1:]:
        rows = rows.unionByName(part)
    rows = rows.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done(upto: int) -> pa.RecordBatch:
            """Link the first `upto` of the held rows."""
            node, fp, shard = (np.concatenate(c) for c in zip(*held))
            u, v = shard_links(node[:upto], fp[:upto].view(np.uint64), shard[:upto], radius)
            held[:] = [tuple(c[upto:] for c in (node, fp, shard))]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            shard = held[-1][2]
            other = np.flatnonzero(shard != shard[-1])
            before = sum(len(h[0]) for h in held[:-1])
            if len(other) and before + int(other[-1]) + 1 >= 50_000:
                yield done(before + int(other[-1]) + 1)
        if held:
            yield done(sum(len(h[0]) for h in held))

    return rows.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) of each node of `edges` (u, v), u > v; root is the smallest node reachable.

    Large-star and small-star in turn until nothing changes; only minima are gathered per node.
    """
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): fingerprint in hex and component_id.

    component_id is the smallest doc_id reachable by links, itself included. Null and empty texts
    have fingerprint zero, linked like any other; rows that repeat share their component. A null
    doc_id counts as the largest, and is null in the result. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, width), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    roots = components(materialize(links(nodes, radius, shard_rows), "simhash-links"))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    found = fps.join(named, "fp")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(null("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component, the row of the smallest doc_id.

    Rows are told apart by their place, so rows that share a doc_id or have none stay unless their
    texts are linked. Of rows that tie the one that stands first is kept.
    """
    docs = stable(docs)
    fps = materialize(fingerprints(docs, width, keyed=True), "simhash")
    nodes = materialize(fps.select("fp", F.col("fp").alias("node")).distinct(), "simhash-nodes")
    roots = components(materialize(links(nodes, radius), "simhash-links"))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", *ROW_KEY, F.coalesce("root", "fp").alias("component"))
    return keep_first(docs, named)


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the stable frame `docs` that come first, by doc_id and place, in their component.

    `found` has doc_id, ROW_KEY and component of each row.
    """
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", *ROW_KEY)).alias("first"))
    twice = found.join(first, "component").where((F.col(ROW_KEY[0]) != F.col(f"first.{ROW_KEY[0]}")) | (F.col(ROW_KEY[1]) != F.col(f"first.{ROW_KEY[1]}")))
    return without_rows(docs, twice, "simhash-dropped")
