"""Merkle manifest of a dataset: a tree of each source, a root above them, a proof for each row.

Leaves are hashed inside the JVM; texts never move. Rows are numbered inside their source by a
range sort of ids and hashes: the counts of (part, source) are summed to offsets, so no source, hot
or not, meets in one task. Every BLOCK consecutive leaves of a source are one task's work: a
recursive postorder traversal returns the digest of each subtree and, while it unwinds, appends the
siblings to the leaves below. The digests of blocks, which are aligned to the tree's runs, are the
leaves of the next traversal, and so on up to the subroots, which are numbered and traversed alike.
Proofs come down the same way: what stands above a block is joined to its rows, at most BLOCK a key.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, few, materialize, stable, with_row_key

FANOUT, HEIGHT = 16, 2
#: Leaves of a task's traversal, whole subtrees of HEIGHT levels.
BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of paths that are broadcast at most (about 1 KB a level each).
BROADCAST_PATHS = 8_192

_GROUP = ("absent", "name")
_PATH = "array<struct<at:int,others:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n leaves."""
    height = 0
    while FANOUT**height < n:
        height += 1
    return height


def traverse(leaves: list[str], paths: list[list], low: int, high: int, height: int) -> str:
    """The digest of the node of `height` above leaves[low:high]; the paths of these leaves grow by its levels.

    A level of a path is (at, others): the digests of the node's siblings, joined, and where it stands between them.
    """
    if not height:
        return leaves[low]
    width = FANOUT ** (height - 1)
    spans = [(k, min(k + width, high)) for k in range(low, high, width)]
    digests = [traverse(leaves, paths, a, b, height - 1) for a, b in spans]
    for k, (a, b) in enumerate(spans):
        level = {"at": sum(map(len, digests[:k])), "others": "".join(digests[:k] + digests[k + 1 :])}
        for leaf in range(a, b):
            paths[leaf].append(level)
    return _digest("".join(digests))


def _block(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    leaves, total = table["node"].to_pylist(), table["total"][0].as_py()
    paths: list[list] = [[] for _ in leaves]
    top = traverse(leaves, paths, 0, len(leaves), min(HEIGHT, height_of(total)))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))
    return table.append_column("top", pa.array([top] * len(leaves), pa.string())).append_column("path", pa.array(paths, kind))


def numbered(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """`nodes` with pos, from 0, and total: each row's place and the rows in its group (_GROUP), by `order`.

    The rows are range-sorted by group and order, so a group may span many parts; a part's row of
    each of its groups carries the offset. `order` must leave no ties that matter.
    """
    keys = [F.col("absent").desc(), *map(F.col, _GROUP[1:]), *[F.col(c).asc_nulls_first() for c in order]]
    rows = materialize(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), label)
    part = F.shiftright("_id", 33).alias("_part")
    counts = rows.groupBy(*_GROUP, part).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*_GROUP)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select(*_GROUP, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total")), f"{label}-offsets")
    placed = rows.withColumn("_part", part).join(few(offsets), [*_GROUP, "_part"])
    return placed.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def _climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The traversals above `nodes` (_GROUP, pos, total, node, ...), lowest first, each with block, top and path."""
    levels = []
    while True:
        rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", top string, path {_PATH}"
        levels.append(materialize(rows.groupBy(*_GROUP, "block").applyInArrow(_block, schema), label))
        if (levels[-1].agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return levels
        nodes = _tops(levels[-1]).withColumn("total", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}"))


def _tops(level: DataFrame) -> DataFrame:
    """A row for each block: its number as place, its digest as node."""
    return level.where(F.col("pos") % BLOCK == 0).select(*_GROUP, F.col("block").alias("pos"), "total", F.col("top").alias("node"))


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with whole paths; `above` has, by group, what stands above the highest."""

    def under(upper: DataFrame, level: DataFrame) -> DataFrame:
        on = [c for c in (*_GROUP, "block") if c in upper.columns]
        upper = few(upper.withColumnRenamed("path", "_above"), BROADCAST_PATHS)
        return level.join(upper, on).withColumn("path", F.concat("path", "_above")).drop("_above")

    *lower, highest = levels
    rows = under(above, highest)
    for level in reversed(lower):
        extra = [c for c in above.columns if c not in (*_GROUP, "path")]
        rows = under(rows.select(*_GROUP, F.col("pos").alias("block"), "path", *extra), level)
    return rows


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(row: dict[str, Column]) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[_field(row[c]) for c in FIELDS]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    put = lambda node, level: F.concat(level["others"].substr(F.lit(1), level["at"]), node, level["others"].substr(level["at"] + 1, F.length(level["others"])))
    return F.aggregate(path, leaf, lambda node, level: F.sha2(put(node, level), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, forged_leaf, subroot, root and path of each row of `docs`.

    Rows of a source ascend by doc_id (null first); rows that share one by leaf, then by place, so
    repeated rows are leaves of their own. Sources ascend by bytes, null first; an empty source is
    another than null. forged_leaf is the leaf of the row with lower-case a to z in its text where 5
    divides the id's CRC-32, null elsewhere and for null ids. `path` lists, from the leaf to the
    root, the siblings and the leaf's place between them. Fields may be null, empty or of any
    length: a leaf is hashed in its task, and only its digest moves. Columns of other names are
    ignored. An empty table gives no rows.
    """
    docs = stable(docs, "merkle-rows")
    row = {c: docs[f"`{c}`"] for c in FIELDS}
    forged = {**row, "text": F.translate(row["text"], _UPPER, _LOWER)}
    chosen = F.crc32(row["doc_id"].cast("string")) % 5 == 0
    source = row["source"].cast("string")
    columns = [source.isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("name"), row["doc_id"].alias("doc_id"), leaf_of(row).alias("node"), F.when(chosen, leaf_of(forged)).alias("forged_leaf")]
    leaves = materialize(with_row_key(docs, *columns), "merkle-leaves")
    levels = _climb(numbered(leaves, ["doc_id", "node", *ROW_KEY], "merkle-order").drop(*ROW_KEY), "merkle-level")

    top = _tops(levels[-1]).select(*_GROUP, F.col("node").alias("subroot"))
    own = top.select(F.lit(False).alias("absent"), F.lit("").alias("name"), F.col("absent").alias("_absent"), F.col("name").alias("_name"), F.col("subroot").alias("node"))
    # nulls first: _absent falls
    crown = _climb(numbered(own.withColumn("_present", ~F.col("_absent")), ["_present", "_name"], "merkle-sources").drop("_present"), "merkle-crown")
    root = F.lit((_tops(crown[-1]).first() or {"node": None})["node"]).cast("string")
    begin = _tops(crown[-1]).select(*_GROUP, F.array().cast(_PATH).alias("path"))
    sources = materialize(_descend(crown, begin).select(F.col("_absent").alias("absent"), F.col("_name").alias("name"), F.col("node").alias("subroot"), "path"), "merkle-subroots")
    return _descend(levels, sources).select("doc_id", F.col("node").alias("leaf"), "forged_leaf", "subroot", root.alias("root"), "path")


def verify(found: DataFrame) -> DataFrame:
    """Proof digests and roots recomputed from tampered leaves (else the original ones)."""
    proof = F.sha2(F.array_join(F.transform("path", lambda level: level["others"]), ""), 256)
    rows = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("forged_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def plain_root(leaves: list[str]) -> str:
    """Root of a list of leaves, level by level."""
    while len(leaves) > 1:
        leaves = [_digest(reduce(str.__add__, leaves[k : k + FANOUT])) for k in range(0, len(leaves), FANOUT)]
    return leaves[0]
