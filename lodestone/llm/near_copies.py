"""Near-duplicates by the pipeline's rule: 5-word shingles, Jaccard similarity of 0.8 or more.

Texts with equal sets of shingles are one node. Candidate pairs come from the BK-trees of
`simhash_bk` and, since pairs at 0.8 differ by more bits than its trees can search, from MinHash
bands (30 of 5 values; a pair at 0.8 shares none with probability 7e-6). Every candidate is
compared by its whole sets, so no link is below the threshold.

A bucket's nodes are first compared with its smallest, so large groups of copies cost no pairs.
Nodes of buckets that are then still in different components are joined by an exact prefix filter:
two sets at the threshold share one of the smaller one's rarest ninth and the larger one's rarest
fifth of shingles (a ninth too, if it is no larger), counted among these nodes, so documents that
share a common passage and too little else for the threshold never meet, however many there are.
Where a shingle brings many together, they are near copies of something that they share: all are
first compared with those few that are nearest to it, and sets that this links don't meet any more.
Of those that do, most are told apart by parity bits: each set has 512 bits, a shingle flips one of them, and two sets
differ in at least as many shingles as bits, so no link is lost and few sets move to be compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_bk
from .common import BROADCAST_IDS, ROW_KEY, few, materialize, stable

THRESHOLD, SHINGLE = 0.8, 5
BANDS, VALUES, SEED = 30, 5, 42
#: Shingles that are hashed together.
STEP = 2_048
#: Longs of a set's parity bits.
PARITY_LONGS = 8
#: Sizes of a class differ by this factor at most. Sets of each group that all its others are compared with, round by round, and the
#: pairs for each row of the groups beyond which that is done.
CLASS, LEADS, CROSSING = 1.04, (1, 4, 16), 4

_dice = np.random.default_rng(SEED)
_MULTIPLY = _dice.integers(0, 1 << 31, BANDS * VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _dice.integers(0, 1 << 32, BANDS * VALUES, dtype=np.uint32)
_BAND = _dice.integers(0, 1 << 63, (VALUES, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; a shorter text is one shingle."""
    return np.unique(simhash_bk.shingle_hashes(text, width))


def _key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values of a set that isn't empty; the values are of 32 bits."""
    least = np.full(BANDS * VALUES, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for k in range(0, len(short), STEP):
        some = short[k : k + STEP]
        np.minimum(least, (some * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    mixed = np.arange(BANDS, dtype=np.uint64) * _BAND[0]
    for column, multiply in zip(least.reshape(BANDS, VALUES).T, _BAND):
        mixed = (mixed ^ column) * multiply
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _parity(found: np.ndarray) -> np.ndarray:
    """PARITY_LONGS longs, whose bit h is set if an odd number of a set's hashes are h modulo the bits."""
    odd = np.bincount((found % np.uint64(64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [simhash_bk.shingle_hashes(t.as_py(), SHINGLE) for t in b.column(1)]
        prints, sets = [simhash_bk.majority(h) for h in hashes], [np.unique(h) for h in hashes]
        bands = [_bands(s).view(np.int64).tolist() if len(s) else [] for s in sets]
        columns = [b.column(0), _signed([_key(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), _signed(prints), pa.array(bands, pa.list_(pa.int64())), *b.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "fp", "bands", *ROW_KEY])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            found = [shingles(t.as_py()) for t in b.column(0)[k : k + 500]]
            lists = [pa.array([f(s) for s in found], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), _parity)]
            yield pa.RecordBatch.from_arrays([_signed([_key(s) for s in found]), *lists], names=["key", "found", "parity"])


def _alike(a: str, b: str) -> object:
    """Condition: two sets of these sizes can reach the threshold."""
    return F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _near(a: str, b: str, n: str, m: str) -> object:
    """Condition: sets of n and m shingles and these parity bits can reach the threshold."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY_LONGS)), F.lit(0))
    return differ <= (F.col(n) + F.col(m)) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The rows of `pairs` (u, v) whose sets reach the threshold."""
    left, right = sets.select(F.col("key").alias("u"), F.col("found").alias("_a")), sets.select(F.col("key").alias("v"), F.col("found").alias("_b"))
    rows = pairs.join(left, "u").join(right, "v")
    both = F.size(F.array_intersect("_a", "_b"))
    return materialize(rows.where(both >= THRESHOLD * (F.size("_a") + F.size("_b") - both)).select("u", "v"), label)


def _prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, n, root, s, at, small): the shingles by which `nodes` (key, n, root) can meet a larger or equal set (small), or a smaller one.

    Sets are read in the order of rarity; a shingle is number `at`. Two at the threshold share THRESHOLD / (1 + THRESHOLD) of
    the sum of their sizes at least, so their first common shingle is one of the larger set's
    n - ceil(THRESHOLD * n) + 1 first, and one of the smaller's n - ceil(2 * THRESHOLD * n / (1 + THRESHOLD)) + 1.
    Sets that share a common passage and too little else are told apart by that: the passage is
    beyond the smaller set's prefix. Shingles whose sets are all of one root bring nothing.
    """
    held = materialize(nodes.join(sets, "key").select("key", "n", "root", F.explode("found").alias("s")), "near-hard")
    counts = held.groupBy("s").agg(F.count("*").alias("df"))
    first = held.join(counts, "s").groupBy("key", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    length = lambda share: (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int")
    first = first.select("key", "n", "root", F.slice("order", 1, length(THRESHOLD)).alias("order"), length(2 * THRESHOLD / (1 + THRESHOLD)).alias("short"))
    first = first.select("key", "n", "root", "short", F.posexplode("order").alias("at", "o")).where("o.df > 1")
    first = materialize(first.select("key", "n", "root", "o.s", "at", (F.col("at") < F.col("short")).alias("small")), "near-prefix")
    return _mixed(first, "s")


def _mixed(rows: DataFrame, *by: str) -> DataFrame:
    """The rows of groups that hold several roots and a row that can meet a larger set."""
    mixed = rows.groupBy(*by).agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("small").alias("any")).where("a <> b and any").select(*by)
    return rows.join(mixed, list(by), "left_semi")


def _class(n: object) -> object:
    """A size's class; those of one class differ by the factor CLASS at most."""
    return F.floor(F.log(n) / math.log(CLASS) + 1e-9)


def _reach(n: object, m: object) -> object:
    """The last place at which a set of m shingles can hold its first that is common with a set of n."""
    return m - F.ceil(THRESHOLD / (1 + THRESHOLD) * (n + m) - 1e-9)


def _groups(first: DataFrame) -> DataFrame:
    """The rows of _prefixes (small: may be the smaller set) for each class of sizes that the smaller set can have there.

    Two sets at the threshold share what _reach says of their sizes, so their first common shingle
    is early in both: a set of about the smaller one's size meets it by a ninth of its shingles, not
    by a fifth. So what a hot shingle brings together are sets that lie near one another but for
    sizes, most of them of one root. _mixed leaves groups of several.
    """
    n = F.col("n")
    rows = first.select("*", F.explode(F.sequence(_class(F.ceil(THRESHOLD * n - 1e-9)), _class(n))).alias("size"))
    rows = rows.where(F.col("at") <= _reach(F.greatest(F.pow(F.lit(CLASS), F.col("size")) * (1 - 1e-6), THRESHOLD * n), n))
    return _mixed(rows.withColumn("small", F.col("small") & (F.col("size") == _class(n))), "s", "size")


def _crossing(groups: DataFrame) -> tuple[int, int]:
    """The rows of _groups, and their pairs of a small one and one of another root."""
    rows, small = F.col("rows"), F.col("small")
    held = groups.groupBy("s", "size", "root").agg(F.count("*").alias("rows"), F.sum(small.cast("double")).alias("small"))
    held = held.groupBy("s", "size").agg(F.sum(rows).alias("rows"), F.sum(small).alias("small"), F.sum(rows * small).alias("own"))
    found = held.agg(F.sum(rows), F.sum(rows * small - F.col("own"))).first()
    return found[0] or 0, found[1] or 0


def _meetings(first: DataFrame) -> DataFrame:
    """The rows of _prefixes, with those of larger sets of another root (key2, n2, root2, ...) that share a shingle where both can.

    Roots meet before their sets, so sets of one root cost no pairs.
    """
    return _crossed(_groups(first))


def _crossed(groups: DataFrame) -> DataFrame:
    """_meetings of the rows of _groups."""
    small = groups.where("small")
    other = groups.select("s", "size", *[F.col(c).alias(f"{c}2") for c in groups.columns if c not in ("s", "size", "small")])
    roots = small.select("s", "size", "root").distinct().join(other.select("s", "size", "root2").distinct(), ["s", "size"]).where("root <> root2")
    rows = roots.join(small, ["s", "size", "root"]).join(other, ["s", "size", "root2"]).where("n < n2 or n = n2 and key < key2")
    n, m = F.col("n"), F.col("n2")
    return rows.where(_alike("n", "n2")).where((F.col("at") <= _reach(m, n)) & (F.col("at2") <= _reach(n, m)))


def _led(groups: DataFrame, leads: int) -> DataFrame:
    """The rows of _groups, with `leads` sets of another root (key2, n2, root2, parity2) of their group: those with the fewest rarer shingles.

    These are the nearest to what the group has in common, so they are near the most of its sets.
    """
    place = F.row_number().over(Window.partitionBy("s", "size").orderBy("at", "key"))
    least = groups.withColumn("place", place).where(F.col("place") <= leads)
    least = least.select("s", "size", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "root", "parity")])
    return groups.join(least, ["s", "size"]).where("root <> root2").where(_alike("n", "n2"))


def _told(pairs: DataFrame, label: str) -> DataFrame:
    """(u, v): the distinct pairs of keys that parity bits don't tell apart."""
    pairs = pairs.where(_near("parity", "parity2", "n", "n2"))
    return materialize(pairs.select(F.greatest("key", "key2").alias("u"), F.least("key", "key2").alias("v")).distinct(), label)


def _with_parity(first: DataFrame, parities: DataFrame | None) -> DataFrame:
    return first.join(parities, "key") if parities is not None else first.withColumn("parity", F.array_repeat(F.lit(0).cast("long"), PARITY_LONGS))


def _rare_pairs(nodes: DataFrame, sets: DataFrame, parities: DataFrame | None = None) -> DataFrame:
    """(u, v): pairs of `nodes` (key, n, root) of different roots that share a shingle of both's prefixes.

    Pairs that parities (key, parity) tell apart are left out.
    """
    return _told(_meetings(_with_parity(_prefixes(nodes, sets), parities)), "near-rest")


def _rest(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join what _rare_pairs of `nodes` would, and cost no pairs of sets that a few links join.

    While groups hold many more pairs than rows, their sets are first compared
    with a few of each group, and roots that are then linked become one. The pairs left are compared
    one and all.
    """
    first, found, parities = _prefixes(nodes, sets), [], sets.select("key", "parity")
    for leads in LEADS:
        groups = materialize(_with_parity(_groups(first), parities), "near-groups")
        rows, pairs = _crossing(groups)
        if pairs <= CROSSING * rows:
            break
        found.append(_verified(_told(_led(groups, leads), "near-led"), sets, "near-leads"))
        first = _merged(first, found[-1])
    else:
        groups = materialize(_with_parity(_groups(first), parities), "near-groups")
    rest = _verified(_told(_crossed(groups), "near-rest"), sets, "near-more")
    for links in found:
        rest = rest.unionByName(links)
    return rest


def _merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of _prefixes with one root for roots that `links` (u, v) join."""
    roots = first.select("key", "root").distinct()
    ends = links.join(roots.withColumnRenamed("key", "u").withColumnRenamed("root", "a"), "u").join(roots.withColumnRenamed("key", "v").withColumnRenamed("root", "b"), "v")
    edges = materialize(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-edges")
    named = simhash_bk.components(edges, "near-cc").select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return first.join(named, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID if null), ROW_KEY and component, a key, of each row of a stable frame."""
    texts = simhash_bk.ids_and_texts(docs, keyed=True)
    rows = materialize(texts.mapInArrow(_describe, f"doc_id long, key long, n long, fp long, bands array<long>, {ROW_KEY[0]} long, {ROW_KEY[1]} long"), "near-rows")
    place = F.struct(*ROW_KEY).alias("at")
    nodes = materialize(rows.groupBy("key").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).where("n > 0"), "near-nodes")

    buckets = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    shared = materialize(shared.select("bucket", F.col("lead.key").alias("lead"), F.col("lead.n").alias("lead_n")), "near-buckets")
    members = materialize(buckets.join(shared, "bucket"), "near-members")
    close = members.where("key <> lead").where(_alike("n", "lead_n")).select(F.col("key").alias("u"), F.col("lead").alias("v"))

    prints = materialize(nodes.groupBy("fp").agg(F.min("key").alias("node")), "near-prints")
    equal = nodes.join(prints, "fp").where("key <> node").select(F.col("key").alias("u"), F.col("node").alias("v"))
    trees = simhash_bk.links(prints.select("node", "fp"))
    pairs = materialize(close.unionByName(equal).unionByName(trees).distinct(), "near-pairs")

    asked = members.select("key").unionByName(pairs.select(F.col("u").alias("key"))).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    places = few(materialize(nodes.join(asked, "key", "left_semi").select("at.*"), "near-asked"), BROADCAST_IDS // 2)
    sets = materialize(texts.join(places, list(ROW_KEY), "left_semi").select("text").mapInArrow(_sets, "key long, found array<long>, parity array<long>"), "near-sets")
    links = _verified(pairs, sets, "near-links")

    roots = simhash_bk.components(links, "near-cc")
    named = members.join(roots, members["key"] == roots["node"], "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("root"))
    split = named.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    hard = materialize(named.join(split, "bucket", "left_semi").select("key", "n", "root").distinct(), "near-split")
    links = links.unionByName(_rest(hard, sets))

    roots = simhash_bk.components(links, "near-cc")
    return rows.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", *ROW_KEY, F.coalesce("root", "key").alias("component"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of each row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by pairs at the threshold, itself included.
    Texts without words are copies of each other. A null doc_id counts as the largest, and is null
    in the result. An empty table gives no rows.
    """
    named = _grouped(stable(docs))
    least = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-components")
    null = lambda c: F.when(F.col(c) != simhash_bk.NO_ID, F.col(c)).alias(c)
    return named.join(least, "component").select(null("doc_id"), null("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-copies: of each component, that of the smallest doc_id.

    Rows are told apart by their place, so rows that share a doc_id or have none stay unless their
    texts are alike; of rows that tie the one that stands first is kept. Columns of any name are
    kept as they are. An empty table gives no rows.
    """
    docs = stable(docs)
    return simhash_bk.keep_first(docs, _grouped(docs))
