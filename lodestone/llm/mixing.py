"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target in words. Its weight changes linearly over training: at time t of
[0, 1] its density is 1 + slope * (2t - 1), whose integral is F(t) = t + slope * (t^2 - t). A
document copy whose words lie around the share u of its source's target is due at the time
with F(t) = u, the root of a quadratic. Rows are range-sorted by that time.

Only ids, sources and sizes are moved. A source's prefix sums are made over 1024 hash buckets of
each source, so a source with a third of all rows is dealt over 1024 groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, few, materialize, stable, whole_rows, with_row_key, word_count

#: Weights of the sources in order, repeating, and the slopes of their schedules.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
#: Words of the mix as a share of all words; most copies of a document.
SHARE, MOST = 1.5, 2.0
BUCKETS_BITS = 10
#: Rows of the plan that are broadcast, at most (24 MB).
BROADCAST_PLAN = 500_000


def document_sizes(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, source, size in words, the place (60 bits) of the document in its source, and ROW_KEY if `keyed`."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    picked = (
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("place"),
    )
    return with_row_key(docs, *picked) if keyed else docs.select(*picked)


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, slope and target of every source; one row a source.

    Targets share `share` of all words by weight; what exceeds `most` times a source's size is
    shared again by weight among the rest, which is filling to a common level of target / weight.
    """
    n = len(weights)
    every = Window.partitionBy()
    in_order = every.orderBy(F.col("source").asc_nulls_last())
    by_room = every.orderBy("room", "rank")
    # one task, which sees a row per source after the aggregate: for thousands of sources, not for billions
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(in_order) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % n + 1).cast("int"))
    per = per.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("room", F.col("cap") / F.col("weight")).withColumn("all_words", F.sum("source_size").over(every))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.col("all_words") - before) / rest)
    # the first source, by room, that the level of it and all after it doesn't fill
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "rank", "level"))).over(every)["level"]
    per = per.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return per.select("source", "source_size", "slope", F.round("target", 6).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST, keyed: bool = False) -> DataFrame:
    """One row per document: size, source_size, target, copies, taken, slope and positions.

    A source takes all its documents floor(target / size) times, and once more those that come
    first in a fixed order of hashes, as far as brings it nearest the target. `positions` has the
    time of each copy in [0, 1]. Null texts have size 0; a null source is a source of its own,
    the last; rows that repeat are mixed each, in a fixed order, which with `keyed` (for a stable
    frame) is that of their places. An empty table gives no rows. Sizes are made before this returns.
    """
    key = ROW_KEY if keyed else ()
    sizes = materialize(document_sizes(docs, keyed), "mix-sizes")
    targets = source_targets(sizes, weights, slopes, share, most)
    shift = 60 - BUCKETS_BITS
    rows = sizes.withColumn("bucket", F.shiftright("place", shift).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0))).drop("words")
    starts = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "before", "source_size", "slope", "target")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    rows = rows.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    rows = rows.select("doc_id", *key, "r.source", "size", "source_size", "target", "slope", (F.col("before") + F.col("inside")).alias("start"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = rows.withColumn("full", full)
    more = F.col("target") - F.col("full") * F.col("source_size")
    rows = rows.withColumn("copies", F.col("full") + F.when((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= more), 1).otherwise(0))
    middle = lambda c: F.least(F.lit(1.0), (c * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    a = F.col("slope")
    due = lambda u: F.when(a == 0, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a))
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("positions", F.transform(copies, lambda c: due(middle(c))))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).drop("start", "full")


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The digest of `mix`, range-sorted by the time of the first copy; documents left out come last."""
    rows = mix(docs, **options).withColumn("position", F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", "position")
    return rows.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, range-sorted by training position.

    Which row goes where is found on ids, sizes and the rows' places, so rows that repeat or have
    no doc_id are taken as often as `mix` says of each, and columns may have any names. Documents
    of no words are not taken; an empty table gives no rows. The plan is broadcast while it is
    small; then the text is moved once, by the range sort. Written as Parquet, the part files' numbers and the rows' numbers in them
    are the training order (see `packing.pack_documents`).
    """
    docs = stable(docs)
    plan = materialize(mix(docs, keyed=True, **options).where("copies > 0").select(*ROW_KEY, "positions"), "mix-plan")
    rows = whole_rows(docs).join(few(plan, BROADCAST_PLAN), list(ROW_KEY)).select("_doc", F.explode("positions").alias("_position"), *ROW_KEY)
    return rows.sort("_position", *ROW_KEY).select("_doc.*")
