"""Documents to numbered, deduplicated rows and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.constants import CHUNK_OVERLAP, CHUNK_SIZE
from ..session import scratch_table


def mark_duplicates(docs: DataFrame, order: str, name: str) -> DataFrame:
    """Add content_hash (unless there) and duplicate_of: the `name` of the first row, by `order`, with the same hash.

    The first row per hash is found by an aggregate of ids that combines before it shuffles, so a
    hash that many rows share meets in one small row. Only hashes that repeat go to the join, whose
    hot keys adaptive execution splits.
    """
    rows = docs if "content_hash" in docs.columns else docs.withColumn("content_hash", t.content_hash(F.col("text")))
    first = rows.groupBy("content_hash").agg(F.min(F.struct(F.col(order).alias("at"), F.col(name).alias("name"))).alias("first"), F.count("*").alias("_rows"))
    rows = rows.join(first.where("_rows > 1").drop("_rows"), "content_hash", "left")
    same = F.col(order).eqNullSafe(F.col("first.at")) & F.col(name).eqNullSafe(F.col("first.name"))
    return rows.withColumn("duplicate_of", F.when(F.col("first").isNotNull() & ~same, F.col("first.name"))).drop("first")


def number_files(files: DataFrame) -> DataFrame:
    """Add doc_no, from 1, in component-wise path order.

    Paths are range-sorted without contents; a part's rows are numbered from what the parts before
    it hold, so what one task sees of all files is a count for each part.
    """
    order = F.split("file_path", "/")
    rows = scratch_table(files.select("file_path").repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "paths")
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before - F.col("_first")).alias("_shift"))
    numbers = rows.withColumn("_part", part).join(offsets, "_part").select("file_path", (F.col("_id") + F.col("_shift") + 1).alias("doc_no"))
    return files.join(numbers, "file_path")


def doc_id(number: Column) -> Column:
    return F.format_string("doc_%04d", number)


def chunk_documents(docs: DataFrame, key: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, normal: bool = False) -> DataFrame:
    """One row per chunk of each document's normalised text (`normal`: it is already): key, chunk_index from 1, text."""
    chunks = t.chunk_text(F.col("text") if normal else t.normalize_text(F.col("text")), size, overlap)
    rows = docs.select(key, F.posexplode(chunks).alias("at", "text"))
    return rows.select(key, (F.col("at") + 1).alias("chunk_index"), "text")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.format_string("%s_%04d", F.col("doc_id"), F.col("chunk_index")))


def ingest_counters(docs: DataFrame, chunks: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: documents, indexed_documents, duplicates, chunks, skipped."""
    one = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("duplicate_of").isNull()).alias("indexed_documents"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"))
    parts = [one.select(F.lit(1).alias("k"), "*"), chunks.agg(F.count("*").alias("chunks")).select(F.lit(1).alias("k"), "*")]
    out = parts[0].join(parts[1], "k")
    lost = skipped.agg(F.count("*").alias("skipped")).select(F.lit(1).alias("k"), "*") if skipped is not None else None
    out = out.join(lost, "k") if lost is not None else out.withColumn("skipped", F.lit(0).cast("long"))
    return out.select("documents", "indexed_documents", "chunks", "skipped", "duplicates")


def sources_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its number of chunks (0 for duplicates), by file_path."""
    counts = chunks.groupBy("doc_id").agg(F.count("chunk_id").alias("chunk_count"))
    columns = [c for c in docs.columns if c != "text"]
    rows = docs.select(columns).join(counts, "doc_id", "left")
    return rows.select(*columns, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")).orderBy("file_path")


def duplicate_files(docs: DataFrame) -> DataFrame:
    """(file_path, duplicate_of) of the duplicates, by path."""
    return docs.where(F.coalesce("duplicate_of", F.lit("")) != "").select("file_path", "duplicate_of").orderBy("file_path")
