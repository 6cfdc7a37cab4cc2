"""Incremental ingest of text tables, beyond the batch index: new files become chunks as they come.

The hashes seen so far are the state of a streaming aggregate, not a table that each batch joins: a
batch looks up its own hashes only, whatever came before. It keeps each hash's first document, by the
time of the batch and by doc_id, and combines before it shuffles, so a hash of many rows is a few
small ones. A row for each hash and file of the batch comes out; texts are then read from its files.
A batch that is run again starts from the same state and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as t
from ..functions import udfs
from ..operators import documents as d

SCHEMA = "doc_id long, text string"
DOCUMENTS = "doc_id long, text string, content_hash string, duplicate_of long"
#: Files of a batch at most; a batch's file names pass through the driver.
BATCH_FILES = 1_000
#: State on disk, not in the executors' heaps.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_SEEN = "is_file boolean, key string, first struct<at: timestamp, doc_id: bigint>, last timestamp"


def _documents(rows: DataFrame) -> DataFrame:
    """doc_id, text and content_hash of rows that have a doc_id and some text."""
    docs = rows.where("text is not null and doc_id is not null").withColumn("text", t.normalize_text(F.col("text"))).where("text <> ''")
    return docs.withColumn("content_hash", t.content_hash(F.col("text")))


def _append(out: str, schema: str | StructType):
    def run(seen: DataFrame, number: int) -> None:
        spark = seen.sparkSession
        seen.write.mode("overwrite").parquet(f"{out}/hashes/batch={number}")
        seen = spark.read.schema(_SEEN).parquet(f"{out}/hashes/batch={number}")
        files = [r.key for r in seen.where("is_file").select("key").collect()]  # of this batch: BATCH_FILES at most
        if not files:
            return
        docs = _documents(spark.read.schema(schema).parquet(*files)).select("doc_id", "text", "content_hash")
        hashes = seen.where("not is_file").select(F.col("key").alias("content_hash"), F.col("first.doc_id").alias("first"), (F.col("first.at") == F.col("last")).alias("fresh"))
        own = F.col("fresh") & (F.col("doc_id") == F.col("first"))
        docs = docs.join(hashes, "content_hash").withColumn("duplicate_of", F.when(~own, F.col("first"))).drop("first", "fresh")
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        new = spark.read.parquet(f"{out}/documents/batch={number}").where("duplicate_of is null")
        chunks = d.chunk_documents(new, normal=True).withColumn("embedding", udfs.stored_vector("text"))
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    return run


def stream_index(spark: SparkSession, source_dir: str, out: str, schema: str | StructType = SCHEMA, once: bool = True, batch_files: int = BATCH_FILES) -> StreamingQuery:
    """Follow Parquet files (doc_id, text) in `source_dir`; with `once`, take what is there and stop.

    A document repeats another if a batch before, or a smaller doc_id of its own batch, has the same
    text but for case and white space. doc_ids tell documents apart; rows without one, or without
    text, are left out.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(source_dir)
    docs = _documents(rows.select("doc_id", "text", F.col("_metadata.file_path").alias("file"))).withColumn("at", F.current_timestamp())  # a batch's own, also when it is run again
    what = F.array(F.struct(F.lit(False).alias("is_file"), F.col("content_hash").alias("key")), F.struct(F.lit(True).alias("is_file"), F.col("file").alias("key")))
    keyed = docs.select("at", "doc_id", F.explode(what).alias("k")).select("at", "doc_id", "k.*")
    seen = keyed.groupBy("is_file", "key").agg(F.min(F.struct("at", "doc_id")).alias("first"), F.max("at").alias("last"))
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:  # a query keeps the settings it was started with
        query = seen.writeStream.outputMode("update").foreachBatch(_append(out, schema)).option("checkpointLocation", f"{out}/progress")
        return (query.trigger(availableNow=True) if once else query).start()
    finally:
        spark.conf.set(_PROVIDER, before)
