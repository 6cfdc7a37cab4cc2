"""Building, versioning and reporting the index.

An index is a folder of versions, each a set of Parquet tables, of segments of posting lists, and a
pointer file that names the current version. A build or an update writes a new version and swaps the
pointer at the end, so readers never see half an index. A version names the segments it reads, which
later versions share, and has the places of its chunks in them.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import udfs
from ..functions.constants import MODEL_LABEL, NO_INDEX_REPORT
from ..operators import documents as d
from ..operators import shards
from ..sources.files import extract_texts, scan_files

#: Tables of posting lists, which are in segments; other tables are in the version's folder.
LISTS = ("shard_vectors", "shard_tokens", "shard_runs")
#: What tells a state of a file from another.
SAME = ["file_path", "file_size", "modified"]
STAGED = ("staged", "carried", "dead", "places_kept", "listed")
DOCUMENT_COLUMNS = ("doc_id", "file_name", "file_path", "file_type", "file_size", "modified_at", "indexed_at", "content_hash", "duplicate_of", "text")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _write_pointer(spark: SparkSession, index_dir: str, version: str) -> None:
    """Swap the pointer: the new one is written beside it and renamed over it, so a reader finds the one or the other."""
    made = f"{index_dir}/.CURRENT-{uuid.uuid4().hex}"
    fs, p = _fs(spark, made)
    out = fs.create(p, True)
    out.write(version.encode())
    out.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    options = gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(_fs(spark, f"{index_dir}/CURRENT")[1]), options)


def current_version(spark: SparkSession, index_dir: str) -> str | None:
    if not exists(spark, f"{index_dir}/CURRENT"):
        return None
    return spark.read.text(f"{index_dir}/CURRENT").first()[0]


class Index:
    """Tables of one version."""

    def __init__(self, spark: SparkSession, index_dir: str):
        version = current_version(spark, index_dir)
        if version is None:
            raise FileNotFoundError(index_dir)
        self.spark, self.root, self.path = spark, index_dir, f"{index_dir}/{version}"

    def table(self, name: str) -> DataFrame:
        return self._lists(name.removeprefix("shard_")) if name in LISTS else self.spark.read.parquet(f"{self.path}/{name}")

    def _lists(self, name: str) -> DataFrame:
        """Posting lists of the live shards of all segments."""
        live, parts = self.table("shard_rows").select("shard"), []
        for segment in self.table("segments").collect():  # a few dozen: `merged` keeps their number small
            rows = self.spark.read.parquet(f"{self.root}/segments/{segment.segment}/{name}")
            parts.append(rows if segment.whole else rows.join(live, "shard", "left_semi"))
        return reduce(DataFrame.unionByName, parts)

    def metadata(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.table("metadata").orderBy("key").collect()}


def build(spark: SparkSession, raw_dir: str, index_dir: str, processed_dir: str | None = None) -> dict:
    """Read all files below `raw_dir` into a new version of the index; returns the counters (`duplicate_rows` has the duplicates)."""
    return _write_version(spark, raw_dir, index_dir, processed_dir, None)


def update(spark: SparkSession, raw_dir: str, index_dir: str, processed_dir: str | None = None) -> dict:
    """Bring the index up to date with `raw_dir`; it answers like one that is built anew.

    Only files of a new path, size or time are read, cut, embedded and listed. Documents and chunks
    of the others are copied under their new numbers; posting lists have none and stay.
    """
    return _write_version(spark, raw_dir, index_dir, processed_dir, Index(spark, index_dir) if current_version(spark, index_dir) else None)


def _write_version(spark: SparkSession, raw_dir: str, index_dir: str, processed_dir: str | None, old: Index | None) -> dict:
    indexed_at = datetime.now(timezone.utc).isoformat(timespec="seconds")
    version = f"v-{uuid.uuid4().hex}"
    out = f"{index_dir}/{version}"
    docs, skipped = _write_documents(spark, raw_dir, out, old, indexed_at)
    numbers = docs.where("duplicate_of is null").withColumn("doc_no", F.substring("doc_id", 5, 19).cast("long"))
    same = _carried(numbers, old, out)
    chunks = _write_chunks(numbers, same, old, out)
    _write_lists(numbers.select(F.col("file_path").alias("source"), "doc_no"), same, chunks, old, index_dir, out)
    spark.createDataFrame([("indexed_at", indexed_at), ("embedding_model", MODEL_LABEL)], "key string, value string").write.parquet(f"{out}/metadata")
    if processed_dir:
        export_jsonl(docs, chunks, processed_dir)
    counts = d.ingest_counters(docs, chunks, skipped).first().asDict()
    _write_pointer(spark, index_dir, version)
    for name in STAGED:
        _delete(spark, f"{out}/{name}")
    return counts | {"indexed_at": indexed_at, "embedding_model": MODEL_LABEL}


def _kept(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_documents(spark: SparkSession, raw_dir: str, out: str, old: Index | None, indexed_at: str) -> tuple[DataFrame, DataFrame]:
    """Documents and skipped files: those of `old` that are still there unchanged, and what was read of the others."""
    files, before = scan_files(spark, raw_dir), []
    if old is not None:
        listed = files.select(*SAME)
        before = [old.table(name).join(listed, SAME, "left_semi") for name in ("documents", "skipped")]
        known = before[0].select(*SAME).unionByName(before[1].select(*SAME))
        # to the driver like all names that Spark lists; contents of other files aren't read
        files = scan_files(spark, raw_dir, [r.file_path for r in listed.join(known, SAME, "left_anti").collect()])
    staged = _kept(extract_texts(files).withColumn("text", t.normalize_text(F.col("text"))), f"{out}/staged")
    good = F.coalesce(F.length("text"), F.lit(0)) > 0
    bad = staged.where(~good).select(*SAME, "file_type", "error")  # with the messages of bad files
    rows = staged.where(good).select(*SAME, "file_name", "file_type", t.iso_utc(F.col("modified")).alias("modified_at"), F.lit(indexed_at).alias("indexed_at"), t.content_hash(F.col("text")).alias("content_hash"), "text")
    if before:
        rows, bad = rows.unionByName(before[0].select(rows.columns)), bad.unionByName(before[1].select(bad.columns))
    rows = d.mark_duplicates(d.number_files(rows), "doc_no", "file_path").withColumn("doc_id", d.doc_id(F.col("doc_no")))
    return _kept(rows.select(*DOCUMENT_COLUMNS, "modified"), f"{out}/documents"), _kept(bad, f"{out}/skipped")


def _carried(numbers: DataFrame, old: Index | None, out: str) -> DataFrame | None:
    """(source, doc_no, old_id): documents whose chunks `old` has."""
    if old is None:
        return None
    held = old.table("documents").where("duplicate_of is null").select(*SAME, F.col("doc_id").alias("old_id"))
    return _kept(numbers.join(held, SAME).select(F.col("file_path").alias("source"), "doc_no", "old_id"), f"{out}/carried")


def _write_chunks(numbers: DataFrame, same: DataFrame | None, old: Index | None, out: str) -> DataFrame:
    new = numbers if same is None else numbers.join(same.select(F.col("source").alias("file_path")), "file_path", "left_anti")
    rows = d.chunk_documents(new, "doc_no").withColumn("embedding", udfs.stored_vector("text"))
    if same is not None:
        held = old.table("chunks").join(same.select(F.col("old_id").alias("doc_id"), "doc_no"), "doc_id")
        rows = rows.unionByName(held.select(rows.columns))
    rows = rows.withColumn("doc_id", d.doc_id(F.col("doc_no"))).withColumn("chunk_no", shards.chunk_no(F.col("doc_no"), F.col("chunk_index")))
    return _kept(d.chunk_ids(rows).select("chunk_no", "chunk_id", "doc_id", "chunk_index", "text", "embedding"), f"{out}/chunks")


def merged(live: dict[str, int], new: int) -> set[str]:
    """The segments that are written again with a segment of `new` chunks.

    These are, from the smallest on, all that have at most twice the chunks gathered so far. So each
    segment left has more than twice those of all smaller ones, their number grows with the
    logarithm of the chunks, and a chunk is written again about as often.
    """
    taken = set()
    for segment, n in sorted(live.items(), key=lambda x: (x[1], x[0])):
        if n > 2 * new:
            break
        taken.add(segment)
        new += n
    return taken


def _write_lists(numbers: DataFrame, same: DataFrame | None, chunks: DataFrame, old: Index | None, index_dir: str, out: str) -> None:
    """Posting lists of a new segment, and the places of all chunks.

    Segments never change. A shard with a chunk that is gone is dead as a whole: its other chunks
    are listed in the new segment, like those of segments that are merged and of new documents.
    """
    spark, segments, places = chunks.sparkSession, [], None
    rest = chunks
    if old is not None:
        held = old.table("places")
        dead = _kept(held.join(same.select("source"), "source", "left_anti").select("segment", "shard").distinct(), f"{out}/dead")
        live = held.join(dead.select("shard"), "shard", "left_anti")
        sizes = {r.segment: r["count"] for r in live.groupBy("segment").count().collect()}
        again = merged(sizes, chunks.count() - sum(sizes.values()))
        hurt = {r.segment for r in dead.select("segment").distinct().collect()} | {r.segment for r in old.table("segments").where("not whole").collect()}
        segments = [(s, s not in hurt) for s in sizes if s not in again]
        live = live.where(~F.col("segment").isin(list(again))).drop("chunk_no").join(same.select("source", "doc_no"), "source")
        places = _kept(live.select("segment", "shard", "place", "source", "chunk_index", shards.chunk_no(F.col("doc_no"), F.col("chunk_index")).alias("chunk_no"), "n_text", "n_tokens"), f"{out}/places_kept")
        rest = chunks.join(places.select("chunk_no"), "chunk_no", "left_anti")
    rest = _kept(rest.select("chunk_no", "text", "embedding"), f"{out}/listed")
    segment = f"s-{uuid.uuid4().hex}"
    if not segments or not rest.isEmpty():
        placed = shards.placed(rest)
        for name, table in {"vectors": shards.vectors(placed), "tokens": shards.tokens(placed), "runs": shards.runs(placed)}.items():
            table.write.parquet(f"{index_dir}/segments/{segment}/{name}")
        segments.append((segment, True))
        new = shards.sizes(placed).withColumn("doc_no", F.shiftright("chunk_no", shards.CHUNK_BITS)).join(numbers, "doc_no")
        new = new.withColumn("segment", F.lit(segment)).withColumn("chunk_index", (F.col("chunk_no") - shards.chunk_no(F.col("doc_no"), F.lit(0))).cast("int"))
        new = new.select("segment", "shard", "place", "source", "chunk_index", "chunk_no", "n_text", "n_tokens")
        places = new if places is None else places.unionByName(new)
    shards.rows(_kept(places, f"{out}/places")).write.parquet(f"{out}/shard_rows")
    spark.createDataFrame(segments, "segment string, whole boolean").coalesce(1).write.parquet(f"{out}/segments")


def prune(spark: SparkSession, index_dir: str) -> int:
    """Delete the versions before the current one and the segments it doesn't name; for when no reader has them open."""
    version, index = current_version(spark, index_dir), Index(spark, index_dir)
    used = {r.segment for r in index.table("segments").collect()}
    gone = [p for p in _names(spark, index_dir) if p.startswith("v-") and p != version]
    gone += [f"segments/{p}" for p in _names(spark, f"{index_dir}/segments") if p not in used]
    for name in gone:
        _delete(spark, f"{index_dir}/{name}")
    return len(gone)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def export_jsonl(docs: DataFrame, chunks: DataFrame, processed_dir: str) -> None:
    """Documents and chunks as JSON lines, nulls kept; chunks without vectors."""
    docs.select(*DOCUMENT_COLUMNS).orderBy(F.substring("doc_id", 5, 19).cast("long")).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{processed_dir}/documents.jsonl")
    named = chunks.join(docs.select("doc_id", "file_name", "file_path", "file_type"), "doc_id").withColumn("embedding_model", F.lit(MODEL_LABEL))
    columns = ["chunk_id", "doc_id", "chunk_index", "file_name", "file_path", "file_type", "embedding_model", "text"]
    named.orderBy("chunk_no").select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{processed_dir}/chunks.jsonl")


def source_rows(spark: SparkSession, index_dir: str) -> DataFrame:
    """Each file of the index with its chunks, by path."""
    index = Index(spark, index_dir)
    return d.sources_report(index.table("documents").select(*DOCUMENT_COLUMNS), index.table("chunks"))


def duplicate_rows(spark: SparkSession, index_dir: str) -> DataFrame:
    """Each duplicate of the index with the file it repeats, by path."""
    return d.duplicate_files(Index(spark, index_dir).table("documents"))


def sources(spark: SparkSession, index_dir: str) -> dict:
    """What the index holds, in counts; `source_rows` and `duplicate_rows` list it."""
    if current_version(spark, index_dir) is None:
        return {"indexed": False, "message": NO_INDEX_REPORT, "sources": []}
    index = Index(spark, index_dir)
    meta, counts = index.metadata(), d.ingest_counters(index.table("documents"), index.table("chunks")).first()
    return {
        "indexed": True, "index_updated_at": meta.get("indexed_at"), "embedding_model": meta.get("embedding_model"),
        "documents": counts["documents"], "indexed_documents": counts["indexed_documents"], "duplicates": counts["duplicates"],
    }


def remove_generated(spark: SparkSession, index_dir: str, processed_dir: str, root: str) -> None:
    """Delete an index and its exports, but only below `root`/index and `root`/processed."""
    names = [index_dir, f"{processed_dir}/documents.jsonl", f"{processed_dir}/chunks.jsonl"]
    full = lambda path: (lambda fs, p: fs.makeQualified(p).toUri().normalize().getPath())(*_fs(spark, path))
    allowed = [full(f"{root}/index"), full(f"{root}/processed")]
    for name in names:
        path = full(name)
        if not any(path == a or path.startswith(a + "/") for a in allowed):
            raise RuntimeError(f"refusing to delete outside {root}: {path}")
    for name in names:
        fs, p = _fs(spark, name)
        fs.delete(p, True)


def rebuild(spark: SparkSession, raw_dir: str, index_dir: str, processed_dir: str, root: str) -> dict:
    remove_generated(spark, index_dir, processed_dir, root)
    return {"rebuilt": True} | build(spark, raw_dir, index_dir, processed_dir)


def dump(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, indent=2)
