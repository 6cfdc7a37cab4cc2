"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is `spark.checkpoint.dir`; only where that is unset in a local session (tests) a temporary
    folder is chosen and set as the checkpoint folder. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    The result has no lineage to recompute, survives lost executors, and tells the planner its
    true size, so a later join is a broadcast only when it is small.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Delete the tables and archives written inside the block, but for those whose label is in `keep`.

    Only for results that are complete at its end: DataFrames read these tables when they run.
    """
    before = len(_made)
    yield
    made, _made[before:] = _made[before:], []
    for app, path in made:
        if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] in keep:
            _made.append((app, path))
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete all that this session's operators have written; results not yet read are lost."""
    own = [m for m in _made if m[0] == spark.sparkContext.applicationId]
    _made[:] = [m for m in _made if m not in own]
    with scratch(spark):
        _made.extend(own)


#: A row's place: its file and its number there. It tells apart rows that are alike in all columns.
ROW_KEY = ("_file", "_row")


def _place(docs: DataFrame) -> list:
    at = docs.metadataColumn("_metadata")
    return [F.xxhash64(at["file_path"]).alias(ROW_KEY[0]), at["row_index"].alias(ROW_KEY[1])]


def stable(docs: DataFrame, label: str = "rows") -> DataFrame:
    """`docs`, whose rows can be told apart by ROW_KEY: a frame that isn't read from Parquet is written first."""
    try:
        docs.select(*_place(docs)).schema
    except AnalysisException:
        return materialize(docs, label)
    return docs


def with_row_key(docs: DataFrame, *columns) -> DataFrame:
    """`columns` of a stable frame and its ROW_KEY, which is the same on every reading."""
    return docs.select(*columns, *_place(docs))


def whole_rows(docs: DataFrame) -> DataFrame:
    """ROW_KEY and `_doc`, a struct of all columns of a stable frame; their names can't clash with others."""
    return with_row_key(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"))


def word_count(text):
    """Column: the number of words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Ids that are broadcast to pick or drop their rows, at most (16 MB); with more the join shuffles.
BROADCAST_IDS = 2_000_000


def few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """`df` marked for broadcast if it has `most` rows at most, which are counted."""
    return F.broadcast(df) if df.count() <= most else df


def without_rows(docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """The rows of the stable frame `docs` whose ROW_KEY isn't in `dropped`."""
    dropped = few(materialize(dropped.select(*ROW_KEY), label), BROADCAST_IDS // 2)
    return whole_rows(docs).join(dropped, list(ROW_KEY), "left_anti").select("_doc.*")


def token_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
