"""Tables that a session's queries share: each is written once for each set of input files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import session

_tables: dict[tuple, DataFrame] = {}


def _version(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells a state of the input files from another: their paths, sizes and times."""
    out = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def stored(spark: SparkSession, source: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` made from the files that `source` reads, written by the first query that needs it."""
    key = (spark.sparkContext.applicationId, name, _version(spark, source.inputFiles()))
    if key not in _tables:
        _tables[key] = session.scratch_table(make(), name)
    return _tables[key]


def release(spark: SparkSession) -> None:
    """Delete the session's tables; the next query that needs one writes it anew."""
    for key in [k for k in _tables if k[0] == spark.sparkContext.applicationId]:
        del _tables[key]
    session.release(spark)
