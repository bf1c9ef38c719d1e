"""Cutting lineage through Parquet tables in the cluster's shared checkpoint folder.

A plan that is read by several later steps, or that grows with each iteration, is written once to the folder
named by ``spark.checkpoint.dir`` and read back.  Such a table survives the loss of any executor, which a cached
or locally checkpointed DataFrame does not.  Only where the setting is unset in a local session (tests) is a
temporary folder used; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import UsageError

_fallback: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _fallback
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise UsageError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="lodestone-")
    return f"file://{_fallback}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and return a scan of it.

    group_rows is the number of rows that Parquet holds and reads at once, for rows of some MB.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    large = {} if group_rows is None else {"parquet.block.row.count.limit": str(group_rows), "parquet.page.row.count.limit": str(group_rows)}
    df.write.options(**large).parquet(path, compression=compression)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestone_path", None)
        for entry in [e for e in _written if e[1] == path]:
            _written.remove(entry)
            _delete(*entry)
