"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
and the master is local (tests on one machine) a folder of our own is used.  On
a cluster the setting must name a folder that all executors share.  Tables written here cut
the lineage and survive the loss of executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="lakeweave-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again.

    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that nothing needs any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
