"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage: what was computed is read again instead of recomputed when an
executor is lost. The folder is the session's ``spark.checkpoint.dir``; only a local session without one
(tests, a laptop) gets a temporary folder, elsewhere its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one of its own only for local sessions that have none."""
    found = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trackweave-')}"
        spark.conf.set(SETTING, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    ``few`` writes a quarter of the session's shuffle partitions as files (two a core at least), for
    tables that are small for their number of partitions; not for stages whose functions look at their
    partition's number.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if few:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions_for(df) // 4))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark).rstrip("/").split(":")[-1].lstrip("/")
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions as the session has them: sized by the cluster's owner for its data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain column names by position: batch functions over columns of any name need that."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))
