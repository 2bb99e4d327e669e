"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a folder of its own; on a
    cluster that is an error, as no local folder is shared there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='specloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/specloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write a frame to the shared folder and read it again.

    Cuts the lineage at a table that outlives lost executors, so that a step
    used more than once is computed once.  Tables stay until their owner clears
    the folder, like Spark's own checkpoints, or ``drop_table`` deletes them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``written`` frame that nothing reads any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
