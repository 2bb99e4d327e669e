"""Binary record files through Spark's own writer and reader.

Spark's text writer puts out the bytes of a row and then a separator.  With
records as rows and a separator that belongs to the format (an end-of-document
token, an empty gzip member) its files are plain record files, committed by
Spark's protocol on any file system Spark can write to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, column: str, separator: bytes, path: str, records_per_file: int) -> None:
    """Write the binary ``column`` of each row and ``separator`` after it, at most ``records_per_file`` rows a file."""
    rows = df.select(F.col(column).cast("string").alias("value"))
    # latin-1 maps each byte of the separator to itself
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """shard (hash of the file's path), path, length, content: a row per record file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.xxhash64("path").alias("shard"), "path", "length", "content")
