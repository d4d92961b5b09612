"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table `folder`/`table`.parquet.

    A table that is one file no larger than one split is one task's work, however many cores there are: its rows are dealt out to all of them, which costs a
    shuffle of that one split at most. Folders of files are read as they come.
    """
    path = f"{folder}/{table}.parquet"
    df = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    if cores > 1 and fs.isFile(at) and fs.getFileStatus(at).getLen() <= split:
        return df.repartition(cores)
    return df
