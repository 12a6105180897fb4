"""Tables that cut lineage: written in the shared folder and read back, so that a lost executor costs no recomputation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: one under the warehouse in local mode, and an error on a cluster, whose machines may share none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def settle(df: DataFrame) -> DataFrame:
    """df as a written table; it goes when the application ends, or when it is released."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    store, where = _store(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables whose last reader has itself been settled."""
    for df in tables:
        store, where = _store(df.sparkSession, df._settled)
        store.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt anew where it is read from fewer files than there are cores: a scan cannot deal out less than a file's row groups, and parsing a text costs far more than moving it.
    Larger tables stay as they are."""
    files, cores = len(df._jdf.inputFiles()), df.sparkSession.sparkContext.defaultParallelism  # names stay where they are listed
    return df.repartition(cores) if 0 < files < cores else df
