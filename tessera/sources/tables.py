"""The tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One table: a file or a folder ``<name>.parquet``.

    ``spread``: for work that costs much per row, a table of fewer splits than cores is dealt out to all cores; tables of more splits are read as they are.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # a plain scan: counting its splits runs nothing
    return df.repartition(cores) if spread and df._jdf.rdd().getNumPartitions() <= cores // 2 else df
