"""The project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; timestamps without zone are read as the session's (UTC) timestamps."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
