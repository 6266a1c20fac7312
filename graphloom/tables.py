"""Readers for the tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of the directory, a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
