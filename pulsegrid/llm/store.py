"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.session import drop_folder, scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table below ``spark.checkpoint.dir``: cuts the lineage, survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Such a table and its folder, for one that is dropped before the end."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(df: DataFrame, path: str) -> None:
    """Removes a table that nothing unwritten is read from any more."""
    drop_folder(df.sparkSession, path)
