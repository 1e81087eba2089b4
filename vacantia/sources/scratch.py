"""Cutting the lineage of a DataFrame through a table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a local session may leave it unset; it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="vacantia-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` written and read again: later steps start from its rows, whatever executors are lost, and its plan is short."""
    at = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at)
