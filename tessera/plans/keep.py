"""Stages written in the shared folder: their readers' plans stay short, and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and driver and
    executors are one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as Parquet, read back: at ``folder``/``name``, or under a new name in the shared folder, where it stays until that
    is cleaned. Spark describes a plan kept by persist again in the plans of its readers, which grow long where kept plans nest."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}" if folder else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
