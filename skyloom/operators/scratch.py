"""Tables in the folder that driver and executors share, to cut lineage between dependent steps; columns computed once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session that runs in one process may go without, in the driver's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def settled(df: DataFrame, label: str = "step") -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, whatever later filters and projections refer to them.

    Projections are merged into those above them, and expressions repeated; a generator of a single struct is not.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.explode(F.array(row)).alias("__once")).select(*kept, *[F.col("__once").getField(n).alias(n) for n in columns])
