"""Cuts lineage through the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``; where the session names none, under the warehouse, but only on one machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern"
        context.setCheckpointDir(folder)
    return df.checkpoint()
