"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that driver and executors share (spark.checkpoint.dir), so
    that plans of a loop don't grow. Where none is set and all runs in one process, as in tests, a
    folder is made; on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="locusflow-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
