"""Cutting of lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written below ``spark.checkpoint.dir``: its partitions stay as they are, and a lost executor costs a read.

    Without that setting only local mode works, with a temporary folder. Spark deletes the files with the last reference to
    them where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="stratalog-"))
    return df.checkpoint()
