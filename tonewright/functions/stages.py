"""Results that later steps read many times, written where lost executors don't take them along."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialised(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder (`spark.checkpoint.dir`); only a master in this process alone may do without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tonewright-checkpoint-"))
    return df.checkpoint(eager=True)
