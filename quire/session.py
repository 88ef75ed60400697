"""Session settings for document analytics."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit any size: adaptive plans, skewed joins split, last value wins in merged maps, UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quire", master: str | None = None, **settings: str) -> SparkSession:
    """A session with this package's settings; ``master`` is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder of spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return df.checkpoint()
