"""Session defaults and the two helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "statuta", cores: str = "*", **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; keyword settings override the defaults. Master,
    memory and shuffle partitions are those of the cluster if the program was submitted to
    one (or names a master itself); only otherwise it runs in this process."""
    builder = SparkSession.builder.appName(app)
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or "spark.master" in conf
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if not submitted:
        defaults |= {"spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later branches read
    identical rows even if executors are lost. The folder is the one named in
    ``spark.checkpoint.dir``. Where none is named, a temporary one is used if everything
    runs in this process; on a cluster that is an error, as every executor would write
    its own disk."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="statuta-checkpoint-"))
    return df.checkpoint()
