"""Session defaults used by the tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "textloom", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow; a cluster passes its own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Inputs below this estimate are spread over all cores: a small file is one row group and so one task.
SMALL_BYTES = 8 << 20


def spread(df):
    """``df`` over all cores if it is small; larger inputs keep the partitions of their files and are not shuffled.

    For operators that spend much on each row.  The estimate is the optimizer's, so no job runs for it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def checkpointed(spark: SparkSession, df):
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that
    is unset, a local session takes a fresh folder of its machine; a cluster raises,
    since its executors share no such folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)
