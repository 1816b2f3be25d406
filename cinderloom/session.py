"""Session factory and run-wide settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "cinderloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under.

    On a cluster the session comes from the launcher; nothing in the library depends on the
    values below other than the UTC time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the cluster names, else (local tests only) a fresh one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cinderloom-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()
