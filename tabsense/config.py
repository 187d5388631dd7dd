"""Session and lineage helpers.

Library code never creates a session: it uses ``df.sparkSession``. ``get_session``
exists for tests, the bench and scripts only.
"""
from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8,
                app: str = "tabsense") -> SparkSession:
    """Local session for tests / bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABSENSE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a local
    session (one machine, as in tests) gets a fresh scratch folder; on a cluster that
    would be a folder of the driver alone, so it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tabsense-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that several fit jobs read (recomputable from lineage)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


AGG_CHUNK = 256   # aggregate expressions per job: keeps generated code and plans small


def agg_row(df: DataFrame, exprs: list) -> dict:
    """Evaluate many named aggregate expressions as global aggregates and return
    one merged dict. Wide frames are split into several jobs of at most
    ``AGG_CHUNK`` expressions, so a 1,000-column table never builds one giant
    aggregate (slow planning, code too large to compile)."""
    out: dict = {}
    for i in range(0, len(exprs), AGG_CHUNK):
        row = df.agg(*exprs[i:i + AGG_CHUNK]).first()
        out.update(row.asDict(recursive=False) if row is not None else {})
    return out

