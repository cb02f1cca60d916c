"""Spark session defaults for eventloom jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "eventloom") -> SparkSession:
    """Create (or reuse) a session with the settings every eventloom job assumes.

    * UTC session zone: rendered timestamps and window bounds do not depend on the host.
    * AQE on, with partition coalescing and skew-join splitting, so shuffle sizes adapt
      at run time instead of being hand-tuned per scale factor.
    * Spark UI off (no server is opened).
    * ``hugeMethodLimit`` 8000: wide event projections stay JIT-compiled.
    * ``spark.checkpoint.dir`` is only set when the cluster has not set it (tests).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # Generated methods above HotSpot's 8000-byte JIT limit would run interpreted;
          # wide rendering projections are faster split out of whole-stage codegen.
          .config("spark.sql.codegen.hugeMethodLimit", "8000"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is.
    Only when it is unset (local tests) do we pick a scratch folder ourselves.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="eventloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir
