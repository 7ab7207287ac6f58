"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Shuffle partitions and scan split sizes belong to the cluster and are left alone;
    pass them as ``conf`` where they are known.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint directory that all executors can reach.

    The cluster names that directory in ``spark.checkpoint.dir``. Only a local session may do
    without: one machine shares its temporary folder with itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="wardline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
