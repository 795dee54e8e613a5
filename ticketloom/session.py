"""Session settings every operator relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot tenant is worth one more exchange; an unsplit skewed task is not
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lists, maps and timers in the state of a stream
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the results depend on (UTC days) or scale with (AQE), and make the
    package known to the workers."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context, wherever the session was started."""
    context = spark.sparkContext
    if getattr(context, "_ticketloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="ticketloom-package-"), "ticketloom")
    context.addPyFile(shutil.make_archive(target, "zip", root_dir=root, base_dir="ticketloom"))
    context._ticketloom_shipped = True


def build(app: str = "ticketloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is unset,
    as in local tests, a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"ticketloom-{purpose}-") + "/data"


def checkpointed(df, purpose: str = "cut"):
    """Cut a long lineage by writing the frame to the shared folder and reading it back.

    Unlike a local checkpoint this survives the loss of an executor.
    """
    path = os.path.join(shared_dir(df.sparkSession, purpose), "frame")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
