"""Session construction and the shared folder used to cut lineage.

Library code never builds its own session: every operator takes DataFrames
and reaches the session through them. ``local_session`` is for tests, the
bench and the driver entry only.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours should carry, local or cluster.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # selective join sides (a month of sales, keyword products) prune the
    # large scan on the other side with a runtime bloom filter
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # zone-less timestamps on both sides of the oracle check
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state for the streaming stock deduction
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "storeline") -> SparkSession:
    """A local session for tests and benches (UI off, no server opened)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        # drop reliable checkpoints once their DataFrames are garbage
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system path and is used as
    is. Only when it is unset and the master is local (tests) do we pick a
    fresh local folder; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="storeline-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_base_conf(spark: SparkSession) -> None:
    """Apply the run-time settings of ``BASE_CONF`` that may change late and that the session does not set itself."""
    own = spark._jsparkSession.conf()
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql.") and "stateStore" not in k and not own.contains(k):
            spark.conf.set(k, v)


def ship_package(spark: SparkSession) -> None:
    """Make ``storeline`` importable in executor Python workers.

    Operators that run Python inside tasks (``mapInPandas``, the stateful
    stream) pickle functions by module path, so every worker must be able to
    import the package. The package is zipped on the driver and shipped with
    ``addPyFile`` (the same mechanism as ``--py-files``), once per context.
    """
    sc = spark.sparkContext
    if getattr(sc, "_storeline_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="storeline-pyfiles-"), "storeline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._storeline_shipped = True
