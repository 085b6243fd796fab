"""Spark session helpers.

The library never creates a session behind the caller's back: every public
function takes DataFrames (and reads ``df.sparkSession`` when it needs one).
``local_session`` is only for tests, the bench and the driver contract.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Iterative operators (connected components) cut lineage with reliable
# checkpoints. On a cluster ``spark.checkpoint.dir`` must name a shared
# folder; we only invent one when the session has none (local tests).
_CKPT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FAULTLINE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get(_CKPT_CONF, None) or sc.getConf().get(_CKPT_CONF, None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="faultline-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df: DataFrame, how: str = "parquet") -> DataFrame:
    """Cut lineage: write ``df`` once under the session's checkpoint folder
    and read it back (``how="parquet"``), or use a reliable RDD checkpoint
    (``how="checkpoint"``).

    The Parquet form computes the plan exactly once, stores it columnar and
    compressed, and keeps column statistics for later pruning. The folder is
    the shared ``spark.checkpoint.dir`` (never a machine-local temp folder on
    a cluster), so a lost executor re-reads the files instead of recomputing.
    """
    spark = df.sparkSession
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/faultline-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Folders that ``materialize`` wrote in this process and ``cleanup`` has not removed.
_WRITTEN: list[str] = []


def cleanup(spark: SparkSession) -> int:
    """Delete what ``materialize`` wrote so far; returns the number of folders.

    Frames are lazy, so a result may read such a folder until it has been
    written or collected: call this after the results of a run are stored.
    """
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which nothing may read any more."""
    folders = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for written in [w for w in _WRITTEN if os.path.basename(w) in folders]:
        _WRITTEN.remove(written)
        path = jvm.org.apache.hadoop.fs.Path(written)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more
    (it does so when the driver's garbage is collected, else much later)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``faultline`` importable in the Python workers.

    The pandas functions of the pairwise, DBSCAN and K-Means operators are
    pickled by reference to this package, so every executor needs it. This
    zips the package once per application and distributes it with
    ``SparkContext.addPyFile`` (what ``--py-files`` does at submit time);
    a deployment that already ships the package can skip it.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="faultline-pkg-"), "faultline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
