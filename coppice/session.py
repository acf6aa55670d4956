"""Session set-up and durable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_SPLIT = 10_000
_CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "coppice", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators count on (AQE on, UTC)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="coppice-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the session.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    path would vanish with its machine, so the setting is required there.
    """
    configured = spark.conf.get(_CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a shared folder before staging tables")
    return _local_dir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/coppice/{label}-{uuid.uuid4().hex}"


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of an under-split scan over all cores; a larger scan is left alone.

    Only for tables straight from storage: asking a plan with shuffles for its number of
    partitions would run it. For work that costs far more per row than moving the row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stage(df: DataFrame, label: str = "stage", spread: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage with a copy that outlives executors, and, unlike ``checkpoint()``,
    keeps column pruning and filter pushdown for every later pass. ``spread=True`` rewrites
    a table with fewer scan splits than cores (small by definition: under one split per
    core) into more files, so that model fitting can use the whole cluster, but not into
    files of fewer than ``ROWS_PER_SPLIT`` rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if not spread:
        return staged
    splits = staged.rdd.getNumPartitions()
    if splits < cores:
        wanted = min(cores, staged.count() // ROWS_PER_SPLIT)
        if wanted > splits:
            wide_path = new_path(spark, f"{label}-spread")
            staged.repartition(wanted).write.parquet(wide_path)
            staged = spark.read.schema(df.schema).parquet(wide_path)
    return staged


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="coppice-py-"))  # the driver serves the file from here
    with zipfile.ZipFile(folder / "coppice.zip", "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(folder / "coppice.zip"))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
