"""Session defaults and the two cluster-facing helpers: stage tables and size-checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE_DIR_KEY = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 20_000
_local_stage: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lectern") -> SparkSession:
    """A local session with the settings the jobs are tuned for; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a session in one process may do without and gets a new temporary folder."""
    root = spark.sparkContext.getConf().get(STAGE_DIR_KEY, None) or spark.conf.get(STAGE_DIR_KEY, None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {STAGE_DIR_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_stage:
        _local_stage[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_stage[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that a job can start from any folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{home.name}.zip"  # the driver's own; Spark sends the file
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, keeps column pruning."""
    spark = df.sparkSession
    path = os.path.join(stage_root(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if before is not None:  # nothing reads the shuffles of a finished table again
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table holds at most `rows` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def attach(big: DataFrame, side: DataFrame, on, how: str = "inner", bound: DataFrame | None = None,
           rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that is expected to be small to a big table.

    Row estimates behind explodes are unreliable, so the choice is made on a checked
    row count: of the side itself, or of a cheaper table `bound` that has at least as
    many rows. Within the limit the side is broadcast and the big table is not shuffled;
    beyond it both are shuffled and AQE splits the partitions of hot keys.
    """
    if fits(side if bound is None else bound, rows):
        return big.join(F.broadcast(side), on, how)
    return big.join(side.hint("shuffle_hash"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that is cut into fewer splits than there are cores one task per core.

    A no-op for any input large enough to fill the cluster, so nothing big is ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
