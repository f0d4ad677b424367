"""Session helpers: shipping the package to workers, cutting lineage, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict[str, bool] = {}
_FALLBACK: list[tempfile.TemporaryDirectory] = []

#: Rows of an Arrow batch.
ARROW_ROWS = 1000
#: Rows of a key list that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it.

    Also lowers the rows of an Arrow batch from Spark's default: rows can be long texts,
    and a batch stands in memory both in the JVM and in the worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    _SHIPPED[sc.applicationId] = True
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillgrid-")
    target = os.path.join(folder, "quillgrid_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path("quillgrid") / path.relative_to(root)))
    sc.addPyFile(target)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one where none is configured, in local mode (tests) only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.TemporaryDirectory(prefix="quillgrid-ck-"))
    return _FALLBACK[0].name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder: later stages do not recompute it if executors are lost.

    Its shuffle files, which nothing reads again, are removed at once.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow key list for broadcast only if it has at most ``rows`` rows; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def together(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key``, in four times the usual number of partitions and never fewer, as its rows are narrow and what is made of them is not."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
