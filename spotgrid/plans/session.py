"""Session set-up and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders of the workspaces that are open, the innermost last.
_workspaces: list[str] = []


def local_session(cores: int | str = "*", app: str = "spotgrid") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without
    the setting is an error, since a machine-local folder is lost with its host.
    """
    if _workspaces:
        return _workspaces[-1]
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    made = tempfile.mkdtemp(prefix="run-spotgrid-")
    context.setCheckpointDir(made)
    return made


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder for a written table."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one for all checkpoints and written tables inside the block, removed at its end.

    Results that depend on them are to be materialised inside the block.  One block is
    open at a time per driver, or blocks inside one another.
    """
    context = spark.sparkContext
    outer = shared_root(spark)
    folder = shared_folder(spark, "workspace")
    _workspaces.append(folder)
    context.setCheckpointDir(f"{folder}/checkpoints")
    try:
        yield folder
    finally:
        _workspaces.pop()
        context.setCheckpointDir(outer if not _workspaces else f"{outer}/checkpoints")
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably, so that lost executors never replay earlier steps."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
