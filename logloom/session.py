"""What an operator needs from the session it is handed."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names for all its machines, if it names one."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per application.

    Workers need not share the driver's ``sys.path``; the package travels as a
    zip through Spark's own file distribution.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path("logloom") / p.relative_to(root))), p.read_bytes())
    shared = (shared_folder(spark) or "").removeprefix("file://")
    base = Path(shared) if shared and "://" not in shared else Path(tempfile.gettempdir())
    folder = base / f"logloom-{sc.applicationId}"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "logloom.zip"
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the cluster's shared folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset,
    as in tests, a folder of this machine is used.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession) or os.path.join(tempfile.gettempdir(), "logloom-checkpoints"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder, seen by all machines of the cluster, for what a query writes in between."""
    base = shared_folder(spark) or os.path.join(tempfile.gettempdir(), "logloom-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """Number of partitions for an exchange in front of Python work.

    Given explicitly, because adaptive coalescing looks at bytes only and would
    put a small but computation-heavy input into a few tasks.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than those; else as it is, without an exchange.

    For computation-heavy passes over inputs of few files or row groups.  Large inputs have more partitions than there are cores.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
