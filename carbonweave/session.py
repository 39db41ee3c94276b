"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

#: Rows and bytes (as text) above which a side is never offered for broadcast by our own hints.
BROADCAST_ROW_BOUND = 50_000
BROADCAST_BYTE_BOUND = 16_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: `spark.checkpoint.dir` where the cluster names one; our own only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise SessionError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "carbonweave-checkpoints"))
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: the lineage ends in files that all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, most: int = BROADCAST_ROW_BOUND, most_bytes: int = BROADCAST_BYTE_BOUND) -> bool:
    """Whether the side has at most `most` rows and, written out, at most `most_bytes` bytes; at most `most` + 1 rows are looked at."""
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= most and (size or 0) <= most_bytes


def small(df: DataFrame, most: int = BROADCAST_ROW_BOUND, most_bytes: int = BROADCAST_BYTE_BOUND) -> DataFrame:
    """Hints a broadcast only after counting the side's rows and bytes; else leaves the join to shuffle."""
    return broadcast(df) if is_small(df, most, most_bytes) else df


def python_tasks(spark: SparkSession) -> int:
    """Tasks for a Python stage whose input is far smaller than its work, which adaptive execution would put into one."""
    return 2 * spark.sparkContext.defaultParallelism


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers through Spark's own file server, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":
        path = os.path.join(tempfile.mkdtemp(prefix="carbonweave-"), "carbonweave.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)


class SessionError(RuntimeError):
    """A session cannot be had: settings are missing or the master does not answer."""


def connect(master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session from the given settings, or from SPARK_MASTER in the environment."""
    master = master or os.environ.get("SPARK_MASTER")
    if not master:
        raise SessionError("set SPARK_MASTER or give a master")
    try:
        return SparkSession.builder.master(master).config(map=settings or {}).getOrCreate()
    except Exception as e:  # noqa: BLE001
        raise SessionError(str(e)) from e
