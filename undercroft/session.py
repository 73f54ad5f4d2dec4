"""Session settings and the shared scratch folder.

Results that are read more than once are written as Parquet to the shared folder, so a
lost executor never loses one.  The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders handed out in the shared folder, for ``clear_scratch``.
_PATHS: set[str] = set()


def build_session(app: str = "undercroft", master: str = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> None:
    """Journal stamps are wall-clock values: they must not move with the session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="undercroft-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables written between two jobs."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.add(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: columns, not whole rows, and a plan that starts there."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table, sent to every task where it has no more than ``rows``: what meets it is not shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clear_scratch(spark: SparkSession) -> int:
    """Removes the tables that this session has stored and no longer reads; gives their number."""
    removed = 0
    for path in list(_PATHS):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        removed += folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _PATHS.discard(path)
    return removed
