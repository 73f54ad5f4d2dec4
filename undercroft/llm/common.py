"""Helpers shared by the operators: column names, staged tables, sizes."""

from __future__ import annotations

from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.session import scratch_path

#: ASCII white space and its opposite, as the contracts write them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Where a staged table stands, as long as its frame lives.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: a lost executor loses nothing of it."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def swept(df: DataFrame, name: str) -> DataFrame:
    """Like ``staged``; the shuffle files of the write go as soon as the table stands, not with the session."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    was = conf.get(key, "false")
    conf.set(key, "true")
    try:
        out = staged(df, name)
    finally:
        conf.set(key, was)
    return out


def forget(*frames: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in frames:
        path = _PATHS.pop(df, None)
        if path is not None:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sized(rows: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` rows."""
    return max(least, -(-rows // each))


def schema_of(spec: str) -> str:
    """'a:long b:string' as a DDL schema."""
    return ", ".join(f"{n} {t}" for n, t in (x.split(":") for x in spec.split()))


def text_batches(batches: Iterable, text: str, most: int = 4_000_000):
    """Arrow batches cut into slices of about ``most`` bytes of text; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(length) // most).astype(int)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
