"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to so many bytes, as counted before the join.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later jobs survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit the limit; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ascii_lower(column):
    """A-Z to a-z, all else untouched (``lower`` would fold other alphabets too)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Like ``names``, with underscores added until no column of ``df`` has the name in any spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, exactly spelled, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def texts_of(column) -> list[str | None]:
    """An Arrow column's texts; Spark's strings may hold bytes that are not UTF-8, which become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast("binary").to_pylist()]
