"""Tables in the folder that driver and executors share: they cut lineage, and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What this thread has stored since the innermost scratch began.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir; where the session names none, a temporary one, if all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/wayline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (own := _OWN.get()) is not None:
        own.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """df, written once, dealt over parts by key, and read back: joins and sums by key of such tables with as many parts shuffle nothing. No table stays in the catalog."""
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"wayline_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    if (own := _OWN.get()) is not None:
        own.append(path)
    out = spark.table(table).select("*")
    out.schema  # resolved before the name goes; the table is external, so its files stay
    spark.sql(f"DROP TABLE {table}")
    out.__dict__["_stored_at"] = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored table's files before its scratch ends."""
    path = df.__dict__.get("_stored_at")
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what this thread stores inside, at its end, but for the tables put into the list."""
    outer, own, keep = _OWN.get(), [], []
    token = _OWN.set(own)
    try:
        yield keep
    finally:
        _OWN.reset(token)
        kept = {t.__dict__.get("_stored_at") for t in keep}
        for path in own:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)
