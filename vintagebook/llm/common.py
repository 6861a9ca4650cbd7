"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word throughout, for Java's and DuckDB's patterns.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch handed to Python, so that very long texts don't add up.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that their Python finds it wherever it starts."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    # on the driver, which serves it to executors for as long as it runs
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` after bounding the bytes of the Arrow batches its session sends to Python, and sending its executors this package."""
    shipped(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


#: A key is hot if it holds more than one in so many rows; that many keys at most are hot.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, found: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` left joined with ``found``, which has one row per ``key`` and in ``size`` how many of the ``n_rows`` rows hold it.

    Hot keys, fewer than ``HOT_SHARE`` by their definition, are broadcast, so that their rows
    stay where they are; the other keys, none of which is large, meet by a shuffle.
    ``found`` should be a stored table: it is read several times.
    """
    bound = n_rows // HOT_SHARE
    hot = F.broadcast(found.where(F.col(size) > bound))
    near = rows.join(hot, key)
    others = rows.join(hot.select(key), key, "left_anti").join(found.where(F.col(size) <= bound), key, "left")
    return near.unionByName(others)
