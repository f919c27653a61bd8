"""Shared helpers: table access, ASCII lower-casing, tables kept in the shared checkpoint folder, and bitmaps of ids."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.textblocks import mix


#: Bytes of an Arrow batch; texts would else fill batches of 10,000 rows, whose copies count against the executor's memory.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; the session's Arrow batches are bounded by bytes from then on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does it for pure ASCII; other texts take the per-character way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables written by ``stored`` in this process and not yet dropped.
_STORED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several later steps read, as Parquet in the shared folder, and reads it back.

    It survives lost executors, cuts the lineage, and later reads prune its columns. ``drop_stored`` removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.parquet(path)


def stored_now() -> list[str]:
    """The paths of the stored tables; those of a result's own making are the ones added while it was built."""
    return list(_STORED)


def drop_stored(spark: SparkSession, keep: tuple[str, ...] | list[str] = ()) -> None:
    """Removes the stored tables but those in ``keep``, once what was built on them has been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _STORED if p not in keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _STORED.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """A small frame checkpointed into the shared folder; Spark's cleaner drops the files when nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a bitmap of ids, 2 MB whatever the number of ids.
BITMAP_BITS = 24


def places(columns: list[np.ndarray], bits: int) -> np.ndarray:
    at = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        at = mix(at ^ (c.astype(np.int64, copy=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return (at >> np.uint64(64 - bits)).astype(np.int64)


def held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bitmap_of(rows: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashed rows (long columns). It has a fixed size, and what it holds errs on the side of "may"."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(places([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns], bits))
                word, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

    found = rows.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def may_be_in(rows: DataFrame, bits: int = BITMAP_BITS) -> Callable[..., Column]:
    """A test on columns whether their row may be among ``rows``. The bitmap goes to every task, so that what a join would drop is not shuffled for it."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap_of(rows, bits))

    @F.arrow_udf("boolean")
    def may_hold(*columns: pa.Array) -> pa.Array:
        return pa.array(held(shared.value, places([c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns], bits)))

    return may_hold


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose doc_id may be among ``ids`` (one column), and rows whose doc_id is not; the join decides.

    Only the ids go to Python; the texts stay in the JVM.
    """
    maybe = may_be_in(ids.select(F.col(ids.columns[0]).cast("long")))(F.col("doc_id").cast("long"))
    return docs.where(maybe), docs.where(~maybe)
