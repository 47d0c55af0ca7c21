"""Small helpers that the training-data operators share.

Conventions that hold for every operator of this subpackage:

* only the columns an operator names are read, so further columns, also ones whose names clash with its
  outputs, change nothing;
* a null text counts as an empty one unless the operator says otherwise;
* repeated rows stay repeated rows.
"""

from __future__ import annotations

import gc
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Arrow gives what it frees back to the system, so that workers that live on between stages stay small.
pa.set_memory_pool(pa.system_memory_pool())


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local one if all of Spark runs here, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="loom-ckpt-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; lost executors do not lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """A checkpoint after which the shuffle files of what led to it can go."""
    out = checkpointed(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def spread_join(rows: DataFrame, stats: DataFrame, keys: list[str], count: str, many: int = 2000) -> DataFrame:
    """``rows`` with the columns of ``stats``, which has one row for each of some keys and in ``count`` how many rows have it.

    Keys that have more than one in ``many`` of these rows are fewer than ``many``, so their stats are broadcast and their
    rows stay spread out; the others meet in a shuffle.  ``stats`` is read several times and should be stored.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    more = [c for c in stats.columns if c not in keys]
    hot = stats.where(F.col(count) > total / many).select(*[F.col(c).alias(f"_hot_{c}") for c in stats.columns])
    cold = stats.select(*[F.col(c).alias(f"_cold_{c}") for c in stats.columns], F.lit(0).cast("long").alias("_cold_salt"))
    is_hot = F.col(f"_hot_{count}").isNotNull()
    dealt = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    # No stats have a salt besides 0, so rows of hot keys meet nothing in the shuffle.
    dealt = dealt.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    joined = dealt.join(cold, [F.col(k) == F.col(f"_cold_{k}") for k in keys] + [F.col("_salt") == F.col("_cold_salt")], "left")
    return joined.where(is_hot | F.col(f"_cold_{count}").isNotNull()).select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in more])


def kept_names(columns: list[str], taken: set[str]) -> list[str]:
    """Names of kept columns in a result that has the columns ``taken``: those that clash get ``in_`` in front."""
    out: list[str] = []
    for c in columns:
        while c in taken or c in out:
            c = f"in_{c}"
        out.append(c)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_list(values) -> Column:
    """A literal ``array<bigint>``; one string literal that the optimizer folds, however many values."""
    values = list(values)
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def below_count(splitters: list[int], key: Column) -> Column:
    """How many of the ascending ``splitters`` are at most ``key``: a binary search in Catalyst expressions."""
    n = len(splitters)
    if n == 0:
        return F.lit(0).cast("int")
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    table_ = long_list(splitters)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.try_element_at(table_, at + step) <= key), at + step).otherwise(at),
    )


def unit_interval(key: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))


# ---- Arrow side -----------------------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * column.offset)
    start, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, count=end - start, offset=start) if end > start else np.zeros(0, np.uint8)
    return data, offsets - start


def row_blocks(batch: pa.RecordBatch, column: str, most: int):
    """Slices of ``batch`` whose texts hold about ``most`` bytes, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
