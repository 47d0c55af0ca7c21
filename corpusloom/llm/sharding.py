"""Sharding by sampled splitters (DataFrame functions only).

1. One scan reduces a row to its key, size and checksum.  The key is a hash of the text, so equal texts are
   neighbours in key order.
2. Keys are sampled with a probability proportional to their size, and the sample's quantiles become the
   splitters of many small key ranges.
3. Rows find their range by binary search.  A range that came out overfull (one text with many copies, say) is
   subdivided by a second key, a hash of the record's id.
4. The ranges, whose exact sizes are known by now, are dealt to the shards, largest first.

The driver only holds splitters and range totals: their number depends on the parameters, not on the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import below_count, checkpointed, long_list, unit_interval


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 16,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 256,
    samples_per_range: int = 12,
    overfull: float = 2.0,
) -> DataFrame:
    """Shards whose sizes in bytes are nearly equal.

    Returns ``id_col, size, text_crc32, shard, slot`` for each row.  ``size`` is the text's UTF-8 bytes plus 1, and 1
    for a null text, whose ``text_crc32`` is that of an empty one.  ``slot`` counts a shard's rows from 0 without gaps.  Rows
    with equal texts share a range, and so a shard, unless that range is overfull; rows that agree in everything
    are interchangeable.  An empty input gives an empty output.
    """
    base = checkpointed(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"),
            F.xxhash64(F.col(text_col)).alias("_key"),
            F.xxhash64(F.col(id_col).cast("string"), F.lit("second key")).alias("_sub"),
        )
    )
    total = base.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()["n"]
    n_ranges = n_shards * ranges_per_shard

    # Size-weighted sample; equal keys are counted where they are found.
    chance = F.col("_size") * F.lit(n_ranges * samples_per_range / max(total, 1))
    sampled = (
        base.where(unit_interval(F.xxhash64("_key", "_sub", F.lit("sample"))) < chance)
        .groupBy("_key").agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("w"))
        .collect()
    )
    splitters, held, step = [], 0.0, sum(r["w"] for r in sampled) / n_ranges
    for row in sorted(sampled):
        held += row["w"]
        if held >= step and len(splitters) < n_ranges - 1:
            splitters.append(row["_key"] + 1 if row["_key"] < (1 << 63) - 1 else row["_key"])
            held -= step * int(held / step)

    ranged = base.withColumn("_range", below_count(splitters, F.col("_key")))
    share = total / n_ranges
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.sum("_size").alias("n")).collect()}
    parts = [max(1, -(-int(sizes.get(i, 0)) // max(1, int(share))) if sizes.get(i, 0) > overfull * share else 1)
             for i in range(len(splitters) + 1)]
    first = [0]
    for p in parts:
        first.append(first[-1] + p)
    at = F.col("_range") + 1
    units = ranged.withColumn(
        "_unit",
        (F.element_at(long_list(first[:-1]), at)
         + F.floor(unit_interval(F.col("_sub")) * F.element_at(long_list(parts), at))).cast("int"),
    )
    filled = {r["_unit"]: (r["n"], r["c"])
              for r in units.groupBy("_unit").agg(F.sum("_size").alias("n"), F.count("*").alias("c")).collect()}
    heap = [(0, s) for s in range(n_shards)]
    shard_of, offset_of, rows_in = [0] * first[-1], [0] * first[-1], [0] * n_shards
    for unit, (n, count) in sorted(filled.items(), key=lambda x: (-x[1][0], x[0])):
        held, s = heapq.heappop(heap)
        shard_of[unit], offset_of[unit] = s, rows_in[s]
        rows_in[s] += count
        heapq.heappush(heap, (held + n, s))

    unit_at = F.col("_unit") + 1
    rank = F.row_number().over(Window.partitionBy("_unit").orderBy("_key", "_sub", "_id"))
    return units.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.element_at(long_list(shard_of), unit_at).cast("int").alias("shard"),
        (F.element_at(long_list(offset_of), unit_at) + rank - 1).cast("long").alias("slot"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
