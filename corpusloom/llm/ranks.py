"""Gapless numbers of rows in a total order, without a window over a whole group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def runs_of(column) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the runs of equal neighbours (nulls are equal) in an Arrow column."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return first, np.diff(np.append(first, n))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos`` (from 0 within its ``group``) and ``n`` (rows of the group), and the largest ``n``.

    Rows are sorted by range on group, ``order`` and at last a number of their own, so a large group or many equal rows
    spread over partitions, and stored.  The driver gets one line for each partition: the rows of its first and last
    group, from which it sums where the first group of each partition goes on.  ``rows`` is read twice and should be stored.
    """
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_own")]
    ranged = rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own")
    stored = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))

    def edges(batches):
        lines: list[list] = []  # part, group, rows: all runs of one part in turn, of which the first, the last and the longest stay
        for batch in batches:
            groups, parts = batch.column(group), batch.column("_part")
            for at, size in zip(*(x.tolist() for x in runs_of(groups))):
                line = [parts[at].as_py(), groups[at].as_py(), size]
                if lines and lines[-1][:2] == line[:2]:
                    lines[-1][2] += size
                else:
                    lines.append(line)
                    if len(lines) > 3:
                        lines[1:3] = [max(lines[1:3], key=lambda x: x[2])]
        if lines:
            yield pa.RecordBatch.from_pylist([{"part": p, "name": g, "rows": r, "at": i} for i, (p, g, r) in enumerate(lines)], pa.schema([("part", pa.int32()), ("name", held), ("rows", pa.int64()), ("at", pa.int32())]))

    kind = dict(rows.dtypes)[group]
    held = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]
    told = sorted(stored.select(group, "_part").mapInArrow(edges, f"part int, name {kind}, rows long, at int").collect(), key=lambda r: (r["part"], r["at"]))
    ends = {}
    for r in told:
        ends.setdefault(r["part"], []).append(r)
    total: dict = {}  # only groups at the edge of a partition
    for lines in ends.values():
        for r in {0: lines[0], len(lines) - 1: lines[-1]}.values():
            total[r["name"]] = total.get(r["name"], 0) + r["rows"]
    before: dict = {}
    starts = {}
    for part in sorted(ends):
        first, last = ends[part][0], ends[part][-1]
        starts[part] = (before.get(first["name"], 0), total[first["name"]], total[last["name"]])
        for r in {0: first, len(ends[part]) - 1: last}.values():
            before[r["name"]] = before.get(r["name"], 0) + r["rows"]
    largest = max([0, *total.values(), *(r["rows"] for r in told)])
    offsets = stored.sparkSession.sparkContext.broadcast(starts)  # three numbers a partition

    def number(batches):
        # A group's size is known at its end: runs wait until their group ends, unless it lies at the partition's edge.
        waiting, size, name, index, part = [], 0, None, -1, None

        def flush(last: bool):
            start, n_first, n_last = offsets.value[part]
            at = start if index == 0 else 0
            n = n_first if index == 0 else n_last if last else size
            for piece in waiting:
                m = piece.num_rows
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(np.arange(at, at + m)), pa.array(np.full(m, n, np.int64))], [*kept, "pos", "n"])
                at += m

        for batch in batches:
            groups = batch.column(group)
            for at, rows_in in zip(*(x.tolist() for x in runs_of(groups))):
                here = groups[at].as_py()
                if index < 0 or here != name:
                    if index >= 0:
                        yield from flush(False)
                    waiting, size, name, index = [], 0, here, index + 1
                part = batch.column("_part")[at].as_py()
                waiting.append(batch.slice(at, rows_in))
                size += rows_in
        if index >= 0:
            yield from flush(True)

    kept = rows.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return stored.mapInArrow(number, f"{schema}, pos long, n long"), largest
