"""Tool calls and their results: blocks of tool output as a table function of SQL, and calls joined with results as they stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = re.compile(r"^\[(\d+)\] (.*?) \(doc: (\w+), page: (\d+)\)\n?(.*)\Z", re.S)
_OPENS = re.compile(r"(?m)(?=^\[\d+\] )")


class ToolBlocks:
    """``n, name, doc_id, page, body`` of each block of a tool's output, ``[n] name (doc: id, page: p)`` and what follows up to the next."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for part in _OPENS.split(text or ""):
            m = _BLOCK.match(part)
            if m:
                yield int(m[1]), m[2], m[3], int(m[4]), m[5].strip(" \n")


def register(spark: SparkSession) -> None:
    """``tool_blocks(text)`` for SQL, as in ``SELECT conv_id, b.* FROM outputs, LATERAL tool_blocks(text) b``."""
    spark.udtf.register("tool_blocks", F.udtf(ToolBlocks, returnType="n int, name string, doc_id string, page int, body string"))


def correlated(calls: DataFrame, results: DataFrame, key: str, seconds: int, *, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``calls`` (columns with ``call_`` in front) with the results of the same key within ``seconds`` after each; of a stream and of a table alike.

    Of streams, watermarks bound what is kept of either side: a call waits ``seconds`` and the lateness allowed.  A call without a result comes out with nulls, of
    streams once its time is up.
    """
    both = [df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]).withColumn(f"{side}_at", F.col(f"{side}_{ts}").cast("timestamp")) for side, df in (("call", calls), ("result", results))]
    if calls.isStreaming:
        both = [df.withWatermark(f"{side}_at", late) for side, df in zip(("call", "result"), both)]
    within = F.expr(f"result_at >= call_at AND result_at <= call_at + INTERVAL {int(seconds)} SECONDS")
    same: Column = F.col(f"call_{key}") == F.col(f"result_{key}")
    return both[0].join(both[1], same & within, "left").drop("call_at", "result_at")
