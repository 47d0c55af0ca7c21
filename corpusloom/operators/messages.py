"""Logs, traces and tool output of conversations with models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trimmed_trace(messages: DataFrame, *, content: int = 10_000, arguments: int = 5_000) -> DataFrame:
    """``messages`` with ``content`` and, if present, ``arguments`` cut to their limits."""
    out = messages.withColumn("content", F.substring("content", 1, content))
    return out.withColumn("arguments", F.substring("arguments", 1, arguments)) if "arguments" in messages.columns else out


def history(turns: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """``conv_id, history``: turns of these roles, in order, a line each."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    return turns.where(F.col("role").isin(*roles)).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("history"))


def assembled(deltas: DataFrame, *by: str, order: str, text: str) -> DataFrame:
    """``by, text``: fragments joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return deltas.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("text"))


def tool_sources(outputs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Sources named in tool output, blocks that start with ``[n] name (doc: id, page: p)`` and run to the next: ``n, name, doc_id, page, body``; of blocks that name
    one document the first stays."""
    rest = [c for c in outputs.columns if c != text_col]
    blocks = outputs.select(*rest, F.explode(F.split(F.col(text_col), r"(?m)(?=^\[\d+\] )")).alias("b"))
    get = lambda i: F.regexp_extract("b", r"(?s)^\[(\d+)\] (.*?) \(doc: (\w+), page: (\d+)\)\n?(.*)$", i)
    rows = blocks.where(get(1) != "").select(*rest, get(1).cast("int").alias("n"), get(2).alias("name"), get(3).alias("doc_id"), get(4).cast("int").alias("page"), F.btrim(get(5), F.lit(" \n")).alias("body"))
    first = Window.partitionBy(*rest, "doc_id").orderBy("n")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def sessions(events: DataFrame, key: str, *, ts: str = "ts", seconds: int = 7200) -> DataFrame:
    """``events`` with ``age_s`` since the key's first event and whether its session has ended by then."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    age = (at - F.min(at).over(Window.partitionBy(key))).cast("double") / 1_000_000
    return events.withColumn("age_s", age).withColumn("expired", F.col("age_s") > seconds)


def first_by_name(sources: DataFrame, *by: str, order: str, name: str = "name") -> DataFrame:
    """``sources`` of which, within ``by``, the first by ``order`` stays of each name; a source without a name stays."""
    key = F.coalesce(F.nullif(F.col(name), F.lit("")), F.concat(F.lit("\u0000"), F.col(order).cast("string")))
    return sources.withColumn("_r", F.row_number().over(Window.partitionBy(*by, key).orderBy(order))).where("_r = 1").drop("_r")
