"""Chunks of documents, and the pages and layout blocks they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_prefix, clause_number, fuzzy_matcher, has_heading, normalized, section_path


def line_chunks(docs: DataFrame, tokens: int = 512, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """``id_col, chunk, text, n_tokens``: consecutive lines of a document, cut where the running number of words passes a
    multiple of ``tokens``.  Documents of fewer than ``least`` characters have no chunks."""
    long_ = docs.where(F.char_length(text_col) >= least)
    lines = long_.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    counted = lines.withColumn("n", F.regexp_count("line", F.lit(r"\S+")).cast("long"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("chunk", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / tokens))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return placed.groupBy(id_col, "chunk").agg(joined.alias("text"), F.sum("n").alias("n_tokens"))


def heading_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with Markdown headings, cut before each: ``id_col, chunk, text``."""
    parts = F.filter(F.split(F.col(text_col), r"(?m)(?=^#{1,6}\s+\S)"), lambda p: F.trim(p) != "")
    return docs.where(has_heading(F.col(text_col))).select(id_col, F.posexplode(parts).alias("chunk", "text"))


def enriched(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    return chunks.withColumn("clause_number", clause_number(F.col(text_col))).withColumn("section_path", section_path(F.col(text_col)))


def with_page(chunks: DataFrame, pages: DataFrame, *, id_col: str = "doc_id", chunk_col: str = "chunk") -> DataFrame:
    """``chunks`` with ``page_number``: the first page, by position, that holds the chunk's prefix; null if none does.

    An equi-join on the document keeps each document's chunks with its own pages.
    """
    prefixed = chunks.withColumn("_prefix", chunk_prefix(F.col("text")))
    right = pages.select(F.col(id_col).alias("_id"), F.col("page").alias("_page"), F.col("text").alias("_text"))
    hits = prefixed.join(right, F.col(id_col) == F.col("_id")).where((F.col("_prefix") != "") & F.contains("_text", "_prefix"))
    first = hits.groupBy(id_col, chunk_col).agg(F.min("_page").alias("page_number"))
    return chunks.join(first, [id_col, chunk_col], "left")


def block_ranges(chunks: DataFrame, blocks: DataFrame, *, id_col: str = "doc_id", chunk_col: str = "chunk", fuzzy: bool = True) -> DataFrame:
    """``id_col, chunk_col, block_start, block_end``: the least and greatest order of the blocks on the chunk's page that
    match it.  Containment is decided first; only pairs that it leaves open reach LCS."""
    left = chunks.where(F.col("page_number").isNotNull()).select(id_col, chunk_col, "page_number", normalized("text").alias("_a"))
    right = blocks.select(F.col(id_col).alias("_id"), F.col("page").alias("_page"), "block_order", normalized("block_content").alias("_b"))
    pairs = left.join(right, (F.col(id_col) == F.col("_id")) & (F.col("page_number") == F.col("_page"))).where((F.col("_a") != "") & (F.col("_b") != ""))
    inside = F.contains("_a", "_b") | F.contains("_b", "_a")
    matched = pairs.where(inside).select(id_col, chunk_col, "block_order")
    if fuzzy:
        matched = matched.union(pairs.where(~inside).where(fuzzy_matcher()("_a", "_b")).select(id_col, chunk_col, "block_order"))
    return matched.groupBy(id_col, chunk_col).agg(F.min("block_order").alias("block_start"), F.max("block_order").alias("block_end"))
