"""Ingestion: from documents, their pages and layout blocks to chunks that can be searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import block_ranges, enriched, line_chunks, with_page


def overlapping_chunks(docs: DataFrame, tokens: int = 512, overlap: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, chunk, text, n_tokens``: runs of at most ``tokens`` words, each of which begins with the last ``overlap`` of the one
    before.  Texts without words have none.  Array functions within the row: no shuffle."""
    words = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    split = docs.select(id_col, words.alias("_w")).where(F.size("_w") > 0)
    step = tokens - overlap
    last = F.floor(F.greatest(F.size("_w") - overlap - 1, F.lit(0)) / step)
    placed = split.select(id_col, "_w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    part = F.slice("_w", (F.col("chunk") * step + 1).cast("int"), tokens)
    return placed.select(id_col, "chunk", F.array_join(part, " ").alias("text"), F.size(part).cast("long").alias("n_tokens"))


def ingested(
    docs: DataFrame, pages: DataFrame, blocks: DataFrame, embed: Callable[[Column], Column], *, id_col: str = "doc_id", fuzzy: bool = True
) -> DataFrame:
    """Chunks with clause, section, page, the range of blocks on that page, and the vector that ``embed`` gives for their text;
    what is missing is null.  ``pages`` has ``id_col, page, text``, ``blocks`` has ``id_col, page, block_order, block_content``."""
    chunks = with_page(enriched(line_chunks(docs, id_col=id_col)), pages, id_col=id_col)
    ranges = block_ranges(chunks, blocks, id_col=id_col, fuzzy=fuzzy)
    return chunks.join(ranges, [id_col, "chunk"], "left").withColumn("embedding", embed(F.col("text")))


def rebuilt(docs: DataFrame, stored: DataFrame, pages: DataFrame, blocks: DataFrame, embed: Callable[[Column], Column], *, id_col: str = "doc_id") -> DataFrame:
    """The index of a collection: ``stored`` chunks where a document has any, the others ingested anew.  Columns of ``stored``."""
    missing = docs.join(stored.select(id_col).distinct(), id_col, "left_anti")
    return stored.unionByName(ingested(missing, pages, blocks, embed, id_col=id_col).select(*stored.columns))
