"""What users and models get to see: formatted results, previews, queries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------------
NOTHING_FOUND = "未找到相关标准依据。"
REFERENCE_HEAD = "参考标准依据（向量检索）"
LEAST_RELEVANCE = 0.35


def result_label(source: Column, clause: Column, section: Column) -> Column:
    """Source, clause, or else section; empty parts are left out."""
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat_ws(
        " ", F.when(told(source), F.concat(F.lit("【"), source, F.lit("】"))), F.when(told(clause), F.concat(F.lit("第"), clause, F.lit("条"))),
        F.when(told(section) & ~told(clause), section),
    )


def formatted(results: DataFrame, *by: str, head: str = REFERENCE_HEAD, chars: int = 1000) -> DataFrame:
    """``by, context``: a group's results (``rank, source, clause, section, content``; few, as a search returns them) under a head, numbered in order."""
    line = F.concat(F.lit("\n"), F.col("rank").cast("string"), F.lit(". "), result_label(F.col("source"), F.col("clause"), F.col("section")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    return results.groupBy(*by).agg(F.concat(F.lit(f"【{head}】\n"), F.array_join(lines, "\n")).alias("context"))


def keyword_query(topic: Column, keywords: Column, chars: int = 200) -> Column:
    """The topic, or else the keywords that are not empty, joined and cut."""
    joined = F.substring(F.array_join(F.filter(keywords, lambda k: k != ""), " "), 1, chars)
    return F.when(F.coalesce(topic, F.lit("")) != "", topic).otherwise(joined)


def preview_url(doc_id: Column, page: Column) -> Column:
    """Where a source can be seen; null without a document, without a page where none is known."""
    base = F.concat(F.lit("/documents/"), F.url_encode(doc_id.cast("string")), F.lit("/preview"))
    return F.when(doc_id.isNotNull(), F.concat(base, F.when(page.isNotNull(), F.concat(F.lit("?page="), (page + 1).cast("string"))).otherwise("")))


def joined_parts(parts: Column, kind: str | None = "text") -> Column:
    """The contents of structured parts (``type, content``), those of one kind if it is given, in one string."""
    chosen = F.filter(parts, lambda p: p["type"] == kind) if kind else parts
    return F.array_join(F.transform(chosen, lambda p: F.coalesce(p["content"], F.lit(""))), "")


def table_text(rows: Column) -> Column:
    """Cells joined by bars, rows by line breaks; null cells are empty."""
    return F.array_join(F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def list_text(items: Column) -> Column:
    """Items on lines of their own; empty ones are left out."""
    return F.array_join(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
