"""Chapters, clauses and lines of structured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))


def carried(lines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``lines`` with ``chapter_no`` (0 before the first), ``chapter`` and ``clause``, carried forward from Markdown headings of
    level two and from lines that start with a dotted number."""
    over = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.nullif(F.regexp_extract("line", r"^##\s+(.+)$", 1), F.lit(""))
    clause = F.nullif(F.regexp_extract("line", r"^(\d+(?:\.\d+)+)\s", 1), F.lit(""))
    out = lines.withColumn("_t", title).withColumn("_c", clause)
    out = out.withColumn("chapter_no", F.count("_t").over(over)).withColumn("chapter", F.last("_t", True).over(over))
    inside = Window.partitionBy(id_col, "chapter_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("clause", F.last("_c", True).over(inside)).drop("_t", "_c")


def chapters(lines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, chapter_no, chapter, start_pos, end_pos, n_clauses``; a chapter ends before the next one starts."""
    marked = carried(lines, id_col=id_col)
    sized = marked.where("chapter_no > 0").groupBy(id_col, "chapter_no").agg(F.first("chapter").alias("chapter"), F.min("pos").alias("start_pos"), F.countDistinct("clause").alias("n_clauses"))
    last = marked.groupBy(id_col).agg((F.max("pos") + 1).alias("_end"))
    following = F.lead("start_pos").over(Window.partitionBy(id_col).orderBy("chapter_no"))
    return sized.withColumn("end_pos", following).join(last, id_col).withColumn("end_pos", F.coalesce("end_pos", "_end")).drop("_end")


def without_tables(lines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Lines outside HTML tables; the line that opens one becomes ``<TABLE>``."""
    count = lambda tag: F.size(F.split(F.lower("line"), tag)) - 1
    over = Window.partitionBy(id_col).orderBy("pos")
    depth = F.sum(count("<table") - count("</table>")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("_before", F.coalesce(depth, F.lit(0))).withColumn("_opens", count("<table") > 0)
    kept = marked.where(F.col("_before") <= 0)
    return kept.withColumn("line", F.when(F.col("_opens"), "<TABLE>").otherwise(F.col("line"))).drop("_before", "_opens")


def merged_lines(lines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Lines without repeats of the line before, and with one blank line for several."""
    over = Window.partitionBy(id_col).orderBy("pos")
    marked = lines.withColumn("_p", F.lag("line").over(over))
    return marked.where(F.col("_p").isNull() | (F.col("line") != F.col("_p"))).drop("_p")


def running_offset(pages: DataFrame, n: str, *, id_col: str = "doc_id") -> DataFrame:
    """``pages`` with ``first_block``: blocks on the pages before."""
    over = Window.partitionBy(id_col).orderBy("page")
    return pages.withColumn("first_block", F.sum(n).over(over) - F.col(n))


def page_window(text: Column, offset: Column, size: int = 4000) -> Column:
    """A window of a chapter from ``offset`` (negative: 0), or a note past its end."""
    at = F.greatest(F.lit(0), F.coalesce(offset, F.lit(0)))
    more = F.when(F.char_length(text) > at + size, F.concat(F.lit("\n[continues at "), (at + size).cast("string"), F.lit("]"))).otherwise("")
    return F.when(at >= F.char_length(text), F.lit("[end of chapter]")).otherwise(F.concat(F.substr(text, at + 1, F.lit(size)), more))


def outline(chapters_: DataFrame, *, id_col: str = "doc_id", most: int = 10) -> DataFrame:
    """``id_col, outline``: a line for each chapter with its number of clauses."""
    line = F.concat_ws(" ", F.col("chapter_no").cast("string"), "chapter", F.concat(F.lit("("), F.col("n_clauses").cast("string"), F.lit(")")))
    rows = F.array_sort(F.collect_list(F.struct("chapter_no", line.alias("line"))))
    return chapters_.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("outline"))


def markdown(items: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Documents rebuilt from typed items (``pos, kind, level, text``): headings by level, tables in markers, blank items and
    repeats of the item before left out."""
    over = Window.partitionBy(id_col).orderBy("pos")
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    line = (
        F.when(F.col("kind") == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("text")))
        .when(F.col("kind") == "table", F.concat(F.lit("<TABLE>\n"), F.trim("text"), F.lit("\n</TABLE>"))).otherwise(F.trim("text"))
    )
    lines = items.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("line", line).withColumn("_p", F.lag("line").over(over))
    kept = lines.where(F.col("_p").isNull() | (F.col("_p") != F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return kept.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"))
