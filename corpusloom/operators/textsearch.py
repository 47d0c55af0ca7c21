"""Keyword search over pages: exact containment first, standard form where that misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, standard_form, tolerant_search
from .keywords import holding  # noqa: F401


def pages_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source") -> DataFrame:
    """A document's lines as pages: ``kb_id, doc_id, page, text``."""
    lines = F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("page", "text")
    return docs.select(F.col(group_col).alias("kb_id"), F.col(id_col).alias("doc_id"), lines).withColumn("page", F.col("page").cast("long"))


def first_pages(pages: DataFrame, keyword: str) -> DataFrame:
    """``kb_id, doc_id, page, content``: each document's first page that holds the keyword.

    Pages are compared in lower case.  A keyword with something to strip, or with a known prefix glued to a number, also
    matches in standard form where the page does not hold it exactly; the place is then scaled to the raw text.
    An empty keyword finds nothing.
    """
    if not keyword:
        return pages.select("kb_id", "doc_id", "page", F.lit("").alias("content")).limit(0)
    spark = pages.sparkSession
    needle = F.lit(keyword)
    at = F.instr(F.lower("text"), F.lit(keyword.lower())) - 1
    exact = pages.where(at >= 0).select("kb_id", "doc_id", "page", snippet(F.col("text"), at, needle).alias("content"))
    told = spark.range(1).select(tolerant_search(needle).alias("tolerant"), standard_form(needle).alias("form")).first()
    hits = exact
    if told["tolerant"] and told["form"]:
        rest = pages.where(at < 0).withColumn("form", standard_form("text"))
        place = F.instr("form", F.lit(told["form"])) - 1
        scaled = F.floor(place * F.char_length("text") / F.greatest(F.char_length("form"), F.lit(1))).cast("int")
        hits = exact.union(rest.where(place >= 0).select("kb_id", "doc_id", "page", snippet(F.col("text"), scaled, needle)))
    first = Window.partitionBy("kb_id", "doc_id").orderBy("page")
    return hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def top_hits(hits: DataFrame, most: int = 5) -> DataFrame:
    """In the order of collections and documents."""
    return hits.orderBy("kb_id", "doc_id").limit(most)


def keyword_union(pages: DataFrame, keywords: list[str], most: int = 5) -> DataFrame:
    """Documents that any keyword finds, once each, in keyword order: ``doc_id, keyword, ord``.

    One pass over the pages: each names its first keyword that matches as in ``first_pages``.
    """
    asked = [(i, k) for i, k in enumerate(keywords) if k]
    if not asked:
        return pages.select("doc_id", F.lit("").alias("keyword"), F.lit(0).cast("long").alias("ord")).limit(0)
    given = pages.sparkSession.createDataFrame(asked, "k int, keyword string")
    forms = {r["k"]: r["form"] for r in given.select("k", standard_form("keyword").alias("form"), tolerant_search(F.col("keyword")).alias("tolerant")).collect() if r["tolerant"] and r["form"]}
    told = pages.withColumn("_form", standard_form("text")) if forms else pages
    first = None
    for i, k in reversed(asked):
        hit = F.contains(F.lower("text"), F.lit(k.lower()))
        hit = hit | F.contains("_form", F.lit(forms[i])) if i in forms else hit
        first = F.when(hit, i).otherwise(first) if first is not None else F.when(hit, i)
    once = told.select("doc_id", "kb_id", first.alias("_k")).where(F.col("_k").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("_k", "kb_id")).alias("m"))
    ranked = once.orderBy("m._k", "m.kb_id", "doc_id").limit(most)
    named = F.get(F.array(*[F.lit(k) for k in keywords]), F.col("m._k"))
    return ranked.select("doc_id", named.alias("keyword"), F.row_number().over(Window.orderBy("m._k", "m.kb_id", "doc_id")).cast("long").alias("ord"))
