"""From findings to the documents, chunks, blocks and rectangles that support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_matcher, normalized, standard_form
from .findings import linked


def name_rank(doc_name: Column, numbers: Column, names: Column) -> Column:
    """0: the document's name has one of the numbers, both in standard form; 1: it has one of the names; 2: neither.  Null and
    empty numbers and names count for nothing."""
    inside = lambda xs, s: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: (x != "") & F.contains(s, x))
    return F.when(inside(numbers, F.col("_form")), 0).when(inside(names, doc_name), 1).otherwise(2)


def text_hits_ranked(hits: DataFrame, catalog: DataFrame, *, id_col: str = "item_id") -> DataFrame:
    """``id_col, doc_id, rank``: text hits (``id_col, doc_id, ord, numbers, names``) by what the document's name says, then by
    ``ord``.  ``numbers`` are in standard form; an unknown document has no name."""
    named = hits.join(catalog.select("doc_id", F.col("name").alias("_name"), standard_form("name").alias("_form")), "doc_id", "left")
    kind = name_rank(F.col("_name"), F.col("numbers"), F.col("names"))
    return named.select(id_col, "doc_id", (kind.cast("long") * F.lit(1 << 40) + F.col("ord")).alias("rank"))


def sources_of_findings(findings: DataFrame, text_hits: DataFrame, vector_hits: DataFrame, catalog: DataFrame, *, id_col: str = "item_id") -> DataFrame:
    """``findings`` (``id_col, numbers, names``) with ``doc_id`` and ``strategy``: 0, a vector hit that the text search confirms and
    whose content has a number; 1, the best text hit; 2, a vector hit alone whose content has a number, or a name where
    there are no numbers; null without any.

    ``text_hits`` has ``id_col, doc_id, ord``, ``vector_hits`` also ``content``; ``ord`` counts from the best.
    """
    asked = findings.select(id_col, "numbers", "names")
    has = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: (x != "") & F.contains(F.col("content"), x))
    seen = vector_hits.join(asked, id_col)
    told = F.when(F.size("numbers") > 0, has(F.col("numbers"))).otherwise(has(F.col("names")))
    confirmed = seen.where(has(F.col("numbers"))).join(text_hits.select(id_col, "doc_id").distinct(), [id_col, "doc_id"])
    texts = text_hits.join(asked.withColumn("numbers", F.transform("numbers", lambda x: F.regexp_replace(F.lower(x), r"[\s\-./]+", ""))), id_col)
    ranked = lambda rows: rows.select(id_col, "doc_id", F.col("ord").alias("rank"))
    return linked(findings, ranked(confirmed), text_hits_ranked(texts, catalog, id_col=id_col), ranked(seen.where(told)), id_col=id_col)


def chunks_of_findings(findings: DataFrame, chunks: DataFrame, *, id_col: str = "item_id") -> DataFrame:
    """``findings`` (``id_col, doc_id, page_number, excerpt``) with ``block_range``: that of the first chunk, by ``ord``, of the document
    (and of the page, if one is named) whose text matches the excerpt: containment either way, else LCS.  An empty excerpt
    takes the first chunk that has a range.  Null without a match.

    The join is on the document; LCS runs only for findings that containment leaves open.
    """
    left = findings.select(id_col, "doc_id", "page_number", normalized("excerpt").alias("_a"))
    right = chunks.where(F.col("block_range").isNotNull()).select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_p"), "ord", "block_range", normalized("text").alias("_b"))
    pairs = left.join(right, (F.col("doc_id") == F.col("_d")) & (F.col("page_number").isNull() | (F.col("page_number") == F.col("_p"))))
    inside = (F.col("_a") == "") | ((F.col("_b") != "") & (F.contains("_a", "_b") | F.contains("_b", "_a")))
    hits = pairs.where(inside).select(id_col, "ord", "block_range")
    near = pairs.where(~inside & (F.col("_b") != "")).where(fuzzy_matcher()("_a", "_b")).select(id_col, "ord", "block_range")
    best = hits.union(near).groupBy(id_col).agg(F.min_by("block_range", "ord").alias("block_range"))
    return findings.join(best, id_col, "left")


def has_area(box: Column) -> Column:
    """Whether a box is four numbers with width and height."""
    at = lambda i: F.get(box, F.lit(i))
    return (F.size(box) == 4) & (at(2) > at(0)) & (at(3) > at(1))


def rectangle(box: Column, width: Column, height: Column) -> Column:
    """``x, y, w, h`` in pixels of a box in shares of the page."""
    at = lambda i: F.get(box, F.lit(i))
    return F.struct((at(0) * width).alias("x"), (at(1) * height).alias("y"), ((at(2) - at(0)) * width).alias("w"), ((at(3) - at(1)) * height).alias("h"))


def range_rectangles(ranges: DataFrame, blocks: DataFrame, width: Column, height: Column, *, id_col: str = "doc_id") -> DataFrame:
    """``ranges`` (``id_col, page, block_start, block_end``) joined with the rectangles of the blocks whose order lies between."""
    shapes = blocks.where(has_area(F.col("bbox_norm"))).select(id_col, "page", "block_order", rectangle(F.col("bbox_norm"), width, height).alias("r"))
    return ranges.join(shapes, [id_col, "page"]).where(F.col("block_order").between(F.col("block_start"), F.col("block_end")))


def highlight_rectangles(highlights: DataFrame, blocks: DataFrame, width: Column, height: Column, *, id_col: str = "doc_id") -> DataFrame:
    """``highlights`` (``id_col, page, highlight``) joined with the rectangles of the page's blocks that match: containment either way, else
    LCS over the longer length."""
    left = highlights.withColumn("_a", normalized("highlight")).where("_a != ''")
    right = blocks.where(has_area(F.col("bbox_norm"))).select(id_col, "page", "block_order", normalized("block_content").alias("_b"), rectangle(F.col("bbox_norm"), width, height).alias("r")).where("_b != ''")
    pairs = left.join(right, [id_col, "page"])
    inside = F.contains("_a", "_b") | F.contains("_b", "_a")
    return pairs.where(inside).union(pairs.where(~inside).where(fuzzy_matcher("max")("_a", "_b"))).drop("_a", "_b")
