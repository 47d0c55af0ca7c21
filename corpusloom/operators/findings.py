"""Findings: guards at insertion, removal of repeats, summaries, and links to the documents that support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed


def severity_rank(s: Column) -> Column:
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """Counts of findings by type and severity; types without a counter appear in ``issues_count`` alone."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("issues_count"),
        *[F.count_if(F.col("type") == t).alias(f"{t}_issues") for t in ("compliance", "completeness", "consistency")],
        *[F.count_if(F.col("severity") == s).alias(f"{s}_severity") for s in ("high", "medium", "low")],
    )


def deduplicated(findings: DataFrame, *, order: str = "id", chars: int = 80) -> DataFrame:
    """One finding for each excerpt (its first ``chars`` characters, else the description's): the most severe, the first of
    equals.  If several of the group have suggestions and the kept one has one, they are joined.  ``ord`` is the order of
    first appearance."""
    key = F.substring(F.coalesce(F.nullif("excerpt", F.lit("")), "description", F.lit("")), 1, chars)
    told = F.when(F.coalesce("suggestion", F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col("suggestion").alias("s")))
    groups = findings.withColumn("_key", key).groupBy("_key").agg(
        F.min(order).alias("ord"), F.count("*").alias("n_merged"), F.array_sort(F.collect_list(told)).alias("_all"),
        F.max_by(F.struct(order, "type", "severity", "suggestion"), F.struct(severity_rank(F.col("severity")).alias("r"), (-F.col(order)).alias("o"))).alias("b"),
    )
    several = (F.size("_all") > 1) & (F.coalesce("b.suggestion", F.lit("")) != "")
    merged = F.when(several, F.array_join(F.transform("_all", lambda x: x["s"]), "；")).otherwise(F.col("b.suggestion"))
    return groups.select(F.col(f"b.{order}").alias(order), F.col("_key").alias("excerpt_key"), "b.type", "b.severity", merged.alias("suggestion"), "ord", "n_merged")


def guarded(findings: DataFrame, *by: str, order: str, excerpt: str, position: str | None = None, least: int = 10) -> DataFrame:
    """The findings that pass the duplicate guard: of excerpts of at least ``least`` characters that agree after white space
    is collapsed, and of equal positions among shorter ones, the first."""
    text = collapsed(F.col(excerpt))
    short = F.concat(F.lit("at:"), F.col(position).cast("string")) if position else F.concat(F.lit("row:"), F.col(order).cast("string"))
    keyed = findings.withColumn("_guard", F.when(F.char_length(text) >= least, text).otherwise(short))
    first = Window.partitionBy(*by, "_guard").orderBy(order)
    return keyed.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_guard", "_r")


def unknown_targets(findings: DataFrame, documents: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``findings`` with ``id_col`` cleared where no such document exists, and ``pending`` where it is null."""
    known = documents.select(F.col(id_col).alias("_known")).distinct()
    joined = findings.join(known, F.col(id_col) == F.col("_known"), "left")
    return joined.withColumn(id_col, F.col("_known")).withColumn("pending", F.col(id_col).isNull()).drop("_known")


def linked(findings: DataFrame, *strategies: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``findings`` with ``doc_id`` and ``strategy``: the first strategy, in the order given, that has a hit, and its best hit.
    A strategy has ``id_col, doc_id, rank`` (least is best)."""
    found = None
    for i, s in enumerate(strategies):
        part = s.select(id_col, "doc_id", F.lit(i).alias("strategy"), F.col("rank").cast("long").alias("rank"))
        found = part if found is None else found.union(part)
    best = found.groupBy(id_col).agg(F.min(F.struct("strategy", "rank", "doc_id")).alias("b"))
    return findings.join(best, id_col, "left").withColumn("doc_id", F.col("b.doc_id")).withColumn("strategy", F.col("b.strategy")).drop("b")

