"""Retrieval quality: matches, per-case and mean metrics, drift, rank correlation, parameter grids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def matches(content: Column, keywords: Column) -> Column:
    """All keywords occur, or of several at least 70 % (and one)."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(content, k)))
    n = F.size(keywords)
    return (hits == n) | ((n > 1) & (hits >= F.greatest(F.lit(1), F.floor(n * F.lit(0.7)).cast("int"))))


def case_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``case_id, precision, recall, rr, results, matched``; ``results`` has ``case_id, rank, content`` and ``expected`` has ``case_id, expected_id, keywords``.

    Precision divides by the rows among the first ``k``; recall and the reciprocal rank use all rows.
    """
    pairs = results.join(expected, "case_id").where(matches(F.col("content"), F.col("keywords")))
    good = pairs.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("rank") <= k, F.col("rank"))).alias("top"), F.count_distinct("expected_id").alias("matched"), F.min("rank").alias("first")
    )
    sized = results.groupBy("case_id").agg(F.count("*").alias("results"), F.count_if(F.col("rank") <= k).alias("shown"))
    cases = expected.groupBy("case_id").agg(F.count("*").alias("wanted")).join(sized, "case_id", "left").join(good, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return cases.select(
        "case_id", F.when(zero("shown") > 0, zero("top") / zero("shown")).otherwise(0.0).alias("precision"), (zero("matched") / F.col("wanted")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), zero("results").alias("results"), zero("matched").alias("matched"),
    )


def mean_metrics(cases: DataFrame, *by: str) -> DataFrame:
    return cases.groupBy(*by).agg(
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"),
        F.count_if(F.col("matched") > 0).alias("cases_hit"), F.count("*").alias("cases"),
    )


def drift(a: Column, b: Column) -> Column:
    """|a - b| in percent of the larger magnitude, 0.0001 at least."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-4)) * 100


def average_ranks(rows: DataFrame, value: str, *by: str, ranges: int = 128) -> DataFrame:
    """``by, value, rank``, one row for each value of each group: 1-based ranks, nulls first; ties share the mean of theirs.

    ``value`` is numeric.  Values are counted first and ranked within ``ranges`` ranges of about equal size, to which the
    numbers of the ranges below are added, so no task ranks a whole group and a common value is one row.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    found = counted.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 8 * ranges)).first()[0]
    bounds = sorted({float(x) for x in found or [] if math.isfinite(x)})
    at = F.expr(f"aggregate(array({', '.join(f'{x!r}D' for x in bounds)}), 0, (n, x) -> n + CAST(`{value}` > x AS INT))") if bounds else F.lit(0)
    dealt = counted.withColumn("_range", F.coalesce(at, F.lit(-1)))
    whole = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    below = F.sum("_size").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_size")
    offsets = whole.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), below.alias("_below"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    inside = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value)) - F.col("_n")
    ranked = dealt.withColumn("_inside", inside).join(offsets, [*same, F.col("_range") == F.col("_at")])
    return ranked.select(*by, value, (F.col("_below") + F.col("_inside") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """``by, rho``: the correlation of average ranks, within each group of ``by``.  ``a`` and ``b`` are numeric."""
    base = ranked = rows.select(*by, F.col(a).alias("_va"), F.col(b).alias("_vb"))
    for v, name in (("_va", "_a"), ("_vb", "_b")):
        ranks = average_ranks(base.select(*by, v), v, *by)
        ranks = ranks.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col(v).alias("_v"), F.col("rank").alias(name))
        same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
        ranked = ranked.join(ranks, [*same, F.col(v).eqNullSafe(F.col("_v"))]).drop("_v", *[f"_{i}" for i in range(len(by))])
    return ranked.groupBy(*by).agg(F.round(F.corr("_a", "_b"), 4).alias("rho"))


def grid(spark: SparkSession, **values) -> DataFrame:
    """All combinations of parameter values, in the order given."""
    frames = [spark.createDataFrame([(v,) for v in vs], [name]) for name, vs in values.items()]
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), frames)


def class_scores(texts: DataFrame, keywords: dict[str, list[str]], *, text_col: str = "text", chars: int = 5000, default: str = "other") -> DataFrame:
    """``texts`` with ``class``: that of which most keywords occur in the first ``chars`` characters, the first of equals, the
    default without any."""
    low = F.substring(F.lower(text_col), 1, chars)
    scores = [reduce(lambda x, y: x + y, [F.contains(low, F.lit(k)).cast("int") for k in ks]) for ks in keywords.values()]
    top = F.greatest(*scores, F.lit(0)) if len(scores) > 1 else scores[0]
    label = F.lit(default)
    for name, s in reversed(list(zip(keywords, scores))):
        label = F.when((s == top) & (s > 0), name).otherwise(label)
    return texts.withColumn("class", label)


def ranked(runs: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """``by, score, runs, place``: the ``most`` configurations of the highest mean, rounded to four digits, then by name."""
    means = runs.groupBy(by).agg(F.round(F.avg(value), 4).alias("score"), F.count("*").alias("runs"))
    best = means.orderBy(F.desc("score"), by).limit(most)  # one window over at most ``most`` rows
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), by)).cast("long"))


def diversity(results: DataFrame, by: str, source: str) -> DataFrame:
    """``by, results, sources, single_source``."""
    return results.groupBy(by).agg(F.count("*").alias("results"), F.count_distinct(source).alias("sources"), (F.count_distinct(source) <= 1).alias("single_source"))


def report_lines(cases: DataFrame) -> DataFrame:
    """``case_id, line``: what a report prints of each case."""
    return cases.select("case_id", F.format_string("[%d] P=%.4f R=%.4f RR=%.4f", F.col("case_id"), "precision", "recall", "rr").alias("line"))
