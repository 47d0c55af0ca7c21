"""Tables that hold collections, documents, nodes, vectors and tasks: scans, integrity, upkeep.

Every function is a filter, an equi-join or a partial aggregation over its tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(rows: DataFrame, *columns: str, **equal) -> DataFrame:
    """The columns named of the rows whose further columns have the values given; a value of None does not restrict.  Filter
    and columns reach the scan."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return rows.select(*columns)


def newest(rows: DataFrame, by: str, at: str, order: str, most: int) -> DataFrame:
    """The ``most`` latest rows of each ``by``, with ``rank`` from 1; of equal times the larger ``order`` comes first."""
    window = Window.partitionBy(by).orderBy(F.desc(at), F.desc(order))
    return rows.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= most)


def integrity(docs: DataFrame, vectors: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_vectors, n_nodes, state`` of each document: whether stored vectors and nodes can be used as they are
    (``ok``), or ``missing vectors``, ``missing nodes``, ``count mismatch``, by the first check that fails."""
    v = vectors.groupBy(id_col).agg(F.count("*").alias("n_vectors"))
    n = nodes.groupBy(id_col).agg(F.count("*").alias("n_nodes"))
    held = docs.select(id_col).distinct().join(v, id_col, "left").join(n, id_col, "left")
    state = (
        F.when(F.col("n_vectors").isNull(), "missing vectors").when(F.col("n_nodes").isNull(), "missing nodes")
        .when(F.col("n_vectors") != F.col("n_nodes"), "count mismatch").otherwise("ok")
    )
    return held.select(id_col, F.coalesce("n_vectors", F.lit(0)).cast("long").alias("n_vectors"), F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"), state.alias("state"))


def zipped(nodes: DataFrame, vectors: DataFrame, checked: DataFrame, id_col: str = "doc_id", at: str = "ordinal") -> DataFrame:
    """Nodes with their vectors, by document and ordinal, of documents that ``integrity`` calls ok."""
    good = checked.where("state = 'ok'").select(id_col)
    return nodes.join(vectors, [id_col, at]).join(good, id_col, "left_semi")


def rebuild_plan(checked: DataFrame) -> DataFrame:
    """``checked`` with ``action``: stored vectors are ``reused`` where they are whole, else the document is ``embedded`` anew."""
    return checked.withColumn("action", F.when(F.col("state") == "ok", "reused").otherwise("embedded"))


def without_document(index: DataFrame, doc_id, id_col: str = "doc_id") -> DataFrame:
    """The index without one document's rows; rows without an id stay."""
    return index.where(~F.col(id_col).eqNullSafe(F.lit(doc_id)))


def with_outcomes(docs: DataFrame, outcomes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``embedding_status`` and ``error``: an outcome without an error clears it; of several outcomes of one
    document the greatest ``seq`` holds."""
    last = outcomes.groupBy(id_col).agg(F.max_by(F.struct(F.coalesce("error", F.lit("")).alias("error")), "seq").alias("_o"))
    joined = docs.join(last, id_col, "left")
    status = F.when(F.col("_o").isNull(), "pending").when(F.col("_o.error") != "", "failed").otherwise("embedded")
    return joined.withColumn("embedding_status", status).withColumn("error", F.nullif(F.col("_o.error"), F.lit(""))).drop("_o")


def page_at(requests: DataFrame, pages: DataFrame, id_col: str = "doc_id", at: str = "page") -> DataFrame:
    """``requests`` with the ``text`` of the page they name; null out of range."""
    return requests.join(pages.select(id_col, at, "text"), [id_col, at], "left")


def shown_blocks(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks with content, with the columns that a viewer gets; pages without such a block vanish."""
    return blocks.where(F.trim(F.coalesce("block_content", F.lit(""))) != "").select(id_col, "page", "block_order", "block_label", "block_content")


def searchable(docs: DataFrame, indexed: DataFrame, by: str, id_col: str = "doc_id") -> DataFrame:
    """``by, n_docs, n_indexed, searchable``: a collection can be searched once one of its documents is indexed."""
    known = indexed.select(id_col).distinct().withColumn("_in", F.lit(1))
    return docs.join(known, id_col, "left").groupBy(by).agg(
        F.count("*").alias("n_docs"), F.count("_in").alias("n_indexed"), (F.count("_in") > 0).alias("searchable")
    )


def preflight(docs: DataFrame, cached: DataFrame, by: str, pages: Column, id_col: str = "doc_id") -> DataFrame:
    """``by, docs, cached, pages, uncached_pages``: what a bulk parse of each collection would take."""
    known = cached.select(id_col).distinct().withColumn("_in", F.lit(1))
    sized = docs.select(by, id_col, pages.alias("_n")).join(known, id_col, "left")
    missing = F.when(F.col("_in").isNull(), F.col("_n")).otherwise(0)
    return sized.groupBy(by).agg(F.count("*").alias("docs"), F.count("_in").alias("cached"), F.sum("_n").alias("pages"), F.sum(missing).alias("uncached_pages"))


def usage(events: DataFrame, by: str, tokens: str) -> DataFrame:
    """``by, calls, tokens``: totals of usage events; partial sums meet in the shuffle."""
    return events.groupBy(by).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def degradations(events: DataFrame, by: str, kind: str, order: str) -> DataFrame:
    """``by, kind, n, first, last``: fall-backs of each run, by kind, with the first and last place in its log."""
    return events.groupBy(by, kind).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def stopped(turns: DataFrame, flags: DataFrame, by: str, order: str) -> DataFrame:
    """The turns of each run that came before its stop flag; a run without a flag keeps all."""
    stop = flags.groupBy(by).agg(F.min("stop_at").alias("_stop"))
    return turns.join(stop, by, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
