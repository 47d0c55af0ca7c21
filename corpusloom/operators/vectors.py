"""Exact nearest neighbours of a stated set of queries, with the rankings built on them.

Queries of a checked size are broadcast and meet the corpus in Arrow batches; more of them meet it in groups.  Of each batch a query's best rows
of each group alone are kept, and before the shuffle Spark's limit of window groups keeps a task's best: the shuffle
holds queries x groups x k rows a task, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that meet a batch of the corpus at once; bounds the matrix of scores.
QUERY_ROWS = 512


def scored(
    queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "cosine", query_id: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding",
    group_col: str | None = None, digits: int = 4, most_bytes: int = 64 << 20, other_than_self: bool = False,
) -> DataFrame:
    """``query_id, id, [group,] score, rank``: the ``k`` best rows of each query (and group), by the score rounded to
    ``digits`` and then by id.  ``metric`` is ``cosine`` (descending) or ``l2`` (ascending).

    Vectors that are null or hold null or non-finite components, and vectors of another length than the query's, have no
    score; zero vectors have a cosine of 0.  Queries of at most ``most_bytes`` in all are broadcast and the corpus is read once; more
    of them, which are counted first, meet it in groups of both sides that Spark deals out.
    """
    wanted = queries.where(F.col(vector_col).isNotNull()).select(query_id, vector_col)
    columns = [id_col] + [group_col] * (group_col is not None)
    types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    schema = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, " + ", ".join(f"`{c}` {types[c]}" for c in columns) + ", score double"
    given = corpus.select(*columns, vector_col)
    size = wanted.agg(F.sum(8 * F.size(vector_col))).first()[0] or 0
    if size <= most_bytes:
        held = queries.sparkSession.sparkContext.broadcast(by_length(wanted.toArrow()))
        found = given.mapInArrow(compared(held, k, metric, query_id, columns, vector_col, digits, other_than_self), schema)
    else:
        found = in_groups(wanted, given, -(-size // most_bytes), most_bytes, schema, lambda held: compared(held, k, metric, query_id, columns, vector_col, digits, other_than_self))
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), F.asc(id_col)]
    window = Window.partitionBy(query_id, *columns[1:]).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def in_groups(wanted: DataFrame, given: DataFrame, blocks: int, most_bytes: int, schema: str, compare) -> DataFrame:
    """Each of ``blocks`` blocks of queries against each block of the corpus, both of about ``most_bytes``, one pair a group."""
    vector_col = wanted.columns[1]
    parts = -(-(given.agg(F.sum(8 * F.size(vector_col))).first()[0] or 1) // most_bytes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("_q", F.pmod(F.xxhash64(*wanted.columns), F.lit(blocks)).cast("int")).select("*", every(parts).alias("_p"))
    right = given.withColumn("_p", F.pmod(F.xxhash64(*given.columns), F.lit(parts)).cast("int")).select("*", every(blocks).alias("_q"))
    names = given.columns

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        held = Here(by_length(q.select(wanted_columns)))
        rows = [pa.RecordBatch.from_arrays([x.column(c).combine_chunks() for c in names], names)] if x.num_rows else []
        found = list(compare(held)(rows))
        if found:
            return pa.Table.from_batches(found)
        return pa.table({wanted_columns[0]: q.column(wanted_columns[0]).slice(0, 0), **{c: x.column(c).slice(0, 0) for c in names if c != vector_col}, "score": pa.array([], pa.float64())})

    wanted_columns = wanted.columns
    return left.groupBy("_q", "_p").cogroup(right.groupBy("_q", "_p")).applyInArrow(run, schema)


class Here:
    """Stands for a broadcast whose value is at hand."""

    def __init__(self, value):
        self.value = value


def by_length(queries: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Names and matrices of the finite vectors of a table of names and vectors, by their length."""
    names, vectors = (queries.column(i).combine_chunks() for i in (0, 1))
    out = {}
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = rows_of(vectors.take(pa.array(at)), n)
        sound = np.isfinite(x).all(1)
        if sound.any():
            out[n] = (names.take(pa.array(at[sound])), x[sound])
    return out


def rows_of(vectors, dim: int) -> np.ndarray:
    """A matrix of an Arrow column of vectors of one length; null components become NaN."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), dim)


def compared(held, k: int, metric: str, query_id: str, columns: list[str], vector_col: str, digits: int, other_than_self: bool):
    """A task over batches of the corpus: each query's ``k`` best rows of each batch and group."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(vector_col)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
            for length, (asked, q) in held.value.items():
                at = np.flatnonzero(lengths == length)
                if not len(at):
                    continue
                x = rows_of(vectors.take(pa.array(at)), length)
                sound = np.isfinite(x).all(1)
                at, x = at[sound], x[sound]
                ids = batch.column(columns[0]).take(pa.array(at))
                order = np.asarray(pc.array_sort_indices(ids, null_placement="at_start"))  # so that equal scores stand in the order of ids
                at, x, ids = at[order], x[order], np.asarray(ids.take(pa.array(order)))
                groups = np.asarray(batch.column(columns[1]).take(pa.array(at)).dictionary_encode(null_encoding="encode").indices) if len(columns) > 1 else np.zeros(len(at), np.int64)
                members = [np.flatnonzero(groups == g) for g in np.unique(groups)]
                names = np.asarray(asked)
                for start in range(0, len(q), QUERY_ROWS):
                    part = slice(start, start + QUERY_ROWS)
                    s = scores(q[part], x, metric, digits)
                    key = -s if metric == "cosine" else s.copy()
                    if other_than_self:
                        key[names[part][:, None] == ids[None, :]] = np.inf
                    best = [(i, inside[j]) for inside in members for i, j in [least(key[:, inside], k)]]
                    if not best:
                        continue
                    i, j = (np.concatenate(z) for z in zip(*best))
                    rows = pa.array(at[j])
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(start + i)), *(batch.column(c).take(rows) for c in columns), pa.array(s[i, j])], [query_id, *columns, "score"])

    return run


def scores(q: np.ndarray, x: np.ndarray, metric: str, digits: int) -> np.ndarray:
    if metric == "cosine":
        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        s = np.divide(q @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0)
    else:
        s = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))
    return np.round(s, digits) + 0.0


def least(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` least finite entries, the first of equal ones."""
    bound = np.partition(key, k - 1, axis=1)[:, k - 1 : k] if key.shape[1] > k else np.full((len(key), 1), np.inf)
    i, j = np.nonzero((key <= bound) & (key < np.inf))
    order = np.lexsort((j, key[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)  # where each row starts
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept]


def merged(hits: DataFrame, k: int, *, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Hits of all groups in one ranking of each query, cut to ``k``."""
    window = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def deduplicated(hits: DataFrame, *, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """One row for each query and id, of the highest score."""
    return hits.groupBy(query_id, id_col).agg(F.max("score").alias("score"))


def rank_funnel(hits: DataFrame, k: int, rerank=None, rerank_top: int = 5, *, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Cut to 2k, score anew, cut to ``rerank_top``, then to k.  ``rerank`` is a column for the new score; without one the
    first ranking stays."""
    first = merged(hits, 2 * k, query_id=query_id, id_col=id_col)
    if rerank is None:
        return first.where(F.col("rank") <= k)
    return merged(first.withColumn("score", rerank), min(k, rerank_top), query_id=query_id, id_col=id_col)


def reranked(hits: DataFrame, answers: DataFrame, k: int, *, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """``hits`` (``query_id, id, score, rank``) by a re-ranker's ``answers`` (``query_id, index, relevance``), whose index is a candidate's place from 0: the best ``k`` of
    those it names, and ``source`` ``rerank``.  A query that it has failed for (no answers, or none that names a candidate) keeps its first ``k`` in their order, ``source`` ``first``."""
    given = answers.where(F.col("relevance").isNotNull()).select(F.col(query_id).alias("_q"), (F.col("index") + 1).cast("long").alias("_at"), F.col("relevance").cast("double").alias("_r"))
    named = hits.join(given.groupBy("_q", "_at").agg(F.max("_r").alias("_r")), (F.col(query_id) == F.col("_q")) & (F.col("rank") == F.col("_at")), "left").drop("_q", "_at")
    served = F.max(F.col("_r").isNotNull()).over(Window.partitionBy(query_id))
    told = named.withColumn("_served", served).where(~F.col("_served") | F.col("_r").isNotNull()).withColumn("_s", F.when(F.col("_served"), F.col("_r")).otherwise(-F.col("rank").cast("double")))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("_s"), "rank")).cast("long")
    return told.withColumn("_place", place).where(F.col("_place") <= k).select(query_id, id_col, F.when(F.col("_served"), F.col("_r")).otherwise(F.col("score")).alias("score"), F.col("_place").alias("rank"), F.when(F.col("_served"), "rerank").otherwise("first").alias("source"))


def embedded(texts: DataFrame, embed, *, dim: int, text_col: str = "text", retries: int = 3) -> DataFrame:
    """``texts`` with ``embedding`` and ``error``.  ``embed`` maps a list of texts to vectors; connection failures are
    retried, and a batch that still fails records its error and does not end the job."""
    import time

    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batches):
        for rows in batches:
            error, vectors = None, None
            for attempt in range(retries):
                try:
                    vectors = [list(map(float, v)) for v in embed(list(rows[text_col]))]
                    error = None if all(len(v) == dim for v in vectors) else f"expected {dim} dimensions"
                    break
                except ConnectionError as e:
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(min(30, 2 ** (attempt + 1)) if attempt + 1 < retries else 0)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    break
            yield rows.assign(embedding=vectors if error is None else [None] * len(rows), error=error)

    return texts.mapInPandas(run, schema)
