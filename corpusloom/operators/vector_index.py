"""A stored index of vectors: coarse cells with posting lists, in a folder that Spark reads and writes.

``cells`` holds the centroids, ``postings`` the vectors by the batch that added them and by cell, ``stats`` what each batch put
into each cell (rows, and the widest angle between the centroid and a row), ``commits`` the batches that count, written last: a failed write leaves files that
nothing reads.  New rows are added without a rebuild, and removals are a batch of ids.

A search looks into the cells nearest to each query.  The angles tell which other cells may hold something as good, so
``exact`` looks into those too, and only those; its result is that of a comparison with all rows.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import least, rows_of, scores

#: Rows of a cell, and queries, that meet in one group; larger cells are split into groups of about that many.
GROUP_ROWS = 16_384
COMMIT = "batch string, kind string, number long"


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    dim: int
    model: str
    centroids: np.ndarray  # cells x dim, unit length: a parameter bounds their number
    batches: dict[str, int]  # by the number of the commit
    removals: dict[str, int]


def built(vectors: DataFrame, path: str, *, model: str, dim: int, cells: int | None = None, sample: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
    """An index at ``path``, which must not exist.  Centroids come from k-means (cosine) on at most ``sample`` sound vectors, chosen by a
    hash of the id; by default there are as many as the square root of the rows, 4,096 at most.

    Vectors that are null, zero, of another length or hold null or non-finite components are refused.  Without vectors
    there is one cell with an arbitrary centroid, and rows can be added.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    checked(vectors, dim, vector_col)
    n = vectors.count()
    k = max(1, min(cells or round(math.sqrt(n)), 4096, n or 1))
    centroids = np.eye(1, dim)
    if n:
        share = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
        points = share.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
        found = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=8, seed=1).fit(points).clusterCenters()
        centroids = np.array([c / np.linalg.norm(c) for c in found if np.linalg.norm(c) > 0])
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(json.dumps({"dim": dim, "model": model, "id": id_col}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    spark.createDataFrame([], COMMIT).write.parquet(f"{path}/commits")
    return extended(loaded(spark, path), vectors, id_col=id_col, vector_col=vector_col)


def loaded(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    centroids = [r["centroid"] for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect()]
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()
    names = lambda kind: {r["batch"]: r["number"] for r in commits if r["kind"] == kind}
    return VectorIndex(spark, path, meta["dim"], meta["model"], np.array(centroids), names("rows"), names("removed"))


def checked(vectors: DataFrame, dim: int, vector_col: str) -> None:
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    bad = vectors.where(~F.coalesce(sound, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError(f"every vector needs {dim} finite components that are not all 0")


def extended(index: VectorIndex, vectors: DataFrame, *, model: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
    """The index with further rows; those of another model or length are refused, as are ids that it holds."""
    if model is not None and model != index.model:
        raise ValueError(f"the index holds vectors of {index.model}, not of {model}")
    checked(vectors, index.dim, vector_col)
    held = postings(index)
    if held is not None and not vectors.join(held.select("id"), F.col(id_col) == F.col("id"), "left_semi").isEmpty():
        raise ValueError("some ids are in the index; remove them first")
    batch = uuid.uuid4().hex
    assigned = nearest_cells(index, vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), 1)
    # A cell's rows go to up to eight tasks, so that a large cell is not one task's.
    assigned.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{index.path}/postings/batch={batch}")
    if not vectors.isEmpty():
        stats = index.spark.read.parquet(f"{index.path}/postings/batch={batch}").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        stats.coalesce(1).write.parquet(f"{index.path}/stats/batch={batch}")
        committed(index, batch, "rows")
    return loaded(index.spark, index.path)


def removed(index: VectorIndex, ids: DataFrame, id_col: str = "vec_id") -> VectorIndex:
    """The index without the rows that it has of some ids; they may be added anew later.  One writer at a time."""
    batch = uuid.uuid4().hex
    ids.select(F.col(id_col).alias("id")).distinct().write.parquet(f"{index.path}/removed/batch={batch}")
    committed(index, batch, "removed")
    return loaded(index.spark, index.path)


def compacted(index: VectorIndex, path: str, *, cells: int | None = None) -> VectorIndex:
    """A new index of what is left, with centroids of its own."""
    rows = postings(index).select("id", "vector")
    return built(rows, path, model=index.model, dim=index.dim, cells=cells, id_col="id", vector_col="vector")


def committed(index: VectorIndex, batch: str, kind: str) -> None:
    number = 1 + max([0, *index.batches.values(), *index.removals.values()])
    index.spark.createDataFrame([(batch, kind, number)], COMMIT).coalesce(1).write.mode("append").parquet(f"{index.path}/commits")


def postings(index: VectorIndex) -> DataFrame | None:
    if not index.batches:
        return None
    rows = index.spark.read.option("basePath", f"{index.path}/postings").parquet(*[f"{index.path}/postings/batch={b}" for b in index.batches])
    if not index.removals:
        return rows
    numbers = lambda table: F.create_map(*[F.lit(x) for b, n in table.items() for x in (b, n)])
    gone = index.spark.read.option("basePath", f"{index.path}/removed").parquet(*[f"{index.path}/removed/batch={b}" for b in index.removals])
    last = gone.groupBy("id").agg(F.max(numbers(index.removals)[F.col("batch")]).alias("_gone"))
    kept = rows.join(last, "id", "left").where(F.col("_gone").isNull() | (F.col("_gone") < numbers(index.batches)[F.col("batch")]))
    return kept.select(rows.columns)


def cell_stats(index: VectorIndex) -> dict[int, tuple[int, float]]:
    """Rows and radius of each cell; one line a cell."""
    rows = index.spark.read.parquet(*[f"{index.path}/stats/batch={b}" for b in index.batches]).groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    return {r["cell"]: (r["n"], r["radius"]) for r in rows}


def nearest_cells(index: VectorIndex, rows: DataFrame, probes: int) -> DataFrame:
    """``rows`` (``id, vector``) once for each of their ``probes`` nearest cells, with ``cell`` and ``angle``."""
    held = index.spark.sparkContext.broadcast(index.centroids)
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            x = rows_of(batch.column("vector"), index_dim)
            angle = angles(x, held.value)
            most = min(probes, angle.shape[1])
            i, j = least(angle, most)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("vector").take(at), pa.array(j.astype(np.int32)), pa.array(angle[i, j])], ["id", "vector", "cell", "angle"])

    index_dim = index.dim
    return rows.mapInArrow(run, f"id {kind}, vector {dict(rows.dtypes)['vector']}, cell int, angle double")


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T / np.linalg.norm(x, axis=1)[:, None], -1, 1)) if len(x) else np.zeros((0, len(centroids)))


def searched(index: VectorIndex, queries: DataFrame, k: int, *, probes: int = 8, exact: bool = False, digits: int = 4, query_id: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, vec_id, score, rank``: each query's ``k`` best rows by cosine, rounded to ``digits``, then by id, among its ``probes``
    nearest cells; with ``exact`` among all.  Queries need sound vectors of the index's length; no rows, no result."""
    checked(queries, index.dim, vector_col)
    asked = queries.select(F.col(query_id).alias("id"), F.col(vector_col).alias("vector"))
    empty = index.spark.createDataFrame([], f"`{query_id}` {dict(asked.dtypes)['id']}, vec_id long, score double, rank long")
    if not index.batches:
        return empty
    stats = cell_stats(index)
    first = best(index, stats, nearest_cells(index, asked, probes), k, digits, query_id)
    if not exact or probes >= len(index.centroids):
        return first
    first = first.checkpoint() if index.spark.sparkContext.getCheckpointDir() else first.persist()
    # A row of cell c makes an angle of at least (angle to c's centroid) - radius with the query.
    worst = first.groupBy(query_id).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("bound"))
    open_ = further_cells(index, asked.join(worst, F.col("id") == F.col(query_id), "left").select("id", "vector", "bound"), stats, probes, 10.0**-digits)
    more = best(index, stats, open_, k, digits, query_id)
    return ranked(first.drop("rank").unionByName(more.drop("rank")), k, query_id)


def further_cells(index: VectorIndex, asked: DataFrame, stats: dict, probes: int, slack: float) -> DataFrame:
    """``asked`` (``id, vector, bound``) once for each cell beyond the ``probes`` nearest that may hold a row of at least ``bound``, or of any score where it is null."""
    held = index.spark.sparkContext.broadcast((index.centroids, np.array([stats.get(c, (0, 0.0))[1] for c in range(len(index.centroids))]), np.array([c in stats for c in range(len(index.centroids))])))
    kinds = dict(asked.dtypes)
    dim = index.dim

    def run(batches):
        for batch in batches:
            centroids, radius, used = held.value
            angle = angles(rows_of(batch.column("vector"), dim), centroids)
            bound = np.array([-1.0 if b is None else b for b in batch.column("bound").to_pylist()])
            may = np.cos(np.maximum(angle - radius[None, :], 0)) >= bound[:, None] - 2 * slack
            may &= used[None, :]
            i, j = least(angle, min(probes, angle.shape[1]))
            may[i, j] = False
            i, j = np.nonzero(may)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("vector").take(at), pa.array(j.astype(np.int32)), pa.array(angle[i, j])], ["id", "vector", "cell", "angle"])

    return asked.mapInArrow(run, f"id {kinds['id']}, vector {kinds['vector']}, cell int, angle double")


def best(index: VectorIndex, stats: dict, asked: DataFrame, k: int, digits: int, query_id: str) -> DataFrame:
    """The best rows of the cells that each query is asked in.  Queries and rows of a cell meet in groups of bounded size: large
    cells are dealt out by salts, and the other side is repeated once for each."""
    spark = index.spark
    split = {c: -(-n // GROUP_ROWS) for c, (n, _) in stats.items() if n > GROUP_ROWS}
    counts = {r["cell"]: -(-r["n"] // GROUP_ROWS) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).collect()}
    parts = lambda table: F.coalesce(F.create_map(*[F.lit(x) for c, s in table.items() for x in (c, s)])[F.col("cell")], F.lit(1)) if table else F.lit(1)
    own = lambda table: F.pmod(F.xxhash64("id"), parts(table)).cast("int")
    every = lambda table: F.explode(F.sequence(F.lit(0), (parts(table) - 1).cast("int")))
    left = asked.withColumn("_q", own(counts)).select("*", every(split).alias("_p"))
    right = postings(index).withColumn("_p", own(split)).select("id", "vector", "cell", "_p", every(counts).alias("_q"))
    kind, other = dict(asked.dtypes)["id"], dict(right.dtypes)["id"]
    dim = index.dim

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({query_id: q.column("id").slice(0, 0), "vec_id": x.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        x = x.take(pc.sort_indices(x.column("id")))  # equal scores stand in the order of ids
        a, b = rows_of(q.column("vector"), dim), rows_of(x.column("vector"), dim)
        i, j, s = [], [], []
        for start in range(0, len(a), 512):
            got = scores(a[start : start + 512], b, "cosine", digits)
            r, c = least(-got, k)
            i.append(r + start), j.append(c), s.append(got[r, c])
        return pa.table({query_id: q.column("id").take(pa.array(np.concatenate(i))), "vec_id": x.column("id").take(pa.array(np.concatenate(j))), "score": pa.array(np.concatenate(s))})

    keys = ["cell", "_p", "_q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"`{query_id}` {kind}, vec_id {other}, score double")
    return ranked(found, k, query_id)


def ranked(found: DataFrame, k: int, query_id: str) -> DataFrame:
    window = Window.partitionBy(query_id).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def audited(index: VectorIndex, queries: DataFrame, k: int, *, probes: int = 8, query_id: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """``asked, found, recall`` of a search through ``probes`` cells against the exact one, over all the given queries; a row counts as found if its
    score is at least the exact ``k``-th one."""
    return held_against(index, queries, exact_bounds(index, queries, k, query_id, vector_col), k, probes, query_id, vector_col)


def exact_bounds(index: VectorIndex, queries: DataFrame, k: int, query_id: str, vector_col: str) -> DataFrame:
    true = searched(index, queries, k, exact=True, query_id=query_id, vector_col=vector_col)
    return true.groupBy(query_id).agg(F.min("score").alias("least"), F.count("*").alias("asked"))


def held_against(index: VectorIndex, queries: DataFrame, bounds: DataFrame, k: int, probes: int, query_id: str, vector_col: str) -> DataFrame:
    near = searched(index, queries, k, probes=probes, query_id=query_id, vector_col=vector_col)
    met = near.groupBy(query_id).agg(F.collect_list("score").alias("scores"))  # k scores at most
    both = bounds.join(met, query_id, "left").select("asked", F.size(F.filter(F.coalesce("scores", F.array().cast("array<double>")), lambda s: s >= F.col("least"))).alias("found"))
    return both.agg(F.sum("asked").alias("asked"), F.sum("found").cast("long").alias("found")).withColumn("recall", F.col("found") / F.col("asked"))


def probes_for(index: VectorIndex, queries: DataFrame, k: int, *, least_recall: float = 0.95, start: int = 4, query_id: str = "query_id", vector_col: str = "embedding") -> tuple[int, float]:
    """How many cells, doubled from ``start``, a search of such ``queries`` must look into for the recall wanted, and the recall they were found to give; all cells
    at most.  The exact results are taken once."""
    bounds = exact_bounds(index, queries, k, query_id, vector_col).persist()
    probes = start
    while True:
        recall = held_against(index, queries, bounds, k, probes, query_id, vector_col).first()["recall"]
        if recall is None or recall >= least_recall or probes >= len(index.centroids):
            bounds.unpersist()
            return min(probes, len(index.centroids)), recall or 0.0
        probes *= 2
