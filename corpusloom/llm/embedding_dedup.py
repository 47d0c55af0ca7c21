"""Near-duplicate embeddings by NN-descent.

Equal vectors are one *point* with a weight.  A point's list holds its nearest known neighbours.

1. *Start.*  In a few tables, points are ordered by the sign bits of random projections and then by one more
   projection, and every point meets those in a sliding window of this order.
2. *Descent.*  Each point introduces the points on its lists, and those that list it, to one another; whoever improves a
   list enters it.
3. *Joining.*  Of those that meet, all whose links connect them are joined into one component at once, whether or not
   their lists have room.  Lists have ``k`` places for points of other components and ``k`` for those of the own one, so links
   within a component can't crowd out links to another.  The descent goes on until a round joins nothing.
4. *Audit.*  A bounded, hash-chosen sample of points is compared with all others; links that it finds missing are added.
   While the recall of links, or that of the sampled points that have any, is below the target, the start is repeated
   with further tables and the descent goes on, and the next audit takes another sample.  If all tries stay below it,
   all pairs are compared, block by block.
5. *Counting.*  Every component is compared whole, block by block, so no link within it is lost however many there are.
   So two points of one component that pass the threshold are a link of the result, as the audit counts them.

Only pairs whose double-precision cosine reaches the threshold become links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components, united

#: Pairs that may enter lists; without ``sim``, points that links connect.
EDGE = "u long, v long, sim double"


def matrix(column) -> np.ndarray:
    """Unit rows of a non-empty Arrow list column whose lists have one length."""
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def distinct_points(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``p`` (hash of the vector), ``w`` (rows), ``dim``, ``vec`` for the vectors that can link."""
    usable = F.size(vector_col) > 0
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.where(F.col(vector_col).isNotNull() & usable & finite & F.exists(vector_col, lambda x: x != 0))
        .groupBy(F.xxhash64(vector_col).alias("p")).agg(F.count("*").alias("w"), F.first(vector_col).alias("vec"))
        .withColumn("dim", F.size("vec"))
    )


def started(points: DataFrame, tables: int, seed: int, bits: int, window: int, k: int, threshold: float) -> DataFrame:
    """Candidate edges from windows over random orders."""
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for dim in np.unique(batch.column("dim")):
                part = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
                x = matrix(part.column("vec"))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), bits + 1))
                    y = x @ planes
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(y), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(y), t * 100_003 + int(dim))), pa.array(code), pa.array(y[:, bits]), part.column("p"), part.column("c"), part.column("vec")],
                        ["t", "code", "at", "p", "c", "vec"],
                    )

    vec = dict(points.dtypes)["vec"]
    placed = points.select("p", "c", "dim", "vec").mapInArrow(place, f"t long, code long, at double, p long, c long, vec {vec}")
    ordered = placed.repartitionByRange(partitions, "t", "code", "at").sortWithinPartitions("t", "code", "at", "p")

    def meet(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= 4 * window:
                yield from windows(held.slice(0, 4 * window))
                held = held.slice(4 * window - window // 2).combine_chunks()
        if held is not None and held.num_rows:
            yield from windows(held)

    def windows(rows):
        key = np.asarray(rows["t"]) * 1_000_003 + np.asarray(rows["code"])
        name, label, vec = np.asarray(rows["p"]), np.asarray(rows["c"]), rows["vec"].combine_chunks()
        for start in range(0, max(1, len(key) - window // 2), window // 2):
            stop = min(len(key), start + window)
            same_t = np.asarray(rows["t"])[start:stop]
            for dim_t in np.unique(same_t):
                at = start + np.flatnonzero(same_t == dim_t)
                if len(at) < 2:
                    continue
                x = matrix(vec.take(pa.array(at)))
                apart, sims = label[at][:, None] != label[at][None, :], x @ x.T
                yield from edges(sims, name[at], apart & (key[at][:, None] == key[at][None, :]), k)
                yield from joined(sims, name[at], apart, threshold)

    return ordered.mapInArrow(meet, EDGE)


def edges(sims: np.ndarray, names: np.ndarray, allowed: np.ndarray | None, k: int):
    """Each row's ``k`` best partners."""
    sims = sims.copy()
    np.fill_diagonal(sims, -2)
    if allowed is not None:
        sims[~allowed] = -2
    k = min(k, len(names) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(names)), k)
    columns = best.ravel()
    good = (sims[rows, columns] > -2) & (names[rows] != names[columns])
    rows, columns = rows[good], columns[good]
    yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(names[columns]), pa.array(sims[rows, columns])], ["u", "v", "sim"])


def joined(sims: np.ndarray, names: np.ndarray, apart: np.ndarray, threshold: float):
    """Of the points that meet, each that links connect with others ``apart`` from it, and one point for all of these."""
    i, j = np.nonzero(apart & (sims >= threshold))
    if len(i):
        nodes, first = united(i, j)
        moved = nodes != first
        yield pa.RecordBatch.from_arrays([pa.array(names[nodes[moved]]), pa.array(names[first[moved]]), pa.nulls(int(moved.sum()), pa.float64())], ["u", "v", "sim"])


def labelled(points: DataFrame, components: DataFrame) -> DataFrame:
    """``points`` with their components ``c``; one that links with nothing is its own."""
    return points.join(components, F.col("p") == F.col("node"), "left").select("p", "w", "dim", "vec", F.coalesce("component", "p").alias("c"))


def nearest(candidates: DataFrame, components: DataFrame, k: int) -> DataFrame:
    """Lists: the ``k`` best distinct candidates of each point within its component (``same``) and the ``k`` best of others."""
    once = candidates.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    for side in ("u", "v"):
        names = components.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        once = once.join(names, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    once = once.select("u", "v", "sim", (F.col("cu") == F.col("cv")).alias("same"))
    rank = F.row_number().over(Window.partitionBy("u", "same").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def introduced(lists: DataFrame, points: DataFrame, k: int, threshold: float, chunk: int = 128) -> DataFrame:
    """Candidates from neighbours of neighbours: pairs of two components that improve at least one of their lists."""
    last = lists.where(~F.col("same")).groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("held"))
    known = points.join(last, F.col("p") == F.col("u"), "left").select("p", "c", "vec", F.when(F.col("held") >= k, F.col("least")).otherwise(-1.0).alias("least"))
    both = lists.select(F.col("u").alias("centre"), F.col("v").alias("p")).union(lists.select(F.col("v"), F.col("u"))).distinct()
    # A point with very many admirers introduces them in bounded parties.
    sorted_ = both.join(known, "p").withColumn("party", F.xxhash64("p", "centre")).repartition("centre").sortWithinPartitions("centre", "party")

    def meet(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            centre = np.asarray(held["centre"])
            cut = np.flatnonzero(centre[1:] != centre[:-1])
            done = int(cut[-1]) + 1 if len(cut) else len(centre) // chunk * chunk
            yield from parties(held.slice(0, done))
            held = held.slice(done).combine_chunks()
        if held is not None:
            yield from parties(held)

    def parties(rows):
        if not rows.num_rows:
            return
        centre, name, label, least = (np.asarray(rows[c]) for c in ("centre", "p", "c", "least"))
        vec = rows["vec"].combine_chunks()
        sizes = np.diff(np.asarray(vec.offsets))
        x = matrix(vec) if (sizes == sizes[0]).all() else None
        starts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1])).tolist()
        us, vs, ss = [], [], []
        for a, b in zip(starts, [*starts[1:], len(centre)]):
            for c in range(a, b, chunk):
                d = min(b, c + chunk)
                y = matrix(vec.slice(c, d - c)) if x is None else x[c:d]  # those around one centre have one length
                sims = y @ y.T
                apart = label[c:d, None] != label[None, c:d]
                i, j = np.nonzero(apart & (sims > least[c:d, None]))
                us.append(name[c + i]), vs.append(name[c + j]), ss.append(sims[i, j])
                yield from joined(sims, name[c:d], apart, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (us, vs, ss)], ["u", "v", "sim"])

    return sorted_.mapInArrow(meet, EDGE)


def audited(points: DataFrame, components: DataFrame, sample: int, threshold: float, turn: int) -> tuple[float, DataFrame]:
    """A sample of points is compared with all others: the share of its links that lie within components, or the mean
    share of a point's links if that is less; and the missing links ``u, v``, one for each component that a task finds."""
    known = labelled(points, components)
    queries = known.orderBy(F.xxhash64("p", F.lit("audit"), F.lit(turn)), "p").limit(sample).collect()
    held = points.sparkSession.sparkContext.broadcast(queries)  # at most ``sample`` vectors

    def compare(batches):
        asked = {}
        for q in held.value:
            asked.setdefault(q["dim"], []).append(q)
        asked = {d: (np.array([q["vec"] for q in qs], np.float64), np.array([q["p"] for q in qs]), np.array([q["c"] for q in qs])) for d, qs in asked.items()}
        totals, told = {}, set()
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                if dim in asked:
                    part = batch.filter(pa.array(dims == dim))
                    q, names, labels = asked[dim]
                    own, component = np.asarray(part.column("p")), np.asarray(part.column("c"))
                    hit = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ matrix(part.column("vec")).T >= threshold
                    hit &= names[:, None] != own[None, :]
                    inside = hit & (labels[:, None] == component[None, :])
                    for i in np.flatnonzero(hit.any(1)).tolist():
                        true, found = totals.get(names[i], (0, 0))
                        totals[names[i]] = true + int(hit[i].sum()), found + int(inside[i].sum())
                    told |= {(int(names[i]), int(component[j])) for i, j in zip(*np.nonzero(hit & ~inside))}
        rows = [(int(p), None, *n) for p, n in totals.items()] + [(u, v, 0, 0) for u, v in sorted(told)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["u", "v", "true", "found"])

    rows = checkpointed(known.mapInArrow(compare, "u long, v long, true long, found long"))
    each = rows.where(F.col("v").isNull()).groupBy("u").agg(F.sum("true").alias("t"), F.sum("found").alias("f"))
    row = each.agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.avg(F.col("f") / F.col("t")).alias("mean")).first()
    # A component's name is one of its points.
    return (min(row["f"] / row["t"], row["mean"]) if row["t"] else 1.0), rows.where(F.col("v").isNotNull()).select("u", "v")


def all_ties(points: DataFrame, components: DataFrame, threshold: float, block: int) -> DataFrame:
    """``u, v``: points that links connect, from all pairs of points of two components; blocks against blocks."""
    known = labelled(points, components).select(F.col("dim").alias("g"), "p", "c", "vec")
    sized = known.groupBy("g").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("blocks"))  # one row for each length
    dealt = known.join(F.broadcast(sized), "g").withColumn("own", F.pmod(F.xxhash64("p", F.lit("block")), F.col("blocks")).cast("int"))
    stored = F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(0).alias("role")))
    asking = F.transform(F.sequence(F.col("own"), F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(1).alias("role")))
    units = dealt.select("g", "p", "c", "vec", F.inline(F.concat(stored, asking))).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "role")

    def run(batches):
        key, store, x = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, i, j, role, names, label = (np.asarray(batch.column(n)) for n in ("g", "i", "j", "role", "p", "c"))
            cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (role[1:] != role[:-1]))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(g)]):
                if (now := (g[a], i[a], j[a])) != key:
                    key, store, x = now, [], None
                y = matrix(batch.slice(a, b - a).column("vec"))
                if role[a] == 0:
                    store.append((y, label[a:b]))
                    continue
                if x is None and store:
                    x, component = (np.concatenate(z) for z in zip(*store))
                if x is not None:
                    at, to = np.nonzero((y @ x.T >= threshold) & (label[a:b, None] != component[None, :]))
                    found = np.unique(np.stack((names[a:b][at], component[to])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

    return units.mapInArrow(run, "u long, v long")


def merged(components: DataFrame, ties: DataFrame) -> DataFrame:
    """``components`` after further points are connected."""
    known = components.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return checkpointed(connected_components(known.union(ties), "u", "v"))


def counted(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``p, links``: weights of a point's links within its component ``c``; blocks against blocks."""
    sized = members.groupBy("c").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("blocks"))
    dealt = members.join(sized, "c").withColumn("own", F.pmod(F.xxhash64("p", F.lit("block")), F.col("blocks")).cast("int"))
    stored = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(0).alias("role")))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(1).alias("role")))
    units = dealt.select("c", "p", "w", "vec", F.inline(F.concat(stored, asking))).repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "role")

    def run(batches):
        key, store, x = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            c, i, j, role, names = (np.asarray(batch.column(n)) for n in ("c", "i", "j", "role", "p"))
            cuts = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (role[1:] != role[:-1]))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(c)]):
                if (now := (c[a], i[a], j[a])) != key:
                    key, store, x = now, [], None
                rows = batch.slice(a, b - a)
                if role[a] == 0:
                    store.append((matrix(rows.column("vec")), np.asarray(rows.column("p")), np.asarray(rows.column("w"))))
                    continue
                if x is None:
                    x, own, weight = (np.concatenate(y) for y in zip(*store))
                hit = matrix(rows.column("vec")) @ x.T >= threshold
                hit &= names[a:b, None] != own[None, :]
                yield pa.RecordBatch.from_arrays([rows.column("p"), pa.array((hit @ weight.astype(np.int64)).astype(np.int64))], ["p", "links"])

    return units.mapInArrow(run, "p long, links long").groupBy("p").agg(F.sum("links").alias("links"))


def embedding_components(
    vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 10, tables: int = 6, window: int = 128, rounds: int = 1, sample: int = 512, recall: float = 0.97, tries: int = 4, block: int = 2048, seed: int = 7,
) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row for each input row.

    Vectors that are null, empty, zero, or hold nulls or non-finite components link with nothing, and vectors of
    different lengths do not link.  Equal vectors link with one another.
    """
    points = checkpointed(distinct_points(vectors, id_col, vector_col))
    n = points.count()
    bits = min(40, int(np.ceil(np.log2(n / window)))) if n > window else 0
    # A pair at the threshold has the same sign bits in a table with this chance; enough tables that all but a twentieth share one.
    alike = (1 - np.arccos(np.clip(threshold, 0, 1)) / np.pi) ** bits
    tables = max(tables, int(np.ceil(np.log(0.05) / np.log1p(-min(alike, 0.95)))))
    lists, components = None, points.select(F.col("p").alias("node"), F.col("p").alias("component")).limit(0)
    for attempt in range(tries):
        fresh, turn = started(labelled(points, components), tables, seed + attempt, bits, window, k, threshold), 0
        while True:
            fresh = checkpointed(fresh)
            ties, pairs = fresh.where(F.col("sim").isNull()).select("u", "v"), fresh.where(F.col("sim").isNotNull())
            if not (still := ties.isEmpty()):
                components = merged(components, ties)
            if still and turn >= rounds:
                break
            lists = checkpointed(nearest(pairs if lists is None else lists.drop("same").union(pairs), components, k))
            fresh, turn = introduced(lists, labelled(points, components), k, threshold), turn + 1
        found, missing = audited(points, components, sample, threshold, attempt)
        components = merged(components, missing) if found < 1 else components
        if found >= recall:
            break
    else:
        components = merged(components, all_ties(points, components, threshold, block))
    members = points.join(components, F.col("p") == F.col("node")).select("p", "w", "vec", F.col("component").alias("c"))
    compared = counted(members, threshold, block).select(F.col("p").alias("q"), "links")
    counts = points.join(compared, F.col("p") == F.col("q"), "left").select("p", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    counts = counts.join(components, F.col("p") == F.col("node"), "left").select("p", "n_links", F.coalesce("component", "p").alias("c"))
    named = vectors.select(id_col, F.xxhash64(vector_col).alias("p")).join(counts, "p", "left")
    least = named.where(F.col("c").isNotNull()).groupBy("c").agg(F.min(id_col).alias("component_id"))
    return named.join(least, "c", "left").select(
        F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"),
        F.coalesce("component_id", id_col).eqNullSafe(F.col(id_col)).alias("kept"),
    )


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return embedding_components(table(spark, sf_dir, "embeddings"))
