"""Exact n-gram Jaccard join with a token-group matrix.

Documents become sets of hashed word shingles; equal sets are one *set* with many documents.

1. *Signatures.*  In one global (hashed) order of all shingles, two similar sets share several of their first few.  These
   are dealt out by shingle once; those that one set alone has go at once, and so do sets with fewer shared ones, or
   more shingles of their own, than a similar set can have.
2. *Groups.*  Each set that is left joins the group of the leader it shares most signatures with.  Groups are cut into
   blocks of bounded size, each of which also holds the leader.
3. *Token-group matrix.*  A block is stored as groups of up to ``WIDTH`` sets with the union of their shingles, which
   shingle is in which group, and who holds it.  A query's overlap with a group's union bounds its overlap with every
   member, so only groups that reach the threshold are opened and counted exactly.  A query skips groups in which all
   are linked with it already.
4. *Between groups.*  Signatures whose sets are still in different components are kept, as long as their sets have enough of
   them for a similar set to exist.  Two similar sets share that many, so they also share one when each keeps all but its
   most frequent ones; a signature that very many sets have is seldom kept.  A set is sent to those other blocks where a kept
   one is held by sets of another component and a fitting size, and goes through their matrix.
5. Components of all links name each document's class.

No step gathers a signature's or group's members in one row or task: runs of one signature are streamed, and large groups
are cut into blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mixed, ranges, released, row_blocks, text_bytes
from .components import connected_components
from .shingles import shingle_sets

BLOCK_BYTES = 1 << 20
#: Sets in a group of the matrix, and in a block of groups.
WIDTH = 64
BLOCK_SETS = 512
#: Names of sets that a task remembers, so that copies send their signatures once a task.
REMEMBERED = 1 << 16


def signatures(tokens: np.ndarray, values: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order of ``values``; similar sets share ``1 + n // 20`` of them, n being the smaller one's size."""
    few = len(tokens) - -(-len(tokens) * percent // 100) + 1 + len(tokens) // 20 if len(tokens) else 0
    return tokens[np.argsort(values, kind="stable")[:few]]


def named_sets(block, size: int, text_col: str):
    """The sets of a block's texts, their shingles' places in the global order, and their 128-bit names."""
    sets = shingle_sets(*text_bytes(block.column(text_col)), size)
    mixes = [mixed(s) for s in sets]
    one = np.array([m.sum(dtype=np.uint64) for m in mixes], np.uint64).view(np.int64)
    two = np.array([mixed(m + np.uint64(7)).sum(dtype=np.uint64) for m in mixes], np.uint64).view(np.int64)
    return sets, mixes, one, two


def set_names(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, n, s1, s2``: size and name of each document's set."""

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, text_col, BLOCK_BYTES):
                sets, _, one, two = named_sets(block, size, text_col)
                yield pa.RecordBatch.from_arrays([block.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)], ["_id", "n", "s1", "s2"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {dict(docs.dtypes)[id_col]}, n long, s1 long, s2 long")


def signature_rows(docs: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """``sig, s1``, at least once for each set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in row_blocks(batch, text_col, BLOCK_BYTES):
                sets, mixes, one, _ = named_sets(block, size, text_col)
                sent, names = [], []
                for tokens, values, name in zip(sets, mixes, one.tolist()):
                    if name not in seen:
                        sent.append(signatures(tokens, values, percent))
                        names.append(name)
                        if len(seen) < REMEMBERED:
                            seen.add(name)
                flat = np.concatenate([*sent, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(names, np.int64), [len(x) for x in sent]))], ["sig", "s1"])

    return docs.select(text_col).mapInArrow(run, "sig long, s1 long")


def token_sets(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """``s1, n, tokens`` of each row's set."""

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, text_col, BLOCK_BYTES):
                sets, _, one, _ = named_sets(block, size, text_col)
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["s1", "n", "tokens"]
                )

    return docs.select(text_col).mapInArrow(run, "s1 long, n long, tokens array<long>")


def met(rows: DataFrame) -> DataFrame:
    """``sig, s1, hub`` for the signatures that several sets have; ``hub`` is the smallest of their names.

    Rows are dealt out by signature and streamed in order, so a signature's sets are never held together.
    """

    def run(batches):
        sig_, hub_, last_, held_ = None, None, None, 0  # of the run that may go on
        for batch in batches:
            sig, name = np.asarray(batch.column("sig")), np.asarray(batch.column("s1"))
            if not len(sig):
                continue
            fresh = np.append(sig_ is None or sig[0] != sig_ or name[0] != last_, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))
            sig, name = sig[fresh], name[fresh]
            if not len(sig):
                continue
            opens = np.append(sig[0] != sig_, sig[1:] != sig[:-1])
            first = np.flatnonzero(opens)
            run_of = np.cumsum(opens)  # 0: the run of the last batch
            hubs = np.concatenate(([0 if hub_ is None else hub_], name[first]))
            sizes = np.bincount(run_of, minlength=len(hubs))
            alone = sizes == 1
            alone[0] = False
            out = ~alone[run_of]
            columns = [sig[out], name[out], hubs[run_of[out]]]
            if sizes[0] and held_ == 1:
                columns = [np.append(c, x) for c, x in zip(columns, (sig_, hub_, hub_))]
            ends_alone = len(first) and alone[-1]
            held_ = 1 if ends_alone else 2
            sig_, last_, hub_ = sig[-1], name[-1], hubs[-1]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sig", "s1", "hub"])

    return rows.select("sig", "s1").repartition("sig").sortWithinPartitions("sig", "s1").mapInArrow(run, "sig long, s1 long, hub long")


def enough(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``s1`` of sets with as many of the signatures as they must share with a similar set, of at least n * percent / 100 shingles."""
    held = shared.groupBy("s1").agg(F.count("*").alias("_k"))
    return held.join(sizes, "s1").where(F.col("_k") >= 1 + F.floor(F.col("n") * percent / 2000)).select("s1")


def ngram_jaccard_components(
    docs: DataFrame, *, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1_000_000
) -> DataFrame:
    """``id_col, n_shingles, component_id``.

    Documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` / 100;
    ``component_id`` is the smallest id that links reach.  A text of fewer words has its whole sequence as its one
    shingle; null and empty texts and texts without words have none, link with nothing, and keep their own id.
    Repeated rows are copies like any others.  ``id_col`` must be integral; a null id names a component only if all
    its ids are null.
    """
    features = released(set_names(docs, words, id_col, text_col))
    sizes = features.where("n > 0").groupBy("s1").agg(F.min("n").alias("n"))
    shared = released(met(signature_rows(docs, words, percent, text_col)))
    able = released(enough(shared, sizes, percent))

    # Sets of the candidates, each from one of its documents.
    rows = features.groupBy("_id", "s1").agg(F.count("*").alias("_rows"))
    chosen = rows.join(able, "s1").groupBy("s1").agg(F.min_by(F.struct("_id", "_rows"), F.struct("_id")).alias("_one"))
    chosen = released(chosen.groupBy(F.col("_one._id").alias("_chosen")).agg(F.max("_one._rows").alias("_rows"), F.count("*").alias("_sets")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(chosen.select("_chosen"), F.col("_id").eqNullSafe(F.col("_chosen")))
    sets = token_sets(texts, words, text_col)
    # Only repeated ids can give a set twice.
    sets = released(sets if chosen.where("_rows > 1 or _sets > 1").isEmpty() else sets.dropDuplicates(["s1"]))

    few = sets.select("s1", "n").join(private(sets), "s1", "left").where((F.col("n") - F.coalesce("u", F.lit(0))) * 100 >= F.col("n") * percent)
    sets = released(sets.join(few.select("s1"), "s1"))
    shared = released(met(shared.select("sig", "s1").join(sets.select("s1"), "s1")))
    blocks = blocks_of_groups(shared, sets.select("s1", "n"), block_tokens)
    links = released(within(blocks, sets, percent))
    first = connected_components(links)

    # Signatures whose sets are in different components, and sets with enough of these.
    open_ = shared.select("sig", "s1").join(first.withColumnRenamed("node", "s1"), "s1", "left").select(
        "sig", "s1", F.coalesce("component", "s1").alias("c")
    )
    open_ = released(several(open_))
    open_ = released(several(open_.join(enough(open_, sizes, percent), "s1").select("sig", "s1", "c")))
    more = between(rarest(open_, sets.select("s1", "n"), percent), blocks.where("role = 1 or own"), sets, percent)

    final = connected_components(links.union(more)).select(F.col("node").alias("s1"), "component")
    named = features.join(final, "s1", "left").withColumn(
        "_key", F.when(F.col("component").isNotNull(), F.struct(F.col("component").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.col("s1").alias("a"), F.col("s2").alias("b")))
    )
    least = named.where("n > 0").groupBy("_key").agg(F.min("_id").alias("component_id"))
    whole = named.where("n > 0").join(least, "_key").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return whole.union(named.where("n = 0").select("_id", "n", "_id"))


def several(rows: DataFrame) -> DataFrame:
    """``sig, s1, c, m`` of the signatures that still have sets of more than one component; ``m`` is how many sets have one."""
    mixed_ = rows.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("sig", "m")
    return rows.select("sig", "s1", "c").join(mixed_, "sig")


def rarest(open_: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``sig, s1, c, n``: of a set's k signatures the first k - t + 1, rare ones first, where t is how many of them it shares with
    any similar set.  Two sets that share t then have one in common among those they keep."""
    own = Window.partitionBy("s1")  # the signatures of one text
    ranked = open_.join(sizes, "s1").withColumn("_r", F.row_number().over(own.orderBy("m", "sig"))).withColumn("_k", F.count("*").over(own))
    return ranked.where(F.col("_r") <= F.col("_k") - F.floor(F.col("n") * percent / 2000)).select("sig", "s1", "c", "n")


def private(sets: DataFrame) -> DataFrame:
    """``s1, u``: how many shingles of a set no other one has."""
    tokens = sets.select("s1", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("k"), F.min("s1").alias("s1"))
    return tokens.where("k = 1").groupBy("s1").agg(F.count("*").alias("u"))


def blocks_of_groups(shared: DataFrame, sizes: DataFrame, block_tokens: int) -> DataFrame:
    """``g, block, s1, role, own``: the blocks of groups.  A set's group is that of the hub it shares most signatures with; the hub
    leads it (``role`` 0) in each of its blocks, and ``own`` says where it is in no other group."""
    counts = shared.where("s1 != hub").groupBy("s1", "hub").agg(F.count("*").alias("k"))
    best = checkpointed(counts.groupBy("s1").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("g")).join(sizes, "s1"))
    sized = best.groupBy("g").agg((F.floor(F.greatest(F.sum("n") / block_tokens, F.count("*") / BLOCK_SETS)) + 1).cast("int").alias("blocks"))
    dealt = best.join(sized, "g").select("g", F.pmod(F.xxhash64("s1", F.lit("block")), F.col("blocks")).cast("int").alias("block"), "s1", F.lit(1).alias("role"), F.lit(True).alias("own"))
    free = sized.join(best.select(F.col("s1").alias("g"), F.lit(True).alias("led")), "g", "left")
    leaders = free.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("g").alias("s1"), F.lit(0).alias("role"), "led")
    return dealt.union(leaders.select("g", "block", "s1", "role", F.col("led").isNull() & (F.col("block") == 0)))


def within(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that connect the sets of each block."""
    units = blocks.join(sets, "s1").repartition("g", "block").sortWithinPartitions("g", "block", "role", "n", "s1")

    def run(batches):
        key, held = None, []
        for batch in batches:
            g, block, names = (batch.column(c).to_pylist() for c in ("g", "block", "s1"))
            for at, (now, tokens) in enumerate(zip(zip(g, block), token_lists(batch))):
                if now != key:
                    yield from answer(held)
                    key, held = now, []
                held.append((names[at], tokens.copy()))
        yield from answer(held)

    def answer(held):
        if len(held) > 1:
            found = linked(held, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return units.select("g", "block", "s1", "tokens").mapInArrow(run, "a long, b long").distinct()


def between(open_: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between sets of different components ``c`` and blocks: a set is sent to those blocks in which one of its
    signatures is held by sets of another component, of sizes that a similar set can have."""
    place = blocks.select("s1", F.struct("g", "block").alias("to"))
    held = released(open_.join(place, "s1"))
    bound = lambda f, c, name: f(c).alias(name)
    wanted = held.groupBy("sig", "to").agg(bound(F.min, "c", "c_lo"), bound(F.max, "c", "c_hi"), bound(F.min, "n", "n_lo"), bound(F.max, "n", "n_hi"))
    others = (F.col("c_lo") != F.col("c")) | (F.col("c_hi") != F.col("c"))
    fitting = (F.col("n") * 100 >= F.col("n_lo") * percent) & (F.col("n_hi") * 100 >= F.col("n") * percent)
    met_ = held.withColumnRenamed("to", "at").join(wanted, "sig").where((F.col("at") < F.col("to")) & others & fitting)
    asked = checkpointed(met_.select("s1", "to").distinct().withColumn("role", F.lit(1)))
    names = held.select("s1", "c").distinct()
    stored = place.join(asked.select("to").distinct(), "to").select("s1", "to", F.lit(0).alias("role"))
    units = stored.union(asked).join(names, "s1").join(sets, "s1").select("to.g", "to.block", "role", "s1", "c", "n", "tokens")
    units = units.repartition("g", "block").sortWithinPartitions("g", "block", "role", "n", "s1")

    def run(batches):
        key, groups, store = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("g", "block", "role", "s1", "c")]
            out = []
            for g, block, role, s, c, tokens in zip(*columns, token_lists(batch)):
                if (g, block) != key:
                    key, groups, store = (g, block), None, []
                if role == 0:
                    store.append((s, tokens.copy(), c))
                    continue
                if groups is None:
                    groups = [TokenGroup(store[k : k + WIDTH]) for k in range(0, len(store), WIDTH)]
                for group in groups:
                    apart = group.components != c
                    if apart.any():
                        out += [(s, b) for b in group.names[apart & group.similar(tokens, percent)].tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return units.mapInArrow(run, "a long, b long").distinct()


def linked(members: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that connect a block's sets as all their links do; the first of ``members`` asks first."""
    groups = [TokenGroup(members[k : k + WIDTH]) for k in range(0, len(members), WIDTH)]
    label = np.arange(len(members))
    out = []
    for i, (name, tokens) in enumerate(members):
        for k, group in enumerate(groups):
            at = slice(k * WIDTH, k * WIDTH + len(group.names))
            if (label[at] == label[i]).all():
                continue
            for j in (np.flatnonzero(group.similar(tokens, percent)) + at.start).tolist():
                if label[j] != label[i]:
                    out.append((name, int(members[j][0])))
                    label[label == label[j]] = label[i]
    return out


def token_lists(batch):
    tokens = batch.column("tokens")
    flat, ends = np.asarray(tokens.flatten()).view(np.uint64), np.asarray(tokens.offsets)
    ends = (ends - ends[0]).tolist()
    return (flat[a:b] for a, b in zip(ends, ends[1:]))


class TokenGroup:
    """Up to ``WIDTH`` sets: the union of their shingles, ascending, each with its holders."""

    def __init__(self, members: list[tuple]):
        self.names = np.array([m[0] for m in members], np.int64)
        self.components = np.array([m[2] for m in members], np.int64) if len(members[0]) > 2 else self.names
        self.sizes = np.array([len(m[1]) for m in members], np.int64)
        tokens = np.concatenate([m[1] for m in members])
        order = np.argsort(tokens, kind="stable")
        self.holders = np.repeat(np.arange(len(members)), self.sizes)[order]
        tokens = tokens[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.union = tokens[first]
        self.bounds = np.append(first, len(tokens))

    def similar(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Which members are similar to the set ``tokens``."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) * 100 < len(tokens) * percent:  # no member can have more in common
            return np.zeros(len(self.names), bool)
        held = self.holders[ranges(self.bounds[at], self.bounds[at + 1] - self.bounds[at])]
        both = np.bincount(held, minlength=len(self.names))
        return both * 100 >= (len(tokens) + self.sizes - both) * percent


#: Components are the closure of links over the distinct sets.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END)) AS s FROM words
), classes AS (SELECT s, min(r) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
named AS (SELECT a AS c, min(b) AS k FROM reached GROUP BY a),
owners AS (SELECT s.doc_id, s.r, len(s.s) AS n, n.k FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN named n ON n.c = c.c)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN k IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k) END AS component_id FROM owners
"""


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Classes of similar documents, over the whole table; see ``ngram_jaccard_components``."""
    from .common import table

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))
