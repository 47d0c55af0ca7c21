"""A Merkle manifest of a dataset: a tree of fan-out 16 over each source's documents, and one over the sources.

Leaves are sorted by range and numbered through partitions by offsets (``ranks.numbered``).  Each partition builds the
complete aligned subtrees of its leaves; the few nodes at its ragged ends, and they alone, are shuffled by the coordinate
of their parent (group, level, index), level by level.  Proofs come top-down: a run of 16 children meets its parent's path,
so no key has more than 16 rows, and 256 neighbouring leaves share one path.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .importance import CRC32
from .ranks import numbered

FAN = 16
#: Proofs are made by blocks of FAN ** BLOCK leaves.
BLOCK = 2


def digest_of(*columns: Column) -> Column:
    """SHA-256, as lower-case hex, of the values: ``-`` for null, else their UTF-8 byte count, ``:`` and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    h = 0
    while FAN**h < n:
        h += 1
    return h


def height_column(most: int) -> Column:
    out = F.lit(0)
    for h in range(height(most)):
        out = out + (F.col("n") > FAN**h).cast("int")
    return out


def tree(rows: DataFrame, group: str, order: list[Column], keep: int) -> tuple[DataFrame, DataFrame, int]:
    """Numbered rows; nodes (``g, n, level, idx, digest``) of level ``keep`` and more, and the group's root in any case; the
    largest group.  ``rows`` needs ``group`` and ``digest`` and should be stored."""
    leaves, largest = numbered(rows, group, order)

    def subtrees(batches):
        out: list[tuple] = []
        name, n, pending = None, 0, []

        def put(level: int, idx: int, digest: str):
            """A complete node: a run that it completes becomes its parent; otherwise it waits."""
            top = level == height(n)
            if level >= keep or top:
                out.append((name, n, level, idx, digest, False))
            if top:
                return
            while len(pending) <= level:
                pending.append([])
            run = pending[level]
            run.append((idx, digest))
            if idx % FAN == FAN - 1:
                close(level)

        def close(level: int):
            run, pending[level] = pending[level], []
            if run[0][0] % FAN == 0:
                put(level + 1, run[0][0] // FAN, joined([d for _, d in run]))
            else:
                out.extend((name, n, level, i, d, True) for i, d in run)

        def end(pos: int):
            """The partition leaves the group after leaf ``pos``: the last runs end here, or their nodes are sent on."""
            level = 0
            while level < len(pending):
                if pending[level]:
                    if pos == n - 1:
                        close(level)
                    else:
                        out.extend((name, n, level, i, d, True) for i, d in pending[level])
                        pending[level] = []
                level += 1
            pending.clear()

        begun, last = False, -1
        for batch in batches:
            for g, size, pos, digest in zip(*(batch.column(c).to_pylist() for c in (group, "n", "pos", "digest"))):
                if not begun or g != name:
                    if begun:
                        end(last)
                    name, n, begun = g, size, True
                put(0, pos, digest)
                last = pos
            if out:
                yield record(out)
                out.clear()
        if begun:
            end(last)
        if out:
            yield record(out)

    def record(out):
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()])], ["g", "n", "level", "idx", "digest", "ragged"])

    nodes = checkpointed(leaves.select(group, "n", "pos", "digest").mapInArrow(subtrees, "g string, n long, level int, idx long, digest string, ragged boolean"))
    every = nodes.where(~F.col("ragged"))  # ragged nodes that are kept stand there too
    made = None
    for level in range(height(largest)):
        pending = nodes.where(F.col("ragged") & (F.col("level") == level)).drop("ragged")
        if made is not None:
            pending = pending.unionByName(made.where(F.col("n") > FAN**level))
        made = runs(pending).select("g", "n", F.lit(level + 1).alias("level"), "idx", F.sha2(F.array_join("run", "").cast("binary"), 256).alias("digest"))
        every = every.unionByName(made.where((F.col("level") >= keep) | (F.col("n") <= FAN ** (level + 1))).withColumn("ragged", F.lit(False)))
    return leaves, checkpointed(every.drop("ragged")), largest


def runs(nodes: DataFrame) -> DataFrame:
    """``g, n, idx, run``: the at most 16 children of each parent, in order."""
    children = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    return nodes.groupBy("g", "n", F.floor(F.col("idx") / FAN).cast("long").alias("up")).agg(F.transform(children, lambda x: x["digest"]).alias("run")).withColumnRenamed("up", "idx")


def paths(nodes: DataFrame, roots: DataFrame, largest: int, keep: int) -> DataFrame:
    """``g, idx, subroot, path`` of the nodes at level ``keep``, or of the root of a lower tree; ``path`` lists from there up
    where a node stands among its parent's children (``at``, ``run``).  ``roots`` gives ``g, above``: what follows at a root."""
    h = height_column(largest)
    found = None
    tops = nodes.where(F.col("level") == h).join(roots, "g").select("g", "level", F.col("idx"), F.col("digest").alias("subroot"), F.col("above").alias("path"))
    for level in range(height(largest), keep - 1, -1):
        here = tops.where(F.col("level") == level).drop("level")
        if found is not None:
            up = found.withColumnRenamed("idx", "_up")
            met = runs(nodes.where((F.col("level") == level) & (h > level))).withColumnRenamed("idx", "_up").join(up, ["g", "_up"])
            step = met.select("g", "_up", "subroot", "path", "run", F.explode(F.sequence(F.lit(0), F.size("run") - 1)).alias("at"))
            here = here.unionByName(step.select("g", (F.col("_up") * FAN + F.col("at")).alias("idx"), "subroot", F.concat(F.array(F.struct("at", "run")), "path").alias("path")))
        found = here
    low = tops.where(F.col("level") < keep).drop("level")
    return low if found is None else found.unionByName(low)


PATH = "array<struct<at:int,run:array<string>>>"


def manifest(docs: DataFrame, *, columns: list[str] = ["doc_id", "source", "lang", "n_chars", "text"], id_col: str = "doc_id", group_col: str = "source", claimed: Column | None = None, proof: bool = False) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row, and with ``proof`` the proof itself (by
    level ``at``, the place in the run, and ``siblings``).

    A leaf is the digest of ``columns`` (see ``digest_of``); it stands in its group by ``id_col`` (null first) and then by the digest,
    so the tree is the same however the rows are stored.  Rows that agree in all of them are leaves of their own.  ``claimed``, where it is given
    and not null, is a digest that is verified in the leaf's place.  A null group is a group of its own, before all others; no rows, no result.
    Only the named columns are read.
    """
    claimed = F.lit(None).cast("string") if claimed is None else claimed
    leaf = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("-")).alias("g"), F.col(id_col).alias("_id"), digest_of(*[F.col(c) for c in columns]).alias("digest"), claimed.alias("claimed"))
    leaves, nodes, largest = tree(checkpointed(leaf), "g", [F.col("_id").asc_nulls_first(), F.col("digest")], BLOCK)
    spark = docs.sparkSession
    if largest == 0:
        none = ", ".join(["leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"] + ["proof array<struct<at:int,siblings:array<string>>>"] * proof)
        return spark.createDataFrame([], f"`{id_col}` {dict(docs.dtypes)[id_col]}, {none}")
    subroots = nodes.where(F.col("level") == height_column(largest)).select(F.lit("").alias("all"), F.col("g").alias("name"), "digest")
    heads, above, sources = tree(checkpointed(subroots), "all", [F.col("name")], 0)
    start = spark.createDataFrame([("", [])], f"g string, above {PATH}")
    upper = paths(above, start, sources, 0).select(F.col("idx").alias("pos"), F.col("subroot").alias("root"), F.col("path").alias("above"))
    by_source = checkpointed(heads.join(upper, "pos").select(F.col("name").alias("g"), F.struct("root", "above").alias("above")))
    # Below a source's root, its path goes on with the root's own.
    own = paths(nodes, by_source.select("g", F.col("above.above").alias("above")), largest, BLOCK)
    shared = own.join(by_source.select("g", F.col("above.root").alias("root")), "g").select("g", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("pos"), "subroot", "root", "path")
    kind = dict(docs.dtypes)[id_col]
    rows = leaves.select("g", F.floor(F.col("pos") / FAN**BLOCK).cast("long").alias("block"), "pos", "n", "_id", "digest", "claimed")
    dealt = rows.unionByName(shared, allowMissingColumns=True).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * proof
    of = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<at:int,siblings:array<string>>>" * proof

    def prove(batches):
        def lines():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("g", "block", "pos", "n", "digest", "claimed", "subroot", "root", "path")), batch.column("_id"))

        for _, block in groupby(lines(), key=lambda x: x[:2]):
            yield proved(list(block), names, proof)

    return dealt.mapInArrow(prove, of)


def proved(block: list[tuple], names: list[str], proof: bool) -> pa.RecordBatch:
    """The rows of one block, whose first line is the shared path: siblings below it are found in the block itself."""
    (_, _, _, _, _, _, subroot, root, path, _), *leaves = block
    levels, n = [[x[4] for x in leaves]], leaves[0][3]
    for _ in range(min(BLOCK, height(n)) - 1):
        levels.append([joined(levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
    below = [["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)] for nodes in levels[: min(BLOCK, height(n))]]
    upper = [(p["at"], "".join(p["run"])) for p in path]
    rest = "".join(without(at, run) for at, run in upper)
    out = []
    for i, (_, _, _, _, digest, claimed, _, _, _, name) in enumerate(leaves):
        steps = [(i // FAN**level % FAN, strings[i // FAN ** (level + 1)]) for level, strings in enumerate(below)] + upper
        own = claimed or digest
        for at, run in steps:
            own = sha256((run[: 64 * at] + own + run[64 * at + 64 :]).encode()).hexdigest()
        siblings = "".join(without(at, run) for at, run in steps[: len(below)]) + rest
        line = [name, digest, subroot, root, sha256(siblings.encode()).hexdigest(), own, own == root]
        if proof:
            line.append([{"at": at, "siblings": [s[k : k + 64] for s in [without(at, run)] for k in range(0, len(s), 64)]} for at, run in steps])
        out.append(line)
    kinds = [leaves[0][9].type] + [pa.string()] * 5 + [pa.bool_()] + [pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))] * proof
    columns = [pa.array([v.as_py() if k == 0 else v for v in values], kind) for k, (values, kind) in enumerate(zip(zip(*out), kinds))]
    return pa.RecordBatch.from_arrays(columns, names)


def without(at: int, run: str) -> str:
    return run[: 64 * at] + run[64 * at + 64 :]


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; ids whose decimal's CRC-32 is divisible by 5 are verified with a text in lower case (A to Z)."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    names = ["doc_id", "source", "lang", "n_chars"]
    return manifest(docs, claimed=F.when(hit, digest_of(*[F.col(c) for c in names], changed)))


def _enc(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels(tag: str, count: int) -> str:
    """Of nodes ``{tag}0`` and leaves on their way ``{tag}p0``: runs, parents and the leaves' next step, level by level; a lone node stays."""
    out = []
    for i in range(count):
        out.append(f"""{tag}r{i} AS (SELECT g, pos // 16 AS up, list(h ORDER BY pos) AS run, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {tag}{i}) GROUP BY 1, 2),
{tag}{i + 1} AS (SELECT g, up AS pos, CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {tag}r{i}),
{tag}p{i + 1} AS (SELECT k, p.g, up AS pos, CASE WHEN c = 1 THEN own ELSE sha256(array_to_string(list_concat(list_concat(run[1 : p.pos % 16], [own]), run[p.pos % 16 + 2 :]), '')) END AS own,
 CASE WHEN c = 1 THEN proof ELSE proof || array_to_string(list_concat(run[1 : p.pos % 16], run[p.pos % 16 + 2 :]), '') END AS proof FROM {tag}p{i} p JOIN {tag}r{i} r ON p.g = r.g AND p.pos // 16 = r.up)""")
    return ",\n".join(out)


#: In DuckDB, for sources of at most 16 ** 4 documents and as many sources.
DEPTH = 4
SQL = f"""WITH d AS (SELECT *, {CRC32.format(s='CAST(doc_id AS VARCHAR)')} % 5 = 0 AS hit, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (SELECT row_number() OVER () AS k, doc_id, coalesce('s' || source, '-') AS g, sha256({' || '.join(map(_enc, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
 CASE WHEN hit THEN sha256({' || '.join(map(_enc, ('doc_id', 'source', 'lang', 'n_chars', 'low')))}) END AS claimed FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
s0 AS (SELECT g, pos, leaf AS h FROM m), sp0 AS (SELECT k, g, pos, coalesce(claimed, leaf) AS own, '' AS proof FROM m),
{_levels('s', DEPTH)},
named AS (SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM s{DEPTH}),
t0 AS (SELECT 'all' AS g, pos, h FROM named), tp0 AS (SELECT k, 'all' AS g, named.pos, own, proof FROM sp{DEPTH} p JOIN named ON p.g = named.name),
{_levels('t', DEPTH)}
SELECT doc_id, leaf, named.h AS subroot, t{DEPTH}.h AS root, sha256(p.proof) AS proof_sha256, p.own AS folded_root, p.own = t{DEPTH}.h AS verified
FROM m JOIN named ON m.g = named.name JOIN tp{DEPTH} p ON m.k = p.k, t{DEPTH}"""
