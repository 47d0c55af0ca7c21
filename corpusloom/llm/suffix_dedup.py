"""Removal of byte strings that occur more than once, across and within documents.

A *window* is a string of ``length`` bytes.  Every byte of a window that starts anywhere else too is removed.

1. *Anchors.*  Every window has an anchor: the ``seed``-byte string in it whose hash is least.  Equal windows have
   equal anchors at equal places, so only windows around equal anchors need comparing.  Neighbouring windows share an
   anchor; they and the bytes they span, the *hull*, are one row.
2. *Hulls.*  An anchor that occurs once has no repeated windows.  Hulls that occur twice are repeated throughout, and
   one of them stands for all.  What is left are anchors that recur in different surroundings.
3. *Column-wise construction.*  The surroundings of such anchors are collections of short strings, to the left (read
   backwards) and to the right.  Each round inserts one symbol of every string and updates the collection's order
   and the common prefixes of neighbours; order and common prefixes then tell, for any window, which strings of its
   anchor agree with it.  Strings arrive sorted by anchor through the shuffle and are worked off in sequence, whole
   anchors at a time, in bounded batches.
4. Anchors with very many different surroundings are split by content into ever narrower sets of windows, down to single
   ones if need be, before they reach step 3.  So no task gathers an unbounded group.

The same steps serve passages of words: a symbol is then a word's 64-bit hash instead of a byte, and lengths, places and
spans count words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import powers
from .common import checkpointed, kept_names, mixed, released, row_blocks, spread_join, text_bytes
from .shingles import word_hashes, word_places

BLOCK_BYTES = 1 << 20
#: Low bits of a hash that give way to a place.
PLACE_BITS = 22
#: Widths, in windows, that anchors with many surroundings are split to.
WIDTHS = (64, 16, 4, 1)
BATCH = 6_000
KEYS = ["key", "hull"]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def least_places(hashed: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive hashes; of equals, the first.  Places replace the hashes' low bits,
    so long data is taken in overlapping pieces whose places fit them."""
    kept = np.uint64(PLACE_BITS)
    step = (1 << PLACE_BITS) - width
    out = []
    for start in range(0, len(hashed) - width + 1, step):
        piece = hashed[start : start + step + width - 1]
        ranked = (piece >> kept << kept) | np.arange(len(piece), dtype=np.uint64)
        out.append(start + (sliding_least(ranked, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64))
    return np.concatenate(out)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Per text and anchor: its text, key, hull, first and last window, and place (bytes within the text); ``to`` and ``weight``: texts that repeat
    themselves have the same anchor and hull over and over, and such a run is one entry, with its last window and how many it stands for."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none, none, none
    power, inverse = powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])))
    hashed = mixed((sums[seed:] - sums[: n - seed + 1]) * inverse[: n - seed + 1])
    least = least_places(hashed, length - seed + 1)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    windows = np.arange(len(owner)) + (offsets[:-1] - np.concatenate(([0], np.cumsum(np.maximum(sizes - length + 1, 0))[:-1])))[owner]
    if not len(windows):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none, none, none
    at = least[windows]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(at)) - 1
    at, owner, lo, hi = at[first], owner[first], windows[first], windows[last]
    hull = mixed((sums[hi + length] - sums[lo]) * inverse[lo] + mixed(((at - lo) * 1_000_003 + (hi - lo)).astype(np.uint64)))
    base, key = offsets[owner], hashed[at]
    head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (hull[1:] != hull[:-1])))
    tail = np.append(head[1:], len(key)) - 1
    to = (hi - base)[tail]
    return *(x[head] for x in (owner, key, hull, lo - base, hi - base, at - base)), to, tail - head + 1


def symbols(column, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, or the hashes of their words, and the n + 1 offsets of the texts."""
    data, offsets = text_bytes(column)
    return word_hashes(data, offsets) if words else (data, offsets)


def anchor_rows(docs: DataFrame, length: int, seed: int, words: bool = False) -> DataFrame:
    """One row for each anchor, or run of equal ones, of each row's text; texts shorter than ``length`` have none."""

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                owner, key, hull, *places = anchors(*symbols(block.column("text"), words), length, seed)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id").take(rows), block.column("th").take(rows), pa.array(key.view(np.int64)), pa.array(hull.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in places)],
                    ["id", "th", "key", "hull", "lo", "hi", "at", "to", "weight"],
                )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, th long, key long, hull long, lo long, hi long, at long, to long, weight long")


def passage_rows(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``id, th, key``: each row's distinct anchors of ``seed`` words, at least one in every ``words`` words in sequence."""

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                owner, key, *_ = anchors(*word_hashes(*text_bytes(block.column("text"))), words, seed)
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                once = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
                rows = pa.array(owner[once])
                yield pa.RecordBatch.from_arrays([block.column("id").take(rows), block.column("th").take(rows), pa.array(key[once].view(np.int64))], ["id", "th", "key"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, th long, key long")


def shared_passages(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``id, th, n_passages``: how many of a row's anchors of ``seed`` words other rows have too."""
    rows = passage_rows(docs, words, seed)
    counts = released(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = spread_join(rows, counts, ["key"], "n").select("id", "th", "key").distinct()  # repeated rows say the same
    return released(shared.groupBy("id", "th").agg(F.count("*").alias("n_passages")))


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with ``key`` and ``hull``: those whose hull recurs, and those that remain to be compared with others (``open``)
    together with one row for each recurring hull that they may match."""
    several = rows.groupBy("key").agg(F.sum("weight").alias("rows"), F.min("hull").alias("a"), F.max("hull").alias("b")).where("rows > 1")
    several = released(several.select("key", "rows", (F.col("a") < F.col("b")).alias("differ")))
    name = F.xxhash64("id", "th", "lo", "hi")
    shared = released(spread_join(rows, several, ["key"], "rows").drop("rows").withColumn("name", name))
    hulls = checkpointed(shared.groupBy(*KEYS).agg(F.sum("weight").alias("n"), F.min("name").alias("chosen")))
    told = released(spread_join(shared, hulls, KEYS, "n"))
    repeated = told.where("n > 1")
    open_ = told.where("n = 1 and differ")
    stand = repeated.where("name = chosen and differ").dropDuplicates(KEYS).join(open_.select("key").distinct(), "key")
    columns = [c for c in rows.columns if c not in ("differ", "name", "n", "chosen", "to", "weight")]  # of a run, one hull is compared
    return repeated, released(open_.select(*columns).union(stand.select(*columns)))


def surroundings(docs: DataFrame, rows: DataFrame, length: int, seed: int, words: bool = False) -> DataFrame:
    """``rows`` with the symbols ``left`` and ``right`` of their anchors, read from the texts."""
    wanted = rows.groupBy("id", "th").agg(F.collect_list(F.struct("key", "hull", "lo", "hi", "at")).alias("rows"))
    wanted = wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "rows")
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "th", "text", "rows")

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                data, offsets = symbols(block.column("text"), words)
                buffer, size = data.tobytes(), data.itemsize
                owner, out = [], []
                for i, rows in enumerate(block.column("rows").to_pylist()):
                    b = int(offsets[i])
                    for r in rows:
                        lo, hi, at = r["lo"], r["hi"], r["at"]
                        owner.append(i)
                        out.append((r["key"], r["hull"], lo, hi, at, buffer[(b + lo) * size : (b + at) * size], buffer[(b + at + seed) * size : (b + hi + length) * size]))
                if out:
                    take = pa.array(owner, pa.int64())
                    types = [pa.int64()] * 5 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays(
                        [block.column("id").take(take), block.column("th").take(take), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                        ["id", "th", "key", "hull", "lo", "hi", "at", "left", "right"],
                    )

    kind = dict(docs.dtypes)["id"]
    # Identical rows of documents say the same.
    return texts.mapInArrow(run, f"id {kind}, th long, key long, hull long, lo long, hi long, at long, left binary, right binary").dropDuplicates(["id", "th", "lo"])


def narrowed(rows: DataFrame, width: int, length: int, seed: int, size: int = 1) -> DataFrame:
    """Rows split into runs of at most ``width`` windows; the symbols, of ``size`` bytes, that all windows of a run have join its key."""

    def run(batches):
        for batch in batches:
            out, owner = [], []
            names = ("key", "lo", "hi", "at", "left", "right")
            for i, (key, lo, hi, at, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                low, high = at - hi, at - lo  # windows by how far they reach to the left of the anchor
                for b in range(low // width, high // width + 1):
                    o1, o2 = max(low, b * width), min(high, b * width + width - 1)
                    # What all windows of block b have, also those that this row lacks: so equal windows get equal keys.
                    inner_left, inner_right = min(b * width * size, len(left)), max(0, length - seed - (b * width + width - 1)) * size
                    core = left[len(left) - inner_left :] + b"|" + right[:inner_right]
                    l, r = left[len(left) - o2 * size :] if o2 else b"", right[: (length - seed - o1) * size]
                    digest = lambda *x: int.from_bytes(hashlib.blake2b(b"|".join(x), digest_size=8).digest(), "little", signed=True)
                    owner.append(i)
                    out.append((digest(b"%d,%d" % (key, b), core), digest(b"%d,%d" % (o1, o2), l, b"", r), at - o2, at - o1, at, l, r))
            if out:
                take = pa.array(owner, pa.int64())
                types = [pa.int64()] * 5 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("th").take(take), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                    ["id", "th", "key", "hull", "lo", "hi", "at", "left", "right"],
                )

    return rows.select("id", "th", "key", "hull", "lo", "hi", "at", "left", "right").mapInArrow(run, rows.select("id", "th", "key", "hull", "lo", "hi", "at", "left", "right").schema)


def collection_order(strings: list[bytes], group: np.ndarray, size: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each string's rank within the collection, ordered by group and then by symbols, and for each rank the common
    prefix with the string before it (-1 at a group's first).

    One symbol of every string is inserted in each round.  A round refines the order by the new column; two neighbours
    that it tells apart have a common prefix of the columns before.
    """
    m = len(strings)
    lengths = [len(s) // size for s in strings]
    width = max(lengths, default=0)
    flat = np.frombuffer(b"".join(strings), np.uint8 if size == 1 else np.uint64)
    codes = (flat if size == 1 else np.unique(flat, return_inverse=True)[1]).astype(np.int64) + 1
    base = int(codes.max(initial=0)) + 1
    columns = np.zeros((width, m), np.int64)  # 0: ended
    at = 0
    for i, n in enumerate(lengths):
        columns[:n, i] = codes[at : at + n]
        at += n
    order = np.argsort(group, kind="stable")
    lcp = np.full(m, width, np.int64)
    tied = group[order]
    lcp[np.append(True, tied[1:] != tied[:-1])] = -1
    classes = np.cumsum(lcp == -1)
    live = np.arange(m)  # ranks whose order isn't settled yet
    for depth in range(width):
        alone = np.append(classes[1:] != classes[:-1], True) & np.append(True, classes[1:] != classes[:-1])
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        symbol = columns[depth, order[live]]
        moved = np.argsort(classes[live] * base + symbol, kind="stable")
        order[live] = order[live][moved]
        symbol = symbol[moved]
        told = np.zeros(len(live), bool)
        told[1:] = (classes[live][1:] == classes[live][:-1]) & (symbol[1:] != symbol[:-1])
        if told.any():
            lcp[live[told]] = depth
            starts = lcp < width
            starts[lcp == -1] = True
            classes = np.cumsum(starts)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    return rank, lcp


def repeated_windows(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], reach: int, size: int = 1) -> list[list[tuple[int, int]]]:
    """For each string pair the runs (o1, o2) of left reaches whose windows another member of its group has."""
    backwards = [s[::-1] if size == 1 else np.frombuffer(s, np.uint64)[::-1].tobytes() for s in left]
    rank_l, lcp_l = collection_order(backwards, group, size)
    rank_r, lcp_r = collection_order(right, group, size)
    m = len(group)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for o in range(int(low.min()), int(high.max()) + 1):
        inside = np.flatnonzero((low <= o) & (o <= high))
        if len(inside) < 2:
            continue
        a = np.cumsum(lcp_l < o)[rank_l[inside]] if o else np.cumsum(lcp_l == -1)[rank_l[inside]]
        r = reach - o
        b = np.cumsum(lcp_r < r)[rank_r[inside]] if r else np.cumsum(lcp_r == -1)[rank_r[inside]]
        both = a * (m + 1) + b
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        for i in inside[counts[inverse] > 1].tolist():
            own = runs[i]
            if own and own[-1][1] == o - 1:
                own[-1] = (own[-1][0], o)
            else:
                own.append((o, o))
    return runs


def resolved(rows: DataFrame, length: int, seed: int, size: int = 1) -> DataFrame:
    """``id, th, s, e``: removed spans of rows with ``left`` and ``right``, compared within their keys."""
    names = ("id", "th", "key", "lo", "hi", "at", "left", "right")

    def run(batches):
        kind, held = None, []

        def answer(part):
            group = np.array([r[2] for r in part])
            low, high = np.array([r[5] - r[4] for r in part]), np.array([r[5] - r[3] for r in part])
            out = []
            for r, runs in zip(part, repeated_windows(group, low, high, [r[6] for r in part], [r[7] for r in part], length - seed, size)):
                out += [(r[0], r[1], r[5] - o2, r[5] - o1 + length) for o1, o2 in runs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.int64(), pa.int64()))], ["id", "th", "s", "e"])

        for batch in batches:
            kind = batch.schema.field("id").type
            held += zip(*(batch.column(c).to_pylist() for c in names))
            while len(held) > BATCH:
                cut = max((i for i in range(1, BATCH + 1) if held[i][2] != held[i - 1][2]), default=0)
                cut = cut or next((i for i in range(BATCH, len(held)) if held[i][2] != held[i - 1][2]), 0)
                if not cut:
                    break
                yield from answer(held[:cut])
                held = held[cut:]
        if held:
            yield from answer(held)

    kind = dict(rows.dtypes)["id"]
    return rows.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, f"id {kind}, th long, s long, e long")


def repeated_spans(docs: DataFrame, length: int, seed: int, most: int, words: bool = False) -> DataFrame:
    """``id, th, s, e`` of windows' runs that recur; ``docs`` has ``id, th, text``.  Lengths and places count bytes, or ``words``."""
    size = 8 if words else 1
    spans = lambda rows: rows.select("id", "th", F.col("lo").alias("s"), (F.col("to") + length).alias("e"))
    repeated, open_ = settled(anchor_rows(docs, length, seed, words))
    found = spans(repeated)
    open_ = released(surroundings(docs, open_, length, seed, words))
    for width in WIDTHS:
        counts = open_.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > most)
        large = open_.join(counts.select("key"), "key")
        if large.isEmpty():
            break
        found = found.union(resolved(open_.join(counts, "key", "left_anti"), length, seed, size))
        parts = narrowed(large, width, length, seed, size).select("*", F.col("hi").alias("to"), F.lit(1).cast("long").alias("weight"))
        repeated, open_ = settled(released(parts))
        found = found.union(spans(repeated))
    return found.union(resolved(open_, length, seed, size))


def without_repeats(
    docs: DataFrame, *, length: int = 400, seed: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most: int = 6_000, as_text: bool = False,
    words: int = 0, words_seed: int = 16, passage_words: int = 0, passage_seed: int = 42,
) -> DataFrame:
    """Texts without the bytes of ``length``-byte strings that start anywhere else too.

    Returns ``keep`` (``id_col`` alone by default) and ``n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept`` (binary).  Strings are judged on the
    input; matches never cross documents; overlapping occurrences and occurrences in one document count.  No rows give none; a null
    text is empty; shorter texts are kept whole; repeated rows are repeats of one another.  ``most`` bounds the
    surroundings of one anchor that meet in one task.  With ``as_text``, ``kept`` is a string without the characters that a
    cut has split.  A kept column that has the name of another column gets ``in_`` in front of it.

    With ``words``, passages of that many words that start anywhere else too go as well, however few bytes they have: words are told
    apart by white space, A-Z are lower-cased, and white space counts for nothing, so a passage is found where its lines are broken
    otherwise.  What follows a passage up to the next word goes with it.

    With ``passage_words``, also ``n_passages``: many passages are shorter than ``length`` bytes, and this counts the row's
    strings of ``passage_seed`` words, chosen by content so that any ``passage_words`` words in sequence hold one, that other
    rows have too.  It removes nothing.
    """
    keep = keep or [id_col]
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    named = named.select("id", "th", "text")
    none = F.lit(None).cast("long")
    told = repeated_spans(named, length, seed, most).distinct().select("id", "th", "s", "e", F.lit(False).alias("w"), none.alias("k"))
    if words:
        told = released(told)  # what led to it can go before more comes
        told = told.union(repeated_spans(named, words, words_seed, most, words=True).distinct().select("id", "th", "s", "e", F.lit(True), none))
    if passage_words:
        told = told.union(shared_passages(named, passage_words, passage_seed).select("id", "th", none, none, F.lit(False), "n_passages"))
    listed = released(told.groupBy("id", "th").agg(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "e", "w"))).alias("_spans"), F.max("k").alias("_k")))
    listed = listed.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_spans", "_k")
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["n_bytes", "n_removed", "n_spans", "kept"] + (["n_passages"] if passage_words else [])
    names = kept_names(keep, {*added, "_text", "_own", "_spans", "_k", "_id", "_th"})
    whole = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], text.alias("_text"), F.col(id_col).alias("_own")).join(
        listed, F.col("_own").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_th")), "left"
    ).select(*names, "_text", "_spans", "_k")

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, "_text", BLOCK_BYTES):
                data, offsets = text_bytes(block.column("_text"))
                change = np.zeros(len(data) + 1, np.int32)
                starts, _, bounds = word_places(data, offsets) if words else (None, None, None)
                for i, own in enumerate(block.column("_spans").to_pylist()):
                    for s in own or ():
                        if s["w"]:
                            after = bounds[i] + s["e"]
                            change[starts[bounds[i] + s["s"]]] += 1
                            change[starts[after] if after < bounds[i + 1] else offsets[i + 1]] -= 1
                            continue
                        change[offsets[i] + s["s"]] += 1
                        change[offsets[i] + s["e"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                first = offsets[:-1][offsets[:-1] < offsets[1:]]
                opens[first] = gone[first]
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                columns = [pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(opens)), kept, pc.fill_null(block.column("_k"), 0)][: len(added)]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), *columns], [*names, *added])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[c]}" for c, n in zip(keep, names))
    more = ", n_passages long" if passage_words else ""
    return whole.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{more}")


#: Windows by their hash-free bytes; a byte goes if a window over it starts twice.
SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT r, doc_id, b, octet_length(b) AS n FROM texts),
starts AS (SELECT r, b, unnest(range(1, n - 398)) AS p FROM sized WHERE n >= 400),
windows AS (SELECT r, p, md5(b[p : p + 399]) AS w FROM starts),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM windows JOIN twice USING (w)),
runs AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
spans AS (SELECT r, k, min(p) AS s, max(p) + 399 AS e FROM runs GROUP BY r, k),
listed AS (SELECT r, sum(e - s + 1) AS n_removed, count(*) AS n_spans, list(e ORDER BY s) AS es, list(s ORDER BY s) AS ss FROM spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN ss IS NULL THEN sha256(b) ELSE sha256(from_hex(array_to_string(list_transform(range(0, len(ss) + 1),
    lambda i: hex(b[(CASE WHEN i = 0 THEN 1 ELSE es[i] + 1 END) : (CASE WHEN i = len(ss) THEN n ELSE ss[i + 1] - 1 END)])), ''))) END AS kept_sha256
FROM sized LEFT JOIN listed USING (r)
"""


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Sizes and checksums of texts without strings of 400 bytes that recur, and shared passages of over 50 words, over the
    whole table; see ``without_repeats``."""
    from .common import table

    return without_repeats(table(spark, sf_dir, "documents"), passage_words=51).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages"
    )
