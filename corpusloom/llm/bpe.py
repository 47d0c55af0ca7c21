"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation finds, without a regular expression, the same slices that the split pattern of byte-level BPE
vocabularies would: contractions, ` ?letters`, ` ?numbers`, ` ?others`, and white space that leaves its last
character to what follows.  Each code point is looked up in an array of character classes.  Whether an
apostrophe starts a contraction depends on what the text before it is part of, so a five-state automaton runs over
the classes: every position carries a transition function, functions compose associatively, and a blocked prefix
scan over the (small, closed) set of composed functions gives the state at every position.  Boundaries then follow
from the states and classes of neighbouring positions.

A slice's ids come from a cache; only slices that were not seen lately are merged pair by pair.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, row_blocks, text_bytes

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)  # BLANK is U+0020, SPACE other white space
#: Code points with the property White_Space, U+0020 aside; fixed values.
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK_BYTES = 1 << 20
CACHED_SLICES = 300_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    out[0x20] = BLANK
    return out


# ---- the automaton ----------------------------------------------------------------------------------
# States: free; in a run of others; two, one more characters of a contraction; just after a contraction.
FREE, RUN, TWO, ONE, AFTER = range(5)
#: symbol -> next state from each of FREE, RUN, TWO, ONE, AFTER
PLAIN, RUNNING, SHORT, LONG = range(4)
STEP = {
    PLAIN: (FREE, FREE, ONE, AFTER, FREE),
    RUNNING: (RUN, RUN, ONE, AFTER, RUN),
    SHORT: (ONE, RUN, ONE, AFTER, ONE),  # an apostrophe that one letter could complete
    LONG: (TWO, RUN, ONE, AFTER, TWO),  # ... two letters
}


@lru_cache(1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closure of the transition functions: ids of symbols (and of symbols at a text's start), a composition
    table, and the functions' values."""
    known: dict[tuple, int] = {}

    def number(f):
        return known.setdefault(f, len(known))

    number((0, 1, 2, 3, 4))  # identity, for padding
    symbols = [number(STEP[s]) for s in range(4)] + [number((STEP[s][FREE],) * 5) for s in range(4)]
    done: dict[tuple[int, int], int] = {}
    while True:
        fs = list(known)
        todo = [(a, b) for a in range(len(fs)) for b in range(len(fs)) if (a, b) not in done]
        if not todo:
            break
        for a, b in todo:
            done[a, b] = number(tuple(fs[b][s] for s in fs[a]))
    m = len(known)
    compose = np.zeros((m, m), np.uint8)
    for (a, b), c in done.items():
        compose[a, b] = c
    return np.array(symbols, np.uint8), compose, np.array(list(known), np.uint8)


def scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix composition of function ids."""
    _, compose, _ = functions()
    m, flat = np.uint16(len(compose)), compose.ravel()
    n = len(f)
    if n <= width:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.uint16) * m + grid[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1], width)[:-1]
    grid = flat[before.astype(np.uint16)[None, :] * m + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def code_points(data: np.ndarray) -> np.ndarray:
    if len(data) == 0 or data.max() < 0x80:
        return data.astype(np.uint32)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which slices start, and for each text the index of its first slice (n + 1 values)."""
    points = code_points(data)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if n == len(data):
        at_byte = np.arange(n + 1, dtype=np.int64)
        text_at = offsets
    else:
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at_byte = np.concatenate(([0], np.cumsum(wide)))
        text_at = np.searchsorted(at_byte, offsets)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_at] = True  # also the end
    last = first[1:]
    first = first[:-1]

    symbol = (kind == OTHER).view(np.uint8) * np.uint8(RUNNING)
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[-1] = SPACE
    after[last] = SPACE  # for white space, the end of a text counts as more of it
    symbol[(kind == BLANK) & (after == OTHER)] = RUNNING
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.concatenate((points, [0, 0]))
        inside = np.concatenate((last, [True, True]))
        one, two = padded[quotes + 1], padded[quotes + 2]
        near = ~inside[quotes]
        far = near & ~inside[quotes + 1]
        symbol[quotes[near & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = one.astype(np.int64) * 256 + np.minimum(two, 255)
        symbol[quotes[far & np.isin(pairs, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    ids, _, values = functions()
    state = np.ascontiguousarray(values[:, FREE])[scan(ids[symbol + 4 * first])]

    white = kind >= BLANK
    cut = np.ones(n, bool)
    was, now = kind[:-1], kind[1:]
    both = white[:-1] & white[1:]
    leaves = after[1:] < BLANK
    same = (was == now) | (was == BLANK)
    cut[1:] = np.where(white[1:], np.where(both, leaves, True), ~same)
    before = state[:-1]
    cut[1:] &= ~((before == TWO) | (before == ONE))
    cut[1:] |= before == AFTER
    cut |= first
    starts = np.flatnonzero(cut)
    return at_byte[starts], np.searchsorted(starts, text_at)


# ---- merging ----------------------------------------------------------------------------------------


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is joined, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], 1 << 40) for i in range(n - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 40:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return [ranks[p] for p in parts]
    # Long slices: a linked list of parts and a heap of pairs.
    end = list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i):
        j = right[i]
        if j >= 0 and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue
        alive[j] = False
        end[i], right[i] = stop, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i >= 0:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


@lru_cache(2)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Ascending keys left * 2**32 + right of the pairs that have a rank, their ranks, the ids of single bytes, and what each
    rank's pair becomes (none where that is the rank itself)."""
    ranks = load_ranks(path)
    found = {}
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            if (a := ranks.get(word[:cut])) is not None and (b := ranks.get(word[cut:])) is not None:
                found[a << 32 | b] = rank
    keys = np.array(sorted(found), np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], np.int64), np.array([ranks[bytes([b])] for b in range(256)], np.int64), None


NO_RANK = (1 << 31) - 1


def merge_many(pieces: list[bytes], table) -> list[bytes]:
    """Packed ids of slices of at most 64 bytes by a ``pair_table``; all are merged side by side, one pair of each a round."""
    keys, values, single, becomes = table
    m, width = len(pieces), max(map(len, pieces))
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    ids = np.zeros((m, width + 2), np.int32)
    ids[:, :width] = single[flat]
    columns = np.arange(width + 2)

    def rank(a, b):
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], NO_RANK).astype(np.int32)

    letters, which = np.unique(flat[:, :-1].astype(np.uint16) << 8 | flat[:, 1:], return_inverse=True)  # few pairs of bytes differ
    pairs = np.full((m, width + 1), NO_RANK, np.int32)
    pairs[:, : width - 1] = rank(single[letters >> 8], single[letters & 255])[which].reshape(m, width - 1)
    pairs[columns[None, :-1] >= sizes[:, None] - 1] = NO_RANK
    out: list[bytes] = [b""] * m
    rows = np.arange(m)
    while len(rows):
        at = pairs.argmin(axis=1)
        line = np.arange(len(rows))
        low = pairs[line, at]
        done = low == NO_RANK
        if done.any():
            for r, n, x in zip(rows[done].tolist(), sizes[done].tolist(), ids[done].astype("<u4")):
                out[r] = x[:n].tobytes()
            go = ~done
            rows, ids, pairs, sizes, at, low = rows[go], ids[go], pairs[go], sizes[go], at[go], low[go]
            line = np.arange(len(rows))
            if not len(rows):
                break
        moved = columns[None, :-1] > at[:, None]
        np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=moved)
        ids[line, at] = low if becomes is None else becomes[low]
        np.copyto(pairs[:, :-1], pairs[:, 1:].copy(), where=moved[:, :-1])
        sizes = sizes - 1
        for near in (at - 1, at):
            ok = (near >= 0) & (near < sizes - 1)
            near = np.maximum(near, 0)
            new = np.where(ok, rank(ids[line, near], ids[line, near + 1]), NO_RANK)
            pairs[line, near] = np.where(ok | (near == at), new, pairs[line, near])
    return out


def merge_by_length(pieces: list[bytes], table, most: int = 4_000) -> list[bytes]:
    """``merge_many`` of slices of about one length at a time."""
    out: list[bytes] = [b""] * len(pieces)
    order = np.argsort(np.fromiter(map(len, pieces), np.int64, len(pieces)), kind="stable").tolist()
    for k in range(0, len(order), most):
        part = order[k : k + most]
        for i, ids in zip(part, merge_many([pieces[i] for i in part], table)):
            out[i] = ids
    return out


class SliceCache(dict):
    """A slice's 64-bit hash -> its ids as packed little-endian 32-bit numbers; bounded.  Slices of more than 64 bytes
    are merged each time, as they would only fill the memory."""

    def __init__(self, path: str):
        self.path, self.ranks = path, load_ranks(path)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > 64:
                out[i] = np.array(merge(piece, self.ranks), "<u4").tobytes()
            else:
                todo.append(i)
        for i, ids in zip(todo, merge_by_length([pieces[i] for i in todo], pair_table(self.path))):
            out[i] = ids
        return out

    def of(self, buffer: bytes, hashes: list[int], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        ids = list(map(self.get, hashes))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            if len(self) + len(missing) > CACHED_SLICES:
                self.clear()
            pieces = [buffer[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
            for i, piece, found in zip(missing, pieces, self.merged(pieces)):
                ids[i] = found
                if len(piece) <= 64:
                    self[hashes[i]] = found
        return ids


@lru_cache(2)
def slice_cache(path: str) -> SliceCache:
    return SliceCache(path)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of spans of one buffer, from prefix sums."""
    power = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[0][: len(data)])))
    return (sums[ends] - sums[starts]) * power[1][starts]


_USED = 0


def _fresh(n: int) -> np.ndarray:
    global _USED
    _USED += n
    return np.arange(_USED - n, _USED, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse; kept for blocks of the usual size."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        base = 0x9E3779B97F4A7C15
        grown = [np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))).cumprod() for b in (base, pow(base, -1, 1 << 64))]
        if n > 4 * BLOCK_BYTES:
            return grown[0], grown[1]
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def encode_block(data: np.ndarray, offsets: np.ndarray, cache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's texts, the n + 1 bounds of each text's ids, the byte starts of all slices, and the n + 1
    bounds of each text's slices.  Equal slices of up to 64 bytes are found by a 64-bit hash and looked up once."""
    starts, first = slices(data, offsets)
    if not len(starts):
        return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64), starts, first
    ends = np.append(starts[1:], len(data))
    lengths = ends - starts
    hashes = span_hashes(data, starts, ends) ^ (lengths.astype(np.uint64) << np.uint64(57))
    long = np.flatnonzero(lengths > 64)
    hashes[long] = np.uint64(1 << 63) + _fresh(len(long))  # each stands for itself
    which, distinct = pd.factorize(hashes)
    chosen = np.empty(len(distinct), np.int64)
    chosen[which[::-1]] = np.arange(len(starts))[::-1]
    ids = cache.of(data.tobytes(), distinct.tolist(), starts[chosen], ends[chosen])
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    flat = np.frombuffer(b"".join(ids), "<u4")
    counts = sizes[which]
    begins = (np.cumsum(sizes) - sizes)[which]
    bounds = np.concatenate(([0], np.cumsum(counts)))[first]
    return flat[ranges(begins, counts)], bounds, starts, first


def packed(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    at = bounds.tolist()
    return [values[a:b].tobytes() for a, b in zip(at, at[1:])]


def bpe_encode(df: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_offsets: bool = False, round_trip: bool = False) -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian 32-bit) and, if asked for, ``slice_starts`` (binary, likewise: the byte
    at which each pre-token starts) and ``decoded`` (binary: what the ids spell, decoded in the same pass).  A null or
    empty text has no ids.  ``ranks_path`` must exist on the executors."""
    fields = f"{id_col} {dict(df.dtypes)[id_col]}, ids binary" + ", slice_starts binary" * keep_offsets + ", decoded binary" * round_trip

    def run(batches):
        cache = slice_cache(ranks_path)
        for batch in batches:
            for block in row_blocks(batch, text_col, BLOCK_BYTES):
                data, offsets = text_bytes(block.column(text_col))
                ids, bounds, starts, first = encode_block(data, offsets, cache)
                columns = [block.column(id_col), pa.array(packed(ids, bounds), pa.binary())]
                if keep_offsets:
                    begins = (starts - np.repeat(offsets[:-1], np.diff(first))).astype("<u4")
                    columns.append(pa.array(packed(begins, first), pa.binary()))
                if round_trip:
                    columns.append(pa.array([decode_ids(ids[a:b], ranks_path) for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids"] + ["slice_starts"] * keep_offsets + ["decoded"] * round_trip)

    return df.select(id_col, text_col).mapInArrow(run, fields)


@lru_cache(2)
def spellings(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    words = [b""] * size
    for word, i in ranks.items():
        words[i] = word
    lengths = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, starts, lengths = spellings(path)
    return flat[ranges(starts[ids], lengths[ids])].tobytes()


def bpe_decode(df: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids_col`` and ``decoded`` (binary): the bytes that the ids spell.  Null ids give a null."""
    fields = f"{id_col} {dict(df.dtypes)[id_col]}, {ids_col} binary, decoded binary"

    def run(batches):
        for batch in batches:
            for block in row_blocks(batch, ids_col, BLOCK_BYTES):
                out = [None if (x := v.as_py()) is None else decode_ids(np.frombuffer(x, "<u4"), ranks_path) for v in block.column(ids_col)]
                yield pa.RecordBatch.from_arrays([block.column(id_col), block.column(ids_col), pa.array(out, pa.binary())], [id_col, ids_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, fields)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe_encode(table(spark, sf_dir, "documents"), path, round_trip=True)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
