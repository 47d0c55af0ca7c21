"""Packing token sequences by minimum bin slack.

Documents are tokenised and cut into pieces of at most a window.  What is left to decide is how to combine the short
pieces, and for that only their lengths matter: the driver plans on the histogram of lengths (at most one entry per
possible length, however many documents there are).  Each window starts with the longest length that is left; a
bitset subset-sum over the other lengths and their counts then finds the multiset that fills the window closest to
its capacity, and backtracking through the bitsets gives the counts.  A filling is repeated as often as the counts
allow, so the plan is a short list of (lengths, repetitions).  The cluster numbers the pieces of each length, and a
piece's number says which window and which place in it are its own.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, SliceCache, encode_block, merge_by_length
from .common import checkpointed, row_blocks, text_bytes


@lru_cache(1)
def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def merge_table(path: str):
    """What ``pair_table`` gives, from the file of a byte-level BPE whose words arise by merges alone; none for others."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    # Bytes that are no visible characters of Latin-1 are written as the characters from U+0100 on.
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spelled = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*seen}))}
    ids, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = {ids[a] << 32 | ids[b]: i for i, (a, b) in enumerate(pairs)}
    if not all(c in ids for c in spelled.values()):
        return None
    keys = np.array(sorted(ranks), np.int64)
    return keys, np.array([ranks[k] for k in keys.tolist()], np.int64), np.array([ids[spelled[b]] for b in range(256)], np.int64), np.array([ids[a + b] for a, b in pairs], np.int64)


class LibraryCache(SliceCache):
    """Ids as the tokenizers library gives them, each distinct slice once.  Slices of at most 64 bytes are merged side by side by the
    file's merges; longer ones, and all where the file allows for more than merges, go to the library."""

    def __init__(self, path: str):
        self.tokenizer, self.table = load_tokenizer(path), merge_table(path)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        if self.table is None or not len(self.table[0]):
            return self.by_library(pieces)
        short = [p for p in pieces if len(p) <= 64]
        found = iter(merge_by_length(short, self.table))
        long = iter(self.by_library([p for p in pieces if len(p) > 64]) if len(short) < len(pieces) else ())
        return [next(found) if len(p) <= 64 else next(long) for p in pieces]

    def by_library(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]


@lru_cache(1)
def library_cache(path: str) -> LibraryCache:
    return LibraryCache(path)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Documents as token ids, ended by ``end_id`` and cut into pieces of at most ``window`` ids.

    Returns ``id_col, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (binary, little-endian 32-bit).
    A null or empty text is the end id alone.  The tokenizer must be a byte-level BPE with the usual split pattern;
    texts that contain one of its added tokens go to the library whole.
    """
    fields = f"{id_col} {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def run(batches):
        tokenizer = load_tokenizer(tokenizer_path)
        cache = library_cache(tokenizer_path)
        added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for block in row_blocks(batch, text_col, BLOCK_BYTES):
                data, offsets = text_bytes(block.column(text_col))
                ids, bounds, _, _ = encode_block(data, offsets, cache)
                buffer = data.tobytes()
                special = any(a in buffer for a in added)
                rows, out = [], []
                for i in range(block.num_rows):
                    own = ids[bounds[i] : bounds[i + 1]].tobytes() + end
                    if special and any(a in (text := buffer[offsets[i] : offsets[i + 1]]) for a in added):
                        own = np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes() + end
                    total = len(own) // 4
                    for start in range(0, total, window):
                        piece = own[4 * start : 4 * (start + window)]
                        rows.append(i)
                        out.append((start, len(piece) // 4, zlib.crc32(piece), total))
                        if keep_ids:
                            out[-1] += (piece,)
                columns = [block.column(id_col).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, fields)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the sum closest to ``room`` without passing it."""
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left:
            share = min(share, left)
            steps.append((length, share, reached))
            reached |= (reached << (length * share)) & mask
            left -= share
            share *= 2
        if reached >> room & 1:
            break
    at = reached.bit_length() - 1
    used: dict[int, int] = {}
    for length, share, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + share
            at -= length * share
    return used


def plan(histogram: dict[int, int], window: int) -> list[tuple[list[int], int]]:
    """(lengths in one window, number of such windows), covering the histogram exactly."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill({k: v for k, v in counts.items() if v}, window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append(([k for k in sorted(used, reverse=True) for _ in range(used[k])], times))
    return out


def pack(pieces: DataFrame, *, window: int = 2048, id_col: str = "doc_id", rows_per_salt: int = 200_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece lies in one sequence of at most ``window`` tokens, a
    sequence's pieces are adjacent from 0, and the sequences are numbered from 0.

    ``pieces`` needs ``id_col, start, length`` with 1 <= length <= window and should be stored, as it is read twice; it
    may be empty.  Pieces that agree in all three are interchangeable.
    """
    spark = pieces.sparkSession
    salts = max(16, -(-pieces.count() // rows_per_salt))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), "start"), F.lit(salts)).cast("int"))
    counted = checkpointed(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}

    places: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan(histogram, window):
        offset = 0
        for length in lengths:
            places.setdefault(length, []).append((given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + times
            offset += length
        sequence += times
    rows = [(k, [p[0] for p in v], [p[1] for p in v], [p[2] for p in v]) for k, v in places.items()]
    placed = spark.createDataFrame(rows, "length long, _from array<bigint>, _sequence array<bigint>, _offset array<bigint>")

    before = Window.partitionBy("length").orderBy("_salt")
    prefix = counted.select("length", "_salt", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "start")) - 1
    ).join(prefix, ["length", "_salt"])
    # One row for each possible length: a bounded side.
    joined = ranked.join(F.broadcast(placed), "length").withColumn("_rank", F.col("_rank") + F.col("_before"))
    steps = F.array(*[F.lit(1 << b) for b in range(24, -1, -1)])
    at = F.aggregate(
        steps, F.lit(0),
        lambda a, s: F.when((a + s <= F.size("_from")) & (F.try_element_at("_from", a + s) <= F.col("_rank")), a + s).otherwise(a),
    )
    return joined.withColumn("_at", at).select(
        *[F.col(c) for c in pieces.columns],
        (F.element_at("_sequence", F.col("_at")) + F.col("_rank") - F.element_at("_from", F.col("_at"))).alias("sequence_id"),
        F.element_at("_offset", F.col("_at")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (binary) of packed pieces that kept their ids; at most a window's ids in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def packed_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    pieces = checkpointed(token_pieces(docs, tokenizer_path))
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
