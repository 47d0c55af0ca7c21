"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays, one modulo 2**64 and one modulo the prime 2**31 - 1, give the
hash of any span by one subtraction and one multiplication, so two spans compare in constant time and the longest
common extension of two positions is found by binary search (``SpanIndex``).

The fingerprint keeps the prefix array at a few content-defined positions: code-point windows whose hash ends in
enough zero bits are anchors, and the number of bits is the smallest (``FIRST_BITS`` at least, none at least in short texts) that
leaves at most ``MOST`` anchors.  As anchors
depend on their window alone, an edit moves only the anchors near it, and as the hashes compose, a fingerprint can be
coarsened to another's number of bits.  Stretches that have hardly an anchor, as in texts that repeat themselves, are cut at equal steps from
where they start (a power of two that gives at most ``MOST`` in the whole text), so that what they share from there on still aligns.  ``likeness`` aligns two fingerprints by longest common extensions over
these prefix arrays and returns the share of characters in common runs, from 0 to 1.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below_count, long_list, ranges

PRIME = (1 << 31) - 1
BASE = 1_000_003
WORD_BASE = 0x9E3779B97F4A7C15
WINDOW = 8
MOST = 48
FIRST_BITS = 3
LAST_BITS = 24
TINY = 3 * WINDOW
#: Levels of cuts at equal steps, from here on by how often two divides the step's number; stretches of more than so many steps are cut.
STEPS, LONG = 25, 8
BLOCK_CHARS = 1 << 20


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


@lru_cache(1)
def power_tables(size: int) -> tuple[np.ndarray, ...]:
    """Powers of the bases and of their inverses: word base, its inverse, prime base, its inverse."""
    word = [np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))).cumprod() for b in (WORD_BASE, pow(WORD_BASE, -1, 1 << 64))]
    prime = []
    for b in (BASE, pow(BASE, -1, PRIME)):
        out = np.ones(1, np.uint64)
        step = b
        while len(out) <= size:  # doubling
            out = np.concatenate((out, reduced(out * np.uint64(step))))
            step = step * step % PRIME
        prime.append(out[: size + 1])
    return (*word, *prime)


def tables_for(n: int) -> tuple[np.ndarray, ...]:
    return power_tables(BLOCK_CHARS * 2 if n <= BLOCK_CHARS * 2 else 1 << n.bit_length())


class SpanIndex:
    """Prefix arrays over code points."""

    def __init__(self, points: np.ndarray):
        x = points.astype(np.uint64) + np.uint64(1)
        n = len(x)
        self.word, self.unword, self.prime, self.unprime = tables_for(n)
        zero = np.zeros(1, np.uint64)
        self.words = np.concatenate((zero, np.cumsum(x * self.word[:n])))
        self.primes = np.concatenate((zero, np.cumsum(reduced(x * self.prime[:n]))))

    def word_hash(self, start, end):
        return (self.words[end] - self.words[start]) * self.unword[start]

    def prime_hash(self, start, end):
        return reduced(reduced(self.primes[end] - self.primes[start]) * self.unprime[start])

    def equal(self, a: int, b: int, length: int) -> bool:
        """Whether the spans of ``length`` from ``a`` and ``b`` are equal."""
        a, b = np.array([a]), np.array([b])
        return bool(self.word_hash(a, a + length) == self.word_hash(b, b + length) and self.prime_hash(a, a + length) == self.prime_hash(b, b + length))

    def extension(self, a: int, b: int) -> int:
        """Length of the longest common extension to the right of positions ``a`` and ``b``."""
        low, high = 0, len(self.words) - 1 - max(a, b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, b, mid) else (low, mid - 1)
        return low


def fingerprints(texts: list[str]) -> list[str]:
    """One fingerprint for each text: ``length.bits.hash.base64(chunks)``; a chunk is 8 bytes, its length and its
    anchor's zero bits in the first four, its prime hash in the others.  Equal texts have equal fingerprints."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    index = SpanIndex(points)
    n = len(points)
    at = np.arange(max(0, n - WINDOW + 1))
    value = (index.words[WINDOW:] - index.words[: n - WINDOW + 1]) * index.unword[: len(at)] if len(at) else np.zeros(0, np.uint64)
    value = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - LAST_BITS)
    short, tiny = sizes < MOST << FIRST_BITS, sizes < TINY
    at = np.flatnonzero(((value & np.uint64((1 << FIRST_BITS) - 1)) == 0) | np.repeat(short, sizes)[: len(value)])
    own = np.searchsorted(ends, at, side="right")
    inside = (at + WINDOW <= ends[own]) & (at > starts[own]) & ~tiny[own]
    at, own = at[inside], own[inside]
    low = value[at]
    low = low & (~low + np.uint64(1))
    bits = np.where(low == 0, LAST_BITS, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))
    held = np.bincount(own * (LAST_BITS + 1) + bits, minlength=len(texts) * (LAST_BITS + 1)).reshape(len(texts), LAST_BITS + 1)
    more = held[:, ::-1].cumsum(axis=1)[:, ::-1]
    need = np.concatenate((more <= MOST, np.ones((len(texts), 1), bool)), axis=1).argmax(axis=1)
    need = np.where(short, need, np.maximum(need, FIRST_BITS))
    keep = bits >= need[own]
    each = np.flatnonzero(np.repeat(tiny, sizes))  # no window fits well: every character is a chunk
    whole = np.searchsorted(ends, each, side="right")
    each, whole = each[each > starts[whole]], whole[each > starts[whole]]
    at, own, bits = np.concatenate((at[keep], each)), np.concatenate((own[keep], whole)), np.concatenate((bits[keep], np.zeros(len(each), np.int64)))

    cuts = np.concatenate((starts, at))
    whose = np.concatenate((np.arange(len(texts)), own))
    level = np.concatenate((np.full(len(texts), 31), bits)).astype(np.uint64)
    cuts, whose, level, stops = in_order(cuts, whose, level, ends)
    step = (1 << step_bits(sizes))[whose]
    more_cuts = np.where(stops - cuts > LONG * step, (stops - cuts - 1) // step, 0)
    if more_cuts.any():
        of, number = np.repeat(np.arange(len(cuts)), more_cuts), ranges(np.ones(len(cuts), np.int64), more_cuts)
        twos = np.log2((number & -number).astype(np.float64)).astype(np.uint64)
        added = np.uint64(STEPS) + np.minimum(twos, np.uint64(30 - STEPS))
        cuts, whose, level, stops = in_order(np.concatenate((cuts, cuts[of] + number * step[of])), np.concatenate((whose, whose[of])), np.concatenate((level, added)), ends)
    chunks = np.empty((len(cuts), 2), "<u4")
    chunks[:, 0] = ((stops - cuts).astype(np.uint64) | level << np.uint64(27)) & np.uint64(0xFFFFFFFF)
    chunks[:, 1] = index.prime_hash(cuts, stops)
    bounds = np.searchsorted(whose, np.arange(len(texts) + 1)).tolist()
    whole = index.word_hash(starts, ends)
    return [
        f"{size}.{b}.{h:016x}." + base64.b64encode(chunks[i:j].tobytes()).decode()
        for size, b, h, i, j in zip(sizes.tolist(), need.tolist(), whole.tolist(), bounds, bounds[1:])
    ]


def in_order(cuts, whose, level, ends):
    """Cuts by text and place, and where the chunk of each ends."""
    order = np.lexsort((cuts, whose))
    cuts, whose, level = cuts[order], whose[order], level[order]
    last = np.append(whose[1:] != whose[:-1], True) if len(whose) else np.zeros(0, bool)
    return cuts, whose, level, np.where(last, ends[whose], np.append(cuts[1:], 0)[: len(cuts)])


def step_bits(sizes):
    """Of each size the least power of two whose multiples cut it into at most ``MOST``."""
    return np.ceil(np.log2(np.maximum(np.asarray(sizes, np.float64) / MOST, 1))).astype(np.int64)


def coarsened(chunks: np.ndarray, bits: int, twos: int = 0) -> tuple[list[int], list[int]]:
    """Lengths and hashes of chunks, those whose anchors have fewer zero bits, and those at steps that a ``twos`` times larger power doesn't
    divide, joined to what precedes them."""
    level, size, value = chunks[:, 0] >> 27, (chunks[:, 0] & 0x7FFFFFF).astype(np.int64), chunks[:, 1].astype(np.int64)
    kept = np.where(level < STEPS, level >= bits, level >= min(STEPS + twos, 31))
    if kept.all():
        return size.tolist(), value.tolist()
    sizes: list[int] = []
    values: list[int] = []
    for b, n, h in zip(kept.tolist(), size.tolist(), value.tolist()):
        if b or not sizes:
            sizes.append(n)
            values.append(h)
        else:
            values[-1] = (values[-1] + h * pow(BASE, sizes[-1], PRIME)) % PRIME
            sizes[-1] += n
    return sizes, values


def likeness(a: str, b: str) -> float:
    """Twice the characters in aligned common runs over the characters of both; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    n, bits_a, _, x = a.split(".")
    m, bits_b, _, y = b.split(".")
    if n == "0" or m == "0":
        return 0.0
    x, y = (np.frombuffer(base64.b64decode(v), "<u4").reshape(-1, 2) for v in (x, y))
    bits = max(int(bits_a), int(bits_b))
    twos_a, twos_b = step_bits([int(n), int(m)]).tolist()
    (size_a, hash_a), (size_b, hash_b) = coarsened(x, bits, max(0, twos_b - twos_a)), coarsened(y, bits, max(0, twos_a - twos_b))
    chunks_a, chunks_b = list(zip(size_a, hash_a)), list(zip(size_b, hash_b))
    where: dict[tuple[int, int], list[int]] = {}
    for j, c in enumerate(chunks_b):
        where.setdefault(c, []).append(j)
    if not any(c in where for c in chunks_a):
        return 0.0
    # Prefix arrays at the chunk bounds: any run of chunks is compared at once.
    prefix_a, prefix_b = prefixes(size_a, hash_a), prefixes(size_b, hash_b)
    i = j = common = 0
    while i < len(chunks_a) and j < len(chunks_b):
        start = next((k for k in where.get(chunks_a[i], ()) if k >= j), None)
        if start is None:
            i += 1
            continue
        run = extension(prefix_a, prefix_b, i, start)
        common += prefix_a[i + run][0] - prefix_a[i][0]
        i, j = i + run, start + run
    return min(1.0, 2.0 * common / (int(n) + int(m)))


def prefixes(sizes: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """Position, hash of the prefix, and power of the base at that position."""
    out = [(0, 0, 1)]
    for n, h in zip(sizes, values):
        at, sum_, power = out[-1]
        out.append((at + n, (sum_ + h * power) % PRIME, power * pow(BASE, n, PRIME) % PRIME))
    return out


def extension(a: list, b: list, i: int, j: int) -> int:
    """How many chunks from ``i`` and ``j`` on agree: a binary search over prefix hashes."""
    low, high = 0, min(len(a) - i, len(b) - j) - 1
    while low < high:
        k = (low + high + 1) // 2
        same = a[i + k][0] - a[i][0] == b[j + k][0] - b[j][0] and (a[i + k][1] - a[i][1]) * b[j][2] % PRIME == (b[j + k][1] - b[j][1]) * a[i][2] % PRIME
        low, high = (k, high) if same else (low, k - 1)
    return low


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, fingerprint``; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for lo, hi in char_blocks(texts):
                part = texts[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(lo, hi - lo), pa.array(map(len, part), pa.int64()), pa.array(fingerprints(part))],
                    [id_col, "n_chars", "fingerprint"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_chars long, fingerprint string")


def char_blocks(texts: list[str], most: int = BLOCK_CHARS):
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def with_successors(docs: DataFrame, n_ranges: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ranges of ascending id, each range followed by the first rows of the next (``_guest``), so that
    every row meets its successor in one pass; after the last comes the first.  The texts are shuffled once.

    Null ids come first; rows of one id are ordered by text.  The driver holds one id for each range.
    """
    probabilities = [i / n_ranges for i in range(1, n_ranges)]
    splitters = []
    if probabilities:
        found = docs.agg(F.percentile_approx(id_col, probabilities, max(10_000, 20 * n_ranges)).alias("p")).first()["p"] or []
        splitters = sorted(set(found))
    ranged = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), below_count(splitters, F.col(id_col)).alias("_range"))
    lowest = ranged.groupBy("_range").agg(F.min(id_col).alias("low"), F.count_if(F.col(id_col).isNull()).alias("nulls")).collect()
    held = sorted(r["_range"] for r in lowest)
    before = {r: held[i - 1] for i, r in enumerate(held)}
    lows = {r["_range"]: None if r["nulls"] else r["low"] for r in lowest}
    size = len(splitters) + 1
    at = F.col("_range") + 1
    low_ids = F.split(F.lit(",".join(str(lows[r]) if lows.get(r) is not None else "" for r in range(size))), ",")
    is_first = F.nullif(F.element_at(low_ids, at), F.lit("")).eqNullSafe(F.col(id_col).cast("string"))
    own = F.struct(F.col("_range").cast("int").alias("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.element_at(long_list(before.get(r, 0) for r in range(size)), at).cast("int").alias("_range"), F.lit(True).alias("_guest"))
    dealt = ranged.select(id_col, text_col, F.inline(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    return dealt.repartitionById(size, F.col("_range")).sortWithinPartitions("_range", "_guest", id_col, text_col)


def edited_fingerprints(docs: DataFrame, n_ranges: int | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how like they and the next text's are.

    The edited text has its last ``n_chars // 4`` code points replaced by as many first ones (or all) of the next text
    by ascending id, after the last by the first's; no rows give none.  Returns ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  A null text is empty; a single row is its own successor.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held: list[tuple] = []

        def rows(ready: list[tuple]):
            """All but the last of ``ready``, each with what follows it."""
            texts = [t for *_, t in ready]
            for lo, hi in char_blocks(texts[:-1]):
                prints = fingerprints(texts[lo : hi + 1])
                todo = [i for i in range(lo, hi) if not ready[i][1]]
                edited = [t[: len(t) - (q := len(t) // 4)] + texts[i + 1][:q] for i in todo for t in [texts[i]]]
                changed = []
                for a, b in char_blocks(edited):
                    changed += fingerprints(edited[a:b])
                out = [
                    (ready[i][2], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), prints[i - lo], c, likeness(prints[i - lo], c), likeness(prints[i - lo], prints[i + 1 - lo]))
                    for i, e, c in zip(todo, edited, changed)
                ]
                if out:
                    types = [pa_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            pa_type = batch.schema.field(id_col).type
            held += zip(*(batch.column(c).to_pylist() for c in ("_range", "_guest", id_col, text_col)))
            yield from rows(held)
            held = held[-1:]
        # What is left is the guest that ended the last range.

    return with_successors(docs, n_ranges, id_col=id_col, text_col=text_col).mapInArrow(
        run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts, and how alike they are."""
    from .common import table

    return edited_fingerprints(table(spark, sf_dir, "documents"))
