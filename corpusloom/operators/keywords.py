"""Many keywords in one pass: an Aho-Corasick automaton over all of them, and places in the raw text.

Keywords of a checked size are sent to the tasks; more than ``most_bytes`` are taken in blocks, each with a pass of its own.
Texts are never shuffled.  Where a text is searched in lower or standard form, each character of the form knows the
characters that it stands for, so places are exact and not scaled.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _STANDARD_STRIP, STANDARD_PREFIXES, snippet

_GLUED = re.compile(rf"(?:{'|'.join(STANDARD_PREFIXES)})\d", re.IGNORECASE)
_STRIPPED = re.compile(_STANDARD_STRIP.pattern.rstrip("+"))


def lowered(text: str) -> tuple[str, np.ndarray]:
    """The text in lower case, and for each of its characters, and the end, the raw text's character it comes from."""
    low = text.lower()
    if len(low) == len(text):
        return low, np.arange(len(text) + 1)
    return low, np.append(np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]), len(text))


@lru_cache(maxsize=1)
def joining() -> frozenset:
    """Characters that NFKC may join to the one before: second ones of canonical pairs, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | {chr(c) for c in range(0x1160, 0x1200)}


@lru_cache(maxsize=100_000)
def starts_anew(c: str) -> bool:
    first = unicodedata.normalize("NFKD", c)[:1]
    return not first or (unicodedata.combining(first) == 0 and first not in joining())


@lru_cache(maxsize=100_000)
def form_of(piece: str) -> str:
    """NFKC, case folding, without white space, dashes, dots and slashes."""
    return _STRIPPED.sub("", unicodedata.normalize("NFKC", piece).casefold())


def standardized(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The standard form, and for each of its characters the start and the end of the piece of raw text that it comes from."""
    if text.isascii() or all(map(starts_anew, set(text))):
        pieces, starts = text, np.arange(len(text))
    else:
        starts = np.array([i for i, c in enumerate(text) if i == 0 or starts_anew(c)])
        pieces = [text[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)])]
    forms = list(map(form_of, pieces))
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    ends = np.append(starts[1:], len(text)) if len(starts) else starts
    return "".join(forms), np.repeat(starts, sizes), np.repeat(ends, sizes)


def is_tolerant(keyword: str) -> bool:
    """Whether a keyword is also searched in standard form: it has something to strip, or a known prefix glued to a digit."""
    return bool(form_of(keyword)) and bool(_STRIPPED.search(keyword) or _GLUED.match(keyword))


def automaton(words: list[str]):
    """Over the distinct words that are not empty; their value is all their numbers."""
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            numbers.setdefault(w, []).append(i)
    out = ahocorasick.Automaton()
    for w, own in numbers.items():
        out.add_word(w, (len(w), own))
    if numbers:
        out.make_automaton()
    return out if numbers else None


def blocks_of(keywords: DataFrame, column: str, most_bytes: int) -> list[pa.Table]:
    """The keywords that are not null, in parts of about ``most_bytes``."""
    given = keywords.where(F.col(column).isNotNull())
    n = -(-(given.agg(F.sum(F.octet_length(column) + 32)).first()[0] or 1) // most_bytes)
    if n == 1:
        return [given.toArrow()]
    return [given.where(F.pmod(F.xxhash64(column), F.lit(n)) == b).toArrow() for b in range(n)]


def keyword_places(rows: DataFrame, keywords: DataFrame, *, keep: list[str], text_col: str = "text", keyword: str = "keyword", keyword_id: str = "keyword_id", most_bytes: int = 32 << 20) -> DataFrame:
    """``keep, keyword_id, exact, start, end``: every place of every keyword in every text, in code points of the raw text, the end exclusive.

    Texts and keywords are compared in lower case.  A keyword with something to strip, or a known prefix glued to a number, is sought in
    standard form where a text doesn't hold it exactly (``exact`` is false).  Places may overlap.  Null and empty texts and
    keywords have none; keywords that are equal are found each.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    id_kind = dict(keywords.dtypes)[keyword_id]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{keyword_id}` {id_kind}, exact boolean, start long, end long"
    sent = rows.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    found = None
    for block in blocks_of(keywords.select(keyword_id, keyword), keyword, most_bytes):
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            table = held.value
            words = table.column(keyword).to_pylist()
            exact = automaton([w.lower() for w in words])
            loose = automaton([form_of(w) if is_tolerant(w) else "" for w in words])
            names = table.column(keyword_id).combine_chunks()
            for batch in batches:
                out: list[tuple] = []
                for i, text in enumerate(batch.column("_text").to_pylist()):
                    if not text or exact is None:
                        continue
                    low, at = lowered(text)
                    seen = set()
                    for end, (size, own) in exact.iter(low):
                        a, b = int(at[end + 1 - size]), int(at[end]) + 1
                        seen.update(own)
                        out += [(i, j, True, a, b) for j in own]
                    if loose is not None:
                        form, starts, ends = standardized(text)
                        for end, (size, own) in loose.iter(form):
                            rest = [j for j in own if j not in seen]
                            if rest:
                                a, b = int(starts[end + 1 - size]), int(ends[end])
                                out += [(i, j, False, a, b) for j in rest]
                if out:
                    i, j, e, a, b = zip(*out)
                    at = pa.array(i)
                    yield pa.RecordBatch.from_arrays([*(batch.column(f"_{k}").take(at) for k in range(len(keep))), names.take(pa.array(j)), pa.array(e), pa.array(a), pa.array(b)], [*keep, keyword_id, "exact", "start", "end"])

        part = sent.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def first_places(pages: DataFrame, keywords: DataFrame, *, keyword: str = "keyword", keyword_id: str = "keyword_id", **more) -> DataFrame:
    """``kb_id, doc_id, keyword_id, page, start, end, content``: the first page of each document that holds each keyword, its first place
    there, and the text around that."""
    places = keyword_places(pages, keywords, keep=["kb_id", "doc_id", "page", "text"], keyword=keyword, keyword_id=keyword_id, **more)
    around = snippet(F.col("text"), F.col("start").cast("int"), F.substr(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    best = places.withColumn("content", around).groupBy("kb_id", "doc_id", keyword_id).agg(F.min(F.struct("page", "start", "end", "content")).alias("m"))
    return best.select("kb_id", "doc_id", keyword_id, "m.page", "m.start", "m.end", "m.content")


def holding(docs: DataFrame, needles: DataFrame, *, text_col: str = "text", needle: str = "needle", keep: list[str] | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` (or their columns ``keep``) joined with the ``needles`` that their texts hold, character by character.  Nulls and empty needles are held by none."""
    keep = keep or docs.columns
    schema = T.StructType([*(docs.schema[c] for c in keep), *needles.schema.fields])
    found = None
    for block in blocks_of(needles, needle, most_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            table = held.value.combine_chunks()
            machine = automaton(table.column(needle).to_pylist())
            for batch in batches:
                pairs = [(i, j) for i, text in enumerate(batch.column(text_col).to_pylist()) if text and machine for j in sorted({j for _, (_, own) in machine.iter(text) for j in own})]
                if pairs:
                    i, j = (pa.array(x) for x in zip(*pairs))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(i) for c in keep), *(c.combine_chunks().take(j) for c in table.columns)], names)

        names = schema.names
        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found
