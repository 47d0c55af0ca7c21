"""Scalar text functions as Catalyst expressions; pandas UDFs only for NFKC, case folding and LCS."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------------------------------
#: Prefixes of standard numbers.
STANDARD_PREFIXES = ["IEC", "ISO", "CIE", "GB", "CJJ", "JGJ", "JG", "BS", "EN", "NF", "DIN", "JIS", "KS", "TJ"]
#: Characters that normalisation strips besides white space.
STRIPPED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "。！？、；：（）【】「」『』《》·…—–"
#: White space and invisible characters that it strips.
INVISIBLE = r"\s\u3000\u2000-\u200f\u2028-\u202f\ufeff"
#: Heading rules in order: pattern, level.
HEADING_RULES = [
    ("第[一二三四五六七八九十百零]+[章篇]", 1),
    ("第[一二三四五六七八九十百零]+[部节]", 2),
    ("第[一二三四五六七八九十百零]+[分]", 2),
    ("^第[一二三四五六七八九十百零]+[条]", 3),
    (r"^\d+\.\d+\.", 3),
    ("^[一二三四五六七八九十]+[、．.]", 3),
    ("^[(（][一二三四五六七八九十百零]+[)）]", 4),
    (r"^\d+\.\d+[^\d]", 4),
    (r"^\d+[、．.\s]", 5),
    (r"^[(（]\d+[)）]", 6),
    ("^[①②③④⑤⑥⑦⑧⑨⑩]", 6),
]
#: A line that ends so is no title.
TITLE_ENDS = "。；！？，,.;!?"
#: Fuzzy matching: least length for LCS, least ratio.
LEAST_LCS, LEAST_RATIO = 4, 0.85

_STRIP = re.compile(f"[{INVISIBLE}{re.escape(STRIPPED)}]")
_STANDARD_STRIP = re.compile(r"[\s\u3000\u00a0\-./]+")


@F.pandas_udf(T.StringType())
def normalized(s: pd.Series) -> pd.Series:
    """NFKC, case folding, then no white space or punctuation; null is empty."""
    return s.map(lambda x: _STRIP.sub("", unicodedata.normalize("NFKC", x).casefold()) if x else "")


@F.pandas_udf(T.StringType())
def standard_form(s: pd.Series) -> pd.Series:
    """For matching standard numbers: NFKC, case folding, without white space, ``-``, ``.`` and ``/``."""
    return s.map(lambda x: _STANDARD_STRIP.sub("", unicodedata.normalize("NFKC", x).casefold()) if x else "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit row per symbol of ``a``, updated by addition with carries."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = where.get(c, 0)
        row = ((row + (row & hit)) | (row & ~hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def lcs_ratio_at_least(a: str, b: str, denominator: str = "min", least: float = LEAST_RATIO) -> bool:
    """Whether LCS over the shorter (``min``) or longer (``max``) length reaches ``least``; a bound by shared characters
    avoids most comparisons."""
    low, high = sorted((len(a), len(b)))
    over = low if denominator == "min" else high
    if low < LEAST_LCS:
        return False
    counts: dict[str, int] = {}
    for c in a:
        counts[c] = counts.get(c, 0) + 1
    shared = 0
    for c in b:
        if counts.get(c, 0) > 0:
            counts[c] -= 1
            shared += 1
    return shared / over >= least and lcs_length(a, b) / over >= least


def fuzzy_matcher(denominator: str = "min"):
    """A pandas UDF over two normalised strings: containment either way, else LCS."""

    @F.pandas_udf(T.BooleanType())
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(x and y and (x in y or y in x or lcs_ratio_at_least(x, y, denominator))) for x, y in zip(a, b)], dtype=bool)

    return match


def collapsed(s: Column) -> Column:
    """White space, Unicode's too, squeezed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def standard_number(s: Column) -> Column:
    """A standard number in tidy form: a blank after a known prefix, no dash before a dotted digit."""
    tidy = collapsed(nfkc(s))
    tidy = F.regexp_replace(tidy, rf"(?i)^({'|'.join(STANDARD_PREFIXES)})(?=\d)", "$1 ")
    return F.regexp_replace(tidy, r"(\d)-(?=\.\d)", "$1")


def tolerant_search(keyword: Column) -> Column:
    """Whether a keyword is also searched in standard form: it has something to strip, or a prefix glued to a digit."""
    return F.rlike(keyword, F.lit(r"(?U)[\s\u3000\u00a0\-./]")) | F.rlike(keyword, F.lit(rf"(?i)^(?:{'|'.join(STANDARD_PREFIXES)})\d"))


def heading_level(s: Column) -> Column:
    """1 to 6 by the first rule that matches a likely title, else null."""
    t = F.trim(s)
    likely = F.char_length(t).between(2, 80) & ~F.contains(F.lit(TITLE_ENDS), F.substring(t, -1, 1))
    rules = F.lit(None).cast("int")
    for pattern, level in reversed(HEADING_RULES):
        rules = F.when(F.rlike(t, F.lit(pattern)), F.lit(level)).otherwise(rules)
    return F.when(likely, rules)


def clause_number(s: Column) -> Column:
    """The number with most dots, the first of equals; null without digits."""
    found = F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1))
    dots = F.transform(found, lambda n: F.char_length(n) - F.char_length(F.replace(n, F.lit("."))))
    best = F.array_position(dots, F.array_max(dots)).cast("int")
    return F.when(F.size(found) > 0, F.try_element_at(found, best))


def section_path(s: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(s, r"(?m)^(#{1,6})\s+(.+)", 2)), F.lit(""))


def has_heading(s: Column) -> Column:
    return F.rlike(s, F.lit(r"(?m)^#{1,6}\s+\S"))


def chunk_prefix(s: Column, most: int = 200) -> Column:
    return F.substring(F.trim(s), 1, most)


def snippet(raw: Column, at: Column, keyword: Column) -> Column:
    """Around a hit at 0-based ``at``: 80 characters before, 200 after, trimmed, 500 at most."""
    low = F.greatest(F.lit(0), at - 80)
    high = F.least(F.char_length(raw), at + F.char_length(keyword) + 200)
    return F.substring(F.trim(F.substr(raw, low + 1, high - low)), 1, 500)


def page_count_estimate(s: Column) -> Column:
    tables = F.size(F.split(s, "<table>")) - 1
    return F.greatest(F.lit(1), F.when(tables > 0, tables).otherwise(F.floor(F.char_length(s) / 3000))).cast("long")


def valid_id(s: Column) -> Column:
    return F.rlike(s, F.lit(r"^[0-9A-Za-z_\-]{1,64}$"))


def content_hash(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def source_id(doc: Column, page: Column) -> Column:
    short = F.when(F.coalesce(doc, F.lit("")) == "", F.lit("empty")).otherwise(F.substring(F.md5(doc.cast("binary")), 1, 8))
    return F.concat(F.lit("src_"), short, F.lit("_p"), F.coalesce(page + 1, F.lit(0)).cast("string"))


def file_name_sanitized(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\w\-.]", "_")


def fenced_json(s: Column) -> Column:
    """The content of the first fenced JSON block, or the text itself."""
    inside = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(s)


def lines_with(s: Column, prefix: str) -> Column:
    """Trimmed lines that start with ``prefix``, without it."""
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.trim(F.substr(x, F.lit(len(prefix) + 1))))


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """A pixel box x0, y0, x1, y1 in shares of the page, within 0 and 1."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when((F.size(box) == 4) & (width > 0) & (height > 0), F.transform(box, lambda v, i: clamp(v / F.when(i % 2 == 0, width).otherwise(height))))


def unit_polygon(points: Column, width: Column, height: Column) -> Column:
    """Corners in shares of the page; points without two numbers are left out, and all are where the size is unknown."""
    whole = F.filter(F.coalesce(points, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    return F.when((width > 0) & (height > 0), F.transform(whole, lambda p: F.array(F.get(p, F.lit(0)) / width, F.get(p, F.lit(1)) / height))).otherwise(F.array().cast("array<array<double>>"))
