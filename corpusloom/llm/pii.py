"""Personal data: candidate spans, scored by boosted trees (DataFrame functions only).

Four base kinds are found by patterns and checks and are always kept.  For what such patterns miss, high-recall generators
propose further spans (tokens with digits, phone numbers without a plus sign, spelled-out mail addresses).  Boosted
trees over features of a proposal's format and context score it, and a threshold calibrated for precision selects.
Proposals that overlap a base span or a better proposal are dropped.

The trees are trained on the driver on a few hundred generated spans, whose features come from the same expressions;
scoring compiles them to CASE expressions.  Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base patterns.  A match starts where the plain pattern's leftmost match would: at the start of a run of its first
# character class, or where the last match ended; with that, possessive repetition never backtracks.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

# Generators of further proposals.
SECRET = r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z_-]*+[0-9][A-Za-z0-9_-]{11,}+"
NUMBER = r"[(]?[0-9]{2,4}[)]?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}"
SPELLED = r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++\x20?(?:\(at\)|\[at\]|\x20at\x20|at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|dot\x20)\x20?[A-Za-z]{2,10}+"
MORE = ["secret", "number", "spelled"]
CONTEXT = r"(?i)(key|token|secret|passw|tel|phone|call|fax|mobil|contact|mail|write|reach)"


#: Sums and maxima of what precedes are taken in blocks of so many elements, pieces of text out of blocks of so many characters: work grows
#: with the matches and the text, not with their product.
ELEMENTS, CHARACTERS = 64, 4096


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def before(values: Column, largest: bool = False) -> Column:
    """For each of an array of integers the sum, or the largest, of 0 and those before it."""
    join = (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x)
    total = lambda v, first: F.aggregate(v, first, join)

    def in_blocks(v):
        count = F.floor((F.size(v) - 1) / ELEMENTS).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(v, b * ELEMENTS + 1, F.lit(ELEMENTS)))
        inside = lambda block, start: F.transform(block, lambda _, j: total(F.slice(block, F.lit(1), j), start))
        return let(blocks, lambda bs: let(F.transform(bs, lambda b: total(b, F.lit(0))), lambda sums: F.flatten(
            F.transform(bs, lambda b, i: let(total(F.slice(sums, F.lit(1), i), F.lit(0)), lambda start: inside(b, start)))
        )))

    return let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.array().cast("array<int>")))


def text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text in blocks."""
    at = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    i, j = (F.floor(x / CHARACTERS).cast("int") for x in (start, end))
    long = F.concat(F.substr(at(i), start % CHARACTERS + 1), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(at(j), F.lit(1), end % CHARACTERS))
    return F.when(i == j, F.substr(at(i), start % CHARACTERS + 1, end - start)).otherwise(long)


def empty() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def spans_of(text: Column, pattern: str, may: Column) -> Column:
    """Matches in order as ``start, end, text``.  The text is cut into what precedes each match and the match; the lengths, summed, are the
    places."""
    cut = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")  # the rest of the text comes with an empty match
    of = lambda group: F.regexp_extract_all(text, cut, F.lit(group))
    lengths = lambda gaps, found: F.transform(gaps, lambda g, i: F.char_length(g) + F.char_length(F.get(found, i)))
    placed = let(F.transform(of(1), lambda g: g), lambda gaps: let(of(2), lambda found: let(before(lengths(gaps, found)), lambda ats: F.filter(
        F.transform(found, lambda m, i: let(F.get(ats, i) + F.char_length(F.get(gaps, i)), lambda start: F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("text")))),
        lambda s: s["text"] != "",
    ))))
    return F.when(may, placed).otherwise(empty())


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of ASCII digits passes Luhn's check."""
    reverse = F.reverse(x)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(x)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(reverse, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(reverse, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def valid_ip(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x, "[.]"), lambda p: (F.char_length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each base kind in ``text``."""
    has = lambda c: F.contains(text, F.lit(c))
    numeric = F.rlike(text, F.lit("[0-9]"))
    count = lambda s: F.char_length(digits(s["text"]))
    return {
        "email": spans_of(text, EMAIL, has("@")),
        "ip": F.filter(spans_of(text, IP, numeric & has(".")), lambda s: valid_ip(s["text"])),
        "card": F.filter(spans_of(text, CARD, numeric), lambda s: F.when(count(s).between(12, 19), luhn(digits(s["text"]))).otherwise(False)),
        "phone": F.filter(spans_of(text, PHONE, has("+")), lambda s: count(s).between(9, 15)),
    }


# ---- the further kinds ------------------------------------------------------------------------------


def proposals(text: Column) -> Column:
    """``kind`` (index in MORE), ``start, end, text, f``: proposals with their features."""
    return let(text_blocks(text), lambda blocks: proposals_in(text, blocks))


def proposals_in(text: Column, blocks: Column) -> Column:
    numeric = F.rlike(text, F.lit("[0-9]"))
    spelled = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) | (F.contains(text, F.lit(" at ")) & F.contains(text, F.lit("dot")))
    found = [spans_of(text, p, may) for p, may in ((SECRET, numeric), (NUMBER, numeric), (SPELLED, spelled))]

    def tagged(spans, kind):
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))

    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")

    def features(c):
        t = c["text"]
        ahead = piece(blocks, F.greatest(c["start"] - 24, F.lit(0)), c["start"])
        after = piece(blocks, c["end"], c["end"] + 1)
        return F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), t.alias("text"),
            F.array(
                c["kind"].cast("double"), F.char_length(t).cast("double"), count(t, "[0-9]"), count(t, "[A-Z]"), count(t, "[a-z]"),
                count(t, r"[^A-Za-z0-9]"), F.size(F.array_distinct(F.split(t, ""))).cast("double"), F.rlike(ahead, F.lit(CONTEXT)).cast("double"),
                F.rlike(t, F.lit("^(AKIA|sk|pk|gh|xox|eyJ)")).cast("double"), F.rlike(after, F.lit("[A-Za-z0-9]")).cast("double"),
                count(t, "[0-9][A-Za-z]|[A-Za-z][0-9]"), F.rlike(t, F.lit(r"[(\[]")).cast("double"),
                F.rlike(ahead, F.lit(r"[A-Za-z0-9.,/-]\x20?$")).cast("double"),
            ).alias("f"),
        )

    return F.transform(F.concat(*[tagged(s, k) for k, s in enumerate(found)]), features)


def generated(n: int, seed: int) -> list[tuple[str, float]]:
    """Texts that hold one span each, and whether it is personal data."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: pick(low, rng.randint(2, 9))
    good = [
        lambda: "AKIA" + pick(up + dig, 14) + pick(dig, 2), lambda: "sk_live_" + pick(low + dig, 22) + "7", lambda: "ghp_" + pick(up + low + dig, 30) + "4x",
        lambda: pick("abcdef" + dig, 38) + "1f", lambda: pick(up + low + dig, 30) + "9Zk",
        lambda: f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", lambda: f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}", lambda: f"0{pick(dig, 2)} {pick(dig, 4)} {pick(dig, 4)}",
        lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"{word()}[at]{word()}[dot]org", lambda: f"{word()} at {word()} dot net",
    ]
    bad = [
        lambda: f"{word()}-20{pick(dig, 2)}-0{pick('123456789', 1)}-1{pick(dig, 1)}", lambda: f"{word()}_{pick(dig, 6)}_{word()}_{word()}", lambda: pick(dig, rng.randint(12, 18)),
        lambda: f"{word()}{pick(dig, 1)}-{word()}-{word()}-{word()}", lambda: f"v{pick(dig, 1)}-{word()}-build-{pick(dig, 5)}", lambda: f"20{pick(dig, 2)}-0{pick(dig, 1)}-{pick(dig, 2)}-{word()}-{word()}",
        lambda: f"{pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 3)}", lambda: f"{pick(dig, 2)} {pick(dig, 3)} {pick(dig, 3)}", lambda: f"19{pick(dig, 2)}-{pick(dig, 4)}-{pick(dig, 3)}",
    ]
    lead = {True: ["call", "tel", "phone", "contact", "key", "token", "secret", "mail", "write to", "reach me"], False: ["in", "the", "of", "page", "file", "total", "about", "see"]}
    out = []
    for _ in range(n):
        personal = rng.random() < 0.5
        told = rng.random() < (0.6 if personal else 0.1)
        span = rng.choice(good if personal else bad)()
        out.append((f"{word()} {word()} {rng.choice(lead[told])} {span} {word()} {word()}.", float(personal)))
    return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, leaves: int = 5) -> tuple[float, list]:
    """Depth-two trees under logistic loss: (start, [(feature, cut, left, right)]), where a side is (feature, cut, low, high)."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score = np.full(len(y), start)

    def best(rows, grad, hess):
        found = (1e-9, 0, np.inf)
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for cut in (values[:-1] + values[1:]) / 2:
                side = x[rows, j] <= cut
                if min(side.sum(), (~side).sum()) < leaves:
                    continue
                gain = sum(grad[rows][s].sum() ** 2 / (hess[rows][s].sum() + 1) for s in (side, ~side)) - grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
                if gain > found[0]:
                    found = (gain, j, float(cut))
        return found[1], found[2]

    value = lambda rows, grad, hess: float(rate * grad[rows].sum() / (hess[rows].sum() + 1)) if len(rows) else 0.0
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        rows = np.arange(len(y))
        j, cut = best(rows, grad, hess)
        sides = []
        for part in (rows[x[:, j] <= cut], rows[x[:, j] > cut]):
            k, inner = best(part, grad, hess) if len(part) else (0, np.inf)
            low, high = part[x[part, k] <= inner], part[x[part, k] > inner]
            sides.append((k, inner, value(low, grad, hess), value(high, grad, hess)))
            score[low] += sides[-1][2]
            score[high] += sides[-1][3]
        trees.append((j, cut, *sides))
    return start, trees


def tree_scores(x: np.ndarray, start: float, trees: list) -> np.ndarray:
    score = np.full(len(x), start)
    for j, cut, left, right in trees:
        for part, (k, inner, low, high) in ((x[:, j] <= cut, left), (x[:, j] > cut, right)):
            score += np.where(part, np.where(x[:, k] <= inner, low, high), 0.0)
    return score


_MODEL: dict[tuple, tuple] = {}


def fitted(spark: SparkSession, n: int = 700, seed: int = 11, precision: float = 0.98) -> tuple[float, list, float]:
    """Trees and the lowest score at which, on generated spans that were not trained on, precision reaches its target."""
    if (n, seed, precision) not in _MODEL:
        rows = generated(n, seed)
        frame = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "i int, text string, y double")
        found = frame.select("i", "y", F.explode(proposals(F.col("text"))).alias("c")).select("i", "y", "c.f").collect()
        found.sort(key=lambda r: (r["i"], r["f"]))
        x, y, i = np.array([r["f"] for r in found]), np.array([r["y"] for r in found]), np.array([r["i"] for r in found])
        known = i % 3 != 0
        start, trees = boosted(x[known], y[known])
        score, truth = tree_scores(x[~known], start, trees), y[~known]
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        cut = float(score[order][good[-1]]) if len(good) else np.inf
        _MODEL[n, seed, precision] = (start, trees, max(cut, 0.0))
    return _MODEL[n, seed, precision]


def tree_column(f: Column, start: float, trees: list) -> Column:
    big = 1e300  # stands for an infinite cut

    def node(j, cut, low, high):
        return F.when(F.element_at(f, j + 1) <= F.lit(min(cut, big)), low).otherwise(high)

    leaf = lambda s: node(s[0], s[1], F.lit(s[2]), F.lit(s[3]))
    return reduce(lambda a, t: a + node(t[0], t[1], leaf(t[2]), leaf(t[3])), trees, F.lit(start))


def find_pii(docs: DataFrame, *, text_col: str = "text", spans: str = "pii", base_spans_col: str = "pii_base") -> DataFrame:
    """``docs`` with ``spans``: an array of ``start, rank, end, kind`` by start and rank (the order of KINDS and MORE), and
    ``base_spans_col``, the spans of the base kinds alone.  ``docs`` must not have columns of these names.  A null text has no spans; repeated rows stay, and
    no rows give none.  Work grows with the text and its matches, so texts may be long.
    """
    clash = {spans, base_spans_col} & set(docs.columns)
    if clash:
        raise ValueError(f"the rows have columns {sorted(clash)}; name others for the spans")
    start, trees, cut = fitted(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    inner = unused(docs, "_found")
    staged = docs.withColumn(inner, F.struct(*[base[k].alias(k) for k in KINDS], proposals(text).alias("more")))
    tagged = lambda of, k: F.transform(of, lambda s: span(s["start"], F.lit(k), s["end"], F.lit(KINDS[k])))
    staged = staged.withColumn(base_spans_col, F.array_sort(F.concat(*[tagged(F.col(inner)[k], i) for i, k in enumerate(KINDS)])))
    names = F.array(*[F.lit(m) for m in MORE])
    scored = F.filter(F.transform(F.col(inner)["more"], lambda c: F.struct(
        c["start"].alias("start"), (c["kind"] + len(KINDS)).alias("rank"), c["end"].alias("end"), F.element_at(names, c["kind"] + 1).alias("kind"), (-tree_column(c["f"], start, trees)).alias("bad"),
    )), lambda c: c["bad"] <= -cut)
    known = F.transform(base_spans_col, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(0.0).alias("bad")))
    return staged.withColumn(spans, F.array_sort(chosen(F.array_sort(F.concat(known, scored))))).drop(inner)


def span(start: Column, rank: Column, end: Column, kind: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), kind.alias("kind"))


def unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def chosen(candidates: Column) -> Column:
    """Of spans by start, those of the base kinds and the proposals, best first, that overlap neither these nor a better one.  What may overlap
    stands together between places that no span crosses, so each such stretch is settled alone."""
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    plain = lambda c: span(c["start"], c["rank"], c["end"], c["kind"])

    def best(stretch):
        base = F.transform(F.filter(stretch, lambda c: c["rank"] < len(KINDS)), plain)
        more = F.array_sort(F.transform(F.filter(stretch, lambda c: c["rank"] >= len(KINDS)), lambda c: F.struct(c["bad"].alias("bad"), c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank"), c["kind"].alias("kind"))))
        settled = F.aggregate(more, base, lambda acc, c: F.when(F.exists(acc, lambda s: overlaps(s, c)), acc).otherwise(F.concat(acc, F.array(plain(c)))))
        return F.when(F.size(stretch) == 1, F.transform(stretch, plain)).otherwise(settled)

    def in_stretches(all_):
        reach = before(F.transform(all_, lambda c: c["end"]), largest=True)
        opens = let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.get(all_, i)["start"] >= F.get(r, i)))
        return let(opens, lambda at: F.flatten(F.transform(at, lambda i, k: let(F.slice(all_, i + 1, F.coalesce(F.get(at, k + 1), F.size(all_)) - i), best))))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return let(candidates, lambda all_: F.when(F.size(all_) > 0, in_stretches(all_)).otherwise(none))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``find_pii`` reports replaced by its kind in brackets; of overlapping spans the
    first counts.  Null texts stay null, other columns as they are, also those that have names of spans."""
    names = [unused(docs, n) for n in ("_spans", "_base")]
    found = find_pii(docs, text_col=text_col, spans=names[0], base_spans_col=names[1])
    text = F.col(text_col)

    def hidden(spans):
        def with_reach(reach, blocks):
            shown = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(reach, i).alias("from"), s["kind"].alias("kind"))), lambda s: s["start"] >= s["from"])
            last = F.greatest(F.get(reach, F.size(spans) - 1), F.element_at(spans, -1)["end"])
            parts = F.transform(shown, lambda s: F.concat(piece(blocks, s["from"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
            return F.array_join(F.concat(parts, F.array(piece(blocks, last, F.char_length(text)))), "")

        return let(before(F.transform(spans, lambda s: s["end"]), largest=True), lambda reach: let(text_blocks(text), lambda blocks: with_reach(reach, blocks)))

    done = let(F.col(names[0]), lambda spans: F.when(F.size(spans) > 0, hidden(spans)).otherwise(text))
    return found.select(*[F.when(text.isNotNull(), done).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in ``documents``, counts of the base kinds and a digest of their spans."""
    from .common import table

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii").alias("spans"))
