"""Many keywords against plain searches."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import keywords as K


def form(text):
    return re.sub(r"[\s　\xa0\-./]", "", unicodedata.normalize("NFKC", text).casefold())


TEXTS = [
    "see IEC 61547 there, iec-61547 and IEC61547", "ＩＥＣ　６１５４７", "GB/T 20145-2006 GB 7000.202", "Straße STRASSE strasse", "İstanbul istanbul", "étude étude ÉTUDE", "ﬁne fine FINE", "가각 각",
    "", None, "a-a a.a aaaa", "ΟΔΟΣ οδος", "x̣́y", "가" * 3 + "ー－-", "no match at all",
]
WORDS = ["IEC61547", "IEC 61547", "gb 7000-.202", "strasse", "étude", "fine", "가각", "a a", "aa", "οδος", "", None, "a-a", "istanbul", "IEC61547", "see"]


def test_places_equal_plain_search(spark):
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)
    words = spark.createDataFrame(list(enumerate(WORDS)), "keyword_id long, keyword string")
    for most in (32 << 20, 100):
        got = {tuple(r) for r in K.keyword_places(rows, words, keep=["doc_id"], most_bytes=most).collect()}
        exact = {(i, j) for i, t in enumerate(TEXTS) for j, w in enumerate(WORDS) if t and w and w.lower() in t.lower()}
        loose = {(i, j) for i, t in enumerate(TEXTS) for j, w in enumerate(WORDS) if t and w and K.is_tolerant(w) and form(w) in form(t)} - exact
        assert {(r[0], r[1]) for r in got if r[2]} == exact and {(r[0], r[1]) for r in got if not r[2]} == loose
        for i, j, is_exact, a, b in got:
            piece = TEXTS[i][a:b]
            assert piece.lower() == WORDS[j].lower() if is_exact else form(WORDS[j]) in form(piece)
        counted = sum(r[2] for r in got)
        want = sum(t.lower().startswith(w.lower(), k) for t in TEXTS if t for w in WORDS if w for k in range(len(t.lower())))
        assert counted == want


def test_tolerant_places_are_tight(spark):
    rows = spark.createDataFrame([(0, "Ärger: GB 7000 -. 202, ＩＥＣ　６１５４７!")], "doc_id long, text string")
    words = spark.createDataFrame([(0, "gb 7000.202"), (1, "IEC61547")], "keyword_id long, keyword string")
    got = {r.keyword_id: rows.first().text[r.start : r.end] for r in K.keyword_places(rows, words, keep=["doc_id"]).collect()}
    assert got == {0: "GB 7000 -. 202", 1: "ＩＥＣ　６１５４７"}


def test_standard_forms_of_any_text():
    rng = random.Random(2)
    alphabet = "aB -./ß̣́éﬁ가각Åｶﾞ㌔̈́　１ﷺোৗ"
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        got, starts, ends = K.standardized(text)
        assert got == form(text)
        assert len(starts) == len(ends) == len(got) and all(0 <= a < b <= len(text) for a, b in zip(starts, ends))


def test_first_places(spark):
    pages = spark.createDataFrame([("k", 1, 0, "nothing"), ("k", 1, 1, "iec-61547 x"), ("k", 1, 2, "IEC61547"), ("k", 2, 0, None), ("m", 3, 4, "see IEC61547")], "kb_id string, doc_id long, page long, text string")
    words = spark.createDataFrame([("w", "IEC61547"), ("e", "")], "keyword_id string, keyword string")
    got = {(r.doc_id, r.page, r.start, r.end, r.content) for r in K.first_places(pages, words).collect()}
    assert got == {(1, 1, 0, 9, "iec-61547 x"), (3, 4, 4, 12, "see IEC61547")}
    assert K.first_places(pages.limit(0), words).count() == 0 and K.first_places(pages, words.limit(0)).count() == 0


def test_holding(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "two Two"), (3, "two Two")], "doc_id long, text string")
    needles = spark.createDataFrame([("a", "two"), ("b", "Two"), ("c", ""), ("d", None), ("e", "two")], "name string, needle string")
    got = K.holding(docs, needles)
    assert sorted((r.doc_id, r.name, r.text) for r in got.collect()) == sorted([(1, "a", "one two"), (1, "e", "one two")] + 2 * [(3, n, "two Two") for n in "abe"])
    assert K.holding(docs, needles.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("n", [2000])
def test_thousands_of_keywords(spark, n):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.pmod(F.col("id") * 37 + k * 11, F.lit(n))) for k in range(9)]).alias("text"))
    words = spark.range(9 * n).select(F.col("id").alias("keyword_id"), F.concat(F.lit("w"), F.floor(F.col("id") / n), F.lit("x"), F.col("id") % n).alias("keyword"))
    got = {(r.doc_id, r.keyword_id) for r in K.keyword_places(docs, words, keep=["doc_id"]).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i, k * n + int(x[len(f"w{k}x") : m])) for i, t in texts.items() for k, x in enumerate(t.split(" ")) for m in range(len(f"w{k}x") + 1, len(x) + 1) if str(int(x[len(f"w{k}x") : m])) == x[len(f"w{k}x") : m]}
    assert got == want
