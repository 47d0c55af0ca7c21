"""Places, pieces and choices of spans in long texts, against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 63, 64, 65, 128, 129, 700])]
    df = spark.createDataFrame(rows, "id int, v array<int>")
    for r in df.select("v", pii.before(F.col("v")).alias("sums"), pii.before(F.col("v"), largest=True).alias("tops")).collect():
        assert r.sums == [sum(r.v[:i]) for i in range(len(r.v))] and r.tops == [max([0, *r.v[:i]]) for i in range(len(r.v))]


def test_pieces(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("aé\U0001f600\n", k=13000))
    cuts = [(a, b) for a in (0, 1, 4095, 4096, 4097, 8191, 12288, 12999, 13000) for b in (a, a + 1, a + 24, a + 4096, a + 9000) if b <= 13000]
    df = spark.createDataFrame([(text, cuts)], "text string, cuts array<struct<a:int,b:int>>")
    got = df.select(pii.let(pii.text_blocks(F.col("text")), lambda blocks: F.transform("cuts", lambda c: pii.piece(blocks, c["a"], c["b"]))).alias("p")).first().p
    assert got == [text[a:b] for a, b in cuts]


def plain_choice(candidates):
    out = [c[:4] for c in candidates if c[1] < 4]
    for bad, start, end, rank, kind in sorted((c[4], c[0], c[2], c[1], c[3]) for c in candidates if c[1] >= 4):
        if not any(start < e and s < end for s, _, e, _ in out):
            out.append((start, rank, end, kind))
    return sorted(out)


def test_choice_of_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        spans = {(s, rng.randint(0, 6), s + rng.randint(1, 9)) for s in (rng.randint(0, 80) for _ in range(rng.randint(0, 25)))}
        rows.append((i, sorted((s, r, e, f"k{r}", rng.choice([0.1, 0.2, 0.3]) if r > 3 else 0.0) for s, r, e in spans)))
    df = spark.createDataFrame(rows, "id int, c array<struct<start:int,rank:int,end:int,kind:string,bad:double>>")
    got = {r.id: sorted(map(tuple, r.x)) for r in df.select("id", pii.chosen(F.col("c")).alias("x")).collect()}
    assert got == {i: plain_choice(c) for i, c in rows}


def test_long_texts_with_many_matches(spark):
    text = "\n".join(f"10.{i % 256}.{i // 256 % 256}.7 GET é" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "x" * 400_000), (3, "7" * 400_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    hidden = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.perf_counter() - began < 90
    assert [(s.start, s.end) for s in got[1].pii_base if s.kind == "ip"] == [m.span() for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text)]
    assert hidden[1] == re.sub(r"[0-9]+(?:\.[0-9]+){3}", "[ip]", text) and hidden[2] == "x" * 400_000


def test_edge_cases_of_redaction(spark):
    rows = [(1, "mail a@b.co", "p", "b"), (1, "mail a@b.co", "p", "b"), (None, None, None, None), (2, "", "p", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string, _spans string").withColumn("_base", F.lit(1)).withColumn("_found", F.lit(2)).withColumn("pii_base", F.lit(3))
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, t and t.replace("a@b.co", "[email]"), p, b, 1, 2, 3)) for i, t, p, b in rows)
    assert pii.redact(df.limit(0)).count() == 0 and pii.find_pii(df.select("doc_id", "text").limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii.find_pii(df)
