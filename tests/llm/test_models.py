"""Language-model scores, importance resampling and the Merkle manifest against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import importance, lm, merkle


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [""]


def by_counts(rows, held_out, order, strength):
    """The same model as conditional probabilities of whole histories, by dictionaries."""
    counts = collections.Counter()
    for i, t in rows:
        if not held_out(i):
            seq = ["<s>", *words_of(t)]
            for m in range(1, order + 1):
                counts.update(tuple(seq[k : k + m]) for k in range(len(seq) - m + 1))
    starts = counts.pop(("<s>",), 0)
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def p(history, word):
        if not history:
            return (counts[word,] + 1) / (n + v + 1)
        mu = strength[len(history) - 1]
        c = starts if history == ("<s>",) else counts[history]
        return (counts[(*history, word)] + mu * p(history[1:], word)) / (c + mu)

    out = []
    for i, t in rows:
        seq = ["<s>", *words_of(t)]
        score = sum(math.log10(p(tuple(seq[max(0, k - order + 1) : k]), seq[k])) for k in range(1, len(seq)))
        out.append((i, bool(held_out(i)), len(seq) - 1, sum(counts[w,] > 0 for w in seq[1:]), n, sum(math.log10(p((), w)) for w in seq[1:]), score))
    return out, p, counts


def held(i):
    return i % 7 == 2


@pytest.mark.parametrize("order, block", [(1, 1 << 20), (2, 4000), (3, 1 << 20), (3, 3000), (4, 9000)])
def test_scores_equal_plain_model(docs, corpus, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3000)
    strength = [4.0, 2.0, 1.5][: order - 1]
    want, _, _ = by_counts(corpus, held, order, strength)
    got = lm.language_model_scores(docs, F.col("doc_id") % 7 == 2, order=order, strength=strength)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    have = sorted(tuple(r) for r in got.collect())
    assert [h[:5] for h in have] == [w[:5] for w in sorted(want)]
    for h, w in zip(have, sorted(want)):
        assert h[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_model_sums_to_one(corpus):
    _, p, counts = by_counts(corpus, held, 3, [4.0, 2.0])
    vocabulary = [g[0] for g in counts if len(g) == 1] + ["never seen"]
    for history in [(), ("<s>",), *[g for g in list(counts)[:400] if len(g) == 2 and g[-1]][:5]]:
        assert sum(p(history, w) for w in vocabulary) == pytest.approx(1)


def test_scores_of_edge_cases(spark, no_docs):
    assert lm.language_model_scores(no_docs, F.lit(False)).count() == 0
    rows = [(None, None), (None, "b a"), (1, "a b " * 3000), (1, "a b " * 3000), (2, "unknown words")]
    df = spark.createDataFrame([(i, t, 1, 2.0, 3) for i, t in rows], "doc_id long, text string, n int, score double, block int")
    want, _, _ = by_counts(rows, lambda i: i == 2, 3, [20.0, 5.0])
    got = [tuple(r) for r in lm.language_model_scores(df, F.col("doc_id") == 2).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert [g[:5] for g in sorted(got, key=key)] == [w[:5] for w in sorted(want, key=key)]
    assert [g[6] for g in sorted(got, key=key)] == pytest.approx([w[6] for w in sorted(want, key=key)])
    none = lm.language_model_scores(df, F.lit(True)).agg(F.sum("n_known"), F.sum("train_tokens"), F.max("base_score"), F.min("base_score")).first()
    assert tuple(none) == (0, 0, 0.0, 0.0)


def test_packing_of_numbers():
    for values in ([], [0], [255, 256, 0], [2**40 + 3, 7], [2**63 - 1]):
        assert lm.unpacked(lm.packed(np.array(values, np.int64)), len(values)).tolist() == values


# ---- importance resampling ----


def plain_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_running_checksums_equal_those_of_whole_features(corpus, n):
    for text in [t for _, t in corpus] + ["", "9to5 Äpfel, ÄPFEL x　y", "a-b_c", "\x00\x7f"]:
        want, words = plain_features(text, n)
        got, count = importance.features((text or "").encode(), n)
        assert count == words and sorted(got) == sorted(zlib.crc32(f.encode()) for f in want)


def test_resampling_equals_plain_version(spark, docs, corpus):
    target = [(0, None), (1, corpus[20][1]), (2, "one two one two")]
    got = importance.resampled(docs, spark.createDataFrame(target, "item_id long, text string"), percent=40, least_words=5, buckets=50)
    bucket = lambda f: zlib.crc32(f.encode()) % 50
    s = collections.Counter(bucket(f) for _, t in corpus for f in plain_features(t, 2)[0])
    t_ = collections.Counter(bucket(f) for _, t in target for f in plain_features(t, 2)[0])
    gain = {b: math.floor(1000 * math.log((t_[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t_.total() + 50)))) for b in range(50)}
    rows = []
    for i, t in corpus:
        f, words = plain_features(t, 2)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    drawn = sorted((r for r in rows if r[4] >= 5), key=lambda r: (-r[3], r[0], -r[1]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(drawn, 1):
        rank[r].append(k if k <= len(drawn) * 40 // 100 else None)
    want = [(*r[:4], rank[r].pop() if rank[r] else None) for r in rows]
    order = lambda r: (r[0], r[4] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)


def test_resampling_of_edge_cases(spark, docs, no_docs):
    empty = spark.createDataFrame([], "text string")
    assert importance.resampled(no_docs, docs).count() == 0
    assert importance.resampled(docs, empty).where("rank is not null").count() > 0
    many = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("word " * 30).alias("text"), F.lit(1).alias("pos"), F.lit(1).alias("weight")).repartition(7)
    got = [r["rank"] for r in importance.resampled(many, empty).collect()]
    assert sorted(x for x in got if x) == list(range(1, 101))


# ---- Merkle manifest ----

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows, claims):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], H("".join(map(enc, r))), claims(r)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    trees = {}
    for n in names:
        by[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[n] = levels([r[1] for r in by[n]])
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, (name, leaf, claim) in enumerate(by[n]):
            own, siblings = claim or leaf, []
            for tree, j in ((trees[n], i), (top, k)):
                for level in tree[:-1]:
                    run = level[j // 16 * 16 : j // 16 * 16 + 16]
                    at = j % 16
                    siblings += run[:at] + run[at + 1 :]
                    own = H("".join([*run[:at], own, *run[at + 1 :]]))
                    j //= 16
            out.append((name, leaf, trees[n][-1][0], top[-1][0], H("".join(siblings)), own, own == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_case(spark, rows, parts, changed=()):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", leaf string, pos int").repartition(parts)
    claim = F.when(F.col("doc_id").isin(list(changed)), F.lit("0" * 64)) if changed else None
    got = merkle.manifest(df, claimed=claim)
    order = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r)
    want = plain_manifest(rows, lambda r: "0" * 64 if r[0] in changed else None)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)


def test_manifest(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 40}", "en", i, f"text {i}") for i in range(1200)]
    rows += [(None, None, None, None, None), (None, "big", "é", 3, ""), (7, "big", "en", 7, "text 7"), (7, "big", "en", 7, "text 7"), (5000, "", "en", 1, "Ä" * 50)]
    manifest_case(spark, rows, 5, changed=[3, 7, 40])


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    manifest_case(spark, [(i, "s", "en", 1, "t") for i in range(n)], 3)


def test_manifest_over_ragged_partitions(spark):
    """Sorted partitions that end anywhere give the tree of the whole."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        manifest_case(spark, [(i, "s" if i % 4 else f"t{i % 3}", None, 1, "t") for i in range(700)], 3)
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        manifest_case(spark, [(i, "s", None, 1, "t") for i in range(3 * 256 * 3)], 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_manifest_without_rows_and_proofs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none, proof=True).collect() == []
    rows = spark.createDataFrame([(i, f"s{i % 2}", "en", 1, "t") for i in range(40)], SCHEMA)
    for r in merkle.manifest(rows, proof=True).collect():
        own = r["leaf"]
        for step in r["proof"]:
            own = H("".join([*step["siblings"][: step["at"]], own, *step["siblings"][step["at"] :]]))
        assert own == r["root"] and r["verified"]


@pytest.mark.parametrize("module, query", [(importance, "op12_importance_resampling"), (merkle, "op13_merkle_manifest")])
def test_sql_forms(spark, small, module, query):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    result = con.execute(module.SQL)
    got = getattr(module, query)(spark, small)
    assert got.columns == [c[0] for c in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
