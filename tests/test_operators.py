import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluation, findings, maintenance, messages, structure, textsearch, vectors


def test_rank_order_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)] + [(200, None), (201, [0.0] * 8), (202, [1.0] * 3)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.scored(e.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), e, 7).orderBy("query_id", "rank").collect()
    x = np.array([r[1] for r in rows[:200]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        s = np.round(x @ x[q], 4)
        want = np.lexsort((np.arange(200), -s))[:7].tolist()
        assert [r.vec_id for r in got if r.query_id == q] == want


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_queries_in_blocks(spark, metric):
    """Blocks of queries give what one block gives; groups, ties, text ids, null and non-finite vectors."""
    rng = np.random.default_rng(3)
    rows = [(f"v{i % 90:02}", "ab"[i % 2] if i % 7 else None, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(120)]
    rows += [("n1", "a", None), ("n2", "a", [1.0, float("nan"), 0.0]), ("n3", "a", [float("inf"), 0.0, 0.0]), ("n4", "b", [1.0])]
    e = spark.createDataFrame(rows, "vec_id string, g string, embedding array<float>").repartition(3)
    queries = [(name, v) for name, _, v in rows[:40] + rows[-4:]]
    asked = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    ask = lambda **more: sorted(map(tuple, vectors.scored(asked, e, 4, metric=metric, group_col="g", other_than_self=True, **more).collect()), key=str)
    got = ask()
    assert got == ask(most_bytes=200)
    want = []
    sound = lambda v: v is not None and np.isfinite(v).all()
    for query, u in (q for q in queries if sound(q[1])):
        for g in ("a", "b", None):
            found = []
            for name, group, v in rows:
                if group == g and name != query and sound(v) and len(v) == len(u):
                    x, y = np.array(u), np.array(v)
                    scale = np.linalg.norm(x) * np.linalg.norm(y)
                    found.append((name, round(x @ y / scale if scale else 0.0, 4) if metric == "cosine" else round(float(np.linalg.norm(x - y)), 4)))
            found.sort(key=lambda f: (-f[1] if metric == "cosine" else f[1], f[0]))
            want += [(query, f[0], g, float(f[1] + 0.0), r + 1) for r, f in enumerate(found[:4])]
    assert got == sorted(want, key=str)


def test_keywords_in_one_pass(spark):
    pages = spark.createDataFrame(
        [("k", 1, 0, "Has KEY"), ("k", 1, 1, "iec-61547"), ("a", 2, 0, "iec 61547"), ("b", 3, 0, None), ("b", 3, 1, "nothing"), ("c", 4, 0, "key"), ("c", 4, 0, "key")], "kb_id string, doc_id long, page long, text string"
    )
    got = textsearch.keyword_union(pages, ["", "IEC61547", "key"], most=9)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(2, "IEC61547", 1), (1, "IEC61547", 2), (4, "key", 3)]
    assert textsearch.keyword_union(pages, [""]).count() == 0 and textsearch.keyword_union(pages.limit(0), ["key"]).count() == 0


def test_failure_lines_hold_few(spark):
    rows = [("x", f"n{i:02}", "bad" if i % 2 else "ok") for i in range(20)] + [(None, "m", "bad"), ("y", "z", "ok")]
    got = {r.g: r.summary for r in maintenance.failure_line(spark.createDataFrame(rows, "g string, name string, outcome string"), "g").collect()}
    assert got == {"x": "10/20 (n01: bad；n03: bad；n05: bad；…)", None: "1/1 (m: bad)", "y": "0/1 ()"}


def test_average_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 7, 7, 7, *range(30)])) for _ in range(600)]
    got = {(r.g, r.v): r["rank"] for r in evaluation.average_ranks(spark.createDataFrame(rows, "g string, v long"), "v", "g", ranges=8).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(-1 if v is None else v for h, v in rows if h == g)
        for v in set(own):
            at = [i + 1 for i, w in enumerate(own) if w == v]
            want[g, None if v == -1 else v] = sum(at) / len(at)
    assert got == want


def test_embedding_failures_are_rows(spark):
    def embed(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[1.0, 2.0] for _ in texts]

    rows = vectors.embedded(spark.createDataFrame([("bad",)], "text string").union(spark.createDataFrame([("ok",)], "text string")), embed, dim=2).collect()
    assert {r.text: r.error is None for r in rows} == {"bad": False, "ok": True}


def test_first_page_and_tolerance(spark):
    pages = spark.createDataFrame([("k", 1, 0, "no"), ("k", 1, 1, "Has KEY"), ("k", 1, 2, "key"), ("k", 2, 0, "iec-61547")], "kb_id string, doc_id long, page long, text string")
    assert [(r.doc_id, r.page) for r in textsearch.first_pages(pages, "key").collect()] == [(1, 1)]
    assert [(r.doc_id, r.page) for r in textsearch.first_pages(pages, "IEC61547").collect()] == [(2, 0)]
    assert textsearch.first_pages(pages, "").count() == 0


def test_chunks_keep_every_line(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"w{i} x y" for i in range(50))), (2, "short"), (3, None)], "doc_id long, text string")
    got = chunking.line_chunks(docs, tokens=20).orderBy("doc_id", "chunk").collect()
    assert "\n".join(r.text for r in got) == docs.first().text and {r.doc_id for r in got} == {1}


def test_block_range_fuzzy(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "abcdefghijklmnopqrstuv")], "doc_id long, chunk long, page_number int, text string")
    blocks = spark.createDataFrame([(1, 0, 3, "abcdefghijkXmnopqrstuv"), (1, 0, 5, "hijkl"), (1, 0, 7, "nothing"), (1, 1, 9, "abc")], "doc_id long, page int, block_order int, block_content string")
    assert tuple(chunking.block_ranges(chunks, blocks).first()) == (1, 0, 3, 5)
    assert tuple(chunking.block_ranges(chunks, blocks, fuzzy=False).first()) == (1, 0, 5, 5)


def test_guard_matches_sequential_reading(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["same  text here", "same text here", "other text too", "ab", "cd"])) for i in range(40)]
    kept, seen = [], set()
    for _, i, s in rows:
        key = " ".join(s.split())
        key = key if len(key) >= 10 else f"at:{i % 3}"
        if key not in seen:
            seen.add(key)
            kept.append(i)
    df = spark.createDataFrame([(c, i, s, i % 3) for c, i, s in rows], "c long, i long, s string, p long")
    assert sorted(r.i for r in findings.guarded(df, "c", order="i", excerpt="s", position="p").collect()) == kept


def test_dedupe_joins_suggestions(spark):
    rows = [(1, "a", "low", "x", "s1", None), (2, "a", "high", "x", "s2", None), (3, "b", "high", "y", None, "d"), (4, "b", "high", None, "z", "d")]
    df = spark.createDataFrame(rows, "id long, type string, severity string, excerpt string, suggestion string, description string")
    got = {r.excerpt_key: (r.id, r.suggestion, r.n_merged) for r in findings.deduplicated(df).collect()}
    assert got == {"x": (2, "s1；s2", 2), "y": (3, None, 1), "d": (4, "z", 1)}


def test_link_priority(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    a = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "item_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 12, 0), (2, 13, 5)], "item_id long, doc_id long, rank long")
    assert {r.item_id: (r.doc_id, r.strategy) for r in findings.linked(items, a, b).collect()} == {1: (11, 0), 2: (13, 1), 3: (None, None)}


def test_reparse_reasons(spark):
    rows = [(1, "none", True, 1), (2, "embedded", False, 1), (3, "embedded", True, 0), (4, "embedded", True, 2), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, embedding_status string, has_pages boolean, n_layout int")
    got = {r.doc_id: r.reason for r in maintenance.reparse_targets(df).collect()}
    assert got == {1: "not_embedded", 2: "missing_pages", 3: "empty_layout", 5: "not_embedded"}
    assert maintenance.reparse_targets(df, force=True).count() == 5


def test_metrics_of_a_case(spark):
    results = spark.createDataFrame([(1, 1, "none"), (1, 2, "a b c"), (1, 3, "a b")], "case_id long, rank int, content string")
    expected = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["zz"]), (2, 0, ["a"])], "case_id long, expected_id int, keywords array<string>")
    got = {r.case_id: (r.precision, r.recall, r.rr) for r in evaluation.case_metrics(results, expected, 2).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}


def test_tables_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "a\n<table>\nx\n</table>\n\n\n\nb\nb")], "doc_id long, text string")
    lines = structure.without_tables(structure.lines_of(docs))
    assert [r.line for r in structure.merged_lines(lines).orderBy("pos").collect()] == ["a", "<TABLE>", "", "b"]


def test_sessions_count_from_their_start(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 01:59:00'), (1, TIMESTAMP '2024-01-01 02:00:01') AS v(k, ts)")
    assert [r.expired for r in messages.sessions(df, "k").orderBy("ts").collect()] == [False, False, True]
