"""Keyed tables, fields of documents, calls and results, records in files, routes of files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify, keyed, maintenance, messages, vectors
from corpusloom.sources import readers
from corpusloom.streaming import calls

SCHEMA = "k long, part string, value string, version long"


def rows(spark, data, deleted=None):
    df = spark.createDataFrame(data, SCHEMA)
    return df if deleted is None else df.withColumn("_deleted", F.lit(deleted))


def held(table):
    return sorted(map(tuple, table.latest().collect()))


def test_versions_compaction_and_failed_writes(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", "version", SCHEMA)
    assert held(table) == []
    table.append(rows(spark, [(1, "a", "x", 1), (2, "a", "y", 5), (3, "b", "z", 1)]))
    table.append(rows(spark, [(1, "a", "x2", 2), (2, "a", "late", 4), (3, "b", "z again", 1)]))
    assert held(table) == [(1, "a", "x2", 2), (2, "a", "y", 5), (3, "b", "z again", 1)]
    table.append(rows(spark, [(1, "a", "", 3)], True))
    table.append(rows(spark, [(1, "a", "old", 2)]))
    assert held(table) == [(2, "a", "y", 5), (3, "b", "z again", 1)]
    table.compact()
    assert len(table.commits()) == 1 and held(table) == [(2, "a", "y", 5), (3, "b", "z again", 1)]
    table.replaced(rows(spark, [(4, "a", "new", 7), (5, "a", "new", 7)]), "part")
    assert held(table) == [(3, "b", "z again", 1), (4, "a", "new", 7), (5, "a", "new", 7)]
    table.append(rows(spark, [(2, "a", "y", 6)]))  # older than its deletion
    assert [r[0] for r in held(table)] == [3, 4, 5]
    monkeypatch.setattr(type(spark.range(0).write), "mode", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.append(rows(spark, [(9, "c", "lost", 9)]))
    monkeypatch.undo()
    assert [r[0] for r in held(table)] == [3, 4, 5]


def test_random_replays(spark, tmp_path):
    rng = random.Random(3)
    table, best = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", "version", SCHEMA), {}
    for batch in range(5):
        data = {k: (k, "p", f"{batch}", rng.randint(1, 6)) for k in rng.sample(range(12), 6)}
        deleted = batch == 3
        table.append(rows(spark, list(data.values()), deleted))
        for k, r in data.items():
            if k not in best or r[3] >= best[k][0][3]:
                best[k] = r, deleted
    assert held(table) == sorted(r for r, gone in best.values() if not gone)


def test_fields(spark):
    prefixes = spark.createDataFrame([(1, "01", "GB500"), (1, "01", "GB/T50"), (2, "02", "CJJ"), (8, "08", "GB5001")], "ord int, code string, prefix string")
    words = spark.createDataFrame([(1, "01", "roof"), (1, "01", "wall"), (2, "02", "water"), (2, "02", "wall"), (8, "08", "fire")], "ord int, code string, word string")
    docs = [
        (1, "[GB50016-2014] roof water fire", "", "01"), (2, "[CJJ 1] x", "", "02"), (3, "[CJJ1] x", "", "02"), (4, "[GB5] x", "", "01"), (5, "Water and WALL", "", "02"), (6, "wall", "", "01"),
        (7, "none", "FIRE fire wall roof", "01"), (8, "none", "x" * 5000 + "fire", "99_其他"), (9, None, None, "99_其他"), (10, "[GB/T501] x", "", "01"),
    ]
    got = {r.doc_id: r.code for r in classify.classified(spark.createDataFrame([d[:3] for d in docs], "doc_id long, name string, text string"), prefixes, words).collect()}
    assert got == {d[0]: d[3] for d in docs}
    empty = words.limit(0)
    assert {r.code for r in classify.classified(spark.createDataFrame([(1, "x", "y")], "doc_id long, name string, text string"), prefixes.limit(0), empty).collect()} == {"99_其他"}


def test_table_function_equals_columns(spark):
    calls.register(spark)
    text = "found:\n[1] Law (doc: d1, page: 3)\nbody one\n[2] Law (doc: d1, page: 4)\nmore\n[x] no\n[3] Act (doc: d2, page: 0)\nx"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = spark.sql("SELECT id, b.* FROM {df}, LATERAL tool_blocks(text) b ORDER BY n", df=df)
    assert [tuple(r) for r in got.collect()] == [(1, 1, "Law", "d1", 3, "body one"), (1, 2, "Law", "d1", 4, "more\n[x] no"), (1, 3, "Act", "d2", 0, "x")]
    assert [r.n for r in messages.tool_sources(df).orderBy("n").collect()] == [1, 3]
    named = messages.first_by_name(got, "id", order="n")
    assert [r.n for r in named.orderBy("n").collect()] == [1, 3]


def test_calls_and_results_as_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(5)
    events = [(i, start + datetime.timedelta(seconds=20 * i), rng.choice([1, 2]), rng.choice(["call", "result", "other"])) for i in range(120)]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    batch = spark.createDataFrame(events, schema)
    of = lambda df, kind: df.where(F.col("event_type") == kind)
    want = {(r.call_event_id, r.result_event_id) for r in calls.correlated(of(batch, "call"), of(batch, "result"), "user_id", 60).collect()}
    plain = {(i, j) for i, t, u, k in events if k == "call" for j, s, v, m in events if m == "result" and u == v and t <= s <= t + datetime.timedelta(seconds=60)}
    assert {p for p in want if p[1] is not None} == plain and {i for i, _ in want} == {e[0] for e in events if e[3] == "call"}
    last = [(900, start + datetime.timedelta(days=1), 9, "call"), (901, start + datetime.timedelta(days=1), 9, "result")]  # move the watermarks on
    for part in (events[:60], events[60:], last, [(902, start + datetime.timedelta(days=2), 9, k) for k in ("call", "result")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = calls.correlated(of(stream(), "call"), of(stream(), "result"), "user_id", 60).writeStream.format("memory").queryName("correlated").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = {(r.call_event_id, r.result_event_id) for r in spark.table("correlated").collect() if r.call_event_id < 900}
    assert got == want


def test_records_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": "wrong"}\n{"x": 2, "more": 3}\n')
    (tmp_path / "b.jsonl").write_text('[1]\n{"x": null}\n{"x": 7')
    good, bad = readers.json_records(spark, str(tmp_path), "x int")
    assert sorted((r.file[-7:], r.record.x) for r in good.collect()) == [("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", None)] or sorted(str(r.record.x) for r in good.collect()) == ["1", "2", "None"]
    assert sorted(r.line for r in bad.collect()) == sorted(["not json", '{"x": "wrong"}', "[1]", '{"x": 7'])
    order = [r.record.x for r in good.where(F.endswith("file", F.lit("a.jsonl"))).orderBy("at").collect()]
    assert order == [1, 2]


def test_routes_and_guards(spark):
    files = spark.createDataFrame([(1, "h1", "layer " * 9, None), (2, "h2", "short", "ocr"), (3, "h3", None, None), (4, None, "layer " * 9, "ocr")], "id int, content_hash string, layer_text string, ocr_text string")
    cache = spark.createDataFrame([("h1", "v2", "cached"), ("h1", "v2", "cached"), ("h2", "v1", "old")], "content_hash string, version string, text string")
    assert {r.id: (r.route, r.text) for r in readers.parse_route(files, cache, "v2").collect()} == {1: ("cache", "cached"), 2: ("ocr", "ocr"), 3: ("error", None), 4: ("text_layer", "layer " * 9)}


def test_reranking_and_its_failures(spark):
    hits = spark.createDataFrame([(q, 10 * q + i, 1.0 - i / 10, i + 1) for q in (1, 2, 3) for i in range(4)], "query_id long, vec_id long, score double, rank long")
    said = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.9), (1, 9, 1.0), (1, 3, None), (3, 50, 0.5)], "query_id long, index int, relevance double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.source) for r in vectors.reranked(hits, said, 3).collect())
    assert got == [(1, 1, 10, "rerank"), (1, 2, 12, "rerank")] + [(q, i + 1, 10 * q + i, "first") for q in (2, 3) for i in range(3)]


def test_appended_ids_and_summaries(spark):
    held_ = spark.createDataFrame([("a", 5), ("a", 2), ("a", 5)], "source string, doc_id long")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("b", 9)], "source string, doc_id long")
    assert sorted(map(tuple, maintenance.appended(held_, new, "source").collect())) == [("a", 1, 2), ("a", 2, 0), ("a", 5, 1), ("b", 9, 0)]
    got = maintenance.summarized(spark.createDataFrame([("a", i) for i in range(5)], "source string, doc_id long"), "source", "doc_id", 3).first()
    assert (got.total, got.names, got.more) == (5, [0, 1, 2], 2)
