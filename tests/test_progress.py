"""Streams with state against their forms over tables, deadlines against a plain search, sweeps."""

import datetime
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import deadlines, sweep
from corpusloom.streaming import progress as P

TERMINAL = {"done": "searchable", "broken": "failed"}


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, rows, schema, parts, folder, make, mode):
    """The rows of a stream over ``rows``, which come in ``parts`` files in order, a file a micro-batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/in")
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"out_{random.randrange(10**9)}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.table(name).collect()


def by_reading(rows):
    out, state = [], {}
    for key, at, value, what in rows:
        best, status = state.get(key, (0.0, "building"))
        if status != "building" and what == "begin":
            best, status = 0.0, "building"
        elif status == "building" and what in TERMINAL:
            best, status = 1.0, TERMINAL[what]
        elif status == "building" and what != "begin":
            best = max(best, min(1.0, max(0.0, value or 0.0)))
        state[key] = best, status
        out.append((key, at, best, status))
    return sorted(out)


def reports():
    rng = random.Random(4)
    return [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice([None, -1.0, 0.2, 0.5, 0.9, 1.5]), rng.choice(["report"] * 6 + ["begin", "done", "broken", None])) for i in range(240)]


def test_progress_of_tables(spark):
    df = spark.createDataFrame(reports(), "k long, event_id long, progress double, state string").repartition(3)
    got = P.batch_progress(df, key="k", terminal=TERMINAL)
    assert sorted(map(tuple, got.collect())) == by_reading(reports())
    assert P.batch_progress(df.limit(0), key="k", terminal=TERMINAL).count() == 0


def test_progress_of_streams(spark, tmp_path, rocksdb):
    got = streamed(spark, reports(), "k long, event_id long, progress double, state string", 4, tmp_path, lambda s: P.stream_progress(s, key="k", terminal=TERMINAL, ttl_ms=None), "append")
    assert sorted(map(tuple, got)) == by_reading(reports())


def fragments():
    rng = random.Random(6)
    return [(rng.randint(1, 3), i, rng.choice([0, 1, 2, None]), rng.choice([None, "", f"id{i}"]), rng.choice([None, "", f"f{i}"]), rng.choice([None, "", f"a{i} "])) for i in range(60)] + [(9, 99, 0, "only", "", "x")]


FRAGMENT = "conv long, turn long, index int, id string, name string, arguments string"


def calls_by_reading():
    out = {}
    for conv, _, i, id_, name, said in fragments():
        if i is not None:
            a, b, c = out.get((conv, i), ("", "", ""))
            out[conv, i] = id_ or a, name or b, c + (said or "")
    return {k: v for k, v in out.items() if v[0] and v[1]}


def test_calls(spark, tmp_path, rocksdb):
    df = spark.createDataFrame(fragments(), FRAGMENT).repartition(3)
    assert {(r.conv, r["index"]): tuple(r)[2:] for r in P.batch_calls(df, key="conv", order="turn").collect()} == calls_by_reading()
    rows = streamed(spark, fragments(), FRAGMENT, 3, tmp_path, lambda s: P.stream_calls(s, key="conv", order="turn", ttl_ms=None), "update")
    last = {}
    for r in rows:
        last[r.conv, r["index"]] = max(last.get((r.conv, r["index"]), ("", "", "")), tuple(r)[2:], key=lambda x: len(x[2]))
    assert {k: v[2] for k, v in last.items()} == {k: v[2] for k, v in calls_by_reading().items()}


EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def events():
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    times = sorted(rng.randint(0, 4000) for _ in range(300))
    return [(i, start + datetime.timedelta(seconds=s), rng.choice([1, 1, 1, 2, 3]), rng.choice(["view", "view", "purchase", "click"])) for i, s in enumerate(times)]


def first_by_reading(rows, seconds):
    out = []
    for i, at, user, kind in rows:
        if kind == "view":
            later = [(t, j) for j, t, u, k in rows if k == "purchase" and u == user and at <= t <= at + datetime.timedelta(seconds=seconds)]
            out.append((i, min(later)[1] if later else None))
    return sorted(out)


@pytest.mark.parametrize("seconds", [1, 7, 60, 3600])
def test_first_answers_within_a_limit(spark, seconds):
    e = spark.createDataFrame(events() + [(900, None, 1, "view"), (901, datetime.datetime(2024, 1, 1), None, "view"), (902, None, 1, "purchase")], EVENT).repartition(3)
    got = deadlines.first_within(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), seconds)
    assert sorted((r.event_id, r.answer_id) for r in got.collect()) == first_by_reading(events(), seconds) + [(900, None), (901, None)]
    assert {r.outcome for r in got.where("answer_id is null").collect()} <= {"timeout"}


def test_polls(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at, at, "answered"), (2, at, at + datetime.timedelta(milliseconds=1), "answered"), (3, at, at + datetime.timedelta(seconds=10), "answered"), (4, at, None, "timeout"), (5, at, at + datetime.timedelta(milliseconds=9900), "answered")]
    got = deadlines.polled(spark.createDataFrame(rows, "id int, ts timestamp, answer_ts timestamp, outcome string"), 3000, 10)
    assert {r.id: (r.polls, r.seen_ms) for r in got.collect()} == {1: (1, 0), 2: (2, 3000), 3: (4, None), 4: (4, None), 5: (4, None)}


def test_deadlines_of_streams(spark, tmp_path, rocksdb):
    last = (1000, datetime.datetime(2024, 1, 3), 1, "view")  # moves the watermark past all limits
    make = lambda s: P.stream_first_within(s, F.col("event_type") == "view", F.col("event_type") == "purchase", 60, late="1 minute")
    got = streamed(spark, [*events(), last], EVENT, 5, tmp_path, make, "append")
    assert sorted((r.event_id, r.answer_id) for r in got) == first_by_reading(events(), 60)
    assert Counter(r.outcome for r in got)["timeout"] == sum(a is None for _, a in first_by_reading(events(), 60))


def test_chunks_of_all_sizes_in_one_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([0, 1, 5, 8, 9, 30])] + [(9, None)], "doc_id long, text string")
    path = str(tmp_path / "t")
    first = sweep.stored_chunks(docs, path, [8], [0, 3])
    assert sweep.held_pairs(spark, path) == {(8, 0), (8, 3)} and first.count() > 0
    other = spark.createDataFrame([(77, "changed text")], "doc_id long, text string")
    both = sweep.stored_chunks(other, path, [8, 4], [0, 3, 8], renew=[(8, 3)])  # only what is missing or renewed is cut anew
    got = {(r.size, r.overlap, r.doc_id, r.chunk): r.text for r in both.collect()}
    want = {}
    for size, overlap in ((8, 0),):
        for i, n in enumerate([0, 1, 5, 8, 9, 30]):
            words = [f"w{i}x{k}" for k in range(n)]
            starts = range(0, max(n - overlap, 1), size - overlap) if n else []
            want |= {(size, overlap, i, c): " ".join(words[a : a + size]) for c, a in enumerate(starts)}
    want |= {(s, o, 77, 0): "changed text" for s, o in ((8, 3), (4, 0), (4, 3))}
    assert got == want
    with pytest.raises(ValueError):
        sweep.cut(docs, [(4, 4)])


def test_sweep_of_cases_without_words(spark):
    chunks = sweep.cut(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), [(2, 0)])
    cases = spark.createDataFrame([(1, ["ONE", "two"]), (2, ["", "none"]), (3, [])], "case_id int, keywords array<string>")
    got = sweep.swept(chunks, cases, [0.5, 0.9], [1]).orderBy("threshold").collect()
    assert [(r.precision, r.recall, r.mrr, r.results) for r in got] == [(0.5, 0.5, 0.5, 1), (0.5, 0.5, 0.5, 1)]


def test_more_pairs_take_no_more_room(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(900))) for i in range(40)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).rglob("*.parquet"))
    path = str(tmp_path / "t")
    sweep.stored_chunks(docs, path, [64, 128], [0, 16, 32, 48])
    assert size("t") < 1.2 * size("docs")
    chunks = sweep.stored_chunks(docs.where("doc_id < 20"), path, [64, 128], [0, 16, 32, 48], renew=[(s, o) for s in (64, 128) for o in (0, 16, 32, 48)])
    assert size("t") < 0.7 * size("docs") and chunks.agg(F.count_distinct("doc_id")).first()[0] == 20  # what nothing names any more is gone
    assert sweep.stored_chunks(docs, path, [8], [8]).count() == 0


def swept_by_reading(docs, cases, pairs, thresholds, top_ks, accept):
    chunks = defaultdict(list)
    for i, text in docs:
        words = (text or "").split()
        for s, o in pairs:
            chunks[s, o] += [(i, c, " ".join(words[a : a + s]).lower()) for c, a in enumerate(range(0, max(len(words) - o, 1), s - o))] if words else []
    asked = [list(dict.fromkeys(k.lower() for k in ks if k)) for _, ks in cases]
    asked = [ks for ks in asked if ks]
    out = {}
    for p, (t, k) in itertools.product(pairs, itertools.product(thresholds, top_ks)):
        told = []
        for ks in asked:
            best = sorted((-sum(w in text for w in ks) / len(ks), i, c) for i, c, text in chunks[p])
            shown = [-x for x, _, _ in best[:k] if x < 0 and -x >= t]
            right = [r for r, x in enumerate(shown, 1) if x >= accept]
            told.append((len(right) / len(shown), bool(right), 1 / right[0] if right else 0, len(shown)) if shown else (0, 0, 0, 0))
        n = len(asked)
        out[(*p, t, k)] = pytest.approx((*[sum(x) / n for x in list(zip(*told))[:3]], sum(x[3] for x in told)), abs=1e-6)
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sweep_equals_plain_reading(spark, tmp_path, kind):
    rng = random.Random(5)
    words = ["the", "There", "other", "a", "an", "tea", "ÑANDÚ", "ñandú", "she", "hers", "x-ray", "rare"]
    docs = [(i if kind == "long" else f"d{i}", rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n"]) for _ in range(rng.choice([0, 1, 9, 40, 90])))) for i in range(60)] + [(900 if kind == "long" else "e", None)]
    cases = [(i, rng.sample([*words, "the other", "a ", " she", "e r", "none", "he", "", "A  B"], rng.randint(0, 6))) for i in range(25)]
    frame, asked = spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3), spark.createDataFrame(cases, "case_id int, keywords array<string>")
    pairs, levels, tops = [(8, 0), (8, 3), (20, 0), (20, 3), (20, 13)], [0.3, 0.5, 1.0], [1, 4]
    want = swept_by_reading(docs, cases, pairs, levels, tops, 0.7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        texts = sweep.stored_texts(frame, str(tmp_path / "t"), [8, 20], [0, 3, 13])
        for got in (sweep.swept_texts(texts, asked, levels, tops), sweep.swept_texts(texts, asked, levels, tops, most_bytes=900), sweep.swept(sweep.cut(frame, pairs), asked, levels, tops, most_bytes=900)):
            rows = got.collect()
            assert {(r.size, r.overlap, r.threshold, r.top_k): (r.precision, r.recall, r.mrr, r.results) for r in rows} == want and sorted(r.place for r in rows) == list(range(1, 31))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
