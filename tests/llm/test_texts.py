import collections
import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, fingerprints, packing, sharding, shingles, suffix_dedup
from corpusloom.llm.common import text_bytes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def encoded(texts):
    ids, bounds, _, _ = bpe.encode_block(*text_bytes(pa.array(texts, pa.string())), bpe.slice_cache(RANKS))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="  \n\t'''sstmdrevelLab1२é!.— 　中\U0001f600", max_size=40), min_size=1, max_size=5))
def test_pre_tokens_and_merges(texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for text, ids in zip(texts, encoded(texts)):
        assert ids == enc.encode_ordinary(text)
        assert bpe.decode_ids(np.array(ids, np.int64), RANKS) == text.encode()


def test_long_slices(encoding):
    texts = ["a" * 5000, "ab" * 400 + " " * 300 + "x", "x" * 49, "é" * 70]
    assert encoded(texts) == [encoding.encode_ordinary(t) for t in texts]


def test_round_trip_of_tables(docs, corpus, encoding):
    want = collections.Counter((i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in corpus)
    rows = bpe.bpe_encode(docs, RANKS, round_trip=True, keep_offsets=True).collect()
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in rows) == want
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((t or "").encode() for _, t in corpus)


def test_shards(docs, no_docs, corpus):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len((t or "").encode()) + 1) for i, t in corpus)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in corpus}
    assert all(r.text_crc32 == crc[r.doc_id] for r in rows)
    for s in range(4):
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shard_by_bytes(no_docs, 4).count() == 0


def test_shards_are_near_equal_and_split_copies(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(3000)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


def test_packing(docs, no_docs, corpus):
    tokenizer = tokenizers.Tokenizer.from_file(JSON)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in corpus}
    rows = packing.packed_documents(docs, JSON).collect()
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in corpus)
    places = collections.defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id]) and r.length * 4 == len(piece)
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(no_docs, JSON).count() == 0


def test_short_slices_are_merged_without_the_library(tmp_path):
    """Ids of slices equal the library's, which is asked for long ones alone, or for all where the file says more than merges."""
    rng = np.random.default_rng(12)
    parts = [*"aeinrst", "th", "ing", "é", "ñ", "漢", "\U0001f600", "zq", "'", "-", "1"]
    data, offsets = text_bytes(pa.array([" " * (k % 2) + "".join(rng.choice(parts, rng.integers(1, 40))) for k in range(3000)]))
    starts, _ = bpe.slices(data, offsets)
    pieces = [data[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(data)])] + [b"x", b" ", b"\0", b" " * 64, b"na" * 32, b"na" * 33, b"-" * 500]
    with open(JSON, encoding="utf-8") as f:
        file = json.load(f)
    names = list(file["model"]["vocab"])
    shuffled = dict(zip(names, rng.permutation(len(names)).tolist()))
    files = {"plain": file, "shuffled": file | {"model": file["model"] | {"vocab": shuffled}, "added_tokens": []}, "whole": file | {"model": file["model"] | {"ignore_merges": True}}}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content), encoding="utf-8")
        cache = packing.LibraryCache(str(tmp_path / name))
        asked, library = [], cache.by_library
        cache.by_library = lambda x: asked.extend(x) or library(x)
        want = [np.array(x.ids, "<u4").tobytes() for x in cache.tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False)]
        assert cache.merged(pieces) == want
        assert asked == [p for p in pieces if name == "whole" or len(p) > 64]


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 200, 3000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    used = collections.Counter()
    windows = packing.plan(histogram, 200)
    for own, times in windows:
        assert sum(own) <= 200
        for x in own:
            used[x] += times
    assert used == histogram
    assert sum(times for _, times in windows) <= 1.02 * sum(k * v for k, v in histogram.items()) / 200 + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fill_is_the_best_subset(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    used = packing.fill(counts, room)
    assert all(used[k] <= counts[k] for k in used) and sum(k * n for k, n in used.items()) == max(sums)


def test_span_index():
    points = np.array([ord(c) for c in "abracadabra abracadabrX"], np.uint32)
    index = fingerprints.SpanIndex(points)
    for a in range(len(points)):
        for b in range(len(points)):
            want = 0
            while max(a, b) + want < len(points) and points[a + want] == points[b + want]:
                want += 1
            assert index.extension(a, b) == want


def test_fingerprints(docs, no_docs, corpus):
    rows = sorted(fingerprints.edited_fingerprints(docs, 4).collect(), key=lambda r: r.doc_id)
    ordered = sorted(((i, t or "") for i, t in corpus))
    assert [r.doc_id for r in rows] == [i for i, _ in ordered]
    by_text = {}
    for k, ((_, text), row) in enumerate(zip(ordered, rows)):
        follows = ordered[(k + 1) % len(ordered)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + follows[:q]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprints.fingerprints([text])[0] and row.edited_fingerprint == fingerprints.fingerprints([edited])[0]
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    assert len(set(by_text.values())) == len(by_text)
    assert fingerprints.edited_fingerprints(no_docs, 4).count() == 0


def test_likeness_follows_edits():
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(800))
    one, other = text[:2000] + "inserted" + text[2000:], "".join(rng.permutation(list(text)))
    a, b, c = fingerprints.fingerprints([text, one, other])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.05


def test_shingles_of_words():
    texts = ["A b\tc d", "a B c D", "a b", "a  b", "", " ", "x y z x y z"]
    sets = shingles.shingle_sets(*text_bytes(pa.array(texts)), 3)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 3]
    assert np.array_equal(sets[0], sets[1]) and np.array_equal(sets[2], sets[3])


def without(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        out.append((len(d), int(gone.sum()), int(opens.sum()), np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("most", [6000, 2])
def test_repeats_are_removed(docs, corpus, most):
    want = collections.Counter((i, *w) for (i, _), w in zip(corpus, without([t for _, t in corpus], 100)))
    got = suffix_dedup.without_repeats(docs, length=100, seed=20, most=most).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_repeats_beyond_four_mebibytes(spark):
    rng = np.random.default_rng(2)
    text = lambda n: (rng.integers(97, 123, n, dtype=np.uint8)).tobytes().decode()
    passage, over = text(700), (1 << 22) + 5000
    rows = [(0, text(over) + passage + text(3000)), (1, text(50) + passage + text(60)), (2, text((1 << 22) - 350) + passage + text(10))]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), as_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {i: (len(t), 700, 1) for i, t in rows}
    assert {r.doc_id: r.kept for r in got} == {i: t.replace(passage, "") for i, t in rows}


def without_passages(texts, length, words):
    """``without`` and the same for runs of ``words`` words, with what follows them up to the next word."""
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    low = [(t or "").encode().lower() for t in texts]  # of bytes: A-Z alone
    names = [[tuple(d[a:b] for a, b in own[i : i + words]) for i in range(len(own) - words + 1)] for d, own in zip(low, found)]
    seen = collections.Counter(x for own in names for x in own)
    strings = collections.Counter(t[i : i + length] for t in ((t or "").encode() for t in texts) for i in range(len(t) - length + 1))
    out = []
    for t, own, runs in zip(texts, found, names):
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone[i : i + length] = True
        for i, x in enumerate(runs):
            if seen[x] > 1:
                gone[own[i][0] : own[i + words][0] if i + words < len(own) else len(d)] = True
        out.append(np.frombuffer(d, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("most", [6000, 2])
def test_passages_of_words_are_removed(spark, corpus, most):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aBcé"), rng.integers(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(40)
    rows = list(corpus) + [(60, "A b " * 200), (61, "x" * 5), (62, " \n"), (63, None)]
    for i in range(70, 100):  # parts of one passage, of various lengths, in other letters and lines
        a, b = sorted(rng.integers(0, 41, 2))
        own = text(int(rng.integers(0, 30))) + passage[a:b] + text(int(rng.integers(0, 9)))
        own = " ".join(own) if i % 3 else "\n".join(own).upper()
        rows.append((i, own + "  " * (i % 2)))
    want = collections.Counter(zip([i for i, _ in rows], without_passages([t for _, t in rows], 100, 15)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.without_repeats(df, length=100, seed=20, most=most, words=15, words_seed=4).collect()
    assert collections.Counter((r.doc_id, bytes(r.kept)) for r in got) == want
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in got)


def test_short_passages_of_many_words(spark):
    """A passage of over 50 words that has fewer than 400 bytes goes in the pipeline, one of 50 words stays."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))
    passage, shorter = text(51), text(50)
    assert len(passage) < 400
    own = [text(80) for _ in range(6)]
    rows = [
        (1, f"{own[0]}\n\n{passage} {own[1]}"), (2, f"{passage.capitalize()}\n{own[2]}"), (3, f"{own[3]} {passage.replace(' ', chr(10), 20)}"),
        (4, f"{own[4]} {shorter}"), (5, f"{shorter} {own[5]}"), (6, ""), (7, None),
    ]
    want = {1: f"{own[0]}\n\n{own[1]}", 2: own[2], 3: f"{own[3]} ", 4: rows[3][1], 5: rows[4][1], 6: "", 7: ""}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_nothing_to_remove(no_docs):
    assert suffix_dedup.without_repeats(no_docs).count() == 0
    assert suffix_dedup.without_repeats(no_docs, words=51).count() == 0


def test_collection_order():
    strings = [b"abc", b"ab", b"abd", b"", b"b", b"abc"]
    rank, lcp = suffix_dedup.collection_order(strings, np.array([1, 1, 1, 1, 1, 2]))
    assert rank.tolist() == [2, 1, 3, 0, 4, 5] and lcp.tolist() == [-1, 0, 2, 2, 0, -1]


@pytest.mark.parametrize("text", ["ab" * 5000, "0123456789" * 500, "one line that comes again and again\n" * 300, "a" * 400_000, "ab" * 100, "0123456789abcdef" * 6])
def test_likeness_of_repetitive_texts(text):
    """Three quarters of the text stay, and so its likeness to the edited text is near three quarters, whatever takes the place of the rest."""
    rng = np.random.default_rng(7)
    other = "".join(rng.choice(list("abcdefghijklmnop "), len(text)))
    edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
    shorter = text[: len(text) - len(text) // 4] + other[:20]
    a, b, c, d = fingerprints.fingerprints([text, edited, other, shorter])
    assert 0.6 < fingerprints.likeness(a, b) <= 0.8 and fingerprints.likeness(a, c) < 0.05
    assert fingerprints.likeness(a, d) > 0.6 and fingerprints.likeness(a, a) == 1


def test_repeats_in_texts_of_low_entropy(spark):
    """Texts that repeat themselves give a row for each run, not for each byte; results equal a plain search, also where others share a part."""
    rng = np.random.default_rng(11)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    texts = ["a" * 3000, "ab" * 900, "a" * 99 + "b" + "a" * 150, noise(300) + "xyz" * 70 + noise(200), "xyz" * 40 + noise(100), "c" * 101, "c" * 100 + "d", noise(90) + "e" * 100, ("0123456789" * 12 + noise(30)) * 3, "a" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most in (6000, 3):
        got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.without_repeats(df, length=100, seed=20, most=most).collect()}
        starts = collections.Counter(t[i : i + 100] for t in texts for i in range(len(t) - 99))
        for i, t in enumerate(texts):
            gone = [False] * len(t)
            for p in range(len(t) - 99):
                if starts[t[p : p + 100]] > 1:
                    gone[p : p + 100] = [True] * 100
            assert got[i] == "".join(c for c, g in zip(t, gone) if not g), i
    data = np.frombuffer(b"a" * 4_000_000 + b"xyz" * 200_000, np.uint8)
    owner, *_, weight = suffix_dedup.anchors(data, np.array([0, 4_000_000, 4_600_000]), 400, 50)
    assert len(owner) < 10 and weight.sum() > 4_000_000
    long = spark.createDataFrame([(1, "a" * 4_000_000), (2, "b")], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(long).collect()} == {1: (4_000_000, 1), 2: (0, 0)}
