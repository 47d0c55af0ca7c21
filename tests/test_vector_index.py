"""The stored index of vectors, and searches with more queries than are broadcast."""

import numpy as np
import pytest

from corpusloom.operators import vector_index as V
from corpusloom.operators import vectors


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 12))
    x = np.concatenate([c + 0.4 * rng.standard_normal((60, 12)) for c in centers] + [rng.standard_normal((80, 12))])
    x[50:56] = x[50]  # equal vectors
    return [(i, v.tolist()) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = []
    for q, v in queries:
        v = np.array(v, np.float32).astype(float)
        s = np.round(x @ v / np.linalg.norm(x, axis=1) / np.linalg.norm(v), 4) + 0.0
        best = np.lexsort((ids, -s))[:k]
        out += [(q, int(ids[b]), float(s[b]), r + 1) for r, b in enumerate(best)]
    return sorted(out)


def asked(spark, queries):
    return spark.createDataFrame(queries, "query_id long, embedding array<float>")


def found(df):
    return sorted((r.query_id, r.vec_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("group", [40])
def test_exact_search_equals_all_rows(spark, points, tmp_path, monkeypatch, group):
    monkeypatch.setattr(V, "GROUP_ROWS", group)
    index = V.built(frame(spark, points[:300]), str(tmp_path / "i"), model="m", dim=12, cells=9)
    queries = points[::11]
    assert found(V.searched(index, asked(spark, queries), 6, probes=2, exact=True)) == brute(points[:300], queries, 6)
    more = V.extended(index, frame(spark, points[300:]), model="m")
    again = V.loaded(spark, str(tmp_path / "i"))
    assert len(again.batches) == 2 and again.batches == more.batches
    assert found(V.searched(again, asked(spark, queries), 6, probes=2, exact=True)) == brute(points, queries, 6)
    audit = V.audited(again, asked(spark, queries), 6, probes=3).first()
    assert audit.asked == 6 * len(queries) and 0 < audit.recall <= 1
    probes, recall = V.probes_for(again, asked(spark, queries), 6, least_recall=0.99, start=1)
    assert recall >= 0.99 and 1 <= probes <= 9
    gone = V.removed(again, frame(spark, points[::3]))
    left = [p for i, p in enumerate(points) if i % 3]
    assert found(V.searched(gone, asked(spark, queries), 6, probes=1, exact=True)) == brute(left, queries, 6)
    back = V.extended(gone, frame(spark, points[:1]))
    assert found(V.searched(back, asked(spark, queries), 6, probes=1, exact=True)) == brute(points[:1] + left, queries, 6)
    small = V.compacted(back, str(tmp_path / "j"), cells=3)
    assert len(small.batches) == 1 and not small.removals
    assert found(V.searched(small, asked(spark, queries), 6, probes=1, exact=True)) == brute(points[:1] + left, queries, 6)


def test_what_an_index_refuses(spark, points, tmp_path):
    index = V.built(frame(spark, points[:40]), str(tmp_path / "i"), model="m", dim=12)
    for bad in ([0.0] * 12, [1.0] * 11, None, [float("nan")] * 12, [None] * 12, [float("inf")] * 12):
        with pytest.raises(ValueError):
            V.extended(index, frame(spark, [(900, bad)]))
    with pytest.raises(ValueError):
        V.extended(index, frame(spark, points[41:42]), model="other")
    with pytest.raises(ValueError):
        V.extended(index, frame(spark, points[:1]))
    assert V.searched(index, asked(spark, []), 3).count() == 0


def test_index_without_rows(spark, points, tmp_path):
    index = V.built(frame(spark, []), str(tmp_path / "i"), model="m", dim=12)
    assert V.searched(index, asked(spark, points[:2]), 3, exact=True).count() == 0
    index = V.extended(index, frame(spark, points[:5]))
    assert found(V.searched(index, asked(spark, points[:2]), 3, exact=True)) == brute(points[:5], points[:2], 3)


def test_failed_batch_is_not_read(spark, points, tmp_path, monkeypatch):
    index = V.built(frame(spark, points[:40]), str(tmp_path / "i"), model="m", dim=12)
    monkeypatch.setattr(V, "committed", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        V.extended(index, frame(spark, points[40:80]))
    again = V.loaded(spark, str(tmp_path / "i"))
    assert V.postings(again).count() == 40


def test_scored_in_groups(spark, points):
    queries = points[::9]
    got = vectors.scored(asked(spark, queries), frame(spark, points).repartition(3), 4, most_bytes=2000)
    assert found(got) == brute(points, queries, 4)
