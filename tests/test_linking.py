"""Links of findings, rectangles and stores on small tables."""

from pyspark.sql import functions as F

from corpusloom.functions import show
from corpusloom.operators import ingest, linking, stores, textsearch


def test_chunks_of_findings(spark):
    chunks = spark.createDataFrame(
        [("d", 0, 0, "emergency rescue centre", (1, 2)), ("d", 1, 1, "fire doors must close", (3, 3)), ("d", 1, 2, "no range", None), ("e", 0, 0, "fire doors must close", (9, 9))],
        "doc_id string, page_number long, ord long, text string, block_range struct<start:int,end:int>",
    )
    findings = spark.createDataFrame(
        [(1, "d", None, "Fire doors must c1ose"), (2, "d", 0, "Fire doors must close"), (3, "d", 1, ""), (4, "d", None, "no range"), (5, "x", None, "fire"), (6, "e", None, None)],
        "item_id long, doc_id string, page_number long, excerpt string",
    )
    got = {r.item_id: tuple(r.block_range) if r.block_range else None for r in linking.chunks_of_findings(findings, chunks).collect()}
    assert got == {1: (3, 3), 2: None, 3: (3, 3), 4: None, 5: None, 6: (9, 9)}


def test_sources_of_findings(spark):
    findings = spark.createDataFrame([(1, ["GB 7000-.202"], ["Lamps"]), (2, ["X1"], []), (3, [], ["Doors"]), (4, ["Z9"], []), (5, None, None)], "item_id long, numbers array<string>, names array<string>")
    texts = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "item_id long, doc_id string, ord long")
    near = spark.createDataFrame([(1, "a", 0, "nothing"), (2, "c", 3, "see X1"), (2, "z", 0, "see X1"), (3, "q", 1, "Doors"), (4, "q", 0, "none")], "item_id long, doc_id string, ord long, content string")
    catalog = spark.createDataFrame([("a", "notes"), ("b", "GB7000.202 lamps"), ("c", None)], "doc_id string, name string")
    got = {r.item_id: (r.doc_id, r.strategy) for r in linking.sources_of_findings(findings, texts, near, catalog).collect()}
    assert got == {1: ("b", 1), 2: ("c", 0), 3: ("q", 2), 4: (None, None), 5: (None, None)}


def test_highlights(spark):
    blocks = spark.createDataFrame(
        [("d", 0, 0, "Fire doors must close", [0.0, 0.5, 0.5, 1.0]), ("d", 0, 1, "fire", [0.0, 0.0, 0.0, 1.0]), ("d", 0, 2, "a long text of other things with fire doors", None), ("d", 1, 0, "Fire doors must close", [0.0, 0.0, 1.0, 1.0])],
        "doc_id string, page long, block_order long, block_content string, bbox_norm array<double>",
    )
    asked = spark.createDataFrame([("d", 0, "fire doors must c1ose"), ("d", 1, " ")], "doc_id string, page long, highlight string")
    got = linking.highlight_rectangles(asked, blocks, F.lit(100.0), F.lit(200.0)).collect()
    assert [(r.block_order, tuple(r.r)) for r in got] == [(0, (0.0, 100.0, 50.0, 100.0))]


def test_needles_without_whole_words(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "phone twos"), (3, None)], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "e two t"), (2, "one tw"), (3, "three")], "n long, needle string")
    assert {(r.doc_id, r.n) for r in textsearch.holding(docs, needles).collect()} == {(1, 1), (1, 2), (2, 2), (1, 3)}


def test_overlapping_chunks(spark):
    docs = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in (0, 1, 10, 11, 18, 19)], "doc_id long, text string")
    got = {}
    for r in ingest.overlapping_chunks(docs, 10, 2).collect():
        got.setdefault(r.doc_id, {})[r.chunk] = r.text.split(" ")
    for n, chunks in got.items():
        words = [str(i) for i in range(n)]
        assert [chunks[i] for i in sorted(chunks)] == [words[s : s + 10] for s in range(0, max(n - 2, 1), 8)]
    assert set(got) == {1, 10, 11, 18, 19}


def test_outcomes_and_keyword_queries(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    outcomes = spark.createDataFrame([(1, "bad", 1), (1, None, 2), (2, "late", 1)], "doc_id long, error string, seq int")
    assert {(r.doc_id, r.embedding_status, r.error) for r in stores.with_outcomes(docs, outcomes).collect()} == {(1, "embedded", None), (2, "failed", "late"), (3, "pending", None)}
    rows = spark.createDataFrame([("t", ["a"]), ("", ["a", "", "b"]), (None, [])], "topic string, ks array<string>")
    assert [r.q for r in rows.select(show.keyword_query(F.col("topic"), F.col("ks")).alias("q")).collect()] == ["t", "a b", ""]
