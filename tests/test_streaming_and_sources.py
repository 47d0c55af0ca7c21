from pyspark.sql import functions as F

from corpusloom.sources import readers
from corpusloom.streaming import events as S


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_agree_with_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    schema = e.schema.simpleString()[7:-1].replace(":", " ")
    stream = S.event_stream(spark, str(tmp_path / "e"), schema)
    got = drained(S.windowed_counts(stream), "w", "update").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = S.windowed_counts(e).select(F.col("start").cast("timestamp"), "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_first_sources(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = S.event_stream(spark, str(tmp_path / "e"), e.schema.simpleString()[7:-1].replace(":", " "))
    got = drained(S.first_sources(stream, "user_id", "event_type", late="365 days"), "f", "append")
    assert got.count() == e.select("user_id", "event_type").distinct().count()


def test_ingest_takes_new_content_only(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for i, rows in enumerate([[("a", 1), ("a", 2)], [("a", 3), ("b", 4)]]):
        spark.createDataFrame(rows, "content_hash string, doc_id long").coalesce(1).write.mode("append").parquet(source)
        S.ingest(spark.readStream.schema("content_hash string, doc_id long").parquet(source), table, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.content_hash for r in spark.read.parquet(table).collect()) == ["a", "b"]


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hello")
    (tmp_path / "b.bin").write_bytes(b"\xff\x00")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    files = readers.read_files(spark, str(tmp_path))

    def parse(content):
        raise ValueError("broken")

    got = {r.name: (r.text, r.error) for r in readers.parsed_files(files, {"pdf": parse}).collect()}
    assert got["a.md"] == ("# hello", None) and got["c.pdf"] == (None, "ValueError: broken")
    cache = files.where("name = 'a.md'").select("content_hash", F.lit("v1").alias("version"), F.lit("kept").alias("text"))
    assert {r.name: r.cache_state for r in readers.with_parse_cache(files, cache, "v1").collect()} == {"a.md": "hit", "b.bin": "miss", "c.pdf": "miss"}


def test_sessions_end_after_their_start(spark, tmp_path):
    rows = "(1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 01:00:00'), (2, TIMESTAMP '2024-01-01 00:30:00')"
    spark.sql(f"SELECT * FROM VALUES {rows} AS v(user_id, ts)").coalesce(1).write.parquet(str(tmp_path / "e"))
    later = spark.sql("SELECT 3 AS user_id, TIMESTAMP '2024-01-01 05:00:00' AS ts")
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = S.event_stream(spark, str(tmp_path / "e"), "user_id int, ts timestamp")
    got = drained(S.session_ages(stream), "s", "update").collect()
    assert {r.user_id: r.n for r in got if r.ended} == {1: 2, 2: 1}
