"""Importance resampling towards a target distribution, by hashed word n-grams.

One scan of a document keeps the running CRC-32 states of the last ``n`` starts; each is extended by a blank and the next
word, so every state that a word ends is a feature's checksum and no n-gram is ever put together.  Bucket counts are summed
in each task before they are shuffled; the gains, one number a bucket, are all that the driver holds.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .ranks import numbered

#: Bytes of words (ASCII letters in lower case, digits, all of other characters); the rest separate words.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def features(text: bytes, n: int) -> tuple[list[int], int]:
    """The CRC-32 of every run of 1 to ``n`` consecutive words, joined by a blank; the number of words."""
    words = text.translate(_WORDS).split()
    found: list[int] = []
    ring: list[int] = []
    for word in words:
        longer = b" " + word
        ring = [crc32(longer, state) for state in (ring[1 - n :] if n > 1 else ())]
        ring.append(crc32(word))
        found += ring
    return found, len(words)


def bucketed(batches, n: int, buckets: int):
    """For each batch of texts, each row's buckets, one after another, and numbers of features and of words."""
    for batch in batches:
        found, sizes, words = [], [], []
        for text in batch.column("text").to_pylist():
            here, count = features(text.encode() if text else b"", n)
            found.append(np.array(here, np.uint32) % np.uint32(buckets))
            sizes.append(len(here))
            words.append(count)
        yield batch, np.concatenate(found) if found else np.zeros(0, np.uint32), np.array(sizes, np.int64), np.array(words, np.int64)


def bucket_counts(texts: DataFrame, *, n: int = 2, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, found, _, _ in bucketed(batches, n, buckets):
            total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "count"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, count long")
    for bucket, count in counted.groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of target and source in each bucket, both smoothed by one, rounded down."""
    s, t = int(source.sum()), int(target.sum())
    b = len(source)
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + b) / ((int(x) + 1) * (t + b)))) for x, y in zip(source, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_features, n_words, weight``: the mean gain of a text's features, rounded down; 0 without features."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        for batch, found, sizes, words in bucketed(batches, n, len(held.value)):
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(held.value[found])])
            total = sums[ends] - sums[ends - sizes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(words), pa.array(total // np.maximum(sizes, 1))], [id_col, "n_features", "n_words", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_features long, n_words long, weight long")


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row: ``weight`` by the features it shares with ``target``, ``score`` with a
    Gumbel term from a hash of seed and id, and ``rank`` (from 1) where the row is among the ``percent`` of the rows of at
    least ``least_words`` words that are drawn, which have the highest scores; ties go to the smaller id (null first), then to
    more features.  A null text has no words and a null id counts as an empty one in the hash.  Repeated rows are drawn apart.  Without rows
    there is no result; an empty ``target`` has all gains from smoothing.  Only the named columns are read.
    """
    gain = gains(bucket_counts(docs, n=n, buckets=buckets, text_col=text_col), bucket_counts(target, n=n, buckets=buckets, text_col=text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = checkpointed(weighed(docs, gain, n=n, id_col=id_col, text_col=text_col).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_out", (F.col("n_words") < least_words).cast("int")))
    drawn = rows.where("_out = 0").count() * percent // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("n_features").desc()]
    placed, _ = numbered(rows, "_out", order)
    rank = F.when((F.col("_out") == 0) & (F.col("pos") < drawn), F.col("pos") + 1)
    return placed.select(id_col, "n_features", "weight", "score", rank.alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """A quarter of ``documents``, drawn towards the distribution of ``benchmark``."""
    from .common import table

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a string in DuckDB: a fold over its bytes and eight shifts after each.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, octet_length(encode({s}))), lambda i: "
    "[('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
)
_LIST = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_LIST}, []) AS w FROM documents), b AS (SELECT coalesce({_LIST}, []) AS w FROM benchmark),
df AS (SELECT k, unnest({_GRAMS}) AS f FROM d), dn AS (SELECT k, f, count(*) AS n FROM df GROUP BY ALL), bf AS (SELECT f, count(*) AS n FROM (SELECT unnest({_GRAMS}) AS f FROM b) GROUP BY ALL),
h AS (SELECT f, {CRC32.format(s='f')} % 10000 AS bucket FROM (SELECT f FROM dn UNION SELECT f FROM bf)),
s AS (SELECT bucket, sum(n) AS s FROM dn JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN h USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT k, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dn JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(d.w) AS words, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (k)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= (SELECT 25 * count(*) // 100 FROM y WHERE words >= 20) THEN r END AS rank FROM z"""
