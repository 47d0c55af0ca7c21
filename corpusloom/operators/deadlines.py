"""Requests and the first event that answers each within a limit.

Time is cut into buckets as long as the limit: an answer lies in a request's bucket, after it, or is the first one of the next
bucket.  Rows meet by key and bucket, so a busy key spreads over its buckets, and no request meets more than one candidate
of the next bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_within(requests: DataFrame, answers: DataFrame, seconds: int, *, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", keep: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """``id_col, key, ts, keep...`` of the requests with ``answer_id, answer_ts, [answer_kind,] outcome``: the first answer of the same key at or after a request
    and at most ``seconds`` later, of equal times the smallest id.  ``outcome`` is ``answered`` or ``timeout``.

    Requests whose key or time is null time out; answers of that sort answer nothing.  Repeated rows stay.
    """
    keep = keep or []
    limit = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(at / limit).cast("long")
    answer = F.struct(at.alias("at"), F.col(id_col).alias("id"), F.col(ts).alias("ts"), *([F.col(kind).alias("kind")] if kind else []))
    given = answers.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_key"), bucket.alias("_bucket"), answer.alias("_answer"))
    firsts = given.groupBy("_key", "_bucket").agg(F.min("_answer").alias("_next")).withColumn("_bucket", F.col("_bucket") - 1)
    asked = requests.select(F.col(key).alias("_key"), bucket.alias("_bucket"), at.alias("_at"), F.struct(id_col, key, ts, *keep).alias("_row"))
    rows = asked.unionByName(given.withColumn("_at", F.col("_answer.at")), allowMissingColumns=True)
    # From late to early; of equal times answers come first, the smallest id last among them.
    back = Window.partitionBy("_key", "_bucket").orderBy(F.desc("_at"), F.col("_row").isNotNull(), F.desc(F.col("_answer.id"))).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last("_answer", True).over(back)).where(F.col("_row").isNotNull())
    met = own.join(firsts, ["_key", "_bucket"], "left")
    found = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_own", F.when(F.col("_next.at") <= F.col("_at") + limit, F.col("_next"))))
    told = met.select("_row.*", found.alias("_found"))
    more = [F.col("_found.kind").alias("answer_kind")] if kind else []
    return told.select(id_col, key, ts, *keep, F.col("_found.id").alias("answer_id"), F.col("_found.ts").alias("answer_ts"), *more, F.when(F.col("_found").isNotNull(), "answered").otherwise("timeout").alias("outcome"))


def polled(waited: DataFrame, every_ms: int, seconds: int, *, ts: str = "ts") -> DataFrame:
    """``waited`` with ``polls`` and ``seen_ms``: how often a poller that looks at once and then every ``every_ms`` has looked when it sees the answer, or has
    at its limit, and when that is, in milliseconds after the request."""
    wait = F.unix_micros(F.col("answer_ts").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    last = seconds * 1000 // every_ms
    rounds = F.coalesce(F.ceil(wait / (every_ms * 1000)).cast("long"), F.lit(last))
    return waited.withColumn("polls", F.least(rounds, F.lit(last)) + 1).withColumn("seen_ms", F.when((F.col("outcome") == "answered") & (rounds <= last), rounds * every_ms))
