"""Upkeep of collections: what to parse again, at what cost, duplicates, states, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pages beyond which a document is not parsed whole, and pages of a document whose number is unknown; fixed values.
PAGE_LIMIT, USUAL_PAGES = 100, 11


def reparse_targets(docs: DataFrame, *, force: bool = False) -> DataFrame:
    """``docs`` (``embedding_status, has_pages, n_layout``) with ``reason``; those without one are left out."""
    reason = (
        F.when(~F.col("embedding_status").eqNullSafe("embedded"), "not_embedded").when(~F.coalesce("has_pages", F.lit(False)), "missing_pages")
        .when(F.coalesce("n_layout", F.lit(0)) == 0, "empty_layout")
    )
    return docs.withColumn("reason", F.lit("forced") if force else reason).where(F.col("reason").isNotNull())


def within_page_limit(targets: DataFrame, limit: int = PAGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    over = F.coalesce("page_count", F.lit(0)) > limit
    return targets.where(~over), targets.where(over)


def parse_cost(targets: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """``cache_state, docs, pages, over_limit``: pages are capped at the limit and assumed where unknown."""
    pages = F.least(F.lit(limit), F.when(F.coalesce("page_count", F.lit(0)) > 0, F.col("page_count")).otherwise(USUAL_PAGES))
    return targets.groupBy("cache_state").agg(F.count("*").alias("docs"), F.sum(pages.cast("long")).alias("pages"), F.count_if(F.col("page_count") > limit).alias("over_limit"))


def usage(rows: DataFrame) -> DataFrame:
    """``bucket, docs, pages`` by source; failed documents are one bucket without pages."""
    bucket = F.when(F.col("succeeded"), F.col("parse_source")).otherwise("failed")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("docs"), F.sum(F.when(F.col("succeeded"), F.col("pages"))).alias("pages"))


def first_of_content(docs: DataFrame, known: DataFrame | None = None, *, order: str = "doc_id", hash_col: str = "content_hash") -> DataFrame:
    """The first document of each content, without contents that ``known`` has."""
    fresh = docs if known is None else docs.join(known.select(hash_col).distinct(), hash_col, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(hash_col).orderBy(order))).where("_r = 1").drop("_r")


def merged_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of its own of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(gone.select(key).distinct(), key, "left_anti")


def collection_status(states: DataFrame) -> DataFrame:
    """``kb_id, docs, embedded, failed, complete, status`` from documents' states."""
    return states.groupBy("kb_id").agg(
        F.count("*").alias("docs"), F.count_if(F.col("embedding_status") == "embedded").alias("embedded"), F.count_if(F.col("embedding_status") == "failed").alias("failed"),
        F.bool_and(F.col("embedding_status") == "embedded").alias("complete"),
    ).withColumn("status", F.when(F.col("embedded") > 0, "searchable").otherwise("failed"))


def failure_line(rows: DataFrame, *by: str, most: int = 3) -> DataFrame:
    """``by, summary``: failures over all, with the first ``most`` by name.  Lists hold ``most`` failures, however many there are."""
    failed = F.col("outcome") != "ok"
    sized = rows.groupBy(*by).agg(F.count_if(failed).alias("f"), F.count("*").alias("total"))
    ranked = rows.where(failed).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("name", "outcome"))).where(F.col("_r") <= most)
    line = F.concat(F.col("name"), F.lit(": "), F.col("outcome"))
    named = ranked.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("first"))
    joined = sized.join(named, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], "left")
    shown = F.coalesce(F.array_join(F.transform("first", lambda x: x["line"]), "；"), F.lit(""))
    more = F.when(F.col("f") > most, "；…").otherwise("")
    return joined.select(*by, F.concat(F.col("f").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), shown, more, F.lit(")")).alias("summary"))


#: State after a restart; fixed values.
RECOVERY = {"building": "none", "pending_index": "none", "indexing": "pending_index", "processing": "failed"}


def recovered(rows: DataFrame, state_col: str = "state") -> DataFrame:
    state = F.col(state_col)
    out = state
    for stuck, then in RECOVERY.items():
        out = F.when(state == stuck, then).otherwise(out)
    return rows.withColumn("recovered", out)


def latest(events: DataFrame, key: str, *, order: str = "event_id", value: str = "event_type", progress: str = "value") -> DataFrame:
    """Each key's last state and its progress, which never falls."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("state"), F.max(progress).alias("progress"), F.count("*").alias("events"))


def compared(baseline: DataFrame, now: DataFrame, key: str = "doc_id") -> DataFrame:
    """``class, docs``: hit, missed, extra and broken documents against a baseline (``ok`` columns say which work)."""
    a, b = baseline.select(F.col(key).alias("a"), F.col("ok").alias("was")), now.select(F.col(key).alias("b"), F.col("ok").alias("is"))
    kind = F.when(F.col("b").isNull(), "missed").when(F.col("a").isNull(), "extra").when(F.col("was") & ~F.col("is"), "broken").otherwise("hit")
    return a.join(b, F.col("a") == F.col("b"), "full").groupBy(kind.alias("class")).agg(F.count("*").alias("docs"))


def extra_sample(docs: DataFrame, baseline: DataFrame, n: int, *, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """``n`` documents, or all there are, outside a baseline, chosen by a seeded hash of their key."""
    return without(docs, baseline, key).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def layout_probe(blocks: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """``key, pages, blocks, labels``: a document's layout at a glance."""
    return blocks.groupBy(key).agg(
        F.countDistinct("page").alias("pages"), F.count("*").alias("blocks"), F.slice(F.array_sort(F.collect_set("block_label")), 1, most).alias("labels")
    )


#: States from which a task may be cancelled or run; fixed values.
TRANSITIONS = {"cancel": ["pending", "processing"], "run": ["pending", "cancelled"]}


def transitions(tasks: DataFrame, action: str, state_col: str = "status") -> DataFrame:
    """``tasks`` with ``allowed`` and the ``after`` state."""
    allowed = F.col(state_col).isin(TRANSITIONS[action])
    return tasks.withColumn("allowed", allowed).withColumn("after", F.when(allowed, "cancelled" if action == "cancel" else "processing").otherwise(F.col(state_col)))


def report(targets: DataFrame, outcomes: DataFrame, *by: str, key: str = "doc_id") -> DataFrame:
    """``by, total, succeeded, failed, failures``: targets with what became of them; one without an outcome has failed.
    ``failures`` lists key and reason, in key order."""
    joined = targets.join(outcomes, key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("ok").isNull(), F.lit("no outcome"))))
    bad = ~F.coalesce("ok", F.lit(False))
    return joined.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"),
        F.array_sort(F.collect_list(F.when(bad, F.struct(F.col(key).alias("key"), F.col("reason").alias("reason"))))).alias("failures"),
    )


def appended(held: DataFrame, new: DataFrame, *by: str, key: str = "doc_id") -> DataFrame:
    """``by, key, ord``: a collection's ids with the new ones that it lacks after them, in the order of their ids.  Repeated ids count once."""
    keys = [*by, key]
    old = held.select(*keys).distinct().withColumn("_new", F.lit(0))
    fresh = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").withColumn("_new", F.lit(1))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_new", key)) - 1
    return old.union(fresh).select(*keys, place.cast("long").alias("ord"))


def summarized(docs: DataFrame, by: str, name: str, most: int = 30) -> DataFrame:
    """``by, total, names, more``: the first ``most`` names of each collection, and how many there are besides."""
    ranked = docs.select(by, name).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(name))).where(F.col("_r") <= most)
    first = ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda x: x[name]).alias("names"))
    return docs.groupBy(by).agg(F.count("*").alias("total")).join(first, by).select(by, "total", "names", F.greatest(F.col("total") - most, F.lit(0)).alias("more"))
