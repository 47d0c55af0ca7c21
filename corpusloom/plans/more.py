"""Further queries over the driver's tables: scans and upkeep of stores, links of findings, what is shown, and table-wide
forms of the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import show
from ..functions import text as X
from ..operators import evaluation, ingest, linking, messages, stores, textsearch, vectors
from ..sources import readers
from .queries import CASES, CHUNKS, DOT, LEVELS, NORM, PAGES, QUERIES, SQL, hits, query, retrieved, t  # noqa: F401

# ---- scans ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def collection_scan(spark, d):
    """Documents of some collections and one status, three columns of them."""
    return stores.scanned(t(spark, d, "documents"), "doc_id", "source", "n_chars", lang="en", source=["src1", "src2", "src3"])


@query("SELECT conv_id, turn, source, lang FROM conversations LEFT JOIN documents ON conv_id = doc_id")
def document_lookup(spark, d):
    """Documents by id, whatever their collection."""
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    return t(spark, d, "conversations").join(docs, F.col("conv_id") == F.col("doc_id"), "left").select("conv_id", "turn", "source", "lang")


@query("SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def newest_tasks(spark, d):
    """Each user's latest tasks, without their traces."""
    return stores.newest(t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", 5).drop("ts")


@query("SELECT vec_id AS doc_id FROM embeddings UNION SELECT doc_id FROM labels")
def indexed_documents(spark, d):
    """Ids that either layout of the index holds."""
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).union(t(spark, d, "labels").select("doc_id")).distinct()


@query(f"SELECT doc_id, page, length(text) AS n FROM ({PAGES}) WHERE length(text) BETWEEN 30 AND 4000")
def production_chunks(spark, d):
    """Chunks of 30 to 4,000 characters."""
    pages = textsearch.pages_of(t(spark, d, "documents"))
    return pages.where(F.char_length("text").between(30, 4000)).select("doc_id", "page", F.char_length("text").cast("long").alias("n"))


@query(f"SELECT conv_id, turn, sha256(p.text) AS text_hash FROM conversations LEFT JOIN ({PAGES}) p ON conv_id = p.doc_id AND turn = p.page")
def page_by_position(spark, d):
    """The page that each turn points at, null out of range."""
    asked = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    out = stores.page_at(asked, textsearch.pages_of(t(spark, d, "documents")))
    return out.select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), X.content_hash(F.col("text")).alias("text_hash"))


def line_blocks(spark, d):
    """Lines as layout blocks of one page, one below the other."""
    pages = textsearch.pages_of(t(spark, d, "documents"))
    top = F.col("page") / 1000
    box = F.array(F.lit(0.125), top, F.when(F.col("page") % 7 == 6, 0.125).otherwise(0.875), top + 0.001)
    kind = F.when(F.char_length("text") > 80, "text").otherwise("title")
    return pages.select("doc_id", F.lit(0).cast("long").alias("page"), F.col("page").alias("block_order"), kind.alias("block_label"), F.col("text").alias("block_content"), box.alias("bbox_norm"))


@query(f"SELECT doc_id, 0::BIGINT AS page, page AS block_order, CASE WHEN length(text) > 80 THEN 'text' ELSE 'title' END AS block_label, text AS block_content FROM ({PAGES}) WHERE trim(text, ' ') <> ''")
def layout_fields(spark, d):
    return stores.shown_blocks(line_blocks(spark, d))


@query("""SELECT doc_id, 0::BIGINT AS page, sha256(text) AS content_hash, 0::BIGINT AS block_order, 0.125::DOUBLE AS x0, least(1.0, n_chars / 1024)::DOUBLE AS y1, 0.5::DOUBLE AS corner, 2::BIGINT AS corners FROM documents""")
def ocr_blocks(spark, d):
    """Blocks of OCR output with boxes and polygons in shares of the page; each document is a line of one page and one block."""
    docs = t(spark, d, "documents")
    numbers = lambda *x: F.array(*[F.lit(float(v)) if isinstance(v, int) else v.cast("double") for v in x])
    block = F.struct(F.lit("text").alias("block_label"), F.col("text").alias("block_content"), numbers(64, 0, 256, F.col("n_chars")).alias("block_bbox"), F.array(numbers(64, 512), numbers(256), numbers(256, 512)).alias("block_polygon"))
    page = F.struct(F.struct(F.lit("x").alias("text")).alias("markdown"), F.struct(F.array(F.lit(512), F.lit(1024)).alias("image_size"), F.array(block).alias("parsing_res_list")).alias("prunedResult"))
    lines = docs.select("doc_id", F.lit(0).alias("ord"), F.to_json(F.struct(F.struct(F.array(page).alias("layoutParsingResults")).alias("result"))).alias("line"))
    out = readers.ocr_pages(lines).select("doc_id", "page", F.explode("blocks").alias("b"))
    corner = F.get(F.get("b.polygon_norm", F.lit(1)), F.lit(0))
    return out.select(
        "doc_id", F.col("page").cast("long").alias("page"), X.content_hash(F.col("b.block_content")).alias("content_hash"), F.col("b.block_order").cast("long").alias("block_order"),
        F.get("b.bbox_norm", F.lit(0)).alias("x0"), F.get("b.bbox_norm", F.lit(3)).alias("y1"), corner.alias("corner"), F.size("b.polygon_norm").cast("long").alias("corners"),
    )


# ---- integrity and upkeep -------------------------------------------------------------------------------

VECTORS = "SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS ordinal, vec_id FROM embeddings"
CHECKED = """SELECT doc_id, coalesce(v, 0) AS n_vectors, coalesce(n, 0) AS n_nodes, CASE WHEN v IS NULL THEN 'missing vectors' WHEN n IS NULL THEN 'missing nodes' WHEN v <> n THEN 'count mismatch' ELSE 'ok' END AS state
 FROM (SELECT DISTINCT substr(source, 4)::INT AS doc_id FROM documents) LEFT JOIN (SELECT label AS doc_id, count(*) AS v FROM embeddings GROUP BY 1) USING (doc_id)
 LEFT JOIN (SELECT label AS doc_id, count(*) AS n FROM embeddings WHERE label <> 3 AND vec_id <> 7 GROUP BY 1) USING (doc_id)"""


def stored_parts(spark, d):
    """Documents, vectors and nodes with faults: one document has no nodes, another lacks one, others have no vectors."""
    ordinal = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    v = t(spark, d, "embeddings").select(F.col("label").cast("int").alias("doc_id"), ordinal.alias("ordinal"), "vec_id")
    docs = t(spark, d, "documents").select(F.substring("source", 4, 9).cast("int").alias("doc_id"))
    return docs, v, v.where("doc_id <> 3 AND vec_id <> 7").select("doc_id", "ordinal", F.col("vec_id").alias("node_id"))


@query(CHECKED)
def vector_integrity(spark, d):
    return stores.integrity(*stored_parts(spark, d))


@query(f"SELECT v.doc_id, ordinal, vec_id, vec_id AS node_id FROM ({VECTORS}) v JOIN ({CHECKED}) c ON v.doc_id = c.doc_id AND state = 'ok'")
def restored_nodes(spark, d):
    """Nodes and vectors by position, of documents whose stored parts are whole."""
    docs, v, n = stored_parts(spark, d)
    return stores.zipped(n, v, stores.integrity(docs, v, n))


@query(f"SELECT *, CASE WHEN state = 'ok' THEN 'reused' ELSE 'embedded' END AS action FROM ({CHECKED})")
def rebuild_plan(spark, d):
    return stores.rebuild_plan(vector_integrity(spark, d))


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def document_removed(spark, d):
    """The index without one document."""
    return stores.without_document(t(spark, d, "embeddings").select("vec_id", "label"), 3, "label")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 0 THEN 'failed' ELSE 'embedded' END AS embedding_status, CASE WHEN quality = 0 THEN 'low quality' END AS error FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def embedding_outcomes(spark, d):
    """Documents marked failed or cleared by their last outcome."""
    outcomes = t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "low quality").alias("error"), F.lit(1).alias("seq"))
    return stores.with_outcomes(t(spark, d, "documents").select("doc_id"), outcomes)


@query("SELECT source, count(*) AS n_docs, count(vec_id) AS n_indexed, count(vec_id) > 0 AS searchable FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1")
def searchable_collections(spark, d):
    return stores.searchable(t(spark, d, "documents"), t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "source")


@query("SELECT source, count(*) AS docs, count(l.doc_id) AS cached, sum(n)::BIGINT AS pages, sum(CASE WHEN l.doc_id IS NULL THEN n ELSE 0 END)::BIGINT AS uncached_pages FROM (SELECT doc_id, source, greatest(1, n_chars // 3000) AS n FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def bulk_preflight(spark, d):
    pages = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 3000))
    return stores.preflight(t(spark, d, "documents"), t(spark, d, "labels"), "source", pages)


@query("SELECT event_type, count(*) AS calls, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1")
def token_usage(spark, d):
    return stores.usage(t(spark, d, "events").withColumn("tokens", F.floor("value")), "event_type", "tokens")


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def degradation_events(spark, d):
    return stores.degradations(t(spark, d, "events").where("event_type = 'error'"), "user_id", "event_type", "event_id")


@query("SELECT c.conv_id, turn FROM conversations c LEFT JOIN (SELECT conv_id, min(turn + 2) AS s FROM conversations WHERE role = 'system' GROUP BY 1) f ON c.conv_id = f.conv_id WHERE s IS NULL OR turn < s")
def turns_before_stop(spark, d):
    """Turns of a run before it was cancelled; system turns set the flag two turns on."""
    c = t(spark, d, "conversations")
    flags = c.where("role = 'system'").select("conv_id", (F.col("turn") + 2).alias("stop_at"))
    return stores.stopped(c.select("conv_id", "turn"), flags, "conv_id", "turn")


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS text_hash FROM conversations GROUP BY 1")
def assembled_texts(spark, d):
    """Whole texts of each conversation's turns, joined in order."""
    return messages.assembled(t(spark, d, "conversations"), "conv_id", order="turn", text="text").select("conv_id", X.content_hash(F.col("text")).alias("text_hash"))


@query("SELECT doc_id, sha256(substr(text, 1, 10000)) AS content_hash, sha256(substr(text, 1, 5000)) AS arguments_hash FROM documents")
def trace_limits(spark, d):
    """The limits of stored traces, over texts that pass them."""
    out = messages.trimmed_trace(t(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("text").alias("arguments")))
    return out.select("doc_id", X.content_hash(F.col("content")).alias("content_hash"), X.content_hash(F.col("arguments")).alias("arguments_hash"))


# ---- what is shown --------------------------------------------------------------------------------------

CLAUSE = "list_filter(n, lambda x: length(x) - length(replace(x, '.', '')) = list_max(list_transform(n, lambda y: length(y) - length(replace(y, '.', '')))))[1]"


@query(f"""WITH s AS ({DOT}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
x AS (SELECT *, regexp_extract_all(text, '\\d+(?:\\.\\d+)*') AS n FROM documents),
l AS (SELECT query_id, rank, rank || '. ' || concat_ws(' ', '【' || source || '】', CASE WHEN len(n) > 0 THEN '第' || {CLAUSE} || '条' ELSE lang END) || chr(10) || substr(text, 1, 1000) AS l FROM r JOIN x ON vec_id = doc_id WHERE rank <= 3),
g AS (SELECT query_id, '【参考标准依据（向量检索）】' || chr(10) || string_agg(chr(10) || l, chr(10) ORDER BY rank) AS c FROM l GROUP BY 1)
SELECT doc_id AS query_id, sha256(coalesce(c, '未找到相关标准依据。')) AS context_hash FROM documents LEFT JOIN g ON doc_id = query_id""")
def found_context(spark, d):
    """The three best hits of each document as context for a model, or that nothing was found."""
    docs = t(spark, d, "documents")
    found = hits(spark, d, 3).join(docs, F.col("vec_id") == F.col("doc_id"))
    rows = found.select("query_id", "rank", "source", X.clause_number(F.col("text")).alias("clause"), F.col("lang").alias("section"), F.col("text").alias("content"))
    context = show.formatted(rows, "query_id")
    joined = docs.select(F.col("doc_id").alias("query_id")).join(context, "query_id", "left")
    return joined.select("query_id", X.content_hash(F.coalesce("context", F.lit(show.NOTHING_FOUND))).alias("context_hash"))


@query(f"""SELECT doc_id, page, sha256(substr(text, 1, 300)) AS snippet_hash, '/documents/' || doc_id || '/preview?page=' || (page + 1) AS preview_url FROM ({PAGES})""")
def source_payload(spark, d):
    """Sources as an answer shows them: a snippet and where to see the page."""
    p = textsearch.pages_of(t(spark, d, "documents"))
    return p.select("doc_id", "page", X.content_hash(F.substring("text", 1, 300)).alias("snippet_hash"), show.preview_url(F.col("doc_id"), F.col("page")).alias("preview_url"))


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN lang ELSE substr(array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' '), 1, 200) END AS query FROM documents")
def keyword_queries(spark, d):
    """A topic, or else the words of the text, cut to 200 characters."""
    topic = F.when(F.col("lang") != "en", F.col("lang"))
    return t(spark, d, "documents").select("doc_id", show.keyword_query(topic, F.split("text", " ")).alias("query"))


@query("""SELECT doc_id, sha256(array_to_string(string_split(text, chr(10)), '')) AS paragraph_hash, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) AS list_hash,
 sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: array_to_string(string_split(x, ' '), ' | ')), chr(10))) AS table_hash FROM documents""")
def structured_content(spark, d):
    """Lines as parts of a paragraph, items of a list and rows of a table."""
    lines = F.split("text", "\n")
    parts = F.concat(F.transform(lines, lambda x: F.struct(F.lit("text").alias("type"), x.alias("content"))), F.array(F.struct(F.lit("image").alias("type"), F.lit("x").alias("content"))))
    cells = F.transform(lines, lambda x: F.split(x, " "))
    hashed = lambda c, n: X.content_hash(c).alias(n)
    return t(spark, d, "documents").select("doc_id", hashed(show.joined_parts(parts), "paragraph_hash"), hashed(show.list_text(lines), "list_hash"), hashed(show.table_text(cells), "table_hash"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(date_trunc('second', ts)) AS us FROM events")
def timestamp_round_trip(spark, d):
    """ISO text of a time, and the time read from it."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t(spark, d, "events").select("event_id", iso.alias("iso"), F.unix_micros(F.to_timestamp(iso)).alias("us"))


# ---- links of findings ----------------------------------------------------------------------------------



@query(f"SELECT doc_id, sha256({NORM.format('text')}) AS form_hash FROM documents")
def normalized_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", X.content_hash(X.normalized("text")).alias("form_hash"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\-./]+', '', 'g')) AS form_hash FROM documents")
def standard_form_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", X.content_hash(X.standard_form("text")).alias("form_hash"))


@query(f"SELECT doc_id, page, CASE WHEN length(l) BETWEEN 2 AND 80 AND NOT contains('{X.TITLE_ENDS}', right(l, 1)) THEN CASE {LEVELS} END END::INT AS level FROM (SELECT doc_id, page, trim(text, ' ') AS l FROM ({PAGES}))")
def line_levels(spark, d):
    """Heading levels of all lines."""
    return textsearch.pages_of(t(spark, d, "documents")).select("doc_id", "page", X.heading_level(F.col("text")).alias("level"))


FIRST_LINES = f"""SELECT l.doc_id, min(page) AS page FROM labels l JOIN ({PAGES}) p USING (doc_id) JOIN (SELECT doc_id, {NORM.format('substr(text, 1, 60)')} AS a FROM documents) e USING (doc_id)
 WHERE a = '' OR ({NORM.format('p.text')} <> '' AND (contains(a, {NORM.format('p.text')}) OR contains({NORM.format('p.text')}, a))) GROUP BY 1"""


@query(f"SELECT l.doc_id, f.page AS block_start, f.page AS block_end FROM labels l LEFT JOIN ({FIRST_LINES}) f USING (doc_id)")
def finding_chunks(spark, d):
    """Block ranges of the chunks that excerpts (a document's first 60 characters) come from."""
    docs = t(spark, d, "documents")
    found = t(spark, d, "labels").select("doc_id").join(docs.select("doc_id", F.substring("text", 1, 60).alias("excerpt")), "doc_id", "left")
    found = found.select(F.col("doc_id").alias("item_id"), "doc_id", F.lit(None).cast("long").alias("page_number"), "excerpt")
    lines = textsearch.pages_of(docs).select("doc_id", F.col("page").alias("page_number"), F.col("page").alias("ord"), "text", F.struct(F.col("page").alias("start"), F.col("page").alias("end")).alias("block_range"))
    return linking.chunks_of_findings(found, lines).select("doc_id", F.col("block_range.start").alias("block_start"), F.col("block_range.end").alias("block_end"))


@query(f"SELECT doc_id, page AS block_order, 75.0::DOUBLE AS x, page / 1000 * 800 AS y, 450.0::DOUBLE AS w FROM ({PAGES}) WHERE page BETWEEN 1 AND 9 AND page % 7 <> 6")
def range_rectangles(spark, d):
    """Rectangles of the blocks from the second to the tenth of each document, on a page of 600 by 800; boxes without area have none."""
    ranges = t(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("page"), F.lit(1).alias("block_start"), F.lit(9).alias("block_end"))
    out = linking.range_rectangles(ranges, line_blocks(spark, d), F.lit(600.0), F.lit(800.0))
    return out.select("doc_id", "block_order", "r.x", "r.y", "r.w")


_CHANGED = "regexp_replace(text, '(?s)(.{8}).', '\\1§', 'g')"


@query(f"""WITH n AS (SELECT doc_id, page, {NORM.format('text')} AS b, {NORM.format(_CHANGED)} AS a, {NORM.format(f"replace({_CHANGED}, '§', '')")} AS c FROM ({PAGES}) WHERE page % 7 <> 6)
SELECT doc_id, page, page / 1000 * 800 AS y FROM n WHERE a <> '' AND b <> '' AND (contains(b, a) OR contains(a, b) OR (least(length(a), length(b)) >= 4 AND length(c) / greatest(length(a), length(b)) >= 0.85))""")
def highlight_rectangles(spark, d):
    """Rectangles of the blocks that hold a highlight: all lines, of which every ninth character is another; a line is a page of one block.  What line and
    highlight have in common is what was not changed, so SQL can tell where the longest common subsequence is long enough."""
    blocks = line_blocks(spark, d).withColumn("page", F.col("block_order"))
    asked = textsearch.pages_of(t(spark, d, "documents")).select("doc_id", "page", F.regexp_replace("text", "(?s)(.{8}).", "$1§").alias("highlight"))
    return linking.highlight_rectangles(asked, blocks, F.lit(600.0), F.lit(800.0)).select("doc_id", "page", "r.y")


LINKS = f"""WITH f AS (SELECT item_id, string_split(text, ' ')[2] AS num, string_split(text, ' ')[3] AS nam FROM benchmark),
w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), th AS (SELECT item_id, doc_id, doc_id AS ord, num, nam FROM f JOIN w ON w = num),
s AS (SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings e ON true)),
v AS (SELECT query_id AS item_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS ord FROM s QUALIFY ord <= 5),
vh AS (SELECT v.item_id, v.doc_id, ord FROM v JOIN documents d ON v.doc_id = d.doc_id JOIN f ON v.item_id = f.item_id WHERE contains(text, num)),
hits AS (SELECT vh.item_id, vh.doc_id, 0 AS strategy, ord AS rank FROM vh JOIN (SELECT DISTINCT item_id, doc_id FROM th) USING (item_id, doc_id)
 UNION ALL SELECT th.item_id, th.doc_id, 1, ord + (CASE WHEN contains(regexp_replace(lower(source || '-' || lang), '[\\s\\-./]+', '', 'g'), regexp_replace(lower(num), '[\\s\\-./]+', '', 'g')) THEN 0 WHEN contains(source || '-' || lang, nam) THEN 1 ELSE 2 END) * 1099511627776 FROM th JOIN documents d ON th.doc_id = d.doc_id
 UNION ALL SELECT item_id, doc_id, 2, ord FROM vh), b AS (SELECT item_id, min({{'s': strategy, 'r': rank, 'd': doc_id}}) AS b FROM hits GROUP BY 1)
SELECT item_id, b.d AS doc_id, b.s AS strategy FROM f LEFT JOIN b USING (item_id)"""


@query(LINKS)
def linked_sources(spark, d):
    """Findings linked to sources: a confirmed vector hit, else the best text hit, else a vector hit alone.  A finding is a
    passage, its second word the number and its third the name."""
    docs, items = t(spark, d, "documents"), t(spark, d, "benchmark")
    words = F.split("text", " ")
    found = items.select("item_id", F.array(F.get(words, F.lit(1))).alias("numbers"), F.array(F.get(words, F.lit(2))).alias("names"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("w"))
    texts = tokens.join(found.select("item_id", F.get("numbers", F.lit(0)).alias("w")), "w").select("item_id", "doc_id", F.col("doc_id").alias("ord"))
    e = t(spark, d, "embeddings")
    asked = e.join(items.select("item_id"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "embedding")
    near = vectors.scored(asked, e, 5).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("rank").alias("ord"))
    near = near.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    catalog = docs.select("doc_id", F.concat_ws("-", "source", "lang").alias("name"))
    return linking.sources_of_findings(found, texts, near, catalog).select("item_id", "doc_id", "strategy")


# ---- ingestion ------------------------------------------------------------------------------------------

WINDOWS = "SELECT doc_id, w, unnest(range(0, (greatest(len(w) - 51, 0) // 462) + 1)) AS chunk FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0"


@query(f"SELECT doc_id, chunk, sha256(array_to_string(w[chunk * 462 + 1 : chunk * 462 + 512], ' ')) AS text_hash, len(w[chunk * 462 + 1 : chunk * 462 + 512]) AS n_tokens FROM ({WINDOWS})")
def overlapping_chunks(spark, d):
    out = ingest.overlapping_chunks(t(spark, d, "documents"))
    return out.select("doc_id", "chunk", X.content_hash(F.col("text")).alias("text_hash"), "n_tokens")


INGESTED = f"""WITH c AS ({CHUNKS}), p AS ({PAGES}), a AS (SELECT c.doc_id, c.chunk, c.text, c.n_tokens, min(p.page) AS page FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND substr(trim(c.text, ' '), 1, 200) <> '' AND contains(p.text, substr(trim(c.text, ' '), 1, 200)) GROUP BY 1, 2, 3, 4),
n AS (SELECT a.*, {NORM.format('a.text')} AS x, {NORM.format('p.text')} AS y, regexp_extract_all(a.text, '\\d+(?:\\.\\d+)*') AS n FROM a LEFT JOIN p ON a.doc_id = p.doc_id AND a.page = p.page)
SELECT doc_id, chunk, n_tokens, page AS page_number, {CLAUSE} AS clause_number, CASE WHEN x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) THEN page END AS block_start, length(text)::DOUBLE AS size FROM n"""


def whole_ingest(spark, d, docs):
    pages = textsearch.pages_of(t(spark, d, "documents"))
    blocks = pages.select("doc_id", "page", F.col("page").alias("block_order"), F.col("text").alias("block_content"))
    return docs, pages, blocks, lambda text: F.array(F.char_length(text).cast("double"))


@query(INGESTED)
def ingested_chunks(spark, d):
    """Split, enriched, placed on pages and blocks, and embedded in one job; the stand-in for an embedder is the length."""
    out = ingest.ingested(*whole_ingest(spark, d, t(spark, d, "documents")))
    return out.select("doc_id", "chunk", "n_tokens", "page_number", "clause_number", "block_start", F.get("embedding", F.lit(0)).alias("size"))


@query(f"SELECT * REPLACE (CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -1 ELSE size END AS size) FROM ({INGESTED})")
def rebuilt_index(spark, d):
    """Stored chunks of the labelled documents (marked by a size of -1), the others ingested anew."""
    docs = t(spark, d, "documents")
    kept = ingest.ingested(*whole_ingest(spark, d, docs.join(t(spark, d, "labels"), "doc_id", "left_semi"))).withColumn("embedding", F.array(F.lit(-1.0)))
    columns = ["doc_id", "chunk", "n_tokens", "page_number", "clause_number", "block_start", "embedding"]
    out = ingest.rebuilt(docs, kept.select(*columns), *whole_ingest(spark, d, docs)[1:])
    return out.select(*columns[:-1], F.get("embedding", F.lit(0)).alias("size"))


# ---- evaluation -----------------------------------------------------------------------------------------

ALL_CASES = CASES.replace("rank <= 3", "rank <= 1000000000")


@query(f"SELECT case_id, CASE WHEN matched > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(rr, 4) AS mrr, round(recall, 4) AS recall, round(precision, 4) AS precision_at_k FROM ({ALL_CASES})")
def hit_rate_cases(spark, d):
    """The variant whose precision divides by all results."""
    cases = evaluation.case_metrics(*retrieved(spark, d), 1_000_000_000)
    return cases.select("case_id", F.when(F.col("matched") > 0, 1.0).otherwise(0.0).alias("hit_rate"), F.round("rr", 4).alias("mrr"), F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision_at_k"))


@query("SELECT * FROM (SELECT user_id AS config, round(avg(value), 4) AS score, count(*) AS runs, row_number() OVER (ORDER BY round(avg(value), 4) DESC, user_id) AS place FROM events GROUP BY 1) WHERE place <= 10")
def ranked_configs(spark, d):
    """The ten best configurations of a sweep by their mean score."""
    return evaluation.ranked(t(spark, d, "events"), "user_id", "value", 10).withColumnRenamed("user_id", "config")


@query("SELECT user_id, count(*) AS results, count(DISTINCT event_type) AS sources, count(DISTINCT event_type) <= 1 AS single_source FROM events GROUP BY 1")
def source_diversity(spark, d):
    """How many sources a result draws on, and whether it is one alone."""
    return evaluation.diversity(t(spark, d, "events"), "user_id", "event_type")
