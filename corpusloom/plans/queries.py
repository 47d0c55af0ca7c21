"""Queries over the driver's tables, each with its SQL form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, evaluation, findings, maintenance, messages, sections, structure, textsearch, vectors
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- the pages' articles as Markdown, and forms for characters of the driver's tables --------------------------

PAGE_TEXT = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<h1>', chr(10) || '{mark} ', 'g'), '</h1>|<p>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g')"
ARTICLES = f"SELECT page_id, {PAGE_TEXT.format(mark='#')} AS text FROM pages"
SUB_ARTICLES = f"SELECT page_id, {PAGE_TEXT.format(mark='##')} AS text FROM pages"


def page_texts(spark, d, mark="#"):
    """The articles of the pages, with a line for each heading and paragraph."""
    inner = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    marked = F.regexp_replace(F.regexp_replace(inner, "<h1>", f"\n{mark} "), "</h1>|<p>|<br>", "\n")
    return t(spark, d, "pages").select("page_id", F.regexp_replace(marked, "<[^>]*>", "").alias("text"))


#: Normal form of a text, for characters of the driver's tables.
NORM = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '[\s!-/:-@\[-`{{-~。！？、；：（）【】「」『』《》·…—–]', '', 'g')"
#: Standard form.
FORM = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '[\s\x{{3000}}\x{{a0}}\-./]+', '', 'g')"
#: Lines of texts, from 0.
LINES = "(SELECT unnest(range(0, len(string_split({0}, chr(10))))) AS pos, unnest(string_split({0}, chr(10))) AS line)"


# ---- vectors: every vector whose id is divisible by 50 is a query ---------------------------------------

DOT = """SELECT q.vec_id AS query_id, e.vec_id, e.label,
 round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS score
 FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0"""


def hits(spark, d, k, **more) -> DataFrame:
    e = t(spark, d, "embeddings")
    return vectors.scored(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, k, **more)


@query(f"""WITH s AS ({DOT}), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 5""")
def vector_topk(spark, d):
    """Nearest neighbours by cosine."""
    return hits(spark, d, 5)


@query(f"""WITH s AS ({DOT}), r AS (SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 3""")
def vector_topk_by_group(spark, d):
    """Nearest neighbours within each collection."""
    return hits(spark, d, 3, group_col="label")


@query(f"""WITH s AS ({DOT}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, vec_id, max(score) AS score FROM r WHERE r <= 3 GROUP BY 1, 2""")
def vector_retrieve_dedup(spark, d):
    return vectors.deduplicated(hits(spark, d, 3, group_col="label"))


@query(f"""WITH s AS ({DOT}), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r2 FROM a WHERE r <= 6),
c AS (SELECT query_id, vec_id, label, round(score - 0.01 * label, 4) AS score FROM b WHERE r2 <= 12),
e AS (SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) SELECT * FROM e WHERE rank <= 5""")
def vector_rank_funnel(spark, d):
    """Six of each collection, cut to 2k, scored anew (here by label), cut to five."""
    return vectors.rank_funnel(hits(spark, d, 6, group_col="label"), 6, rerank=F.round(F.col("score") - 0.01 * F.col("label"), 4))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def vector_knn_l2(spark, d):
    return hits(spark, d, 5, metric="l2", other_than_self=True)


# ---- text search ------------------------------------------------------------------------------------------

PAGES = "SELECT source AS kb_id, doc_id, u.page - 1 AS page, u.line AS text FROM documents, (SELECT unnest(generate_series(1, len(string_split(documents.text, chr(10))))) AS page, unnest(string_split(documents.text, chr(10))) AS line) u"
SNIPPET = "substr(trim(substr(text, greatest(0, p0 - 80) + 1, least(length(text), p0 + {n} + 200) - greatest(0, p0 - 80)), ' '), 1, 500)"


def first_sql(word: str) -> str:
    return f"""SELECT kb_id, doc_id, page, {SNIPPET.format(n=len(word))} AS content FROM (SELECT *, instr(lower(text), '{word}') - 1 AS p0,
 row_number() OVER (PARTITION BY kb_id, doc_id ORDER BY page) AS r FROM ({PAGES}) WHERE instr(lower(text), '{word}') > 0) WHERE r = 1"""


@query(first_sql("licensed"))
def text_search_first_page(spark, d):
    """The first page of each document that holds a keyword, with its surroundings."""
    return textsearch.first_pages(textsearch.pages_of(t(spark, d, "documents")), "licensed")


@query(f"SELECT * FROM ({first_sql('version')}) ORDER BY kb_id, doc_id LIMIT 5")
def text_search_top(spark, d):
    return textsearch.top_hits(textsearch.first_pages(textsearch.pages_of(t(spark, d, "documents")), "version"))


@query(f"""WITH f AS (SELECT *, {FORM.format("text")} AS form FROM ({PAGES})), h AS (SELECT *, instr(lower(text), 'of-the') - 1 AS e, instr(form, 'ofthe') - 1 AS l FROM f),
g AS (SELECT *, CASE WHEN e >= 0 THEN e ELSE floor(l * length(text) / greatest(length(form), 1)) END::INT AS p0, row_number() OVER (PARTITION BY kb_id, doc_id ORDER BY page) AS r FROM h WHERE e >= 0 OR l >= 0)
SELECT kb_id, doc_id, page, {SNIPPET.format(n=6)} AS content FROM g WHERE r = 1""")
def text_search_tolerant(spark, d):
    """Keywords with something to strip match across white space, dashes, dots and slashes."""
    return textsearch.first_pages(textsearch.pages_of(t(spark, d, "documents")), "of-the")


@query("""WITH k AS (SELECT * FROM (VALUES ('apache', 0), ('mit license', 1), ('gnu', 2)) v(keyword, k)),
h AS (SELECT doc_id, min((k, source, keyword)) AS m FROM documents JOIN k ON instr(lower(text), keyword) > 0 GROUP BY 1)
SELECT doc_id, m[3] AS keyword, row_number() OVER (ORDER BY m[1], m[2], doc_id) AS ord FROM h ORDER BY ord LIMIT 5""".replace("min((k, source, keyword))", "min({'a': k, 'b': source, 'c': keyword})").replace("m[3]", "m.c").replace("m[1], m[2]", "m.a, m.b"))
def keyword_union(spark, d):
    return textsearch.keyword_union(textsearch.pages_of(t(spark, d, "documents")), ["apache", "mit license", "gnu"])


@query(f"SELECT conv_id, turn, sha256({NORM.format('text')}) AS a, sha256({FORM.format('text')}) AS b FROM conversations")
def text_normalized(spark, d):
    """Normal and standard forms of all turns."""
    return t(spark, d, "conversations").select("conv_id", "turn", X.content_hash(X.normalized("text")).alias("a"), X.content_hash(X.standard_form("text")).alias("b"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'IEC ' || n_chars WHEN 1 THEN 'GB ' || n_chars || '.' || doc_id ELSE 'GBT ' || lang END AS number FROM documents")
def standard_numbers(spark, d):
    """Numbers made of documents' fields, in several spellings, in tidy form."""
    n, i = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("IEC"), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" GB\u3000 "), n, F.lit("-."), i)).otherwise(F.concat(F.lit("GBT\t"), "lang", F.lit(" ")))
    return t(spark, d, "documents").select("doc_id", X.standard_number(spelled).alias("number"))


@query(f"""WITH l AS (SELECT doc_id, page, length(text) AS n, length(text) // 7 AS k, length(text) // 10 AS more FROM ({PAGES}) WHERE text <> '')
SELECT doc_id, page, (n - k)::INT AS lcs, k = 0 OR (n >= 4 AND (n - k) / n >= 0.85) AS by_min, k = 0 OR (n >= 4 AND (n - k) / (n + more) >= 0.85) AS by_max FROM l""")
def fuzzy_match(spark, d):
    """Longest common subsequences of all lines with themselves, every seventh character another and a tail added: what is left of the line, over
    the shorter or the longer length."""
    lines = textsearch.pages_of(t(spark, d, "documents")).where("text <> ''")
    other = F.concat(F.regexp_replace("text", "(?s)(.{6}).", "$1\u0001"), F.repeat(F.lit("\u0002"), F.floor(F.char_length("text") / 10).cast("int")))
    pairs = lines.select("doc_id", "page", "text", other.alias("b"))
    return pairs.select("doc_id", "page", X.lcs_len("text", "b").alias("lcs"), X.fuzzy_matcher("min")("text", "b").alias("by_min"), X.fuzzy_matcher("max")("text", "b").alias("by_max"))


# ---- ingestion and chunks -----------------------------------------------------------------------------


def hashed(spark, d):
    return t(spark, d, "documents").withColumn("content_hash", X.content_hash(F.col("text")))


@query("SELECT doc_id, source, h AS content_hash FROM (SELECT *, sha256(text) AS h, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def content_dedup(spark, d):
    return maintenance.first_of_content(hashed(spark, d)).select("doc_id", "source", "content_hash")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents
 WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)) WHERE r = 1""")
def import_new_content(spark, d):
    """First of each content, but for contents that the collection of labelled toxic documents has."""
    docs = hashed(spark, d)
    return maintenance.first_of_content(docs, docs.join(t(spark, d, "labels").where("toxic = 1"), "doc_id")).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def existing_anti(spark, d):
    return maintenance.without(t(spark, d, "documents"), t(spark, d, "labels")).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def existing_semi(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""SELECT source AS kb_id, count(*) AS docs, count(vec_id) AS embedded, count(*) - count(vec_id) AS failed, bool_and(vec_id IS NOT NULL) AS complete,
 CASE WHEN count(vec_id) > 0 THEN 'searchable' ELSE 'failed' END AS status FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1""")
def has_vectors_split(spark, d):
    """Documents with and without vectors, and what that makes of their collections."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("embedded").alias("s"))
    states = t(spark, d, "documents").join(e, "doc_id", "left").select(F.col("source").alias("kb_id"), F.coalesce("s", F.lit("failed")).alias("embedding_status"))
    return maintenance.collection_status(states)


CHUNKS = """SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS text, sum(n)::BIGINT AS n_tokens FROM (
 SELECT *, floor(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 512)::BIGINT AS chunk FROM (
 SELECT doc_id, pos, line, len(regexp_extract_all(line, '\\S+')) AS n FROM (SELECT doc_id, u.pos, u.line FROM documents, (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line) u WHERE length(text) >= 20))) GROUP BY 1, 2"""


def chunks(spark, d):
    return chunking.line_chunks(t(spark, d, "documents"))


@query(f"SELECT doc_id, chunk, n_tokens, sha256(text) AS text_hash FROM ({CHUNKS})")
def chunk_split(spark, d):
    return chunks(spark, d).select("doc_id", "chunk", "n_tokens", X.content_hash(F.col("text")).alias("text_hash"))


@query(f"""WITH c AS ({CHUNKS}), p AS ({PAGES}) SELECT c.doc_id, c.chunk, min(p.page) AS page_number FROM c LEFT JOIN p
 ON c.doc_id = p.doc_id AND substr(trim(c.text, ' '), 1, 200) <> '' AND contains(p.text, substr(trim(c.text, ' '), 1, 200)) GROUP BY 1, 2""")
def chunk_page_assign(spark, d):
    return chunking.with_page(chunks(spark, d), textsearch.pages_of(t(spark, d, "documents"))).select("doc_id", "chunk", F.col("page_number").cast("long").alias("page_number"))


@query(f"""WITH c AS ({CHUNKS}), p AS ({PAGES}), a AS (SELECT c.doc_id, c.chunk, c.text, min(p.page) AS page FROM c JOIN p ON c.doc_id = p.doc_id AND substr(trim(c.text, ' '), 1, 200) <> '' AND contains(p.text, substr(trim(c.text, ' '), 1, 200)) GROUP BY 1, 2, 3),
n AS (SELECT a.doc_id, chunk, a.page, {NORM.format("a.text")} AS x, {NORM.format("p.text")} AS y FROM a JOIN p ON a.doc_id = p.doc_id AND a.page = p.page)
SELECT doc_id, chunk, page AS block_start, page AS block_end FROM n WHERE x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))""")
def chunk_block_range(spark, d):
    """Blocks of each chunk's page that match it; containment and LCS.  A line is a page of one block."""
    pages = textsearch.pages_of(t(spark, d, "documents"))
    blocks = pages.select("doc_id", "page", F.col("page").alias("block_order"), F.col("text").alias("block_content"))
    return chunking.block_ranges(chunking.with_page(chunks(spark, d), pages), blocks)


@query("""SELECT doc_id, list_filter(n, lambda x: length(x) - length(replace(x, '.', '')) = list_max(list_transform(n, lambda y: length(y) - length(replace(y, '.', '')))))[1] AS clause_number
 FROM (SELECT doc_id, regexp_extract_all(text, '\\d+(?:\\.\\d+)*') AS n FROM documents)""")
def clause_number(spark, d):
    return t(spark, d, "documents").select("doc_id", X.clause_number(F.col("text")).alias("clause_number"))




@query(f"SELECT page_id, nullif(trim(regexp_extract(text, '(?m)^#{{1,6}}\\s+(.+)', 1), ' '), '') AS section_path, regexp_matches(text, '(?m)^#{{1,6}}\\s+\\S') AS has_heading FROM ({ARTICLES})")
def section_path(spark, d):
    """The first heading of each page's article."""
    return page_texts(spark, d).select("page_id", X.section_path(F.col("text")).alias("section_path"), X.has_heading(F.col("text")).alias("has_heading"))


@query(f"""WITH a AS (SELECT *, instr(text, chr(10) || '# ') AS p0 FROM ({ARTICLES})), c AS (SELECT page_id, 0 AS i, substr(text, 1, p0) AS part FROM a WHERE p0 > 0 UNION ALL SELECT page_id, 1, substr(text, p0 + 1) FROM a WHERE p0 > 0)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS chunk, sha256(part) AS text_hash FROM c WHERE trim(part, ' ') <> ''""")
def heading_chunks(spark, d):
    """The articles, cut before each heading."""
    return chunking.heading_chunks(page_texts(spark, d), id_col="page_id").select("page_id", "chunk", X.content_hash(F.col("text")).alias("text_hash"))


LEVELS = " ".join(f"WHEN regexp_matches(l, '{p}') THEN {n}" for p, n in X.HEADING_RULES)


@query(f"""WITH l AS (SELECT conv_id, turn, pos, trim((CASE (pos + turn) % 4 WHEN 0 THEN '第' || '三' || '章 ' WHEN 1 THEN (pos + 1) || '.' || (turn + 1) || '.2 ' WHEN 2 THEN '(' || (turn + 1) || ') ' ELSE '' END) || substr(line, 1, 60), ' ') AS l FROM conversations, {LINES.format("text")} u)
SELECT conv_id, turn, pos::INT AS pos, CASE WHEN length(l) BETWEEN 2 AND 80 AND NOT contains('{X.TITLE_ENDS}', right(l, 1)) THEN CASE {LEVELS} END END::INT AS level FROM l""")
def heading_level(spark, d):
    """Levels of the lines of all turns, which get the marks of headings in turn; a heading is short, so 60 characters of each are taken."""
    lines = structure.lines_of(t(spark, d, "conversations").withColumn("_id", F.struct("conv_id", "turn")), id_col="_id").select("_id.*", "pos", "line")
    by = F.pmod(F.col("pos") + F.col("turn"), F.lit(4))
    said = lambda c: (F.col(c) + 1).cast("string")
    mark = F.when(by == 0, "第三章 ").when(by == 1, F.concat(said("pos"), F.lit("."), said("turn"), F.lit(".2 "))).when(by == 2, F.concat(F.lit("("), said("turn"), F.lit(") "))).otherwise("")
    return lines.select("conv_id", "turn", "pos", X.heading_level(F.concat(mark, F.substring("line", 1, 60))).alias("level"))


CHAPTERS = f"""WITH l AS (SELECT page_id, pos, line, nullif(regexp_extract(line, '^##\\s+(.+)$', 1), '') AS title FROM ({SUB_ARTICLES}), {LINES.format("text")} u),
h AS (SELECT page_id, arg_min(title, pos) FILTER (WHERE title IS NOT NULL) AS chapter, min(pos) FILTER (WHERE title IS NOT NULL) AS a, max(pos) + 1 AS b FROM l GROUP BY 1)
SELECT page_id, 1::BIGINT AS chapter_no, chapter, a::INT AS start_pos, b::INT AS end_pos, (SELECT count(DISTINCT nullif(regexp_extract(line, '^(\\d+(?:\\.\\d+)+)\\s', 1), '')) FROM l WHERE l.page_id = h.page_id AND pos >= a)::BIGINT AS n_clauses FROM h WHERE chapter IS NOT NULL"""


@query(CHAPTERS)
def chapter_segments(spark, d):
    """Chapters of the articles, whose headings count as level two here, and how many clauses each has."""
    lines = structure.lines_of(page_texts(spark, d, "##"), id_col="page_id")
    return structure.chapters(lines, id_col="page_id")


@query(f"SELECT page_id, chapter_no || ' ' || chapter || ' (' || n_clauses || ')' AS outline FROM ({CHAPTERS})")
def structure_outline(spark, d):
    return structure.outline(chapter_segments(spark, d), id_col="page_id")


@query(f"SELECT doc_id, pos::INT AS pos, CASE WHEN pos % 5 = 1 THEN '<TABLE>' ELSE line END AS line FROM documents, {LINES.format('text')} u WHERE pos % 5 IN (0, 1, 4)")
def html_table_strip(spark, d):
    """Documents of whose every five lines the second to the fourth are made a table, without these tables."""
    lines = structure.lines_of(t(spark, d, "documents"))
    by = F.col("pos") % 5
    return structure.without_tables(lines.withColumn("line", F.when(by == 1, F.concat(F.lit("<table><tr><td>"), "line")).when(by == 3, F.concat("line", F.lit("</td></tr></TABLE>"))).otherwise(F.col("line"))))


@query("""SELECT doc_id, pos - 1 AS pos, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM (
 SELECT doc_id, u.pos, u.line FROM documents, (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line) u)) WHERE p IS NULL OR line <> p""")
def merged_lines(spark, d):
    """Lines without repeats of the one before."""
    out = structure.merged_lines(structure.lines_of(t(spark, d, "documents")))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query(f"SELECT doc_id, page, n, (coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_block FROM (SELECT doc_id, page, len(regexp_extract_all(text, '\\S+'))::INT AS n FROM ({PAGES}))")
def block_offsets(spark, d):
    """Words on the pages before each page."""
    pages = textsearch.pages_of(t(spark, d, "documents")).select("doc_id", "page", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return structure.running_offset(pages, "n")


@query("""SELECT doc_id, CASE WHEN 1000 >= length(text) THEN '[end of chapter]' ELSE substr(text, 1001, 1000) || CASE WHEN length(text) > 2000 THEN chr(10) || '[continues at 2000]' ELSE '' END END AS body FROM documents""")
def page_window(spark, d):
    return t(spark, d, "documents").select("doc_id", structure.page_window(F.col("text"), F.lit(1000), 1000).alias("body"))


@query("SELECT doc_id, regexp_matches(source, '^[0-9A-Za-z_-]{1,64}$') AS ok, length(text) >= 20 AS indexable, length(trim(text, ' ')) >= 20 AS has_text FROM documents")
def validity(spark, d):
    """Identifier and length checks."""
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", X.valid_id(F.col("source")).alias("ok"), (F.char_length(text) >= 20).alias("indexable"), (F.char_length(F.trim(text)) >= 20).alias("has_text"))


@query("SELECT doc_id, greatest(1, floor(length(text) / 3000))::BIGINT AS pages FROM documents")
def page_count_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", X.page_count_estimate(F.col("text")).alias("pages"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' WHEN 2 THEN 'docx' END AS file_type, regexp_replace(url, '[^\\w\\-.]', '_', 'g') AS safe FROM pages""")
def file_types(spark, d):
    """Types of files named after the pages, and names made safe from their addresses."""
    ending = F.get(F.array(*[F.lit(x) for x in (".PDF", ".markdown", ".doc", ".exe", "")]), (F.col("page_id") % 5).cast("int"))
    named = t(spark, d, "pages").withColumn("name", F.concat(F.lit("file "), F.col("page_id").cast("string"), ending))
    return named.select("page_id", readers.file_type(F.col("name")).alias("file_type"), X.file_name_sanitized(F.col("url")).alias("safe"))


@query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS page, sha256(line) AS text_hash, 100 AS width, 200 AS height, CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END AS n_blocks,
 CASE WHEN pos % 4 = 0 THEN 'text' END AS label, CASE WHEN pos % 4 = 0 THEN 0.1 END::DOUBLE AS x0, CASE WHEN pos % 4 = 0 THEN sha256(line) END AS content_hash FROM documents, {LINES.format('text')} u WHERE pos % 4 <> 3""")
def ocr_pages(spark, d):
    """OCR output made of the lines of all documents, every fourth of them broken: pages numbered through the lines, boxes in shares of the page."""
    lines = structure.lines_of(t(spark, d, "documents"))
    block = F.struct(F.lit("text").alias("block_label"), F.col("line").alias("block_content"), F.array(*[F.lit(x) for x in (10.0, 20.0, 50.0, 60.0)]).alias("block_bbox"))
    blocks = F.when(F.col("pos") % 4 == 0, F.array(block))
    page = F.struct(F.struct(F.col("line").alias("text")).alias("markdown"), F.lit(1).alias("width"), F.struct(F.array(F.lit(100), F.lit(200)).alias("image_size"), blocks.alias("parsing_res_list")).alias("prunedResult"))
    said = F.to_json(F.struct(F.struct(F.array(page).alias("layoutParsingResults")).alias("result")))
    rows = lines.select("doc_id", F.col("pos").alias("ord"), F.when(F.col("pos") % 4 == 3, F.concat(F.lit("not json "), "line")).otherwise(said).alias("line"))
    first = F.get(F.col("blocks"), F.lit(0))
    return readers.ocr_pages(rows).select("doc_id", "page", X.content_hash(F.col("text")).alias("text_hash"), "width", "height", F.size("blocks").alias("n_blocks"), first["block_label"].alias("label"), F.get(first["bbox_norm"], F.lit(0)).alias("x0"), X.content_hash(first["block_content"]).alias("content_hash"))


@query("""SELECT event_id, "at", event, data FROM (SELECT event_id, 0 AS "at", event_type AS event, props AS data FROM events UNION ALL SELECT event_id, 2, 'value', '[' || user_id || ']' FROM events)""")
def sse_events(spark, d):
    """Events as server-sent ones, with blocks among them whose data is no JSON or that have no name."""
    e = t(spark, d, "events")
    text = F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\nevent: b\ndata: {bad\n\nevent: value\ndata: ["), F.col("user_id").cast("string"), F.lit("]\n\ndata: {}"))
    return readers.sse_events(e.select("event_id", text.alias("text")))


# ---- findings -------------------------------------------------------------------------------------------

FINDINGS = """SELECT event_id AS id, user_id, CASE event_type WHEN 'view' THEN 'compliance' WHEN 'click' THEN 'completeness' ELSE 'consistency' END AS type,
 CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity FROM events"""


def as_findings(spark, d):
    e = t(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "compliance").when(F.col("event_type") == "click", "completeness").otherwise("consistency")
    level = F.when(F.col("value") >= 75, "high").when(F.col("value") >= 25, "medium").otherwise("low")
    return e.select(F.col("event_id").alias("id"), "user_id", kind.alias("type"), level.alias("severity"))


@query(f"""SELECT user_id, count(*) AS issues_count, count_if(type = 'compliance')::BIGINT AS compliance_issues, count_if(type = 'completeness')::BIGINT AS completeness_issues, count_if(type = 'consistency')::BIGINT AS consistency_issues,
 count_if(severity = 'high')::BIGINT AS high_severity, count_if(severity = 'medium')::BIGINT AS medium_severity, count_if(severity = 'low')::BIGINT AS low_severity FROM ({FINDINGS}) GROUP BY 1""")
def findings_summary(spark, d):
    return findings.summary(as_findings(spark, d), "user_id")


@query(f"""WITH f AS (SELECT *, 'user ' || user_id AS k, CASE WHEN id % 3 = 0 THEN NULL ELSE 'do ' || id END AS s, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r FROM ({FINDINGS})),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, id) AS n FROM f), g AS (SELECT k, min(id) AS ord, count(*) AS n_merged, count(s) AS told, string_agg(s, '；' ORDER BY id) AS every FROM f GROUP BY 1)
SELECT id, k AS excerpt_key, type, severity, CASE WHEN told > 1 AND s IS NOT NULL THEN every ELSE s END AS suggestion, ord, n_merged FROM b JOIN g USING (k) WHERE n = 1""")
def findings_dedupe(spark, d):
    f = as_findings(spark, d).withColumn("excerpt", F.concat(F.lit("user "), F.col("user_id"))).withColumn("description", F.lit(""))
    f = f.withColumn("suggestion", F.when(F.col("id") % 3 != 0, F.concat(F.lit("do "), F.col("id"))))
    return findings.deduplicated(f)


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS g FROM conversations), k AS (SELECT *, CASE WHEN length(g) >= 10 THEN g ELSE 'at:' || turn END AS key FROM c)
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS r FROM k) WHERE r = 1""")
def flag_guard(spark, d):
    """Turns that repeat an earlier one of their conversation are not flagged again."""
    return findings.guarded(t(spark, d, "conversations"), "conv_id", order="turn", excerpt="text", position="turn").select("conv_id", "turn")


@query("""WITH h AS (SELECT item_id, doc_id, 0 AS strategy FROM benchmark b JOIN documents d ON contains(d.text, b.text)), w AS (SELECT item_id, doc_id, 1 AS strategy FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 40))),
m AS (SELECT item_id, min({'s': strategy, 'd': doc_id}) AS x FROM (SELECT * FROM h UNION ALL SELECT * FROM w) GROUP BY 1) SELECT item_id, x.d AS doc_id, x.s AS strategy FROM benchmark LEFT JOIN m USING (item_id)""")
def link_documents(spark, d):
    """Passages linked to documents that hold them, or else their first 40 characters."""
    docs, items = t(spark, d, "documents"), t(spark, d, "benchmark")
    found = textsearch.holding(docs.select("doc_id", "text"), items.select("item_id", F.col("text").alias("passage"), F.substring("text", 1, 40).alias("needle")))
    start = found.select("item_id", "doc_id", F.col("doc_id").alias("rank"), F.contains("text", "passage").alias("whole"))
    whole, start = start.where("whole").drop("whole"), start.drop("whole")
    return findings.linked(items.select("item_id"), whole, start)


@query("SELECT event_id AS id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE user_id END AS doc_id, d.doc_id IS NULL AS pending FROM events LEFT JOIN (SELECT DISTINCT doc_id FROM labels) d ON user_id = d.doc_id")
def unknown_targets(spark, d):
    f = as_findings(spark, d).withColumnRenamed("user_id", "doc_id")
    return findings.unknown_targets(f, t(spark, d, "labels")).select("id", "doc_id", "pending")


# ---- upkeep ---------------------------------------------------------------------------------------------

TARGETS = """SELECT * FROM (SELECT d.doc_id, d.lang, n_chars, CASE WHEN vec_id IS NULL THEN 'not_embedded' WHEN l.doc_id IS NULL THEN 'missing_pages' WHEN quality = 0 THEN 'empty_layout' END AS reason,
 n_chars // 100 AS page_count, CASE WHEN toxic = 1 THEN 'hit' ELSE 'miss' END AS cache_state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings ON d.doc_id = vec_id) WHERE reason IS NOT NULL"""


def targets(spark, d):
    labels = t(spark, d, "labels").select("doc_id", F.lit(True).alias("has_pages"), F.col("quality").alias("n_layout"), "toxic")
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("embedded").alias("embedding_status"))
    docs = t(spark, d, "documents").join(labels, "doc_id", "left").join(e, "doc_id", "left")
    docs = docs.withColumn("page_count", F.expr("n_chars div 100")).withColumn("cache_state", F.when(F.col("toxic") == 1, "hit").otherwise("miss"))
    return maintenance.reparse_targets(docs)


@query(f"SELECT doc_id, reason FROM ({TARGETS})")
def reparse_targets(spark, d):
    return targets(spark, d).select("doc_id", "reason")


@query(f"SELECT doc_id, page_count > 100 AS skipped FROM ({TARGETS})")
def page_limit_split(spark, d):
    kept, over = maintenance.within_page_limit(targets(spark, d))
    return kept.select("doc_id", F.lit(False).alias("skipped")).union(over.select("doc_id", F.lit(True)))


@query(f"SELECT cache_state, count(*) AS docs, sum(least(100, CASE WHEN page_count > 0 THEN page_count ELSE 11 END))::BIGINT AS pages, count_if(page_count > 100)::BIGINT AS over_limit FROM ({TARGETS}) GROUP BY 1")
def parse_cost(spark, d):
    return maintenance.parse_cost(targets(spark, d))


@query("SELECT CASE WHEN value >= 10 THEN event_type ELSE 'failed' END AS bucket, count(*) AS docs, sum(CASE WHEN value >= 10 THEN user_id END)::BIGINT AS pages FROM events GROUP BY 1")
def usage_buckets(spark, d):
    rows = t(spark, d, "events").select(F.col("event_type").alias("parse_source"), F.col("user_id").alias("pages"), (F.col("value") >= 10).alias("succeeded"))
    return maintenance.usage(rows)


CLASSES = {"licence": ["licensed", "license"], "secret": ["token", "key"], "mail": ["@"]}
CLASS_SQL = """SELECT doc_id, CASE WHEN a > 0 AND a >= b AND a >= c THEN 'licence' WHEN b > 0 AND b >= c THEN 'secret' WHEN c > 0 THEN 'mail' ELSE 'other' END AS class FROM (
 SELECT doc_id, contains(x, 'licensed')::INT + contains(x, 'license')::INT AS a, contains(x, 'token')::INT + contains(x, 'key')::INT AS b, contains(x, '@')::INT AS c FROM (SELECT doc_id, substr(lower(text), 1, 5000) AS x FROM documents))"""


@query(CLASS_SQL)
def document_class(spark, d):
    return evaluation.class_scores(t(spark, d, "documents"), CLASSES).select("doc_id", "class")


@query(f"SELECT class, count(*) AS docs FROM ({CLASS_SQL}) GROUP BY 1")
def class_distribution(spark, d):
    return document_class(spark, d).groupBy("class").agg(F.count("*").alias("docs"))


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(value) AS progress, count(*) AS events FROM events GROUP BY 1")
def latest_state(spark, d):
    return maintenance.latest(t(spark, d, "events"), "user_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'none' WHEN 'signup' THEN 'pending_index' WHEN 'error' THEN 'failed' ELSE 'embedded' END AS recovered FROM events")
def state_recovery(spark, d):
    """What states that a crash left behind become; event types stand for states."""
    state = F.create_map(*[F.lit(x) for x in ("click", "building", "view", "pending_index", "signup", "indexing", "error", "processing", "purchase", "embedded")])[F.col("event_type")]
    return maintenance.recovered(t(spark, d, "events").select("event_id", state.alias("state"))).select("event_id", "recovered")


@query("""WITH f AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, length(text) < 100 ORDER BY 'd' || doc_id) AS r, length(text) < 100 AS bad FROM documents),
g AS (SELECT lang, count(*) AS total, count_if(bad) AS f, coalesce(string_agg('d' || doc_id || ': short', '；' ORDER BY r) FILTER (WHERE bad AND r <= 3), '') AS s FROM f GROUP BY 1)
SELECT lang, f || '/' || total || ' (' || s || CASE WHEN f > 3 THEN '；…' ELSE '' END || ')' AS summary FROM g""")
def failure_summary(spark, d):
    rows = t(spark, d, "documents").select("lang", F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.when(F.char_length("text") < 100, "short").otherwise("ok").alias("outcome"))
    return maintenance.failure_line(rows, "lang")


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'missed' WHEN d.doc_id IS NULL THEN 'extra' WHEN d.n_chars > 500 AND l.quality = 0 THEN 'broken' ELSE 'hit' END AS class, count(*) AS docs
 FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def baseline_compare(spark, d):
    return maintenance.compared(t(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).alias("ok")), t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok")))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN lang ELSE 'new' END AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def replace_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return maintenance.merged_documents(docs, docs.join(t(spark, d, "labels"), "doc_id", "left_semi").withColumn("lang", F.lit("new")))


# ---- evaluation -----------------------------------------------------------------------------------------


def retrieved(spark, d):
    """Documents that hold a benchmark item, by id; the item's first words are what is expected."""
    items = t(spark, d, "benchmark")
    words = F.slice(F.split("text", " "), 1, 5)
    expected = items.select(F.col("item_id").alias("case_id"), F.lit(0).alias("expected_id"), words.alias("keywords"))
    start = items.select(F.col("item_id").alias("case_id"), F.col("text").alias("needle"))
    found = textsearch.holding(t(spark, d, "documents").select("doc_id", "text"), start)
    rank = F.row_number().over(evaluation.Window.partitionBy("case_id").orderBy("doc_id"))
    return found.select("case_id", rank.alias("rank"), F.col("text").alias("content")), expected


CASES = """WITH e AS (SELECT item_id AS case_id, string_split(text, ' ')[1:5] AS k, text AS s FROM benchmark),
r AS (SELECT e.case_id, row_number() OVER (PARTITION BY e.case_id ORDER BY doc_id) AS rank, text AS content, k FROM documents JOIN e ON contains(text, s)),
m AS (SELECT *, len(list_filter(k, lambda x: contains(content, x))) AS h FROM r), g AS (SELECT *, h = len(k) OR (len(k) > 1 AND h >= greatest(1, floor(len(k) * 0.7::DOUBLE))) AS ok FROM m),
a AS (SELECT case_id, count(*) AS results, count_if(rank <= 3)::BIGINT AS shown, count_if(ok AND rank <= 3)::BIGINT AS top, min(rank) FILTER (WHERE ok) AS first FROM g GROUP BY 1)
SELECT e.case_id, CASE WHEN coalesce(shown, 0) > 0 THEN top / shown ELSE 0.0 END AS precision, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, coalesce(1.0::DOUBLE / first, 0.0) AS rr,
 coalesce(results, 0) AS results, CASE WHEN first IS NULL THEN 0 ELSE 1 END::BIGINT AS matched FROM e LEFT JOIN a USING (case_id)"""


@query(CASES)
def retrieval_cases(spark, d):
    results, expected = retrieved(spark, d)
    return evaluation.case_metrics(results, expected, 3)


@query(f"SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, count_if(matched > 0)::BIGINT AS cases_hit, count(*) AS cases FROM ({CASES})")
def retrieval_metrics(spark, d):
    return evaluation.mean_metrics(retrieval_cases(spark, d))


@query("SELECT lang, round(abs(a - b) / greatest(abs(a), abs(b), 0.0001) * 100, 4) AS drift FROM (SELECT lang, avg(n_chars) AS a, median(n_chars) AS b FROM documents GROUP BY 1)")
def metric_drift(spark, d):
    m = t(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("a"), F.median("n_chars").alias("b"))
    return m.select("lang", F.round(evaluation.drift(F.col("a"), F.col("b")), 4).alias("drift"))


@query("""SELECT lang, round(corr(a, b), 4) AS rho FROM (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS a,
 rank() OVER (PARTITION BY lang ORDER BY doc_id) + (count(*) OVER (PARTITION BY lang, doc_id) - 1) / 2 AS b FROM documents) GROUP BY 1""")
def spearman(spark, d):
    return evaluation.spearman(t(spark, d, "documents"), "n_chars", "doc_id", "lang")


@query("SELECT min(n_chars) AS least, median(n_chars) AS middle, round(avg(n_chars), 4) AS mean, count_if(n_chars >= 1000)::BIGINT AS passed FROM documents")
def score_stats(spark, d):
    return t(spark, d, "documents").agg(F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count_if(F.col("n_chars") >= 1000).alias("passed"))


@query("""WITH g AS (SELECT s.v AS size, o.v AS overlap FROM (VALUES (256), (512), (1024)) s(v), (VALUES (0), (50)) o(v)), w AS (SELECT lang, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
SELECT lang, size, overlap, sum(greatest(n - overlap - 1, 0) // (size - overlap) + 1)::BIGINT AS chunks FROM w, g WHERE n > 0 GROUP BY ALL""")
def param_grid(spark, d):
    """How many chunks each combination of size and overlap makes of each language's documents."""
    grid = evaluation.grid(spark, size=[256, 512, 1024], overlap=[0, 50]).select(F.col("size").cast("int").alias("size"), F.col("overlap").cast("int").alias("overlap"))
    words = t(spark, d, "documents").select("lang", F.regexp_count("text", F.lit(r"\S+")).alias("n")).where("n > 0")
    pieces = F.floor(F.greatest(F.col("n") - F.col("overlap") - 1, F.lit(0)) / (F.col("size") - F.col("overlap"))) + 1
    return words.crossJoin(F.broadcast(grid)).groupBy("lang", "size", "overlap").agg(F.sum(pieces).alias("chunks"))  # as many rows as combinations


# ---- messages and streams ---------------------------------------------------------------------------------


@query("SELECT doc_id, 'src_' || substr(md5(doc_id::VARCHAR), 1, 8) || '_p' || CASE WHEN n_chars % 2 = 0 THEN 0 ELSE n_chars % 7 + 1 END AS source_id FROM documents")
def source_ids(spark, d):
    page = F.when(F.col("n_chars") % 2 != 0, F.col("n_chars") % 7)
    return t(spark, d, "documents").select("doc_id", X.source_id(F.col("doc_id").cast("string"), page).alias("source_id"))


@query("SELECT doc_id, len(l) - 1 AS n, sha256(array_to_string(list_transform(l[2:], lambda x: trim(x, ' ')), '|')) AS suggestions_hash FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def suggestions(spark, d):
    """Lines that are marked as suggestions: here all but a document's first."""
    marked = F.replace(F.col("text"), F.lit("\n"), F.lit("\n  > "))
    found = t(spark, d, "documents").select("doc_id", X.lines_with(marked, ">").alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), X.content_hash(F.array_join("s", "|")).alias("suggestions_hash"))


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def chat_history(spark, d):
    return messages.history(t(spark, d, "conversations"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def assembled_messages(spark, d):
    return messages.assembled(t(spark, d, "conversations"), "conv_id", order="turn", text="text")


@query("SELECT conv_id, turn, role, substr(text, 1, 10000) AS content FROM conversations")
def trimmed_trace(spark, d):
    return messages.trimmed_trace(t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")))


@query("""WITH b AS (SELECT conv_id, turn, role, 'd' || (turn % 3) AS doc, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS r, regexp_replace(regexp_replace(coalesce(text, ''), '^[ \n]+', ''), '[ \n]+$', '') AS body FROM conversations)
SELECT conv_id, (turn + 1)::INT AS n, role AS name, doc AS doc_id, turn::INT AS page, sha256(body) AS body_hash FROM b WHERE r = 1""")
def tool_sources(spark, d):
    """Turns as a tool's output about three documents: of the blocks that name one the first stays."""
    c = t(spark, d, "conversations")
    block = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), "role", F.lit(" (doc: d"), (F.col("turn") % 3).cast("string"), F.lit(", page: "), F.col("turn").cast("string"), F.lit(")\n"), F.coalesce("text", F.lit("")))
    said = messages.assembled(c.withColumn("block", F.concat(block, F.lit("\n"))), "conv_id", order="turn", text="block")
    return messages.tool_sources(said).select("conv_id", "n", "name", "doc_id", "page", X.content_hash(F.col("body")).alias("body_hash"))


@query("SELECT event_id, us::DOUBLE / 1000000 AS age_s, us::DOUBLE / 1000000 > 7200 AS expired FROM (SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events)")
def session_ttl(spark, d):
    return messages.sessions(t(spark, d, "events"), "user_id").select("event_id", "age_s", "expired")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def source_dedup(spark, d):
    """The first event of each user and type, the batch form of the stream's deduplication."""
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 5000")
def event_offset_read(spark, d):
    from ..streaming.events import since

    return since(t(spark, d, "events"), 5000).select("event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    """Extension: event-time windows."""
    from ..streaming.events import windowed_counts as windowed

    return windowed(t(spark, d, "events")).select(F.col("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- further upkeep -----------------------------------------------------------------------------------------


@query()
def extra_sample(spark, d):
    """Thirty documents outside the labelled ones, by a seeded hash."""
    return maintenance.extra_sample(t(spark, d, "documents"), t(spark, d, "labels"), 30).select("doc_id")


@query(f"""SELECT doc_id, count(*) AS pages, count(*) AS blocks, list_sort(list(DISTINCT CASE WHEN length(text) > 80 THEN 'text' ELSE 'title' END)) AS labels FROM ({PAGES}) GROUP BY 1""")
def layout_probe(spark, d):
    blocks = textsearch.pages_of(t(spark, d, "documents")).withColumn("block_label", F.when(F.char_length("text") > 80, "text").otherwise("title"))
    return maintenance.layout_probe(blocks)


@query("SELECT event_id, event_type IN ('signup', 'view') AS allowed, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'cancelled' ELSE 'cancelled' END AS after FROM events")
def task_transitions(spark, d):
    """Which tasks can be cancelled, and their state then; event types stand for states."""
    state = F.create_map(*[F.lit(x) for x in ("click", "completed", "view", "processing", "signup", "pending", "error", "failed", "purchase", "cancelled")])[F.col("event_type")]
    return maintenance.transitions(t(spark, d, "events").select("event_id", state.alias("status")), "cancel").select("event_id", "allowed", "after")


@query("""SELECT lang, count(*) AS total, count_if(coalesce(quality = 1, false))::BIGINT AS succeeded, count_if(NOT coalesce(quality = 1, false))::BIGINT AS failed,
 sha256(coalesce(string_agg(doc_id || ':' || CASE WHEN quality IS NULL THEN 'no outcome' ELSE 'low' END, ',' ORDER BY doc_id) FILTER (WHERE NOT coalesce(quality = 1, false)), '')) AS failures FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def bulk_report(spark, d):
    outcomes = t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"), F.when(F.col("quality") != 1, "low").alias("reason"))
    r = maintenance.report(t(spark, d, "documents").select("doc_id", "lang"), outcomes, "lang")
    line = F.array_join(F.transform("failures", lambda x: F.concat_ws(":", x["key"].cast("string"), x["reason"])), ",")
    return r.withColumn("failures", F.sha2(line, 256))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'plain ' || event_type ELSE props END AS json, event_id % 3 <> 2 AS ok FROM events")
def json_blocks(spark, d):
    """JSON in fences, by itself, or none."""
    by = F.col("event_id") % 3
    said = F.when(by == 0, F.concat(F.lit("x ```json\n"), "props", F.lit("\n``` y"))).when(by == 1, F.col("props")).otherwise(F.concat(F.lit("plain "), "event_type"))
    return t(spark, d, "events").select("event_id", F.btrim(X.fenced_json(said), F.lit(" \n")).alias("json")).withColumn("ok", F.try_parse_json("json").isNotNull())


@query(f"SELECT page_id, instr(a.text, '# ') - 1 AS pos FROM ({ARTICLES}) a")
def chapter_locate(spark, d):
    """Where the heading of each article stands, by its name."""
    titles = t(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))
    both = page_texts(spark, d).join(titles, "page_id")
    return both.select("page_id", sections.located(F.col("text"), F.col("title"), F.lit(0)).alias("pos"))


@query(f"""WITH i AS (SELECT doc_id, pos, trim(line, ' ') AS x, least(greatest(pos % 8, 1), 6) AS level FROM documents, {LINES.format('text')} u WHERE trim(line, ' ') <> ''),
l AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN repeat('#', level::INT) || ' ' || x WHEN 4 THEN '<TABLE>' || chr(10) || x || chr(10) || '</TABLE>' ELSE x END AS line FROM i), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l)
SELECT doc_id, sha256(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS text_hash FROM p WHERE p IS NULL OR p <> line GROUP BY 1""")
def rebuilt_markdown(spark, d):
    """Documents put together from their lines, of every five of which one is a title and one a table."""
    by = F.col("pos") % 5
    items = structure.lines_of(t(spark, d, "documents")).select("doc_id", "pos", F.when(by == 0, "title").when(by == 4, "table").otherwise("text").alias("kind"), (F.col("pos") % 8).alias("level"), F.col("line").alias("text"))
    return structure.markdown(items).select("doc_id", X.content_hash(F.col("text")).alias("text_hash"))