"""Scans and sinks: text, binary and JSON sources, OCR output, event streams in text form, the parse cache, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import unit_box, unit_polygon

#: Extension -> file type; fixed values.
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx", "md": "md", "markdown": "md", "txt": "txt"}


def file_type(name: Column) -> Column:
    """The type by extension, or null for an extension that is not supported."""
    table = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def read_files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """``path, name, file_type, length, content_hash, content`` of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), file_type(name).alias("file_type"), "length", F.sha2("content", 256).alias("content_hash"), "content")


def parsed_files(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """``files`` with ``text`` and ``error``: text formats are decoded, others go to ``parsers[file_type]``, a function from
    bytes to text that runs in Arrow batches; a failure is recorded on its row alone."""
    plain = files.where(F.coalesce("file_type", F.lit("txt")).isin("md", "txt"))
    out = plain.withColumn("text", F.expr("make_valid_utf8(cast(content as string))")).withColumn("error", F.lit(None).cast("string"))
    for kind, parse in (parsers or {}).items():

        def run(batches, parse=parse):
            for rows in batches:
                texts, errors = [], []
                for content in rows["content"]:
                    try:
                        texts.append(parse(bytes(content)))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  the parser's failures are data
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield rows.assign(text=texts, error=errors)

        part = files.where(F.col("file_type") == kind)
        out = out.unionByName(part.mapInPandas(run, out.schema))
    return out


def with_parse_cache(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """``files`` with ``cached`` text and ``cache_state`` (hit, miss), by content hash and parser version."""
    known = cache.where(F.col("version") == version).select("content_hash", F.col("text").alias("cached"))
    joined = files.join(known, "content_hash", "left")
    return joined.withColumn("cache_state", F.when(F.col("cached").isNotNull(), "hit").otherwise("miss"))


def guarded(docs: DataFrame, *, least: int = 20) -> DataFrame:
    """``docs`` (``text, n_layout, n_pages``) with ``failure``: the first guard that a parse result breaks, or null."""
    reason = (
        F.when(F.char_length(F.coalesce("text", F.lit(""))) < least, "text too short")
        .when(F.coalesce("n_layout", F.lit(0)) == 0, "no layout").when(F.coalesce("n_pages", F.lit(0)) == 0, "no pages")
    )
    return docs.withColumn("failure", reason)


def ocr_pages(lines: DataFrame, *, id_col: str = "doc_id", line_col: str = "line", order_col: str = "ord") -> DataFrame:
    """Pages of OCR output, one row each, numbered through the lines: ``id, page, text, width, height, blocks``.  Lines that
    are not JSON of the expected form are left out.

    A page's size is its image size, else the pruned result's, else its own; boxes become shares of it.
    """
    from pyspark.sql import Window

    parsed = lines.select(id_col, order_col, F.from_json(line_col, schemas.OCR_LINE, {"mode": "PERMISSIVE"}).alias("j")).where(F.col("j.result.layoutParsingResults").isNotNull())
    pages = parsed.select(id_col, order_col, F.posexplode("j.result.layoutParsingResults").alias("at", "p"))
    page = F.row_number().over(Window.partitionBy(id_col).orderBy(order_col, "at")) - 1
    width = F.coalesce(F.try_element_at("p.prunedResult.image_size", F.lit(1)), F.col("p.prunedResult.width"), F.col("p.width"))
    height = F.coalesce(F.try_element_at("p.prunedResult.image_size", F.lit(2)), F.col("p.prunedResult.height"), F.col("p.height"))
    sized = pages.select(id_col, page.alias("page"), F.coalesce("p.markdown.text", F.lit("")).alias("text"), width.alias("width"), height.alias("height"), F.col("p.prunedResult.parsing_res_list").alias("raw"))

    def block(b, i):
        return F.struct(
            F.coalesce(b["block_order"], i).alias("block_order"), b["block_label"].alias("block_label"), F.coalesce(b["block_content"], F.lit("")).alias("block_content"),
            unit_box(b["block_bbox"], F.col("width"), F.col("height")).alias("bbox_norm"), unit_polygon(b["block_polygon"], F.col("width"), F.col("height")).alias("polygon_norm"),
        )

    return sized.withColumn("blocks", F.transform(F.coalesce("raw", F.array()), block)).drop("raw")


def sse_events(texts: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``texts`` without ``text_col``, one row for each complete server-sent event whose data is JSON: ``event, data``."""
    parts = F.posexplode(F.filter(F.split(F.col(text_col), "\n\n"), lambda b: F.rlike(b, F.lit(r"(?m)^event: ?\S")) & F.rlike(b, F.lit("(?m)^data:"))))
    rest = [c for c in texts.columns if c != text_col]
    rows = texts.select(*rest, parts.alias("at", "block"))
    data = F.regexp_extract("block", r"(?m)^data: ?(.*)$", 1)
    return rows.select(*rest, "at", F.regexp_extract("block", r"(?m)^event: ?(.*)$", 1).alias("event"), data.alias("data")).where(F.try_parse_json("data").isNotNull())


def json_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of the JSON lines of all files under ``path``, and the lines that are not of that form: ``file, at, record`` and
    ``file, at, line``; ``at`` ascends within a file.  Blank lines are neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_n"), F.col("value").alias("line"))
    told = lines.where(F.trim("line") != "").select("file", F.struct("_from", "_n").alias("at"), "line", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("record"))
    good = F.col("record").isNotNull() & F.col("record._bad").isNull()
    return told.where(good).select("file", "at", F.col("record").dropFields("_bad").alias("record")), told.where(~good).select("file", "at", "line")


def parse_route(files: DataFrame, cache: DataFrame, version: str, *, least: int = 20) -> DataFrame:
    """``files`` (``content_hash, layer_text, ocr_text``) with ``text`` and ``route``: what the cache has of the content and version, else the text layer if
    it holds ``least`` characters, else what OCR gave; ``error`` where all are missing.  Of equal cache entries any holds."""
    known = with_parse_cache(files, cache.dropDuplicates(["content_hash", "version"]), version)
    layer = F.when(F.char_length("layer_text") >= least, F.col("layer_text"))
    route = F.when(F.col("cached").isNotNull(), "cache").when(layer.isNotNull(), "text_layer").when(F.col("ocr_text").isNotNull(), "ocr").otherwise("error")
    return known.withColumn("text", F.coalesce("cached", layer, "ocr_text")).withColumn("route", route).drop("cached", "cache_state")
