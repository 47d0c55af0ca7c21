"""Chapters and clauses of whole documents: a state machine over lines, told as windows.

Each line gets a kind from the patterns and from what its document has at all (the chapter level is 1 where there is a heading
of level 1, else 2; Chinese headings and short lines count only without Markdown headings).  Counting the lines that open
something gives every line its chapter and its clause.  All windows share one distribution, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------------
CN_PART = "^第[一二三四五六七八九十百]+[部分章节编篇]"
CN_NUMBER = "^[一二三四五六七八九十]+[、.．]"
CN_PAREN = "^（[一二三四五六七八九十]+）\\s*(.*)"
#: A short line that ends so, or holds a comma, is no heading.
SENTENCE_ENDS = "[。；：.!?]$"
PREFACE = "前言"
WITH_TABLE = "[包含表格数据]"
#: A clause's text, a heading by itself, a short line, a line with a dotted number, in characters.
CLAUSE_MOST, HEADING_MOST, SHORT_MOST, NUMBERED_MOST = 200, 100, 30, 200
#: Characters of a chapter that no next chapter ends; characters from which on a stored chapter text is taken as it is.
UNBOUNDED_MOST, ENOUGH = 2000, 100

_WHITE = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _WHITE, "")


def flattened(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, pos, at, line``: the lines of each text, from which HTML tables are taken out but for a line ``<TABLE>`` where one opens; ``at``
    is where the line starts.  Null texts have no lines.  Ids must be unique."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    over = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    low = F.lower("line")
    opens, closes = F.contains(low, F.lit("<table")), F.contains(low, F.lit("</table>"))
    inside = F.coalesce(F.last(F.when(opens & ~closes, True).when(closes & ~opens, False), True).over(over), F.lit(False))
    told = lines.select(id_col, "pos", F.coalesce(F.sum(F.char_length("line") + 1).over(over), F.lit(0)).alias("at"), F.when(opens, "<TABLE>").when(~closes & ~inside, F.col("line")).alias("line"))
    return told.where("line is not null")


def number_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(stripped(c), r"^(\d+(?:\.\d+)*)", 1), F.lit(""))


def heading_of(c: Column) -> Column:
    """A heading without emphasis and leading number."""
    plain = F.regexp_replace(stripped(c), r"\*\*(.*?)\*\*", "$1")
    return stripped(F.regexp_replace(plain, r"^\d+(?:\.\d+)*\.?\s*", ""))


def lines_with_kind(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that are not blank, with ``kind`` (chapter, clause, own, none, table or text), ``number`` and ``head`` (what the line itself
    says, for chapters and clauses).

    ``own`` is a clause that stands by itself and is counted within its chapter; ``none`` opens text that belongs to no clause.
    """
    lines = flattened(docs, id_col=id_col, text_col=text_col)
    every = Window.partitionBy(id_col)
    of = F.regexp_extract
    hit = lambda p: F.rlike("s", F.lit(p))
    first = F.max(F.rlike("line", F.lit(r"^#\s+\S"))).over(every)
    marked = F.max(F.rlike("line", F.lit(r"^#{1,3}\s+\S"))).over(every)
    lines = lines.withColumn("_h1", first).withColumn("_md", marked).withColumn("s", stripped(F.col("line"))).where("s <> ''")
    n = F.char_length("s")
    clause = r"^(\d+(?:\.\d+)*)[）).、]\s+(.*)"
    dotted = r"^(\d+(?:\.\d+)+)\s+(.*)"
    chapter = F.when(F.col("_h1"), hit(r"^#\s+.+$")).otherwise(hit(r"^##\s+.+$"))
    chinese = ~F.col("_md") & (hit(CN_PART) | (hit(CN_NUMBER) & (n < HEADING_MOST)))
    paren = ~F.col("_md") & hit(CN_PAREN) & (n < HEADING_MOST)
    short = ~F.col("_md") & (n <= SHORT_MOST) & ~hit(SENTENCE_ENDS) & ~hit(r"^\d+(?:\.\d+)*[）).、\s]") & ~hit("[，,]")
    third, second = hit(r"^###\s+.+$"), F.col("_h1") & hit(r"^##\s+.+$")
    title = F.regexp_replace("s", r"^#{1,3}\s+", "")
    has_number = number_of(title).isNotNull()
    by_mark, by_dots = hit(clause), ~hit("^[<!?]") & hit(dotted) & (n < NUMBERED_MOST)
    cases = [
        (chapter, "chapter", number_of(title), heading_of(title)), (chinese, "chapter", None, F.col("s")), (paren, "own", None, of("s", CN_PAREN, 1)), (short, "own", None, F.col("s")),
        (third & has_number, "heading", number_of(title), heading_of(title)), (third | second, "none", None, None), (by_mark, "clause", of("s", clause, 1), stripped(of("s", clause, 2))),
        (by_dots, "clause", of("s", dotted, 1), stripped(of("s", dotted, 2))), (F.col("s") == "<TABLE>", "table", None, None),
    ]
    rule = F.lit(len(cases))
    for i in range(len(cases) - 1, -1, -1):
        rule = F.when(cases[i][0], i).otherwise(rule)
    pick = lambda values: F.coalesce(*[F.when(F.col("_rule") == i, v if isinstance(v, Column) else F.lit(v)) for i, v in enumerate(values) if v is not None])
    told = lines.withColumn("_rule", rule)
    return told.select(id_col, "pos", "at", "s", F.coalesce(pick([c[1] for c in cases]), F.lit("text")).alias("kind"), pick([c[2] for c in cases]).alias("number"), pick([c[3] for c in cases]).alias("head"))


def placed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with ``chapter`` (from 0; what stands before the first one is a preface) and ``part`` (the line's clause or stretch without one)."""
    lines = lines_with_kind(docs, id_col=id_col, text_col=text_col)
    over = Window.partitionBy(id_col).orderBy("pos")
    begun = F.count(F.when(F.col("kind") == "chapter", 1)).over(over)
    preface = F.first(F.col("kind") != "chapter").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    opens = F.col("kind").isin("chapter", "clause", "heading", "own", "none")
    return lines.withColumn("chapter", begun - F.when(preface, 0).otherwise(1)).withColumn("part", F.count(F.when(opens, 1)).over(over))


def clauses(lines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, chapter, clause_no, number, text`` from ``placed`` lines: a clause's text runs to the line that opens something else, 200 characters at most;
    the next clause of the same number goes on with it unless it says the same."""
    keys = [id_col, "chapter", "part"]
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "s"))))
    parts = lines.groupBy(*keys).agg(
        F.max_by("kind", F.when(F.col("kind").isin("clause", "heading", "own"), 1)).alias("kind"), F.max("number").alias("number"), F.max("head").alias("head"),
        F.transform(said, lambda x: x["s"]).alias("body"), F.max((F.col("kind") == "table").cast("int")).alias("table"),
    )
    text = lambda c: stripped(F.array_join(F.filter(c, lambda x: x != ""), " "))
    whole = F.when(F.col("kind") == "clause", F.array(text(F.concat(F.array(F.coalesce("head", F.lit(""))), "body")))).when(F.col("kind") == "heading", F.array(F.col("head"), text(F.col("body")))).otherwise(F.array("head"))
    # A table belongs to the clause that was complete when it began: the heading's or own one, else the one before.
    told = parts.withColumn("texts", whole).withColumn("real", F.col("kind").isin("heading", "own") | ((F.col("kind") == "clause") & (F.get("texts", F.lit(0)) != "")))
    by_chapter = Window.partitionBy(id_col, "chapter").orderBy("part")
    shown = F.when(F.col("kind").isin("heading", "own"), F.col("part")).otherwise(F.last(F.when(F.col("real"), F.col("part")), True).over(by_chapter.rowsBetween(Window.unboundedPreceding, -1)))
    told = told.withColumn("_t", F.when(F.col("table") == 1, shown))
    told = told.withColumn("tabled", F.array_contains(F.collect_set("_t").over(Window.partitionBy(id_col, "chapter")), F.col("part"))).where("real")
    before = F.lag(F.struct("kind", "number")).over(by_chapter)
    anew = F.coalesce(before["kind"], F.lit("own")).eqNullSafe("own") | F.col("kind").isin("own") | ~before["number"].eqNullSafe(F.col("number"))
    told = told.withColumn("clause_no", F.sum(F.when(anew, 1).otherwise(0)).over(by_chapter))
    rows = F.array_sort(F.collect_list(F.struct("part", "kind", "number", "texts", "tabled")))
    grown = F.aggregate(
        F.flatten(F.transform("rows", lambda r: r["texts"])), F.lit(None).cast("string"),
        lambda a, x: F.when(a.isNull(), F.substring(x, 1, CLAUSE_MOST)).when((x == "") | F.contains(a, x) | (F.char_length(a) >= CLAUSE_MOST), a).otherwise(F.concat(a, F.lit(" "), F.substr(x, F.lit(1), CLAUSE_MOST - F.char_length(a)))),
    )
    out = told.groupBy(id_col, "chapter", "clause_no").agg(rows.alias("rows"))
    has = F.exists("rows", lambda r: r["tabled"])
    number = F.when(F.get("rows", F.lit(0))["kind"] == "own", F.col("clause_no").cast("string")).otherwise(F.get("rows", F.lit(0))["number"])
    return out.select(id_col, "chapter", F.col("clause_no").cast("long").alias("clause_no"), number.alias("number"), F.when(has, F.concat(F.rtrim(grown), F.lit(" " + WITH_TABLE))).otherwise(grown).alias("text"))


def chapters(docs: DataFrame, lines: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, chapter, number, title, text, n_clauses`` of documents and their ``placed`` lines; ``text`` runs from the chapter's line to the next chapter's."""
    heads = lines.groupBy(id_col, "chapter").agg(F.max(F.when(F.col("kind") == "chapter", F.struct("number", "head"))).alias("h"), F.min("at").alias("at"))
    over = Window.partitionBy(id_col).orderBy("chapter")
    begin = F.when(F.col("chapter") == 0, F.when(F.col("h").isNull(), 0).otherwise(F.col("at"))).otherwise(F.col("at"))
    sized = heads.withColumn("_a", begin).withColumn("_b", F.lead("at").over(over))
    counted = clauses(lines, id_col=id_col).groupBy(id_col, "chapter").agg(F.count("*").alias("n_clauses"), F.slice(F.array_sort(F.collect_list(F.struct("clause_no", "number"))), 1, 10).alias("first"))
    body = stripped(F.substr(F.col(text_col), (F.col("_a") + 1).cast("int"), (F.coalesce("_b", F.char_length(text_col)) - F.col("_a")).cast("int")))
    out = docs.select(id_col, text_col).join(sized, id_col).join(counted, [id_col, "chapter"], "left")
    return out.select(
        id_col, F.col("chapter").cast("long").alias("chapter"), F.col("h")["number"].alias("number"), F.coalesce(F.col("h")["head"], F.lit(PREFACE)).alias("title"),
        body.alias("text"), F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"), F.transform(F.coalesce("first", F.array().cast("array<struct<clause_no:bigint,number:string>>")), lambda x: x["number"]).alias("clauses"),
    )


def outline(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, outline``: a line for each of a document's chapters with its number, or its place, its title and its first ten clauses."""
    more = F.when(F.col("n_clauses") > 10, "...").otherwise("")
    told = F.when(F.col("n_clauses") > 0, F.concat(F.lit("（"), F.col("n_clauses").cast("string"), F.lit(" 个条款: "), F.array_join("clauses", ", "), more, F.lit("）"))).otherwise("")
    name = F.coalesce("number", F.concat(F.lit("第"), (F.col("chapter") + 1).cast("string"), F.lit("章")))
    line = F.concat(F.trim(F.concat(F.lit("  "), name, F.lit(" "), F.col("title"))), told)
    rows = F.array_sort(F.collect_list(F.struct("chapter", line.alias("line"))))
    return found.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("outline"))


def label(number: Column, title: Column, chapter: Column) -> Column:
    """What a chapter is called in running text."""
    plain = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("第"), (chapter + 1).cast("string"), F.lit("章")))
    return F.when(F.coalesce(number, F.lit("")) != "", F.trim(F.concat(F.lit("第"), number, F.lit("章 "), F.coalesce(title, F.lit(""))))).otherwise(plain)


def located(text: Column, name: Column, after: Column) -> Column:
    """Where a chapter's name stands (0-based, not before ``after``), or -1: as a heading, as a line, at a line's start, anywhere."""
    rest = F.substr(text, after + 1)
    quoted = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    found = lambda pattern: F.nullif(F.regexp_instr(rest, pattern), F.lit(0))
    tried = [F.concat(F.lit("#+\\s+"), quoted), F.concat(F.lit("(?m)^"), quoted, F.lit("\\s*$")), F.concat(F.lit("(?m)^"), quoted), quoted]
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(-1)).otherwise(F.coalesce(after + F.coalesce(*map(found, tried)) - 1, F.lit(-1)))


def chapter_texts(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, chapter, text``: the stored text of a chapter if it is long enough; else from the place of its label, or of its title, to the next
    chapter's; where that isn't found, 2,000 characters; the last chapter runs to the end."""
    over = Window.partitionBy(id_col).orderBy("chapter")
    named = found.withColumn("_name", label(F.col("number"), F.col("title"), F.col("chapter"))).withColumn("_own", F.col("text"))
    named = named.select(id_col, "chapter", "_own", "_name", "title", F.lead("_name").over(over).alias("_next"), F.lead("title").over(over).alias("_next_title"))
    text = F.col("_whole")
    zero = F.lit(0)
    either = lambda name, title, after: F.when(located(text, name, after) >= 0, located(text, name, after)).when(F.coalesce(title, F.lit("")) != name, located(text, title, after)).otherwise(-1)
    told = named.join(docs.select(id_col, F.col(text_col).alias("_whole")), id_col)
    told = told.withColumn("_a", F.greatest(either(F.col("_name"), F.col("title"), zero), zero)).withColumn("_b", F.when(F.col("_next").isNotNull(), either(F.col("_next"), F.col("_next_title"), F.col("_a"))))
    size = F.when(F.col("_next").isNull(), F.char_length(text)).when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")).otherwise(UNBOUNDED_MOST)
    return told.select(id_col, "chapter", F.when(F.char_length("_own") > ENOUGH, F.col("_own")).otherwise(stripped(F.substr(text, F.col("_a") + 1, size))).alias("text"))
