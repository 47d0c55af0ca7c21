"""Documents into fields: by the prefix of their standard number, else by keywords in their names, else in their texts.

The rules are tables: ``prefixes`` (``ord, code, prefix``) and ``words`` (``ord, code, word``), ``ord`` being the field's place.
Prefixes meet numbers in equi-joins over all beginnings of either; keywords are found by one automaton, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keywords import holding

#: A standard number at the beginning of a file's name; fixed value.
NUMBER = r"^\[([A-Z]+[ /T\d]*\d+)"
OTHER = "99_其他"
#: Characters of a text in which keywords count.
CONTENT_MOST = 5000


def by_number(names: DataFrame, prefixes: DataFrame, *, id_col: str) -> DataFrame:
    """``id_col, code`` of names whose number begins with a prefix of the rules, or which a prefix begins with; of several fields the first."""
    numbers = names.select(id_col, F.upper(F.regexp_extract("name", NUMBER, 1)).alias("n")).where("n <> ''")
    rules = prefixes.select("ord", "code", F.upper("prefix").alias("p")).where("p <> ''")
    begins = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda k: F.substr(F.col(c), F.lit(1), k)))
    long = numbers.select(id_col, begins("n").alias("p")).join(rules, "p")
    short = rules.select("ord", "code", begins("p").alias("n")).distinct().join(numbers, "n")
    every = long.select(id_col, "ord", "code").union(short.select(id_col, "ord", "code"))
    return every.groupBy(id_col).agg(F.min(F.struct("ord", "code")).alias("m")).select(id_col, "m.code")


def by_words(texts: DataFrame, words: DataFrame, *, id_col: str) -> DataFrame:
    """``id_col, code`` of the field most of whose words the text (``low``, in lower case) holds; of equal ones the first."""
    rules = words.select("ord", "code", "word").where("word <> ''")
    found = holding(texts, rules.select(F.col("word").alias("needle")).distinct(), text_col="low", keep=[id_col])
    scored = found.join(rules, F.col("needle") == F.col("word")).groupBy(id_col, "ord", "code").agg(F.count("*").alias("n"))
    return scored.groupBy(id_col).agg(F.min(F.struct(-F.col("n"), "ord", "code")).alias("m")).select(id_col, "m.code")


def classified(docs: DataFrame, prefixes: DataFrame, words: DataFrame, *, id_col: str = "doc_id", name_col: str = "name", text_col: str = "text") -> DataFrame:
    """``id_col, code`` of every document, ``99_其他`` where no rule holds.  Ids must be unique; null names and texts hold nothing."""
    given = docs.select(id_col, F.coalesce(name_col, F.lit("")).alias("name"), F.coalesce(text_col, F.lit("")).alias("text"))
    first = by_number(given, prefixes, id_col=id_col)
    second = by_words(given.select(id_col, F.lower("name").alias("low")), words, id_col=id_col)
    third = by_words(given.select(id_col, F.substring(F.lower("text"), 1, CONTENT_MOST).alias("low")), words, id_col=id_col)
    out = docs.select(id_col)
    for i, found in enumerate((first, second, third)):
        out = out.join(found.withColumnRenamed("code", f"_{i}"), id_col, "left")
    return out.select(id_col, F.coalesce("_0", "_1", "_2", F.lit(OTHER)).alias("code"))
