import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_agrees_with_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 20))) for _ in range(2))
        assert X.lcs_length(a, b) == lcs(a, b)


def test_denominators_differ():
    a, b = "abcd", "a1b2c3d4"
    assert X.lcs_ratio_at_least(a, b, "min") and not X.lcs_ratio_at_least(a, b, "max")
    assert not X.lcs_ratio_at_least("abc", "abc")  # too short


@pytest.mark.parametrize(
    "line, level",
    [("第一章 总则", 1), ("第三条 范围", 3), ("1.2.3. x", 3), ("1.2 scope", 4), ("1. general", 5), ("(1) item", 6), ("①a", 6), ("x", None), ("a" * 81, None), ("1. ends.", None), ("", None), (None, None)],
)
def test_heading_level(spark, line, level):
    assert spark.createDataFrame([(line,)], "s string").select(X.heading_level(F.col("s"))).first()[0] == level


@pytest.mark.parametrize("text, number", [("a 3.2.1 b 4.5.6", "3.2.1"), ("price 2.50", "2.50"), ("7", "7"), ("none", None), ("", None), (None, None)])
def test_clause_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "s string").select(X.clause_number(F.col("s"))).first()[0] == number


def test_normalisation(spark):
    rows = spark.createDataFrame([("（ＡＢ）１。　x​", "GB/T 20145-2006"), (None, None), ("ß", "")], "a string, b string")
    got = [tuple(r) for r in rows.select(X.normalized("a"), X.standard_form("b")).collect()]
    assert got == [("ab1x", "gbt201452006"), ("", ""), ("ss", "")]


def test_snippet_window(spark):
    raw = "x" * 100 + "KEY" + "y" * 300
    got = spark.createDataFrame([(raw,)], "s string").select(X.snippet(F.col("s"), F.lit(100), F.lit("KEY"))).first()[0]
    assert got == raw[20:303]
