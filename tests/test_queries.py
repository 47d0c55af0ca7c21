"""Every query that has an SQL form against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from corpusloom.plans import further as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return round(float(v), 6) if hasattr(v, "__float__") and not isinstance(v, (int, bool)) else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_agrees_with_sql(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = duck.execute(plans.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert in_order([tuple(plain(r[c]) for c in columns) for r in df.collect()]) == in_order(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_block_ranges_of_all_chunks(spark, tmp_path):
    """Every chunk whose first 200 characters one line holds has the first such line as its range."""
    rows = [(i, "s", "\n".join(f"doc{i}line{n} " + " ".join(f"w{i}x{n}x{j}" for j in range(60 + 25 * i)) for n in range(30))) for i in range(4)] + [(9, "s", "short"), (10, "s", "\n".join(f"brief line {n}" for n in range(400)))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc, _, text in rows:
        seen, found = 0, {}
        for n, line in enumerate(text.split("\n") if len(text) >= 20 else []):
            found.setdefault(seen // 512, []).append(line)
            seen += len(line.split())
        for chunk, lines in found.items():
            prefix = "\n".join(lines).strip(" ")[:200]
            page = next((n for n, line in enumerate(text.split("\n")) if prefix in line), None)
            want |= {(doc, chunk, page, page)} if page is not None else set()
    got = {(r.doc_id, r.chunk, r.block_start, r.block_end) for r in plans.QUERIES["chunk_block_range"](spark, str(tmp_path)).collect()}
    assert got == want and max(c for _, c, _, _ in got) > 3


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
