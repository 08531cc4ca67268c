"""Every registered query with a SQL twin gives the twin's rows (the smallest tables)."""

import math

import pytest

import __spark_entry__ as entry

CORE = [n for n in sorted(entry.registry.oracle_sql())]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return v if v is None else str(v)


@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, sf_dir, duck, name):
    df = entry.registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_registered_once():
    assert len(entry.queries()) >= len(CORE) and set(entry.oracle_sql()) <= set(entry.queries())
