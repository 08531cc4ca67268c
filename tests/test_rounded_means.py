"""Means that lie in the middle of two tenths, and scores that are made of them, equal the SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

KINDS = ["click", "view", "purchase", "signup", "error"]
#: lists whose mean falls otherwise where tenths are rounded by its shortest digits, or where the halves of the list are added by themselves
BY_DIGITS, BY_ORDER = [97.08, 38.37, 33.9], [1.9, 9.9, 8.6, 1.2, 3.3, 7.2]


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Events of 40 users in two files: users 1 and 2 have nothing but the lists above, the others a value near by."""
    root = tmp_path_factory.mktemp("means")
    (root / "events.parquet").mkdir()
    rows = []
    for k, kind in enumerate(KINDS):
        for user, told in [(1, BY_DIGITS), (2, BY_ORDER), *((u, [(56 if u % 2 else 5) + (u + k) % 11 / 10]) for u in range(3, 40))]:
            rows += [(i, user, kind, v) for i, v in enumerate(told)]
    for part in (0, 1):
        ids, users, kinds, values = zip(*sorted((i, u, t, v) for i, u, t, v in rows if (i >= 3) == part))
        pq.write_table(pa.table({"event_id": ids, "user_id": users, "event_type": kinds, "value": values}), root / "events.parquet" / f"part-{part}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["h02_oriented", "h03_rank_losses", "h04_tie_rules", "h05_mean_losses", "h05_median_losses"])
def test_equals_sql(spark, events, name):
    con = duckdb.connect(config={"threads": 1})  # more threads add a group's values in parts
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet/*.parquet')")
    df = entry.queries()[name](spark, events)
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]}) q").fetchall())
    assert got == want
