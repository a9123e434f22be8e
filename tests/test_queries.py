"""Every query against its DuckDB SQL on the same tables; the rest run and give rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(lambda x: "" if x is None else f"{x:030.4f}" if isinstance(x, float) else str(x))).reset_index(drop=True)


NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline" and not n.startswith("opn")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = tidy(entry.queries()[name](spark, SF).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = tidy(duck.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        for a, b in zip(got[c], want[c]):
            if isinstance(a, float) or isinstance(b, float):
                assert (a is None) == (b is None) and (a is None or abs(a - b) <= 2e-5 * max(1, abs(a))), (c, a, b)
            else:
                assert (a is None and b is None) or a == b, (c, a, b)
