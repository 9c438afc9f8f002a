"""Every query of the catalogue against its SQL in DuckDB."""

import math

import duckdb
import pytest

from gridwork import catalog


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    found = [tuple("null" if (x := value(r[i])) is None or isinstance(x, float) and math.isnan(x) else x for i in order) for r in rows]
    return sorted(names), sorted(found, key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, sf)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)


def test_flagship(spark, sf):
    assert {r.value for r in catalog.flagship(spark, sf).collect()} == {"building"}


@pytest.mark.parametrize("name", ["normalize_cells", "enrich_sheet"])
def test_serials_around_day_60(spark, tmp_path, name):
    """Balances shown as dates: before, within and behind the day that the 1900 system has too many."""
    balances = [-0.01, 0.0, 59.99, 60.0, 60.01, 60.99, 61.0, 61.5, 9999.99]
    rows = [(13 * (i + 1), f"Customer#{i}", 1, b, "BUILDING") for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, str(tmp_path))
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)
