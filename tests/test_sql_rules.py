"""Comparison SQL and operators where both must state one rule: equal losses, and divisions by zero."""

import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check import plain  # noqa: E402
from paneloom.operators import selection  # noqa: E402
from paneloom.plans.bindings import TABLES  # noqa: E402

GIVEN = "/root/testdata/sf0.1"


def sql_rows(name, folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con.execute(entry_points.oracle_sql()[name]).fetchdf()


def test_equal_losses_choose_the_first_setting():
    # one model twice: the sums of its terms differ in the last digit by their order
    assert selection.first_of_least([(0.3440809558378159, 1), (0.344080955837816, 0)])[1] == 0
    assert selection.first_of_least([(0.3, 1), (0.4, 0), (0.3 + 1e-6, 2)]) == (0.3, 1)
    assert set(sql_rows("saturated_refit_cells", GIVEN)["setting"]) == {0}


def test_ratios_divided_by_zero_are_unknown(spark, tmp_path):
    """A year of two closed lines without tax and returns: its share of depreciation is 0 / 0."""
    for table in TABLES:
        if table not in ("orders", "lineitem"):
            os.symlink(f"{GIVEN}/{table}.parquet", tmp_path / f"{table}.parquet")
    days = pd.to_datetime(["1996-02-01", "1997-02-01", "1996-03-01", "1997-03-01"])
    orders = pd.read_parquet(f"{GIVEN}/orders.parquet").head(4)
    orders = orders.assign(o_orderkey=[1, 2, 3, 4], o_custkey=[7, 7, 8, 8], o_orderdate=days.astype(orders["o_orderdate"].dtype))
    lines = pd.read_parquet(f"{GIVEN}/lineitem.parquet").head(8)
    lines = lines.assign(l_orderkey=[1, 1, 2, 2, 3, 3, 4, 4], l_linestatus="F", l_tax=[0, 0, 0.02, 0.04, 0.02, 0.02, 0.06, 0.02], l_returnflag=list("AAAARARA"))
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    lines.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    theirs = sql_rows("statement_ratios", tmp_path).sort_values("period")
    ours = entry_points.queries()["statement_ratios"](spark, str(tmp_path)).toPandas().sort_values("period")
    columns = sorted(ours.columns)
    assert [tuple(map(plain, r)) for r in ours[columns].values] == [tuple(map(plain, r)) for r in theirs[columns].values]
    assert ours["depi"].notna().sum() == 1
