"""Registered queries next to their comparison SQL on the smallest tables.

A spread of quick queries runs by default; ALL_QUERIES=1 runs every one.
"""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check import plain  # noqa: E402
from paneloom.plans.bindings import TABLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = """as_of_panel matched_pairs opinion_results endpoint_outcomes resolved_decisions endpoint_completion event_cluster_dedup
source_labels candidate_targets fold_eligibility posterior_quadrature average_precision roc_auc bootstrap_delta cost_threshold registered_ratios
coverage_diagnostics rolling_splits channel_holdout minimax_regret known_case_ranks mcse_summary event_reconciliation""".split()
NAMES = sorted(entry_points.queries()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    answer = duck.execute(sql)
    heads = [d[0] for d in answer.description]
    assert sorted(heads) == columns
    theirs = Counter(tuple(plain(r[heads.index(c)]) for c in columns) for r in answer.fetchall())
    assert ours == theirs


def test_entry_and_registry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
