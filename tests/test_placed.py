"""Bindings whose rows Spark numbers by ranges, and what reads them."""

import re

import duckdb

from pyspark.sql import functions as F

from paneloom.operators import mcse, ranking
from paneloom.plans.bindings import TABLES, Inputs, comparison_sql

FOLDER = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_numbered_without_a_window_over_a_group(spark):
    facts = Inputs(spark, FOLDER)("fx_facts")
    assert "Window" not in plan(facts)  # a window would hold one of 25 groups in a task
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    theirs = con.execute(comparison_sql("SELECT o_orderkey, scenario_id, method_id, replication_id, order_value FROM fx_facts")).fetchall()
    columns = ["o_orderkey", "scenario_id", "method_id", "replication_id", "order_value"]
    assert sorted(map(tuple, facts.select(*columns).collect())) == sorted(theirs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fx_facts")]


def test_bijection_aggregates_both_sides_once(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n int")
    right = spark.createDataFrame([("b", 2), ("c", 3), ("c", 3)], "k string, n int")
    found = mcse.coordinate_bijection(left, right, ["k", "n"])
    assert sorted(map(tuple, found.collect())) == [("a", 1, "left_only"), ("c", 3, "right_only")]
    assert "Join" not in plan(found)


def test_coverage_reads_facts_for_copies_alone(spark):
    rows = [("s", "m", "x", 1, "core"), ("s", "m", "x", 1, "core"), ("s", "m", "y", 1, "extended"), ("s", "o", "x", 1, "core")]
    facts = spark.createDataFrame(rows, "scenario_id string, method_id string, metric_id string, replication_id int, learner_tier string")
    methods = spark.createDataFrame([("s", "m", "core"), ("s", "p", "core")], "scenario_id string, method_id string, learner_tier string")
    found = mcse.validate_coverage(facts, methods, ["x", "z"])
    assert len(re.findall(r"Scan \w*\[[^\]]*replication_id", plan(found))) == 1  # the rest comes from a few rows a cell
    assert sorted((r["method_id"], r["metric_id"] or "", r["reason"]) for r in found.collect()) == [
        ("m", "", "METADATA_CONFLICT"), ("m", "x", "DUPLICATE_FACT"), ("m", "y", "METRIC_UNEXPECTED"), ("m", "z", "METRIC_MISSING"),
        ("o", "", "METHOD_UNEXPECTED"), ("o", "z", "METRIC_MISSING"), ("p", "", "METHOD_MISSING"),
    ]


def test_running_sums_over_a_fixed_number_of_ranges(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS g", "id * 7919 % 1000 AS v")
    some = ranking.running(rows, ["g"], [("v", True)], {"n": F.lit(1), "s": F.col("v")}, ranges=37)
    assert some.rdd.getNumPartitions() == 37
    got = sorted(map(tuple, some.select("g", "v", "n", "s").collect()))
    want, n, s = [], {}, {}
    for v, g in sorted((r["v"], r["g"]) for r in rows.collect()):
        n[g], s[g] = n.get(g, 0) + 1, s.get(g, 0) + v
        want.append((g, v, n[g], s[g]))
    assert got == sorted(want)
