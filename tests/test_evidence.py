"""Reason cascades, order independence and tri-state rules of the evidence operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paneloom.functions.provenance import canonical_references, mine_provenance
from paneloom.operators import cells, decisions, evidence, labels, riskset

DAY = dt.datetime(2020, 3, 31, 12)
ENDPOINT = [{"item": "x", "unit": "U", "scope": "g", "family": "s", "threshold": 0.05}]


def pairs(spark, rows, floor=1.0, endpoints=ENDPOINT):
    panel = spark.createDataFrame([("e", 2019, DAY)], "entity_id string, period int, anchor timestamp_ntz")
    df = spark.createDataFrame(
        [("e", 2019, "x", s, v, u, c, f) for s, v, u, c, f in rows],
        "entity_id string, period int, item string, status string, value double, unit string, scope string, family string",
    )
    return evidence.matched_pairs(panel, df, endpoints, floor).first()


@pytest.mark.parametrize(
    ("rows", "reason", "outcome"),
    [
        ([], "PAIR_MISSING_BOTH", None),
        ([("post", 1.0, "U", "g", "s")], "PAIR_MISSING_PRE", None),
        ([("pre", 1.0, "U", "g", "s")], "PAIR_MISSING_POST", None),
        ([("pre", 1.0, "U", "g", "s"), ("pre", 2.0, "U", "g", "s"), ("post", 1.0, "U", "g", "s")], "DUPLICATE_CONFLICT", None),
        ([("pre", 1.0, "U", "g", "s"), ("pre", 1.0, "U", "g", "s"), ("post", 1.0, "U", "g", "s")], "DUPLICATE_STATUS_RECORD", None),
        ([("pre", None, "U", "g", "s"), ("post", 1.0, "U", "g", "s")], "PAIR_VALUE_MISSING", None),
        ([("pre", 1.0, "K", "g", "s"), ("post", 1.0, "U", "g", "s")], "INCONSISTENT_UNIT", None),
        ([("pre", 1.0, "U", "h", "s"), ("post", 1.0, "U", "g", "s")], "SCOPE_MISMATCH", None),
        ([("pre", 1.0, "U", "g", "s"), ("post", 1.0, "U", "g", None)], "FAMILY_MISMATCH", None),
        ([("pre", 1.0, "U", "g", "s"), ("post", 0.0, "U", "g", "s")], "INVALID_DENOMINATOR_ZERO", None),
        ([("pre", 1.0, "U", "g", "s"), ("post", 1.0, "U", "g", "s")], "INVALID_DENOMINATOR_BELOW_FLOOR", None),
        ([("pre", 100.0, "U", "g", "s"), ("post", 90.0, "U", "g", "s")], "MATERIAL_ADJUSTMENT", True),
        ([("pre", 100.0, "U", "g", "s"), ("post", 99.0, "U", "g", "s")], "BELOW_MATERIALITY_THRESHOLD", False),
    ],
)
def test_pair_reasons(spark, rows, reason, outcome):
    got = pairs(spark, rows)
    assert (got.reason, got.outcome) == (reason, outcome)


def test_unlocked_rule_keeps_the_ratio(spark):
    got = pairs(spark, [("pre", 100.0, "U", "g", "s"), ("post", 50.0, "U", "g", "s")], endpoints=[{**ENDPOINT[0], "threshold": None}])
    assert got.reason == "EMPIRICAL_RULE_NOT_LOCKED" and got.outcome is None and got.opportunity and got.ratio == 1.0


def test_cluster_dedup_is_order_independent(spark):
    rows = [("e", 2019, "c", s, i, "ch", DAY, True) for s, i in (("b", "2"), ("a", "9"), ("a", "1"))]
    rows += [("e", 2019, "d", "a", "5", "ch", DAY, True), ("e", 2019, "d", "a", "6", "ch", DAY, False)]
    schema = "entity_id string, period int, cluster_id string, source_id string, event_id string, channel_id string, availability timestamp_ntz, outcome boolean"
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, schema).withColumn("opportunity", F.lit(True)).repartition(3)
        got = {r.event_id: r.status for r in evidence.dedupe_event_clusters(df).collect()}
        want = want or got
        assert got == want
    assert want["1"] == "ACCEPTED" and want["9"] == want["2"] == "DUPLICATE_UPSTREAM_EVENT"
    assert want["5"] == want["6"] == "CONFLICTING_UPSTREAM_CLUSTER"


def test_horizon_boundary_is_inclusive_on_the_right(spark):
    panel = spark.createDataFrame([("e", 2019, DAY)], "entity_id string, period int, anchor timestamp_ntz")
    times = {"at": DAY, "last": dt.datetime(2021, 3, 31, 12), "late": dt.datetime(2021, 3, 31, 12, 0, 1), "first": DAY + dt.timedelta(seconds=1)}
    df = spark.createDataFrame(
        [(k, "e", 2019, "s", evidence.DELAYED, True, True, t) for k, t in times.items()],
        "record_id string, entity_id string, period int, source_id string, role string, outcome boolean, opportunity boolean, availability timestamp_ntz",
    )
    sources = [{"source_id": "s", "channel_id": "c", "role": evidence.DELAYED}]
    got = {r.record_id for r in labels.admit_events(panel, df, sources, 12).collect()}
    assert got == {"last", "first"}


def test_absence_stays_unknown(spark):
    risk = spark.createDataFrame([("e", 2019, DAY)], "entity_id string, period int, anchor timestamp_ntz").select(
        "*", *[F.lit(True).alias(c) for c in ("eligible", "annual_mature", "next_mature", "mature")]
    )
    records = spark.createDataFrame(
        [("r", "e", 2019, "a", evidence.ANNUAL, False, True, DAY)],
        "record_id string, entity_id string, period int, source_id string, role string, outcome boolean, opportunity boolean, availability timestamp_ntz",
    )
    sources = [{"source_id": s, "channel_id": s, "role": evidence.ANNUAL} for s in ("a", "b")]
    grid = labels.source_outcomes(risk, labels.admit_events(risk, records, sources, 12), sources)
    assert {r.source_id: r.label for r in grid.collect()} == {"a": False, "b": None}
    got = {r.target_id: r.outcome for r in labels.candidate_targets(grid, {"one": ["a"], "both": ["a", "b"]}).collect()}
    assert got == {"one": False, "both": None}


def test_month_shift_clamps_and_keeps_time(spark):
    panel = spark.createDataFrame([("e", 2019, dt.datetime(2020, 1, 31, 7, 30))], "entity_id string, period int, anchor timestamp_ntz")
    assert riskset.horizon_mature(panel, 1, "2020-02-29 07:30:00").first().mature
    assert not riskset.horizon_mature(panel, 1, "2020-02-29 07:29:59").first().mature


def test_provenance_is_found_at_any_depth(spark):
    text = '{"a": [{"Decision ID": ["d2", 7, ["d3"]]}, {"b": {"c": {"document_ids": "d1", "publishDate": "2020-01-02"}}}], "taxonomy-codes": ["x", null]}'
    decoy = '{"k": "\\"documentid\\":\\"no\\"", "document_id": "a\\"b"}'
    frame = spark.createDataFrame([(0, text), (1, "[]"), (2, " "), (3, None), (4, "{bad"), (5, decoy)], "i int, t string")
    got = [r.m for r in frame.select("i", mine_provenance("t").alias("m")).orderBy("i").collect()]
    assert (got[0].document_ids, got[0].date_texts, got[0].codes) == (["7", "d1", "d2", "d3"], ["2020-01-02"], ["x"])
    assert got[0].canonical.startswith('{"a":[') and [g.canonical for g in got[1:5]] == [None] * 4
    assert [g.problem for g in got] == [None] * 4 + ["MALFORMED_PROVENANCE", None] and got[5].document_ids == ['a"b']


def test_references_drop_empty_parts(spark):
    cells = ['["null", "[]", {"k": "nan"}]', '["b", "{\\"z\\": 1, \\"a\\": \\"\\"}", "b"]', '[{"a":[{"b":"n/a"},{"c":"x"}]}]', "[", None]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    got = [r.c for r in frame.select("i", canonical_references("t").alias("c")).orderBy("i").collect()]
    assert got == [None, '["b","{\\"z\\":1}"]', '["{\\"a\\":[{\\"c\\":\\"x\\"}]}"]', None, None]



def test_zero_needs_a_complete_year(spark):
    panel = spark.createDataFrame([("e", 2018), ("e", 2019), ("f", 2018)], "entity_id string, period int")
    rows = spark.createDataFrame(
        [("d", "f", "n", None, None, None, None, None, "X", "c", True, True, 1.0, True, None, "r")],
        "document_id string, entity_id string, decision_number string, event_year int, decision_date timestamp_ntz, publish_date timestamp_ntz, known_date timestamp_ntz, target_period int, level_1 string, code string, row_included boolean, hard_positive boolean, total_fine double, has_fine boolean, has_warning boolean, source_ref string",
    )
    codes = decisions.Taxonomy(["REPORTING"], [], ["C1"], ["C3"], [])
    got = decisions.endpoint_results(panel, decisions.resolve_decisions(rows, codes), 2019)
    states = {(r.entity_id, r.period): (r.outcome, r.reason) for r in got.filter("endpoint = 'content'").collect()}
    assert states == {("e", 2018): (False, None), ("e", 2019): (None, "SOURCE_YEAR_INCOMPLETE"), ("f", 2018): (None, "YEAR_UNRESOLVED")}


def test_rollup_continues_in_further_cells(spark):
    df = spark.createDataFrame([("k", f"v{i:03d}") for i in range(25)] * 2, "k string, v string")
    got = sorted((r.cell, r["values"]) for r in cells.rollup_cells(df, ["k"], "v", per_cell=10).collect())
    assert [c for c, _ in got] == [0, 1, 2] and sum((v for _, v in got), []) == [f"v{i:03d}" for i in range(25)]
