"""Panel-shaped views over the given tables, and the query registry.

Each binding is one SQL text that runs unchanged in Spark and in the comparison engine. It
only shapes inputs; everything measured is done by the operators. Bindings in PLACED number the
rows of a few large groups: a window would hold a whole group in one task, so Spark numbers them
by ranges.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.operators.ranking import cut, positions

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

BINDINGS: dict[str, str] = {
    # one row per source observation of an entity-period
    "fx_obs": """
        SELECT 'orders' AS source_id, CAST(o_custkey AS STRING) AS entity_id,
               CAST(year(o_orderdate) AS INT) AS period, max(o_orderdate) AS availability
        FROM orders GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'lineitem', CAST(o_custkey AS STRING), CAST(year(o_orderdate) AS INT), max(l_shipdate)
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3""",
    "fx_panel": """
        SELECT entity_id, period, max(availability) AS anchor
        FROM fx_obs GROUP BY 1, 2 HAVING count(DISTINCT source_id) = 2""",
    "fx_lines": """
        SELECT CAST(o_custkey AS STRING) AS entity_id, CAST(year(o_orderdate) AS INT) AS period,
               o_orderkey, o_orderdate, o_orderpriority, o_totalprice, l_linenumber, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    # pre / post value per entity-period, wide
    "fx_prepost": """
        SELECT entity_id, period,
               CASE WHEN count_if(l_linestatus = 'F') > 0
                    THEN round(sum(l_extendedprice), 2) END AS value_pre,
               CASE WHEN count_if(l_returnflag = 'A') > 0
                    THEN round(sum(l_extendedprice * (1 - l_discount)), 4) END AS value_post,
               CASE WHEN count_if(l_linestatus = 'O') > 0 THEN round(sum(l_quantity), 2) END AS volume_pre,
               CASE WHEN count_if(l_returnflag = 'R') > 0
                    THEN round(sum(l_quantity * (1 + l_tax)), 2) END AS volume_post
        FROM fx_lines GROUP BY 1, 2""",
    # pre / post rows, long, with duplicate, unit, scope and family damage
    "fx_pairs": """
        SELECT entity_id, period, 'amount' AS item, 'pre' AS status, value_pre AS value,
               CASE WHEN CAST(entity_id AS INT) % 41 = 0 THEN 'K' ELSE 'U' END AS unit,
               CASE WHEN CAST(entity_id AS INT) % 43 = 0 THEN 'parent' ELSE 'group' END AS scope,
               CASE WHEN CAST(entity_id AS INT) % 47 = 0 THEN 'flow' ELSE 'stock' END AS family,
               concat('pre#', entity_id) AS source_ref
        FROM fx_prepost WHERE value_pre IS NOT NULL OR CAST(entity_id AS INT) % 5 = 0
        UNION ALL
        SELECT entity_id, period, 'amount', 'post',
               CASE WHEN CAST(entity_id AS INT) % 53 = 0 THEN 0.0 ELSE value_post END, 'U', 'group', 'stock',
               concat('post#', entity_id)
        FROM fx_prepost WHERE value_post IS NOT NULL
        UNION ALL
        SELECT entity_id, period, 'amount', 'post',
               value_post + CASE WHEN CAST(entity_id AS INT) % 2 = 0 THEN 1.0 ELSE 0.0 END, 'U', 'group', 'stock',
               concat('copy#', entity_id)
        FROM fx_prepost WHERE value_post IS NOT NULL AND CAST(entity_id AS INT) % 37 = 0
        UNION ALL
        SELECT entity_id, period, 'volume', 'pre', volume_pre, 'N', 'group', 'stock', concat('vpre#', entity_id)
        FROM fx_prepost WHERE volume_pre IS NOT NULL
        UNION ALL
        SELECT entity_id, period, 'volume', 'post', volume_post, 'N', 'group', 'stock', concat('vpost#', entity_id)
        FROM fx_prepost WHERE volume_post IS NOT NULL""",
    "fx_opinion": """
        SELECT CAST(o_custkey AS STRING) AS entity_id, CAST(year(o_orderdate) AS INT) AS period,
               CASE WHEN o_orderkey % 29 = 0 THEN '  ' WHEN o_orderkey % 3 = 0
                    THEN concat(' ', lower(o_orderpriority), ' ') ELSE o_orderpriority END AS opinion_raw,
               CASE WHEN o_orderkey % 31 = 0 THEN 'other' ELSE 'opinion' END AS indicator,
               CASE WHEN o_orderkey % 61 = 0 THEN 'quarter' ELSE 'annual' END AS period_type,
               'group' AS scope, 'audited' AS status, concat('o', CAST(o_orderkey AS STRING)) AS source_ref
        FROM orders""",
    "fx_long_values": """
        SELECT entity_id, period, CASE l_linestatus WHEN 'F' THEN 'audited' ELSE 'unaudited' END AS status,
               l_returnflag AS item, round(sum(l_extendedprice), 2) AS value
        FROM fx_lines GROUP BY 1, 2, 3, 4""",
    "fx_features": """
        SELECT entity_id, period, round(sum(l_extendedprice), 2) AS fs_aud_price,
               round(sum(l_extendedprice * l_discount), 4) AS fs_aud_rebate,
               CASE WHEN count_if(l_returnflag = 'A') > 0 THEN round(sum(l_quantity), 2) END AS fs_aud_quantity,
               CASE WHEN count_if(l_linestatus = 'F') > 1 THEN round(sum(l_extendedprice * l_tax), 4)
                    END AS fs_aud_tax,
               CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS fs_aud_orders,
               CAST(count_if(l_returnflag = 'R') AS DOUBLE) AS fs_aud_returns
        FROM fx_lines GROUP BY 1, 2""",
    # monthly event sources for a user, anchored inside the event window
    "fx_event_panel": """
        SELECT CAST(user_id AS STRING) AS entity_id, 2023 AS period,
               CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-10 06:00:00'
                    ELSE TIMESTAMP '2023-12-20 00:00:00' END AS anchor
        FROM events WHERE user_id % 11 <> 0 GROUP BY 1, 2, 3""",
    "fx_events": """
        SELECT CAST(event_id AS STRING) AS event_id, CAST(user_id AS STRING) AS entity_id, 2023 AS period,
               event_type AS source_id,
               CASE WHEN event_type IN ('error', 'purchase') THEN 'hard' ELSE 'soft' END AS channel_id,
               'delayed_verification' AS role, ts AS availability, value > 100 AS outcome,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 5 <> 0 END AS opportunity,
               concat(CAST(user_id AS STRING), ':', props) AS cluster_id
        FROM events""",
    # exact copies of an event under another id: the duplicates an upstream feed produces
    "fx_event_copies": """
        SELECT event_id, entity_id, period, source_id, channel_id, role, availability, outcome, opportunity,
               concat('c', event_id) AS cluster_id FROM fx_events
        UNION ALL
        SELECT concat('copy', event_id), entity_id, period, source_id, channel_id, role,
               CASE WHEN CAST(event_id AS BIGINT) % 10 = 0 THEN availability + INTERVAL 1 DAY ELSE availability END,
               outcome, opportunity, concat('c', event_id)
        FROM fx_events WHERE CAST(event_id AS BIGINT) % 4 < 2""",
    # 40 entities and 900 documents per 10,000 events, so that groups stay as large as they are while their number grows
    "fx_decisions": """
        SELECT concat('d', CAST(event_id % 900 + 900 * CAST(floor(event_id / 10000) AS BIGINT) AS STRING)) AS document_id,
               CAST(user_id % 40 + 40 * CAST(floor(event_id / 10000) AS BIGINT) AS STRING) AS entity_id,
               concat('n', CAST(event_id % 70 AS STRING)) AS decision_number,
               CASE WHEN event_id % 6 = 0 THEN CAST(2024 - event_id % 4 AS INT) END AS event_year,
               CASE WHEN event_id % 5 <> 0 THEN ts END AS decision_date,
               CASE WHEN event_id % 10 <> 0 THEN ts + INTERVAL 3 DAY END AS publish_date,
               CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 9 DAY END AS known_date,
               CAST(NULL AS INT) AS target_period,
               CASE WHEN event_id % 4 = 0 THEN ' reporting ' WHEN event_id % 4 = 1 THEN 'CONDUCT'
                    WHEN event_id % 4 = 2 THEN 'odd' END AS level_1,
               concat('c', CAST(event_id % 10 AS STRING)) AS code,
               event_id % 7 <> 0 AS row_included, value > 10 AS hard_positive,
               CASE WHEN event_id % 3 = 0 THEN round(value, 2) END AS total_fine,
               CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 3 = 0 END AS has_fine,
               CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 END AS has_warning,
               concat('r', CAST(event_id AS STRING)) AS source_ref
        FROM events
        UNION ALL
        SELECT concat('d', CAST(event_id % 900 + 900 * CAST(floor(event_id / 10000) AS BIGINT) AS STRING)),
               CAST(user_id % 40 + 40 * CAST(floor(event_id / 10000) AS BIGINT) AS STRING),
               concat('n', CAST(event_id % 70 AS STRING)),
               CASE WHEN event_id % 6 = 0 THEN CAST(2024 - event_id % 4 AS INT) END,
               CASE WHEN event_id % 5 <> 0 THEN ts END,
               CASE WHEN event_id % 10 <> 0 THEN ts + INTERVAL 3 DAY END,
               CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 9 DAY END, CAST(NULL AS INT),
               CASE WHEN event_id % 4 = 0 THEN ' reporting ' WHEN event_id % 4 = 1 THEN 'CONDUCT'
                    WHEN event_id % 4 = 2 THEN 'odd' END,
               concat('c', CAST(event_id % 10 AS STRING)), event_id % 7 <> 0, value > 10,
               CASE WHEN event_id % 3 = 0 THEN round(value, 2) END,
               CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 3 = 0 END,
               CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 END, concat('again', CAST(event_id AS STRING))
        FROM events WHERE event_id % 13 = 0""",
    "fx_decision_panel": """
        SELECT entity_id, period FROM (SELECT DISTINCT CAST(user_id % 40 + 40 * CAST(floor(event_id / 10000) AS BIGINT) AS STRING) AS entity_id FROM events) e
        JOIN (SELECT DISTINCT CAST(2018 + n_nationkey AS INT) AS period FROM nation WHERE n_nationkey < 8) p
        ON true""",
    # documents as an entity-period panel with three label sources
    "fx_matrix": """
        SELECT CAST(d.doc_id AS STRING) AS entity_id, CAST(d.doc_id % 7 + 2015 AS INT) AS period,
               'quality' AS source_id, 'S1' AS channel_id, 'annual_at_anchor' AS role,
               l.quality = 0 AS outcome, CASE WHEN l.doc_id IS NOT NULL THEN true END AS opportunity,
               CAST(d.n_chars % 90 AS INT) AS lag_days
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT CAST(d.doc_id AS STRING), CAST(d.doc_id % 7 + 2015 AS INT), 'toxic', 'S2', 'annual_at_anchor',
               l.toxic = 1, CASE WHEN l.doc_id IS NOT NULL THEN true END, CAST(d.n_chars % 60 AS INT)
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT CAST(d.doc_id AS STRING), CAST(d.doc_id % 7 + 2015 AS INT), 'lang', 'S3', 'next_period',
               CASE WHEN d.n_chars > 200 THEN d.lang <> 'en' END, d.n_chars > 200,
               CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.n_chars % 400 AS INT) END
        FROM documents d""",
    "fx_scores": """
        SELECT CAST(d.doc_id AS STRING) AS entity_id, CAST(d.doc_id % 7 + 2015 AS INT) AS period, 'full' AS model_id,
               CAST(d.n_chars % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS prediction, l.quality = 0 AS outcome
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT CAST(d.doc_id AS STRING), CAST(d.doc_id % 7 + 2015 AS INT), 'observability_only',
               CAST(d.doc_id % 101 AS DOUBLE) / CAST(101 AS DOUBLE), l.quality = 0
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_surface": """
        SELECT o_orderpriority AS model_id, CAST(year(o_orderdate) AS STRING) AS scenario_id,
               round(avg(o_totalprice), 4) AS value
        FROM orders GROUP BY 1, 2""",
    "fx_facts": """
        SELECT c_mktsegment AS scenario_id, o_orderpriority AS method_id,
               CAST(row_number() OVER (PARTITION BY c_mktsegment, o_orderpriority ORDER BY o_orderkey) - 1 AS BIGINT)
                 AS replication_id,
               o_totalprice AS order_value, o_orderkey
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "fx_domain": """
        SELECT CAST(c_custkey AS STRING) AS entity_id, CAST(year(o_orderdate) AS INT) AS period,
               c_mktsegment AS domain, round(sum(o_totalprice), 2) AS spend,
               CAST(count(*) AS DOUBLE) AS orders_made, round(max(o_totalprice), 2) AS top_order,
               CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS balance,
               count_if(o_orderpriority = '1-URGENT') > 0 AS outcome
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, 2, 3, c_acctbal""",
    # text columns with deterministic damage
    "fx_text": """
        SELECT o_orderkey AS row_key,
               CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END AS entity_code,
               CASE WHEN o_orderkey % 71 = 0 THEN 'FY?' ELSE CAST(year(o_orderdate) AS STRING) END AS period_text,
               CASE WHEN o_orderkey % 89 = 0 THEN 'not-a-date' WHEN o_orderkey % 11 = 0 THEN NULL
                    WHEN o_orderkey % 7 = 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
                         lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS available_text,
               CASE WHEN o_orderkey % 83 = 0 THEN '1.234,5' WHEN o_orderkey % 67 = 0 THEN '1,234.50'
                    WHEN o_orderkey % 101 = 0 THEN 'n/a' WHEN o_orderkey % 59 = 0 THEN '-5.00'
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS amount_text
        FROM orders""",
    # raw source rows before entity resolution
    "fx_raw": """
        SELECT 'core' AS source_id, o_orderkey AS row_key,
               CASE WHEN o_orderkey % 97 = 0 THEN ' '
                    WHEN o_custkey % 50 = 0 AND o_orderkey % 2 = 0 THEN concat('OLD ', CAST(o_custkey AS STRING))
                    WHEN o_custkey % 75 = 0 THEN concat('legacy  ', CAST(o_custkey AS STRING))
                    WHEN o_orderkey % 13 = 0 THEN concat('  customer   ', CAST(o_custkey AS STRING))
                    ELSE concat('CUSTOMER ', CAST(o_custkey AS STRING)) END AS raw_entity,
               CASE WHEN o_orderkey % 71 = 0 THEN 'FY?' ELSE CAST(year(o_orderdate) AS STRING) END AS period_text,
               CASE WHEN o_orderkey % 89 = 0 THEN 'not-a-date'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS available_text
        FROM orders
        UNION ALL
        SELECT 'late', o_orderkey, concat('Customer ', CAST(o_custkey AS STRING)),
               CAST(year(o_orderdate) AS STRING), CAST(CAST(o_orderdate AS DATE) AS STRING)
        FROM orders WHERE o_orderstatus <> 'P'""",
    "fx_aliases": """
        SELECT 'core' AS source_id, concat('OLD ', CAST(c_custkey AS STRING)) AS alias,
               concat('customer ', CAST(c_custkey AS STRING)) AS target FROM customer WHERE c_custkey % 100 = 0
        UNION ALL
        SELECT 'core', concat('LEGACY ', CAST(c_custkey AS STRING)), concat('customer  ', CAST(c_custkey + 1 AS STRING))
        FROM customer WHERE c_custkey % 75 = 0""",
    # wide endpoint columns with opportunities and nested provenance text
    "fx_endpoints": """
        SELECT entity_id, period,
               CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 = 1 END AS broad_outcome,
               CASE WHEN k % 7 = 0 THEN NULL ELSE k % 7 < 6 END AS broad_source,
               CASE WHEN k % 11 = 0 THEN NULL ELSE k % 11 < 10 END AS broad_observed,
               CASE WHEN k % 5 < 2 AND k % 13 <> 0 THEN
                    CASE WHEN k % 17 = 0 THEN concat('{"note": "', entity_id, '"}')
                         ELSE concat('{"Decision-ID": ["d', CAST(k % 50 AS STRING), '", "d', CAST(k % 30 AS STRING),
                              '"], "meta": {"items": [{"publish_date": "2020-01-05", "taxonomy_code": "C',
                              CAST(k % 4 AS STRING), '"}]}}') END
                    WHEN k % 13 = 0 THEN '[]' END AS broad_provenance,
               CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 = 1 END AS narrow_outcome,
               true AS narrow_source, k % 2 = 0 AS narrow_observed,
               CASE WHEN k % 3 < 2 THEN concat('{"document_ids": ["d', CAST(k % 50 AS STRING),
                    '"], "taxonomy_codes": ["C9"]}') END AS narrow_provenance
        FROM (SELECT entity_id, period, CAST(entity_id AS INT) + period * 3 AS k FROM fx_panel) q
        WHERE k % 101 <> 0""",
    "fx_process": """
        SELECT concat('p', CAST(event_id AS STRING)) AS record_id, event_type AS source_id,
               CAST(user_id AS STRING) AS entity_id, 2023 AS period,
               CASE WHEN event_id % 4 < 2 THEN 'endpoint_result' ELSE 'delayed_event' END AS record_kind,
               CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS opportunity,
               CASE CAST(floor(event_id / 3) AS BIGINT) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verification,
               CASE CAST(floor(event_id / 9) AS BIGINT) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS determination,
               CASE CAST(floor(event_id / 27) AS BIGINT) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS recording,
               CASE CAST(floor(event_id / 81) AS BIGINT) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS outcome,
               CASE WHEN event_id % 7 = 0 THEN 'STATED' END AS reason,
               CASE WHEN event_id % 10 = 0 THEN 'OVDRS' END AS mask,
               CASE WHEN event_id % 5 = 0 THEN ts END AS verification_date,
               CASE WHEN event_id % 6 = 0 THEN ts END AS determination_date,
               CASE WHEN event_id % 8 = 0 THEN ts END AS recording_date
        FROM events""",
    # evidence records of all roles against the document panel
    "fx_doc_panel": """
        SELECT CAST(doc_id AS STRING) AS entity_id, CAST(doc_id % 7 + 2015 AS INT) AS period,
               make_timestamp(2016 + doc_id % 7, 3, 31, 12, 0, 0) AS anchor
        FROM documents WHERE doc_id % 23 <> 0""",
    "fx_records": """
        SELECT concat(source_id, ':', entity_id) AS record_id, m.entity_id, m.period, source_id, channel_id, role, outcome,
               opportunity,
               CASE WHEN role = 'annual_at_anchor' AND CAST(m.entity_id AS INT) % 53 = 0
                    THEN make_timestamp(2016 + m.period - 2015, 4, 1, 0, 0, 0)
                    WHEN role = 'annual_at_anchor' THEN make_timestamp(2016 + m.period - 2015, 3, 31, 12, 0, 0)
                    WHEN lag_days IS NOT NULL
                    THEN make_timestamp(2016 + m.period - 2015, 3, 31, 6, 0, 0) + lag_days * INTERVAL 1 DAY
                    END AS availability,
               CAST(m.entity_id AS INT) % 31 <> 0 AS row_included
        FROM fx_matrix m
        UNION ALL
        SELECT concat('delayed:', CAST(doc_id AS STRING), ':', CAST(n_regionkey AS STRING)),
               CAST(doc_id AS STRING), CAST(doc_id % 7 + 2015 AS INT), 'appeal', 'S4', 'delayed_verification',
               n_chars % 3 = 0, true,
               CASE WHEN doc_id % 37 <> 0
                    THEN make_timestamp(2016 + doc_id % 7, 3, 31, 9, 0, 0)
                         + CAST(n_chars % 900 - 60 + n_regionkey AS INT) * INTERVAL 1 DAY END, true
        FROM documents JOIN (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 2) r ON true
        WHERE doc_id % 4 = 0""",
    "fx_risk": """
        SELECT entity_id, period, anchor, CAST(entity_id AS INT) % 19 <> 0 AS eligible, period <= 2020 AS annual_mature,
               period <= 2019 AS next_mature, period <= 2019 AS mature
        FROM fx_doc_panel""",
}


@cache
def _needs(text: str) -> tuple[str, ...]:
    """Bindings that a SQL text reads, dependencies first."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in BINDINGS:
            if re.search(rf"\b{name}\b", body) and name not in found:
                visit(BINDINGS[name])
                found.append(name)

    visit(text)
    return tuple(found)


def _inner_with(text: str, heads: list[str]) -> str:
    body = text.strip()
    if not heads:
        return body
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(heads) + ",\n" + body[4:]
    return "WITH " + ",\n".join(heads) + "\n" + body


def comparison_sql(text: str) -> str:
    """Full SQL over the registered tables. A filtered count stays 0 where count_if would be null."""
    whole = _inner_with(text, [f"{n} AS ({BINDINGS[n]})" for n in _needs(text)])
    return whole.replace("count_if(", "count(*) FILTER (WHERE ")


class Inputs:
    """Opens the given tables and bindings of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.placed: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        df = self.sql(f"SELECT * FROM {name}")
        zoned = [c for c, dtype in df.dtypes if dtype == "timestamp"]
        return df.withColumns({c: df[c].cast("timestamp_ntz") for c in zoned}) if zoned else df

    def sql(self, text: str) -> DataFrame:
        bindings = _needs(text)
        whole = text + " ".join(BINDINGS[n] for n in bindings)
        tables = [t for t in TABLES if re.search(rf"\b{t}\b", whole)]
        heads = [f"{t} AS (SELECT * FROM parquet.`{self.path(t)}`)" for t in tables]
        views = {}
        for n in bindings:
            if n in PLACED:
                if n not in self.placed:
                    self.placed[n] = PLACED[n](self)
                views[n] = f"{n}_{uuid.uuid4().hex}"
                self.placed[n].createOrReplaceTempView(views[n])
            heads.append(f"{n} AS (SELECT * FROM {views[n]})" if n in views else f"{n} AS ({BINDINGS[n]})")
        try:
            return self.spark.sql(_inner_with(text, heads))
        finally:  # the plan holds what it reads
            for view in views.values():
                self.spark.catalog.dropTempView(view)


def _facts(fx: Inputs) -> DataFrame:
    """``fx_facts``: a cell is one of 25 groups of all orders."""
    rows = fx.sql("""SELECT c_mktsegment AS scenario_id, o_orderpriority AS method_id, o_totalprice AS order_value, o_orderkey
                     FROM orders JOIN customer ON c_custkey = o_custkey""")
    placed = positions(rows, ["scenario_id", "method_id"], [("o_orderkey", True)])
    return cut(placed.select("scenario_id", "method_id", (F.col("position") - 1).alias("replication_id"), "order_value", "o_orderkey"))


PLACED: dict[str, Callable[[Inputs], DataFrame]] = {"fx_facts": _facts}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Callable[[Inputs], DataFrame]]:
    """Register a query; ``sql`` is the equivalent statement for the comparison engine."""

    def register(body: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: body(Inputs(spark, folder))
        if sql is not None:
            SQL[name] = comparison_sql(sql)
        return body

    return register
