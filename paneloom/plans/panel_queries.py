"""Sources, audits, entity resolution and the as-of panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.dates import year_of
from paneloom.operators import panel, quality
from paneloom.operators.ranking import cut
from paneloom.plans.bindings import Inputs, query
from paneloom.sources import contracts, files, readers, sinks

CORE = ["orders", "lineitem"]

# ---------------------------------------------------------------- sources


@query(
    "parquet_scan",
    "SELECT CAST(count(*) AS BIGINT) AS n, count(l_discount) AS with_discount, round(sum(l_quantity), 2) AS quantity FROM lineitem",
)
def _(fx: Inputs) -> DataFrame:
    rows = readers.read_source(fx.spark, fx.path("lineitem"), "parquet")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_discount").alias("with_discount"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
    )


CSV_SQL = """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(length(props)) AS longest
             FROM events GROUP BY 1"""


def _typed_events(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("value").try_cast("double")), 2).alias("total"),
        F.max(F.length("props")).cast("long").alias("longest"),
    )


def _events_as(fx: Inputs, fmt: str, **options: str) -> str:
    path = sinks.scratch_folder(fx.spark, fmt)
    rows = fx("events").select("event_id", "event_type", "value", "props")
    rows.write.options(**options).format("csv" if fmt == "tsv" else "json" if fmt == "jsonl" else fmt).save(path)
    return path


@query("csv_scan", CSV_SQL)
def _(fx: Inputs) -> DataFrame:
    path = _events_as(fx, "csv", header="true", compression="gzip", escape='"')
    return _typed_events(readers.read_source(fx.spark, path, "csv"))


@query("tsv_scan", CSV_SQL)
def _(fx: Inputs) -> DataFrame:
    path = _events_as(fx, "tsv", header="true", sep="\t", escape='"')
    return _typed_events(readers.read_source(fx.spark, path, "tsv"))


@query("json_lines_scan", CSV_SQL)
def _(fx: Inputs) -> DataFrame:
    path = _events_as(fx, "jsonl")
    schema = "event_id bigint, event_type string, value double, props string"
    return _typed_events(readers.read_source(fx.spark, path, "jsonl", schema=schema))


@query("json_array_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(fx: Inputs) -> DataFrame:
    path = sinks.scratch_folder(fx.spark, "json")
    arrays = (
        fx("events")
        .select("event_id", "event_type", (F.col("event_id") % 64).alias("file"))
        .groupBy("file", F.expr("event_id div 6400").alias("part"))
        .agg(F.to_json(F.collect_list(F.struct("event_id", "event_type"))).alias("value"))
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = readers.read_source(fx.spark, path, "json", schema="event_id bigint, event_type string")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "long_values_scan",
    """SELECT status AS audit_status, item AS source_item_id, count(*) AS n, round(sum(value), 2) AS total
       FROM fx_long_values GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    path = sinks.scratch_folder(fx.spark, "long-values")
    fx("fx_long_values").select(
        F.col("entity_id").alias("issuer_ticker"),
        F.col("period").alias("fiscal_year"),
        F.col("status").alias("audit_status"),
        F.lit("group").alias("scope"),
        F.col("item").alias("source_item_id"),
        F.col("value").cast("decimal(18,2)").alias("value_numeric"),
        F.lit("U").alias("unit"),
    ).write.option("header", True).csv(path)
    rows = readers.read_long_values(fx.spark, path)
    return rows.groupBy("audit_status", "source_item_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value_numeric").try_cast("double")), 2).alias("total")
    )


@query("source_discovery")
def _(fx: Inputs) -> DataFrame:
    return files.discover(fx.spark, fx.folder, ["*.parquet"], ["pages*", "embed*"]).drop("path")


@query("file_signatures")
def _(fx: Inputs) -> DataFrame:
    return files.file_signatures(fx.spark, [fx.path("orders"), fx.path("customer")]).select(
        F.substring_index("path", "/", -1).alias("file"), "size_bytes", "sha256", "bom", "newline_style"
    )


@query("tree_signatures")
def _(fx: Inputs) -> DataFrame:
    found = files.tree_signatures(fx.spark, [fx.path(t) for t in ("orders", "customer", "documents")], 2**16)
    return found.select(F.substring_index("path", "/", -1).alias("file"), "size_bytes", "chunk_count", "tree_sha256", "problem")


@query(
    "path_rules",
    """SELECT url AS relative_path, page_id, count(*) OVER () AS match_count, true AS cardinality_ok FROM pages
       WHERE (url LIKE '%/en/%' OR url LIKE '%/fr/%') AND url NOT LIKE '%utm_%'""",
)
def _(fx: Inputs) -> DataFrame:
    listed = fx("pages").select(F.col("url").alias("relative_path"), "page_id")
    return files.matching_paths(listed, ["*/en/*", "*/fr/*"], ["*utm_*"])


PAGE_SIGNATURE_SQL = """
    SELECT page_id, sha256(html) AS sha256, CAST(NULL AS STRING) AS bom,
           CASE WHEN contains(html, chr(13) || chr(10)) THEN 'CRLF' WHEN contains(html, chr(10)) THEN 'LF' ELSE 'NONE_OR_BINARY' END AS newline_style
    FROM pages"""


@query("content_signatures", PAGE_SIGNATURE_SQL)
def _(fx: Inputs) -> DataFrame:
    return files.content_signatures(fx("pages").select("page_id", F.col("html").cast("binary").alias("content")))


@query(
    "content_lock_drift",
    f"""SELECT page_id, page_id % 10 > 1 AS hash_matches_lock FROM ({PAGE_SIGNATURE_SQL}) p""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    now = files.content_signatures(rows)
    page = F.col("path").cast("long")
    locked = now.filter(page % 10 != 1).withColumn("sha256", F.when(page % 10 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return files.hash_drift(now, locked).select(page.alias("page_id"), "hash_matches_lock")


@query("hash_lock_drift")
def _(fx: Inputs) -> DataFrame:
    now = files.file_signatures(fx.spark, [fx.path("orders"), fx.path("customer"), fx.path("nation")])
    locked = now.filter(~F.col("path").endswith("nation.parquet")).withColumn(
        "sha256", F.when(F.col("path").endswith("customer.parquet"), F.lit("changed")).otherwise(F.col("sha256"))
    )
    return files.hash_drift(now, locked).select(F.substring_index("path", "/", -1).alias("file"), "hash_matches_lock")


@query(
    "schema_fingerprint",
    """SELECT sha256('o_orderkey:bigint|o_custkey:bigint|o_orderstatus:string|o_totalprice:double|o_orderdate:timestamp_ntz|o_orderpriority:string|format=parquet')
              AS fingerprint, count(*) AS row_count, 6 AS column_count FROM orders""",
)
def _(fx: Inputs) -> DataFrame:
    return files.schema_fingerprint(fx("orders"), {"format": "parquet"})


@query("resolved_columns", "SELECT CAST(count(*) AS BIGINT) AS n, count(DISTINCT o_custkey) AS entities, max(o_orderdate) AS latest FROM orders")
def _(fx: Inputs) -> DataFrame:
    messy = fx("orders").withColumnsRenamed({"o_custkey": "Mã Khách-Hàng", "o_orderdate": "Order Date"})
    rows = files.resolve_columns(
        messy, {"entity": ["ma khach hang", "customer"], "available": ["order_date", "ORDERDATE"]}, ["entity"]
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.max("available").alias("latest")
    )


@query(
    "partitioned_sink",
    "SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(fx: Inputs) -> DataFrame:
    path = sinks.scratch_folder(fx.spark, "orders-by-year") + "/table"
    rows = fx("orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    contract = contracts.Contract(
        {"o_orderkey": "bigint", "o_orderpriority": "string", "y": "int"}, not_null=["y"], unique=[["o_orderkey"]]
    )
    # ranges over year and key: a year is as many tasks as its rows need
    sinks.write_table(rows.repartitionByRange("y", "o_orderkey"), path, partition_by=["y"], contract=contract)
    return (
        fx.spark.read.parquet(path)
        .groupBy("o_orderpriority", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "contract_violations",
    """SELECT * FROM (
       SELECT 'not_null' AS rule, 'value_post' AS column_name, count_if(value_post IS NULL) AS violations FROM fx_prepost
       UNION ALL SELECT 'between', 'period', count_if(period NOT BETWEEN 1996 AND 2000) FROM fx_prepost
       UNION ALL SELECT 'greater_than', 'value_pre', count_if(NOT value_pre > 50000) FROM fx_prepost
       UNION ALL SELECT 'greater_or_equal', 'volume_pre', count_if(NOT volume_pre >= 10) FROM fx_prepost
       UNION ALL SELECT 'dtype', 'period', 1
       UNION ALL SELECT 'unique', 'entity_id', CAST(coalesce(sum(n), 0) AS BIGINT)
                 FROM (SELECT count(*) AS n FROM fx_prepost GROUP BY entity_id HAVING count(*) > 1) q) v
       WHERE violations > 0""",
)
def _(fx: Inputs) -> DataFrame:
    contract = contracts.Contract(
        {"entity_id": "string", "period": "smallint", "value_pre": "double"},
        not_null=["entity_id", "value_post"],
        unique=[["entity_id", "period"], ["entity_id"]],
        between={"period": (1996, 2000)},
        greater_than={"value_pre": 50000},
        greater_or_equal={"volume_pre": 10},
        strict=False,
    )
    return contracts.validate_contract(fx("fx_prepost"), contract)


@query(
    "constant_lineage_value",
    """SELECT 'o_orderstatus' AS column_name, CAST(NULL AS STRING) AS value, false AS is_constant
       UNION ALL SELECT 'table', 'orders', true""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("orders").withColumn("table", F.when(F.col("o_orderkey") % 3 == 0, " orders ").otherwise(" "))
    return contracts.constant_value(rows, "o_orderstatus").unionByName(contracts.constant_value(rows, "table"))


@query(
    "known_case_registry",
    """SELECT case_id, entity_id, period, CASE WHEN problem IS NULL AND count(*) OVER (PARTITION BY case_id, entity_id, period) > 1
              THEN 'DUPLICATE_CASE' ELSE problem END AS problem
       FROM (SELECT concat('case', CAST(doc_id AS STRING)) AS case_id,
                    CAST(CASE WHEN doc_id % 4 = 0 THEN doc_id - doc_id % 40 ELSE doc_id END AS STRING) AS entity_id,
                    CASE WHEN doc_id % 11 <> 3 THEN CAST(doc_id % 7 + 2015 AS INT) END AS period,
                    CASE WHEN doc_id % 11 = 3 THEN 'PERIOD_INVALID' WHEN doc_id % 13 = 5 THEN 'ROLE_UNEXPECTED'
                         WHEN doc_id % 17 = 6 THEN 'TRAINING_FLAG_NOT_BOOLEAN'
                         WHEN doc_id % 19 = 7 THEN 'TRAINING_FLAG_UNEXPECTED' END AS problem
             FROM labels WHERE toxic = 1
             UNION ALL
             SELECT concat('case', CAST(doc_id AS STRING)),
                    CAST(CASE WHEN doc_id % 4 = 0 THEN doc_id - doc_id % 40 ELSE doc_id END AS STRING),
                    CASE WHEN doc_id % 11 <> 3 THEN CAST(doc_id % 7 + 2015 AS INT) END,
                    CASE WHEN doc_id % 11 = 3 THEN 'PERIOD_INVALID' WHEN doc_id % 13 = 5 THEN 'ROLE_UNEXPECTED'
                         WHEN doc_id % 17 = 6 THEN 'TRAINING_FLAG_NOT_BOOLEAN'
                         WHEN doc_id % 19 = 7 THEN 'TRAINING_FLAG_UNEXPECTED' END
             FROM labels WHERE toxic = 1 AND doc_id % 5 = 0) c""",
)
def _(fx: Inputs) -> DataFrame:
    toxic = fx("labels").filter("toxic = 1")
    doc = F.col("doc_id")
    rows = toxic.unionByName(toxic.filter(doc % 5 == 0)).select(
        F.concat(F.lit(" case"), doc.cast("string")).alias("Case"),
        F.when(doc % 4 == 0, " ").otherwise(doc.cast("string")).alias("ticker"),
        (doc - doc % 40).cast("string").alias("old_ticker"),
        F.when(doc % 11 == 3, "soon").otherwise((doc % 7 + 2015).cast("string")).alias("year"),
        F.when(doc % 13 == 5, "train").otherwise("external").alias("role"),
        F.when(doc % 17 == 6, "maybe").when(doc % 19 == 7, "yes").otherwise(" No ").alias("training"),
    )
    return contracts.read_known_cases(
        rows,
        {"case_id": ["Case"], "entity_id": ["ticker", "old_ticker"], "period": ["fiscal_year", "year"],
         "role": ["role"], "training_flag": ["training"]},
        {"role": "external"},
        {"training_flag": False},
    )


@query(
    "event_source_audit",
    """SELECT count(*) AS row_count, count_if(i AND d) AS eligible_row_count, count_if(NOT (i AND d)) AS excluded_row_count,
              count_if(NOT (i AND d) AND u) AS excluded_unresolved_row_count,
              count_if(i AND d AND u) AS eligible_unresolved_row_count,
              CAST(0 AS BIGINT) AS invalid_flag_row_count, CAST(0 AS BIGINT) AS missing_key_row_count,
              (SELECT count(*) FROM (SELECT 1 AS one FROM fx_decisions GROUP BY document_id, entity_id, code
                                     HAVING count(*) > 1) q) AS duplicate_document_entity_code_count
       FROM (SELECT row_included AS i, hard_positive AS d, event_year IS NULL AS u FROM fx_decisions) r""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_decisions").select(
        "document_id",
        "entity_id",
        "code",
        F.coalesce(F.col("event_year").cast("string"), F.lit(" ")).alias("target_period"),
        F.when(F.col("row_included"), "Yes").otherwise("0").alias("include_flag"),
        F.col("hard_positive").cast("string").alias("direct_flag"),
    )
    return contracts.audit_event_source(rows)


# ---------------------------------------------------------------- audits


def _counts(column: str) -> str:
    return f"""SELECT '{column}' AS field, count_if(trim(CAST({column} AS STRING)) <> '') AS nonmissing_count,
               count(*) AS row_count FROM fx_text"""


@query(
    "column_coverage",
    "SELECT *, nonmissing_count * 1.0 / row_count AS coverage_rate FROM ("
    + " UNION ALL ".join(_counts(c) for c in ("row_key", "entity_code", "period_text", "available_text", "amount_text"))
    + ") q",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_coverage(fx("fx_text"))


@query(
    "required_values",
    """SELECT 'MISSING_REQUIRED_VALUES' AS code, 'ISOLATE' AS severity, 'entity_code' AS field,
              count_if(trim(entity_code) = '') AS "count" FROM fx_text
       UNION ALL SELECT 'MISSING_REQUIRED_DATE_VALUES', 'ISOLATE', 'available_text', count_if(available_text IS NULL) FROM fx_text""",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_required(fx("fx_text"), ["entity_code", "period_text", "available_text"], ["available_text"])


@query(
    "missing_keys",
    """SELECT 'MISSING_KEY_VALUES' AS code, 'FAIL' AS severity, 'entity_code' AS field,
              count_if(trim(entity_code) = '') AS "count" FROM fx_text""",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_keys(fx("fx_text"), ["entity_code", "period_text"])


DUPLICATES = """SELECT entity_code, period_text, count(*) AS n FROM fx_text WHERE trim(entity_code) <> ''
                GROUP BY 1, 2 HAVING count(*) > 1"""


@query(
    "duplicate_keys",
    f"SELECT count(*) AS duplicate_group_count, CAST(sum(n) AS BIGINT) AS duplicate_row_count FROM ({DUPLICATES}) q",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_duplicate_keys(fx("fx_text"), ["entity_code", "period_text"])


@query(
    "duplicate_key_examples",
    f'SELECT entity_code, period_text, n AS "count" FROM ({DUPLICATES}) q ORDER BY 1, 2 LIMIT 20',
)
def _(fx: Inputs) -> DataFrame:
    return quality.duplicate_examples(fx("fx_text"), ["entity_code", "period_text"])


@query(
    "date_fields",
    """SELECT field, count(*) AS nonmissing, count(d) AS parsed, count(*) - count(d) AS invalid,
              min(d) AS minimum, max(d) AS maximum
       FROM (SELECT 'available_text' AS field, try_strptime(available_text, ['%Y-%m-%d', '%d/%m/%Y']) AS d
             FROM fx_text WHERE available_text IS NOT NULL
             UNION ALL SELECT 'period_text', try_strptime(period_text, '%Y') FROM fx_text) q GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_dates(fx("fx_text"), ["available_text", "period_text"])


@query(
    "invalid_date_samples",
    "SELECT row_key, available_text FROM fx_text WHERE available_text = 'not-a-date' ORDER BY 1 LIMIT 20",
)
def _(fx: Inputs) -> DataFrame:
    return quality.invalid_date_samples(fx("fx_text"), "available_text", "row_key")


@query(
    "numeric_fields",
    """SELECT 'amount_text' AS field, count(*) AS nonmissing, count(v) AS parsed, count(*) - count(v) AS invalid,
              count_if(v < 0) AS negative
       FROM (SELECT TRY_CAST(replace(trim(amount_text), ',', '') AS DOUBLE) AS v FROM fx_text) q
       UNION ALL
       SELECT 'local_text', count(*), count(v), count(*) - count(v), count_if(v < 0)
       FROM (SELECT TRY_CAST(replace(replace(trim(amount_text), '.', ''), ',', '.') AS DOUBLE) AS v FROM fx_text) q""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_text").withColumn("local_text", F.col("amount_text"))
    return quality.audit_numerics(rows, {"amount_text": ".", "local_text": ","})


@query(
    "schema_issues",
    """SELECT 'MISSING_REQUIRED_COLUMN' AS code, 'FAIL' AS severity, 'unit' AS field, CAST(1 AS BIGINT) AS "count"
       UNION ALL SELECT 'UNREGISTERED_COLUMN', 'FAIL', 'amount_text', 1""",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_schema(
        fx("fx_text"), ["entity_code", "period_text", "unit"], ["available_text", "row_key"]
    )


@query(
    "row_count_minimum",
    """SELECT 'ROW_COUNT_BELOW_MINIMUM' AS code, 'FAIL' AS severity, CAST(NULL AS STRING) AS field, n AS "count"
       FROM (SELECT count(*) AS n FROM fx_text) q WHERE n < 1000000000""",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_row_count(fx("fx_text"), 1_000_000_000)


ISSUES_SQL = f"""
    SELECT * FROM (
      SELECT 'UNREGISTERED_COLUMN' AS code, 'WARN' AS severity, 'row_key' AS field, CAST(1 AS BIGINT) AS "count"
      UNION ALL SELECT 'MISSING_REQUIRED_VALUES', 'ISOLATE', 'entity_code', count_if(trim(entity_code) = '') FROM fx_text
      UNION ALL SELECT 'MISSING_KEY_VALUES', 'FAIL', 'entity_code', count_if(trim(entity_code) = '') FROM fx_text
      UNION ALL SELECT 'DUPLICATE_KEYS', 'FAIL', NULL, count(*) FROM ({DUPLICATES}) q
      UNION ALL SELECT 'INVALID_DATE_VALUES', 'ISOLATE', 'available_text', count_if(available_text = 'not-a-date') FROM fx_text
      UNION ALL SELECT 'INVALID_NUMERIC_VALUES', 'ISOLATE', 'amount_text',
                count_if(TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) IS NULL) FROM fx_text
      UNION ALL SELECT 'NEGATIVE_VALUES', 'ISOLATE', 'amount_text', count_if(amount_text LIKE '-%') FROM fx_text
    ) i WHERE "count" > 0"""


def _issues(fx: Inputs) -> DataFrame:
    return quality.audit_issues(
        fx("fx_text"),
        keys=["entity_code", "period_text"],
        required=["entity_code", "period_text"],
        dates=["available_text"],
        numerics={"amount_text": "."},
        optional=["available_text", "amount_text"],
        allow_extra=True,
    )


@query("audit_issues", ISSUES_SQL)
def _(fx: Inputs) -> DataFrame:
    return _issues(fx)


@query(
    "audit_status",
    f"""SELECT CASE WHEN count_if(severity = 'FAIL') > 0 THEN 'FAILED' WHEN count(*) > 0 THEN 'PASS_WITH_ISSUES'
                    ELSE 'PASS' END AS status, count_if(severity = 'FAIL') = 0 AS may_advance, count(*) AS issue_count,
               count_if(severity = 'FAIL') AS fatal_issue_count, count_if(severity = 'ISOLATE') AS isolated_issue_count
        FROM ({ISSUES_SQL}) a""",
)
def _(fx: Inputs) -> DataFrame:
    return quality.audit_status(_issues(fx))


# ---------------------------------------------------------------- entity resolution and panel

RESOLVED_SQL = """
    SELECT r.*, coalesce(a.t, b.t, r.norm) AS entity_id,
           CASE WHEN a.t IS NOT NULL THEN 'registered_raw_alias' WHEN b.t IS NOT NULL THEN 'registered_normalized_alias'
                WHEN r.norm IS NOT NULL THEN 'normalized_identity' ELSE 'unmapped' END AS method
    FROM (SELECT *, nullif(upper(regexp_replace(trim(raw_entity), '\\s+', ' ', 'g')), '') AS norm FROM fx_raw) r
    LEFT JOIN (SELECT source_id, alias, upper(regexp_replace(trim(target), '\\s+', ' ', 'g')) AS t FROM fx_aliases) a
      ON a.source_id = r.source_id AND a.alias = r.raw_entity
    LEFT JOIN (SELECT source_id, alias, upper(regexp_replace(trim(target), '\\s+', ' ', 'g')) AS t FROM fx_aliases) b
      ON b.source_id = r.source_id AND b.alias = r.norm"""

TYPED_SQL = f"""
    SELECT *, CASE WHEN trim(raw_entity) = '' THEN 'MISSING_ENTITY_ID' WHEN period IS NULL THEN 'INVALID_PERIOD'
                   WHEN period NOT BETWEEN 1996 AND 2000 THEN 'OUTSIDE_SAMPLE_WINDOW'
                   WHEN availability IS NULL THEN 'MISSING_OR_INVALID_AVAILABILITY_DATE' END AS reason
    FROM (SELECT *, TRY_CAST(period_text AS INT) AS period,
                 CASE WHEN source_id = 'late' THEN make_timestamp(TRY_CAST(period_text AS INT) + 1, 3, 31, 0, 0, 0)
                      ELSE try_strptime(available_text, '%Y-%m-%d') END AS availability
          FROM ({RESOLVED_SQL}) s) t"""

KEPT_SQL = f"""
    SELECT source_id, entity_id, period, arg_min(availability, row_key) AS availability,
           arg_min(raw_entity, row_key) AS raw_entity, count(*) - 1 AS collapsed_rows
    FROM ({TYPED_SQL}) k WHERE reason IS NULL GROUP BY 1, 2, 3"""


def _resolved(fx: Inputs) -> DataFrame:
    return panel.resolve_entities(fx("fx_raw"), fx("fx_aliases"))


def _typed(fx: Inputs) -> DataFrame:
    return panel.type_observations(_resolved(fx), 1996, 2000, {"late": "03-31"})


@query(
    "normalized_entities",
    """SELECT raw_entity, nullif(upper(regexp_replace(trim(raw_entity), '\\s+', ' ', 'g')), '') AS normalized_id,
              count(*) AS n FROM fx_raw GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_raw").groupBy("raw_entity").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("normalized_id", panel.normalize_entity(F.col("raw_entity")))


@query("resolved_entities", f"SELECT source_id, row_key, entity_id, method FROM ({RESOLVED_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _resolved(fx).select("source_id", "row_key", "entity_id", "method")


@query(
    "entity_collisions",
    f"""SELECT o.entity_id, count(DISTINCT norm) AS normalized_count,
               count_if(norm <> o.entity_id AND reg IS NULL) AS unregistered_count
        FROM (SELECT DISTINCT source_id, norm, entity_id FROM ({RESOLVED_SQL}) q WHERE entity_id IS NOT NULL) o
        LEFT JOIN (SELECT DISTINCT source_id, alias AS n2,
                          upper(regexp_replace(trim(target), '\\s+', ' ', 'g')) AS e2, true AS reg FROM fx_aliases
                   WHERE alias NOT LIKE 'LEGACY%') a
          ON a.source_id = o.source_id AND n2 = norm AND e2 = o.entity_id
        GROUP BY 1 HAVING count(DISTINCT norm) > 1 AND count_if(norm <> o.entity_id AND reg IS NULL) > 0""",
)
def _(fx: Inputs) -> DataFrame:
    return panel.entity_collisions(_resolved(fx), fx("fx_aliases").filter("alias NOT LIKE 'LEGACY%'"))


@query(
    "period_window",
    """SELECT TRY_CAST(period_text AS INT) AS period, TRY_CAST(period_text AS INT) BETWEEN 1996 AND 2000 AS in_window,
              count(*) AS n FROM fx_text GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_text").withColumn("period", year_of(F.col("period_text")))
    return (
        rows.withColumn("in_window", F.col("period").between(1996, 2000))
        .groupBy("period", "in_window")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "availability_dates",
    f"SELECT source_id, row_key, availability FROM ({TYPED_SQL}) q",
)
def _(fx: Inputs) -> DataFrame:
    return _typed(fx).select("source_id", "row_key", "availability")


CALENDAR = {"1": "06-30", "2": "03-31", "11": "09-30"}


@query(
    "period_ends",
    """SELECT entity_id, period, CAST(CASE entity_id WHEN '1' THEN make_date(period, 6, 30) WHEN '2' THEN make_date(period, 3, 31)
              WHEN '11' THEN make_date(period, 9, 30) ELSE make_date(period, 12, 31) END AS DATE) AS period_end
       FROM fx_panel""",
)
def _(fx: Inputs) -> DataFrame:
    end = panel.fiscal_year_end(F.col("period"), F.col("entity_id"), exceptions=CALENDAR)
    return fx("fx_panel").select("entity_id", "period", end.alias("period_end"))


@query(
    "early_reports",
    """SELECT source_id, entity_id, period, availability FROM fx_obs
       WHERE CAST(availability AS DATE) < make_date(period, 12, 31) AND NOT (period = 1997 AND source_id = 'orders')""",
)
def _(fx: Inputs) -> DataFrame:
    obs = fx("fx_obs")
    allowed = obs.filter("period = 1997 AND source_id = 'orders'").select("entity_id", "period", "source_id")
    end = panel.fiscal_year_end(F.col("period"), F.col("entity_id"))
    return panel.early_reports(obs, end, allowed).select("source_id", "entity_id", "period", "availability")


@query("row_exclusions", f"SELECT source_id, row_key, reason FROM ({TYPED_SQL}) q WHERE reason IS NOT NULL")
def _(fx: Inputs) -> DataFrame:
    return panel.exclusion_ledger(_typed(fx)).select("source_id", "row_key", "reason")


@query("source_row_presence", f"SELECT * FROM ({KEPT_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    kept = panel.dedupe_source_rows(_typed(fx).filter("reason IS NULL"), "row_key")
    return kept.select("source_id", "entity_id", "period", "availability", "raw_entity", "collapsed_rows")


@query("entity_master", "SELECT DISTINCT entity_id FROM fx_obs WHERE source_id = 'orders'")
def _(fx: Inputs) -> DataFrame:
    return panel.entity_master(fx("fx_obs"), ["orders"])


@query("as_of_panel", "SELECT entity_id, period, anchor FROM fx_panel")
def _(fx: Inputs) -> DataFrame:
    return panel.build_panel(fx("fx_obs"), CORE)


@query(
    "incomplete_core_periods",
    """SELECT entity_id, period, ['lineitem'] AS missing_sources, 'INCOMPLETE_CORE_AVAILABILITY' AS reason
       FROM fx_obs GROUP BY 1, 2 HAVING count(DISTINCT source_id) < 2""",
)
def _(fx: Inputs) -> DataFrame:
    return panel.incomplete_core(fx("fx_obs"), CORE)


@query(
    "resolution_counts",
    f"""SELECT source_id, raw_entity, norm AS normalized_id, entity_id, method, count(*) AS occurrence_count
        FROM ({TYPED_SQL}) q WHERE reason IS NULL GROUP BY 1, 2, 3, 4, 5""",
)
def _(fx: Inputs) -> DataFrame:
    return panel.resolution_report(_typed(fx).filter("reason IS NULL"))


@query(
    "panel_summary",
    f"""WITH kept AS ({KEPT_SQL}), states AS (SELECT entity_id, period, count(DISTINCT source_id) AS n FROM kept GROUP BY 1, 2)
        SELECT (SELECT count(*) FROM ({TYPED_SQL}) t WHERE reason IS NOT NULL) AS excluded_row_count,
               (SELECT count(*) FROM kept) AS observation_count,
               (SELECT CAST(sum(collapsed_rows) AS BIGINT) FROM kept) AS collapsed_row_count,
               (SELECT count(DISTINCT entity_id) FROM kept) AS entity_count,
               (SELECT count_if(n = 2) FROM states) AS panel_row_count,
               (SELECT count_if(n < 2) FROM states) AS incomplete_period_count""",
)
def _(fx: Inputs) -> DataFrame:
    # the resolved rows feed three counts, so they are placed once
    return panel.panel_summary(cut(_typed(fx)), ["core", "late"], "row_key")
