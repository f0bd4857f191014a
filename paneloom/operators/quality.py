"""Table audits. Each audit is one pass of conditional counts over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.dates import parse_timestamp
from paneloom.functions.grid import registry
from paneloom.functions.profile import profile
from paneloom.functions.text import is_missing, parse_number
from paneloom.operators.ranking import cut

SAMPLE = 20


def _missing(df: DataFrame, column: str) -> Column:
    return is_missing(F.col(column), dict(df.dtypes)[column])


def audit_coverage(df: DataFrame) -> DataFrame:
    """Non-missing count and rate per column; blank text counts as missing."""
    metrics = {
        c: {"nonmissing_count": F.count_if(~_missing(df, c)), "row_count": F.count(F.lit(1))} for c in df.columns
    }
    return profile(df, metrics).withColumn("coverage_rate", F.try_divide("nonmissing_count", "row_count"))


def _missing_issues(df: DataFrame, codes: Mapping[str, str], severity: str) -> DataFrame:
    counts = profile(df, {c: {"count": F.count_if(_missing(df, c))} for c in codes})
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("field")]
    return counts.filter("count > 0").select(
        code.alias("code"), F.lit(severity).alias("severity"), "field", "count"
    )


def audit_required(df: DataFrame, required: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    codes = {c: "MISSING_REQUIRED_DATE_VALUES" if c in dates else "MISSING_REQUIRED_VALUES" for c in required}
    return _missing_issues(df, codes, "ISOLATE")


def audit_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _missing_issues(df, dict.fromkeys(keys, "MISSING_KEY_VALUES"), "FAIL")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys among the rows whose keys are all present, compared as text."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & ~_missing(df, key)
    return (
        df.filter(complete)
        .groupBy(*[F.col(k).cast("string").alias(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("count"))
        .filter("count > 1")
    )


def audit_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicate_groups(df, keys).agg(
        F.count(F.lit(1)).alias("duplicate_group_count"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_row_count"),
    )


def duplicate_examples(df: DataFrame, keys: Sequence[str], limit: int = SAMPLE) -> DataFrame:
    """First repeated keys in key order: a bounded report sample."""
    return duplicate_groups(df, keys).orderBy(*keys).limit(limit)


def audit_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parsed, invalid and range per date field."""
    fields = {}
    for c in columns:
        filled, moment = ~_missing(df, c), parse_timestamp(F.col(c))
        fields[c] = {
            "nonmissing": F.count_if(filled),
            "parsed": F.count_if(filled & moment.isNotNull()),
            "invalid": F.count_if(filled & moment.isNull()),
            "minimum": F.min(moment),
            "maximum": F.max(moment),
        }
    return profile(df, fields)


def invalid_date_samples(df: DataFrame, column: str, row_key: str, limit: int = SAMPLE) -> DataFrame:
    bad = ~_missing(df, column) & parse_timestamp(F.col(column)).isNull()
    return df.filter(bad).select(row_key, column).orderBy(row_key).limit(limit)


def audit_numerics(df: DataFrame, decimal_marks: Mapping[str, str]) -> DataFrame:
    """Parsed, invalid and negative per numeric field, each with its own decimal mark."""
    fields = {}
    for c, mark in decimal_marks.items():
        filled, number = ~_missing(df, c), parse_number(F.col(c), mark)
        fields[c] = {
            "nonmissing": F.count_if(filled),
            "parsed": F.count_if(filled & number.isNotNull()),
            "invalid": F.count_if(filled & number.isNull()),
            "negative": F.count_if(number < 0),
        }
    return profile(df, fields)


def audit_schema(df: DataFrame, required: Sequence[str], optional: Sequence[str] = (), allow_extra: bool = False) -> DataFrame:
    """Missing and unregistered columns as issue rows."""
    registered = {*required, *optional}
    found = [("MISSING_REQUIRED_COLUMN", "FAIL", c) for c in required if c not in df.columns]
    found += [("UNREGISTERED_COLUMN", "WARN" if allow_extra else "FAIL", c) for c in df.columns if c not in registered]
    rows = [{"code": code, "severity": severity, "field": c, "count": 1} for code, severity, c in found]
    return registry(df.sparkSession, rows, {"code": "string", "severity": "string", "field": "string", "count": "bigint"})


def audit_row_count(df: DataFrame, minimum: int) -> DataFrame:
    return (
        df.agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") < minimum)
        .select(F.lit("ROW_COUNT_BELOW_MINIMUM").alias("code"), F.lit("FAIL").alias("severity"),
                F.lit(None).cast("string").alias("field"), "count")
    )


def audit_issues(
    df: DataFrame,
    *,
    keys: Sequence[str],
    required: Sequence[str],
    dates: Sequence[str] = (),
    numerics: Mapping[str, str] | None = None,
    allow_negative: Sequence[str] = (),
    optional: Sequence[str] = (),
    allow_extra: bool = False,
    minimum_rows: int = 1,
) -> DataFrame:
    """All issue rows (code, severity, field, count) of one source.

    The columns that the audits look at are read from the source once and kept for all of them.
    """
    looked_at = dict.fromkeys([*keys, *required, *dates, *(numerics or {})])
    whole, df = df, cut(df.select(*[c for c in looked_at if c in df.columns]))
    layout = ("code", "severity", "field", "count")

    def issue(rows: DataFrame, code: str, severity: str, count: str) -> DataFrame:
        return rows.filter(F.col(count) > 0).select(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), "field", F.col(count).alias("count")
        )

    parts = [
        audit_schema(whole, required, optional, allow_extra),
        audit_row_count(df, minimum_rows),
        audit_required(df, [c for c in required if c in df.columns], dates),
        audit_keys(df, keys),
        issue(
            audit_duplicate_keys(df, keys).withColumn("field", F.lit(None).cast("string")),
            "DUPLICATE_KEYS", "FAIL", "duplicate_group_count",
        ),
    ]
    if dates:
        parts.append(issue(audit_dates(df, dates), "INVALID_DATE_VALUES", "ISOLATE", "invalid"))
    if numerics:
        numbers = audit_numerics(df, numerics)
        parts.append(issue(numbers, "INVALID_NUMERIC_VALUES", "ISOLATE", "invalid"))
        checked = numbers.filter(~F.col("field").isin(*allow_negative)) if allow_negative else numbers
        parts.append(issue(checked, "NEGATIVE_VALUES", "ISOLATE", "negative"))
    result = parts[0].select(*layout)
    for part in parts[1:]:
        result = result.unionByName(part.select(*layout))
    return result


def audit_status(issues: DataFrame) -> DataFrame:
    """FAILED if any issue is fatal, PASS_WITH_ISSUES if any issue is left, else PASS."""
    return issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("severity") == "FAIL").alias("fatal_issue_count"),
        F.count_if(F.col("severity") == "ISOLATE").alias("isolated_issue_count"),
    ).select(
        F.when(F.col("fatal_issue_count") > 0, "FAILED")
        .when(F.col("issue_count") > 0, "PASS_WITH_ISSUES")
        .otherwise("PASS")
        .alias("status"),
        (F.col("fatal_issue_count") == 0).alias("may_advance"),
        "issue_count",
        "fatal_issue_count",
        "isolated_issue_count",
    )
