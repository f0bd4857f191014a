"""Table contracts and registry reads: a broken rule becomes a row, not an exception."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.grid import registry
from paneloom.functions.text import blank_to_null, parse_flag
from paneloom.operators.ranking import attach


@dataclass(frozen=True)
class Contract:
    """Ordered columns with types, nullability, ranges and unique keys."""

    columns: Mapping[str, str]
    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    between: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    greater_than: Mapping[str, float] = field(default_factory=dict)
    greater_or_equal: Mapping[str, float] = field(default_factory=dict)
    strict: bool = True


def validate_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per broken rule: (rule, column_name, violations)."""
    spark = df.sparkSession
    names = list(contract.columns)
    found: list[tuple[str, str, int]] = []
    head = df.columns if contract.strict else df.columns[: len(names)]
    if head != names:
        found.append(("columns", ",".join(df.columns), 1))
    types = dict(df.dtypes)
    found += [("dtype", n, 1) for n, t in contract.columns.items() if n in types and types[n] != t]
    layout = {"rule": "string", "column_name": "string", "violations": "bigint"}
    result = registry(spark, [dict(zip(layout, row, strict=True)) for row in found], layout)

    checks: list[tuple[str, str, Column]] = [("not_null", n, F.col(n).isNull()) for n in contract.not_null]
    checks += [("between", n, ~F.col(n).between(lo, hi)) for n, (lo, hi) in contract.between.items()]
    checks += [("greater_than", n, ~(F.col(n) > low)) for n, low in contract.greater_than.items()]
    checks += [("greater_or_equal", n, ~(F.col(n) >= low)) for n, low in contract.greater_or_equal.items()]
    checks = [c for c in checks if c[1] in types]
    if checks:
        counted = df.agg(*[F.count_if(cond).alias(f"_{i}") for i, (_, _, cond) in enumerate(checks)])
        rows = F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.lit(n).alias("column_name"), F.col(f"_{i}").alias("violations"))
                for i, (r, n, _) in enumerate(checks)
            ]
        )
        result = result.unionByName(counted.select(F.explode(rows).alias("r")).select("r.*"))
    for key in contract.unique:
        repeated = (
            df.groupBy(*key)
            .count()
            .filter("count > 1")
            .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
            .select(F.lit("unique").alias("rule"), F.lit(",".join(key)).alias("column_name"), "violations")
        )
        result = result.unionByName(repeated)
    return result.filter("violations > 0")


def violation_count(df: DataFrame, contract: Contract) -> int:
    return validate_contract(df, contract).count()


def constant_value(df: DataFrame, column: str) -> DataFrame:
    """The single non-blank value of a lineage column; ``is_constant`` tells if there is just one."""
    value = blank_to_null(F.col(column).cast("string"))
    return df.agg(F.min(value).alias("value"), F.max(value).alias("_last")).select(
        F.lit(column).alias("column_name"),
        F.when(F.col("value") == F.col("_last"), F.col("value")).alias("value"),
        F.coalesce(F.col("value") == F.col("_last"), F.lit(False)).alias("is_constant"),
    )


def read_known_cases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], expected: Mapping[str, str], flags: Mapping[str, bool]
) -> DataFrame:
    """Canonical known cases with the first problem of each row (null when the row is usable).

    ``aliases`` lists header spellings per field, first non-blank wins; ``expected`` fixes text
    fields and ``flags`` fixes inclusion flags.
    """

    def first_filled(name: str) -> Column:
        present = [blank_to_null(F.col(a).cast("string")) for a in aliases[name] if a in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    rows = df.select(*[first_filled(name).alias(name) for name in aliases])
    year = F.col("period").try_cast("double")
    period = F.when((year == F.floor(year)) & year.between(1900, 2200), year.cast("int"))
    problem = F.when(F.col("case_id").isNull(), "CASE_ID_MISSING").when(F.col("entity_id").isNull(), "ENTITY_MISSING")
    problem = problem.when(period.isNull(), "PERIOD_INVALID")
    for name, value in expected.items():
        problem = problem.when(~F.col(name).eqNullSafe(F.lit(value)), f"{name.upper()}_UNEXPECTED")
    for name, value in flags.items():
        flag = parse_flag(F.col(name))
        problem = problem.when(flag.isNull(), f"{name.upper()}_NOT_BOOLEAN")
        problem = problem.when(flag != F.lit(value), f"{name.upper()}_UNEXPECTED")
    checked = rows.select("case_id", "entity_id", period.alias("period"), problem.alias("problem"))
    keys = ["case_id", "entity_id", "period"]
    counts = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return attach(checked, counts, keys).select(
        *keys, F.coalesce("problem", F.when(F.col("_copies") > 1, F.lit("DUPLICATE_CASE"))).alias("problem")
    )


def audit_event_source(df: DataFrame) -> DataFrame:
    """Eligible, excluded, unresolved and repeated rows of a document-entity-code source.

    Expects text columns entity_id, document_id, code, target_period, include_flag, direct_flag.
    """
    include, direct = parse_flag(F.col("include_flag")), parse_flag(F.col("direct_flag"))
    eligible, unresolved = include & direct, blank_to_null(F.col("target_period")).isNull()
    per_key = df.groupBy(F.trim("document_id").alias("d"), F.trim("entity_id").alias("e"), F.trim("code").alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(~eligible).alias("excluded"),
        F.count_if(~eligible & unresolved).alias("excluded_unresolved"),
        F.count_if(eligible & unresolved).alias("eligible_unresolved"),
        F.count_if(include.isNull() | direct.isNull()).alias("bad_flags"),
        F.count_if(blank_to_null(F.col("document_id")).isNull() | blank_to_null(F.col("entity_id")).isNull()).alias("bad_keys"),
    )
    return per_key.agg(
        F.sum("n").alias("row_count"),
        F.sum("eligible").alias("eligible_row_count"),
        F.sum("excluded").alias("excluded_row_count"),
        F.sum("excluded_unresolved").alias("excluded_unresolved_row_count"),
        F.sum("eligible_unresolved").alias("eligible_unresolved_row_count"),
        F.sum("bad_flags").alias("invalid_flag_row_count"),
        F.sum("bad_keys").alias("missing_key_row_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_document_entity_code_count"),
    )
