"""Three-valued (true / false / unknown) aggregates.

``bool_or`` skips nulls, so on its own it turns "false or unknown" into false. These
aggregates keep the unknown. All are algebraic: they combine map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def any_true(value: Column) -> Column:
    """Kleene OR over a group: true > unknown > false, and an empty group is unknown."""
    return (
        F.when(F.bool_or(value), F.lit(True))
        .when((F.count(value) == F.count("*")) & (F.count(value) > 0), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def union_label(outcome: Column, opportunity: Column | None = None, expected: Column | None = None) -> Column:
    """Union label: true if any source is true; false only if every expected source is an
    observed zero that had an observation opportunity; otherwise unknown.

    ``expected`` is the number of sources that must report. Leave it out only when the rows
    already form the full source grid.
    """
    zero = outcome == F.lit(False)
    if opportunity is not None:
        zero = zero & opportunity
    need = F.count("*") if expected is None else F.max(expected)
    return (
        F.when(F.bool_or(outcome), F.lit(True))
        .when((F.count_if(zero) == need) & (F.count_if(zero) > 0), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def effective_opportunity(first: Column, second: Column) -> Column:
    """Kleene AND of two opportunities, which is SQL's own three-valued AND."""
    return first & second


def differs(left: Column, right: Column) -> Column:
    """Inequality that counts unknown as a value of its own."""
    return ~left.eqNullSafe(right)
