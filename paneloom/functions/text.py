"""Text cleaning and parsing expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of yes / no flags.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form; Spark has no built-in for it."""
    for batch in batches:
        yield batch.str.normalize("NFKC")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def is_missing(column: Column, dtype: str) -> Column:
    """Null, NaN or blank text."""
    if dtype in ("double", "float"):
        return column.isNull() | F.isnan(column)
    if dtype == "string":
        return column.isNull() | (F.trim(column) == "")
    return column.isNull()


def norm_text(text: Column) -> Column:
    """Trim, lower-case and collapse inner white space."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def norm_code(text: Column) -> Column:
    """Upper-cased code, null when blank."""
    return F.upper(blank_to_null(text))


def token(text: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def parse_flag(text: Column) -> Column:
    """true/1/yes/y and false/0/no/n; every other text is null and shows up as a violation."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def parse_number(text: Column, decimal_mark: str = ".") -> Column:
    """Number from text with thousands separators; non-finite values are null."""
    plain = F.trim(text)
    if decimal_mark == ",":
        plain = F.regexp_replace(F.regexp_replace(plain, r"\.", ""), ",", ".")
    else:
        plain = F.regexp_replace(plain, ",", "")
    number = plain.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def normalize_entity(
    text: Column,
    *,
    unicode_form: bool = True,
    trim: bool = True,
    collapse: bool = True,
    upper: bool = True,
) -> Column:
    """Entity id in its comparison form; each step can be switched off. Empty becomes null."""
    value = nfkc(text) if unicode_form else text
    if trim:
        value = F.trim(value)
    if collapse:
        value = F.regexp_replace(value, r"\s+", " ")
    if upper:
        value = F.upper(value)
    return F.nullif(value, F.lit(""))
