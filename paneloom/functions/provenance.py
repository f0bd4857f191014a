"""Nested provenance text as column expressions.

A cell is parsed once as a variant; its compact text with sorted keys is the canonical form. Strings of
that text, each with the scalars or plain lists that belong to it as a key, are found by one pattern,
and sets are taken with array functions. Nothing leaves the row and no Python runs. A cell that is no
JSON is reported in ``problem`` and yields nothing.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provenance keys (letters and digits, lower case) and null-like tokens.
DOCUMENT_KEYS = {"documentid", "documentids", "decisionid", "decisionids", "decisionnumber", "decisionnumbers"}
DATE_KEYS = {"labelknowndate", "firstlabelknowndate", "lastlabelknowndate", "decisiondate", "publishdate"}
CODE_KEYS = {"taxonomycode", "taxonomycodes", "normalizedviolationcode", "normalizedviolationcodes"}
EMPTY_TOKENS = ("", "[]", "{}", "null", "none", "nan", "na", "n/a", "<na>")

#: Lists inside lists that still belong to a key, and texts or containers inside a reference that are looked into.
LIST_DEPTH, REFERENCE_DEPTH = 3, 3

STRING = r'"(?:[^"\\]|\\.)*"'
SCALAR = rf'(?:{STRING}|[^\s"\[\]{{}},:]+)'


def _plain_list(depth: int) -> str:
    """Pattern of a list of scalars and of such lists."""
    item = SCALAR if depth == 1 else rf"(?:{SCALAR}|{_plain_list(depth - 1)})"
    return rf"\[(?:{item}(?:,{item})*)?\]"


# a string is always taken whole, so a match never starts inside one
KEYED = rf"{STRING}(?::(?:{SCALAR}|{_plain_list(LIST_DEPTH)}))?"


def _values_of(matches: Column, keys: Collection[str]) -> Column:
    """Sorted distinct trimmed scalars under the keys."""

    def belongs(match: Column) -> Column:
        name = F.regexp_replace(F.lower(F.regexp_extract(match, rf"^({STRING}):", 1)), "[^a-z0-9]+", "")
        return name.isin(*sorted(keys))

    def scalars(match: Column) -> Column:
        return F.regexp_extract_all(F.regexp_replace(match, rf"^{STRING}:", ""), F.lit(f"({SCALAR})"), F.lit(1))

    found = F.flatten(F.transform(F.filter(matches, belongs), scalars))
    texts = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    trimmed = F.transform(texts, lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda t: t.isNotNull() & (t != ""))))


def mine_provenance(text: Column | str) -> Column:
    """Canonical JSON, document ids, date texts and codes found at any depth, and what is wrong with the cell."""
    cell = F.col(text) if isinstance(text, str) else text
    whole = F.to_json(F.try_parse_json(cell))
    canonical = F.when(~whole.isin("{}", "[]"), whole)
    matches = F.regexp_extract_all(F.coalesce(canonical, F.lit("")), F.lit(f"({KEYED})"), F.lit(1))
    broken = (F.trim(cell) != "") & whole.isNull()
    return F.struct(
        canonical.alias("canonical"),
        _values_of(matches, DOCUMENT_KEYS).alias("document_ids"),
        _values_of(matches, DATE_KEYS).alias("date_texts"),
        _values_of(matches, CODE_KEYS).alias("codes"),
        F.when(broken, "MALFORMED_PROVENANCE").alias("problem"),
    )


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _kept(value: Column, depth: int) -> Column:
    """Compact JSON of a variant without its null-like parts; null if nothing is left."""
    kind = F.schema_of_variant(value)
    text = F.trim(value.cast("string"))
    if depth == 0:
        return F.when(kind == "STRING", F.when(~is_placeholder(text), _quoted(text))).otherwise(F.to_json(value))
    inner = F.try_parse_json(F.when(F.substring(text, 1, 1).isin("[", "{"), text))
    string = F.when(is_placeholder(text), None).when(inner.isNotNull(), _kept(inner, depth - 1)).otherwise(_quoted(text))
    items = F.transform(F.from_json(F.to_json(value), "array<variant>"), lambda v: _kept(v, depth - 1))
    members = F.map_entries(F.from_json(F.to_json(value), "map<string,variant>"))
    pairs = F.transform(members, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _kept(e["value"], depth - 1)))

    def joined(parts: Column, ends: str) -> Column:
        left = F.array_compact(parts)
        return F.when(F.size(left) > 0, F.concat(F.lit(ends[0]), F.array_join(left, ","), F.lit(ends[1])))

    return (
        F.when(kind == "VOID", None)
        .when(kind == "STRING", string)
        .when(kind.startswith("ARRAY"), joined(items, "[]"))
        .when(kind.startswith("OBJECT"), joined(F.array_sort(pairs), "{}"))
        .otherwise(F.to_json(value))
    )


def canonical_references(text: Column | str) -> Column:
    """Sorted distinct references of a JSON list, without null-like parts, as JSON list of texts; null if none is left.

    A reference that is a text stays that text; anything else is its compact JSON.
    """
    cell = F.col(text) if isinstance(text, str) else text
    listed = F.from_json(F.to_json(F.try_parse_json(cell)), "array<variant>")
    cleaned = F.array_compact(F.transform(listed, lambda v: _kept(v, REFERENCE_DEPTH)))
    plain = F.transform(cleaned, lambda t: F.when(t.startswith('"'), F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]).otherwise(t))
    unique = F.array_sort(F.array_distinct(plain))
    return F.when(F.size(unique) > 0, F.to_json(unique))


def is_placeholder(document_id: Column) -> Column:
    return document_id.isNull() | F.lower(F.trim(document_id)).isin(*EMPTY_TOKENS)
