"""Typed reading of loose JSON: strict parsing, per-field defaults, and reasons for rejection.

A field is a pair of columns: the value to use and whether the input was acceptable. An absent key
takes its default; an explicit null or a value of the wrong type is rejected, never coerced away.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns that are computed one time per row, whoever reads them afterwards.

    A plain projection is merged into every filter above it, which would parse the same text once
    per mention. Filters do not move below a generator, so a generator of exactly one row is the
    fence.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(made)))


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else NULL.

    The JSON parser stops at the end of the first value, so the text is parsed as the first of two items
    of an array. The second is the text's own hash: only a text that is one value leaves it where it
    belongs, since no text can hold its own hash to close the array early.
    """
    mark = F.xxhash64(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))

    def first(v: Column) -> Column:
        alone = (F.try_variant_get(v, "$[1]", "bigint") == mark) & F.try_variant_get(v, "$[2]", "variant").isNull()
        return F.when(alone, F.try_variant_get(v, "$[0]", "variant"))

    return F.get(F.transform(F.array(both), first), F.lit(0))


def kind_of(v: Column) -> Column:
    """Type name of a VARIANT: OBJECT<…>, ARRAY<…>, STRING, BIGINT, VOID, …; NULL when absent."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("ARRAY"), F.lit(False))


def member(v: Column, key: str) -> Column:
    """Member of a VARIANT object; SQL NULL when absent, VARIANT null when explicitly null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def elements(v: Column) -> Column:
    """Items of a VARIANT array as ``array<variant>``."""
    return F.try_variant_get(v, "$", "array<variant>")


@dataclass(frozen=True)
class Field:
    """Value and acceptability of one contract field."""

    value: Column
    ok: Column


def _field(v: Column, accepted: Column, value: Column, default: Column) -> Field:
    absent = v.isNull()
    good = F.coalesce(accepted, F.lit(False))
    return Field(F.when(absent, default).when(good, value), absent | good)


def text_field(v: Column, default: Column) -> Field:
    """A JSON string."""
    return _field(v, kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"), default)


def int_field(v: Column, default: Column) -> Field:
    """A whole number: integral JSON number, numeric text, or boolean."""
    shown = F.try_variant_get(v, "$", "string")
    digits = F.regexp_extract(shown, r"\A\s*([+-]?\d+)(?:\.0*)?\s*\z", 1)
    value = F.coalesce(digits.try_cast("int"), F.when(kind_of(v) == "BOOLEAN", F.try_variant_get(v, "$", "int")))
    return _field(v, value.isNotNull(), value, default)


def number_field(v: Column, default: Column) -> Field:
    """A number, or text that reads as one."""
    kind = kind_of(v)
    from_text = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\A\s+|\s+\z", "").try_cast("double")
    value = F.when(kind == "STRING", from_text).otherwise(F.try_variant_get(v, "$", "double"))
    return _field(v, value.isNotNull(), value, default)


def text_list_field(v: Column, default: Column) -> Field:
    """An array of JSON strings."""
    items = F.try_variant_get(v, "$", "array<variant>")
    accepted = is_array(v) & F.forall(items, lambda e: F.coalesce(kind_of(e) == "STRING", F.lit(False)))
    return _field(v, accepted, F.try_variant_get(v, "$", "array<string>"), default)


def text_map_field(v: Column, default: Column) -> Field:
    """An object whose values are all JSON strings."""
    values = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    accepted = is_object(v) & F.forall(values, lambda e: F.coalesce(kind_of(e) == "STRING", F.lit(False)))
    return _field(v, accepted, F.try_variant_get(v, "$", "map<string,string>"), default)


def object_list_field(v: Column) -> Field:
    """An array of objects, kept as ``array<variant>``; absent means empty."""
    items = F.try_variant_get(v, "$", "array<variant>")
    accepted = is_array(v) & F.forall(items, is_object)
    return _field(v, accepted, items, F.expr("cast(array() as array<variant>)"))


def open_items(items: Column, keys: Sequence[str]) -> Column:
    """``array<variant>`` of objects to an array of structs with one VARIANT per key, read in one pass."""
    shape = ",".join(f"{k}:variant" for k in keys)
    return F.transform(items, lambda item: F.try_variant_get(item, "$", f"struct<{shape}>"))


def first_reason(*rules: tuple[Column, Column]) -> Column:
    """Text of the first rule whose condition does not hold; NULL when all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for ok, reason in rules])
