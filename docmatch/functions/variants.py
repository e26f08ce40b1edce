"""Type tests and field access on ``variant`` values.

Plain casts coerce (the number 1 reads as the string "1"), so scalar types are tested by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(v: Column, path: str = "$") -> Column:
    """The list at ``path`` as ``array<variant>``; NULL when absent or not a list."""
    return F.try_variant_get(v, path, "array<variant>")


def field(v: Column, name: str) -> Column:
    """The value of an object key; NULL when the key is absent."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def string_field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_list(v: Column) -> Column:
    return items(v).isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False)
    )


def text_field(v: Column, name: str) -> Column:
    """An object key whose value is a string; NULL for any other kind of value."""
    return F.when(is_string(field(v, name)), string_field(v, name))


def other_fields(v: Column, known: Callable[[Column], Column]) -> Column:
    """The keys of an object that are not ``known``, values as text."""
    others = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~known(k))
    return F.transform_values(others, lambda _, x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
