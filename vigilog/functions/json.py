"""Strict JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: str | Column) -> Column:
    """The text as a variant if it is exactly one JSON value, else null.

    The built-in parser ignores whatever follows the first value. Text that stays valid both as the
    only member of an array and as the value of a field has nothing before or after its one value.
    """
    text = F.col(text) if isinstance(text, str) else text
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(as_item.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))
