"""JSON payloads as variants: parsed once, then read by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the variant of a JSON column; text that isn't JSON is null, a variant column is taken as it is."""
    is_variant = df.schema[column].dataType.typeName() == "variant"
    return df.withColumn(name, F.col(column) if is_variant else F.try_parse_json(column))


def text_at(payload: str, path: str) -> Column:
    """Text at a path; null where there is none, or an empty one."""
    return F.nullif(F.try_variant_get(F.col(payload), path, "string"), F.lit(""))


def texts_at(payload: str, path: str) -> Column:
    """List of texts at a path; null where there is no list."""
    return F.try_variant_get(F.col(payload), path, "array<string>")


def there(payload: str, path: str) -> Column:
    """Whether something other than null lies at a path."""
    at = F.try_variant_get(F.col(payload), path, "variant")
    return at.isNotNull() & ~F.is_variant_null(at)
