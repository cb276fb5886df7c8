"""Column functions: text folding, JSON values, vectors."""

from __future__ import annotations

import json as _json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Lower case of A to Z only; other letters stay as they are."""
    return F.translate(c, _UP, _LOW)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


DISTANCES = {"l2": l2_distance, "cosine": cosine_distance}


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def canonical_json(value: Any) -> Column:
    """The text that to_json gives for the variant of this value: keys sorted, no spaces."""
    return F.to_json(F.parse_json(F.lit(_json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))))


def json_at(document: Column, path: str) -> Column:
    """The variant at a path; NULL where the document is NULL or the path is absent."""
    return F.try_variant_get(F.try_parse_json(document), path, "variant")


def json_class(v: Column) -> Column:
    """number, string, boolean, array, object or null; NULL where there is no value."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.isNull(), None)
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def json_number(v: Column) -> Column:
    """The number a variant holds; NULL for anything else, numeric strings included."""
    return F.when(json_class(v) == "number", F.try_variant_get(v, "$", "double"))


def json_integer(v: Column) -> Column:
    """The whole number a variant holds, exactly; NULL for anything else."""
    return F.when(F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))"), F.try_variant_get(v, "$", "decimal(38,0)"))


def json_string(v: Column) -> Column:
    return F.when(json_class(v) == "string", F.try_variant_get(v, "$", "string"))


def json_elements(v: Column) -> Column:
    """Canonical texts of an array's elements; NULL unless it is an array."""
    return F.when(json_class(v) == "array", F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))


__all__ = ["DISTANCES", "ascii_fold", "canonical_json", "cosine_distance", "json_at", "json_class", "json_elements", "json_integer", "json_number", "json_string", "l2_distance", "vector_literal"]
