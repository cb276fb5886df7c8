"""Scalar, list and JSON filters as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError, ValidationError
from ..functions import ascii_fold, canonical_json, json_at, json_elements, json_integer, json_number, json_string
from ..schema import Field, Model

#: Camel-case spellings of operators and arguments that are also accepted.
SPELLINGS = {
    "notIn": "not_in", "startsWith": "starts_with", "endsWith": "ends_with", "hasEvery": "has_every", "hasSome": "has_some", "isEmpty": "is_empty", "isNot": "is_not", "orderBy": "order_by",
    "createMany": "create_many", "connectOrCreate": "connect_or_create", "updateMany": "update_many", "deleteMany": "delete_many", "skipDuplicates": "skip_duplicates", "targetWhere": "target_where", "setWhere": "set_where",
}


def spelled(d: dict) -> dict:
    return {SPELLINGS.get(k, k): v for k, v in d.items()}


@dataclass(frozen=True)
class FieldRef:
    """Another field of the same model as an operand."""

    name: str


class _Token:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


#: Which null a JSON filter or write means: the database's, the document's, or (in filters) either.
DB_NULL, JSON_NULL, ANY_NULL = _Token("DB_NULL"), _Token("JSON_NULL"), _Token("ANY_NULL")

_ORDER_OPS = ("equals", "not", "in", "not_in", "lt", "lte", "gt", "gte")
_TEXT_OPS = ("contains", "starts_with", "ends_with")
_LIST_OPS = ("equals", "not", "has", "has_every", "has_some", "is_empty")
_JSON_OPS = ("path", "mode", "equals", "not", "lt", "lte", "gt", "gte", "string_contains", "string_starts_with", "string_ends_with", "array_contains", "array_starts_with", "array_ends_with")
_COMPARE: dict[str, Callable[[Any, Any], Column]] = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}
_TEXT: dict[str, Callable[[Column, Any], Column]] = {"contains": lambda a, b: a.contains(b), "starts_with": lambda a, b: a.startswith(b), "ends_with": lambda a, b: a.endswith(b)}


#: Values of an `in` from which on it is a join with a table of them.
LONG_LIST = 1000


def allowed_operators(f: Field) -> tuple[str, ...]:
    if f.array:
        return _LIST_OPS
    if f.kind == "string":
        return (*_ORDER_OPS, *_TEXT_OPS, "mode")
    if f.kind == "json":
        return _JSON_OPS
    if f.kind in ("enum", "blob"):
        return _ORDER_OPS[:4]
    return _ORDER_OPS[:2] if f.kind in ("boolean", "vector", "point") else _ORDER_OPS


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def literal(f: Field, value: Any) -> Column:
    """A value as a column of the field's type; unfit values are refused."""
    if isinstance(value, Column):
        return value
    if f.kind == "enum" and not f.array and value is not None and value not in f.values:
        raise ValidationError(f"{value!r} isn't one of {', '.join(f.values)}")
    if f.kind == "point" and isinstance(value, dict):
        return F.struct(F.lit(float(value["x"])).alias("x"), F.lit(float(value["y"])).alias("y"))
    if f.kind == "vector" and f.dimension and value is not None and len(value) != f.dimension:
        raise ValidationError(f"a vector of {f.dimension} numbers is needed, not of {len(value)}")
    if f.array or f.kind == "vector":
        if value is None:
            return F.lit(None).cast(f.spark_type())
        one = Field(f.kind, values=f.values, precision=f.precision, scale=f.scale, zone=f.zone) if f.array else Field("float")
        return F.array(*(literal(one, v) for v in value)).cast(f.spark_type())
    if f.kind == "decimal" and value is not None:
        if not re.fullmatch(r"-?\d+(\.\d+)?", str(value)):
            raise ValidationError(f"{value!r} isn't a plain decimal")
        value = Decimal(str(value))
    if f.kind == "blob" and value is not None:
        return F.lit(bytes(value))
    if isinstance(value, bool) != (f.kind == "boolean") and value is not None and f.kind in ("boolean", "int", "big_int", "float"):
        raise ValidationError(f"{value!r} isn't a value of kind {f.kind}")
    return F.lit(value).cast(f.spark_type())


class Operands:
    """Resolves operands against a model's columns."""

    def __init__(self, model: Model, refs: bool = True):
        self.model, self.refs = model, refs

    def resolve(self, value: Any) -> Any:
        return value(self) if callable(value) and not isinstance(value, (Column, type)) else value

    def __getattr__(self, name: str) -> FieldRef:
        if name.startswith("__") or name not in self.__dict__["model"].fields:
            raise AttributeError(name)
        return FieldRef(name)

    def column(self, f: Field, value: Any) -> Column:
        value = self.resolve(value)
        if isinstance(value, FieldRef):
            other = self.model.fields.get(value.name)
            if not self.refs:
                raise UnsupportedError("field references can't be used here")
            if other is None or other.kind != f.kind or other.array != f.array:
                raise ValidationError(f"{value.name} isn't a field of kind {f.kind} of {self.model.name}")
            return F.col(f"`{value.name}`")
        return literal(f, value)


def scalar_filter(f: Field, c: Column, cond: Any, ops: Operands, insensitive: bool = False) -> Column:
    """A field's condition: an operator object, a value (equals) or None (is null)."""
    cond = ops.resolve(cond)
    if f.kind == "json" and not f.array:
        if not isinstance(cond, dict):
            raise ValidationError("a json condition is an object of operators")
        return json_filter(c, cond)
    if not isinstance(cond, dict) or (f.kind == "point" and set(cond) == {"x", "y"}):
        cond = {"equals": cond}
    cond = spelled(cond)
    if not cond:
        return F.lit(True)
    for op in cond:
        if op not in allowed_operators(f):
            raise ValidationError(f"{op} isn't an operator of {'lists of ' * f.array}{f.kind}")
    mode = cond.pop("mode", None)
    if mode not in (None, "default", "insensitive"):
        raise ValidationError(f"unknown mode {mode!r}")
    insensitive = insensitive or mode == "insensitive"
    fold = ascii_fold if insensitive and f.kind == "string" and not f.array else lambda x: x
    parts = [_operator(f, c, op, ops.resolve(v), ops, fold, insensitive) for op, v in cond.items()]
    return all_of(parts)


def _operator(f: Field, c: Column, op: str, v: Any, ops: Operands, fold: Callable, insensitive: bool) -> Column:
    if op == "not" and isinstance(v, dict) and not (f.kind == "point" and set(v) == {"x", "y"}):
        return ~scalar_filter(f, c, v, ops, insensitive)
    if op in ("equals", "not"):
        if v is None:
            return c.isNull() if op == "equals" else c.isNotNull()
        return fold(c) == fold(ops.column(f, v)) if op == "equals" else fold(c) != fold(ops.column(f, v))
    if op in ("in", "not_in"):
        if not isinstance(v, (list, tuple, set)) or any(isinstance(ops.resolve(x), FieldRef) for x in v):
            raise ValidationError(f"{op} takes a list of values")
        if not v:
            return F.lit(op == "not_in")
        values = [fold(literal(f, x)) for x in v]
        found = fold(c).isin(*values)
        return found if op == "in" else ~found
    if op == "is_empty":
        empty = c.isNull() | (F.size(c) == 0)
        return empty if v else ~empty
    if op == "has":
        if v is None:
            raise ValidationError("has takes a value")
        return F.array_contains(c, _element(f, v))
    if op == "has_every":
        return all_of([F.array_contains(c, _element(f, x)) for x in v])
    if op == "has_some":
        return F.coalesce(F.arrays_overlap(c, literal(f, list(v))), F.when(c.isNotNull(), F.lit(False))) if v else F.lit(False)
    if v is None:
        raise ValidationError(f"{op} takes a value")
    operand = fold(ops.column(f, v))
    return (_TEXT[op] if op in _TEXT else _COMPARE[op])(fold(c), operand)


def _element(f: Field, v: Any) -> Column:
    return literal(Field(f.kind, values=f.values, precision=f.precision, scale=f.scale, zone=f.zone), v)


def json_path(path: Any) -> str:
    """A path as a list of keys and places, or as text such as $.a[0].b; quotes and backslashes are refused."""
    if isinstance(path, str):
        if not re.fullmatch(r"\$(\.[^.\[\]'\"\\*]+|\[\d+\])*", path):
            raise ValidationError(f"{path!r} isn't a path of keys and places")
        return path
    out = "$"
    for p in path:
        if re.search(r"['\"\\]", str(p)):
            raise ValidationError(f"{p!r} can't be part of a path")
        out += f"[{p}]" if isinstance(p, int) or str(p).isdigit() else f".{p}" if re.fullmatch(r"\w+", str(p)) else f"['{p}']"
    return out


def json_filter(c: Column, cond: dict, path: str | None = None, insensitive: bool = False) -> Column:
    cond = spelled(cond)
    for op in cond:
        if op not in _JSON_OPS:
            raise ValidationError(f"{op} isn't an operator of json")
    if "path" in cond:
        path = json_path(cond.pop("path"))
    mode = cond.pop("mode", None)
    if mode is not None:
        if mode not in ("default", "insensitive"):
            raise ValidationError(f"unknown mode {mode!r}")
        if not any(op.startswith("string_") or op == "not" for op in cond):
            raise ValidationError("mode is for string operators")
        insensitive = mode == "insensitive"
    if not cond:
        raise ValidationError("a json condition needs an operator besides path and mode")
    v = json_at(c, path or "$")
    return all_of([_json_operator(c, v, op, x, path, insensitive) for op, x in cond.items()])


def _json_operator(c: Column, v: Column, op: str, x: Any, path: str | None, insensitive: bool) -> Column:
    fold = ascii_fold if insensitive else lambda y: y
    text = F.to_json(v)
    if op == "not" and isinstance(x, dict) and x and set(spelled(x)) <= set(_JSON_OPS):
        if "not" in x:
            raise ValidationError("a json not can't hold another")
        return ~json_filter(c, x, path, insensitive)
    if op in ("equals", "not"):
        if isinstance(x, _Token):
            if path:
                raise ValidationError(f"{x} can't be used under a path")
            null = {DB_NULL: c.isNull(), JSON_NULL: text == "null", ANY_NULL: c.isNull() | (text == "null")}[x]
            return null if op == "equals" else ~F.coalesce(null, F.lit(False)) if x is not JSON_NULL else text != "null"
        if x is None:
            null = text == "null" if path else c.isNull()
            return null if op == "equals" else ~null
        return text == canonical_json(x) if op == "equals" else text != canonical_json(x)
    if op in _COMPARE:
        if isinstance(x, bool) or not isinstance(x, (int, float, str, Decimal)):
            raise ValidationError(f"{op} takes a number or a string")
        if isinstance(x, str):
            return F.coalesce(_COMPARE[op](json_string(v), F.lit(x)), F.lit(False))
        exact = [_COMPARE[op](json_integer(v), F.lit(Decimal(x)).cast("decimal(38,0)"))] if isinstance(x, int) and abs(x) < 10**38 else []
        return F.coalesce(*exact, _COMPARE[op](json_number(v), F.lit(float(x))), F.lit(False))
    if op.startswith("string_"):
        return _TEXT[op.removeprefix("string_")](fold(F.try_variant_get(v, "$", "string")), fold(F.lit(x)))
    elements = json_elements(v)
    if op == "array_contains":
        wanted = x if isinstance(x, list) else [x]
        return all_of([F.array_contains(elements, canonical_json(y)) for y in wanted]) & elements.isNotNull()
    return F.try_element_at(elements, F.lit(1 if op == "array_starts_with" else -1)) == canonical_json(x)
