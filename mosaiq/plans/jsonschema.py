"""JSON Schema of a model's arguments, for callers that check payloads before sending them."""

from __future__ import annotations

from typing import Any

from ..operators.predicates import allowed_operators
from ..schema import NUMERIC, Field, Model, Registry

_VALUES: dict[str, dict[str, Any]] = {
    "string": {"type": "string"}, "int": {"type": "integer"}, "big_int": {"type": "integer"}, "float": {"type": "number"}, "decimal": {"type": "string", "pattern": r"^-?\d+(\.\d+)?$"}, "boolean": {"type": "boolean"},
    "date": {"type": "string", "format": "date"}, "date_time": {"type": "string", "format": "date-time"}, "time": {"type": "string"}, "blob": {"type": "string", "contentEncoding": "base64"}, "json": {},
    "point": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "number"}}, "required": ["x", "y"], "additionalProperties": False},
}


def _closed(properties: dict, **more: Any) -> dict:
    return {"type": "object", "properties": properties, "additionalProperties": False, **more}


def value_schema(f: Field, element: bool = False) -> dict:
    if f.kind == "vector":
        size = {"minItems": f.dimension, "maxItems": f.dimension} if f.dimension else {}
        return {"type": "array", "items": {"type": "number"}, **size}
    one = {"enum": list(f.values)} if f.kind == "enum" else dict(_VALUES[f.kind])
    out = {"type": "array", "items": one} if f.array and not element else one
    return {"anyOf": [out, {"type": "null"}]} if f.nullable and not element else out


def _filter(f: Field, name: str) -> dict:
    value, one = value_schema(f), value_schema(f, element=True)
    lists = {"in", "not_in", "has_every", "has_some", "array_contains"}
    kinds = {"mode": {"enum": ["default", "insensitive"]}, "is_empty": {"type": "boolean"}, "has": one, "path": {"type": ["string", "array"]}, "not": {"anyOf": [value, {"$ref": f"#/$defs/{name}"}]}}
    return _closed({op: kinds.get(op, {"type": "array", "items": one} if op in lists and f.kind != "json" else value) for op in allowed_operators(f)})


def argument_schemas(registry: Registry, model_name: str) -> dict:
    """where, order_by, data (create) and changes (update) of a model, with the filters of other models as definitions."""
    defs: dict[str, dict] = {}
    for m in registry.models.values():
        for k, f in m.fields.items():
            defs[f"{m.name}.{k}"] = _filter(f, f"{m.name}.{k}")
        ref = {"$ref": f"#/$defs/{m.name}.where"}
        conditions = {k: {"anyOf": [*([] if f.kind == "json" else [value_schema(f), {"type": "null"}]), {"$ref": f"#/$defs/{m.name}.{k}"}]} for k, f in m.fields.items()}
        for k, r in m.relations.items():
            other = {"$ref": f"#/$defs/{r.target}.where"}
            conditions[k] = {"anyOf": [_closed({"is": {"anyOf": [other, {"type": "null"}]}, "is_not": {"anyOf": [other, {"type": "null"}]}}), other, {"type": "null"}]} if r.kind == "one" else _closed(dict.fromkeys(("some", "every", "none"), other))
        both = {"anyOf": [ref, {"type": "array", "items": ref}]}
        defs[f"{m.name}.where"] = _closed({**conditions, "AND": both, "OR": {"type": "array", "items": ref}, "NOT": both})
    m: Model = registry[model_name]
    direction = {"enum": ["asc", "desc"]}
    order = {k: {"anyOf": [direction, _closed({"sort": direction, "nulls": {"enum": ["first", "last"]}})]} for k, f in m.fields.items() if f.kind not in ("json", "point", "vector") and not f.array}
    changes = {}
    for k, f in m.fields.items():
        ops = {"set": value_schema(f)}
        if f.kind in NUMERIC and not f.array:
            ops |= dict.fromkeys(("increment", "decrement", "multiply", "divide"), value_schema(f, element=True))
        if f.array:
            ops |= dict.fromkeys(("push", "unshift"), {"anyOf": [value_schema(f, element=True), {"type": "array", "items": value_schema(f, element=True)}]})
        changes[k] = {"anyOf": [value_schema(f), _closed(ops)]}
    required = [k for k, f in m.fields.items() if not (f.nullable or f.has_default or f.generate or f.array)]
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": defs, "where": {"$ref": f"#/$defs/{m.name}.where"}, "order_by": {"anyOf": [_closed(order), {"type": "array", "items": _closed(order)}]}, "data": _closed({k: value_schema(f) for k, f in m.fields.items()}, required=required), "changes": _closed(changes)}
