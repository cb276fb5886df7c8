"""Models: typed fields, relations, keys; and the registry that checks and resolves them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import ModelNotFoundError, SchemaError

ORDERED = ("int", "big_int", "float", "decimal", "string", "date", "date_time", "time")
NUMERIC = ("int", "big_int", "float", "decimal")
KINDS = (*ORDERED, "boolean", "json", "blob", "enum", "vector", "point")
GENERATORS = ("increment", "uuid", "ulid", "nanoid", "cuid", "now", "updated_at")


@dataclass(frozen=True)
class Field:
    kind: str
    column: str | None = None
    nullable: bool = False
    array: bool = False
    id: bool = False
    unique: bool = False
    default: Any = None
    has_default: bool = False
    generate: str | None = None
    values: tuple[str, ...] = ()
    precision: int = 38
    scale: int = 18
    dimension: int | None = None
    zone: bool = True
    check: Any = None

    def spark_type(self) -> T.DataType:
        one = {
            "string": T.StringType(), "enum": T.StringType(), "json": T.StringType(), "time": T.StringType(), "int": T.IntegerType(), "big_int": T.LongType(), "float": T.DoubleType(),
            "boolean": T.BooleanType(), "date": T.DateType(), "blob": T.BinaryType(), "decimal": T.DecimalType(self.precision, self.scale), "vector": T.ArrayType(T.DoubleType()),
            "date_time": T.TimestampType() if self.zone else T.TimestampNTZType(), "point": T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]),
        }[self.kind]
        return T.ArrayType(one) if self.array else one


def _make(kind: str):
    def make(**mods: Any) -> Field:
        if "default" in mods:
            mods["has_default"] = True
        return Field(kind, **mods)

    make.__name__ = kind
    make.__doc__ = f"A field of kind {kind}; keywords are the attributes of Field."
    return make


string, integer, big_int, floating, decimal, boolean, date_time, date, time, json, blob, vector, point = map(
    _make, ("string", "int", "big_int", "float", "decimal", "boolean", "date_time", "date", "time", "json", "blob", "vector", "point")
)


def enum(*values: str, **mods: Any) -> Field:
    return _make("enum")(values=tuple(values), **mods)


@dataclass(frozen=True)
class Relation:
    """kind: one (holds the keys if `fields` is given, else the inverse side), many or m2m."""

    kind: str
    target: str
    fields: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    name: str | None = None
    optional: bool = False
    on_delete: str = "no_action"
    on_update: str = "no_action"
    through: str | None = None
    a: str | None = None
    b: str | None = None

    @property
    def holds(self) -> bool:
        return self.kind == "one" and bool(self.fields)


def _names(x: str | Iterable[str]) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


def to_one(target: str, fields: str | Iterable[str] = (), references: str | Iterable[str] = (), **mods: Any) -> Relation:
    return Relation("one", target, _names(fields), _names(references), **mods)


def to_many(target: str, name: str | None = None) -> Relation:
    return Relation("many", target, name=name)


def many_to_many(target: str, through: str | None = None, a: str | None = None, b: str | None = None, name: str | None = None) -> Relation:
    return Relation("m2m", target, through=through, a=a, b=b, name=name)


@dataclass
class Model:
    name: str
    shape: dict[str, Field | Relation]
    table: str | None = None
    id: tuple[str, ...] = ()
    uniques: dict[str, tuple[str, ...]] = field(default_factory=dict)
    indexes: tuple[tuple[str, ...], ...] = ()
    omit: frozenset[str] = frozenset()

    def __post_init__(self):
        self.id, self.omit = _names(self.id), frozenset(_names(self.omit))
        if not isinstance(self.uniques, dict):
            self.uniques = {"_".join(_names(u)): _names(u) for u in self.uniques}
        self.uniques = {k: _names(v) for k, v in self.uniques.items()}
        self.table = self.table or self.name
        self.fields = {k: v for k, v in self.shape.items() if isinstance(v, Field)}
        self.relations = {k: v for k, v in self.shape.items() if isinstance(v, Relation)}

    def column(self, name: str) -> str:
        return self.fields[name].column or name

    @property
    def key(self) -> tuple[str, ...]:
        """The primary key: the compound one, else the id field, else a field named id, else nothing."""
        return self.id or next(((k,) for k, f in self.fields.items() if f.id), ("id",) if "id" in self.fields else ())

    def unique_keys(self) -> dict[str, tuple[str, ...]]:
        """What a unique `where` may name: fields, and compounds by name."""
        out = {k: (k,) for k, f in self.fields.items() if f.id or f.unique}
        if not out and self.key == ("id",):
            out["id"] = ("id",)
        if self.id:
            out["_".join(self.id)] = self.id
        return out | self.uniques

    def visible(self) -> list[str]:
        return [k for k in self.fields if k not in self.omit]

    def extend(self, **shape: Field | Relation) -> Model:
        return Model(self.name, {**self.shape, **shape}, self.table, self.id, dict(self.uniques), self.indexes, self.omit)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, f.spark_type(), True) for k, f in self.fields.items()])


@dataclass(frozen=True)
class Junction:
    table: str
    source: str
    target: str


class Registry:
    """Models by name, checked."""

    def __init__(self, *models: Model):
        self.models = {m.name: m for m in models}
        issues = self.issues()
        if len(self.models) < len(models):
            issues.append(("M002", "two models have one name"))
        if issues:
            raise SchemaError("; ".join(f"{c}: {m}" for c, m in issues), issues=issues)

    def __getitem__(self, name: str) -> Model:
        if name not in self.models:
            raise ModelNotFoundError(f"no model {name}")
        return self.models[name]

    def inverse(self, model: Model, name: str) -> Relation:
        """The holder's relation that the relation `name` of model answers."""
        rel, target = model.relations[name], self[model.relations[name].target]
        back = [r for r in target.relations.values() if r.target == model.name and r.holds]
        if len(back) > 1 or rel.name:
            back = [r for r in back if r.name == rel.name]
        if len(back) != 1:
            raise SchemaError(f"{model.name}.{name} has {len(back)} possible inverses on {target.name}; a shared name tells them apart")
        return back[0]

    def keys(self, model: Model, name: str) -> list[tuple[str, str]]:
        """(field of model, field of the target) pairs of a relation that isn't many-to-many."""
        rel = model.relations[name]
        if rel.holds:
            return list(zip(rel.fields, rel.references, strict=True))
        held = self.inverse(model, name)
        return [(r, f) for f, r in zip(held.fields, held.references, strict=True)]

    def paired(self, model: Model, name: str) -> Relation | None:
        rel, target = model.relations[name], self[model.relations[name].target]
        back = [r for k, r in target.relations.items() if r.kind == "m2m" and r.target == model.name and r.name == rel.name and (target is not model or k != name)]
        return back[0] if len(back) == 1 else None

    def junction(self, model: Model, name: str) -> Junction:
        rel, other = model.relations[name], self.paired(model, name)
        target = self[rel.target]

        def agreed(mine: str | None, theirs: str | None) -> str | None:
            if mine and theirs and mine != theirs:
                raise SchemaError(f"{model.name}.{name}: both sides configure the junction, as {mine} and {theirs}")
            return mine or theirs

        low, high = sorted((model.name.lower(), target.name.lower()))
        pair = rel.name or (other.name if other else None)
        table = agreed(rel.through, other.through if other else None) or f"{low}_{high}" + (f"_{pair}" if pair else "")
        source, to = agreed(rel.a, other.b if other else None), agreed(rel.b, other.a if other else None)
        if model is target:
            if other and not (source and to):
                raise SchemaError(f"{model.name}.{name}: a pair of self relations needs the columns a and b on one side")
            return Junction(table, source or f"{model.name.lower()}AId", to or f"{model.name.lower()}BId")
        return Junction(table, source or f"{model.name.lower()}Id", to or f"{target.name.lower()}Id")

    def issues(self) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        tables: dict[str, str] = {}
        for m in self.models.values():
            say = lambda code, text, m=m: out.append((code, f"{m.name}{text}"))
            if not m.fields:
                say("M001", " has no fields")
            if tables.setdefault(m.table, m.name) != m.name:
                say("M003", f" shares the table {m.table} with {tables[m.table]}")
            if sum(f.id for f in m.fields.values()) + bool(m.id) > 1:
                say("M005", " has more than one id")
            columns = [m.column(k) for k in m.fields]
            if len(set(columns)) < len(columns):
                say("M004", " maps two fields to one column")
            for label, names in {**m.uniques, "id": m.id}.items():
                for k in names:
                    if k not in m.fields:
                        say("CM001", f".{label} names {k}, which isn't a field")
            for k in m.omit:
                if k not in m.fields:
                    say("M007", f" omits {k}, which isn't a field")
            for k, f in m.fields.items():
                if f.kind not in KINDS:
                    say("F001", f".{k} has the unknown kind {f.kind}")
                if f.id and (f.nullable or f.array):
                    say("F002", f".{k} is an id and can't be nullable or a list")
                if f.kind in ("blob", "json", "vector", "point") and (f.id or f.unique or f.array):
                    say("F003", f".{k} of kind {f.kind} can't be an id, unique or a list")
                if f.generate and f.generate not in GENERATORS:
                    say("F004", f".{k} has the unknown generator {f.generate}")
                if f.generate == "increment" and f.kind not in ("int", "big_int"):
                    say("F005", f".{k} increments but isn't a whole number")
                if f.kind == "enum" and not f.values:
                    say("F006", f".{k} is an enum without values")
                if f.kind == "decimal" and not 0 < f.precision <= 38:
                    say("F007", f".{k} has a precision out of 1 to 38")
            for k, r in m.relations.items():
                if r.target not in self.models:
                    say("R002", f".{k} targets the unknown model {r.target}")
                    continue
                target = self.models[r.target]
                if r.holds:
                    if len(r.fields) != len(r.references):
                        say("FK001", f".{k} pairs {len(r.fields)} fields with {len(r.references)} references")
                        continue
                    for a, b in zip(r.fields, r.references, strict=True):
                        if a not in m.fields:
                            say("FK002", f".{k} uses {a}, which isn't a field")
                        elif b not in target.fields:
                            say("FK003", f".{k} references {r.target}.{b}, which isn't a field")
                        elif m.fields[a].kind != target.fields[b].kind:
                            say("FK004", f".{k} pairs {m.fields[a].kind} with {target.fields[b].kind}")
                    if not out and set(r.references) not in [set(v) for v in target.unique_keys().values()]:
                        say("FK005", f".{k} references fields of {r.target} that aren't unique")
                    if r.on_delete == "set_null" and not all(m.fields[a].nullable for a in r.fields if a in m.fields):
                        say("RA003", f".{k} sets null on delete but its fields aren't nullable")
                elif r.kind == "m2m":
                    if len(m.key) != 1 or len(target.key) != 1:
                        say("JT001", f".{k} needs single-field primary keys on both sides")
                    else:
                        try:
                            self.junction(m, k)
                        except SchemaError as e:
                            say("JT002", f".{k}: {e}")
                else:
                    try:
                        self.inverse(m, k)
                    except SchemaError as e:
                        say("R004", f".{k}: {e}")
        return out


def inferred(name: str, schema: T.StructType, **mods: Any) -> Model:
    """A model of a table as it is stored; keyword fields and relations override or add."""
    kinds = {"int": "int", "bigint": "big_int", "double": "float", "float": "float", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "date_time", "timestamp_ntz": "date_time", "binary": "blob"}
    shape: dict[str, Field | Relation] = {}
    for f in schema:
        t = f.dataType
        if isinstance(t, T.DecimalType):
            shape[f.name] = Field("decimal", precision=t.precision, scale=t.scale, nullable=f.nullable)
        elif isinstance(t, T.ArrayType) and t.elementType.simpleString() in kinds:
            shape[f.name] = Field(kinds[t.elementType.simpleString()], array=True, nullable=f.nullable)
        elif t.simpleString() in kinds:
            shape[f.name] = Field(kinds[t.simpleString()], nullable=f.nullable, zone=not isinstance(t, T.TimestampNTZType))
    shape |= mods.pop("shape", {})
    return Model(name, shape, **mods)


__all__ = ["Field", "Junction", "Model", "Registry", "Relation", "big_int", "blob", "boolean", "date", "date_time", "decimal", "enum", "floating", "inferred", "integer", "json", "many_to_many", "point", "replace", "string", "time", "to_many", "to_one", "vector"]
