"""The write operations, nested writes included, over a transaction.

Sets of rows change by DataFrame: affected keys are found first and kept, then only the files that hold them are
rewritten. A record with nested writes is a short program of such steps, in a fixed order of the kinds: those that read
(disconnect, delete, update, upsert, connect_or_create), those without bound (set, update_many, delete_many), then those
that add (connect, create, create_many). Every unique key, foreign key and referential action is checked or applied.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ForeignKeyError, NestedWriteError, NotFoundError, NotNullError, UniqueConstraintError, UnsupportedError, ValidationError
from ..operators.predicates import all_of, literal, spelled
from ..schema import NUMERIC, Field, Model, Registry, Relation
from ..sources.store import Transaction
from .read import Reader

#: Fixed value: the kinds of nested writes, in the order in which they are done.
ORDER = ("disconnect", "delete", "update", "upsert", "connect_or_create", "set", "update_many", "delete_many", "connect", "create", "create_many")
UNDER_CREATE = ("create", "create_many", "connect", "connect_or_create", "upsert")
_B32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _listed(x: Any) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def generated(kind: str) -> Any:
    if kind == "uuid":
        return str(uuid.uuid4())
    if kind in ("now", "updated_at"):
        return datetime.now(timezone.utc).replace(tzinfo=None)
    if kind == "ulid":
        n = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10))
        return "".join(_B32[(n >> (5 * k)) & 31] for k in range(25, -1, -1))
    if kind == "nanoid":
        return "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-"[b & 63] for b in os.urandom(21))
    return "c" + uuid.uuid4().hex[:24]


def generated_column(kind: str) -> Column:
    """As generated, anew for each row."""
    if kind in ("now", "updated_at"):
        return F.lit(generated(kind))
    digits = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    if kind == "uuid":
        return F.uuid()
    if kind == "ulid":  # the time, then 64 random bits, whose digits are among those of the encoding
        return F.concat(F.lit(generated("ulid")[:10]), F.upper(F.substring(digits, 17, 16)))
    if kind == "nanoid":
        return F.translate(F.substring(F.base64(F.unhex(digits)), 1, 21), "+/", "_-")
    return F.concat(F.lit("c"), F.substring(digits, 1, 24))


class Writer(Reader):
    def __init__(self, registry: Registry, tx: Transaction, omit: dict | None = None):
        super().__init__(registry, tx, omit)
        self.tx = tx

    # rows

    def to_fields(self, df: DataFrame, model: Model) -> DataFrame:
        """Stored columns under field names; columns that the model doesn't have stay."""
        names = {model.column(f): f for f in model.fields}
        return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))

    def to_columns(self, df: DataFrame, model: Model) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(model.column(c) if c in model.fields else c) for c in df.columns))

    def _keys(self, df: DataFrame, model: Model) -> DataFrame:
        if not model.key:
            raise UnsupportedError(f"{model.name} has no primary key, so its rows can't be changed one by one")
        return self.tx.temporary(df.select(*(F.col(f"`{k}`").alias(f"__w{i}") for i, k in enumerate(model.key))).distinct())

    def _change(self, model: Model, keys: DataFrame, assign: dict[str, Column] | None) -> None:
        """Rows with these primary keys get the assignments, or go; only the files that hold them are written anew."""
        on = all_of([F.col(f"`{k}`") == F.col(f"__w{i}") for i, k in enumerate(model.key)])
        names = self._files(self.to_fields(self.tx.with_files(model.table), model), keys, on)
        if not names:
            return
        old = self.to_fields(self.tx.files_of(model.table, names), model)
        if assign is None:
            new = old.join(keys, on, "left_anti")
        else:
            hit = F.col("__hit").isNotNull()
            new = old.join(keys.withColumn("__hit", F.lit(True)), on, "left").select(*(F.when(hit, assign[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in assign else F.col(f"`{c}`") for c in old.columns))
        self.tx.replace_files(model.table, names, self.to_columns(new, model))

    def _files(self, held: DataFrame, keys: DataFrame, on: Column) -> set[str]:
        """Names of the files whose rows (of with_files) keys has: as many as are to be written anew."""
        return {r["__file"] for r in held.join(keys, on, "left_semi").select("__file").distinct().collect()}

    def _drop_links(self, table: str, gone: DataFrame, on: Column) -> None:
        """Rows of a junction that gone has go; only the files that hold them are written anew."""
        names = self._files(self.tx.with_files(table), gone, on)
        if names:
            self.tx.replace_files(table, names, self.tx.files_of(table, names).join(gone, on, "left_anti"))

    def _check_unique(self, model: Model, only: set[str] | None = None) -> None:
        """Each unique key (that has a field in `only`) holds once. Nulls don't count."""
        for name, fields in model.unique_keys().items():
            if only is not None and not only & set(fields):
                continue
            df = self.scan(model).where(all_of([F.col(f"`{f}`").isNotNull() for f in fields]))
            if not df.groupBy(*(F.col(f"`{f}`") for f in fields)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
                raise UniqueConstraintError(f"{model.name}.{name} would not be unique", model=model.name, fields=fields)

    def _check_new_unique(self, model: Model, rows: DataFrame) -> None:
        """As above for rows about to be added: they are compared among themselves and with the stored ones that match."""
        for name, fields in model.unique_keys().items():
            new = rows.where(all_of([F.col(f"`{f}`").isNotNull() for f in fields]))
            twice = new.groupBy(*(F.col(f"`{f}`") for f in fields)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
            if not twice.isEmpty() or not self._stored(model, new, fields).isEmpty():
                raise UniqueConstraintError(f"{model.name}.{name} would not be unique", model=model.name, fields=fields)

    def _stored(self, model: Model, rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        other = rows.select(*(F.col(f"`{f}`").alias(f"__u{i}") for i, f in enumerate(fields)))
        return self.scan(model).join(other, all_of([F.col(f"`{f}`") == F.col(f"__u{i}") for i, f in enumerate(fields)]), "left_semi")

    def _check_references(self, model: Model, rows: DataFrame, only: set[str] | None = None) -> None:
        for name, rel in model.relations.items():
            if rel.holds and (only is None or only & set(rel.fields)):
                target = self.registry[rel.target]
                parents = self.scan(target).select(*(F.col(f"`{r}`").alias(f"__p{i}") for i, r in enumerate(rel.references)))
                held = rows.where(all_of([F.col(f"`{f}`").isNotNull() for f in rel.fields]))
                if not held.join(parents, all_of([F.col(f"`{f}`") == F.col(f"__p{i}") for i, f in enumerate(rel.fields)]), "left_anti").isEmpty():
                    raise ForeignKeyError(f"{model.name}.{name} refers to a {rel.target} that doesn't exist", model=model.name, relation=name)

    def _referrers(self, model: Model) -> list[tuple[Model, str, Relation]]:
        return [(m, k, r) for m in self.registry.models.values() for k, r in m.relations.items() if r.target == model.name and r.holds]

    def _remove(self, model: Model, rows: DataFrame) -> None:
        """Deletes rows, after what their referrers' actions ask for; links of many-to-many relations go along."""
        rows = self.tx.temporary(rows)
        keys = self._keys(rows, model)
        for child, name, rel in self._referrers(model):
            parents = rows.select(*(F.col(f"`{r}`").alias(f"__p{i}") for i, r in enumerate(rel.references)))
            children = self.scan(child).join(parents, all_of([F.col(f"`{f}`") == F.col(f"__p{i}") for i, f in enumerate(rel.fields)]), "left_semi")
            if child is model:
                own = keys.select(*(F.col(f"__w{i}").alias(f"__x{i}") for i in range(len(model.key))))
                children = children.join(own, all_of([F.col(f"`{k}`") == F.col(f"__x{i}") for i, k in enumerate(model.key)]), "left_anti")
            if children.isEmpty():
                continue
            if rel.on_delete == "cascade":
                self._remove(child, children)
            elif rel.on_delete == "set_null":
                self._change(child, self._keys(children, child), {f: F.lit(None).cast(child.fields[f].spark_type()) for f in rel.fields})
            else:
                raise ForeignKeyError(f"{child.name}.{name} still refers to {model.name}", model=child.name, relation=name)
        for name, rel in model.relations.items():
            if rel.kind == "m2m" and (j := self.registry.junction(model, name)).table in self.tx.tables:
                self._drop_links(j.table, rows.select(F.col(f"`{model.key[0]}`").alias("__g")), F.col(f"`{j.source}`") == F.col("__g"))
        self._change(model, keys, None)

    # values

    def _row(self, model: Model, data: dict, next_ids: dict[str, int] | None = None) -> dict:
        """A complete row of a create payload: defaults and generated values filled in, required ones checked."""
        if unknown := set(data) - set(model.fields):
            raise ValidationError(f"{model.name} has no field {', '.join(sorted(unknown))}")
        row = {}
        for name, f in model.fields.items():
            if name in data:
                v = data[name]
            elif f.generate == "increment":
                v = self._next_id(model, name, next_ids)
            elif f.generate:
                v = generated(f.generate)
            elif f.has_default:
                v = f.default() if callable(f.default) else f.default
            elif f.nullable or f.array:
                v = [] if f.array and not f.nullable else None
            else:
                raise NotNullError(f"{model.name}.{name} is required", model=model.name, field=name)
            if v is None and not f.nullable:
                raise NotNullError(f"{model.name}.{name} can't be null", model=model.name, field=name)
            if f.generate == "increment" and v == 0:
                raise ValidationError(f"{model.name}.{name} counts up from 1, so it can't be zero")
            if f.check and v is not None and not f.check(v):
                raise ValidationError(f"{v!r} isn't a valid {model.name}.{name}")
            row[name] = v
        return row

    def _next_id(self, model: Model, name: str, next_ids: dict[str, int] | None) -> int:
        next_ids = next_ids if next_ids is not None else {}
        if name not in next_ids:
            next_ids[name] = self.scan(model).agg(F.max(f"`{name}`")).first()[0] or 0
        next_ids[name] += 1
        return next_ids[name]

    def _stored_value(self, f: Field, v: Any) -> Any:
        if v is None:
            return None
        if f.array:
            return [self._stored_value(Field(f.kind, values=f.values, scale=f.scale, precision=f.precision), x) for x in v]
        if f.kind == "enum" and v not in f.values:
            raise ValidationError(f"{v!r} isn't one of {', '.join(f.values)}")
        if f.kind == "decimal":
            return Decimal(str(v))
        if f.kind == "float":
            return float(v)
        if f.kind == "vector":
            if f.dimension and len(v) != f.dimension:
                raise ValidationError(f"a vector of {f.dimension} numbers is needed")
            return [float(x) for x in v]
        if f.kind == "point":
            return (float(v["x"]), float(v["y"]))
        if f.kind == "json":
            import json as _json

            from ..operators.predicates import DB_NULL, JSON_NULL

            return None if v is DB_NULL else "null" if v is JSON_NULL else v if isinstance(v, str) and v[:1] in '{["' else _json.dumps(v, sort_keys=True, separators=(",", ":"))
        return v

    def _frame(self, model: Model, rows: list[dict]) -> DataFrame:
        data = [tuple(self._stored_value(f, r[k]) for k, f in model.fields.items()) for r in rows]
        return self.tx.spark.createDataFrame(data, model.schema())

    def _payload(self, model: Model, data: DataFrame) -> DataFrame:
        """Complete rows of a DataFrame payload, checked like single ones: missing columns get their defaults or generated
        values as columns, and one aggregate finds what may not be."""
        if unknown := set(data.columns) - set(model.fields):
            raise ValidationError(f"{model.name} has no field {', '.join(sorted(unknown))}")
        columns, faults, counted = [], {}, None
        for name, f in model.fields.items():
            if name in data.columns:
                c = F.col(f"`{name}`")
            elif f.generate == "increment":
                c, counted = F.lit(None), name
            elif f.generate:
                c = generated_column(f.generate)
            elif f.has_default:
                c = F.udf(f.default, f.spark_type()).asNondeterministic()() if callable(f.default) else self._literal(f, f.default)
            elif f.nullable or f.array:
                c = F.array() if f.array and not f.nullable else F.lit(None)
            else:
                raise NotNullError(f"{model.name}.{name} is required", model=model.name, field=name)
            columns.append(c.cast(f.spark_type()).alias(name))
            value = F.col(f"`{name}`")
            if not f.nullable and name != counted:
                faults[name, NotNullError, "can't be null"] = value.isNull()
            if f.generate == "increment" and name != counted:
                faults[name, ValidationError, "counts up from 1, so it can't be zero"] = value == 0
            if f.kind == "enum":
                bad = lambda x, f=f: ~x.isin(*f.values)
                faults[name, ValidationError, f"must be one of {', '.join(f.values)}"] = F.exists(value, lambda x: bad(x)) if f.array else bad(value)
            if f.kind == "vector" and f.dimension:
                faults[name, ValidationError, f"must have {f.dimension} numbers"] = F.size(value) != f.dimension
            if f.check:
                faults[name, ValidationError, "isn't valid"] = value.isNotNull() & ~F.udf(lambda v, check=f.check: bool(check(v)), "boolean")(value)
        rows = self.tx.temporary(data.select(*columns))
        if faults:
            found = rows.agg(*(F.coalesce(F.max(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)).alias(f"f{k}") for k, c in enumerate(faults.values()))).first()
            for k, (name, error, text) in enumerate(faults):
                if found[k]:
                    raise error(f"{model.name}.{name} {text}", model=model.name, field=name)
        return self._counted_up(model, rows, counted) if counted else rows

    def _counted_up(self, model: Model, rows: DataFrame, name: str) -> DataFrame:
        """rows with the next numbers in the field, in the order of the files: a count for each task comes to the driver."""
        place, part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.spark_partition_id()
        first = self.scan(model).agg(F.max(f"`{name}`")).first()[0] or 0
        starts, total = [], first + 1
        for r in sorted(rows.groupBy(part.alias("p")).count().collect()):
            starts.append((r["p"], total))
            total += r["count"]
        if not starts:
            return rows
        start = F.element_at(F.map_from_arrays(F.array(*(F.lit(p) for p, _ in starts)), F.array(*(F.lit(n) for _, n in starts))), F.col("__part"))
        numbered = rows.withColumn("__part", part).withColumn("__place", place)
        return self.tx.temporary(numbered.withColumn(name, (start + F.col("__place")).cast(model.fields[name].spark_type())).select(*rows.columns))

    def _insert(self, model: Model, rows: DataFrame) -> None:
        self._check_new_unique(model, rows)
        self._check_references(model, rows)
        self.tx.append(model.table, self.to_columns(rows, model))

    def assignments(self, model: Model, data: dict) -> dict[str, Column]:
        """Update payload to columns: set, increment, decrement, multiply, divide, push, unshift, or a plain value."""
        out: dict[str, Column] = {}
        for name, v in data.items():
            f = model.fields.get(name)
            if f is None:
                raise ValidationError(f"{model.name} has no field {name}")
            c = F.col(f"`{name}`")
            ops = v if isinstance(v, dict) and f.kind not in ("json", "point") or isinstance(v, dict) and set(v) == {"set"} else {"set": v}
            op = next((o for o in ("set", "increment", "decrement", "multiply", "divide", "push", "unshift") if o in ops), None)
            if op is None or set(ops) - {"set", "increment", "decrement", "multiply", "divide", "push", "unshift"}:
                raise ValidationError(f"{ops!r} isn't an update of {name}")
            x = ops[op]
            if name in model.key and isinstance(v, dict):
                self._check_key_update(model, name, ops)
            if op == "set":
                if x is None and not f.nullable:
                    raise NotNullError(f"{model.name}.{name} can't be null", model=model.name, field=name)
                out[name] = self._literal(f, x)
            elif op in ("push", "unshift"):
                if not f.array:
                    raise ValidationError(f"{name} isn't a list")
                old, new = F.coalesce(c, F.array().cast(f.spark_type())), literal(f, _listed(x))
                out[name] = F.concat(old, new) if op == "push" else F.concat(new, old)
            else:
                if f.kind not in NUMERIC or f.array:
                    raise ValidationError(f"{name} isn't a number")
                if op == "divide" and not float(x):
                    raise ValidationError("division by zero")
                y = literal(f, x)
                if op == "divide" and f.kind in ("int", "big_int"):
                    out[name] = F.call_function("div", c, y).cast(f.spark_type())  # toward zero
                else:
                    out[name] = {"increment": c + y, "decrement": c - y, "multiply": c * y, "divide": c / y}[op].cast(f.spark_type())
        for name, f in model.fields.items():
            if f.generate == "updated_at" and name not in out:
                out[name] = self._literal(f, generated("now"))
        return out

    def _check_key_update(self, model: Model, name: str, ops: dict) -> None:
        """A key field takes one operation, arithmetic on whole numbers alone, and finite operands."""
        f = model.fields[name]
        if len(ops) != 1:
            raise ValidationError(f"{model.name}.{name} is a key and takes one operation")
        ((op, x),) = ops.items()
        if op != "set" and f.kind in ("float", "decimal"):
            raise ValidationError(f"{model.name}.{name} is a key of kind {f.kind}, which takes set alone")
        if isinstance(x, float) and not math.isfinite(x):
            raise ValidationError(f"{x!r} can't change the key {model.name}.{name}")

    def _literal(self, f: Field, v: Any) -> Column:
        if isinstance(v, Column) or v is None or f.kind != "json":
            return literal(f, v)
        return F.lit(self._stored_value(f, v)).cast("string")

    # sets of rows

    def _result(self, model: Model, rows: DataFrame | None, n: int, args: dict) -> DataFrame:
        """The rows if a projection was asked for, else their number."""
        if args.get("select") or args.get("omit"):
            if args.get("select") and set(args["select"]) - set(model.fields):
                raise ValidationError("bulk writes return fields only")
            fields = self.wanted(model, args)[0]
            return rows.select(*(F.col(f"`{k}`") for k in fields))
        return self.tx.spark.createDataFrame([(n,)], "count long")

    def create_many(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("data", "skip_duplicates", "select", "omit"))
        data, ids = args.get("data") or [], {}
        if isinstance(data, DataFrame):
            rows = self._payload(model, data)
        else:
            rows = self._frame(model, [self._row(model, spelled(d), ids) for d in data])
        if args.get("skip_duplicates"):
            order = self.fresh("i")
            rows = self.tx.temporary(rows.withColumn(order, F.monotonically_increasing_id()))
            for fields in model.unique_keys().values():
                some = all_of([F.col(f"`{f}`").isNotNull() for f in fields])
                stored = self._stored(model, rows.where(some), fields).select(*(F.col(f"`{f}`").alias(f"__s{i}") for i, f in enumerate(fields)))
                rows = rows.join(stored, all_of([F.col(f"`{f}`") == F.col(f"__s{i}") for i, f in enumerate(fields)]), "left_anti")
                first = rows.where(some).groupBy(*(F.col(f"`{f}`").alias(f"__s{i}") for i, f in enumerate(fields))).agg(F.min(order).alias("__first")).select("__first")
                rows = self.tx.temporary(rows.join(first, F.col(order) == F.col("__first"), "left_semi").unionByName(rows.where(~some)))
            rows = rows.drop(order)
        n = rows.count()
        if n:
            self._insert(model, rows)
        return self._result(model, rows, n, args)

    def _limited(self, model: Model, args: dict) -> DataFrame:
        df = self.filtered(self.scan(model), model, args.get("where"))
        if args.get("limit") is not None:
            if args["limit"] < 0:
                raise ValidationError("limit can't be negative")
            df = df.orderBy(*(F.col(f"`{k}`") for k in model.key)).limit(args["limit"])
        return df

    def update_many(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("where", "data", "limit", "select", "omit"))
        if set(args.get("data") or {}) & set(model.relations):
            raise ValidationError("update_many takes fields only")
        keys = self._keys(self._limited(model, args), model)
        n = keys.count()
        rows = self._update_rows(model, keys, args.get("data") or {}) if n else self.scan(model).limit(0)
        return self._result(model, rows, n, args)

    def _update_rows(self, model: Model, keys: DataFrame, data: dict) -> DataFrame:
        assign = self.assignments(model, data)
        moved = set(assign) & {f for _, _, r in self._referrers(model) for f in r.references}
        if moved:
            old = self.tx.temporary(self.scan(model).join(keys, all_of([F.col(f"`{k}`") == F.col(f"__w{i}") for i, k in enumerate(model.key)]), "left_semi"))
            for child, name, rel in self._referrers(model):
                if moved & set(rel.references):
                    parents = old.select(*(F.col(f"`{r}`").alias(f"__p{i}") for i, r in enumerate(rel.references)))
                    if not self.scan(child).join(parents, all_of([F.col(f"`{f}`") == F.col(f"__p{i}") for i, f in enumerate(rel.fields)]), "left_semi").isEmpty():
                        if rel.on_update != "cascade":
                            raise ForeignKeyError(f"{child.name}.{name} refers to the key that would change")
                        new = old.select(*(F.col(f"`{r}`").alias(f"__p{i}") for i, r in enumerate(rel.references)), *(assign.get(r, F.col(f"`{r}`")).alias(f"__q{i}") for i, r in enumerate(rel.references)))
                        on = all_of([F.col(f"`{f}`") == F.col(f"__p{i}") for i, f in enumerate(rel.fields)])
                        names = self._files(self.to_fields(self.tx.with_files(child.table), child), new, on)
                        kids = self.to_fields(self.tx.files_of(child.table, names), child)
                        joined = kids.join(new, on, "left")
                        for i, f in enumerate(rel.fields):
                            joined = joined.withColumn(f, F.when(F.col(f"__p{i}").isNotNull(), F.col(f"__q{i}")).otherwise(F.col(f"`{f}`")))
                        self.tx.replace_files(child.table, names, self.to_columns(joined.select(*kids.columns), child))
        self._change(model, keys, assign)
        if set(assign) & {f for fs in model.unique_keys().values() for f in fs}:
            self._check_unique(model, set(assign))
        same = keys
        if set(assign) & set(model.key):
            names = list(keys.columns)
            same = self.tx.temporary(keys.select(*(F.col(c).alias(model.key[i]) for i, c in enumerate(names))).withColumns({k: v for k, v in assign.items() if k in model.key}).select(*(F.col(f"`{k}`").alias(c) for k, c in zip(model.key, names, strict=True))))
        rows = self.scan(model).join(same, all_of([F.col(f"`{k}`") == F.col(f"__w{i}") for i, k in enumerate(model.key)]), "left_semi")
        self._check_references(model, rows, set(assign))
        return rows

    def put(self, model: Model, rows: DataFrame, changed: set[str]) -> int:
        """Puts these rows in the place of those with the same primary keys; changed: the fields that may differ."""
        n = rows.count()
        if not n:
            return 0
        keys = self._keys(rows, model)
        self._check_references(model, rows, changed)
        self._change(model, keys, None)
        self.tx.append(model.table, self.to_columns(rows, model))
        if changed & {f for fs in model.unique_keys().values() for f in fs}:
            self._check_unique(model, changed)
        for child, name, rel in self._referrers(model):
            if changed & set(rel.references):
                self._check_references(child, self.scan(child), set(rel.fields))
        return n

    def delete_many(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("where", "limit", "select", "omit"))
        rows = self.tx.temporary(self._limited(model, args))
        n = rows.count()
        if n:
            self._remove(model, rows)
        return self._result(model, rows, n, args)

    # single records

    def _locate(self, model: Model, where: dict) -> dict | None:
        rows = self.unique_filtered(self.scan(model), model, where).take(2)
        return rows[0].asDict(recursive=True) if rows else None

    def _required_row(self, model: Model, where: dict) -> dict:
        row = self._locate(model, where)
        if row is None:
            raise NotFoundError(f"no {model.name} matches")
        return row

    def _of(self, model: Model, row: dict) -> dict:
        """A unique where of this row."""
        return {model.key[0]: row[model.key[0]]} if len(model.key) == 1 else {"_".join(model.key): {k: row[k] for k in model.key}}

    def _one_key(self, model: Model, row: dict) -> DataFrame:
        schema = ", ".join(f"__w{i} {model.fields[k].spark_type().simpleString()}" for i, k in enumerate(model.key))
        return self.tx.spark.createDataFrame([tuple(row[k] for k in model.key)], schema)

    def _shown(self, model: Model, row: dict, args: dict) -> DataFrame:
        """The record as the payload's projection asks; kept as a file, as the transaction ends after this."""
        df = self.find_unique(model.name, where=self._of(model, row), **{k: args[k] for k in ("select", "include", "omit") if k in args})
        return self.tx.temporary(df)

    def create(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("data", "select", "include", "omit"))
        return self._shown(model, self._create(model, args.get("data") or {}), args)

    def update(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("where", "data", "select", "include", "omit"))
        row = self._required_row(model, args.get("where") or {})
        return self._shown(model, self._update(model, row, args.get("data") or {}), args)

    def upsert(self, model_name: str, **args: Any) -> DataFrame:
        """Creates if nothing matches `where`; else updates, unless target_where or set_where doesn't hold for the row,
        which then stays as it is."""
        model, args = self.checked(model_name, args, ("where", "create", "update", "target_where", "set_where", "select", "include", "omit"))
        row = self._locate(model, args.get("where") or {})
        if row is None:
            row = self._create(model, args.get("create") or {})
        elif all(not self.filtered(self.unique_filtered(self.scan(model), model, self._of(model, row)), model, args[k]).isEmpty() for k in ("target_where", "set_where") if k in args):
            row = self._update(model, row, args.get("update") or {})
        return self._shown(model, row, args)

    def delete(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("where", "select", "include", "omit"))
        row = self._required_row(model, args.get("where") or {})
        shown = self._shown(model, row, args)
        self._remove(model, self.unique_filtered(self.scan(model), model, self._of(model, row)))
        return shown

    def _split(self, model: Model, data: dict, under: tuple[str, ...]) -> tuple[dict, dict[str, dict]]:
        if unknown := set(data) - set(model.shape):
            raise ValidationError(f"{model.name} has no {', '.join(sorted(unknown))}")
        nested = {k: spelled(v) for k, v in data.items() if k in model.relations}
        for name, ops in nested.items():
            if bad := set(ops) - set(under):
                raise ValidationError(f"{model.name}.{name} takes no {', '.join(sorted(bad))} here")
            if model.relations[name].kind == "one" and set(ops) & {"create_many", "set", "update_many", "delete_many"}:
                raise ValidationError(f"{name} is to one record")
            if model.relations[name].kind == "one" and under is UNDER_CREATE and "upsert" in ops:
                raise ValidationError(f"{name} takes no upsert under create: there is no record yet that could have it")
            if model.relations[name].kind == "one" and len(ops) > 1:
                raise NestedWriteError(f"{name} takes one write at a time")
        return {k: v for k, v in data.items() if k in model.fields}, nested

    def _create(self, model: Model, data: dict) -> dict:
        scalars, nested = self._split(model, data, UNDER_CREATE)
        for name, ops in nested.items():
            rel = model.relations[name]
            if rel.holds:
                if set(rel.fields) & set(scalars):
                    raise ValidationError(f"{name} and its fields can't both be given")
                scalars |= self._held(model, name, ops)
        row = self._row(model, scalars)
        self._insert(model, self._frame(model, [row]))
        for name, ops in nested.items():
            if not model.relations[name].holds:
                self._children(model, row, name, ops, fresh=True)
        return row

    def _held(self, model: Model, name: str, ops: dict) -> dict:
        """Foreign key values for a to-one relation that this side holds, after making or finding the target."""
        rel = model.relations[name]
        target = self.registry[rel.target]
        ((op, v),) = ops.items()
        if op == "create":
            found = self._create(target, v)
        elif op == "connect":
            found = self._required_row(target, v)
        elif op == "connect_or_create":
            found = self._locate(target, v["where"]) or self._create(target, v["create"])
        else:
            raise ValidationError(f"{name} takes no {op} here")
        return {f: found[r] for f, r in zip(rel.fields, rel.references, strict=True)}

    def _update(self, model: Model, row: dict, data: dict) -> dict:
        scalars, nested = self._split(model, data, ORDER)
        for name, ops in nested.items():
            if model.relations[name].holds:
                scalars |= self._update_held(model, row, name, ops)
        if scalars:
            new = self._update_rows(model, self._one_key(model, row), scalars).take(1)
            row = new[0].asDict(recursive=True)
        for name, ops in nested.items():
            if not model.relations[name].holds:
                self._children(model, row, name, ops)
        return row

    def _parent_of(self, model: Model, row: dict, name: str) -> dict | None:
        rel = model.relations[name]
        if any(row[f] is None for f in rel.fields):
            return None
        target = self.registry[rel.target]
        got = self.scan(target).where(all_of([F.col(f"`{r}`") == literal(target.fields[r], row[f]) for f, r in zip(rel.fields, rel.references, strict=True)])).take(1)
        return got[0].asDict(recursive=True) if got else None

    def _update_held(self, model: Model, row: dict, name: str, ops: dict) -> dict:
        rel = model.relations[name]
        target = self.registry[rel.target]
        ((op, v),) = ops.items()
        if op in ("create", "connect", "connect_or_create"):
            return self._held(model, name, ops)
        now = self._parent_of(model, row, name)
        if op in ("disconnect", "delete"):
            if v is False:
                return {}
            if not all(model.fields[f].nullable for f in rel.fields):
                raise NestedWriteError(f"{model.name}.{name} is required")
            if op == "delete":
                if now is None:
                    raise NestedWriteError(f"{model.name}.{name} is empty")
                self._update_rows(model, self._one_key(model, row), {f: None for f in rel.fields})
                self._remove(target, self.unique_filtered(self.scan(target), target, self._of(target, now)))
            return {f: None for f in rel.fields}
        if op == "upsert" and now is None:
            made = self._create(target, v["create"])
            return {f: made[r] for f, r in zip(rel.fields, rel.references, strict=True)}
        if now is None:
            raise NestedWriteError(f"{model.name}.{name} is empty")
        self._update_one(target, now, v if op == "update" else {"data": v["update"], "where": v.get("where", {})})
        return {}

    def _update_one(self, target: Model, row: dict, v: dict) -> None:
        """A nested update: bare data, or data with a precondition."""
        wrapped = set(v) <= {"where", "data"} and "data" in v
        if wrapped and "data" in target.shape and set(v) == {"data"}:
            raise NestedWriteError(f"{target.name} has a field data, so the update must name where and data")
        if wrapped and v.get("where") and self.filtered(self.unique_filtered(self.scan(target), target, self._of(target, row)), target, v["where"]).isEmpty():
            raise NestedWriteError(f"the related {target.name} doesn't match where")
        self._update(target, row, v["data"] if wrapped else v)

    # records on the other side

    def _related(self, model: Model, row: dict, name: str) -> DataFrame:
        rel = model.relations[name]
        target = self.registry[rel.target]
        if rel.kind == "m2m":
            j = self.registry.junction(model, name)
            links = self.tx.load(j.table).where(F.col(f"`{j.source}`") == F.lit(row[model.key[0]])).select(F.col(f"`{j.target}`").alias("__l"))
            return self.scan(target).join(links, F.col(f"`{target.key[0]}`") == F.col("__l"), "left_semi")
        return self.scan(target).where(all_of([F.col(f"`{c}`") == literal(target.fields[c], row[p]) for p, c in self.registry.keys(model, name)]))

    def _link(self, model: Model, row: dict, name: str, child: dict) -> None:
        target = self.registry[model.relations[name].target]
        if model.relations[name].kind == "m2m":
            j = self.registry.junction(model, name)
            a, b = row[model.key[0]], child[target.key[0]]
            links = self.tx.load(j.table)
            if links.where((F.col(f"`{j.source}`") == F.lit(a)) & (F.col(f"`{j.target}`") == F.lit(b))).isEmpty():
                schema = f"`{j.source}` {model.fields[model.key[0]].spark_type().simpleString()}, `{j.target}` {target.fields[target.key[0]].spark_type().simpleString()}"
                self.tx.append(j.table, self.tx.spark.createDataFrame([(a, b)], schema))
        else:
            self._update_rows(target, self._one_key(target, child), {c: row[p] for p, c in self.registry.keys(model, name)})

    def _unlink(self, model: Model, row: dict, name: str, children: DataFrame) -> None:
        target = self.registry[model.relations[name].target]
        if model.relations[name].kind == "m2m":
            j = self.registry.junction(model, name)
            gone = self.tx.temporary(children.select(F.col(f"`{target.key[0]}`").alias("__g")))
            self._drop_links(j.table, gone, (F.col(f"`{j.source}`") == F.lit(row[model.key[0]])) & (F.col(f"`{j.target}`") == F.col("__g")))
            return
        fields = [c for _, c in self.registry.keys(model, name)]
        keys = self._keys(children, target)
        if keys.isEmpty():
            return
        if not all(target.fields[c].nullable for c in fields):
            raise NestedWriteError(f"{target.name} can't be without its {model.name}")
        self._update_rows(target, keys, {c: None for c in fields})

    def _check_own_writes(self, target: Model, name: str, ops: dict) -> None:
        """Writes side by side that depend on one another are refused: two that name the same record, and a condition on fields
        that another one sets."""
        named: dict[str, str] = {}
        sets: list[tuple[str, int, set[str]]] = []
        for op in ORDER:
            for k, x in enumerate(_listed(ops[op]) if op in ops else ()):
                if not isinstance(x, dict):
                    continue
                if op in ("update", "upsert", "update_many") and ("where" in x or op == "update_many"):
                    sets.append((op, k, set(x.get("data") or x.get("update") or {})))
                where = x.get("where") if op in ("update", "upsert", "connect_or_create") else x if op in ("disconnect", "delete", "set", "connect") else None
                if where and named.setdefault(repr(sorted(where.items(), key=str)), op) != op:
                    raise NestedWriteError(f"{name}: {op} and {named[repr(sorted(where.items(), key=str))]} name the same {target.name}")
        for op in ("update_many", "delete_many"):
            for k, x in enumerate(_listed(ops[op]) if op in ops else ()):
                asked = set((x.get("where") if op == "update_many" else x) or {})
                for other, j, fields in sets:
                    if (other, j) != (op, k) and asked & fields:
                        raise NestedWriteError(f"{name}: {op} asks for {', '.join(sorted(asked & fields))}, which {other} beside it sets")

    def _own(self, model: Model, row: dict, name: str, where: dict) -> dict:
        """The child that where names, which must belong to this record."""
        target = self.registry[model.relations[name].target]
        got = self.unique_filtered(self._related(model, row, name), target, where).take(1)
        if not got:
            raise NestedWriteError(f"no {target.name} of this {model.name} matches")
        return got[0].asDict(recursive=True)

    def _children(self, model: Model, row: dict, name: str, ops: dict, fresh: bool = False) -> None:
        """fresh: the record was made just now, so an upsert takes over the target that it finds, whoever had it."""
        rel = model.relations[name]
        target = self.registry[rel.target]
        single = rel.kind == "one"
        back = {} if rel.kind == "m2m" else {c: row[p] for p, c in self.registry.keys(model, name)}

        def current() -> dict | None:
            got = self._related(model, row, name).take(1)
            return got[0].asDict(recursive=True) if got else None

        def make(data: dict) -> None:
            if set(back) & set(data):
                raise ValidationError(f"{', '.join(back)} follow from the parent")
            child = self._create(target, {**data, **back})
            if rel.kind == "m2m":
                self._link(model, row, name, child)

        self._check_own_writes(target, name, ops)
        for op in ORDER:
            if op not in ops:
                continue
            v = ops[op]
            if op in ("disconnect", "delete") and single:
                if v is False:
                    continue
                if op == "disconnect":
                    self._unlink(model, row, name, self._related(model, row, name))
                else:
                    if current() is None:
                        raise NestedWriteError(f"{model.name}.{name} is empty")
                    self._remove(target, self._related(model, row, name))
            elif op in ("disconnect", "delete"):
                for w in _listed(v):
                    if op == "disconnect":
                        self._unlink(model, row, name, self.unique_filtered(self._related(model, row, name), target, w))
                    else:
                        self._remove(target, self.unique_filtered(self.scan(target), target, self._of(target, self._own(model, row, name, w))))
            elif op == "update":
                if single:
                    now = current()
                    if now is None:
                        raise NestedWriteError(f"{model.name}.{name} is empty")
                    self._update_one(target, now, v)
                else:
                    for x in _listed(v):
                        self._update(target, self._own(model, row, name, x["where"]), x["data"])
            elif op == "upsert":
                for x in _listed(v):
                    now = current() if single else self._locate(target, x["where"])
                    if now is None:
                        make(x["create"])
                    else:
                        if fresh:
                            self._link(model, row, name, now)
                        elif not single and self.unique_filtered(self._related(model, row, name), target, self._of(target, now)).isEmpty():
                            raise NestedWriteError(f"that {target.name} belongs to another {model.name}")
                        self._update(target, now, x["update"])
            elif op == "connect_or_create":
                for x in _listed(v):
                    now = self._locate(target, x["where"])
                    if now is None:
                        make(x["create"])
                    else:
                        self._link(model, row, name, now)
            elif op == "set":
                wanted = [self._required_row(target, w) for w in _listed(v)]
                keep = self._frame_keys(target, wanted)
                now = self._related(model, row, name)
                self._unlink(model, row, name, now.join(keep, all_of([F.col(f"`{k}`") == F.col(f"__w{i}") for i, k in enumerate(target.key)]), "left_anti"))
                for child in wanted:
                    self._link(model, row, name, child)
            elif op == "update_many":
                for x in _listed(v):
                    keys = self._keys(self.filtered(self._related(model, row, name), target, x.get("where")), target)
                    if not keys.isEmpty():
                        self._update_rows(target, keys, x["data"])
            elif op == "delete_many":
                for w in _listed(v):
                    rows = self.filtered(self._related(model, row, name), target, w)
                    if not rows.isEmpty():
                        self._remove(target, rows)
            elif op == "connect":
                for w in _listed(v):
                    child = self._required_row(target, w)
                    if single:
                        self._unlink(model, row, name, self._related(model, row, name))
                    self._link(model, row, name, child)
            elif op == "create":
                for x in _listed(v):
                    make(x)
            elif op == "create_many":
                v = spelled(v)
                ids: dict[str, int] = {}
                rows = [self._row(target, {**spelled(d), **back}, ids) for d in v["data"]]
                self.create_many(target.name, data=rows, skip_duplicates=v.get("skip_duplicates", False))
                if rel.kind == "m2m":
                    for d in rows:
                        self._link(model, row, name, self._kept(target, d))

    def _kept(self, model: Model, row: dict) -> dict:
        """The stored record of a row of create_many: itself, or the one in whose favour it was skipped."""
        for name, fields in model.unique_keys().items():
            if all(row[f] is not None for f in fields):
                found = self._locate(model, {name: row[fields[0]]} if name in model.fields else {name: {f: row[f] for f in fields}})
                if found:
                    return found
        raise NotFoundError(f"no {model.name} matches")

    def _frame_keys(self, model: Model, rows: list[dict]) -> DataFrame:
        schema = ", ".join(f"__w{i} {model.fields[k].spark_type().simpleString()}" for i, k in enumerate(model.key))
        return self.tx.spark.createDataFrame([tuple(r[k] for k in model.key) for r in rows], schema)
