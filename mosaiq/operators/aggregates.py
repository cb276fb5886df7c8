"""count, aggregate, group_by and having."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError, ValidationError
from ..schema import NUMERIC, Field, Model
from .ordering import Key, direction
from .predicates import Operands, all_of, any_of, literal, scalar_filter, spelled

if TYPE_CHECKING:
    from ..plans.read import Reader

AGGREGATES = ("_count", "_avg", "_sum", "_min", "_max")
_HAVING_OPS = ("equals", "not", "in", "not_in", "lt", "lte", "gt", "gte")


class Aggregation:
    """A Reader mixes this in."""

    def aggregate_column(self: Reader, model: Model, kind: str, name: str) -> Column:
        if kind == "_count" and name == "_all":
            return F.count(F.lit(1))
        f = model.fields.get(name)
        if f is None:
            raise ValidationError(f"{model.name} has no field {name}")
        if kind in ("_avg", "_sum") and (f.kind not in NUMERIC or f.array):
            raise ValidationError(f"{kind} takes numbers, and {name} isn't one")
        if kind in ("_min", "_max") and f.kind in ("json", "vector", "point"):
            raise ValidationError(f"{kind} can't compare {name}")
        return {"_count": F.count, "_avg": F.avg, "_sum": F.sum, "_min": F.min, "_max": F.max}[kind](F.col(f"`{name}`"))

    def aggregate_structs(self: Reader, model: Model, args: dict) -> list[Column]:
        out = []
        for kind in AGGREGATES:
            spec = args.get(kind)
            if not spec:
                continue
            if spec is True:
                if kind != "_count":
                    raise ValidationError(f"{kind} takes fields")
                out.append(F.count(F.lit(1)).alias(kind))
            else:
                chosen = [k for k in ("_all", *model.fields) if spec.get(k) is True]
                if set(spec) - {"_all", *model.fields} or not chosen:
                    raise ValidationError(f"{kind} takes fields of {model.name}")
                out.append(F.struct(*(self.aggregate_column(model, kind, k).alias(k) for k in chosen)).alias(kind))
        return out

    def aggregate_input(self: Reader, model: Model, args: dict) -> DataFrame:
        """The rows that where, cursor, order, take and skip leave; aggregates see only these."""
        df = self.filtered(self.scan(model), model, args.get("where"))
        if not any(args.get(k) is not None for k in ("take", "skip", "cursor")):
            return df
        df, keys = self.order_keys(df, model, args.get("order_by"))
        return self.windowed(df, model, keys, args)[0]

    def count(self: Reader, model_name: str, **args: Any) -> DataFrame:
        """One row: count, or a count for each selected field (and _all)."""
        model, args = self.checked(model_name, args, ("where", "order_by", "cursor", "take", "skip", "select"))
        df, select = self.aggregate_input(model, args), args.get("select")
        if not select or select is True:
            return df.agg(F.count(F.lit(1)).alias("count"))
        if set(select) - {"_all", *model.fields}:
            raise ValidationError(f"count selects fields of {model.name} and _all")
        return df.agg(*(self.aggregate_column(model, "_count", k).alias(k) for k in ("_all", *model.fields) if select.get(k) is True))

    def exist(self: Reader, model_name: str, **args: Any) -> DataFrame:
        """One row: exists, of the rows that count would count. Reading stops at the first row found."""
        model, args = self.checked(model_name, args, ("where", "order_by", "cursor", "take", "skip"))
        return self.aggregate_input(model, args).limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))

    def aggregate(self: Reader, model_name: str, **args: Any) -> DataFrame:
        """One row with a struct for each aggregate asked for."""
        model, args = self.checked(model_name, args, ("where", "order_by", "cursor", "take", "skip", *AGGREGATES))
        chosen = self.aggregate_structs(model, args)
        if not chosen:
            raise ValidationError("aggregate needs one of " + ", ".join(AGGREGATES))
        return self.aggregate_input(model, args).agg(*chosen)

    def group_by(self: Reader, model_name: str, **args: Any) -> DataFrame:
        """A row for each group: its fields, then a struct for each aggregate."""
        model, args = self.checked(model_name, args, ("by", "where", "having", "order_by", "take", "skip", *AGGREGATES))
        by = [args["by"]] if isinstance(args.get("by"), str) else list(args.get("by") or ())
        if not by or any(f not in model.fields for f in by):
            raise ValidationError("by takes fields of the model")
        if clash := {k for k in AGGREGATES if k in by and args.get(k)}:
            raise ValidationError(f"{clash} would name both a field and an aggregate")
        hidden: dict[tuple[str, str], str] = {}

        def hold(kind: str, name: str) -> str:
            return hidden.setdefault((kind, name), self.fresh("h"))

        having = self._having(model, by, args.get("having") or {}, hold)
        keys = []
        for part in args["order_by"] if isinstance(args.get("order_by"), (list, tuple)) else [args["order_by"]] if args.get("order_by") else []:
            for name, spec in part.items():
                if name in AGGREGATES:
                    keys += [Key(hold(name, f), *direction(d)) for f, d in spec.items()]
                elif name in by:
                    keys.append(Key(name, *direction(spec)))
                else:
                    raise ValidationError(f"groups can't be ordered by {name}")
        chosen = self.aggregate_structs(model, args)
        more = [self.aggregate_column(model, kind, name).alias(alias) for (kind, name), alias in hidden.items()]
        df = self.filtered(self.scan(model), model, args.get("where"))
        grouped = df.groupBy(*(F.col(f"`{f}`") for f in by))
        df = grouped.agg(*chosen, *more) if chosen or more else df.select(*(F.col(f"`{f}`") for f in by)).distinct()
        if having is not None:
            df = df.where(having)
        take, skip = args.get("take"), args.get("skip")
        if (take is not None and take < 0) or (skip or 0) < 0:
            raise UnsupportedError("groups take no negative take or skip")
        if keys:
            df = df.orderBy(*(k.sort() for k in keys))
        if skip:
            df = df.offset(skip)
        if take is not None:
            df = df.limit(take)
        return df.drop(*hidden.values())

    def _having(self: Reader, model: Model, by: list[str], having: dict, hold: Any) -> Column | None:
        parts: list[Column] = []
        for key, spec in having.items():
            if key in ("AND", "OR", "NOT"):
                inner = [c for c in (self._having(model, by, x, hold) for x in (spec if isinstance(spec, (list, tuple)) else [spec])) if c is not None]
                parts.append(any_of(inner) if key == "OR" else all_of([~c for c in inner] if key == "NOT" else inner))
                continue
            if key not in model.fields:
                raise ValidationError(f"{model.name} has no field {key}")
            kinds = set(spec) & set(AGGREGATES) if isinstance(spec, dict) else set()
            for kind in sorted(kinds):
                parts.append(self._having_aggregate(model, kind, key, spec[kind], F.col(hold(kind, key))))
            rest = {k: v for k, v in spec.items() if k not in kinds} if isinstance(spec, dict) else spec
            if not kinds or rest:
                if key not in by:
                    raise ValidationError(f"having uses {key}, which isn't grouped by")
                parts.append(scalar_filter(model.fields[key], F.col(f"`{key}`"), rest, Operands(model, refs=False)))
        return all_of(parts) if parts else None

    def _having_aggregate(self: Reader, model: Model, kind: str, name: str, cond: Any, c: Column) -> Column:
        self.aggregate_column(model, kind, name)
        f = model.fields[name]
        f = Field("big_int") if kind == "_count" else Field("float") if kind == "_avg" and f.kind != "decimal" else f
        if kind == "_sum" and f.kind == "int":
            f = Field("big_int")
        cond = spelled(cond) if isinstance(cond, dict) else {"equals": cond}
        parts = []
        for op, v in cond.items():
            if op not in _HAVING_OPS:
                raise ValidationError(f"{op} isn't an operator of having")
            if op == "not" and isinstance(v, dict):
                parts.append(~self._having_aggregate(model, kind, name, v, c))
            elif op in ("equals", "not") and v is None:
                parts.append(c.isNull() if op == "equals" else c.isNotNull())
            elif op in ("in", "not_in"):
                found = c.isin(*(literal(f, x) for x in v)) if v else F.lit(False)
                parts.append(found if op == "in" else ~found)
            else:
                x = literal(f, v)
                parts.append({"equals": c == x, "not": c != x, "lt": c < x, "lte": c <= x, "gt": c > x, "gte": c >= x}[op])
        return all_of(parts)
