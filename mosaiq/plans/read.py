"""The read operations: each returns a DataFrame that hasn't run."""

from __future__ import annotations

from itertools import count as counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFoundError, ValidationError
from ..operators.aggregates import Aggregation
from ..operators.ordering import Ordering
from ..operators.predicates import Operands, all_of, literal, scalar_filter, spelled
from ..operators.projection import Projection
from ..operators.relations import Filters
from ..schema import Model, Registry
from ..sources import Source

FIND_ARGS = ("where", "order_by", "take", "skip", "cursor", "select", "include", "omit", "distinct")


class Reader(Filters, Ordering, Projection, Aggregation):
    """Compiles read arguments over a registry of models and a source of tables."""

    def __init__(self, registry: Registry, source: Source, omit: dict[str, Any] | None = None):
        self.registry, self.source = registry, source
        self.default_omit = {m: ([k for k, v in o.items() if v] if isinstance(o, dict) else list(o)) for m, o in (omit or {}).items()}
        self._numbers = counter()

    def fresh(self, prefix: str) -> str:
        return f"__{prefix}{next(self._numbers)}"

    def scan(self, model: Model) -> DataFrame:
        """The table with columns named as fields, in the declared types."""
        df = self.source.load(model.table)
        kinds, out = dict(df.dtypes), []
        for name, f in model.fields.items():
            c = F.col(f"`{model.column(name)}`")
            if f.kind == "decimal" and kinds[model.column(name)] != f.spark_type().simpleString():
                c = c.cast(f.spark_type())
            out.append(c.alias(name))
        return df.select(*out)

    def checked(self, model_name: str, args: dict, known: tuple[str, ...]) -> tuple[Model, dict]:
        args = {k: v for k, v in spelled(args).items() if v is not None}
        if unknown := set(args) - set(known):
            raise ValidationError(f"unknown arguments: {', '.join(sorted(unknown))}")
        return self.registry[model_name], args

    def unique_pairs(self, model: Model, where: dict, strict: bool = False) -> dict[str, Any]:
        """The fields and values of the unique keys that where names; strict: nothing else may be there."""
        keys, out = model.unique_keys(), {}
        for name, v in where.items():
            names = keys.get(name)
            if names is None:
                continue
            if len(names) == 1 and name in model.fields:
                if isinstance(v, dict):
                    continue
                out[name] = v
            else:
                if not isinstance(v, dict) or set(v) != set(names):
                    raise ValidationError(f"{name} takes all of {', '.join(names)}")
                out |= v
        if not out or any(v is None for v in out.values()):
            raise ValidationError(f"where must name a unique key of {model.name}: {', '.join(keys)}")
        if strict and set(where) - set(keys):
            raise ValidationError("only unique keys can be named here")
        return out

    def unique_filtered(self, df: DataFrame, model: Model, where: dict) -> DataFrame:
        """The rows of an extended unique where: the unique keys and any further conditions."""
        pairs = self.unique_pairs(model, where)
        df = df.where(all_of([F.col(f"`{f}`") == literal(model.fields[f], v) for f, v in pairs.items()]))
        compound = {k for k in model.unique_keys() if k not in model.fields}
        return self.filtered(df, model, {k: v for k, v in where.items() if k not in compound and k not in pairs})

    # operations

    def find_many(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, FIND_ARGS)
        df = self.filtered(self.scan(model), model, args.get("where"))
        df, keys = self.order_keys(df, model, args.get("order_by"))
        df, keys, sorted_ = self.windowed(df, model, keys, args)
        before = df
        df, out = self.shaped(df, model, args)
        if keys and not (sorted_ and df is before):
            df = df.orderBy(*(k.sort() for k in keys))
        return df.select(*out)

    def find_first(self, model_name: str, **args: Any) -> DataFrame:
        """At most one row; a negative take reads from the end, and take 0 finds nothing."""
        take = args.pop("take", None)
        return self.find_many(model_name, **args, take=1 if take is None else max(-1, min(1, take)))

    def find_unique(self, model_name: str, **args: Any) -> DataFrame:
        model, args = self.checked(model_name, args, ("where", "select", "include", "omit"))
        df = self.unique_filtered(self.scan(model), model, args.get("where") or {}).limit(1)
        df, out = self.shaped(df, model, args, narrow=True)
        return df.select(*out)

    def find_first_or_throw(self, model_name: str, **args: Any) -> DataFrame:
        return self._required(model_name, self.find_first(model_name, **args))

    def find_unique_or_throw(self, model_name: str, **args: Any) -> DataFrame:
        return self._required(model_name, self.find_unique(model_name, **args))

    def _required(self, model_name: str, df: DataFrame) -> DataFrame:
        """These two run: the row is fetched, and its absence is an error."""
        rows = df.take(1)
        if not rows:
            raise NotFoundError(f"no {model_name} matches")
        return df.sparkSession.createDataFrame(rows, df.schema)


__all__ = ["FIND_ARGS", "Operands", "Reader", "scalar_filter"]
