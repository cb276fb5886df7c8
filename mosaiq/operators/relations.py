"""Relation filters: semi and anti joins at the top of a condition, existence flags elsewhere.

A relation leaf becomes the parent-key values of its matching children. At a top-level AND it is a left semi or left anti
join; under OR or NOT the distinct keys carry a flag through a left join, which adds no rows. NULL keys never match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import Model
from .predicates import LONG_LIST, Operands, all_of, any_of, scalar_filter, spelled

if TYPE_CHECKING:
    from ..plans.read import Reader


@dataclass
class Exists:
    """True where the fields `on` are among the rows of keys (columns named as in `names`)."""

    keys: DataFrame
    on: list[str]
    names: list[str]
    positive: bool

    def condition(self) -> Column:
        return all_of([F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in zip(self.on, self.names, strict=True)])

    def joined(self, df: DataFrame) -> DataFrame:
        return df.join(self.keys, self.condition(), "left_semi" if self.positive else "left_anti")


class Filters:
    """The `where` compiler; a Reader mixes it in."""

    def filtered(self: Reader, df: DataFrame, model: Model, where: dict | None) -> DataFrame:
        """The rows of df, all columns, that satisfy where."""
        columns, joins = df.columns, []
        for key, value in (where or {}).items():
            if key == "AND":
                for part in value if isinstance(value, (list, tuple)) else [value]:
                    df = self.filtered(df, model, part)
            elif key in ("OR", "NOT"):
                df, c = self.condition(df, model, {key: value})
                df = df.where(c).select(*(F.col(f"`{x}`") for x in columns))
            elif key in model.relations:
                joins += self.relation_terms(model, key, value)
            else:
                df, value = self.listed(df, model, key, value)
                df = df.where(self.scalar(model, key, value))
        for term in joins:
            df = term.joined(df) if isinstance(term, Exists) else df.where(term)
        return df

    def listed(self: Reader, df: DataFrame, model: Model, key: str, value: Any) -> tuple[DataFrame, Any]:
        """A long list of `in` as a semi join with a table of its values; what else the condition asks remains."""
        f = model.fields.get(key)
        if f is None or not isinstance(value, dict) or f.array or f.kind == "json" or "mode" in value or not isinstance(value.get("in"), (list, tuple, set)) or len(value["in"]) < LONG_LIST:
            return df, value
        name = self.fresh("l")
        wanted = df.sparkSession.createDataFrame([(x,) for x in value["in"] if x is not None], "v " + ("string" if f.kind == "decimal" else f.spark_type().simpleString()))
        wanted = wanted.select(F.col("v").cast(f.spark_type()).alias(name)).distinct()
        return df.join(wanted, F.col(f"`{key}`") == F.col(name), "left_semi"), {k: v for k, v in value.items() if k != "in"}

    def scalar(self: Reader, model: Model, key: str, value: Any) -> Column:
        if key not in model.fields:
            raise ValidationError(f"{model.name} has no field or relation {key}")
        return scalar_filter(model.fields[key], F.col(f"`{key}`"), value, Operands(model))

    def condition(self: Reader, df: DataFrame, model: Model, where: dict) -> tuple[DataFrame, Column]:
        """df with the flags that the condition needs, and the condition."""
        parts: list[Column] = []
        for key, value in where.items():
            if key in ("AND", "OR", "NOT"):
                if key == "OR" and not isinstance(value, (list, tuple)):
                    raise ValidationError("OR takes a list")
                inner = []
                for part in value if isinstance(value, (list, tuple)) else [value]:
                    if key == "OR" and not part:
                        continue
                    df, c = self.condition(df, model, part)
                    inner.append(~c if key == "NOT" and part else c)
                parts.append(any_of(inner) if key == "OR" else all_of(inner))
            elif key in model.relations:
                for term in self.relation_terms(model, key, value):
                    if isinstance(term, Exists):
                        flag = self.fresh("e")
                        df = df.join(term.keys.distinct().withColumn(flag, F.lit(True)), term.condition(), "left").drop(*term.names)
                        found = F.coalesce(F.col(flag), F.lit(False))
                        parts.append(found if term.positive else ~found)
                    else:
                        parts.append(term)
            else:
                parts.append(self.scalar(model, key, value))
        return df, all_of(parts)

    def relation_terms(self: Reader, model: Model, name: str, cond: Any) -> list[Exists | Column]:
        rel = model.relations[name]
        if rel.kind == "one":
            if cond is None:
                cond = {"is": None}
            cond = spelled(cond)
            if not set(cond) & {"is", "is_not"}:
                cond = {"is": cond}
            if set(cond) - {"is", "is_not"}:
                raise ValidationError(f"{name} takes is and is_not, or a condition, not both")
        else:
            if not isinstance(cond, dict) or not set(cond) <= {"some", "every", "none"}:
                raise ValidationError(f"{name} takes some, every and none")
        out: list[Exists | Column] = []
        for op, where in cond.items():
            if op in ("is", "is_not") and where is None:
                if rel.holds:
                    missing = reduce(lambda a, b: a | b, [F.col(f"`{f}`").isNull() for f in rel.fields])
                    out.append(missing if op == "is" else ~missing)
                else:
                    out.append(self.matching(model, name, {}, op == "is_not"))
            elif op == "every":
                if where:
                    out.append(self.matching(model, name, where, False, violating=True))
            else:
                out.append(self.matching(model, name, where or {}, op in ("some", "is")))
        return out

    def matching(self: Reader, model: Model, name: str, where: dict, positive: bool, violating: bool = False) -> Exists:
        """Parents with a child that satisfies where, or, if violating, one for which it is false (unknown is no violation)."""
        child = self.registry[model.relations[name].target]
        df = self.scan(child)
        if violating:
            df, c = self.condition(df, child, where)
            df = df.where(~c)
        else:
            df = self.filtered(df, child, where)
        df, on, names = self.with_parent_keys(df, model, name)
        return Exists(df.select(*(F.col(n) for n in names)), on, names, positive)

    def with_parent_keys(self: Reader, df: DataFrame, model: Model, name: str) -> tuple[DataFrame, list[str], list[str]]:
        """Rows of the target with the parent's key values as fresh columns (once for each link), the parent's fields
        that they equal, and the fresh columns' names."""
        rel = model.relations[name]
        if rel.kind == "m2m":
            j, child = self.registry.junction(model, name), self.registry[rel.target]
            source, target = self.fresh("k"), self.fresh("k")
            links = self.source.load(j.table).select(F.col(f"`{j.source}`").alias(source), F.col(f"`{j.target}`").alias(target))
            return df.join(links, F.col(f"`{child.key[0]}`") == F.col(target)).drop(target), [model.key[0]], [source]
        pairs = self.registry.keys(model, name)
        names = [self.fresh("k") for _ in pairs]
        return df.select("*", *(F.col(f"`{c}`").alias(n) for (_, c), n in zip(pairs, names, strict=True))), [p for p, _ in pairs], names
