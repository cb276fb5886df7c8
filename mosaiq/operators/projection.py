"""select, include, omit, _count, distances and nested relations.

A to-one relation is a left join of a struct; a to-many relation is windowed for each parent, given its own relations,
then collected once by parent key, so each level of nesting costs one shuffle on the parent's key. Where the parents are
narrowed (by a condition or a window), a semi join first keeps only their children.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import Model
from .predicates import all_of, spelled

if TYPE_CHECKING:
    from ..plans.read import Reader

NARROWING = ("where", "take", "skip", "cursor", "distinct")
NODE_ARGS = ("where", "order_by", "take", "skip", "cursor", "distinct", "select", "include", "omit")


class Projection:
    """A Reader mixes this in."""

    def wanted(self: Reader, model: Model, args: dict) -> tuple[list[str], dict[str, Any], dict[str, dict], Any]:
        """Field names in the model's order, relations with their arguments, distances, and the _count request."""
        select, include, omit = args.get("select"), args.get("include"), args.get("omit")
        if select is not None and include is not None:
            raise ValidationError("a node takes select or include, not both")
        if select is not None and omit:
            raise ValidationError("a node takes select or omit, not both")
        asked = select if select is not None else include or {}
        if unknown := set(asked) - {*model.shape, "_count"}:
            raise ValidationError(f"{model.name} has no {', '.join(sorted(unknown))}")
        if include is not None and set(include) & set(model.fields):
            raise ValidationError("include takes relations")
        distances = {k: v["_distance"] for k, v in asked.items() if k in model.fields and isinstance(v, dict)}
        if len(distances) > 1 or any(not isinstance(v, dict) or "_distance" not in v for k, v in asked.items() if k in model.fields and v not in (True, False, None)):
            raise ValidationError("a select takes one distance, and fields as true or false")
        relations = {k: {} if v is True else spelled(v) for k, v in asked.items() if k in model.relations and v}
        if select is not None:
            fields = [k for k in model.visible() if select.get(k) is True]
            if not fields and not relations and not distances and not select.get("_count"):
                raise ValidationError("select is empty")
        else:
            hidden = {k for k, v in (omit or {}).items() if v} | {k for k in self.default_omit.get(model.name, ()) if (omit or {}).get(k) is not False}
            if unknown := hidden - set(model.fields):
                raise ValidationError(f"{model.name} has no {', '.join(sorted(unknown))}")
            fields = [k for k in model.visible() if k not in hidden]
            if not fields and not relations:
                raise ValidationError("omit leaves nothing")
        if distances and "_distance" in model.shape or asked.get("_count") and "_count" in model.shape:
            raise ValidationError("the model has a field of that name")
        return fields, relations, distances, asked.get("_count")

    def shaped(self: Reader, df: DataFrame, model: Model, args: dict, narrow: bool = False) -> tuple[DataFrame, list[Column]]:
        """df with the related values joined on, and the output columns. narrow: df has only some of the model's rows; the
        arguments may say so too."""
        narrow = narrow or any(args.get(k) for k in NARROWING)
        parents = df
        fields, relations, distances, count = self.wanted(model, args)
        out = [F.col(f"`{k}`") for k in fields]
        for name, sub in relations.items():
            if unknown := set(sub) - set(NODE_ARGS):
                raise ValidationError(f"{name} takes no {', '.join(sorted(unknown))}")
            df, c = self._one(df, model, name, sub, narrow) if model.relations[name].kind == "one" else self._many(df, model, name, sub, parents if narrow else None)
            out.append(c.alias(name))
        for name, d in distances.items():
            if model.fields[name].nullable:
                raise ValidationError(f"{name} may be null, so its distance can't be selected")
            out.append(self.distance(model, name, d).alias("_distance"))
        if count:
            many = {k for k, r in model.relations.items() if r.kind != "one"}
            asked = dict.fromkeys(sorted(many), True) if count is True else count.get("select", count)
            if not set(asked) <= many:
                raise ValidationError("_count takes to-many relations")
            columns = []
            for name, spec in asked.items():
                if spec:
                    col = self.fresh("n")
                    df = self.counted(df, model, name, spec.get("where") or {} if isinstance(spec, dict) else {}, col, narrow)
                    columns.append(F.col(col).alias(name))
            out.append(F.struct(*columns).alias("_count"))
        return df, out or [F.lit(1).alias("_row")]

    def _one(self: Reader, df: DataFrame, model: Model, name: str, args: dict, narrow: bool) -> tuple[DataFrame, Column]:
        child = self.registry[model.relations[name].target]
        cdf = self.filtered(self.scan(child), child, args.get("where"))
        deeper = any(child.relations[k].kind != "one" for k in {**(args.get("include") or {}), **(args.get("select") or {})} if k in child.relations)
        if narrow and deeper:  # the related record's own children are then looked up for these records alone
            linked, on, names = self.with_parent_keys(cdf, model, name)
            cdf = self.of_parents(linked, df, on, names).drop(*names)
        cdf, out = self.shaped(cdf, child, args, narrow and deeper)
        pairs, value = self.registry.keys(model, name), self.fresh("r")
        names = [self.fresh("k") for _ in pairs]
        cdf = cdf.select(*(F.col(f"`{c}`").alias(n) for (_, c), n in zip(pairs, names, strict=True)), *([F.col(f"`{k}`").alias(f"__t_{k}") for k in child.key] if not model.relations[name].holds else []), F.struct(*out).alias(value))
        if not model.relations[name].holds:  # the first by primary key, should the holder's side not be unique
            first = F.min_by(value, F.struct(*(F.col(f"__t_{k}") for k in child.key))) if child.key else F.first(value)
            cdf = cdf.groupBy(*names).agg(first.alias(value))
        on = all_of([F.col(f"`{p}`") == F.col(n) for (p, _), n in zip(pairs, names, strict=True)])
        return df.join(cdf, on, "left").drop(*names), F.col(value)

    def _many(self: Reader, df: DataFrame, model: Model, name: str, args: dict, parents: DataFrame | None) -> tuple[DataFrame, Column]:
        child = self.registry[model.relations[name].target]
        cdf = self.filtered(self.scan(child), child, args.get("where"))
        cdf, on, names = self.with_parent_keys(cdf, model, name)
        cdf = self.of_parents(cdf, parents, on, names) if parents is not None else cdf
        cdf, keys = self.order_keys(cdf, child, args.get("order_by"))
        cdf, _, _ = self.windowed(cdf, child, keys, args, parents=names)
        cdf, out = self.shaped(cdf, child, args, parents is not None)
        value = self.fresh("r")
        rows = F.array_sort(F.collect_list(F.struct(F.col("__rn").alias("rn"), F.struct(*out).alias("v"))))  # by rn, which is unique
        cdf = cdf.groupBy(*names).agg(F.transform(rows, lambda x: x["v"]).alias(value))
        kind = cdf.schema[value].dataType
        match = all_of([F.col(f"`{a}`") == F.col(n) for a, n in zip(on, names, strict=True)])
        return df.join(cdf, match, "left").drop(*names), F.coalesce(F.col(value), F.array().cast(kind))
