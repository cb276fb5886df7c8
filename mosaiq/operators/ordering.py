"""Order keys with explicit null placement, cursors over a total order, windows per parent, and distinct rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnsupportedError, ValidationError
from ..functions import DISTANCES, vector_literal
from ..schema import ORDERED, Model
from .predicates import all_of, any_of, literal

if TYPE_CHECKING:
    from ..plans.read import Reader

MAX_HOPS = 8


@dataclass(frozen=True)
class Key:
    """A sort key on a column of the DataFrame; nullable keys need the general cursor comparison."""

    column: str
    desc: bool
    nulls_first: bool
    field: str | None = None

    def sort(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.desc:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def reversed(self) -> Key:
        return replace(self, desc=not self.desc, nulls_first=not self.nulls_first)


def direction(spec: Any) -> tuple[bool, bool]:
    """Descending, nulls first. Nulls come last ascending and first descending unless said otherwise."""
    sort, nulls = (spec.get("sort"), spec.get("nulls")) if isinstance(spec, dict) else (spec, None)
    if sort not in ("asc", "desc") or nulls not in (None, "first", "last") or (isinstance(spec, dict) and set(spec) - {"sort", "nulls"}):
        raise ValidationError(f"{spec!r} isn't a sort order")
    return sort == "desc", (sort == "desc") if nulls is None else nulls == "first"


class Ordering:
    """Order, cursor and window compiler; a Reader mixes it in."""

    def order_keys(self: Reader, df: DataFrame, model: Model, order_by: Any) -> tuple[DataFrame, list[Key]]:
        keys: list[Key] = []
        for part in order_by if isinstance(order_by, (list, tuple)) else [order_by] if order_by else []:
            for name, spec in part.items():
                df, key = self._order_key(df, model, name, spec)
                if key.column not in [k.column for k in keys]:
                    keys.append(key)
        return df, keys

    def _order_key(self: Reader, df: DataFrame, model: Model, name: str, spec: Any) -> tuple[DataFrame, Key]:
        if name in model.relations:
            return self._relation_order(df, model, name, spec, 1)
        if name not in model.fields:
            raise ValidationError(f"{model.name} has no field or relation {name}")
        f = model.fields[name]
        if isinstance(spec, dict) and "_distance" in spec:
            d = spec["_distance"]
            out = self.fresh("o")
            return df.withColumn(out, self.distance(model, name, d)), Key(out, *direction(d.get("sort", "asc")))
        if f.kind in ("json", "vector", "point") or f.array:
            raise ValidationError(f"{name} can't be ordered by")
        return df, Key(name, *direction(spec), field=name)

    def distance(self: Reader, model: Model, name: str, d: dict) -> Column:
        f = model.fields.get(name)
        if f is None or not (f.kind == "vector" or (f.array and f.kind == "float")):
            raise ValidationError(f"{name} isn't a vector")
        if d.get("metric", "l2") not in DISTANCES or "to" not in d or set(d) - {"to", "metric", "sort"}:
            raise ValidationError("a distance names to, and a metric of l2 or cosine")
        if f.dimension and len(d["to"]) != f.dimension:
            raise ValidationError(f"{name} has {f.dimension} dimensions, not {len(d['to'])}")
        return DISTANCES[d.get("metric", "l2")](F.col(f"`{name}`").cast("array<double>"), vector_literal(d["to"]))

    def _relation_order(self: Reader, df: DataFrame, model: Model, name: str, spec: Any, hops: int) -> tuple[DataFrame, Key]:
        """Joins the related value as a fresh column: a field at the end of a chain of to-one relations, or a count."""
        if not isinstance(spec, dict) or len(spec) != 1:
            raise ValidationError(f"order by {name} takes one field")
        rel, out = model.relations[name], self.fresh("o")
        ((inner, order),) = spec.items()
        if rel.kind != "one":
            if inner != "_count" or hops > 1:
                raise UnsupportedError(f"order by {name} is by _count")
            return self.counted(df, model, name, {}, out), Key(out, *direction(order))
        if hops > MAX_HOPS:
            raise UnsupportedError(f"order by relations goes {MAX_HOPS} hops at most")
        child = self.registry[rel.target]
        cdf = self.scan(child)
        if inner in child.relations:
            cdf, key = self._relation_order(cdf, child, inner, order, hops + 1)
        else:
            cdf, key = self._order_key(cdf, child, inner, order)
        pairs = self.registry.keys(model, name)
        names = [self.fresh("k") for _ in pairs]
        cdf = cdf.select(*(F.col(f"`{c}`").alias(n) for (_, c), n in zip(pairs, names, strict=True)), F.col(f"`{key.column}`").alias(out))
        on = all_of([F.col(f"`{p}`") == F.col(n) for (p, _), n in zip(pairs, names, strict=True)])
        return df.join(cdf, on, "left").drop(*names), replace(key, column=out, field=None)

    def counted(self: Reader, df: DataFrame, model: Model, name: str, where: dict, out: str, narrow: bool = False) -> DataFrame:
        """df with the number of related rows (those that satisfy where) as the column out: zero where there are none. narrow:
        df has few of the model's rows, so that only their related rows are looked at."""
        child = self.registry[model.relations[name].target]
        cdf, on, names = self.with_parent_keys(self.filtered(self.scan(child), child, where), model, name)
        cdf = self.of_parents(cdf, df, on, names) if narrow else cdf
        counts = cdf.groupBy(*names).agg(F.count(F.lit(1)).alias(out))
        match = all_of([F.col(f"`{a}`") == F.col(n) for a, n in zip(on, names, strict=True)])
        return df.join(counts, match, "left").drop(*names).withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))

    def of_parents(self: Reader, cdf: DataFrame, parents: DataFrame, on: list[str], names: list[str]) -> DataFrame:
        """The rows of with_parent_keys that belong to the parents."""
        wanted = [self.fresh("w") for _ in on]
        keys = parents.select(*(F.col(f"`{a}`").alias(w) for a, w in zip(on, wanted, strict=True))).distinct()
        return cdf.join(keys, all_of([F.col(n) == F.col(w) for n, w in zip(names, wanted, strict=True)]), "left_semi")

    def total_order(self: Reader, model: Model, keys: list[Key], extra: tuple[str, ...] = (), needed: bool = True) -> list[Key]:
        """keys, then the primary key and the cursor's fields, ascending."""
        if needed and not model.key and not extra:
            raise UnsupportedError(f"{model.name} has no primary key, so take and cursor have no stable order")
        have = [k.column for k in keys]
        return keys + [Key(f, False, False, f) for f in dict.fromkeys((*model.key, *extra)) if f not in have]

    def windowed(self: Reader, df: DataFrame, model: Model, keys: list[Key], args: dict, parents: list[str] | None = None) -> tuple[DataFrame, list[Key], bool]:
        """Applies cursor, distinct, skip and take, for each parent if `parents` names its columns. Returns the rows, the
        keys they are to be shown in, and whether they are in that order already."""
        take, skip, cursor, distinct = args.get("take"), args.get("skip"), args.get("cursor"), args.get("distinct")
        for name, v in (("take", take), ("skip", skip)):
            if v is not None and (isinstance(v, bool) or not isinstance(v, int)):
                raise ValidationError(f"{name} takes a whole number")
        if skip is not None and skip < 0:
            raise ValidationError("skip can't be negative")
        if cursor is not None and any(k.field is None for k in keys):
            raise UnsupportedError("a cursor can't follow an order by relations or distances")
        unique = self.unique_pairs(model, cursor, strict=True) if cursor is not None else {}
        if take is not None or cursor is not None or parents is not None or skip:
            keys = self.total_order(model, keys, tuple(unique), needed=take is not None or cursor is not None)
        shown = keys
        backward = take is not None and take < 0
        if backward:
            keys = [k.reversed() for k in keys]
        if cursor is not None:
            df = df.where(self._from_cursor(model, keys, unique))
        if distinct:
            fields = [distinct] if isinstance(distinct, str) else list(distinct)
            for f in fields:
                if f not in model.fields:
                    raise ValidationError(f"{model.name} has no field {f}")
            rn = self.fresh("d")
            inside = Window.partitionBy(*(F.col(f"`{c}`") for c in (*(parents or ()), *fields))).orderBy(*(k.sort() for k in self.total_order(model, keys, needed=False) or [Key(fields[0], False, False)]))
            df = df.withColumn(rn, F.row_number().over(inside)).where(F.col(rn) == 1).drop(rn)
        if parents is not None:
            rn = "__rn"
            sort = [k.sort() for k in keys] or [F.lit(0)]
            df = df.withColumn(rn, F.row_number().over(Window.partitionBy(*(F.col(p) for p in parents)).orderBy(*sort)))
            if skip or take is not None:
                low = skip or 0
                df = df.where(F.col(rn) > low) if take is None else df.where((F.col(rn) > low) & (F.col(rn) <= low + abs(take)))
            if backward:
                df = df.withColumn(rn, -F.col(rn))
            return df, shown, False
        if skip and take is None and model.key:
            last = df.orderBy(*(k.sort() for k in keys)).select(F.struct(*(F.col(f"`{k.column}`") for k in keys)).alias("c")).offset(skip - 1).limit(1).scalar()
            return df.where(F.coalesce(self._past(keys, last), F.lit(False))), shown, False
        if keys and (take is not None or skip):
            df = df.orderBy(*(k.sort() for k in keys))
        if skip:
            df = df.offset(skip)
        if take is not None:
            df = df.limit(abs(take))
        return df, shown, bool(keys) and (take is not None or bool(skip)) and not backward

    def _from_cursor(self: Reader, model: Model, keys: list[Key], unique: dict[str, Any]) -> Column:
        """True from the cursor's row on. The row is a scalar subquery, so it is looked up once, at run time; without such
        a row it is NULL and nothing is left."""
        if any(v is None for v in unique.values()):
            raise ValidationError("a cursor's values can't be null")
        for k in keys:
            if k.field and model.fields[k.field].kind not in ORDERED:
                raise ValidationError(f"a cursor can't follow an order by {k.field}")
        row = self.scan(model).where(all_of([F.col(f"`{f}`") == literal(model.fields[f], v) for f, v in unique.items()]))
        at = row.select(F.struct(*(F.col(f"`{k.column}`") for k in keys)).alias("c")).scalar()
        if all(not model.fields[k.field].nullable for k in keys) and len({k.desc for k in keys}) == 1:
            here = F.struct(*(F.col(f"`{k.column}`") for k in keys))
            lead = F.col(f"`{keys[0].column}`")
            first = at[keys[0].column]
            # the plain comparison on the leading key lets the scan skip row groups
            return ((lead <= first) & (here <= at)) if keys[0].desc else ((lead >= first) & (here >= at))
        return self._past(keys, at) | (at.isNotNull() & all_of([F.col(f"`{k.column}`").eqNullSafe(at[k.column]) for k in keys]))

    def _past(self: Reader, keys: list[Key], at: Column) -> Column:
        """True for the rows after the one whose keys `at` has, in the order of the keys; false where there is no such row."""
        equal: list[Column] = []
        ways: list[Column] = []
        for k in keys:
            c, v = F.col(f"`{k.column}`"), at[k.column]
            past = (c < v) if k.desc else (c > v)
            after = F.when(v.isNull(), c.isNotNull() if k.nulls_first else F.lit(False)).otherwise(F.coalesce(past, F.lit(False)) | (F.lit(not k.nulls_first) & c.isNull()))
            ways.append(all_of([*equal, after]))
            equal.append(c.eqNullSafe(v))
        return at.isNotNull() & any_of(ways)
