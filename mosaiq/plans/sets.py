"""Set operations, joins and recursion over the DataFrames that reads return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError

#: Rows of the right side of a cross join.
CROSS_ROWS = 10_000


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL EXCEPT: distinct rows of a that aren't in b."""
    return a.subtract(b.select(*a.columns))


def join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """inner, left, right or full; columns of b whose names a has are prefixed with right_."""
    b = b.select(*(F.col(f"`{c}`").alias(f"right_{c}" if c in a.columns else c) for c in b.columns))
    name = lambda c: f"right_{c}" if c in a.columns else c
    cond = None
    for x, y in on:
        c = F.col(f"`{x}`") == F.col(f"`{name(y)}`")
        cond = c if cond is None else cond & c
    return a.join(b, cond, how)


def cross(a: DataFrame, b: DataFrame, most: int = CROSS_ROWS) -> DataFrame:
    """Every pair of rows. One side must be small: b of `most` rows at most, which is looked at."""
    if b.limit(most + 1).count() > most:
        raise UnsupportedError(f"a cross join takes {most} rows at most on its right side")
    return a.crossJoin(b.select(*(F.col(f"`{c}`").alias(f"right_{c}" if c in a.columns else c) for c in b.columns)))


def lateral(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """b may use columns of a as F.col(...).outer(); how is inner, left or cross."""
    return a.lateralJoin(b, how=how)


def descend(edges: DataFrame, roots: DataFrame, parent: str, child: str, max_depth: int = 100) -> DataFrame:
    """Everything below the roots (a column named as child) in a tree or graph of parent-child rows: child and depth, the
    least at which it is reached. Runs as one recursive query; rows already found aren't a cycle's end, so max_depth is."""
    spark = edges.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE walk(node, depth) AS (
              SELECT `{child}`, 0 FROM {{roots}}
              UNION ALL
              SELECT e.`{child}`, w.depth + 1 FROM walk w JOIN {{edges}} e ON e.`{parent}` = w.node WHERE w.depth < {int(max_depth)})
            SELECT node AS `{child}`, min(depth) AS depth FROM walk GROUP BY node""",
        roots=roots,
        edges=edges,
    )
