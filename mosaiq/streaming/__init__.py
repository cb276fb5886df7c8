"""Reads over unbounded tables: the same filters and projections on a streaming DataFrame, and windowed groups.

Only what a stream supports is here: filters on the model's own fields and on related static tables (stream-static semi
joins), projections, and groups by event time under a watermark.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError, ValidationError
from ..plans.read import Reader


def find_stream(reader: Reader, model_name: str, **args: Any) -> DataFrame:
    """find_many without order, window or nesting, over a model whose source gives a stream."""
    model, args = reader.checked(model_name, args, ("where", "select", "omit"))
    df = reader.filtered(reader.scan(model), model, args.get("where"))
    fields, relations, distances, count = reader.wanted(model, args)
    if relations or count:
        raise UnsupportedError("streams have no nested relations")
    return df.select(*(F.col(f"`{k}`") for k in fields), *(reader.distance(model, k, d).alias("_distance") for k, d in distances.items()))


def group_stream(reader: Reader, model_name: str, time: str, window: str, watermark: str, slide: str | None = None, session: bool = False, **args: Any) -> DataFrame:
    """group_by over tumbling, sliding or session windows of a time field: window_start, window_end, the grouped fields and
    a struct for each aggregate. Rows later than the watermark are left out; state is dropped behind it."""
    model, args = reader.checked(model_name, args, ("by", "where", "_count", "_avg", "_sum", "_min", "_max"))
    if time not in model.fields or model.fields[time].kind != "date_time":
        raise ValidationError(f"{time} isn't a time of {model.name}")
    by = [args["by"]] if isinstance(args.get("by"), str) else list(args.get("by") or ())
    df = reader.filtered(reader.scan(model), model, args.get("where"))
    at = F.col(f"`{time}`").cast("timestamp")
    df = df.withColumn("__at", at).withWatermark("__at", watermark)
    slot = F.session_window("__at", window) if session else F.window("__at", window, slide)
    chosen = reader.aggregate_structs(model, args)
    if not chosen:
        raise ValidationError("a stream's groups need an aggregate")
    grouped = df.groupBy(slot.alias("__w"), *(F.col(f"`{k}`") for k in by)).agg(*chosen)
    return grouped.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *(c for c in grouped.columns if c != "__w"))
