"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, scratch_path

#: Rows and bytes of one Arrow batch handed to a Python worker: a bound on a worker's memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches and ships this package to the executors, once for each context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_mosaiq_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # not when it is run from a zip that was shipped already
        target = Path(tempfile.mkdtemp(prefix="mosaiq-")) / "mosaiq_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
    sc._mosaiq_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mosaiq_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more; the others go when the application ends."""
    path = getattr(df, "_mosaiq_path", None)
    if path:
        delete(df.sparkSession, path)


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as _id and _text: other columns, whatever their names, can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(df: DataFrame, col: str = "_id") -> str:
    return df.schema[col].dataType.simpleString()
