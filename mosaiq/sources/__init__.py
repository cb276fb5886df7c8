"""Where models' tables come from."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(Protocol):
    def load(self, table: str) -> DataFrame: ...


class ParquetSource:
    """dir/<table>.parquet for each table: a file or a directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def load(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{table}.parquet")


class FrameSource:
    """Tables given as DataFrames, or functions that make them (streams, views, other formats)."""

    def __init__(self, spark: SparkSession, tables: dict):
        self.spark, self.tables = spark, tables

    def load(self, table: str) -> DataFrame:
        t = self.tables[table]
        return t() if callable(t) and not isinstance(t, DataFrame) else t


class JdbcSource:
    """Tables of a database that the driver and every executor reach; Spark pushes filters, columns and limits down to it."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def load(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load()


class LayeredSource:
    """The first of several sources that has the table."""

    def __init__(self, *sources: Source):
        self.sources, self.spark = sources, sources[0].spark

    def load(self, table: str) -> DataFrame:
        for s in self.sources[:-1]:
            if table in getattr(s, "tables", ()):
                return s.load(table)
        return self.sources[-1].load(table)


class Recorded:
    """A source that keeps the names of the tables it was asked for."""

    def __init__(self, source: Source):
        self.source, self.spark, self.loaded = source, source.spark, set()

    def load(self, table: str) -> DataFrame:
        self.loaded.add(table)
        return self.source.load(table)

    def __getattr__(self, name: str):
        return getattr(self.source, name)


def query(spark: SparkSession, text: str, **args) -> DataFrame:
    """Raw SQL with bound named parameters (:name); values are never spliced into the text."""
    return spark.sql(text, args=args)
