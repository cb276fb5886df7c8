"""Tables as lists of Parquet files under versioned manifests, with atomic commits.

A commit publishes one manifest that names every table's files, so several tables change together or not at all. Writers
are optimistic: the manifest of the next version is created exclusively, and a writer that finds it taken goes on from
there unless the other changed a table that it touched. Rewrites replace only the files that hold changed rows; inserts
add files. On a store without exclusive create, use one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, TransactionError


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere, as files are read."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        if self.version() is None:
            self._publish(0, {})

    # files

    def _path(self, text: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self, path: Any) -> Any:
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:012d}.json"

    def _publish(self, version: int, tables: dict, touched: list[str] | None = None) -> bool:
        """Creates the manifest; false if that version exists."""
        path = self._path(self._manifest(version))
        fs = self._fs(path)
        draft = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "tables": tables, "touched": touched or []}).encode()))
        out.close()
        if fs.exists(path):
            fs.delete(draft, False)
            return False
        try:
            return bool(fs.rename(draft, path))
        except Exception:  # the name was taken meanwhile
            fs.delete(draft, False)
            return False

    def version(self) -> int | None:
        path = self._path(f"{self.root}/_manifest")
        fs = self._fs(path)
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=None)

    def manifest(self, version: int | None = None) -> dict:
        path = self._path(self._manifest(self.version() if version is None else version))
        stream = self._fs(path).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # reading

    @property
    def tables(self) -> dict:
        return self.manifest()["tables"]

    def load(self, table: str, version: int | None = None) -> DataFrame:
        """The table now, or as of a version."""
        return self.read(self.manifest(version)["tables"], table)

    def read(self, tables: dict, table: str, files: list[str] | None = None) -> DataFrame:
        if table not in tables:
            raise TransactionError(f"no table {table}")
        schema = T.StructType.fromJson(json.loads(tables[table]["schema"]))
        files = tables[table]["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in files))

    # writing

    def write_files(self, df: DataFrame, table: str) -> list[str]:
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        path = self._path(f"{self.root}/{folder}")
        return [f"{folder}/{s.getPath().getName()}" for s in self._fs(path).listStatus(path) if s.getPath().getName().startswith("part-")]

    # upkeep

    def history(self) -> list[dict]:
        """Version and changed tables of every manifest that is kept, oldest first."""
        path = self._path(f"{self.root}/_manifest")
        names = sorted(s.getPath().getName() for s in self._fs(path).listStatus(path))
        return [{"version": int(n[:-5]), "touched": self.manifest(int(n[:-5]))["touched"]} for n in names if n.endswith(".json")]

    def compact(self, table: str, files: int) -> int:
        """The same rows in so many files; a commit like any other."""
        tx = self.begin()
        tx.rewrite(table, tx.load(table).repartition(files))
        return tx.commit()

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last `keep`, and all files that none of those names; returns the number of files.
        No writer or reader of an older version may be at work."""
        versions = [h["version"] for h in self.history()]
        kept = versions[-keep:]
        named = {f for v in kept for t in self.manifest(v)["tables"].values() for f in t["files"]}
        root, gone = self._path(self.root), 0
        fs = self._fs(root)
        for table in fs.listStatus(root):
            if table.getPath().getName() in ("_manifest", "_steps"):
                continue
            for folder in fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                files = [f"{name}/{x.getPath().getName()}" for x in fs.listStatus(folder.getPath())]
                if not named.intersection(files):
                    gone += len(files)
                    fs.delete(folder.getPath(), True)
        for v in versions[:-keep]:
            fs.delete(self._path(self._manifest(v)), False)
        return gone

    def begin(self) -> Transaction:
        return Transaction(self)

    def create_table(self, table: str, df_or_schema: DataFrame | T.StructType) -> None:
        tx = self.begin()
        tx.create_table(table, df_or_schema)
        tx.commit()


class Transaction:
    """A set of changes to tables that is published at once. It reads its own changes, and otherwise the version it began with."""

    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark
        self.base = store.version() or 0
        self.state = store.manifest(self.base)["tables"]
        self.touched: set[str] = set()
        self.changed: list[str] = []
        self.done = False

    @property
    def tables(self) -> dict:
        return self.state

    def load(self, table: str) -> DataFrame:
        self.touched.add(table)
        return self.store.read(self.state, table)

    def with_files(self, table: str) -> DataFrame:
        """The rows with the name of the file that holds each, as __file."""
        df = self.load(table)
        if not self.state[table]["files"]:
            return df.withColumn("__file", F.lit(""))
        return df.select("*", F.col("_metadata.file_name").alias("__file"))

    def create_table(self, table: str, df_or_schema: DataFrame | T.StructType) -> None:
        if table in self.state:
            raise TransactionError(f"table {table} exists")
        frame = isinstance(df_or_schema, DataFrame)
        schema = nullable(df_or_schema.schema if frame else df_or_schema)
        self.state[table] = {"schema": schema.json(), "files": self.store.write_files(df_or_schema, table) if frame else []}
        self.touched.add(table)

    def drop_table(self, table: str) -> None:
        self.state.pop(table)
        self.touched.add(table)

    def append(self, table: str, rows: DataFrame) -> None:
        schema = T.StructType.fromJson(json.loads(self.state[table]["schema"]))
        shaped = rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        self.touched.add(table)
        self.state[table] = self.state[table] | {"files": self.state[table]["files"] + self.store.write_files(shaped, table)}

    def replace_files(self, table: str, names: set[str], rows: DataFrame) -> None:
        """Puts rows in the place of the files with these names."""
        kept = [f for f in self.state[table]["files"] if f.rpartition("/")[2] not in names]
        self.state[table] = self.state[table] | {"files": kept}
        self.append(table, rows)

    def rewrite(self, table: str, rows: DataFrame, schema: T.StructType | None = None) -> None:
        self.state[table] = self.state.get(table, {}) | {"schema": nullable(schema or rows.schema).json(), "files": []}
        self.append(table, rows)

    def files_of(self, table: str, names: set[str]) -> DataFrame:
        return self.store.read(self.state, table, [f for f in self.state[table]["files"] if f.rpartition("/")[2] in names])

    def temporary(self, df: DataFrame) -> DataFrame:
        """df as files that no manifest names: read again without being computed again. They stay for results that are read
        after the transaction, until vacuum."""
        files = self.store.write_files(df, "_temporary")
        return self.spark.read.schema(df.schema).parquet(*(f"{self.store.root}/{f}" for f in files)) if files else self.spark.createDataFrame([], df.schema)

    def savepoint(self) -> tuple:
        return deepcopy(self.state), set(self.touched)

    def rollback_to(self, mark: tuple) -> None:
        self.state, self.touched = deepcopy(mark[0]), set(mark[1])

    def commit(self) -> int:
        if self.done:
            raise TransactionError("the transaction has ended")
        self.changed = changed = sorted(t for t in self.touched if self.state.get(t) != self.store.manifest(self.base)["tables"].get(t))
        if not changed:
            self.done = True
            return self.base
        target = self.base
        while True:
            tables = self.store.manifest(target)["tables"]
            for t in changed:
                if t in self.state:
                    tables[t] = self.state[t]
                else:
                    tables.pop(t, None)
            if self.store._publish(target + 1, tables, changed):
                self.done = True
                return target + 1
            target += 1
            clash = set(self.store.manifest(target)["touched"]) & self.touched
            if clash:
                self.done = True
                raise ConflictError(f"another writer changed {', '.join(sorted(clash))}")
