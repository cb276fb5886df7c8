"""The client: engine.<model>.<operation>(**arguments), transactions and the cache."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame

from .cache import DEFAULT_TTL_MS, Cache, cache_key
from .errors import ConflictError, ModelNotFoundError, TransactionError, UnsupportedError, ValidationError
from .log import emit, handled, span
from .plans.read import Reader
from .plans.write import Writer
from .schema import Registry
from .sources import Recorded, Source, query
from .sources.store import SnapshotStore

READS = ("find_many", "find_first", "find_unique", "find_first_or_throw", "find_unique_or_throw", "count", "exist", "aggregate", "group_by")
WRITES = ("create", "create_many", "update", "update_many", "upsert", "delete", "delete_many")


class _Model:
    def __init__(self, call: Callable, name: str, operations: tuple[str, ...]):
        self._call, self._name, self._operations = call, name, operations

    def __getattr__(self, operation: str) -> Callable[..., DataFrame]:
        snake = "".join(f"_{c.lower()}" if c.isupper() else c for c in operation)
        if snake not in self._operations:
            raise AttributeError(f"no operation {operation}")
        return lambda **args: self._call(self._name, snake, args)


class _Models:
    registry: Registry

    def __getattr__(self, name: str) -> _Model:
        if name.startswith("_") or name not in self.registry.models:
            raise ModelNotFoundError(f"no model {name}")
        return self.model(name)

    def model(self, name: str) -> _Model:
        self.registry[name]
        return _Model(self._run, name, READS + WRITES)


class Session(_Models):
    """The models within a transaction."""

    def __init__(self, writer: Writer, timeout: float | None = None):
        self.writer, self.registry, self.spark = writer, writer.registry, writer.tx.spark
        self.timeout, self.began = timeout, time.monotonic()

    def check_time(self) -> None:
        if self.timeout is not None and (time.monotonic() - self.began) * 1000 > self.timeout:
            raise TransactionError(f"the transaction took longer than {self.timeout:g} ms")

    def _run(self, model: str, operation: str, args: dict) -> DataFrame:
        self.check_time()
        with span("mosaiq.execute" if operation in WRITES else "mosaiq.build", model=model, operation=operation):
            return getattr(self.writer, operation)(model, **args)

    def query(self, text: str, **args: Any) -> DataFrame:
        """Raw SQL with named parameters; it sees the transaction's changes."""
        self.check_time()
        for m in self.registry.models.values():
            if m.table in self.writer.tx.tables:
                self.writer.tx.load(m.table).createOrReplaceTempView(m.table)
        return query(self.spark, text, **args)

    def execute(self, text: str, **args: Any) -> int:
        """A raw INSERT, UPDATE or DELETE of one model's table with named parameters; the number of rows it affects. Keys,
        references and referential actions are looked after as in other writes."""
        for pattern, run in ((_INSERT, self._insert), (_UPDATE, self._update), (_DELETE, self._delete)):
            if m := pattern.fullmatch(text.strip().rstrip(";")):
                model = next((x for x in self.registry.models.values() if x.table.lower() == m["table"].strip("`\"").lower()), None)
                if model is None:
                    raise ModelNotFoundError(f"no model has the table {m['table']}")
                return run(model, m.groupdict(), args)
        raise UnsupportedError("execute takes one INSERT INTO, UPDATE or DELETE FROM statement")

    def _insert(self, model: Any, parts: dict, args: dict) -> int:
        names = [x.strip().strip("`\"") for x in parts["columns"].split(",")] if parts["columns"] else [model.column(k) for k in model.fields]
        fields = {model.column(k): k for k in model.fields}
        if unknown := set(names) - set(fields):
            raise ValidationError(f"{model.table} has no column {', '.join(sorted(unknown))}")
        rows = self.query(parts["rows"], **args)
        if len(rows.columns) != len(names):
            raise ValidationError(f"{len(names)} columns are named, and {len(rows.columns)} given")
        return self.writer.create_many(model.name, data=rows.toDF(*(fields[n] for n in names))).first()[0]

    def _matching(self, model: Any, columns: str, where: str | None, args: dict) -> DataFrame:
        return self.writer.tx.temporary(self.query(f"SELECT {columns} FROM `{model.table}`" + (f" WHERE {where}" if where else ""), **args))

    def _update(self, model: Any, parts: dict, args: dict) -> int:
        set_to = dict(x.split("=", 1) for x in _split_top(parts["set"]))
        set_to = {k.strip().strip("`\""): v.strip() for k, v in set_to.items()}
        stored = [model.column(k) for k in model.fields]
        if unknown := set(set_to) - set(stored):
            raise ValidationError(f"{model.table} has no column {', '.join(sorted(unknown))}")
        if set(set_to) & {model.column(k) for k in model.key}:
            raise UnsupportedError("a raw update can't change the primary key")
        rows = self._matching(model, ", ".join(f"{set_to[c]} AS `{c}`" if c in set_to else f"`{c}`" for c in stored), parts["where"], args)
        return self.writer.put(model, self.writer.to_fields(rows, model), {k for k in model.fields if model.column(k) in set_to})

    def _delete(self, model: Any, parts: dict, args: dict) -> int:
        rows = self.writer.to_fields(self._matching(model, "*", parts["where"], args), model)
        n = rows.count()
        if n:
            self.writer._remove(model, rows)
        return n

    @contextmanager
    def savepoint(self) -> Iterator[Session]:
        """What happens inside is undone if it raises; the transaction goes on."""
        mark = self.writer.tx.savepoint()
        try:
            yield self
        except Exception:
            self.writer.tx.rollback_to(mark)
            raise


_INSERT = re.compile(r"insert\s+into\s+(?P<table>\S+?)\s*(?:\((?P<columns>[^()]*)\))?\s+(?P<rows>(?:values|select|with)\b.*)", re.I | re.S)
_UPDATE = re.compile(r"update\s+(?P<table>\S+)\s+set\s+(?P<set>.*?)(?:\s+where\s+(?P<where>.*))?", re.I | re.S)
_DELETE = re.compile(r"delete\s+from\s+(?P<table>\S+)(?:\s+where\s+(?P<where>.*))?", re.I | re.S)


def _split_top(text: str) -> list[str]:
    """Split at commas that stand in no brackets and no quotes."""
    out, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append("")
            continue
        out[-1] += c
    return out


def checked_options(options: dict, form: str) -> float | None:
    """The timeout of a transaction's options, in milliseconds; what can't be kept to is refused, with the reason."""
    options = {{"isolationLevel": "isolation_level", "maxWait": "max_wait"}.get(k, k): v for k, v in options.items() if v is not None}
    known = {"isolation_level", "timeout", "max_wait"} if form == "callback" else {"isolation_level"}
    if unknown := set(options) - known:
        raise ValidationError(f"a {form} transaction takes no {', '.join(sorted(unknown))}")
    level = str(options.get("isolation_level", "serializable")).lower().replace(" ", "_").replace("-", "_")
    if level not in ("serializable", "repeatable_read", "read_committed", "read_uncommitted"):
        raise ValidationError(f"{level} isn't an isolation level")
    if level != "serializable":
        raise UnsupportedError(f"{level} isn't offered: a transaction reads one version, and commits only if no table that it read has changed since, so it is serializable")
    if "max_wait" in options:
        raise UnsupportedError("max_wait isn't offered: a transaction waits for no slot")
    timeout = options.get("timeout")
    if timeout is not None and (isinstance(timeout, bool) or not isinstance(timeout, (int, float)) or not 0 < timeout < float("inf")):
        raise ValidationError(f"{timeout!r} isn't a timeout in milliseconds")
    return timeout


class Engine(_Models):
    """Reads from any source; writes if the source is a SnapshotStore."""

    def __init__(self, registry: Registry, source: Source | SnapshotStore, omit: dict | None = None, cache: Cache | None = None, log_values: bool = False, log: dict[str, Callable[[dict], None]] | None = None):
        """log: functions that get the records of a kind: query, cache, warning, error or span."""
        self.registry, self.source, self.omit, self.cache, self.log_values, self.log = registry, source, omit, cache, log_values, log or {}
        self.spark = source.spark

    def _run(self, model: str, operation: str, args: dict) -> DataFrame:
        return self._read(model, operation, args)[0] if operation in READS else self._write(lambda s: s._run(model, operation, args), model, operation, args)

    def _read(self, model: str, operation: str, args: dict) -> tuple[DataFrame, frozenset[str]]:
        """The rows, and the tables that they come from."""
        with handled(self.log), span("mosaiq.operation", self.log_values, model=model, operation=operation, args=args):
            source = Recorded(self.source.begin() if isinstance(self.source, SnapshotStore) else self.source)  # one version for the whole statement
            reader = Reader(self.registry, source, self.omit)
            with span("mosaiq.build", model=model, operation=operation):
                df = getattr(reader, operation)(model, **args)
            emit("query", model=model, operation=operation, **({"args": args} if self.log_values else {}))
            return df, frozenset(source.loaded)

    def _write(self, body: Callable[[Session], Any], model: str = "", operation: str = "batch", args: dict | None = None, **options: Any) -> Any:
        """Runs and commits; once more if another writer was faster."""
        with handled(self.log), span("mosaiq.operation", self.log_values, model=model, operation=operation, args=args):
            for last in (False, True):
                try:
                    with self.transaction(**options) as s:
                        return body(s)
                except ConflictError as e:
                    if last:
                        raise
                    emit("warning", message="another writer was faster; once more", error=type(e).__name__)
        return None

    @contextmanager
    def transaction(self, **options: Any) -> Iterator[Session]:
        """All changes inside are published together at the end, or none if it raises. Options: isolation_level, which can be
        serializable alone, and timeout in milliseconds, looked at before each operation and before the end."""
        timeout = checked_options(options, "callback")
        if not isinstance(self.source, SnapshotStore):
            raise UnsupportedError("writes need a SnapshotStore")
        session = Session(Writer(self.registry, self.source.begin(), self.omit), timeout)
        with handled(self.log), span("mosaiq.transaction"):
            yield session
            session.check_time()
            session.writer.tx.commit()
        if self.cache:
            self.cache.invalidate_tables(set(session.writer.tx.changed))

    def batch(self, *steps: Callable[[Session], Any], **options: Any) -> list[Any]:
        """Steps of one transaction; their results. Options: isolation_level."""
        if not all(map(callable, steps)):
            raise TransactionError("a batch takes functions of the session")
        checked_options(options, "batch")
        return self._write(lambda s: [f(s) for f in steps])

    def execute(self, text: str, **args: Any) -> int:
        """A raw statement in a transaction of its own (see Session.execute)."""
        return self._write(lambda s: s.execute(text, **args), operation="execute")

    def with_cache(self, ttl: str | int = DEFAULT_TTL_MS, swr: bool | str | int = False, key: str | None = None, bypass: bool = False) -> _Cached:
        return _Cached(self, ttl, swr, key, bypass)

    def query(self, text: str, **args: Any) -> DataFrame:
        """Raw SQL with named parameters; every model's table is a view by its name."""
        for m in self.registry.models.values():
            try:
                self.source.load(m.table).createOrReplaceTempView(m.table)
            except Exception as e:  # a model without a table yet
                if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, (TransactionError, KeyError)):
                    raise
        return query(self.spark, text, **args)

    def create_tables(self) -> None:
        """An empty table for every model and junction that has none."""
        tx = self.source.begin()
        for m in self.registry.models.values():
            if m.table not in tx.tables:
                from pyspark.sql import types as T

                tx.create_table(m.table, T.StructType([T.StructField(m.column(k), f.spark_type()) for k, f in m.fields.items()]))
            for name, r in m.relations.items():
                if r.kind == "m2m":
                    j, target = self.registry.junction(m, name), self.registry[r.target]
                    if j.table not in tx.tables:
                        from pyspark.sql import types as T

                        tx.create_table(j.table, T.StructType([T.StructField(j.source, m.fields[m.key[0]].spark_type()), T.StructField(j.target, target.fields[target.key[0]].spark_type())]))
        tx.commit()


class _Cached(_Models):
    """Reads whose rows are kept; writes can't go through it."""

    def __init__(self, engine: Engine, ttl: str | int, swr: bool | str | int, key: str | None, bypass: bool):
        self._engine, self._options, self._key = engine, {"ttl": ttl, "swr": swr, "bypass": bypass}, key
        self.registry = engine.registry
        if engine.cache is None:
            engine.cache = Cache()

    def _run(self, model: str, operation: str, args: dict) -> DataFrame:
        if operation not in READS:
            raise UnsupportedError("only reads are cached")
        key = f"{model}:{operation}:{self._key}" if self._key else cache_key(model, operation, args)

        read: list[frozenset[str]] = []

        def compute() -> DataFrame:
            df, tables = self._engine._read(model, operation, args)
            read.append(tables)
            if isinstance(self._engine.cache.entries, dict):
                df = df.persist()
                df.count()
            return df

        with handled(self._engine.log):
            return self._engine.cache.get(key, compute, **self._options, tables=lambda: read[-1])
