"""Schema evolution: the difference between stored tables and models, its application in one commit, and named migrations.

Besides columns, a table's manifest entry keeps facts: its primary key, unique keys, foreign keys, indexes and the values of
its enums. Adding one checks the rows that are there; writes check them by the models. Spark has no indexes, so those are
noted alone."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ForeignKeyError, NotNullError, UniqueConstraintError, UnsupportedError, ValidationError
from ..schema import Registry
from .store import SnapshotStore, Transaction

#: Facts of a table, and the steps that add, change and drop one.
FACTS = {
    "primary_key": ("add_primary_key", None, "drop_primary_key"),
    "unique": ("add_unique", None, "drop_unique"),
    "foreign_key": ("add_foreign_key", None, "drop_foreign_key"),
    "index": ("create_index", None, "drop_index"),
    "enum": ("create_enum", "alter_enum", "drop_enum"),
}


@dataclass(frozen=True)
class Step:
    """create_table, drop_table, rename_table, add_column, drop_column, rename_column, alter_column, or a step of FACTS, whose
    column is the fact's name."""

    kind: str
    table: str
    column: str | None = None
    to: Any = None

    @property
    def destructive(self) -> bool:
        return self.kind in ("drop_table", "drop_column")


def wanted_tables(registry: Registry) -> dict[str, T.StructType]:
    out = {m.table: T.StructType([T.StructField(m.column(k), f.spark_type()) for k, f in m.fields.items()]) for m in registry.models.values()}
    for m in registry.models.values():
        for name, r in m.relations.items():
            if r.kind == "m2m":
                j, target = registry.junction(m, name), registry[r.target]
                out.setdefault(j.table, T.StructType([T.StructField(j.source, m.fields[m.key[0]].spark_type()), T.StructField(j.target, target.fields[target.key[0]].spark_type())]))
    return out


def wanted_facts(registry: Registry) -> dict[str, dict[str, dict[str, Any]]]:
    """Of each table: {fact: {name: columns, or what else it says}}."""
    out: dict[str, dict[str, dict[str, Any]]] = {}
    for m in registry.models.values():
        columns = lambda names, m=m: [m.column(k) for k in names]
        facts: dict[str, dict[str, Any]] = {k: {} for k in FACTS}
        if m.key:
            facts["primary_key"]["_".join(m.key)] = columns(m.key)
        facts["unique"] = {name: columns(fields) for name, fields in m.unique_keys().items() if fields != m.key}
        facts["index"] = {"_".join(i): columns(i) for i in ((x,) if isinstance(x, str) else tuple(x) for x in m.indexes)}
        facts["enum"] = {m.column(k): list(f.values) for k, f in m.fields.items() if f.kind == "enum"}
        for name, r in m.relations.items():
            if r.holds:
                target = registry[r.target]
                facts["foreign_key"][name] = [columns(r.fields), target.table, [target.column(k) for k in r.references]]
        out[m.table] = facts
    return out


def difference(store: SnapshotStore | Transaction, registry: Registry, renames: dict[str, str] | None = None, facts: bool = False) -> list[Step]:
    """renames: {"table": "new_table", "table.column": "new_column"}; what isn't named there is dropped and added. facts: steps
    for keys, references, indexes and enums too, after the others. Tables that begin with _ are the store's own."""
    now = {t: v for t, v in store.tables.items() if not t.startswith("_")}
    steps = _columns(now, registry, renames or {})
    if facts:
        moved = {s.table: s.to for s in steps if s.kind == "rename_table"}
        kept = {moved.get(t, t): v.get("facts", {}) for t, v in now.items()}
        for table, wanted in sorted(wanted_facts(registry).items()):
            for fact, (add, change, drop) in FACTS.items():
                old, new = kept.get(table, {}).get(fact, {}), wanted[fact]
                steps += [Step(drop, table, k) for k in old if k not in new or (old[k] != new[k] and not change)]
                steps += [Step(change if k in old and change else add, table, k, v) for k, v in new.items() if old.get(k) != v]
        first = ("add_primary_key", "add_unique")  # what foreign keys refer to
        steps.sort(key=lambda s: 2 if s.kind == "add_foreign_key" else 1 if s.kind in first else 0)
    return steps


def _columns(tables: dict, registry: Registry, renames: dict[str, str]) -> list[Step]:
    have = {t: T.StructType.fromJson(json.loads(v["schema"])) for t, v in tables.items()}
    want, steps = wanted_tables(registry), []
    for old, new in renames.items():
        if "." not in old and old in have:
            steps.append(Step("rename_table", old, to=new))
            have[new] = have.pop(old)
    for t in sorted(have.keys() - want.keys()):
        steps.append(Step("drop_table", t))
    for t in sorted(want.keys() - have.keys()):
        steps.append(Step("create_table", t, to=want[t]))
    for t in sorted(want.keys() & have.keys()):
        now = {f.name: f.dataType for f in have[t]}
        for old, new in renames.items():
            table, _, column = old.partition(".")
            if column and table == t and column in now:
                steps.append(Step("rename_column", t, column, new))
                now[new] = now.pop(column)
        then = {f.name: f.dataType for f in want[t]}
        steps += [Step("drop_column", t, c) for c in now if c not in then]
        steps += [Step("add_column", t, c, k) for c, k in then.items() if c not in now]
        steps += [Step("alter_column", t, c, k) for c, k in then.items() if c in now and now[c] != k]
    return steps


def apply(store: SnapshotStore, steps: list[Step], allow_loss: bool = False) -> int:
    """Publishes the steps together; returns the new version. Going back is a matter of reading an older one (see revert)."""
    tx = store.begin()
    run_steps(tx, steps, allow_loss)
    return tx.commit()


def run_steps(tx: Transaction, steps: list[Step], allow_loss: bool = False) -> None:
    if any(s.destructive for s in steps) and not allow_loss:
        raise UnsupportedError("the steps drop data; allow_loss permits it")
    for s in steps:
        fact = next((k for k, kinds in FACTS.items() if s.kind in kinds), None)
        if fact:
            _change_fact(tx, s, fact)
        elif s.kind == "create_table":
            tx.create_table(s.table, s.to)
        elif s.kind == "drop_table":
            tx.drop_table(s.table)
        elif s.kind == "rename_table":
            tx.state[s.to] = tx.state.pop(s.table)
            tx.touched |= {s.table, s.to}
        else:
            df = tx.load(s.table)
            if s.kind == "add_column":
                df = df.withColumn(s.column, F.lit(None).cast(s.to))
            elif s.kind == "drop_column":
                df = df.drop(s.column)
            elif s.kind == "rename_column":
                df = df.withColumnRenamed(s.column, s.to)
            else:
                df = df.withColumn(s.column, F.col(f"`{s.column}`").cast(s.to))
            tx.rewrite(s.table, tx.temporary(df))


def _change_fact(tx: Transaction, s: Step, fact: str) -> None:
    facts = {k: dict(v) for k, v in tx.state[s.table].get("facts", {}).items()}
    if s.kind == FACTS[fact][2]:
        facts.get(fact, {}).pop(s.column, None)
    else:
        _check_fact(tx, s, fact)
        facts.setdefault(fact, {})[s.column] = s.to
    tx.state[s.table] = tx.state[s.table] | {"facts": facts}
    tx.touched.add(s.table)


def _check_fact(tx: Transaction, s: Step, fact: str) -> None:
    """Refuses a fact that the stored rows contradict."""
    df = tx.load(s.table)
    columns = [F.col(f"`{c}`") for c in (s.to[0] if fact == "foreign_key" else s.to if fact in ("primary_key", "unique") else ())]
    if fact == "primary_key" and not df.where(F.greatest(*(c.isNull() for c in columns), F.lit(False))).isEmpty():
        raise NotNullError(f"{s.table}.{s.column} has nulls")
    if fact in ("primary_key", "unique") and not df.dropna(subset=s.to).groupBy(*columns).count().where("count > 1").isEmpty():
        raise UniqueConstraintError(f"{s.table}.{s.column} isn't unique")
    if fact == "enum":
        c = F.col(f"`{s.column}`")
        array = isinstance(df.schema[s.column].dataType, T.ArrayType)
        if not df.where(F.exists(c, lambda x: ~x.isin(*s.to)) if array else ~c.isin(*s.to)).isEmpty():
            raise ValidationError(f"{s.table}.{s.column} has other values than {', '.join(s.to)}")
    if fact == "foreign_key":
        _, table, references = s.to
        there = tx.load(table).select(*(F.col(f"`{c}`").alias(f"__r{k}") for k, c in enumerate(references)))
        on = [c == F.col(f"__r{k}") for k, c in enumerate(columns)]
        if not df.dropna(subset=s.to[0]).join(there, on, "left_anti").isEmpty():
            raise ForeignKeyError(f"{s.table}.{s.column} refers to rows of {table} that don't exist")


def revert(store: SnapshotStore, version: int) -> int:
    """Publishes the tables of an older version as the newest."""
    tx = store.begin()
    old = store.manifest(version)["tables"]
    tx.touched |= set(tx.state) | set(old)
    tx.state = old
    return tx.commit()


def _plain(s: Step) -> dict:
    to = {"$type": s.to.json()} if isinstance(s.to, T.DataType) else s.to
    return {"kind": s.kind, "table": s.table, "column": s.column, "to": to}


def _step(x: dict) -> Step:
    to = x["to"]
    if isinstance(to, dict) and "$type" in to:
        said = json.loads(to["$type"])
        to = T.StructType.fromJson(said) if isinstance(said, dict) and said.get("type") == "struct" else T._parse_datatype_json_value(said)
    return Step(x["kind"], x["table"], x["column"], to)


class Migrations:
    """Named lists of steps beside a store, applied in the order of their numbers. The table _migrations says which are
    applied and from which version; it changes in the same commit as the tables."""

    LOG = T.StructType([T.StructField("name", T.StringType()), T.StructField("before", T.LongType())])

    def __init__(self, store: SnapshotStore, registry: Registry):
        self.store, self.registry = store, registry

    def _place(self, name: str = "") -> Any:
        return self.store._path(f"{self.store.root}/_steps" + (f"/{name}.json" if name else ""))

    def names(self) -> list[str]:
        path = self._place()
        fs = self.store._fs(path)
        return sorted(x.getPath().getName()[:-5] for x in fs.listStatus(path)) if fs.exists(path) else []

    def _save(self, name: str, steps: list[Step]) -> None:
        path = self._place(name)
        out = self.store._fs(path).create(path, False)
        out.write(bytearray(json.dumps([_plain(s) for s in steps]).encode()))
        out.close()

    def steps(self, name: str) -> list[Step]:
        path = self._place(name)
        stream = self.store._fs(path).open(path)
        try:
            return [_step(x) for x in json.loads(self.store.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))]
        finally:
            stream.close()

    def applied(self) -> dict[str, int]:
        """The version before each applied migration, in order."""
        return dict(sorted(self.store.load("_migrations").collect())) if "_migrations" in self.store.tables else {}

    def status(self) -> list[tuple[str, bool]]:
        done = self.applied()
        return [(n, n in done) for n in self.names()]

    def generate(self, name: str, renames: dict[str, str] | None = None) -> str | None:
        """Keeps the difference of the models to the store, where all migrations are applied, as a new one; its full name."""
        if not all(done for _, done in self.status()):
            raise UnsupportedError("a migration waits to be applied")
        steps = difference(self.store, self.registry, renames, facts=True)
        if not steps:
            return None
        last = self.names()[-1:]
        full = f"{int(last[0][:4]) + 1 if last else 1:04d}_{name}"
        self._save(full, steps)
        return full

    def apply(self, allow_loss: bool = False) -> list[str]:
        """Applies those that wait, each in a commit of its own; their names."""
        done = []
        for name, there in self.status():
            if not there:
                self._apply(name, allow_loss)
                done.append(name)
        return done

    def _apply(self, name: str, allow_loss: bool) -> None:
        tx = self.store.begin()
        run_steps(tx, self.steps(name), allow_loss)
        if "_migrations" not in tx.tables:
            tx.create_table("_migrations", self.LOG)
        tx.append("_migrations", self.store.spark.createDataFrame([(name, tx.base)], self.LOG))
        tx.commit()

    def down(self, count: int = 1, allow_loss: bool = False) -> list[str]:
        """Goes back to the tables before the last `count` applied ones. What was written since is lost."""
        if not allow_loss:
            raise UnsupportedError("going back drops what was written since; allow_loss permits it")
        last = list(self.applied().items())[-count:]
        if last:
            revert(self.store, last[0][1])
        return [n for n, _ in reversed(last)]

    def reset(self) -> list[str]:
        """Drops every table and applies all migrations again."""
        tx = self.store.begin()
        for t in list(tx.tables):
            tx.drop_table(t)
        tx.commit()
        return self.apply(allow_loss=True)

    def squash(self, name: str) -> str:
        """Puts one migration, from nothing to the models, in the place of all, which must be applied."""
        done = self.applied()
        if set(done) != set(self.names()) or not done or difference(self.store, self.registry, facts=True):
            raise UnsupportedError("only migrations that are applied and lead to the models can be squashed")
        empty = type("Empty", (), {"tables": {}})
        full, path = f"0001_{name}", self._place()
        fs = self.store._fs(path)
        fs.delete(path, True)
        self._save(full, difference(empty, self.registry, facts=True))
        tx = self.store.begin()
        tx.rewrite("_migrations", self.store.spark.createDataFrame([(full, next(iter(done.values())))], self.LOG))
        tx.commit()
        return full

    def push(self, allow_loss: bool = False) -> list[Step]:
        """Applies the difference at once, without a migration."""
        steps = difference(self.store, self.registry, facts=True)
        apply(self.store, steps, allow_loss)
        return steps
