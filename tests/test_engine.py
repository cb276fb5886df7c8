"""Options of transactions, raw statements, logs, caches, migrations, narrowed plans and refusals of writes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from mosaiq.cache import Cache, FileEntries
from mosaiq.engine import Engine
from mosaiq.errors import ConflictError, ForeignKeyError, NestedWriteError, NotNullError, TransactionError, UniqueConstraintError, UnsupportedError, ValidationError
from mosaiq.plans import sets
from mosaiq.plans.read import Reader
from mosaiq.queries import REGISTRY, reader
from mosaiq.schema import Model, Registry, big_int, decimal, enum, integer, string, to_many, to_one, vector
from mosaiq.scratch import shared_dir
from mosaiq.sources.evolve import Migrations, difference
from mosaiq.sources.store import SnapshotStore
from mosaiq.write_queries import BOOK, book


@pytest.fixture
def e(spark, data):
    return book(spark, f"{data}/sf0.001")


def test_frame_payloads_are_checked(spark, e, tmp_path):
    one = spark.createDataFrame([("x", 1)], "name string, score long")
    for bad, error in (
        (one.drop("name"), NotNullError),
        (one.withColumn("name", F.lit(None).cast("string")), NotNullError),
        (one.withColumn("id", F.lit(0)), ValidationError),
        (one.withColumn("nope", F.lit(0)), ValidationError),
        (one.withColumn("team_id", F.lit(99)), ForeignKeyError),
        (one.withColumn("id", F.lit(1)), UniqueConstraintError),
    ):
        with pytest.raises(error):
            e.person.create_many(data=bad)
    assert e.person.count().first()[0] == 25
    kinds = Registry(Model("k", {"id": string(id=True, generate="ulid"), "a": string(generate="uuid"), "b": string(generate="nanoid"), "c": string(generate="cuid"), "d": integer(default=lambda: 4), "size": enum("s", "l", default="s"), "even": integer(check=lambda v: v % 2 == 0), "place": vector(dimension=2, nullable=True), "tags": string(array=True)}))
    k = Engine(kinds, SnapshotStore(spark, f"file://{tmp_path}/k"))
    k.create_tables()
    k.k.create_many(data=spark.range(40).select((F.col("id") * 2).cast("int").alias("even")))
    rows = k.k.find_many().collect()
    assert len({r["id"] for r in rows}) == len({r["b"] for r in rows}) == 40 and all((len(r["id"]), len(r["a"]), len(r["b"]), r["c"][0], r["d"], r["size"], r["tags"]) == (26, 36, 21, "c", 4, "s", []) for r in rows)
    for column, value in (("even", F.lit(3)), ("size", F.lit("m")), ("place", F.array(F.lit(1.0)))):
        with pytest.raises(ValidationError):
            k.k.create_many(data=spark.range(1).select(F.lit(2).alias("even")).withColumn(column, value))


def test_keys_and_zero(spark, e, tmp_path):
    with pytest.raises(ValidationError):
        e.person.create(data={"id": 0, "name": "zero"})
    with pytest.raises(ValidationError):
        e.person.update(where={"id": 1}, data={"id": {"increment": 1, "set": 5}})
    exact = Registry(Model("p", {"id": decimal(id=True), "n": integer()}))
    p = Engine(exact, SnapshotStore(spark, f"file://{tmp_path}/p"))
    p.create_tables()
    p.p.create(data={"id": "1.5", "n": 1})
    with pytest.raises(ValidationError):
        p.p.update(where={"id": "1.5"}, data={"id": {"increment": 1}})


def test_writes_that_depend_on_one_another(e):
    for ops in (
        {"update": [{"where": {"id": 1}, "data": {"name": "x"}}], "delete": [{"id": 1}]},
        {"connect": [{"id": 1}], "disconnect": [{"id": 1}]},
        {"update": [{"where": {"id": 1}, "data": {"score": 0}}], "delete_many": [{"score": {"lt": 5}}]},
        {"update_many": [{"where": {"id": 1}, "data": {"name": "x"}}, {"where": {"name": "x"}, "data": {"score": 1}}]},
    ):
        with pytest.raises(NestedWriteError):
            e.team.update(where={"id": 1}, data={"members": ops})
    with pytest.raises(ValidationError):
        e.person.create(data={"name": "x", "team": {"upsert": {"where": {"id": 1}, "create": {"id": 1, "name": "y"}, "update": {}}}})


def test_transaction_options(e):
    for bad, error in (({"isolation_level": "read_committed"}, UnsupportedError), ({"isolationLevel": "nonsense"}, ValidationError), ({"max_wait": 5}, UnsupportedError), ({"timeout": 0}, ValidationError), ({"tempo": 1}, ValidationError)):
        with pytest.raises(error), e.transaction(**bad):
            pass
    with pytest.raises(ValidationError):
        e.batch(lambda s: s.person.count(), timeout=5)
    with pytest.raises(TransactionError), e.transaction(timeout=1) as t:
        t.person.create(data={"name": "late"})
    assert e.person.count().first()[0] == 25
    with pytest.raises(ConflictError), e.transaction() as t:
        seen = t.person.count().first()[0]
        e.person.create(data={"name": "between"})
        t.team.update(where={"id": 1}, data={"note": str(seen)})


def test_raw_statements(e):
    assert e.execute("insert into team (id, name) values (50, 'a, b'), (51, :n)", n="c") == 2
    assert e.execute("UPDATE team SET note = concat('(', name, ')'), name = upper(name) WHERE id >= 50;") == 2
    assert sorted(tuple(r) for r in e.team.find_many(where={"id": {"gte": 50}}).collect()) == [(50, "A, B", "(a, b)"), (51, "C", "(c)")]
    assert e.execute("DELETE FROM team WHERE id = 999") == 0
    for text, error in (("DELETE FROM nowhere", Exception), ("DROP TABLE team", UnsupportedError), ("UPDATE team SET nope = 1", ValidationError), ("INSERT INTO person (id, name, score, team_id) VALUES (60, 'x', 1, 999)", ForeignKeyError), ("UPDATE person SET team_id = 999 WHERE id = 1", ForeignKeyError), ("UPDATE team SET name = 'ASIA'", UniqueConstraintError)):
        with pytest.raises(error):
            e.execute(text)
    with e.transaction() as t:
        t.execute("UPDATE person SET score = 1")
        assert t.query("SELECT sum(score) AS s FROM person").first()["s"] == 25


def test_spans_and_records(spark, e):
    spans, queries, errors, cached = [], [], [], []
    logged = Engine(BOOK, e.source, cache=Cache(), log={"span": spans.append, "query": queries.append, "error": errors.append, "cache": cached.append})
    logged.person.update(where={"id": 1}, data={"name": "secret"})
    assert [(s["name"], s["parent"]) for s in spans] == [("mosaiq.execute", "mosaiq.transaction"), ("mosaiq.transaction", "mosaiq.operation"), ("mosaiq.operation", None)] and "secret" not in repr(spans)
    logged.person.find_many(where={"name": "secret"})
    assert queries[-1]["operation"] == "find_many" and "args" not in queries[-1] and spans[-2]["name"] == "mosaiq.build"
    with pytest.raises(ValidationError):
        logged.person.find_many(where={"nope": 1})
    assert {x["error"] for x in errors} == {"ValidationError"}
    for _ in range(2):
        logged.with_cache().team.count()
    assert [x["result"] for x in cached] == ["miss", "hit"]
    assert not list(filter(None, [Engine(BOOK, e.source, log_values=True, log={"query": queries.append}).team.find_many(where={"id": 1}) and queries[-1].get("args") != {"where": {"id": 1}}]))


def test_cache_follows_every_table_that_changed(spark, e):
    e.cache = Cache()
    c = e.with_cache(ttl="10 minutes")
    first = c.team.find_many(include={"members": True}, where={"id": 1})
    assert first is c.team.find_many(include={"members": True}, where={"id": 1}) and first.is_cached
    c.badge.count()
    e.person.update(where={"id": 1}, data={"name": "CHANGED"})
    assert "CHANGED" in repr(c.team.find_many(include={"members": True}, where={"id": 1}).collect()) and not first.is_cached
    assert any(k.startswith("badge:") for k in e.cache.entries)


def test_entries_go_when_they_may_not_be_served(spark):
    now = [0.0]
    c = Cache(clock=lambda: now[0])
    old = c.get("a", lambda: spark.range(3).persist(), ttl=1000, swr=True)
    now[0] = 1.9
    c.get("b", lambda: 1, ttl=1000)
    assert set(c.entries) == {"a", "b"} and old.is_cached
    now[0] = 2.5
    c.get("c", lambda: 1, ttl=1000)
    assert set(c.entries) == {"b", "c"} and not old.is_cached


def test_entries_in_files(spark, e, tmp_path):
    entries = FileEntries(spark, f"file://{tmp_path}/cache")
    e.cache = Cache(entries=entries)
    c = e.with_cache(ttl="10 minutes")
    assert c.team.count().first()[0] == 5 and len(entries) == 1
    other = Engine(BOOK, e.source, cache=Cache(entries=FileEntries(spark, f"file://{tmp_path}/cache"))).with_cache(ttl="10 minutes")
    assert other.team.count().first()[0] == 5 and len(entries) == 1
    e.team.create(data={"id": 9, "name": "nine"})
    assert len(entries) == 0 and c.team.count().first()[0] == 6


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_children_of_narrowed_parents_alone(spark, data):
    r = reader(spark, f"{data}/sf0.001")
    node = {"orders": {"order_by": {"o_totalprice": "desc"}, "take": 3}}
    few = plan(r.find_many("customer", where={"c_mktsegment": "BUILDING"}, take=5, include=node))
    assert re.search(r"Window.*\n(.*\n)*?.*Join LeftSemi", few)
    assert "LeftSemi" in plan(r.find_unique("customer", where={"c_custkey": 1}, include=node))
    assert "LeftSemi" in plan(r.find_many("part", where={"p_size": 3}, include={"suppliers": True}))
    assert "LeftSemi" in plan(r.find_many("customer", take=2, select={"c_custkey": True, "_count": True}))
    assert "LeftSemi" not in plan(r.find_many("customer", include=node))


def test_skip_gathers_no_table(spark, data):
    r = reader(spark, f"{data}/sf0.001")
    df = r.find_many("orders", order_by={"o_totalprice": "desc"}, skip=7, select={"o_orderkey": True})
    assert "CollectLimit" not in df._jdf.queryExecution().executedPlan().toString()
    want = [x["o_orderkey"] for x in r.find_many("orders", order_by={"o_totalprice": "desc"}, select={"o_orderkey": True}).collect()]
    have = [x["o_orderkey"] for x in df.collect()]
    assert len(have) == len(want) - 7 and set(have) <= set(want)
    assert r.find_many("region", skip=99).count() == 0


def test_long_lists_are_joined(spark, data):
    r = Reader(REGISTRY, reader(spark, f"{data}/sf0.001").source)
    many = r.find_many("orders", where={"o_orderkey": {"in": [None, *range(5000)], "gt": 10}}, select={"o_orderkey": True})
    assert "LeftSemi" in plan(many) and many.count() == r.scan(REGISTRY["orders"]).where("o_orderkey between 11 and 4999").count()
    assert "LeftSemi" not in plan(r.find_many("orders", where={"o_orderkey": {"in": [1, 2]}}))


def test_cross_joins_are_bounded(spark):
    assert sets.cross(spark.range(3), spark.range(4), most=4).count() == 12
    with pytest.raises(UnsupportedError):
        sets.cross(spark.range(3), spark.range(5), most=4)


def test_junction_writes_keep_other_files(e):
    e.person.update(where={"id": 2}, data={"skills": {"connect": [{"id": 1}]}})
    before = set(e.source.tables["person_skill"]["files"])
    e.person.update(where={"id": 2}, data={"skills": {"disconnect": [{"id": 1}]}})
    assert len(before - set(e.source.tables["person_skill"]["files"])) == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://x:7077", "app"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(type("S", (), {"sparkContext": Context()})())


def registry(**more):
    return Registry(
        Model("owner", {"id": integer(id=True), "email": string(unique=True), "size": enum("s", "l"), "pets": to_many("pet")}, indexes=(("email",),)),
        Model("pet", {"id": integer(id=True), "owner_id": integer(nullable=True), "owner": to_one("owner", "owner_id", "id", optional=True), **more}),
    )


def test_migrations(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/m")
    m = Migrations(store, registry())
    first = m.generate("start")
    assert first == "0001_start" and m.status() == [(first, False)]
    with pytest.raises(UnsupportedError):
        m.generate("again")
    assert m.apply() == [first] and m.apply() == [] and m.generate("nothing") is None and m.status() == [(first, True)]
    engine = Engine(registry(), store)
    engine.owner.create(data={"id": 1, "email": "a", "size": "s", "pets": {"create": [{"id": 1}]}})
    two = Migrations(store, registry(name=string(nullable=True)))
    second = two.generate("names")
    assert [s.kind for s in two.steps(second)] == ["add_column"] and two.apply() == [second]
    assert "name" in store.load("pet").columns and set(two.applied()) == {first, second}
    with pytest.raises(UnsupportedError):
        two.down()
    assert two.down(allow_loss=True) == [second] and "name" not in store.load("pet").columns and two.status() == [(first, True), (second, False)]
    assert two.apply() == [second] and store.load("pet").count() == 1
    assert two.squash("all") == "0001_all" and two.status() == [("0001_all", True)]
    assert two.reset() == ["0001_all"] and store.load("pet").count() == 0 and difference(store, two.registry, facts=True) == []
    wide = Migrations(store, registry(name=string(nullable=True), age=big_int(nullable=True)))
    assert [s.kind for s in wide.push()] == ["add_column"] and "age" in store.load("pet").columns


def test_facts_are_checked_against_the_rows(spark, tmp_path):
    for rows, error in (([(1, "a", "s"), (2, "a", "s")], UniqueConstraintError), ([(1, "a", "m")], ValidationError), ([(1, "a", "s"), (1, "b", "s")], UniqueConstraintError)):
        store = SnapshotStore(spark, f"file://{tmp_path}/{len(rows)}{rows[-1][1:]}".replace("'", "").replace(" ", "").replace("(", "").replace(")", ""))
        store.create_table("owner", spark.createDataFrame(rows, "id int, email string, size string"))
        store.create_table("pet", spark.createDataFrame([(1, 1)], "id int, owner_id int"))
        with pytest.raises(error):
            Migrations(store, registry()).push()
    store = SnapshotStore(spark, f"file://{tmp_path}/fk")
    store.create_table("owner", spark.createDataFrame([(1, "a", "s")], "id int, email string, size string"))
    store.create_table("pet", spark.createDataFrame([(1, 7)], "id int, owner_id int"))
    with pytest.raises(ForeignKeyError):
        Migrations(store, registry()).push()
    kinds = {s.kind for s in difference(store, registry(), facts=True)}
    assert kinds == {"add_primary_key", "add_unique", "create_index", "create_enum", "add_foreign_key"}
