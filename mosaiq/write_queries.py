"""A query for each write operation and each kind of field, over tables made of the test tables, and the same in SQL."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import Cache
from .engine import Engine
from .errors import MosaiqError
from .operators.predicates import DB_NULL, FieldRef
from .plans.jsonschema import argument_schemas
from .schema import Model, Registry, big_int, blob, boolean, date, date_time, decimal, enum, floating, integer, json, many_to_many, point, string, time, to_many, to_one, vector
from .scratch import hadoop_path, scratch_path
from .sources import JdbcSource, ParquetSource
from .sources.evolve import Migrations, revert
from .sources.store import SnapshotStore

BOOK = Registry(
    Model("team", {"id": integer(id=True), "name": string(unique=True), "note": string(nullable=True), "members": to_many("person")}),
    Model("person", {
        "id": integer(id=True, generate="increment"), "name": string(), "score": big_int(default=7), "team_id": integer(nullable=True),
        "team": to_one("team", "team_id", "id", optional=True, on_delete="set_null"), "badge": to_one("badge"), "skills": many_to_many("skill", "person_skill", "person_id", "skill_id"),
    }),
    Model("badge", {"id": integer(id=True), "code": string(unique=True), "person_id": integer(unique=True, nullable=True), "person": to_one("person", "person_id", "id", optional=True, on_delete="cascade")}),
    Model("skill", {"id": integer(id=True, generate="increment"), "label": string(unique=True), "people": many_to_many("person")}),
    Model("account", {"tenant": integer(), "number": big_int(), "holder": string(), "balance": decimal(precision=18, scale=2), "moves": to_many("move")}, id=("tenant", "number")),
    Model("move", {"id": big_int(id=True), "tenant": integer(nullable=True), "number": big_int(nullable=True), "account": to_one("account", ("tenant", "number"), ("tenant", "number"), optional=True)}),
    Model("thing", {
        "id": big_int(id=True), "flag": boolean(), "day": date(), "at": date_time(zone=False), "clock": time(), "size": enum("small", "large"), "other": enum("small", "large", nullable=True), "data": blob(), "spot": point(),
        "doc": json(nullable=True), "words": string(array=True), "price": decimal(precision=18, scale=2), "big": big_int(), "ratio": floating(), "place": vector(dimension=2),
    }),
)

#: The tables that every query begins with.
TABLES = {
    "team": "SELECT CAST(r_regionkey + 1 AS INT) AS id, r_name AS name, CAST(NULL AS {text}) AS note FROM region",
    "person": "SELECT CAST(n_nationkey + 1 AS INT) AS id, n_name AS name, CAST(n_nationkey * 10 AS BIGINT) AS score, CAST(n_regionkey + 1 AS INT) AS team_id FROM nation",
    "badge": "SELECT CAST(n_nationkey + 1 AS INT) AS id, concat('B', n_nationkey + 1) AS code, CAST(n_nationkey + 1 AS INT) AS person_id FROM nation WHERE n_nationkey < 20",
    "skill": "SELECT CAST(r_regionkey + 1 AS INT) AS id, concat('skill ', r_regionkey + 1) AS label FROM region",
    "person_skill": "SELECT CAST(n_nationkey + 1 AS INT) AS person_id, CAST(r_regionkey + 1 AS INT) AS skill_id FROM nation, region WHERE (n_nationkey + r_regionkey) % 4 = 0",
    "account": "SELECT CAST(s_nationkey AS INT) AS tenant, CAST(s_suppkey AS BIGINT) AS number, s_name AS holder, CAST(s_acctbal AS DECIMAL(18, 2)) AS balance FROM supplier",
    "move": "SELECT CAST(s_suppkey * 2 AS BIGINT) AS id, CAST(s_nationkey AS INT) AS tenant, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS BIGINT) END AS number FROM supplier",
    "thing": "SELECT CAST(c_custkey AS BIGINT) AS id, c_acctbal > 0 AS flag, CAST('2024-01-01' AS DATE) + CAST(c_custkey % 50 AS INT) AS day, CAST('2024-01-01 10:00:00' AS {stamp}) AS at, concat('10:0', c_custkey % 9, ':00') AS clock,"
    " CASE WHEN c_custkey % 3 = 0 THEN 'small' ELSE 'large' END AS size, CASE WHEN c_custkey % 2 = 0 THEN 'small' END AS other, {blob} AS data, {point} AS spot, concat('{{\"n\":', 9007199254740990 + c_custkey % 7, '}}') AS doc,"
    " {words} AS words, CAST(c_acctbal AS DECIMAL(18, 2)) AS price, CAST(9007199254740992 + c_custkey % 5 AS BIGINT) AS big, c_acctbal / 4 AS ratio, {place} AS place FROM customer",
}
SPARK = {"text": "STRING", "stamp": "TIMESTAMP_NTZ", "blob": "encode(c_mktsegment, 'UTF-8')", "point": "named_struct('x', CAST(c_custkey % 4 AS DOUBLE), 'y', CAST(1 AS DOUBLE))", "words": "split(c_name, '#')", "place": "array(CAST(c_custkey % 10 AS DOUBLE), CAST(2 AS DOUBLE))"}
DUCK = {"text": "VARCHAR", "stamp": "TIMESTAMP", "blob": "encode(c_mktsegment)", "point": "{'x': CAST(c_custkey % 4 AS DOUBLE), 'y': CAST(1 AS DOUBLE)}", "words": "string_split(c_name, '#')", "place": "[CAST(c_custkey % 10 AS DOUBLE), CAST(2 AS DOUBLE)]"}
_WITH = "WITH " + ", ".join(f"{t} AS ({q.format(**DUCK)})" for t, q in TABLES.items())

_BASES: dict[tuple[str, str], tuple[SnapshotStore, int]] = {}


def book(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the tables as they are at first: they are stored once, and each query goes back to that version."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BASES:
        for t in ("region", "nation", "supplier", "customer"):
            ParquetSource(spark, sf_dir).load(t).createOrReplaceTempView(t)
        store = SnapshotStore(spark, scratch_path(spark, "book"))
        tx = store.begin()
        for t, q in TABLES.items():
            tx.create_table(t, spark.sql(q.format(**SPARK)))
        _BASES[key] = store, tx.commit()
    store, version = _BASES[key]
    revert(store, version)
    return Engine(BOOK, store, **options)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str):
    def keep(f: Callable[[Engine], DataFrame]) -> Callable[[Engine], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(book(spark, sf_dir))
        ORACLES[name] = f"{_WITH} {sql}"
        return f

    return keep


def people(e: Engine) -> DataFrame:
    return e.person.find_many(select={"id": True, "name": True, "score": True, "team_id": True})


def _people(name: str, sql: str, act: Callable[[Engine], object]) -> None:
    """The people after an act. sql: of the columns id, name, score and team_id."""
    _add(name, sql)(lambda e: (act(e), people(e))[1])


def links(e: Engine) -> DataFrame:
    return e.person.find_many(include={"skills": True}).select("id", F.explode("skills.id").alias("skill_id"))


_SAME = "SELECT id, name, score, team_id FROM person"

# single records

_people("write_create", f"{_SAME} UNION ALL SELECT 26, 'NEW', 7, NULL", lambda e: e.person.create(data={"name": "NEW"}))
_people("write_create_connect", f"{_SAME} UNION ALL SELECT 26, 'NEW', 3, 2", lambda e: e.person.create(data={"name": "NEW", "score": 3, "team": {"connect": {"id": 2}}}))
_people("write_create_connect_or_create", f"{_SAME} UNION ALL SELECT 26, 'A', 7, 3 UNION ALL SELECT 27, 'B', 7, 90", lambda e: [e.person.create(data={"name": n, "team": {"connect_or_create": {"where": {"id": t}, "create": {"id": t, "name": "MADE"}}}}) for n, t in (("A", 3), ("B", 90))])
_people("write_update", "SELECT id, CASE WHEN id = 3 THEN 'X' ELSE name END AS name, score + CASE WHEN id = 3 THEN 5 ELSE 0 END AS score, team_id FROM person", lambda e: e.person.update(where={"id": 3}, data={"name": "X", "score": {"increment": 5}}))
_people("write_update_key", "SELECT CASE WHEN id = 25 THEN 125 ELSE id END AS id, name, score, team_id FROM person", lambda e: e.person.update(where={"id": 25}, data={"id": {"increment": 100}}))
_people("write_delete", f"{_SAME} WHERE id <> 25", lambda e: e.person.delete(where={"id": 25}))
_people("write_delete_set_null", "SELECT id, name, score, CASE WHEN team_id <> 2 THEN team_id END AS team_id FROM person", lambda e: e.team.delete(where={"id": 2}))
_people("write_upsert_create", f"{_SAME} UNION ALL SELECT 70, 'UP', 7, NULL", lambda e: e.person.upsert(where={"id": 70}, create={"id": 70, "name": "UP"}, update={"name": "NO"}))
_people("write_upsert_update", "SELECT id, CASE WHEN id = 7 THEN 'UP' ELSE name END AS name, score, team_id FROM person", lambda e: e.person.upsert(where={"id": 7}, create={"name": "NO"}, update={"name": "UP"}))
_people("write_upsert_conditions", "SELECT id, CASE WHEN id = 8 THEN 'YES' ELSE name END AS name, score, team_id FROM person", lambda e: [e.person.upsert(where={"id": k}, create={"name": "NO"}, update={"name": "YES"}, target_where={"score": {"lt": 100}}, set_where={"score": {"gt": s}}) for k, s in ((8, 60), (9, 90), (20, 0))])
_people("write_divide_bigint", "SELECT id, name, CASE id WHEN 1 THEN 9007199254740993 WHEN 2 THEN -9007199254740993 ELSE score END AS score, team_id FROM person",
        lambda e: [e.person.update(where={"id": k}, data={"score": x}) for k, n in ((1, 27021597764222979), (2, -27021597764222981)) for x in (n, {"divide": 3})])


@_add("write_delete_cascade", "SELECT id, code, person_id FROM badge WHERE person_id NOT IN (5, 6)")
def _(e: Engine) -> DataFrame:
    e.person.delete_many(where={"id": {"in": [5, 6]}})
    return e.badge.find_many()


@_add("write_delete_returning", "SELECT id, name FROM person WHERE id = 25")
def _(e: Engine) -> DataFrame:
    return e.person.delete(where={"id": 25}, select={"id": True, "name": True})


@_add("write_create_returning", "SELECT 26 AS id, 'NEW' AS name, 'AFRICA' AS team FROM (SELECT 1)")
def _(e: Engine) -> DataFrame:
    return e.person.create(data={"name": "NEW", "team": {"connect": {"name": "AFRICA"}}}, select={"id": True, "name": True, "team": {"select": {"name": True}}}).select("id", "name", F.col("team.name").alias("team"))


# sets of rows

_people("write_create_many_frame", f"{_SAME} UNION ALL SELECT 25 + CAST(id AS INTEGER), name || ' 2', 7, team_id FROM person WHERE id <= 10", lambda e: e.person.create_many(data=people(e).where("id <= 10").orderBy("id").coalesce(1).select(F.concat("name", F.lit(" 2")).alias("name"), "team_id")))
_people("write_create_many_mixed_rows", f"{_SAME} UNION ALL VALUES (26, 'P', 7, NULL), (27, 'Q', 1, 4), (90, 'R', 7, NULL)", lambda e: e.person.create_many(data=[{"name": "P"}, {"name": "Q", "score": 1, "team_id": 4}, {"id": 90, "name": "R"}]))
_people("write_create_many_empty", _SAME, lambda e: e.person.create_many(data=[]))
_people("raw_insert", f"{_SAME} UNION ALL SELECT id + 50, 'raw ' || name, score * 2, team_id FROM person WHERE id < 4", lambda e: e.execute("INSERT INTO person (id, name, score, team_id) SELECT id + 50, concat(:word, name), score * 2, team_id FROM person WHERE id < :most", word="raw ", most=4))
_people("raw_update", "SELECT id, CASE WHEN score > 200 THEN concat(name, ', raw') ELSE name END AS name, CASE WHEN score > 200 THEN score + 1 ELSE score END AS score, team_id FROM person", lambda e: e.execute("UPDATE person SET name = concat(name, ', raw'), score = score + :by WHERE score > 200", by=1))
_people("raw_delete", f"{_SAME} WHERE NOT (id > 22 AND score > 10)", lambda e: e.execute("DELETE FROM person WHERE id > :k AND score > 10", k=22))


@_add("raw_execute_count", "SELECT count(*) AS n FROM person WHERE team_id = 2")
def _(e: Engine) -> DataFrame:
    n = e.execute("UPDATE person SET score = 0 WHERE team_id = :t", t=2)
    return e.spark.createDataFrame([(n,)], "n long")


@_add("write_bulk_returning", "SELECT id, score * 3 AS score FROM person WHERE team_id = 1")
def _(e: Engine) -> DataFrame:
    return e.person.update_many(where={"team_id": 1}, data={"score": {"multiply": 3}}, select={"id": True, "score": True})


@_add("write_create_many_returning", "SELECT 26 AS id, 'P' AS name FROM (SELECT 1) UNION ALL SELECT 27, 'Q'")
def _(e: Engine) -> DataFrame:
    return e.person.create_many(data=[{"name": "P"}, {"name": "Q"}], omit={"score": True, "team_id": True})


@_add("write_list_push", "SELECT id, array_to_string(list_append(list_prepend('a', words), 'z'), '|') AS words FROM thing WHERE id < 20")
def _(e: Engine) -> DataFrame:
    e.thing.update_many(where={"id": {"lt": 20}}, data={"words": {"push": "z"}})
    e.thing.update_many(where={"id": {"lt": 20}}, data={"words": {"unshift": ["a"]}})
    return e.thing.find_many(where={"id": {"lt": 20}}).select("id", F.array_join("words", "|").alias("words"))


# nested writes

_people("write_nested_connect", "SELECT id, name, score, CASE WHEN id IN (2, 3) THEN 1 ELSE team_id END AS team_id FROM person", lambda e: e.team.update(where={"id": 1}, data={"members": {"connect": [{"id": 2}, {"id": 3}]}}))
_people("write_nested_disconnect", "SELECT id, name, score, CASE WHEN id <> 1 THEN team_id END AS team_id FROM person", lambda e: e.team.update(where={"id": 1}, data={"members": {"disconnect": [{"id": 1}]}}))
_people("write_nested_set", "SELECT id, name, score, CASE WHEN id IN (1, 3) THEN 1 WHEN team_id <> 1 THEN team_id END AS team_id FROM person", lambda e: e.team.update(where={"id": 1}, data={"members": {"set": [{"id": 1}, {"id": 3}]}}))
_people("write_nested_delete", f"{_SAME} WHERE id <> 1", lambda e: e.team.update(where={"id": 1}, data={"members": {"delete": [{"id": 1}]}}))
_people("write_nested_update_many", "SELECT id, name, CASE WHEN team_id = 1 AND id > 5 THEN 0 ELSE score END AS score, team_id FROM person", lambda e: e.team.update(where={"id": 1}, data={"members": {"update_many": [{"where": {"id": {"gt": 5}}, "data": {"score": 0}}]}}))
_people("write_nested_delete_many", f"{_SAME} WHERE NOT (team_id = 1 AND id > 5)", lambda e: e.team.update(where={"id": 1}, data={"members": {"delete_many": [{"id": {"gt": 5}}]}}))
_people("write_nested_create_many", f"{_SAME} UNION ALL VALUES (26, 'P', 7, 1), (27, 'Q', 7, 1)", lambda e: e.team.update(where={"id": 1}, data={"members": {"create_many": {"data": [{"name": "P"}, {"name": "Q"}]}}}))
_people("write_nested_upsert", "SELECT id, CASE WHEN id = 1 THEN 'UP' ELSE name END AS name, score, team_id FROM person UNION ALL SELECT 80, 'MADE', 7, 1", lambda e: e.team.update(where={"id": 1}, data={"members": {"upsert": [{"where": {"id": 1}, "create": {"name": "NO"}, "update": {"name": "UP"}}, {"where": {"id": 80}, "create": {"id": 80, "name": "MADE"}, "update": {"name": "NO"}}]}}))
_people("write_nested_upsert_create", "SELECT id, CASE WHEN id = 2 THEN 'TAKEN' ELSE name END AS name, score, CASE WHEN id = 2 THEN 50 ELSE team_id END AS team_id FROM person UNION ALL SELECT 80, 'MADE', 7, 50",
        lambda e: e.team.create(data={"id": 50, "name": "FRESH", "members": {"upsert": [{"where": {"id": 2}, "create": {"name": "NO"}, "update": {"name": "TAKEN"}}, {"where": {"id": 80}, "create": {"id": 80, "name": "MADE"}, "update": {"name": "NO"}}]}}))
_people("write_nested_connect_or_create", "SELECT id, name, score, CASE WHEN id = 2 THEN 1 ELSE team_id END AS team_id FROM person UNION ALL SELECT 80, 'MADE', 7, 1", lambda e: e.team.update(where={"id": 1}, data={"members": {"connect_or_create": [{"where": {"id": k}, "create": {"id": k, "name": "MADE"}} for k in (2, 80)]}}))
_people("write_nested_parent_update", "SELECT id, name, score, team_id FROM person", lambda e: e.person.update(where={"id": 1}, data={"team": {"update": {"note": "via"}}}))
_people("write_nested_parent_disconnect", "SELECT id, name, score, CASE WHEN id <> 4 THEN team_id END AS team_id FROM person", lambda e: e.person.update(where={"id": 4}, data={"team": {"disconnect": True}}))
_people("write_nested_parent_create", "SELECT id, name, score, CASE WHEN id = 4 THEN 60 ELSE team_id END AS team_id FROM person", lambda e: e.person.update(where={"id": 4}, data={"team": {"create": {"id": 60, "name": "MADE"}}}))


@_add("write_nested_child_writes", "SELECT CASE WHEN id = 1 THEN 101 ELSE id END AS id, CASE id WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' ELSE code END AS code, CASE WHEN id <> 3 THEN person_id END AS person_id FROM badge WHERE id <> 4 UNION ALL SELECT 99, 'NEW', 25")
def _(e: Engine) -> DataFrame:
    e.person.update(where={"id": 1}, data={"badge": {"update": {"id": 101, "code": "ONE"}}})
    e.person.update(where={"id": 2}, data={"badge": {"upsert": {"create": {"id": 77, "code": "NO"}, "update": {"code": "TWO"}}}})
    e.person.update(where={"id": 3}, data={"badge": {"disconnect": True}})
    e.person.update(where={"id": 4}, data={"badge": {"delete": True}})
    e.person.update(where={"id": 25}, data={"badge": {"create": {"id": 99, "code": "NEW"}}})
    return e.badge.find_many()


def _skills(name: str, sql: str, act: Callable[[Engine], object]) -> None:
    """The skills of people after an act. sql: of id and skill_id."""
    _add(name, sql)(lambda e: (act(e), links(e))[1])


_LINKS = "SELECT person_id AS id, skill_id FROM person_skill"
_skills("write_m2m_connect", f"{_LINKS} UNION SELECT 2, 1 UNION SELECT 2, 2", lambda e: e.person.update(where={"id": 2}, data={"skills": {"connect": [{"id": 1}, {"label": "skill 2"}]}}))
_skills("write_m2m_disconnect", f"{_LINKS} WHERE NOT (person_id = 1 AND skill_id = 1)", lambda e: e.person.update(where={"id": 1}, data={"skills": {"disconnect": [{"id": 1}]}}))
_skills("write_m2m_set", f"{_LINKS} WHERE person_id <> 1 UNION ALL VALUES (1, 2), (1, 3)", lambda e: e.person.update(where={"id": 1}, data={"skills": {"set": [{"id": 2}, {"id": 3}]}}))
_skills("write_m2m_create_many", f"{_LINKS} UNION ALL VALUES (2, 6), (2, 7) UNION ALL SELECT 2, 5 WHERE (2, 5) NOT IN (SELECT person_id, skill_id FROM person_skill)", lambda e: e.person.update(where={"id": 2}, data={"skills": {"create_many": {"data": [{"label": "P"}, {"label": "Q"}, {"label": "skill 5"}], "skip_duplicates": True}}}))
_skills("write_m2m_delete", f"{_LINKS} WHERE skill_id <> 1", lambda e: e.skill.delete(where={"id": 1}))


# transactions, batches, cache


@_add("write_transaction", f"{_SAME} UNION ALL SELECT 26, 'KEPT', 7, 1")
def _(e: Engine) -> DataFrame:
    with e.transaction(isolation_level="serializable", timeout=600_000) as t:
        t.person.create(data={"name": "KEPT", "team_id": 1})
    try:
        with e.transaction() as t:
            t.person.delete_many(where={"id": {"gt": 20}})
            raise KeyError("undone")
    except KeyError:
        return people(e)


@_add("write_savepoint", f"{_SAME} UNION ALL SELECT 26, 'KEPT', 7, NULL")
def _(e: Engine) -> DataFrame:
    with e.transaction() as t:
        t.person.create(data={"name": "KEPT"})
        try:
            with t.savepoint():
                t.person.create(data={"name": "LOST"})
                raise KeyError("undone")
        except KeyError:
            pass
    return people(e)


@_add("write_batch", "SELECT (SELECT count(*) FROM person) + 1 AS people, (SELECT count(*) FROM team) AS teams")
def _(e: Engine) -> DataFrame:
    counted = e.batch(lambda s: s.person.create(data={"name": "X"}), lambda s: s.person.count(), lambda s: s.team.count())
    return counted[1].select(F.col("count").alias("people")).crossJoin(counted[2].select(F.col("count").alias("teams")))  # one row each


@_add("cache_after_nested_write", "SELECT id, name, score, team_id FROM person UNION ALL SELECT 26, 'NEW', 7, 1")
def _(e: Engine) -> DataFrame:
    e.cache = Cache()
    cached = e.with_cache(ttl="10 minutes")
    for _i in range(2):
        cached.person.find_many()
    e.team.update(where={"id": 1}, data={"members": {"create": [{"name": "NEW"}]}})
    return cached.person.find_many().select("id", "name", "score", "team_id")


@_add("cache_hit", "SELECT count(*) AS entries, 'same' AS second FROM (SELECT 1)")
def _(e: Engine) -> DataFrame:
    e.cache = Cache()
    cached = e.with_cache(ttl="10 minutes", swr=True)
    one, two = cached.team.find_many(), cached.team.findMany()
    return e.spark.createDataFrame([(len(e.cache.entries), "same" if one is two else "another")], "entries long, second string")


# reads of these tables

_add("find_first_or_throw", "SELECT id, name FROM person WHERE score > 50 ORDER BY score LIMIT 1")(lambda e: e.person.find_first_or_throw(where={"score": {"gt": 50}}, order_by={"score": "asc"}, select={"id": True, "name": True}))
_add("find_unique_or_throw", "SELECT id, code FROM badge WHERE code = 'B7'")(lambda e: e.badge.find_unique_or_throw(where={"code": "B7"}, select={"id": True, "code": True}))
_add("find_unique_compound", "SELECT tenant, number, holder, balance FROM account WHERE number = (SELECT min(number) FROM account)")(lambda e: e.account.find_unique(where={"tenant_number": {k: v for k, v in e.account.find_first(order_by={"number": "asc"}).first().asDict().items() if k in ("tenant", "number")}}))
_add("include_compound", "SELECT m.id, a.holder FROM move m LEFT JOIN account a ON a.tenant = m.tenant AND a.number = m.number")(lambda e: e.move.find_many(include={"account": True}).select("id", F.col("account.holder").alias("holder")))
_add("rel_compound", "SELECT tenant, number FROM account a WHERE EXISTS (SELECT 1 FROM move m WHERE a.tenant = m.tenant AND a.number = m.number)")(lambda e: e.account.find_many(where={"moves": {"some": {}}}, select={"tenant": True, "number": True}))
_add("cursor_compound", "SELECT tenant, number FROM account WHERE tenant > (SELECT tenant FROM account WHERE number = 3) OR (tenant = (SELECT tenant FROM account WHERE number = 3) AND number >= 3) ORDER BY tenant, number LIMIT 4")(lambda e: e.account.find_many(cursor={"tenant_number": {"tenant": e.account.find_first(where={"number": 3}).first()["tenant"], "number": 3}}, take=4, select={"tenant": True, "number": True}))
_add("exist_window", "SELECT (SELECT count(*) FROM person) > 24 AS many, (SELECT count(*) FROM person) > 25 AS more")(lambda e: e.person.exist(skip=24, take=1).select(F.col("exists").alias("many")).crossJoin(e.person.exist(skip=25, take=1, order_by={"score": "desc"}).select(F.col("exists").alias("more"))))
_add("exist_cursor", "SELECT TRUE AS here FROM (SELECT 1)")(lambda e: e.person.exist(cursor={"id": 25}, take=1).select(F.col("exists").alias("here")))
_add("skip_nulls", "SELECT id, note FROM team ORDER BY note DESC NULLS FIRST, id OFFSET 2")(lambda e: e.team.find_many(order_by={"note": "desc"}, skip=2, select={"id": True, "note": True}))
_add("include_narrowed", "SELECT t.id, count(p.id) AS n, string_agg(p.name, '|' ORDER BY p.id) AS names FROM (SELECT * FROM team ORDER BY id DESC LIMIT 2) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY id) AS rn FROM person) p ON p.team_id = t.id AND p.rn <= 3 GROUP BY t.id")(lambda e: e.team.find_many(order_by={"id": "desc"}, take=2, include={"members": {"order_by": {"id": "asc"}, "take": 3}}).select("id", F.size("members").cast("long").alias("n"), F.array_join("members.name", "|").alias("names")))
_add("include_narrowed_m2m", "SELECT p.id, count(l.skill_id) AS n FROM person p LEFT JOIN person_skill l ON l.person_id = p.id WHERE p.score < 60 GROUP BY p.id")(lambda e: e.person.find_many(where={"score": {"lt": 60}}, include={"skills": True}).select("id", F.size("skills").cast("long").alias("n")))
_add("include_through_parent", "SELECT p.id, (SELECT count(*) FROM person q WHERE q.team_id = p.team_id) AS n FROM person p WHERE p.id IN (1, 2)")(lambda e: e.person.find_many(where={"id": {"in": [1, 2]}}, include={"team": {"include": {"members": True}}}).select("id", F.size("team.members").cast("long").alias("n")))
_add("count_narrowed", "SELECT id, (SELECT count(*) FROM person WHERE team_id = team.id AND score > 50) AS n FROM team WHERE id = 3")(lambda e: e.team.find_unique(where={"id": 3}, select={"id": True, "_count": {"select": {"members": {"where": {"score": {"gt": 50}}}}}}).select("id", F.col("_count.members").alias("n")))
_add("having_grouped_field", "SELECT team_id, count(*) AS n FROM person GROUP BY team_id HAVING team_id > 2")(lambda e: e.person.group_by(by="team_id", having={"team_id": {"gt": 2}}, _count=True).select("team_id", F.col("_count").alias("n")))
_add("having_and_or_not", "SELECT team_id FROM person GROUP BY team_id HAVING (sum(score) > 700 OR min(score) < 20) AND NOT max(score) > 230")(lambda e: e.person.group_by(by="team_id", having={"OR": [{"score": {"_sum": {"gt": 700}}}, {"score": {"_min": {"lt": 20}}}], "NOT": [{"score": {"_max": {"gt": 230}}}]}))
_add("group_take_skip", "SELECT team_id, sum(score) AS total FROM person GROUP BY team_id ORDER BY total DESC, team_id LIMIT 2 OFFSET 1")(lambda e: e.person.group_by(by="team_id", order_by=[{"_sum": {"score": "desc"}}, {"team_id": "asc"}], take=2, skip=1, _sum={"score": True}).select("team_id", F.col("_sum.score").alias("total")))
_add("decimal_average", "SELECT tenant, CAST(round(sum(balance) / count(*), 4) AS DOUBLE) AS mean FROM account GROUP BY tenant")(lambda e: e.account.group_by(by="tenant", _avg={"balance": True}).select("tenant", F.round(F.col("_avg.balance").cast("decimal(38,6)"), 4).cast("double").alias("mean")))
_add("order_repeated_field", "SELECT id, name FROM person ORDER BY name DESC LIMIT 3")(lambda e: e.person.find_many(order_by=[{"name": "desc"}, {"name": "asc"}], take=3, select={"id": True, "name": True}))
_add("order_by_relation_take", "SELECT p.id FROM person p LEFT JOIN team t ON t.id = p.team_id ORDER BY t.name DESC NULLS FIRST, p.id LIMIT 7")(lambda e: e.person.find_many(order_by=[{"team": {"name": "desc"}}], take=7, select={"id": True}))
_add("filter_long_in", "SELECT id FROM thing WHERE id % 2 = 0 AND id <= 2400 AND flag")(lambda e: e.thing.find_many(where={"id": {"in": list(range(0, 2401, 2))}, "flag": True}, select={"id": True}))
_add("filter_json_large_numbers", "SELECT id FROM thing WHERE 9007199254740990 + id % 7 > 9007199254740992")(lambda e: e.thing.find_many(where={"doc": {"path": ["n"], "gt": 9007199254740992}}, select={"id": True}))
_add("filter_boolean", "SELECT id FROM thing WHERE NOT flag")(lambda e: e.thing.find_many(where={"flag": False}, select={"id": True}))
_add("filter_date", "SELECT id FROM thing WHERE day >= DATE '2024-01-20' AND day < DATE '2024-02-01'")(lambda e: e.thing.find_many(where={"day": {"gte": "2024-01-20", "lt": "2024-02-01"}}, select={"id": True}))
_add("filter_time", "SELECT id FROM thing WHERE clock > '10:05:00'")(lambda e: e.thing.find_many(where={"clock": {"gt": "10:05:00"}}, select={"id": True}))
_add("filter_enum", "SELECT id FROM thing WHERE size = 'small'")(lambda e: e.thing.find_many(where={"size": "small"}, select={"id": True}))
_add("filter_enum_column", "SELECT id FROM thing WHERE size = other")(lambda e: e.thing.find_many(where={"size": {"equals": FieldRef("other")}}, select={"id": True}))
_add("filter_blob", "SELECT id FROM thing WHERE data = encode('BUILDING')")(lambda e: e.thing.find_many(where={"data": b"BUILDING"}, select={"id": True}))
_add("filter_point", "SELECT id FROM thing WHERE spot.x = 2")(lambda e: e.thing.find_many(where={"spot": {"x": 2, "y": 1}}, select={"id": True}))
_add("filter_big_int", "SELECT id, big FROM thing WHERE big > 9007199254740993")(lambda e: e.thing.find_many(where={"big": {"gt": 9007199254740993}}, select={"id": True, "big": True}))


@_add("omit_by_client", "SELECT id, name FROM team")
def _(e: Engine) -> DataFrame:
    return Engine(BOOK, e.source, omit={"team": {"note": True}}).team.find_many()


@_add("omit_by_client_overridden", "SELECT id, name, note FROM team")
def _(e: Engine) -> DataFrame:
    return Engine(BOOK, e.source, omit={"team": {"note": True}}).team.find_many(omit={"note": False})


@_add("write_every_kind", "SELECT 900001 AS id, TRUE AS flag, DATE '2024-02-29' AS day, '1999-12-31 23:59:59' AS at, '23:59:59' AS clock, 'large' AS size, CAST(NULL AS VARCHAR) AS other, '00ff' AS data, CAST(1.5 AS DOUBLE) AS x, CAST(-2 AS DOUBLE) AS y, CAST(NULL AS VARCHAR) AS doc, 'a|b c' AS words, '12345678901234.56' AS price, 9223372036854775807 AS big, CAST(0.1 AS DOUBLE) AS ratio, CAST(2.5 AS DOUBLE) AS place FROM (SELECT 1)")
def _(e: Engine) -> DataFrame:
    import datetime

    row = {"id": 900001, "flag": True, "day": datetime.date(2024, 2, 29), "at": datetime.datetime(1999, 12, 31, 23, 59, 59), "clock": "23:59:59", "size": "large", "other": None, "data": b"\x00\xff", "spot": {"x": 1.5, "y": -2}, "doc": DB_NULL, "words": ["a", "b c"], "price": "12345678901234.56", "big": 9223372036854775807, "ratio": 0.1, "place": [2.5, 1]}
    made = e.thing.create(data=row)
    return made.select("id", "flag", "day", F.col("at").cast("string").alias("at"), "clock", "size", "other", F.lower(F.hex("data")).alias("data"), "spot.x", "spot.y", "doc", F.array_join("words", "|").alias("words"), F.col("price").cast("string").alias("price"), "big", "ratio", F.get("place", F.lit(0)).alias("place"))


def people_database(e: Engine) -> str:
    """The URL of a Derby database with the people. One in memory or in a folder is open to a single process, but any number
    may read one in an archive: it is filled here and packed into the folder that driver and executors share."""
    path, fs = hadoop_path(e.spark, scratch_path(e.spark, "derby"))
    if fs.getScheme() != "file":
        raise ValueError("Derby opens mounted folders only: spark.checkpoint.dir must be one")
    folder, connect = path.toUri().getPath(), e.spark._jvm.java.sql.DriverManager.getConnection
    os.makedirs(folder)
    made = f"jdbc:derby:{folder}/book"
    c = connect(f"{made};create=true")
    c.setAutoCommit(False)
    c.createStatement().execute('CREATE TABLE person ("id" INTEGER, "name" VARCHAR(100), "score" BIGINT, "team_id" INTEGER)')
    put = c.prepareStatement('INSERT INTO person ("id", "name", "score", "team_id") VALUES (?, ?, ?, ?)')
    for k, row in enumerate(people(e).select("id", "name", "score", "team_id").toLocalIterator(), 1):
        for i, v in enumerate(row, 1):
            put.setObject(i, v)
        put.addBatch()
        if k % 1000 == 0:
            put.executeBatch()
    put.executeBatch()
    c.commit()
    c.close()
    try:
        connect(f"{made};shutdown=true")
    except Py4JJavaError as error:  # Derby reports a shutdown as an error of this state
        if error.java_exception.getSQLState() != "08006":
            raise
    archive = shutil.make_archive(f"{folder}/book", "zip", folder, "book")
    shutil.rmtree(f"{folder}/book")
    return f"jdbc:derby:jar:({archive})book"


@_add("jdbc_source", "SELECT id, name, team_id FROM person WHERE score > 100 AND name <> 'CHINA'")
def _(e: Engine) -> DataFrame:
    there = Engine(BOOK, JdbcSource(e.spark, people_database(e), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver"))
    return there.person.find_many(where={"score": {"gt": 100}, "name": {"not": "CHINA"}}, select={"id": True, "name": True, "team_id": True})


# what is refused, and with which code


def _refused(name: str, cases: dict[str, tuple[str, Callable[[Engine], object]]], made: Callable[[Engine], Engine] = lambda e: e) -> None:
    """A row for each case: its name and the code of the error; `none` if nothing was refused."""

    def run(e: Engine) -> DataFrame:
        e, rows = made(e), []
        for case, (_, act) in cases.items():
            try:
                act(e)
                rows.append((case, "none"))
            except MosaiqError as error:
                rows.append((case, error.code))
        return e.spark.createDataFrame(rows, "refused string, code string")

    listed = ", ".join("('{}', '{}')".format(case.replace("'", "''"), code) for case, (code, _) in cases.items())
    _add(name, f"SELECT * FROM (VALUES {listed}) v(refused, code)")(run)


_refused("refused_projections", {
    "empty select": ("V4001", lambda e: e.person.find_many(select={})),
    "all-false select": ("V4001", lambda e: e.person.find_many(select={"id": False})),
    "select and include": ("V4001", lambda e: e.person.find_many(select={"id": True}, include={"team": True})),
    "select and omit": ("V4001", lambda e: e.person.find_many(select={"id": True}, omit={"name": True})),
    "omit of all": ("V4001", lambda e: e.team.find_many(omit={"id": True, "name": True, "note": True})),
    "include of a field": ("V4001", lambda e: e.person.find_many(include={"name": True})),
    "unknown field": ("V4001", lambda e: e.person.find_many(select={"nope": True})),
    "count of a to-one": ("V4001", lambda e: e.person.find_many(select={"_count": {"select": {"team": True}}})),
    "two distances": ("V4001", lambda e: e.thing.find_many(select={"place": {"_distance": {"to": [1, 2], "metric": "l2"}}, "ratio": {"_distance": {"to": [1, 2], "metric": "l2"}}})),
    "relations of a bulk write": ("V4001", lambda e: e.person.update_many(where={"id": 1}, data={"score": 1}, select={"team": True})),
    "unknown model": ("V6002", lambda e: e.ghost.find_many()),
})
_refused("refused_filters", {
    "order of an enum": ("V4001", lambda e: e.thing.find_many(where={"size": {"lt": "small"}})),
    "text operator on a number": ("V4001", lambda e: e.person.find_many(where={"score": {"contains": "1"}})),
    "order of a blob": ("V4001", lambda e: e.thing.find_many(where={"data": {"gt": b"a"}})),
    "order of a vector": ("V4001", lambda e: e.thing.find_many(where={"place": {"gt": [1, 2]}})),
    "in of a point": ("V4001", lambda e: e.thing.find_many(where={"spot": {"in": [{"x": 1, "y": 1}]}})),
    "order of a boolean": ("V4001", lambda e: e.thing.find_many(where={"flag": {"gt": False}})),
    "list operator on a scalar": ("V4001", lambda e: e.thing.find_many(where={"size": {"has": "small"}})),
    "text operator on a list": ("V4001", lambda e: e.thing.find_many(where={"words": {"contains": "a"}})),
    "value outside the enum": ("V4001", lambda e: e.thing.find_many(where={"size": "medium"})),
    "vector of another length": ("V4001", lambda e: e.thing.find_many(where={"place": [1.0]})),
    "wildcard in a path": ("V4001", lambda e: e.thing.find_many(where={"doc": {"path": "$.a[*]", "equals": 1}})),
    "part of a compound key": ("V4001", lambda e: e.account.find_unique(where={"tenant_number": {"tenant": 1}})),
    "no unique key": ("V4001", lambda e: e.person.find_unique(where={"name": "CHINA"})),
    "cursor with a condition": ("V4001", lambda e: e.person.find_many(cursor={"id": 1, "name": "CHINA"})),
    "cursor under a relation's order": ("V8001", lambda e: e.team.find_many(order_by={"members": {"_count": "asc"}}, cursor={"id": 1})),
    "no row": ("V6001", lambda e: e.person.find_unique_or_throw(where={"id": 9999})),
    "having of another field": ("V4001", lambda e: e.person.group_by(by="team_id", having={"name": "CHINA"})),
    "groups from the end": ("V8001", lambda e: e.person.group_by(by="team_id", take=-1)),
    "groups by another order": ("V4001", lambda e: e.person.group_by(by="team_id", order_by={"name": "asc"})),
    "nothing to aggregate": ("V4001", lambda e: e.person.aggregate()),
    "sum of a text": ("V4001", lambda e: e.person.aggregate(_sum={"name": True})),
})
_refused("refused_writes", {
    "unique key": ("V3001", lambda e: e.team.create(data={"id": 50, "name": "ASIA"})),
    "unique key on update": ("V3001", lambda e: e.team.update(where={"id": 1}, data={"name": "ASIA"})),
    "reference": ("V3002", lambda e: e.person.create(data={"name": "x", "team_id": 999})),
    "required field": ("V3003", lambda e: e.person.create(data={"score": 1})),
    "null in a required field": ("V3003", lambda e: e.person.update(where={"id": 1}, data={"name": None})),
    "no row to update": ("V6001", lambda e: e.person.update(where={"id": 9999}, data={"name": "x"})),
    "no row to delete": ("V6001", lambda e: e.person.delete(where={"id": 9999})),
    "counted zero": ("V4001", lambda e: e.person.create(data={"id": 0, "name": "x"})),
    "two operations on a key": ("V4001", lambda e: e.person.update(where={"id": 1}, data={"id": {"increment": 1, "set": 5}})),
    "division by zero": ("V4001", lambda e: e.person.update(where={"id": 1}, data={"score": {"divide": 0}})),
    "arithmetic on text": ("V4001", lambda e: e.person.update(where={"id": 1}, data={"name": {"increment": 1}})),
    "push on a scalar": ("V4001", lambda e: e.person.update(where={"id": 1}, data={"name": {"push": "x"}})),
    "relations in a bulk write": ("V4001", lambda e: e.person.update_many(data={"team": {"connect": {"id": 1}}})),
    "negative limit": ("V4001", lambda e: e.person.delete_many(limit=-1)),
    "update and delete of one record": ("V7001", lambda e: e.team.update(where={"id": 1}, data={"members": {"update": [{"where": {"id": 1}, "data": {"name": "x"}}], "delete": [{"id": 1}]}})),
    "condition on what is set beside it": ("V7001", lambda e: e.team.update(where={"id": 1}, data={"members": {"update": [{"where": {"id": 1}, "data": {"score": 0}}], "delete_many": [{"score": {"lt": 5}}]}})),
    "another parent's record": ("V7001", lambda e: e.team.update(where={"id": 1}, data={"members": {"update": [{"where": {"id": 3}, "data": {"name": "x"}}]}})),
    "upsert of another parent's record": ("V7001", lambda e: e.team.update(where={"id": 1}, data={"members": {"upsert": [{"where": {"id": 3}, "create": {"name": "x"}, "update": {}}]}})),
    "to-one upsert under create": ("V4001", lambda e: e.person.create(data={"name": "x", "team": {"upsert": {"where": {"id": 1}, "create": {"id": 1, "name": "y"}, "update": {}}}})),
    "isolation level": ("V8001", lambda e: e.batch(lambda s: s.person.count(), isolation_level="read_committed")),
    "write through the cache": ("V8001", lambda e: e.with_cache().person.delete_many()),
})


def _strict(e: Engine) -> Engine:
    """The same tables, with a team that a person can't be without."""
    return Engine(Registry(
        Model("team", {"id": integer(id=True), "name": string(unique=True), "note": string(nullable=True), "members": to_many("person")}),
        Model("person", {"id": integer(id=True), "name": string(), "score": big_int(default=7), "team_id": integer(), "team": to_one("team", "team_id", "id")}),
    ), e.source)


_refused("refused_orphans", {
    "disconnect": ("V7001", lambda e: e.team.update(where={"id": 1}, data={"members": {"disconnect": [{"id": 1}]}})),
    "set without it": ("V7001", lambda e: e.team.update(where={"id": 1}, data={"members": {"set": [{"id": 3}]}})),
    "delete of the parent": ("V3002", lambda e: e.team.delete(where={"id": 1})),
    "create without a parent": ("V3003", lambda e: e.person.create(data={"id": 90, "name": "x"})),
}, _strict)


# updates by kind, schema changes


@_add("write_update_every_kind", "SELECT id, NOT flag AS flag, DATE '2020-02-29' AS day, '2021-03-04 05:06:07' AS at, '01:02:03' AS clock, 'small' AS size, CAST(NULL AS VARCHAR) AS other, '0001' AS data, 3 AS x, 'q' AS words, CAST((CAST(price * 4 AS DECIMAL(18, 2)) + 1.25) AS VARCHAR) AS price, big - 9007199254740992 AS big, ratio * 2 - 1 AS ratio, 9 AS place FROM thing WHERE id < 30")
def _(e: Engine) -> DataFrame:
    import datetime

    where = {"id": {"lt": 30}}
    for flag in (True, False):
        e.thing.update_many(where={**where, "flag": flag, "size": {"in": ["small", "large"]}, "clock": {"not": "23:00:00"}}, data={"flag": not flag, "clock": "23:00:00"})
    e.thing.update_many(where=where, data={
        "day": datetime.date(2020, 2, 29), "at": {"set": datetime.datetime(2021, 3, 4, 5, 6, 7)}, "clock": "01:02:03", "size": "small", "other": None, "data": b"\x00\x01", "spot": {"x": 3, "y": 4}, "words": {"set": ["q"]},
        "price": {"multiply": 4}, "big": {"decrement": 9007199254740992}, "ratio": {"divide": 0.5}, "place": [9, 8],
    })
    e.thing.update_many(where=where, data={"price": {"increment": "1.25"}, "ratio": {"decrement": 1}})
    got = e.thing.find_many(where=where)
    return got.select("id", "flag", "day", F.col("at").cast("string").alias("at"), "clock", "size", "other", F.lower(F.hex("data")).alias("data"), F.col("spot.x").cast("int").alias("x"), F.array_join("words", "|").alias("words"), F.col("price").cast("string").alias("price"), "big", "ratio", F.get("place", F.lit(0)).cast("int").alias("place"))


def _pets(**more) -> Registry:
    return Registry(
        Model("owner", {"id": integer(id=True), "email": string(unique=True), "pets": to_many("pet")}, indexes=(("email",),)),
        Model("pet", {"id": integer(id=True), "owner_id": integer(nullable=True), "owner": to_one("owner", "owner_id", "id", optional=True), **more}),
    )


_STEPS = (
    "(1, 'generate', '0001_start'), (2, 'pending', '0001_start'), (3, 'apply', '0001_start'), (4, 'apply', ''), (5, 'generate', '0002_name'), (6, 'steps', 'add_column'), (7, 'apply', '0002_name'), (8, 'columns', 'id,name,owner_id'),"
    " (9, 'down', '0002_name'), (10, 'columns', 'id,owner_id'), (11, 'rows', '1'), (12, 'pending', '0002_name'), (13, 'apply', '0002_name'), (14, 'squash', '0001_all'), (15, 'pending', ''), (16, 'reset', '0001_all'), (17, 'rows', '0'), (18, 'push', 'add_column'), (19, 'columns', 'age,id,name,owner_id')"
)


@_add("migrations", f"SELECT * FROM (VALUES {_STEPS}) v(place, step, result)")
def _(e: Engine) -> DataFrame:
    store = SnapshotStore(e.spark, scratch_path(e.spark, "migrations"))
    one, two = Migrations(store, _pets()), Migrations(store, _pets(name=string(nullable=True)))
    rows: list[tuple[int, str, str]] = []

    def note(step: str, result: object) -> None:
        rows.append((len(rows) + 1, step, ",".join(result) if isinstance(result, list) else str(result)))

    def columns() -> None:
        note("columns", sorted(store.load("pet").columns))

    def pending(m: Migrations) -> None:
        note("pending", [name for name, done in m.status() if not done])

    note("generate", one.generate("start"))
    pending(one)
    note("apply", one.apply())
    note("apply", one.apply())
    Engine(_pets(), store).owner.create(data={"id": 1, "email": "a", "pets": {"create": [{"id": 1}]}})
    note("generate", second := two.generate("name"))
    note("steps", [s.kind for s in two.steps(second)])
    note("apply", two.apply())
    columns()
    note("down", two.down(allow_loss=True))
    columns()
    note("rows", store.load("pet").count())
    pending(two)
    note("apply", two.apply())
    note("squash", two.squash("all"))
    pending(two)
    note("reset", two.reset())
    note("rows", store.load("pet").count())
    note("push", [s.kind for s in Migrations(store, _pets(name=string(nullable=True), age=big_int(nullable=True))).push()])
    columns()
    return e.spark.createDataFrame(rows, "place int, step string, result string")


_ORDERED = "equals,gt,gte,in,lt,lte,not,not_in"
_FILTERS = {
    "id": _ORDERED, "flag": "equals,not", "day": _ORDERED, "at": _ORDERED, "clock": _ORDERED, "size": "equals,in,not,not_in", "data": "equals,in,not,not_in", "spot": "equals,not", "words": "equals,has,has_every,has_some,is_empty,not",
    "price": _ORDERED, "big": _ORDERED, "ratio": _ORDERED, "place": "equals,not",
}


@_add("schema_filters", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FILTERS.items()) + ") v(field, operators)")
def _(e: Engine) -> DataFrame:
    """The filters of each kind of field, from the exported JSON Schema."""
    defs = argument_schemas(BOOK, "thing")["$defs"]
    return e.spark.createDataFrame([(k, ",".join(sorted(defs[f"thing.{k}"]["properties"]))) for k in _FILTERS], "field string, operators string")
