"""State after writes, and what is refused."""

from __future__ import annotations

import pytest

from mosaiq.engine import Engine
from mosaiq.errors import ConflictError, ForeignKeyError, NestedWriteError, NotFoundError, NotNullError, UniqueConstraintError, UnsupportedError, ValidationError
from mosaiq.schema import Model, Registry, decimal, integer, many_to_many, string, to_many, to_one
from mosaiq.sources import ParquetSource
from mosaiq.sources.evolve import apply, difference, revert
from mosaiq.sources.store import SnapshotStore

REG = Registry(
    Model("user", {"id": integer(id=True, generate="increment"), "name": string(), "email": string(unique=True, nullable=True), "posts": to_many("post"), "profile": to_one("profile")}),
    Model("profile", {"id": integer(id=True), "bio": string(nullable=True), "user_id": integer(unique=True, nullable=True), "user": to_one("user", "user_id", "id", optional=True, on_delete="cascade")}),
    Model("post", {"id": integer(id=True, generate="increment"), "title": string(), "views": integer(default=0), "words": string(array=True), "price": decimal(nullable=True, precision=12, scale=2), "author_id": integer(nullable=True), "author": to_one("user", "author_id", "id", optional=True, on_delete="set_null"), "tags": many_to_many("tag")}),
    Model("tag", {"id": integer(id=True), "name": string(unique=True), "owner": integer(nullable=True), "holder": to_one("user", "owner", "id", name="own", optional=True), "posts": many_to_many("post")}),
)


@pytest.fixture
def e(spark, tmp_path):
    e = Engine(REG, SnapshotStore(spark, f"file://{tmp_path}"))
    e.create_tables()
    e.user.create_many(data=[{"name": "a", "email": "a@x"}, {"name": "b"}])
    e.post.create_many(data=[{"title": f"p{k}", "views": k, "author_id": 1} for k in (1, 2, 3)])
    return e


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def titles(e):
    return sorted((r["id"], r["title"], r["views"], r["author_id"]) for r in e.post.find_many().collect())


def test_sets_of_rows(e):
    assert rows(e.post.update_many(where={"views": {"gte": 2}}, data={"views": {"divide": -2}, "words": {"unshift": ["x", "y"]}})) == [{"count": 2}]
    assert [v for _, _, v, _ in titles(e)] == [1, -1, -1]  # toward zero
    assert rows(e.post.update_many(data={"title": "t"}, limit=0)) == [{"count": 0}]
    assert sorted(r["id"] for r in e.post.update_many(data={"price": "1.25", "words": {"push": "z"}}, limit=2, select={"id": True}).collect()) == [1, 2]
    assert e.post.find_unique(where={"id": 2}).first()["words"] == ["x", "y", "z"]
    assert rows(e.post.delete_many(where={"price": {"gt": "1.2"}}, limit=1)) == [{"count": 1}]
    assert [i for i, *_ in titles(e)] == [2, 3]
    assert rows(e.user.create_many(data=[])) == [{"count": 0}]


def test_skip_duplicates(e):
    got = e.user.create_many(data=[{"name": "x", "email": "a@x"}, {"name": "y", "email": "y"}, {"name": "z", "email": "y"}, {"name": "w"}], skip_duplicates=True)
    assert rows(got) == [{"count": 2}]
    assert sorted(r["name"] for r in e.user.find_many().collect()) == ["a", "b", "w", "y"]


def test_constraints(e):
    for call, error in (
        (lambda: e.user.create(data={"name": "x", "email": "a@x"}), UniqueConstraintError),
        (lambda: e.user.update(where={"id": 2}, data={"email": "a@x"}), UniqueConstraintError),
        (lambda: e.post.create(data={"title": "x", "author_id": 99}), ForeignKeyError),
        (lambda: e.post.update(where={"id": 1}, data={"author_id": 99}), ForeignKeyError),
        (lambda: e.user.create(data={"email": "q"}), NotNullError),
        (lambda: e.user.update(where={"id": 1}, data={"name": None}), NotNullError),
        (lambda: e.user.update(where={"id": 99}, data={"name": "x"}), NotFoundError),
        (lambda: e.post.update(where={"id": 1}, data={"views": {"divide": 0}}), ValidationError),
        (lambda: e.post.update(where={"id": 1}, data={"nope": 1}), ValidationError),
        (lambda: e.post.update_many(data={"author": {"connect": {"id": 1}}}), ValidationError),
    ):
        with pytest.raises(error):
            call()
    assert len(titles(e)) == 3 and e.user.count().first()[0] == 2


def test_referential_actions(e):
    e.profile.create(data={"id": 1, "user": {"connect": {"id": 1}}})
    e.tag.create(data={"id": 1, "name": "t", "owner": 2})
    with pytest.raises(ForeignKeyError):
        e.user.delete(where={"id": 2})
    assert rows(e.user.delete(where={"id": 1}, select={"name": True})) == [{"name": "a"}]
    assert e.profile.count().first()[0] == 0 and {a for *_, a in titles(e)} == {None}


def test_nested_create_and_connect(e):
    e.tag.create(data={"id": 1, "name": "t1"})
    made = rows(e.user.create(data={"name": "c", "posts": {"create": [{"title": "n", "tags": {"create": [{"id": 3, "name": "t3"}], "connect_or_create": [{"where": {"id": 1}, "create": {"id": 1, "name": "q"}}, {"where": {"name": "t2"}, "create": {"id": 2, "name": "t2"}}]}}], "connect": [{"id": 1}]}}, include={"posts": {"include": {"tags": {"order_by": {"id": "asc"}}}, "order_by": {"id": "asc"}}}))
    assert [p["id"] for p in made[0]["posts"]] == [1, 4] and [t["name"] for t in made[0]["posts"][1]["tags"]] == ["t1", "t2", "t3"]
    child = rows(e.post.create(data={"title": "o", "author": {"create": {"name": "d"}}}, include={"author": True}))
    assert child[0]["author"]["name"] == "d"


def test_nested_update(e):
    out = rows(e.user.update(where={"id": 1}, data={"name": "A", "posts": {"update": [{"where": {"id": 2}, "data": {"views": {"increment": 10}}}], "disconnect": [{"id": 3}], "delete": [{"id": 1}], "create": {"title": "new"}, "update_many": [{"where": {"title": "p2"}, "data": {"title": "P2"}}]}}, include={"posts": {"order_by": {"id": "asc"}}}))
    assert [(p["id"], p["title"], p["views"]) for p in out[0]["posts"]] == [(2, "P2", 12), (4, "new", 0)]
    out = rows(e.user.update(where={"id": 1}, data={"posts": {"set": [{"id": 3}]}}, include={"posts": True}))
    assert [p["id"] for p in out[0]["posts"]] == [3]
    out = rows(e.user.update(where={"id": 1}, data={"posts": {"upsert": [{"where": {"id": 3}, "create": {"title": "x"}, "update": {"title": "up"}}, {"where": {"id": 50}, "create": {"id": 50, "title": "made"}, "update": {}}], "delete_many": [{"views": 99}]}}, include={"posts": {"order_by": {"id": "asc"}}}))
    assert [(p["id"], p["title"]) for p in out[0]["posts"]] == [(3, "up"), (50, "made")]
    with pytest.raises(NestedWriteError):
        e.user.update(where={"id": 2}, data={"posts": {"update": [{"where": {"id": 3}, "data": {"title": "no"}}]}})
    with pytest.raises(NestedWriteError):
        e.user.update(where={"id": 2}, data={"posts": {"upsert": [{"where": {"id": 3}, "create": {"title": "x"}, "update": {}}]}})


def test_nested_to_one(e):
    e.user.update(where={"id": 1}, data={"profile": {"create": {"id": 5, "bio": "x"}}})
    assert rows(e.profile.find_many()) == [{"id": 5, "bio": "x", "user_id": 1}]
    e.user.update(where={"id": 1}, data={"profile": {"update": {"bio": "y"}}})
    e.user.update(where={"id": 1}, data={"profile": {"upsert": {"create": {"id": 6}, "update": {"bio": "z"}}}})
    assert e.profile.find_first().first()["bio"] == "z"
    e.profile.update(where={"id": 5}, data={"user": {"disconnect": True}})
    with pytest.raises(NestedWriteError):
        e.user.update(where={"id": 1}, data={"profile": {"update": {"bio": "y"}}})
    e.post.update(where={"id": 1}, data={"author": {"update": {"name": "via"}}})
    assert e.user.find_unique(where={"id": 1}).first()["name"] == "via"


def test_upsert(e):
    assert rows(e.user.upsert(where={"email": "n"}, create={"name": "n", "email": "n"}, update={}, select={"id": True, "name": True})) == [{"id": 3, "name": "n"}]
    e.user.upsert(where={"email": "n"}, create={"name": "?"}, update={"name": "m"}, set_where={"name": "other"})
    assert e.user.find_unique(where={"email": "n"}).first()["name"] == "n"
    e.user.upsert(where={"email": "n"}, create={"name": "?"}, update={"name": "m"}, target_where={"name": "n"})
    assert e.user.find_unique(where={"email": "n"}).first()["name"] == "m"


def test_transactions(e):
    with pytest.raises(KeyError), e.transaction() as t:
        t.user.create(data={"name": "x"})
        assert t.user.count().first()[0] == 3
        raise KeyError
    assert e.user.count().first()[0] == 2
    with e.transaction() as t:
        t.user.create(data={"name": "x"})
        with pytest.raises(ValueError), t.savepoint():
            t.user.create(data={"name": "y"})
            raise ValueError
    assert sorted(r["name"] for r in e.user.find_many().collect()) == ["a", "b", "x"]
    assert len(e.batch(lambda s: s.user.count(), lambda s: s.tag.create(data={"id": 1, "name": "t"}))) == 2
    one, two = e.source.begin(), e.source.begin()
    one.append("user", one.load("user").limit(0))
    one.rewrite("user", one.temporary(one.load("user")))
    two.rewrite("user", two.temporary(two.load("user")))
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()


def test_only_files_with_changes_are_rewritten(e):
    before = set(e.source.tables["post"]["files"])
    e.post.create(data={"title": "late"})
    e.post.update(where={"id": 4}, data={"title": "later"})
    assert before <= set(e.source.tables["post"]["files"])


def test_evolution(e):
    more = Registry(*(m if m.name != "tag" else m.extend(color=string(nullable=True)) for m in REG.models.values()))
    steps = difference(e.source, more)
    assert [(s.kind, s.table, s.column) for s in steps] == [("add_column", "tag", "color")]
    old = e.source.version()
    apply(e.source, steps)
    assert "color" in e.source.load("tag").columns and difference(e.source, more) == []
    back = difference(e.source, REG)
    with pytest.raises(UnsupportedError):
        apply(e.source, back)
    revert(e.source, old)
    assert "color" not in e.source.load("tag").columns
    assert [s.kind for s in difference(e.source, more, {"tag.name": "label"})][0] == "rename_column"


def test_reads_only_elsewhere(spark, data):
    with pytest.raises(UnsupportedError):
        Engine(REG, ParquetSource(spark, data)).user.create(data={"name": "x"})


def test_upkeep(e):
    e.post.update_many(data={"title": "t"})
    before = titles(e)
    e.source.compact("post", 1)
    assert titles(e) == before and len([f for f in e.source.tables["post"]["files"]]) == 1
    assert e.source.history()[-1]["touched"] == ["post"] and len(e.source.history()) > 2
    assert e.source.vacuum() > 0 and titles(e) == before and len(e.source.history()) == 1
    e.post.create(data={"title": "after"})
    assert len(titles(e)) == len(before) + 1
