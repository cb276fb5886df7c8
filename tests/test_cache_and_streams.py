from __future__ import annotations

import threading

import pytest

from mosaiq.cache import Cache, cache_key, duration
from mosaiq.engine import Engine
from mosaiq.errors import CacheError, UnsupportedError
from mosaiq.queries import QUERIES, REGISTRY
from mosaiq.sources import ParquetSource


@pytest.mark.parametrize(("text", "ms"), [("1 hour", 3_600_000), ("20seconds", 20_000), ("2.5 h", 9_000_000), ("5m", 300_000), (3000, 3000), ("1 month", 2_592_000_000)])
def test_duration(text, ms):
    assert duration(text) == ms


@pytest.mark.parametrize("text", ["", "5 parsecs", 0, -1, "0s", "h"])
def test_bad_duration(text):
    with pytest.raises(CacheError):
        duration(text)


def test_fresh_stale_and_bypass():
    now, calls, done = [0.0], [], threading.Event()
    c = Cache(clock=lambda: now[0])

    def compute():
        calls.append(1)
        if len(calls) > 1:
            done.set()
        return len(calls)

    assert c.get("k", compute, ttl=1000) == 1 and c.get("k", compute, ttl=1000) == 1
    now[0] = 1.5
    assert c.get("k", compute, ttl=1000, swr=True) == 1
    assert done.wait(5)
    now[0] = 9
    assert c.get("k", compute, ttl=1000, swr=True) == 3
    assert c.get("k", compute, ttl=1000, bypass=True) == 4
    assert c.invalidate("k*") == 1 and c.invalidate("k") == 0


def test_keys_can_not_be_forged():
    assert cache_key("m", "o", {"a": b"x"}) != cache_key("m", "o", {"a": {"$bytes": "78"}})
    assert cache_key("m", "o", {"a": 1, "b": 2}) == cache_key("m", "o", {"b": 2, "a": 1})
    assert cache_key("m", "o", {"a": 1}) != cache_key("m", "o", {"a": "1"})


def test_engine_cache(spark, data):
    e = Engine(REGISTRY, ParquetSource(spark, f"{data}/sf0.001"))
    c = e.with_cache(ttl="1 minute")
    assert c.nation.findMany(where={"n_regionkey": 1}) is c.nation.find_many(where={"n_regionkey": 1})
    with pytest.raises(UnsupportedError):
        c.nation.delete_many()
    assert e.query("SELECT count(*) AS n FROM nation WHERE n_regionkey = :k", k=1).first()["n"] == 5


def test_client_omit(spark, data):
    e = Engine(REGISTRY, ParquetSource(spark, f"{data}/sf0.001"), omit={"nation": {"n_name": True}})
    assert e.nation.find_many().columns == ["n_nationkey", "n_regionkey"]
    assert "n_name" in e.nation.find_many(omit={"n_name": False}).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
