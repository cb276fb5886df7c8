"""A result cache for reads: time to live, serving stale results while they are renewed, and invalidation by model."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import re
import threading
import time
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import CacheError
from .log import emit
from .scratch import delete, hadoop_path

DEFAULT_TTL_MS = 5 * 60 * 1000
#: Milliseconds of a unit, by its spellings.
UNITS = {
    1: ("ms", "millisecond", "milliseconds"),
    1000: ("s", "sec", "second", "seconds"),
    60_000: ("m", "min", "minute", "minutes"),
    3_600_000: ("h", "hr", "hour", "hours"),
    86_400_000: ("d", "day", "days"),
    604_800_000: ("w", "week", "weeks"),
    2_592_000_000: ("month", "months"),
}


def duration(value: str | int | float) -> int:
    """Milliseconds of a number, or of text such as "1 hour" or "2.5h"."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        ms = int(value)
    else:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([a-z]+)", str(value).strip().lower())
        unit = next((k for k, names in UNITS.items() if m and m[2] in names), None)
        if unit is None:
            raise CacheError(f"{value!r} isn't a duration")
        ms = int(float(m[1]) * unit)
    if ms <= 0:
        raise CacheError(f"{value!r} isn't a positive duration")
    return ms


def _tagged(x: Any) -> Any:
    """A JSON value that no other argument gives: types that JSON lacks are wrapped, and so are dicts that look wrapped."""
    if isinstance(x, dict):
        return {"$dict": [[str(k), _tagged(v)] for k, v in sorted(x.items(), key=lambda kv: str(kv[0]))]}
    if isinstance(x, (list, tuple)):
        return [_tagged(v) for v in x]
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, (bytes, bytearray)):
        return {"$bytes": bytes(x).hex()}
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time, decimal.Decimal)):
        return {f"${type(x).__name__}": str(x)}
    return {f"${type(x).__name__}": repr(x)}


def cache_key(model: str, operation: str, args: dict) -> str:
    return f"{model}:{operation}:{hashlib.sha256(json.dumps(_tagged(args), separators=(',', ':')).encode()).hexdigest()}"


@dataclass
class Entry:
    """stored and expires are milliseconds; tables are those that the value was read from."""

    stored: float
    expires: float
    value: Any
    tables: frozenset[str] = frozenset()


class FileEntries(MutableMapping):
    """Entries as Parquet tables and descriptions in a folder, for DataFrames that several sessions share or that are to
    outlive this one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _read(self, place: str) -> dict | None:
        path, fs = hadoop_path(self.spark, f"{place}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def __getitem__(self, key: str) -> Entry:
        said = self._read(self._place(key))
        if said is None:
            raise KeyError(key)
        return Entry(said["stored"], said["expires"], self.spark.read.parquet(said["data"]), frozenset(said["tables"]))

    def __setitem__(self, key: str, entry: Entry) -> None:
        self.pop(key, None)
        data = f"{self._place(key)}-{int(entry.stored)}"
        entry.value.write.mode("overwrite").parquet(data)
        path, fs = hadoop_path(self.spark, f"{self._place(key)}.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"key": key, "stored": entry.stored, "expires": entry.expires, "tables": sorted(entry.tables), "data": data}).encode()))
        out.close()

    def __delitem__(self, key: str) -> None:
        said = self._read(self._place(key))
        if said is None:
            raise KeyError(key)
        delete(self.spark, f"{self._place(key)}.json")
        delete(self.spark, said["data"])

    def __iter__(self) -> Iterator[str]:
        path, fs = hadoop_path(self.spark, self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return iter([said["key"] for n in names if n.endswith(".json") and (said := self._read(f"{self.folder}/{n[:-5]}"))])

    def __len__(self) -> int:
        return len(list(iter(self)))


class Cache:
    """Entries in memory, or in any other mapping of keys to entries. An entry that may not be served any more goes, with
    what Spark keeps of it, at the next access to the cache."""

    def __init__(self, clock: Callable[[], float] = time.time, entries: MutableMapping | None = None):
        self.clock, self.entries, self.renewing, self.lock = clock, {} if entries is None else entries, set(), threading.RLock()

    def get(self, key: str, compute: Callable[[], Any], ttl: str | int = DEFAULT_TTL_MS, swr: bool | str | int = False, bypass: bool = False, tables: Callable[[], frozenset[str]] = frozenset) -> Any:
        """The cached value of key. Past ttl and within the stale time it is given as it is while a thread renews it;
        bypass computes and stores anew. swr true allows as long again as ttl. tables tells what compute has read."""
        ttl_ms = duration(ttl)
        stale_ms = ttl_ms if swr is True else duration(swr) if swr else 0
        now = self.clock() * 1000
        with self.lock:
            hit = self.entries.get(key)
        if hit and not bypass:
            age = now - hit.stored
            if age < ttl_ms:
                emit("cache", key=key, result="hit")
                return hit.value
            if age < ttl_ms + stale_ms:
                emit("cache", key=key, result="stale")
                self._renew(key, compute, ttl_ms + stale_ms, tables)
                return hit.value
        emit("cache", key=key, result="bypass" if bypass else "miss")
        return self._store(key, compute(), ttl_ms + stale_ms, tables())

    def _store(self, key: str, value: Any, kept_ms: float, tables: frozenset[str]) -> Any:
        now = self.clock() * 1000
        with self.lock:
            self._drop([k for k, e in list(self.entries.items()) if e.expires <= now or k == key])
            self.entries[key] = Entry(now, now + kept_ms, value, tables)
        return value

    def _drop(self, keys: list[str]) -> int:
        for k in keys:
            entry = self.entries.get(k)
            del self.entries[k]
            if isinstance(entry.value, DataFrame) and entry.value.is_cached:
                entry.value.unpersist()
        return len(keys)

    def _renew(self, key: str, compute: Callable[[], Any], kept_ms: float, tables: Callable[[], frozenset[str]]) -> None:
        with self.lock:
            if key in self.renewing:
                return
            self.renewing.add(key)

        def work() -> None:
            try:
                self._store(key, compute(), kept_ms, tables())
            finally:
                with self.lock:
                    self.renewing.discard(key)

        threading.Thread(target=work, daemon=True).start()

    def invalidate(self, pattern: str) -> int:
        """Drops a key, or with a final * all keys that begin so; returns how many."""
        with self.lock:
            return self._drop([k for k in list(self.entries) if (k.startswith(pattern[:-1]) if pattern.endswith("*") else k == pattern)])

    def invalidate_tables(self, tables: set[str]) -> int:
        """Drops every entry that was read from one of the tables."""
        with self.lock:
            return self._drop([k for k, e in list(self.entries.items()) if e.tables & tables])
