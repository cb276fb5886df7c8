"""A query for each operator over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import vocabulary as fn
from .operators.predicates import ANY_NULL, DB_NULL, JSON_NULL, FieldRef
from .plans import sets
from .plans.read import Reader
from .schema import Model, Registry, Relation, big_int, date_time, decimal, floating, integer, json, many_to_many, string, to_many, to_one, vector
from .scratch import scratch_path
from .sources import FrameSource, LayeredSource, ParquetSource, query
from .sources.store import SnapshotStore
from .streaming import find_stream, group_stream
from .write_queries import ORACLES as WRITE_ORACLES
from .write_queries import QUERIES as WRITE_QUERIES

REGISTRY = Registry(
    Model("region", {"r_regionkey": integer(id=True), "r_name": string(), "nations": to_many("nation")}),
    Model("nation", {
        "n_nationkey": integer(id=True), "n_name": string(), "n_regionkey": integer(), "region": to_one("region", "n_regionkey", "r_regionkey"),
        "customers": to_many("customer"), "suppliers": to_many("supplier"),
    }),
    Model("customer", {
        "c_custkey": big_int(id=True), "c_name": string(), "c_nationkey": integer(), "c_acctbal": floating(), "c_mktsegment": string(),
        "nation": to_one("nation", "c_nationkey", "n_nationkey"), "orders": to_many("orders"), "events": to_many("events"),
    }),
    Model("supplier", {
        "s_suppkey": big_int(id=True), "s_name": string(), "s_nationkey": integer(), "s_acctbal": floating(),
        "nation": to_one("nation", "s_nationkey", "n_nationkey"), "parts": many_to_many("part", "part_supplier", "l_suppkey", "l_partkey"),
    }),
    Model("part", {
        "p_partkey": big_int(id=True), "p_name": string(), "p_brand": string(), "p_type": string(), "p_size": integer(), "p_retailprice": floating(),
        "lines": to_many("lineitem"), "suppliers": many_to_many("supplier"),
    }),
    Model("orders", {
        "o_orderkey": big_int(id=True), "o_custkey": big_int(), "o_orderstatus": string(), "o_totalprice": floating(), "o_orderdate": date_time(zone=False), "o_orderpriority": string(),
        "customer": to_one("customer", "o_custkey", "c_custkey"), "lines": to_many("lineitem"),
    }),
    Model("lineitem", {
        "l_orderkey": big_int(), "l_partkey": big_int(), "l_suppkey": big_int(), "l_linenumber": integer(), "l_quantity": floating(), "l_extendedprice": floating(), "l_discount": floating(), "l_tax": floating(),
        "l_returnflag": string(), "l_linestatus": string(), "l_shipdate": date_time(zone=False), "order": to_one("orders", "l_orderkey", "o_orderkey"), "part": to_one("part", "l_partkey", "p_partkey"),
    }),
    Model("events", {
        "event_id": big_int(id=True), "ts": date_time(zone=False), "user_id": big_int(), "event_type": string(), "value": floating(), "props": json(),
        "customer": to_one("customer", "user_id", "c_custkey"),
    }),
    Model("documents", {"doc_id": big_int(id=True), "text": string(), "lang": string(), "source": string(), "n_chars": big_int(), "label": to_one("labels")}),
    Model("labels", {"doc_id": big_int(id=True), "quality": integer(), "toxic": integer(), "document": to_one("documents", "doc_id", "doc_id")}),
    Model("embeddings", {"vec_id": big_int(id=True), "embedding": vector(dimension=64), "label": integer()}),
    Model("money", {"o_orderkey": big_int(id=True), "o_orderpriority": string(), "amount": decimal(precision=18, scale=2, column="o_totalprice")}, table="orders_money"),
)


def reader(spark: SparkSession, sf_dir: str) -> Reader:
    files = ParquetSource(spark, sf_dir)
    derived = FrameSource(spark, {
        "part_supplier": lambda: files.load("lineitem").select("l_partkey", "l_suppkey").distinct(),
        "orders_money": lambda: files.load("orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")),
    })
    return Reader(REGISTRY, LayeredSource(derived, files))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str):
    def keep(f: Callable[[Reader], DataFrame]) -> Callable[[Reader], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(reader(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return keep


def find(name: str, model: str, sql: str, **args) -> None:
    _add(name, sql)(lambda r: r.find_many(model, **args))


def flat(df: DataFrame, *cols: str) -> DataFrame:
    """Struct members as columns named after their path: _sum.x becomes sum_x."""
    return df.select(*(F.col(c).alias(c.lstrip("_").replace("._", "_").replace(".", "_")) for c in cols))


# scans, filters

find(
    "find_many_relation_top", "orders",
    "SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    where={"o_orderstatus": "F", "customer": {"is": {"c_mktsegment": "BUILDING"}}}, order_by=[{"o_totalprice": "desc"}], take=10, select={"o_orderkey": True, "o_totalprice": True},
)
find("scan_default_projection", "customer", "SELECT * FROM customer")
find("omit_fields", "customer", "SELECT c_custkey, c_name, c_nationkey FROM customer", omit={"c_acctbal": True, "c_mktsegment": True})
find("filter_comparisons", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderdate > TIMESTAMP '1995-01-01' AND o_orderstatus <> 'P'",
     where={"o_totalprice": {"gte": 1000.0, "lt": 200000.0}, "o_orderdate": {"gt": "1995-01-01 00:00:00"}, "o_orderstatus": {"not": "P"}}, select={"o_orderkey": True})
find("filter_or_not_mix", "customer", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT (c_nationkey = 3) AND NOT (c_nationkey = 5)",
     where={"OR": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"lt": 0.0}}], "NOT": [{"c_nationkey": 3}, {"c_nationkey": 5}]}, select={"c_custkey": True})
find("filter_empty_or", "customer", "SELECT c_custkey FROM customer WHERE FALSE", where={"OR": []}, select={"c_custkey": True})
find("filter_empty_and_not", "customer", "SELECT c_custkey FROM customer", where={"AND": [], "NOT": {}}, select={"c_custkey": True})
find("filter_in_lists", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT')",
     where={"o_orderstatus": {"in": ["F", "O"]}, "o_orderpriority": {"not_in": ["1-URGENT"]}}, select={"o_orderkey": True})
find("filter_in_empty", "orders", "SELECT o_orderkey FROM orders WHERE FALSE", where={"o_orderstatus": {"in": []}, "o_orderpriority": {"notIn": []}}, select={"o_orderkey": True})
find("filter_text_family", "part", "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND starts_with(p_brand, 'Brand') AND ends_with(p_type, 'L')",
     where={"p_name": {"contains": "a"}, "p_brand": {"starts_with": "Brand"}, "p_type": {"endsWith": "L"}}, select={"p_partkey": True})
find("filter_insensitive", "part", "SELECT p_partkey FROM part WHERE contains(translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'bra') OR translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'brand#11'",
     where={"OR": [{"p_type": {"contains": "BRA", "mode": "insensitive"}}, {"p_brand": {"equals": "bRAND#11", "mode": "insensitive"}}]}, select={"p_partkey": True})
find("filter_nested_not", "orders", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000 AND NOT (o_totalprice > 1000))",
     where={"o_totalprice": {"not": {"lt": 50000.0, "not": {"gt": 1000.0}}}}, select={"o_orderkey": True})
find("filter_field_ref", "lineitem", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount < l_tax",
     where={"l_discount": {"lt": FieldRef("l_tax")}}, select={"l_orderkey": True, "l_linenumber": True, "l_discount": True, "l_tax": True})
find("filter_callback_and_column", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = l_discount AND l_quantity > l_linenumber * 10",
     where={"l_tax": lambda m: m.l_discount, "l_quantity": {"gt": lambda m: F.col("l_linenumber") * 10}}, select={"l_orderkey": True, "l_linenumber": True})

# relations

find("rel_some", "customer", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", where={"orders": {"some": {"o_totalprice": {"gt": 400000.0}}}}, select={"c_custkey": True})
find("rel_every", "customer", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice < 400000))", where={"orders": {"every": {"o_totalprice": {"lt": 400000.0}}}}, select={"c_custkey": True})
find("rel_none", "documents", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", where={"label": {"is": None}}, select={"doc_id": True})
find("rel_none_where", "customer", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", where={"orders": {"none": {"o_orderstatus": "F"}}}, select={"c_custkey": True})
find("rel_is_nested", "orders", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = o_custkey AND r_name = 'ASIA')",
     where={"customer": {"nation": {"is": {"region": {"is": {"r_name": "ASIA"}}}}}}, select={"o_orderkey": True})
find("rel_is_not", "documents", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)", where={"label": {"isNot": {"quality": 1}}}, select={"doc_id": True})
find("rel_is_not_null", "documents", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", where={"label": {"is_not": None}}, select={"doc_id": True})
find("rel_m2m_some", "part", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000)", where={"suppliers": {"some": {"s_acctbal": {"gt": 9000.0}}}}, select={"p_partkey": True})
find("rel_m2m_every", "supplier", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND NOT (p_size >= 1))", where={"parts": {"every": {"p_size": {"gte": 1}}}}, select={"s_suppkey": True})
find("rel_under_or", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
     where={"OR": [{"c_acctbal": {"lt": -900.0}}, {"orders": {"some": {"o_totalprice": {"gt": 450000.0}}}}]}, select={"c_custkey": True})
find("rel_under_not", "nation", "SELECT n_nationkey FROM nation WHERE NOT (EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AND n_regionkey < 3)",
     where={"NOT": {"customers": {"some": {"c_acctbal": {"gt": 9900.0}}}, "n_regionkey": {"lt": 3}}}, select={"n_nationkey": True})

# projections


@_add("rel_count_select", "SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def _(r: Reader) -> DataFrame:
    return r.find_many("nation", select={"n_nationkey": True, "_count": {"select": {"customers": True, "suppliers": {"where": {"s_acctbal": {"gt": 0.0}}}}}}).select("n_nationkey", "_count.customers", "_count.suppliers")


@_add("include_to_one", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def _(r: Reader) -> DataFrame:
    return r.find_many("orders", where={"o_totalprice": {"gt": 300000.0}}, include={"customer": {"include": {"nation": True}}}).select("o_orderkey", "customer.c_name", "customer.nation.n_name")


@_add("include_missing_to_one", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(r: Reader) -> DataFrame:
    return r.find_many("documents", select={"doc_id": True, "label": {"select": {"quality": True}}}).select("doc_id", "label.quality")


@_add("include_window", """SELECT c_custkey, o_orderkey, rn - 1 AS place FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS rn
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P') WHERE rn > 1 AND rn <= 4""")
def _(r: Reader) -> DataFrame:
    df = r.find_many("customer", select={"c_custkey": True, "orders": {"where": {"o_orderstatus": {"not": "P"}}, "order_by": {"o_totalprice": "desc"}, "take": 3, "skip": 1, "select": {"o_orderkey": True}}})
    return df.select("c_custkey", F.posexplode("orders")).select("c_custkey", F.col("col.o_orderkey"), (F.col("pos") + 1).cast("long").alias("place"))


@_add("include_negative_take", "SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) JOIN customer ON o_custkey = c_custkey WHERE rn <= 2")
def _(r: Reader) -> DataFrame:
    df = r.find_many("customer", select={"c_custkey": True, "orders": {"order_by": {"o_orderdate": "asc"}, "take": -2, "select": {"o_orderkey": True}}})
    return df.select("c_custkey", F.posexplode("orders")).select("c_custkey", F.col("col.o_orderkey"), F.col("pos").cast("long").alias("place"))


@_add("include_two_levels", """SELECT n_nationkey, c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS cr FROM customer)
  JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS orr FROM orders) ON o_custkey = c_custkey WHERE cr <= 3 AND orr <= 2""")
def _(r: Reader) -> DataFrame:
    inner = {"order_by": {"o_totalprice": "asc"}, "take": 2}
    df = r.find_many("nation", include={"customers": {"order_by": {"c_acctbal": "desc"}, "take": 3, "include": {"orders": inner}}})
    return df.select("n_nationkey", F.explode("customers").alias("c")).select("n_nationkey", "c.c_custkey", F.explode("c.orders").alias("o")).select("n_nationkey", "c_custkey", "o.o_orderkey")


@_add("include_m2m", "SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 1")
def _(r: Reader) -> DataFrame:
    df = r.find_many("part", where={"p_size": 1}, include={"suppliers": True})
    return df.select("p_partkey", F.explode("suppliers").alias("s")).select("p_partkey", "s.s_suppkey")


@_add("include_distinct", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey WHERE rn = 1")
def _(r: Reader) -> DataFrame:
    df = r.find_many("customer", select={"c_custkey": True, "orders": {"distinct": ["o_orderstatus"], "order_by": {"o_totalprice": "desc"}}})
    return df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")


@_add("vector_select_cosine", "SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings")
def _(r: Reader) -> DataFrame:
    to = [float(x) for x in r.scan(REGISTRY["embeddings"]).where("vec_id = 0").first()["embedding"]]
    return r.find_many("embeddings", select={"vec_id": True, "embedding": {"_distance": {"to": to, "metric": "cosine"}}}).select("vec_id", (F.round("_distance", 6) + 0.0).alias("distance"))


@_add("vector_order_l2", "SELECT vec_id FROM embeddings ORDER BY round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 9), vec_id LIMIT 10")
def _(r: Reader) -> DataFrame:
    to = [float(x) for x in r.scan(REGISTRY["embeddings"]).where("vec_id = 7").first()["embedding"]]
    return r.find_many("embeddings", order_by={"embedding": {"_distance": {"to": to, "metric": "l2"}}}, take=10, select={"vec_id": True})


# order, cursors, windows

find("order_take_skip", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", order_by=[{"o_orderdate": "asc"}, {"o_totalprice": "desc"}], take=20, skip=5, select={"o_orderkey": True})
find("take_negative", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7", order_by={"o_totalprice": "asc"}, take=-7, select={"o_orderkey": True})
find("take_zero", "orders", "SELECT o_orderkey FROM orders WHERE FALSE", take=0, select={"o_orderkey": True})
find("skip_only", "nation", "SELECT n_nationkey FROM nation ORDER BY n_name, n_nationkey OFFSET 4", order_by={"n_name": "asc"}, skip=4, select={"n_nationkey": True})
find("cursor_forward", "orders", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) >= (SELECT (o_custkey, o_orderkey) FROM orders WHERE o_orderkey = 100) ORDER BY o_custkey, o_orderkey LIMIT 5",
     order_by={"o_custkey": "asc"}, cursor={"o_orderkey": 100}, take=5, select={"o_orderkey": True})
find("cursor_backward", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 100 ORDER BY o_orderkey DESC LIMIT 5", cursor={"o_orderkey": 100}, take=-5, select={"o_orderkey": True})
find("cursor_mixed_order", "orders", """SELECT o.o_orderkey FROM orders o, (SELECT * FROM orders WHERE o_orderkey = 57) c WHERE o.o_orderpriority < c.o_orderpriority
  OR (o.o_orderpriority = c.o_orderpriority AND (o.o_totalprice > c.o_totalprice OR (o.o_totalprice = c.o_totalprice AND o.o_orderkey >= c.o_orderkey)))""",
     order_by=[{"o_orderpriority": "desc"}, {"o_totalprice": "asc"}], cursor={"o_orderkey": 57}, select={"o_orderkey": True})
find("cursor_missing", "orders", "SELECT o_orderkey FROM orders WHERE FALSE", cursor={"o_orderkey": -1}, take=5, select={"o_orderkey": True})
find("distinct_first", "orders", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 12",
     distinct=["o_custkey"], order_by={"o_totalprice": "desc"}, take=12, select={"o_orderkey": True, "o_custkey": True})
find("order_by_relation", "customer", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY r_name DESC, n_name, c_custkey LIMIT 15",
     order_by=[{"nation": {"region": {"r_name": "desc"}}}, {"nation": {"n_name": "asc"}}], take=15, select={"c_custkey": True})
find("order_by_relation_count", "customer", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY coalesce(n, 0) DESC, c_custkey LIMIT 15",
     order_by={"orders": {"_count": "desc"}}, take=15, select={"c_custkey": True})


@_add("find_first", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 1")
def _(r: Reader) -> DataFrame:
    return r.find_first("orders", where={"o_orderstatus": "O"}, order_by={"o_totalprice": "asc"}, select={"o_orderkey": True})


@_add("find_first_last", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(r: Reader) -> DataFrame:
    return r.find_first("orders", order_by={"o_orderdate": "asc"}, take=-3, select={"o_orderkey": True})


@_add("find_unique", "SELECT * FROM orders WHERE o_orderkey = 42 AND o_totalprice > 0")
def _(r: Reader) -> DataFrame:
    return r.find_unique("orders", where={"o_orderkey": 42, "o_totalprice": {"gt": 0.0}})


# aggregates


@_add("count_all", "SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'")
def _(r: Reader) -> DataFrame:
    return r.count("lineitem", where={"l_returnflag": "R"})


@_add("count_fields", "SELECT count(*) AS _all, count(o_totalprice) AS o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 10)")
def _(r: Reader) -> DataFrame:
    return r.count("orders", select={"_all": True, "o_totalprice": True}, order_by={"o_orderdate": "asc"}, take=100, skip=10)


@_add("exist", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS exists")
def _(r: Reader) -> DataFrame:
    return r.exist("orders", where={"o_totalprice": {"gt": 400000.0}})


@_add("aggregate_window", "SELECT count(*) AS count_all, round(sum(o_totalprice), 2) AS sum_price, round(avg(o_totalprice), 2) AS avg_price, min(o_orderdate) AS min_date, max(o_orderkey) AS max_key FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def _(r: Reader) -> DataFrame:
    df = r.aggregate("orders", where={"o_orderstatus": "F"}, order_by={"o_totalprice": "desc"}, take=50, _count={"_all": True}, _sum={"o_totalprice": True}, _avg={"o_totalprice": True}, _min={"o_orderdate": True}, _max={"o_orderkey": True})
    return df.select(F.col("_count._all").alias("count_all"), F.round("_sum.o_totalprice", 2).alias("sum_price"), F.round("_avg.o_totalprice", 2).alias("avg_price"), F.col("_min.o_orderdate").alias("min_date"), F.col("_max.o_orderkey").alias("max_key"))


@_add("aggregate_empty", "SELECT count(o_totalprice) AS count_o_totalprice, sum(o_totalprice) AS sum_o_totalprice, max(o_orderkey) AS max_o_orderkey FROM orders WHERE FALSE")
def _(r: Reader) -> DataFrame:
    return flat(r.aggregate("orders", where={"OR": []}, _count={"o_totalprice": True}, _sum={"o_totalprice": True}, _max={"o_orderkey": True}), "_count.o_totalprice", "_sum.o_totalprice", "_max.o_orderkey")


@_add("group_having_order", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_quantity > 2 GROUP BY ALL HAVING sum(l_quantity) > 100 AND (l_returnflag <> 'N' OR count(l_tax) > 5) ORDER BY sum(l_quantity) DESC LIMIT 4")
def _(r: Reader) -> DataFrame:
    df = r.group_by("lineitem", by=["l_returnflag", "l_linestatus"], where={"l_quantity": {"gt": 2.0}}, having={"l_quantity": {"_sum": {"gt": 100.0}}, "OR": [{"l_returnflag": {"not": "N"}}, {"l_tax": {"_count": {"gt": 5}}}]}, order_by={"_sum": {"l_quantity": "desc"}}, take=4, _count=True, _sum={"l_quantity": True}, _avg={"l_discount": True})
    return df.select("l_returnflag", "l_linestatus", F.col("_count").alias("n"), F.round("_sum.l_quantity", 2).alias("qty"), F.round("_avg.l_discount", 6).alias("disc"))


@_add("group_distinct_only", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(r: Reader) -> DataFrame:
    return r.group_by("orders", by=["o_orderstatus", "o_orderpriority"])


@_add("decimal_sum", "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS VARCHAR) AS total FROM orders GROUP BY o_orderpriority HAVING sum(CAST(o_totalprice AS DECIMAL(18, 2))) > 1000.50")
def _(r: Reader) -> DataFrame:
    df = r.group_by("money", by="o_orderpriority", having={"amount": {"_sum": {"gt": "1000.50"}}}, _sum={"amount": True})
    return df.select("o_orderpriority", F.col("_sum.amount").cast("string").alias("total"))


# json, lists and nulls

find("json_path_number", "events", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 AND contains(props, 'k')", where={"props": {"path": ["k"], "gt": 50}}, select={"event_id": True})
find("json_path_equals", "events", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7", where={"props": {"path": "$.k", "equals": 7}}, select={"event_id": True})


def _inline(name: str, schema: str, rows: list, model: Model, sql: str, columns: dict | None = None, **args) -> None:
    """A query over literal rows; sql follows VALUES named t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Reader(Registry(model), FrameSource(spark, {model.table: spark.createDataFrame(rows, schema)}))
        return r.find_many(model.name, **args)

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(text, v)) + "]"
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "decimal(38,18)": "DECIMAL(38,18)"}
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(", ")]
    casts = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in cols)
    QUERIES[name] = run
    ORACLES[name] = f"WITH v({', '.join(n for n, _ in cols)}) AS (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}), t AS (SELECT {casts} FROM v) {sql}"


_LISTS = Model("lists", {"id": big_int(id=True), "tags": string(array=True, nullable=True), "scores": integer(array=True, nullable=True)})
_LIST_ROWS = [(1, ["a", "b"], [1, 2]), (2, [], [3]), (3, None, None), (4, ["b", "a"], [2, 1]), (5, ["a", "a"], []), (6, ["x"], [9])]
_LIST_SCHEMA = "id bigint, tags array<string>, scores array<int>"
for _name, _where, _sql in (
    ("list_equals", {"tags": {"equals": ["a", "b"]}}, "tags = ['a', 'b']"),
    ("list_not", {"tags": {"not": ["a", "b"]}}, "tags <> ['a', 'b']"),
    ("list_has", {"tags": {"has": "a"}}, "list_contains(tags, 'a')"),
    ("list_has_every", {"tags": {"has_every": ["a", "b"]}}, "list_contains(tags, 'a') AND list_contains(tags, 'b')"),
    ("list_has_some", {"scores": {"hasSome": [3, 9]}}, "list_has_any(scores, [3, 9])"),
    ("list_is_empty", {"tags": {"is_empty": True}}, "tags IS NULL OR len(tags) = 0"),
    ("list_not_empty", {"scores": {"isEmpty": False}}, "NOT (scores IS NULL OR len(scores) = 0)"),
):
    _inline(_name, _LIST_SCHEMA, _LIST_ROWS, _LISTS, f"SELECT id FROM t WHERE {_sql}", where=_where, select={"id": True})

_DOCS = Model("docs", {"id": big_int(id=True), "meta": json(nullable=True)})
_DOC_ROWS = [(1, None), (2, "null"), (3, '{"a":{"b":[1,2,3]},"n":5,"s":"Hello"}'), (4, '{"a":{"b":[]},"n":"5","s":"help"}'), (5, "[1,2]"), (6, '{"n":null}'), (7, '{"n":7.5,"s":"x%y"}')]
for _name, _where, _sql in (
    ("json_db_null", {"meta": {"equals": DB_NULL}}, "meta IS NULL"),
    ("json_json_null", {"meta": {"equals": JSON_NULL}}, "meta = 'null'"),
    ("json_any_null", {"meta": {"equals": ANY_NULL}}, "meta IS NULL OR meta = 'null'"),
    ("json_null_at_path", {"meta": {"path": ["n"], "equals": None}}, "json_type(meta, '$.n') = 'NULL'"),
    ("json_compare_numbers_only", {"meta": {"path": ["n"], "gte": 5}}, "json_type(meta, '$.n') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(json_extract_string(meta, '$.n') AS DOUBLE) >= 5"),
    ("json_compare_strings_only", {"meta": {"path": ["n"], "lt": "6"}}, "json_type(meta, '$.n') = 'VARCHAR' AND json_extract_string(meta, '$.n') < '6'"),
    ("json_string_insensitive", {"meta": {"path": ["s"], "string_starts_with": "HEL", "mode": "insensitive"}}, "starts_with(lower(json_extract_string(meta, '$.s')), 'hel')"),
    ("json_string_literal", {"meta": {"path": ["s"], "string_contains": "%"}}, "contains(json_extract_string(meta, '$.s'), '%')"),
    ("json_array_contains", {"meta": {"path": ["a", "b"], "array_contains": [1, 3]}}, "id = 3"),
    ("json_array_ends", {"meta": {"path": ["a", "b"], "array_starts_with": 1, "array_ends_with": 3}}, "id = 3"),
    ("json_equals_document", {"meta": {"equals": [1, 2]}}, "meta = '[1,2]'"),
    ("json_not_nested", {"meta": {"path": ["n"], "not": {"gt": 6}}}, "meta IS NOT NULL AND id <> 7 OR id = 1"),
):
    _inline(_name, "id bigint, meta string", _DOC_ROWS, _DOCS, f"SELECT id FROM t WHERE {_sql}", where=_where, select={"id": True})

_TRI = Model("tri", {"id": big_int(id=True), "n": integer(nullable=True), "s": string(nullable=True), "m": decimal(nullable=True)})
_TRI_ROWS = [(1, None, "Éa", Decimal("0.100000000000000001")), (2, 1, None, Decimal("0.100000000000000002")), (3, 2, "50%_\\", None), (4, 1, "éA", Decimal("12345678901234567890.5")), (5, None, "5000", Decimal("-3"))]
_TRI_SCHEMA = "id bigint, n int, s string, m decimal(38,18)"
for _name, _args, _sql in (
    ("null_equals", {"where": {"n": None}}, "SELECT id FROM t WHERE n IS NULL"),
    ("null_not", {"where": {"n": {"not": None}}}, "SELECT id FROM t WHERE n IS NOT NULL"),
    ("null_not_value", {"where": {"n": {"not": 1}}}, "SELECT id FROM t WHERE n <> 1"),
    ("null_under_not", {"where": {"NOT": {"n": 1}}}, "SELECT id FROM t WHERE NOT (n = 1)"),
    ("null_not_in", {"where": {"n": {"not_in": [2]}}}, "SELECT id FROM t WHERE n NOT IN (2)"),
    ("text_wildcards_literal", {"where": {"s": {"contains": "%_"}}}, "SELECT id FROM t WHERE contains(s, '%_')"),
    ("text_fold_ascii_only", {"where": {"s": {"equals": "éa", "mode": "insensitive"}}}, "SELECT id FROM t WHERE translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'éa'"),
    ("decimal_exact", {"where": {"m": {"gt": "0.100000000000000001"}}}, "SELECT id FROM t WHERE m > 0.100000000000000001"),
    ("order_nulls_default_desc", {"order_by": {"n": "desc"}, "take": 3}, "SELECT id FROM t ORDER BY n DESC NULLS FIRST, id LIMIT 3"),
    ("order_nulls_default_asc", {"order_by": {"n": "asc"}, "take": 4}, "SELECT id FROM t ORDER BY n ASC NULLS LAST, id LIMIT 4"),
    ("order_nulls_explicit", {"order_by": {"n": {"sort": "asc", "nulls": "first"}}, "take": 3}, "SELECT id FROM t ORDER BY n ASC NULLS FIRST, id LIMIT 3"),
    ("cursor_nullable_asc", {"order_by": {"n": "asc"}, "cursor": {"id": 4}}, "SELECT id FROM t WHERE id IN (4, 3, 1, 5)"),
    ("cursor_nullable_desc", {"order_by": {"n": "desc"}, "cursor": {"id": 5}, "take": 3}, "SELECT id FROM t WHERE id IN (5, 3, 2)"),
):
    _inline(_name, _TRI_SCHEMA, _TRI_ROWS, _TRI, _sql, **_args, select={"id": True})

# sets, joins, recursion, raw SQL


def _two(r: Reader) -> tuple[DataFrame, DataFrame]:
    return r.find_many("customer", where={"c_acctbal": {"gt": 5000.0}}, select={"c_nationkey": True}), r.find_many("customer", where={"c_mktsegment": "BUILDING"}, select={"c_nationkey": True})


for _name, _op, _word in (("set_union", sets.union, "UNION"), ("set_union_all", sets.union_all, "UNION ALL"), ("set_intersect", sets.intersect, "INTERSECT"), ("set_except", sets.difference, "EXCEPT")):
    _add(_name, f"SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 {_word} SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda r, op=_op: op(*_two(r)))

for _how in ("inner", "left", "right", "full"):
    _add(f"join_{_how}", f"SELECT d.doc_id, quality FROM (SELECT doc_id FROM documents WHERE lang = 'en') d {_how} JOIN labels l ON d.doc_id = l.doc_id")(
        lambda r, how=_how: sets.join(r.find_many("documents", where={"lang": "en"}, select={"doc_id": True}), r.find_many("labels", select={"doc_id": True, "quality": True}), [("doc_id", "doc_id")], how).select("doc_id", "quality")
    )


@_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN (SELECT n_name FROM nation WHERE n_regionkey = 0)")
def _(r: Reader) -> DataFrame:
    return sets.cross(r.find_many("region", select={"r_name": True}), r.find_many("nation", where={"n_regionkey": 0}, select={"n_name": True}))


@_add("join_lateral", "SELECT r_regionkey, n_name FROM region LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) ON n_regionkey = r_regionkey AND rn <= 2")
def _(r: Reader) -> DataFrame:
    inner = r.scan(REGISTRY["nation"]).where(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy("n_name").limit(2).select("n_name")
    return sets.lateral(r.find_many("region", select={"r_regionkey": True}), inner, "left")


@_add("functions_text", "SELECT p_partkey, concat(p_brand, '/', upper(p_type)) AS label, lower(p_name) AS low, p_type LIKE '%BRASS' AS brass, NOT (lower(p_name) LIKE 'a%') AS not_a, p_size BETWEEN 5 AND 10 AS mid, NOT (p_size BETWEEN 5 AND 10) AS not_mid, translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%tin%' AS tin FROM part")
def _(r: Reader) -> DataFrame:
    c = F.col
    return r.scan(REGISTRY["part"]).select("p_partkey", fn.concat(c("p_brand"), F.lit("/"), fn.upper("p_type")).alias("label"), fn.lower("p_name").alias("low"), fn.like(c("p_type"), "%BRASS").alias("brass"), fn.not_ilike(c("p_name"), "A%").alias("not_a"), fn.between(c("p_size"), 5, 10).alias("mid"), fn.not_between(c("p_size"), 5, 10).alias("not_mid"), fn.ilike(c("p_type"), "%TIN%").alias("tin"))


@_add("functions_numbers", "SELECT p_partkey, CAST(-p_size // 4 AS BIGINT) AS quarter, greatest(p_size, 20) AS high, least(p_size, 20) AS low, coalesce(nullif(p_size, 1), -1) AS filled, CAST(p_size AS VARCHAR) AS text, CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS number, lower(hex(encode(p_brand))) AS hexed FROM part")
def _(r: Reader) -> DataFrame:
    size = F.col("p_size")
    return r.scan(REGISTRY["part"]).select("p_partkey", fn.integer_divide(-size, F.lit(4)).alias("quarter"), fn.greatest(size, F.lit(20)).alias("high"), fn.least(size, F.lit(20)).alias("low"), fn.coalesce(F.nullif(size, F.lit(1)), F.lit(-1)).alias("filled"), fn.cast(size, "text").alias("text"), fn.cast(fn.cast(size, "text"), "integer").alias("number"), fn.blob_to_hex(F.encode("p_brand", "UTF-8")).alias("hexed"))


@_add("functions_arrays", "SELECT p_partkey, len(w) AS n, w[2] AS second, array_to_string(list_append(w, 'end'), '-') AS pushed, array_to_string(list_prepend('start', w), '-') AS front, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN 'X' ELSE x END), '-') AS changed FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)")
def _(r: Reader) -> DataFrame:
    w = F.col("w")
    df = r.scan(REGISTRY["part"]).select("p_partkey", F.split("p_type", " ").alias("w"))
    return df.select("p_partkey", fn.array_length(w).cast("bigint").alias("n"), fn.array_get(w, 1).alias("second"), F.array_join(fn.array_push(w, "end"), "-").alias("pushed"), F.array_join(fn.array_unshift(w, "start"), "-").alias("front"), F.array_join(fn.array_set(w, 0, "X"), "-").alias("changed"))


@_add("count_distinct", "SELECT count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first FROM orders")
def _(r: Reader) -> DataFrame:
    return r.scan(REGISTRY["orders"]).agg(fn.count_distinct("o_custkey").alias("customers"), fn.smallest("o_orderdate").alias("first"))


@_add("recursive_tree", "WITH RECURSIVE w(node, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT o_orderkey, depth + 1 FROM w JOIN orders ON (o_orderkey // 2) = node AND o_orderkey > 1 WHERE depth < 6) SELECT node AS child, min(depth) AS depth FROM w GROUP BY node")
def _(r: Reader) -> DataFrame:
    edges = r.scan(REGISTRY["orders"]).where("o_orderkey > 1").select(F.floor(F.col("o_orderkey") / 2).alias("parent"), F.col("o_orderkey").alias("child"))
    roots = edges.sparkSession.createDataFrame([(1,)], "child bigint")
    return sets.descend(edges, roots, "parent", "child", max_depth=6)


@_add("raw_sql", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def _(r: Reader) -> DataFrame:
    r.source.load("orders").createOrReplaceTempView("mosaiq_raw_orders")
    return query(r.source.spark, "SELECT o_orderstatus, count(*) AS n FROM mosaiq_raw_orders WHERE o_totalprice > :least GROUP BY o_orderstatus", least=100000.0)

# writes: the table's state afterwards


def _writes(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine over a store that starts with these tables of the source."""
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    tx = store.begin()
    for t in tables:
        tx.create_table(t, ParquetSource(spark, sf_dir).load(t))
    tx.commit()
    return Engine(REGISTRY, store)


def _write(name: str, sql: str, *tables: str):
    def keep(f: Callable[[Engine], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: f(_writes(spark, sf_dir, *tables))
        ORACLES[name] = sql

    return keep


@_write("write_update_many", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer", "customer", "nation", "orders", "events")
def _(e: Engine) -> DataFrame:
    e.customer.update_many(where={"c_mktsegment": "BUILDING", "c_acctbal": {"lt": 0.0}}, data={"c_acctbal": 0.0})
    return e.customer.find_many(select={"c_custkey": True, "c_acctbal": True})


@_write("write_increment_limit", "SELECT p_partkey, CASE WHEN rn <= 25 THEN p_size * 2 ELSE p_size END AS p_size FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN p_size > 20 THEN 0 ELSE 1 END, p_partkey) + CASE WHEN p_size > 20 THEN 0 ELSE 1000000 END AS rn FROM part)", "part", "lineitem")
def _(e: Engine) -> DataFrame:
    e.part.update_many(where={"p_size": {"gt": 20}}, data={"p_size": {"multiply": 2}}, limit=25)
    return e.part.find_many(select={"p_partkey": True, "p_size": True})


@_write("write_delete_many", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000))", "orders", "customer", "nation", "events")
def _(e: Engine) -> DataFrame:
    free = Engine(Registry(*_no_lines()), e.source)
    free.orders.delete_many(where={"o_orderstatus": "F", "customer": {"is": {"c_acctbal": {"gt": 5000.0}}}})
    return free.orders.find_many(select={"o_orderkey": True})


def _no_lines() -> list[Model]:
    """The models without lineitem's relations, so that orders can go without their lines."""
    return [Model(m.name, {k: v for k, v in m.shape.items() if not (isinstance(v, Relation) and "lineitem" in (v.target, m.name))}, m.table, m.id, m.uniques) for m in REGISTRY.models.values()]


@_write("write_create_many_skip", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 900, 'NEW', 1", "nation", "region", "customer", "supplier")
def _(e: Engine) -> DataFrame:
    e.nation.create_many(data=[{"n_nationkey": 1, "n_name": "X", "n_regionkey": 0}, {"n_nationkey": 900, "n_name": "NEW", "n_regionkey": 1}, {"n_nationkey": 900, "n_name": "AGAIN", "n_regionkey": 1}], skip_duplicates=True)
    return e.nation.find_many()


@_write("write_upsert_nested", "SELECT r_regionkey, n_nationkey, CASE WHEN n_nationkey = 2 THEN 'RENAMED' ELSE n_name END AS n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 77, 901, 'BORN'", "nation", "region", "customer", "supplier")
def _(e: Engine) -> DataFrame:
    owner = e.nation.find_unique(where={"n_nationkey": 2}).first()["n_regionkey"]
    e.region.upsert(where={"r_regionkey": 77}, create={"r_regionkey": 77, "r_name": "NOWHERE", "nations": {"create": {"n_nationkey": 901, "n_name": "BORN"}}}, update={})
    e.region.upsert(where={"r_regionkey": owner}, create={"r_regionkey": owner, "r_name": "?"}, update={"nations": {"update": [{"where": {"n_nationkey": 2}, "data": {"n_name": "RENAMED"}}]}})
    return e.region.find_many(include={"nations": True}).select("r_regionkey", F.explode_outer("nations").alias("n")).select("r_regionkey", "n.n_nationkey", "n.n_name")


# streams


def _streamed(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What an available-now run of the stream has put out."""
    name = f"mosaiq_stream_{uuid.uuid4().hex}"
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", scratch_path(spark, "stream")).start().awaitTermination()
    return spark.table(name)


def _stream_reader(spark: SparkSession, sf_dir: str) -> Reader:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = FrameSource(spark, {"events": lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")})  # a pattern, as the source may be one file
    return Reader(REGISTRY, LayeredSource(events, ParquetSource(spark, sf_dir)))


def _stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _stream_reader(spark, sf_dir)
    return _streamed(spark, find_stream(r, "events", where={"value": {"gt": 50.0}, "customer": {"is": {"c_acctbal": {"gt": 0.0}}}}, select={"event_id": True, "event_type": True}), "append")


def _stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _stream_reader(spark, sf_dir)
    df = _streamed(spark, group_stream(r, "events", time="ts", window="1 day", watermark="400 days", by="event_type", _count=True, _max={"value": True}), "complete")
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.col("_count").alias("n"), F.col("_max.value").alias("top"))


QUERIES |= {"stream_filter": _stream_filter, "stream_window_group": _stream_window}
ORACLES |= {
    "stream_filter": "SELECT event_id, event_type FROM events JOIN customer ON user_id = c_custkey WHERE value > 50 AND c_acctbal > 0",
    "stream_window_group": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL",
}

QUERIES |= WRITE_QUERIES
ORACLES |= WRITE_ORACLES
