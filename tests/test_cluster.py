"""Executors in processes of their own, with only spark.checkpoint.dir and the inputs in common with the driver."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark

from mosaiq.write_queries import ORACLES, JdbcSource, book, people, people_database

ROOT = Path(__file__).resolve().parents[1]
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"

RUN = """
import json, sys
from pyspark.sql import SparkSession
from mosaiq.write_queries import QUERIES
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
first, second = (QUERIES["jdbc_source"](spark, sys.argv[2]) for _ in range(2))
print("ROWS", json.dumps([sorted(map(list, df.collect())) for df in (first, second, first.repartition(4))]))
spark.stop()
"""


def test_jdbc_source_beyond_the_driver(tmp_path, data):
    database = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer"):
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    want = sorted(map(list, database.execute(ORACLES["jdbc_source"]).fetchall()))
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell"}
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), f"{data}/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in ran.stdout, ran.stderr[-3000:]
    assert json.loads(ran.stdout.split("ROWS ")[1]) == [want] * 3


def test_people_database_keeps_every_row(spark, data):
    """Several batches, nulls, quotes, text beyond ASCII and numbers beyond 32 bits."""
    e = book(spark, f"{data}/sf0.001")
    e.person.create_many(data=spark.range(1000, 3501).selectExpr("CAST(id AS INT) AS id", "concat('é\"''\\n', id) AS name", "id * 3000000000 AS score", "CAST(NULL AS INT) AS team_id"))
    there, here = JdbcSource(spark, people_database(e), driver=DERBY).load("person"), people(e)
    assert there.columns == here.columns
    assert there.count() == here.count() == 2526
    assert there.exceptAll(here).isEmpty()
    assert here.exceptAll(there).isEmpty()
