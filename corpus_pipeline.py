"""A training corpus from documents: five stages, each one of the operators of mosaiq.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder, reads it again for the next and deletes it when that has been
written.

Defined cases: a null text is like an empty one to every stage and stays null; a null id is carried, and its row is never
dropped as a copy; rows that repeat id and text become one; rows of one id with different texts go or stay each for its
own text; texts are whole, however long; empty tables give empty results, and without labels or benchmark nothing is
dropped for them; extra columns, whatever their names, stay until the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import forget, table, written
from mosaiq.llm.decontaminate import drop_contaminated
from mosaiq.llm.line_crf import keep_good, train
from mosaiq.llm.packing import pack
from mosaiq.llm.secrets import redact_secrets
from mosaiq.llm.simhash import fingerprints, rooted_fingerprints


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line CRF scores at its threshold or more."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of like fingerprints, the document with the least id; copies of that row stay one. Rows that
    repeat an id are told apart by their texts' fingerprints: each goes or stays with its own component alone."""
    named = docs.where(F.col("doc_id").isNotNull())
    found = rooted_fingerprints(named)
    lost = found.where("_id <> component_id").select(F.col("_id").alias("_lost")).distinct()
    again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")
    once = docs.join(again, docs["doc_id"] == again["_again"], "left_anti")
    once = once.join(lost, once["doc_id"] == lost["_lost"], "left_anti")
    repeated = named.join(again, named["doc_id"] == again["_again"], "left_semi")
    texts = fingerprints(repeated.select(F.struct("doc_id", "text").alias("_key"), "text").distinct(), "_key").select("_id.doc_id", "_id.text", "_fp")
    least = found.where("_id = component_id").groupBy("root").agg(F.min(F.struct("_id", "_fp")).alias("_x")).select(F.col("_x._id").alias("_kept"), F.col("_x._fp").alias("_of"))
    stay = texts.join(least, (texts["doc_id"] == least["_kept"]) & (texts["_fp"] == least["_of"])).groupBy("_kept", "_of").agg(F.min("text").alias("_text"))
    rows = repeated.join(stay.select("_kept", F.col("_text").alias("_own")), (repeated["doc_id"] == F.col("_kept")) & repeated["text"].eqNullSafe(F.col("_own")), "left_semi")
    return once.unionByName(rows.dropDuplicates(["doc_id", "text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, by edit distance."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least_words=1)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; n_chars follows the new text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Learned and iterative stages aren't expressible in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            forget(before)
    return docs
