"""A corpus pipeline: quality rules, quality classifier, near duplicates, secrets, packing.

Each stage gets the session, the documents its predecessor kept and the folder
of the other tables; its result is written as Parquet and read again. All
stages but the last return whole documents in their own columns.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.columns import unused_name
from tabscope.llm import importance, near_text, packing, queries, rules, secrets
from tabscope.session import checkpoint_folder, cut_lineage, tune


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row, and that column.

    The key is the row's ``doc_id`` where no other row has it. Rows without an
    id, or that share one, get numbers of their own above all ids, so that what
    a stage decides is about one row, whatever its id.
    """
    key = unused_name("key", docs.columns)
    ids = docs.groupBy(F.col("doc_id").alias("id")).count()
    highest = ids.agg(F.max("id")).first()[0] or 0
    shared = queries.table_of(ids.where("id IS NULL OR count > 1").select("id"))
    named = [docs[c] for c in docs.columns]
    alone = docs.join(shared, docs["doc_id"].eqNullSafe(shared["id"]), "left_anti").withColumn(key, F.col("doc_id"))
    rest = docs.join(shared, docs["doc_id"].eqNullSafe(shared["id"]), "left_semi")
    if shared.isEmpty():
        return alone, key
    numbered = cut_lineage(rest.select(*named, (F.lit(highest) + 1 + F.monotonically_increasing_id()).alias(key)))
    return alone.unionByName(numbered), key


def _keep(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``judge`` keeps; it is given the rows with their keys as ``doc_id``."""
    keyed, key = _keyed(docs)
    own = [c for c in docs.columns if c != "doc_id"]
    refused = judge(keyed.select(F.col(key).alias("doc_id"), *own)).where(~F.col("kept"))
    refused = queries.table_of(refused.select(F.col("doc_id").alias(key)))
    return keyed.join(refused, key, "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails them; no documents give none."""
    return _keep(docs, rules.judge)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws.

    Labels name documents by ``doc_id``; rows that share an id, or have none,
    are judged like unlabelled ones. Null and empty texts score 0; without
    labels, or without documents, all that came stays.
    """
    return _keep(docs, lambda rows: importance.resample(rows, queries.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows that share an id are documents of their own and go only where their
    texts are alike; rows without one too. Texts without words, null included,
    are alike to none.
    """
    return _keep(docs, near_text.near_duplicates)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks, ``n_chars`` with them.

    Texts without secrets stay as they are, null included; other columns may
    have any names; no documents give none.
    """
    return secrets.redact(docs, chars="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its closing id alone, no documents give no pieces."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

# Sketches, token ids and seeded noise are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    folder = f"{checkpoint_folder(tune(spark))}/pipeline-{uuid4().hex}"
    docs = queries.table(spark, str(sf_dir).rstrip("/"), "documents")
    for name, stage in STAGES:
        stage(spark, docs, str(sf_dir).rstrip("/")).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
