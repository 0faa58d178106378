"""The documents pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, sources are mixed to their
targets, and what is left is packed into sequences. Each stage works on all rows that the one before it kept; all but the last return the
columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolore.llm import cover_dedup, mixing, packing, queries, simhash, toxicity
from chronolore.llm.common import ensure_checkpoint_dir

#: No SQL expresses the stages; tests hold them against plain versions.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from them and the labels, rejects go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, queries.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked at a five-word similarity of 0.8 or more, the document with the least doc_id stays."""
    return simhash.one_of_each(docs, shingle_words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has go; a document without any word left goes."""
    return cover_dedup.without_repeats(docs, window=50)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated and cut as the schedule tells, each file in its order."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it."""
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again by the next. When it is
    written, what the stage before it wrote is deleted: the last stage's input stays, as its result is read from it later."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = queries.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
