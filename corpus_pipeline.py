"""From documents to token ids: five stages, each on all that the one before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``; the last returns
the ids. ``run`` writes each result as Parquet in the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.llm import bpe, decontaminate, exact, quality, simhash
from calibrel.llm.batches import only, without, written
from calibrel.llm.queries import multi_tokenizer, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on all labels."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.where("NOT kept"))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest, then the one of the smallest id.

    Rows with equal id and text are one document.
    """
    found = written(exact.exact_duplicates(docs), "exact")
    kept = without(docs, found.where("NOT kept AND keep_id IS NOT NULL"))
    repeated = written(found.groupBy("doc_id", "text_key").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    return without(kept, repeated).unionByName(only(kept, repeated).dropDuplicates(["doc_id", "text"]))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles, at most three bits apart, the one with the smallest id."""
    found = simhash.near_duplicates(docs, words=3, radius=3)
    return without(docs, found.where("doc_id <> component_id OR doc_id IS NULL AND component_id IS NOT NULL"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded``: the ids, and the text that they give back."""
    path, pattern = multi_tokenizer()
    # written in between: a task then runs one of the two workers, not both
    ids = written(bpe.encode(docs.select("doc_id", "text"), path, pattern).drop("text"), "ids")
    coded = bpe.decode(ids, path)
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.decode("decoded", "UTF-8").alias("decoded"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_each_text),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", token_ids),
]

#: Fingerprints, templates and merges have no SQL; tests compare the rows with plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
