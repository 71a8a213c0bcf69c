"""From documents to tokens: each stage works on what the one before kept.

Every row has its own verdict in the first, fourth and fifth stage, equal rows
the same; of rows equal in id and text the second keeps one. Null and empty
texts: not toxic unless the model says so of an empty text; copies of each
other, so that one of them stays; without passages or leaks; no tokens. Long
texts are read whole. Null ids come after all others where the smallest id
counts. Further columns are kept, whatever their names, but for the last stage.
Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, decontaminate, near_copies, suffix_dedup, toxicity
from loomspark.llm._common import remove, scratch, shared_dir
from loomspark.llm.queries import table, toxicity_model, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles) stays."""
    return near_copies.drop_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of 50 words or more go; a document of which nothing is left goes."""
    return suffix_dedup.drop_repeated_passages(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary, little-endian 32-bit numbers) and digests of ids and decoded text."""
    out = bpe.encode_decode(docs, vocabulary(), ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontaminate", drop_leaks),
    ("bpe", tokens),
]

#: Majorities of hashes, trained scores and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage writes; tables that the stages write on the way are removed as soon as they aren't read any more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, before = "", ""
    for _, stage in STAGES:
        path, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", path
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return docs
