"""The corpus pipeline: five operators, each over all its predecessor kept.

1. toxicity: documents scored toxic go.
2. n-gram Jaccard join: five-word shingles at 0.8 or more; one document of each group stays.
3. suffix-array dedup: passages of more than ``REPEAT_WORDS`` words that repeat are cut out of the texts, however short the
   words; white space between words doesn't count.
4. mixing: sources are replicated towards their target weights; every copy is a row.
5. SentencePiece: every text becomes piece ids.

The stages in between are written as Parquet and read again, under the shared folder of ``spark.checkpoint.dir``; a
stage's folder is removed when the next one is written, the last one's stays for the result, which is read lazily.
The last returns ids of pieces, so no SQL can express the result: ``ORACLE_SQL`` is None, tests compare the second,
third and fifth stage with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.llm import jaccard, mixing, pieces, suffix, toxicity
from scholion.llm.common import shared_folder

REPEAT_WORDS = 50
SHINGLE_WORDS, SIMILARITY = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, size=SHINGLE_WORDS, share=SIMILARITY)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.cut_repeats(docs, words=REPEAT_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}-{k}")
        docs = spark.read.parquet(f"{folder}-{k}")
        if before:
            _remove(spark, before)
        before = f"{folder}-{k}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
