"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two words, case folded, ``BUCKETS`` buckets, one added to
every count): the target model from documents labelled good, a bounded hash sample of ``TARGET_DOCS`` of them, and
the raw model from all documents, which also smooths the target model (``BACKGROUND``). A document's importance is the log ratio of its probability under both; adding
Gumbel noise seeded by its id and keeping the k largest draws k documents without replacement in proportion to
their importance. k is a share of all documents: by default that of the good ones among the labelled.

Counting and scoring are two passes over the text without a shuffle; only bucket counts reach the driver. The k-th
largest key is found exactly by refining a histogram, a few counting passes over the keys.

Defined results: a null or empty text has log ratio 0; null ids share one noise; equal keys at the threshold are all
kept; without good labels the target is the raw model, every log ratio is 0 and the draw is uniform; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

BUCKETS = 10_000
TARGET_DOCS = 20_000
BACKGROUND = 0.2


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, number of the text it is in)."""
    start, end, first = c.words(raw, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = c.span_hash(c.prefix_hash(c.fold(raw)), start, end)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        pair = c.mix(word[same] * np.uint64(3) + word[same + 1])
    return (np.r_[word, pair] % np.uint64(BUCKETS)).astype(np.int64), np.r_[doc, doc[same]]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Log ratio of target to raw by bucket."""
    spark = docs.sparkSession
    known = labels.where((F.col(label) == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("good")).distinct()
    good = known.orderBy(F.xxhash64("good", F.lit(31)), "good").limit(TARGET_DOCS)
    chosen = spark.createDataFrame(good.collect(), known.schema)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("good"), "left")

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in c.chunks(batch, "text"):
                at, doc = buckets(*c.text_buffer(c.column(part, "text")))
                target = c.column(part, "target").to_numpy(zero_copy_only=False)
                total[0] += np.bincount(at, minlength=BUCKETS)
                total[1] += np.bincount(at[target[doc]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    sums = rows.select("text", F.col("good").isNotNull().alias("target")).mapInArrow(count, "bucket long, raw long, target long")
    sums = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    table = np.ones((2, BUCKETS))
    table[:, sums["bucket"].to_numpy(int)] += sums[["raw", "target"]].to_numpy(float).T
    if table[1].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    share = table / table.sum(1, keepdims=True)
    return np.log((1 - BACKGROUND) * share[1] / share[0] + BACKGROUND)


def kth_largest(keys: DataFrame, name: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column: each round counts ``bins`` equal bins of the interval that holds it."""
    if k <= 0:
        return None
    low, high = keys.agg(F.min(name), F.max(name)).head()
    if low is None:
        return None
    while True:  # the interval shrinks to a bin each time
        width = (high - low) / bins
        if not width > 0 or low + width == low:
            return low
        at = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = keys.where((F.col(name) >= F.lit(low)) & (F.col(name) <= F.lit(high)))
        found = sorted(inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect(), key=lambda r: -r.bin)
        for r in found:
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
        else:
            return low
        if r.n == 1 or low == high:
            return low


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, id_column: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(id, log_ratio, gumbel_key, selected) for every row."""
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(fit(docs, labels, id_column, text, label))

    def score(batches):
        for batch in batches:
            for part in c.chunks(batch, "text"):
                raw, offsets = c.text_buffer(c.column(part, "text"))
                at, doc = buckets(raw, offsets)
                value = np.bincount(doc, ratio.value[at], len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([c.column(part, "id"), pa.array(value)], ["id", "log_ratio"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, log_ratio double")
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)
    scored = c.cut_lineage(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(drawn))))
    if share is None:
        share = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).head()[0]
        share = 1.0 if share is None else share
    limit = kth_largest(scored, "gumbel_key", round(share * scored.count()))
    chosen = F.lit(False) if limit is None else F.col("gumbel_key") >= F.lit(limit)
    return scored.select(F.col("id").alias(id_column), "log_ratio", "gumbel_key", chosen.alias("selected"))
