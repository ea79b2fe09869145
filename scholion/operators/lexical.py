"""A positional index of elements and exact top-k lookups in it.

``build`` tokenises every element once, its case folded, into postings: a row for a word of an element with the ranges where it
stands. Elements are dealt into blocks of about ``BLOCK``; a block keeps, for every word in it, the most occurrences in one
of its elements. A lookup reads, in this order:

1. the vocabulary, for the words that hold a term of the query (terms are found inside words, as in a scan of the text);
2. the blocks of those words, for the highest score that an element of a block could have;
3. the postings of the ``SEEDS`` most promising blocks, whose k-th score is a bound from below;
4. the postings of blocks that can reach that bound. All others are never read, and the result is exact.

A word in a third of all elements is as many rows, dealt by blocks, and never a group. What is broadcast is one row or k rows.

Defined results: a term's occurrences don't overlap; the score of an element adds them up over the distinct terms; equal
scores go by the element's keys; elements with a null text have none. A span is the range in the text as it was of the
letters that an occurrence comes from, also where folding makes two of one. Equal spans of two terms are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from scholion.functions.arrow import arrow_udf
from scholion.session import cut_lineage, stored

#: Elements of a block; elements of a document that stay together; blocks scored first; spans returned of an element.
BLOCK, NEIGHBOURS, SEEDS, SPANS = 512, 64, 16, 1000
_WORD = re.compile(r"\w+")


@dataclass
class Index:
    keys: list[str]
    elements: DataFrame  # keys, block, headings (folded)
    postings: DataFrame  # word, shape, block, keys, n, starts
    blocks: DataFrame  # word, block, most


def folded_words(text: str) -> dict[tuple[str, tuple[int, ...] | None], list[int]]:
    """Where each word of the folded text starts in the text as it was. Words of another length than their origin are
    kept apart by their shape: the place in the origin of each of their letters."""
    folded, found = text.casefold(), {}
    if len(folded) == len(text):  # folding only ever lengthens a letter
        for m in _WORD.finditer(folded):
            found.setdefault((m.group(), None), []).append(m.start())
        return found
    origin = [k for k, c in enumerate(text) for _ in c.casefold()]
    for m in _WORD.finditer(folded):
        start, end = m.span()
        at = origin[start]
        same = origin[end - 1] - at == end - 1 - start
        found.setdefault((m.group(), None if same else tuple(o - at for o in origin[start:end])), []).append(at)
    return found


def query_terms(query: str) -> list[str]:
    terms = list(dict.fromkeys(_WORD.findall(query.casefold())))
    if not terms:
        raise ValueError("a lookup needs words")
    return terms


@arrow_udf("string")
def casefolded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


@arrow_udf("array<int>")
def _places(words: pd.Series, terms: pd.Series) -> pd.Series:
    """Where a term stands in a word, from the left and without overlap."""
    return pd.Series([[m.start() for m in re.finditer(re.escape(t), w)] for w, t in zip(words, terms)])


def build(elements: DataFrame, keys: list[str], text: str, section: str | None = None, block: int = BLOCK) -> Index:
    """Index of elements named by ``keys`` (a document and, where it has several, a place in it); ``section``: a column
    with an array of the headings above the element."""
    count = max(1, -(-elements.count() // block))
    near = [F.col(keys[0]), *[F.floor(F.col(k) / NEIGHBOURS) for k in keys[1:]]]
    headings = casefolded(F.array_join(section, " ")) if section else F.lit("")
    rows = elements.select(*keys, F.pmod(F.xxhash64(*near), F.lit(count)).alias("block"), F.col(text).alias("text"), headings.alias("headings"))
    kinds = [rows.schema[k] for k in keys]
    ints = ArrayType(IntegerType())
    schema = StructType([StructField("word", StringType()), StructField("shape", ints), StructField("block", LongType()), *kinds, StructField("n", IntegerType()), StructField("starts", ints)])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for row, t in enumerate(texts):
                out.extend((row, *word, starts) for word, starts in folded_words(t or "").items())
            at, numbers = pa.array([row for row, *_ in out], pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([word for _, word, _, _ in out], pa.string()), pa.array([shape for _, _, shape, _ in out], numbers), *[batch.column(c).take(at) for c in ("block", *keys)],
                    pa.array([len(starts) for *_, starts in out], pa.int32()), pa.array([starts for *_, starts in out], numbers),
                ],
                names=["word", "shape", "block", *keys, "n", "starts"],
            )

    postings = stored(rows.select("block", *keys, "text").mapInArrow(tokens, schema))  # a checkpoint would tokenise twice
    most = postings.groupBy("word", "shape", "block").agg(F.max("n").alias("most"))  # an element may hold several shapes of a word
    blocks = stored(most.groupBy("word", "block").agg(F.sum("most").alias("most")))
    return Index(list(keys), rows.drop("text"), postings, blocks)


def save(index: Index, folder: str, parts: int | None = None) -> None:
    """Write the index; postings and blocks by ranges of word and block, so that a lookup skips files and row groups."""
    parts = parts or int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.elements.write.parquet(f"{folder}/elements")
    for name in ("postings", "blocks"):
        getattr(index, name).repartitionByRange(parts, "word", "block").sortWithinPartitions("word", "block").write.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, keys: list[str]) -> Index:
    return Index(list(keys), *[spark.read.parquet(f"{folder}/{name}") for name in ("elements", "postings", "blocks")])


def _matches(index: Index, terms: list[str]) -> DataFrame:
    """(word, term, places) of the words that hold a term."""
    terms_of = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("word").contains(t))
    found = index.blocks.select("word").distinct().select("word", F.explode(terms_of).alias("term"))
    return found.select("word", "term", _places("word", "term").alias("places"))


def _scored(postings: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    times = words.groupBy("word").agg(F.sum(F.size("places")).alias("times"))
    return postings.join(times, "word").groupBy(*keys, "block").agg(F.sum(F.col("n") * F.col("times")).alias("score"))


def candidate_blocks(index: Index, query: str, k: int, section: str = "", seeds: int = SEEDS) -> DataFrame:
    """(block, bound) of the blocks that may hold one of the first k elements."""
    return _candidates(index, cut_lineage(_matches(index, query_terms(query))), k, section, seeds)


def _allowed(index: Index, rows: DataFrame, section: str) -> DataFrame:
    if not section:
        return rows
    named = index.elements.where(F.col("headings").contains(section.casefold()))
    return rows.join(named.select(*index.keys), index.keys, "left_semi")


def _candidates(index: Index, words: DataFrame, k: int, section: str, seeds: int) -> DataFrame:
    times = words.groupBy("word").agg(F.sum(F.size("places")).alias("times"))
    bounds = cut_lineage(index.blocks.join(times, "word").groupBy("block").agg(F.sum(F.col("most") * F.col("times")).alias("bound")))
    first = bounds.orderBy(F.desc("bound"), "block").limit(seeds)
    seen = _scored(_allowed(index, index.postings.join(F.broadcast(first.select("block")), "block", "left_semi"), section), words, index.keys)
    best = seen.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("held")).head()
    return bounds.where(F.col("bound") >= (best.least if best.held >= k else 1))


def find(index: Index, query: str, k: int = 10, section: str = "", seeds: int = SEEDS) -> DataFrame:
    """(keys, score, span_count, spans) of the k elements with the most occurrences of the distinct words of the query, the
    first by keys among equals; ``section`` keeps elements under a heading that holds it."""
    if k < 1:
        raise ValueError("k must be positive")
    keys = index.keys
    words = cut_lineage(_matches(index, query_terms(query)))
    near = _candidates(index, words, k, section, seeds)
    rows = _allowed(index, index.postings.join(near.select("block"), "block", "left_semi"), section)
    hits = cut_lineage(_scored(rows, words, keys).orderBy(F.desc("score"), *keys).limit(k))
    return hits.drop("block").join(_spans(index, hits, words), keys)


def _spans(index: Index, hits: DataFrame, words: DataFrame) -> DataFrame:
    """Ranges of all occurrences in the hits: k rows meet the postings of their blocks."""
    keys = index.keys
    held = index.postings.join(F.broadcast(hits.select(*keys, "block")), [*keys, "block"], "left_semi").join(words, "word")
    each = held.select(*keys, "term", "shape", "places", F.explode("starts").alias("from")).withColumn("at", F.explode("places"))
    place = lambda at: F.when(F.col("shape").isNull(), at).otherwise(F.get("shape", at))
    start, end = F.col("from") + place(F.col("at")), F.col("from") + place(F.col("at") + F.length("term") - 1) + 1
    spans = each.select(*keys, F.struct(start.alias("start"), end.alias("end")).alias("span")).distinct()
    sorted_ = F.array_sort(F.collect_list("span"))  # of one element
    return spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("span_count"), F.slice(sorted_, 1, SPANS).alias("spans"))
