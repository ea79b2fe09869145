"""Lexical lookup, chunking, packing, quotations and coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scholion.functions.arrow import arrow_udf, exploded

CHUNK, PACK = 4000, 24_000


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def lexical_find(rows: DataFrame, query: str, text: str, pos: str, k: int) -> DataFrame:
    """The k elements with the most occurrences of the distinct query words, earlier first among equals."""
    import re

    terms = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    if not terms:
        raise ValueError("a lookup needs words")
    folded = F.lower(F.col(text))
    score = sum((occurrences(folded, t) for t in terms[1:]), occurrences(folded, terms[0]))
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), pos).limit(k)


def cut_points(text: str, size: int = CHUNK) -> list[int]:
    """Ends of lossless chunks: after the last paragraph or sentence end in the second half, else at the size."""
    ends, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            half = start + size // 2
            last = max(text.rfind(mark, half, end) for mark in ("\n\n", ". "))
            if last >= half:
                end = last + 2
        ends.append(end)
        start = end
    return ends


@arrow_udf("array<int>")
def _cut_points(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([np.array(cut_points(t or "", s), np.int32) for t, s in zip(texts, sizes)])


def chunk(rows: DataFrame, document: str, text: str, size: int = CHUNK) -> DataFrame:
    """(document, pos, start, end, text) of every chunk."""
    ends = rows.select(F.col(document), F.col(text).alias("__text"), _cut_points(F.col(text), F.lit(size)).alias("__ends"))
    out = exploded(ends, [document, "__text", "__ends"], F.col("__ends"), "end", "pos")
    start = F.when(F.col("pos") == 0, 0).otherwise(F.try_element_at("__ends", F.col("pos")))
    out = out.withColumn("start", start)
    return out.select(document, "pos", "start", "end", F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def fixed_chunks(rows: DataFrame, document: str, text: str, size: int) -> DataFrame:
    """Chunks of equal width, the last one shorter: (document, pos, length)."""
    n = F.ceil(F.length(text) / size).cast("int")
    out = rows.where(F.length(text) > 0).select(document, F.length(text).alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return out.select(document, "pos", F.least(F.lit(size), F.col("__n") - F.col("pos") * size).alias("length"))


def pack(chunks: DataFrame, document: str, pos: str, length: str, most: int = PACK, start: int = 0) -> DataFrame:
    """The chunks from ``start`` on whose running length stays within the budget (a prefix, as lengths are positive)."""
    running = F.sum(length).over(W.partitionBy(document).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow))
    return chunks.where(F.col(pos) >= start).withColumn("running", running).where(F.col("running") <= most)


def verify_quotes(observations: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id", quote: str = "quote", text: str = "text") -> DataFrame:
    """Every observation with ``verified``: is its quotation, non-empty, verbatim in the chunk it names?"""
    joined = observations.join(chunks.select(F.col(chunk_id).alias("__id"), F.col(text).alias("__text")), F.col(chunk_id) == F.col("__id"), "left")
    held = F.coalesce((F.length(quote) > 0) & F.col("__text").contains(F.col(quote)), F.lit(False))
    return joined.withColumn("verified", held).drop("__id", "__text")


def uncovered(offered: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Offered chunks without a receipt; the next pack may start when none is left."""
    return offered.join(covered.select(key).distinct(), key, "left_anti")


def cumulative_cover(receipts: DataFrame, chain: str, order: str, covered: str) -> DataFrame:
    """What has been covered up to each receipt of a chain. A running set of distinct chunks: only a chunk's first receipt
    carries it, so what a window adds up is as large as the chain's chunks, not their square."""
    flat = receipts.select(chain, order, F.explode(covered).alias("__item"))
    first = flat.groupBy(chain, "__item").agg(F.min(order).alias(order)).groupBy(chain, order).agg(F.collect_list("__item").alias("__new"))
    window = W.partitionBy(chain).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = receipts.join(first, [chain, order], "left")
    return joined.withColumn("covered_so_far", F.array_sort(F.flatten(F.collect_list(F.coalesce("__new", F.array().cast(dict(receipts.dtypes)[covered]))).over(window)))).drop("__new")


def next_pack(chunks: DataFrame, offered: DataFrame, covered: DataFrame, document: str, pos: str, length: str, most: int = PACK) -> DataFrame:
    """The next chunks of the documents whose offered chunks all have a receipt; documents with an open one give none."""
    keys = [document, pos]
    open_ = offered.join(covered.select(*keys).distinct(), keys, "left_anti").select(document).distinct()
    last = offered.groupBy(F.col(document).alias("__document")).agg(F.max(pos).alias("__last"))
    rest = chunks.join(open_, document, "left_anti").join(last, F.col(document) == F.col("__document"), "left").where(F.col(pos) > F.coalesce("__last", F.lit(-1)))
    return pack(rest.drop("__document", "__last"), document, pos, length, most)


def receipt_faults(receipts: DataFrame, receipt: str, previous: str, digest: str, claimed: str) -> DataFrame:
    """(receipt, fault) of chains that can't be trusted: a digest that differs, a predecessor that isn't there, is claimed
    twice, or leads back to the receipt (found by following chains at doubled distance)."""
    from scholion.session import cut_lineage

    known = receipts.select(F.col(receipt).alias("__known"))
    changed = receipts.where(~F.col(digest).eqNullSafe(F.col(claimed))).select(receipt, F.lit("changed").alias("fault"))
    missing = receipts.where(F.col(previous).isNotNull()).join(known, F.col(previous) == F.col("__known"), "left_anti").select(receipt, F.lit("missing_predecessor").alias("fault"))
    twice = receipts.where(F.col(previous).isNotNull()).groupBy(F.col(previous).alias("__p")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    forked = receipts.join(twice, F.col(previous) == F.col("__p")).select(receipt, F.lit("forked").alias("fault"))
    step = receipts.select(F.col(receipt).alias("r"), F.col(previous).alias("p"))
    for _ in range(max(1, receipts.count()).bit_length()):  # after as many doublings every chain has ended, unless it is a circle
        step = cut_lineage(step.join(step.select(F.col("r").alias("p"), F.col("p").alias("q")), "p", "left").select("r", F.col("q").alias("p")))
    circle = step.where("p is not null").join(known, F.col("p") == F.col("__known"), "left_semi").select(F.col("r").alias(receipt), F.lit("circle").alias("fault"))
    return changed.unionByName(missing).unionByName(forked).unionByName(circle)


def element_text(kind: str, text: str, caption: str, rows: str) -> Column:
    """What is read of an element: its text, and a table's caption and cells as JSON behind it."""
    table = F.to_json(F.struct(F.col(caption).alias("caption"), F.col(rows).alias("rows")))
    return F.when(F.col(kind) == "table", F.concat_ws("\n", F.nullif(F.col(text), F.lit("")), table)).otherwise(F.col(text))


def locator(chunks: DataFrame, document: str, source_sha: str, text: str, start: str, end: str) -> DataFrame:
    """Where a passage stands: digests of its source and of its own text with the range of characters."""
    return chunks.select(document, F.col(source_sha).alias("source_sha256"), F.sha2(F.col(text), 256).alias("text_sha256"), F.col(start).alias("char_start"), F.col(end).alias("char_end"))


def missing_pages(wanted: DataFrame, done: DataFrame, document: str, page: str, most: int) -> DataFrame:
    """The next pages of each document that aren't extracted yet, at most ``most`` a document, numbered on."""
    open_ = wanted.select(document, page).join(done.select(document, page), [document, page], "left_anti")
    ranked = open_.withColumn("place", F.row_number().over(W.partitionBy(document).orderBy(page)))  # pages of one document
    last = done.groupBy(F.col(document).alias("__document")).agg(F.count(F.lit(1)).alias("__done"))
    joined = ranked.where(F.col("place") <= most).join(last, F.col(document) == F.col("__document"), "left")
    return joined.select(document, page, (F.coalesce("__done", F.lit(0)) + F.col("place")).cast("long").alias("number"))


def rebuild_inverted(index: DataFrame, document: str, word: str, positions: str) -> DataFrame:
    """Text from an inverted index: words in the order of (position, word)."""
    flat = index.select(document, F.col(word).alias("w"), F.explode(positions).alias("p"))
    return flat.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias("text"))
