"""Identity of queues, judgments of benchmark works and their lookup by any alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ambiguous_ids(rows: DataFrame, key: str, node: str) -> DataFrame:
    """(key, holders, first) of ids that several rows hold; a queue with any is refused."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("holders"), F.min(node).alias("first")).where("holders > 1")


def require_unique(rows: DataFrame, key: str, node: str) -> DataFrame:
    """The rows, or an error that names an id held twice."""
    bad = ambiguous_ids(rows, key, node).head()
    if bad is not None:
        raise ValueError(f"{key} {bad[0]!r} is held by {bad.holders} rows; make a new inventory")
    return rows


def select_exactly_one(rows: DataFrame, aliases: str, wanted: DataFrame, alias: str = "alias") -> DataFrame:
    """(alias, matches, row): every requested alias with how many rows carry it; the row only where it is one."""
    held = rows.select(F.struct(*[x for x in rows.columns if x != aliases]).alias("row"), F.explode(F.array_distinct(F.transform(aliases, lambda k: F.lower(k)))).alias("__alias"))
    joined = wanted.join(held, F.lower(alias) == F.col("__alias"), "left")
    out = joined.groupBy(alias).agg(F.count("row").alias("matches"), F.first("row", ignorenulls=True).alias("row"))
    return out.withColumn("row", F.when(F.col("matches") == 1, F.col("row")))


def judge(records: DataFrame, node: str, aliases: str, judgments: DataFrame, judgment: str, ids: str, relevant: str) -> DataFrame:
    """(node, judgment, relevant, conflict): the judged work that any alias of a record names; null where none does,
    ``conflict`` where aliases name several."""
    mine = records.select(node, F.explode(F.array_distinct(aliases)).alias("alias"))
    theirs = judgments.select(F.col(judgment).alias("__j"), F.col(relevant).alias("__r"), F.explode(F.array_distinct(ids)).alias("__alias"))
    found = mine.join(theirs, F.col("alias") == F.col("__alias")).groupBy(node).agg(F.min("__j").alias(judgment), F.max("__j").alias("__last"), F.min_by("__r", "__j").alias(relevant))
    return records.select(node).join(found, node, "left").select(node, judgment, relevant, F.coalesce(F.col(judgment) != F.col("__last"), F.lit(False)).alias("conflict"))
