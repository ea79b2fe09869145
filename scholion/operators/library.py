"""Fuzzy match of records against a whole library of titles.

Titles that stand in the library letter by letter are joined. A ratio of ``least`` or more bounds how far two lengths are
apart, so each other title meets the library's titles of its own band of lengths and of the two beside it, in cells of
two parts of at most ``PART`` titles and about ``LETTERS`` letters. In a cell, the bags of letters tell most pairs apart
(``families.Bags``); what is left is compared by its matching ratio, against the best one found so far. No title needs to
share its first words with another. Pairs grow with the square of the titles of a length, cells and their memory don't.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.operators.families import Bags, matching_ratio

LEAST = 0.92
SHORTEST = 20
PART, LETTERS = 2000, 4 << 20
#: Two titles can only agree to six digits without being equal if they have more letters than that.
ROUNDED = 500_000


def _banded(titles: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Titles with their band and a part of it; the parts of each band."""
    width = math.log((2 - least) / least) + 1e-9
    rows = titles.withColumn("band", F.floor(F.log(F.length("title")) / width).cast("int"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum(F.length("title")) / LETTERS)).cast("int")
    sizes = rows.groupBy(F.col("band").alias("of")).agg(parts.alias("parts"))
    return rows.join(sizes, F.col("band") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("title"), "parts").cast("int")).drop("of", "parts"), sizes


def _met(own: DataFrame, others: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """Each title once for every part of the bands that it meets."""
    band, part, its, other = names
    near = own.withColumn("its", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    dealt = near.join(others, F.col("its") == F.col("of")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(F.col("band").alias(band), F.col("part").alias(part), F.col("its").alias(its), F.col("other").alias(other), "title", "item")


def fuzzy_matches(records: DataFrame, items: DataFrame, key: str, item: str, title: str, least: float = LEAST) -> DataFrame:
    """(key, item, similarity): for each record whose folded title has ``SHORTEST`` letters or more the most similar item, the
    smallest of equals, if its ratio is at least ``least``. ``title`` names the folded title in both."""
    kind = items.schema[item].dataType.simpleString()
    mine = records.where(F.length(title) >= SHORTEST).select(F.col(title).alias("title")).distinct()
    theirs = items.where(F.col(title) != "").groupBy(F.col(title).alias("title")).agg(F.min(item).alias("item"))
    held = mine.join(theirs, "title", "left")
    equal = held.where("item is not null").select("title", F.lit(1.0).alias("ratio"), "item")
    left, left_sizes = _banded(held.where(F.col("item").isNull() | (F.length("title") > ROUNDED)).withColumn("item", F.lit(None).cast(kind)), least)
    right, right_sizes = _banded(theirs, least)
    cell = ("a_band", "a_part", "b_band", "b_part")
    met = _met(left, right_sizes, cell).unionByName(_met(right, left_sizes, (*cell[2:], *cell[:2])))

    def compare(table: pa.Table) -> pa.Table:
        titles, ids = table["title"].to_pylist(), table["item"].to_pylist()
        a, b = [t for t, i in zip(titles, ids) if i is None], [(t, i) for t, i in zip(titles, ids) if i is not None]
        out, mine, theirs = [], Bags(a), Bags([t for t, _ in b])
        for k, x in enumerate(a if b else ()):
            at = theirs.near(mine, k, 0, least - 1e-6)
            best = None
            for p in at[np.argsort(np.abs(theirs.couples[at] - mine.couples[k]).sum(1), kind="stable")]:
                y, its = b[p]
                ratio = matching_ratio(x, y, (best[0] if best else least) - 1e-6)
                ratio = round(ratio, 6) if ratio is not None else 0.0
                if ratio >= least and (best is None or (-ratio, its) < (-best[0], best[1])):
                    best = ratio, its
            if best:
                out.append((x, *best))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"title": pa.array(columns[0], table["title"].type), "ratio": pa.array(columns[1], pa.float64()), "item": pa.array(columns[2], table["item"].type)})

    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows and much work
    near = met.repartition(tasks, *cell).groupBy(*cell).applyInArrow(compare, f"title string, ratio double, item {kind}")
    best = equal.unionByName(near).groupBy("title").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "item")).alias("best"))
    out = records.select(key, F.col(title).alias("title")).join(best, "title")
    return out.select(key, F.col("best.item").alias(item), F.round(-F.col("best.less"), 4).alias("similarity"))
