"""Author names: keys that two spellings of a person share, and how well two author lists agree.

Agreement is the size of a maximum matching between the lists, so a surname that repeats counts once a person. The
matching is found in phases: every phase layers the free names by breadth-first search and then takes a maximal set of
disjoint shortest augmenting paths, on index arrays and without recursion.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scholion.functions import normalize as n
from scholion.functions.arrow import arrow_udf

#: A first or last part up to this length is read as initials.
INITIALS = 3


def _parts(name: str) -> list[str]:
    folded = unicodedata.normalize("NFKC", name or "").casefold()
    return "".join(ch if ch.isalnum() else " " for ch in folded).split()


def name_keys(name: str) -> frozenset[tuple[str, str]]:
    """(surname, initial) pairs a name may stand for: one where its order shows, both orders else, none for a single word."""
    parts = _parts(name)
    if len(parts) < 2:
        return frozenset()
    given_last, given_first = (" ".join(parts[:-1]), parts[-1][0]), (" ".join(parts[1:]), parts[0][0])
    for short, reading in ((parts[-1], given_last), (parts[0], given_first)):
        if len(short) <= INITIALS:
            return frozenset([reading])
    return frozenset([(parts[-1], parts[0][0]), (parts[0], parts[-1][0])])


def maximum_matching(reach: list[list[int]], n_right: int) -> int:
    """Size of a maximum matching; ``reach[i]`` lists the right sides of i."""
    mate_left, mate_right = [-1] * len(reach), [-1] * n_right
    while True:
        layer = [0 if m < 0 else -1 for m in mate_left]
        queue, ends = [i for i, m in enumerate(mate_left) if m < 0], False
        for i in queue:  # grows while it is read
            for j in reach[i]:
                k = mate_right[j]
                if k < 0:
                    ends = True
                elif layer[k] < 0:
                    layer[k] = layer[i] + 1
                    queue.append(k)
        if not ends:
            return sum(m >= 0 for m in mate_left)
        tried = [0] * len(reach)
        for root in [i for i, m in enumerate(mate_left) if m < 0]:
            path = [root]
            while path:
                i = path[-1]
                if tried[i] == len(reach[i]):
                    path.pop()
                    continue
                j = reach[i][tried[i]]
                tried[i] += 1
                k = mate_right[j]
                if k < 0:  # every name on the path takes the side it tried last
                    for i in path:
                        j = reach[i][tried[i] - 1]
                        mate_left[i], mate_right[j] = j, i
                    break
                if layer[k] == layer[i] + 1:
                    path.append(k)


def agreement(a: list[str], b: list[str]) -> dict:
    left, right = [name_keys(x) for x in a], [name_keys(x) for x in b]
    holders: dict[tuple[str, str], list[int]] = {}
    for j, keys in enumerate(right):
        for key in keys:
            holders.setdefault(key, []).append(j)
    matched = maximum_matching([sorted({j for key in keys for j in holders.get(key, ())}) for keys in left], len(right))
    shorter, longer = sorted((len(left), len(right)))
    first = bool(left and right and left[0] & right[0])
    enough = matched >= 2 or (shorter == 1 and first)
    return {
        "matched": matched, "shorter": shorter, "longer": longer, "first": first,
        "compatible": bool(shorter) and enough and 10 * matched >= 6 * shorter, "disjoint": bool(shorter) and not matched,
    }


@arrow_udf("matched int, shorter int, longer int, first boolean, compatible boolean, disjoint boolean")
def author_evidence(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([agreement(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)])


def key_column(names) -> Column:
    """The name keys of an array of names as 'surname|initial', without Python."""
    parts = F.transform(F.coalesce(F.col(names) if isinstance(names, str) else names, F.array().cast("array<string>")), lambda x: F.split(n.title(x), " "))
    join = lambda x, start, size: F.array_join(F.slice(x, start, size), " ")
    key = lambda surname, given: F.concat(surname, F.lit("|"), F.substring(given, 1, 1))

    def keys(p: Column) -> Column:
        size, first, last = F.size(p), F.element_at(p, 1), F.element_at(p, -1)
        return (
            F.when(size < 2, F.array().cast("array<string>"))
            .when(F.length(last) <= INITIALS, F.array(key(join(p, 1, size - 1), last)))
            .when(F.length(first) <= INITIALS, F.array(key(join(p, 2, size - 1), first)))
            .otherwise(F.array(key(last, first), key(first, last)))
        )

    return F.array_distinct(F.flatten(F.transform(parts, keys)))


def match_tokens(names) -> Column:
    """First and last part of every name, of more than two letters: what two styles of a name have in common."""
    parts = F.transform(F.coalesce(F.col(names) if isinstance(names, str) else names, F.array().cast("array<string>")), lambda x: F.split(n.title(x), " "))
    ends = F.flatten(F.transform(parts, lambda p: F.array(F.element_at(p, 1), F.element_at(p, -1))))
    return F.array_distinct(F.filter(ends, lambda x: F.length(x) > 2))


def same_publication(doi_a, doi_b, title_a, title_b, year_a, year_b, authors_a, authors_b) -> Column:
    """Equal DOIs where both are known; else equal non-empty titles, equal years and a shared author token."""
    a, b = n.doi(doi_a), n.doi(doi_b)
    name = n.title(title_a)
    described = (
        (name != "") & (name == n.title(title_b)) & F.coalesce(F.col(year_a) == F.substring(F.col(year_b).cast("string"), 1, 4).try_cast("int"), F.lit(False))
        & F.arrays_overlap(match_tokens(authors_a), match_tokens(authors_b))
    )
    return F.when((a != "") & (b != ""), a == b).otherwise(F.coalesce(described, F.lit(False)))


def equal_title_pairs(a: DataFrame, b: DataFrame, node: str, part: int = 2000) -> DataFrame:
    """(a, b, same) for every record of ``a`` with every one of ``b`` of an equal non-empty title: ``same_publication`` of rows (node,
    raw_doi, title, year, authors). DOI, year and tokens are read once a record, the title is a digest from then on, and a
    frequent title is met in cells of two parts of about ``part`` records."""

    def slim(rows: DataFrame, side: str) -> DataFrame:
        name = n.title("title")
        return rows.where(name != "").select(
            F.sha2(name, 256).alias("of"), F.col(node).alias(side), F.nullif(n.doi("raw_doi"), F.lit("")).alias(f"{side}_doi"), F.substring(F.col("year").cast("string"), 1, 4).try_cast("int").alias(f"{side}_y"),
            F.col("year").alias(f"{side}_year"), match_tokens("authors").alias(f"{side}_tokens"),
        )

    left, right = slim(a, "a"), slim(b, "b")
    count = lambda rows, side: rows.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias(f"{side}_parts"))
    sizes = count(left, "a").join(count(right, "b"), "of")

    def dealt(rows: DataFrame, side: str, other: str) -> DataFrame:
        met = rows.join(sizes, "of").withColumn(f"{side}_part", F.pmod(F.xxhash64(side), f"{side}_parts").cast("int"))
        return met.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).drop("a_parts", "b_parts")

    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows make many pairs: not as few tasks as their bytes fill
    cell = ["of", "a_part", "b_part"]
    pairs = dealt(left, "a", "b").repartition(tasks, *cell).hint("merge").join(dealt(right, "b", "a").repartition(tasks, *cell), cell)
    described = F.coalesce((F.col("a_year") == F.col("b_y")) & F.arrays_overlap("a_tokens", "b_tokens"), F.lit(False))
    same = F.when(F.col("a_doi").isNotNull() & F.col("b_doi").isNotNull(), F.col("a_doi") == F.col("b_doi")).otherwise(described)
    return pairs.select("a", "b", same.alias("same"))


def shared_author_pairs(rows: DataFrame, node: str, names: str, *more: str, part: int = 200) -> DataFrame:
    """Pairs (a, b, …) of records that share an author key, each pair once, without a task for a frequent name.

    A key's records are dealt into parts of about ``part``; every two parts of a key meet in a cell of their own.
    """
    keyed = rows.select(node, *more, F.explode(key_column(names)).alias("key"))
    sizes = keyed.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"), F.count(F.lit(1)).alias("members")).where("members > 1")
    parted = keyed.join(sizes, F.col("key") == F.col("of")).withColumn("part", F.pmod(F.xxhash64(node), "parts").cast("int"))
    left = parted.select(F.col(node).alias("a"), "key", F.col("part").alias("low"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("high"), *[F.col(x).alias(f"a_{x}") for x in more])
    right = parted.select(F.col(node).alias("b"), F.col("key").alias("key_b"), F.col("part").alias("high_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("low_b"), *[F.col(x).alias(f"b_{x}") for x in more])
    met = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("low") == F.col("low_b")) & (F.col("high") == F.col("high_b")) & (F.col("a") < F.col("b")))
    return met.select("a", "b", *[f"{s}_{x}" for x in more for s in "ab"]).dropDuplicates(["a", "b"])
