"""Mixing sources to target weights by Poisson replication.

A source of n_s of the N rows whose target share is w_s gets the rate w_s * N / n_s, so the expected output has N
rows in the target proportions. Every row is repeated Poisson(rate) times: its uniform number is a digest of the
seed, its id and its text, so a rerun, or a retried task, repeats the same rows. Rates above ``LARGEST_RATE`` are split into a
sum of equal smaller ones with a number each. All copies are then dealt by a digest of seed, id, text and copy and sorted
by it: a global shuffle in one exchange, in which neither a hot source nor a document's copies stay together.

Only DataFrame functions run. The table of rates has a row a source; it is broadcast up to ``BROADCAST_SOURCES``
rows and otherwise joined with salted keys.

Defined results: null is a source of its own; sources without a target weight get none and vanish; rows of
one id, or without an id, draw by their texts; only rows equal in id and text are repeated alike; a null text is kept, and
draws apart from an empty one; input columns named as the added ones
(``copy``, ``shuffle_key``) are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_SOURCES = 10_000
LARGEST_RATE = 32.0
SALTS = 32
DEFAULT_POWER = 0.5


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: float) -> list[float]:
    """The distribution function at 0, 1, ... up to its last value below 1."""
    out, k, total = [], 0, 0.0
    while total < 1 - 1e-15 and k < rate + 40 * math.sqrt(rate) + 40:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else 1.0
        out.append(min(total, 1.0))
        k += 1
    return out


def rates(docs: DataFrame, weights: dict | None = None, source: str = "source", power: float = DEFAULT_POWER) -> DataFrame:
    """(source, rate): from the given weights, or from shares to the ``power`` of the sources' sizes."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        pairs = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "name string, weight double")
        sizes = sizes.join(F.broadcast(pairs), F.col("source").cast("string").eqNullSafe(F.col("name"))).drop("name")
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).head()
    rows = docs.count() if weights is not None else (total.n or 0)
    return sizes.select("source", (F.col("weight") / F.lit(total.w or 1.0) * F.lit(float(rows)) / F.col("n")).alias("rate"))


def replicate(
    docs: DataFrame, weights: dict | None = None, seed: int = 1, id_column: str = "doc_id", source: str = "source", power: float = DEFAULT_POWER, text: str = "text"
) -> DataFrame:
    """The columns of ``docs`` with ``copy`` (1, 2, ...) and ``shuffle_key``, in shuffled order."""
    spark = docs.sparkSession
    docs = docs.drop("copy", "shuffle_key")
    table = rates(docs, weights, source, power)
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_RATE), F.lit(1)).cast("int")
    table = table.select(F.col("source").alias("__source"), parts.alias("__parts"), (F.col("rate") / parts).alias("__rate"))
    few = table.limit(BROADCAST_SOURCES + 1).collect()
    # below the join, so that a text is digested once whatever the number of steps it is compared with
    digested = docs.withColumn("__digest", F.md5(F.col(text).cast("binary")) if text in docs.columns else F.lit(None).cast("string"))
    # the distribution functions, a short list a source
    kind = table.schema["__source"].dataType.simpleString()
    if len(few) <= BROADCAST_SOURCES:
        lists = spark.createDataFrame([(r[0], r[1], poisson_steps(r[2])) for r in few], f"__source {kind}, __parts int, __steps array<double>")
        rows = digested.join(F.broadcast(lists), digested[source].eqNullSafe(lists["__source"]))
    else:

        def steps(batches):
            for pdf in batches:
                yield pdf.assign(__steps=[poisson_steps(x) for x in pdf["__rate"]]).drop(columns="__rate")

        lists = table.mapInPandas(steps, f"__source {kind}, __parts int, __steps array<double>")
        lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = digested.withColumn("__by", F.pmod(F.xxhash64(id_column, "__digest"), F.lit(SALTS)).cast("int"))
        rows = salted.join(lists, salted[source].eqNullSafe(lists["__source"]) & (F.col("__by") == F.col("__salt"))).drop("__by", "__salt")
    named = (F.col(id_column), F.col("__digest"))
    one = uniform(seed, *named)
    more = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda n, k: n + F.size(F.filter("__steps", lambda s: s <= uniform(seed, *named, k))),
    )
    count = F.when(F.col("__parts") == 1, F.size(F.filter("__steps", lambda s: s <= F.col("__u")))).otherwise(more)
    rows = rows.withColumn("__u", one).withColumn("__n", count).where("__n > 0")
    out = rows.select(*docs.columns, "__digest", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(id_column), F.col("__digest"), F.col("copy"))).drop("__digest")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_column, "copy")


ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n, {DEFAULT_POWER}) / (SELECT sum(pow(n, {DEFAULT_POWER})) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS step
  FROM rates, (SELECT unnest(range(0, 200)) AS k)),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('1:' || coalesce('' || doc_id, '') || ':' || coalesce(md5(text), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.source = d.source AND s.step <= d.u AND s.step < 1 - 1e-15) AS n
  FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM counted WHERE n > 0
"""
