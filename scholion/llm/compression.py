"""Vector code compression: product codes from weighted Lloyd rounds over distinct parts.

Components become integers floor(256 x); a vector is cut into ``PARTS`` equal parts, each position with a codebook of
``ENTRIES`` entries. Equal integer parts of a position are one row with a weight (a partial sum in every task, so a
part that a third of all vectors share costs as much as any other), and all of Lloyd runs over those: a task assigns its distinct
rows by matrix products and returns sums and counts for each entry, at most ``PARTS * ENTRIES`` rows, from which the driver
makes the next codebooks. All arithmetic is in integers: products run in double precision only while they are exact.

Codes and errors are then joined back to the vectors by (position, part). A part of more than a
``1 / HEAVY``-th of all vectors is joined as a broadcast, of which at most ``HEAVY`` exist for each position at any size; the
others are shuffled, so no key of that join is hot. Errors by label come back in the same way.

Defined results: vectors that are null, or hold null or non-finite components, are dropped; an empty vector is kept with
codes 0 and error 0. Vectors of different lengths have codebooks of their own, from the smallest ids of their length; a
length that ``PARTS`` doesn't divide is cut at floor(k * length / PARTS). Components beyond 2**27 in magnitude count as 2**27.
Rows that share an id are rows of their own; ties among the smallest ids go by the vector; null ids come last. With
fewer than ``ENTRIES`` vectors a codebook has as many entries. Equal labels, nulls together, add up their errors, null where
the sum exceeds 64 bits. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 27
HEAVY = 1000
ROWS = 4096  # distinct parts a matrix product


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, ints, row) of the vectors that hold finite components only; ``row`` names a row."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    label = "label" if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", label, F.transform(vector, whole).alias("ints"), F.monotonically_increasing_id().alias("row"))


def bounds(length: int, parts: int = PARTS) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def first_codebooks(kept: DataFrame, length: int, entries: int = ENTRIES) -> list[np.ndarray]:
    """By position the parts of the smallest ids: (entries, width) integers."""
    few = kept.where(F.size("ints") == length).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    rows = np.array([r.ints for r in few], np.int64).reshape(len(few), length)
    cut = bounds(length)
    return [rows[:, a:b] for a, b in zip(cut, cut[1:])]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``parts``; the lowest of equally near entries. Exact."""
    largest = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    exact = 4 * max(parts.shape[1], 1) * largest * largest < 1 << 53
    x, y = (parts.astype(float), book.astype(float)) if exact else (parts, book)
    distance = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    entry = distance.argmin(1)
    return entry, distance[np.arange(len(x)), entry].astype(np.int64)


def _parts(batch: pa.RecordBatch):
    """Slices of a batch of (length, position, part, ...) with equal length and position: (length, position, rows, parts)."""
    length, position = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
    parts = batch.column(2)
    flat, offsets = parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(parts.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(offsets)])
    for key in np.unique(length.astype(np.int64) << 16 | position):
        rows = np.flatnonzero((length.astype(np.int64) << 16 | position) == key)
        width = offsets[rows[0]]
        for at in range(0, len(rows), ROWS):
            mine = rows[at : at + ROWS]
            yield int(key >> 16), int(key & 0xFFFF), mine, flat[starts[mine][:, None] + np.arange(width)]


def lloyd_round(distinct: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """The codebooks after every distinct part went to its nearest entry with its weight."""

    def sums(batches):
        total: dict[tuple, list] = {}
        for batch in batches:
            weights = batch.column(3).to_numpy(zero_copy_only=False)
            for length, position, rows, parts in _parts(batch):
                entry, _ = nearest(parts, books[length][position])
                used, of = np.unique(entry, return_inverse=True)
                added = np.zeros((len(used), parts.shape[1] + 1), np.int64)
                np.add.at(added, of, np.column_stack([parts * weights[rows][:, None], weights[rows]]))
                for k, row in zip(used.tolist(), added):
                    at = total.setdefault((length, position, k), np.zeros(len(row), np.int64))
                    at += row
        out = [{"length": k[0], "position": k[1], "entry": k[2], "sums": v.tolist()} for k, v in total.items()]
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("length", pa.int32()), ("position", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])
    partial = distinct.mapInArrow(sums, "length int, position int, entry int, sums array<long>")
    summed = partial.select("length", "position", "entry", F.posexplode("sums").alias("at", "value")).groupBy("length", "position", "entry", "at").agg(F.sum("value").alias("value"))
    after = {n: [b.copy() for b in book] for n, book in books.items()}
    totals: dict[tuple, dict[int, int]] = {}
    for r in summed.collect():  # a number for each component of the codebooks, and a count an entry
        totals.setdefault((r.length, r.position, r.entry), {})[r["at"]] = r.value
    for (length, position, entry), sums_ in totals.items():
        width = after[length][position].shape[1]
        after[length][position][entry] = [sums_[j] // sums_[width] for j in range(width)]
    return after


def book_digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def assigned(distinct: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """(length, position, part, weight, entry, error) of every distinct part."""

    def assign(batches):
        for batch in batches:
            entries, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for length, position, rows, parts in _parts(batch):
                entries[rows], errors[rows] = nearest(parts, books[length][position])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entries), pa.array(errors)], [*batch.schema.names, "entry", "error"])

    return distinct.mapInArrow(assign, "length int, position int, part array<int>, weight long, entry int, error long")


def joined(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row for each of their keys and its ``weight``, the number of rows with it.

    Keys of more than a ``1 / HEAVY``-th of the ``total`` rows are fewer than ``HEAVY`` for each such total and are broadcast.
    """
    named = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[x for x in found.columns if x not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    gone = [f"__{k}" for k in keys] + ["weight"]
    heavy = named.where(F.col("weight") * HEAVY > total)
    light = named.where(F.col("weight") * HEAVY <= total)
    first = rows.join(F.broadcast(heavy), same, "left")
    done = first.where("weight is not null").drop(*gone)
    open_rows = first.where("weight is null").select(*rows.columns)
    return done.unionByName(open_rows.join(light, same).drop(*gone))


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) of every vector that is kept."""
    spark = vectors.sparkSession
    kept = c.cut_lineage(integers(vectors, vector))
    lengths = {r.length: r.n for r in kept.groupBy(F.size("ints").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    books = {n: first_codebooks(kept, n, entries) for n in lengths}
    total = sum(lengths.values())
    places = F.array(*[F.struct(F.lit(k).alias("position"), F.floor(F.size("ints") * k / parts).cast("int").alias("low"), F.floor(F.size("ints") * (k + 1) / parts).cast("int").alias("high")) for k in range(parts)])
    split = kept.select("row", F.size("ints").alias("length"), "ints", F.explode(places).alias("p"))
    split = split.select("row", "length", F.col("p.position").alias("position"), F.slice("ints", F.col("p.low") + 1, F.col("p.high") - F.col("p.low")).alias("part"))
    distinct = c.cut_lineage(split.groupBy("length", "position", "part").agg(F.count(F.lit(1)).alias("weight")))
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    coded = joined(split, c.cut_lineage(assigned(distinct, books)), ["length", "position", "part"], total)
    digits = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    byrow = coded.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", digits.alias("digits")))), lambda x: x["digits"]), "").alias("code"),  # parts of one vector
        F.sum("error").alias("error"),
    )
    digests = spark.createDataFrame([(n, book_digest(b)) for n, b in books.items()], "__length int, codebooks_sha256 string")
    whole = kept.select("row", "vec_id", "label", F.size("ints").alias("__size")).join(byrow, "row").join(F.broadcast(digests), F.col("__size") == F.col("__length")).drop("row", "__size", "__length")
    whole = c.cut_lineage(whole)
    labels = whole.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight"))
    return joined(whole, labels, ["label"], total).select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")


def _sql_assign(name: str, books: str) -> str:
    """Nearest entries of all parts, as a table ``name`` (vec_id, position, part, entry, error)."""
    return f"""{name}_far AS (SELECT p.vec_id, p.position, p.part, b.entry,
    list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - b.part[i]) * (p.part[i] - b.part[i]))) AS distance
  FROM parts p JOIN {books} b ON p.position = b.position),
{name} AS (SELECT vec_id, position, any_value(part) AS part, min_by(entry, distance * {ENTRIES} + entry) AS entry, CAST(min(distance) AS BIGINT) AS error
  FROM {name}_far GROUP BY vec_id, position)"""


def _sql_round(books: str, after: str) -> str:
    return f"""{_sql_assign(f"{after}_near", books)},
{after}_sums AS (SELECT position, entry, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS value
  FROM {after}_near, (SELECT unnest(range(1, 1 + (SELECT max(len(part)) FROM parts))) AS i) WHERE i <= len(part) GROUP BY position, entry, i),
{after}_moved AS (SELECT position, entry, list(value ORDER BY i) AS part FROM {after}_sums GROUP BY position, entry),
{after} AS (SELECT b.position, b.entry, coalesce(m.part, b.part) AS part FROM {books} b LEFT JOIN {after}_moved m ON m.position = b.position AND m.entry = b.entry)"""


#: For vectors of one length that 16 divides, with distinct ids.
ORACLE = f"""
WITH ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, k AS position, v[CAST(k * len(v) // {PARTS} AS INT) + 1 : CAST((k + 1) * len(v) // {PARTS} AS INT)] AS part FROM ints, (SELECT unnest(range({PARTS})) AS k)),
smallest AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ints ORDER BY vec_id LIMIT {ENTRIES}),
books0 AS (SELECT p.position, s.entry, p.part FROM smallest s JOIN parts p USING (vec_id)),
{_sql_round("books0", "books1")},
{_sql_round("books1", "books2")},
{_sql_assign("final", "books2")},
digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM books2),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, CAST(sum(error) AS BIGINT) AS error FROM final GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label
FROM coded JOIN ints USING (vec_id), digest
"""
