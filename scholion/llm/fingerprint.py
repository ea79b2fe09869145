"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk of block size 2**j wherever its j lowest bits are zero, so
boundaries follow the content and those of a larger block size are among those of a smaller one. Every chunk
gives one of 64 letters. A fingerprint is ``block size:letters:letters at twice the size``. The block size, 2 at
least, makes about 20 to 40 chunks of the text's bytes; it is halved while there are fewer than 16. The whole text
is covered: were there more than 64 chunks, the last letter would stand for all the rest.

Likeness compares letters of the same block size (equal sizes, or one twice the other) by the edit distance of
insertions and deletions, 1 - distance / (both lengths); the longest common subsequence behind it is computed for
all pairs of a chunk at once, bit-parallel in one 64-bit word a pair. Without a common run of three letters (or
of the whole shorter string) or a common block size it is 0; equal fingerprints give 1.

``edited_pairs`` walks the documents in descending order of id. They are dealt by ranges of the id, each range
also receives the first document of the next one, so no task sees more than its range.

Defined results: a null text reads as empty; two empty texts are alike (1), an empty and another one aren't (0);
rows that share an id follow each other by text; a null id comes after all others; a single document is its own
next. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

WINDOW = 7
LETTERS = 64
LEAST_LEVEL = 1
CHUNKS, LEAST_CHUNKS = 40, 16
RUN = 3
#: The usual base64 alphabet.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_LEAST_ID = -(1 << 63)


@dataclass
class Prints:
    level: np.ndarray  # (n,)
    code: np.ndarray  # (n, 2, LETTERS)
    size: np.ndarray  # (n, 2)

    def __getitem__(self, rows) -> Prints:
        return Prints(self.level[rows], self.code[rows], self.size[rows])

    def strings(self) -> list[str]:
        out = []
        for level, code, size in zip(self.level.tolist(), ALPHABET[self.code], self.size.tolist()):
            out.append(f"{1 << level}:{code[0, : size[0]].tobytes().decode()}:{code[1, : size[1]].tobytes().decode()}")
        return out


def join(a: Prints, b: Prints) -> Prints:
    return Prints(np.r_[a.level, b.level], np.concatenate([a.code, b.code]), np.concatenate([a.size, b.size]))


NONE = Prints(np.zeros(0, np.int64), np.zeros((0, 2, LETTERS), np.uint8), np.zeros((0, 2), np.int64))


def prints(raw: np.ndarray, offsets: np.ndarray) -> Prints:
    n = len(offsets) - 1
    level = np.full(n, LEAST_LEVEL)
    code = np.zeros((n, 2, LETTERS), np.uint8)
    size = np.zeros((n, 2), np.int64)
    if len(raw) == 0:
        return Prints(level, code, size)
    prefix = c.prefix_hash(raw)
    at = np.arange(1, len(raw) + 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    rolled = c.span_hash(prefix, np.maximum(at - WINDOW, offsets[doc]), at)
    depth = np.bitwise_count((rolled & (~rolled + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # trailing zero bits
    ends = np.flatnonzero(depth >= LEAST_LEVEL)
    depth, doc_of = np.minimum(depth[ends], 47), doc[ends]
    final = ends + 1 == offsets[doc_of + 1]
    ends, depth, doc_of = ends[~final], depth[~final], doc_of[~final]  # the text's end closes the last chunk anyway
    grid = np.bincount(doc_of * 48 + depth, minlength=n * 48).reshape(n, 48)
    chunks_at = grid[:, ::-1].cumsum(1)[:, ::-1] + 1
    filled_bytes = np.maximum(np.diff(offsets), 1)
    level = np.maximum(np.ceil(np.log2(filled_bytes / CHUNKS)).astype(np.int64), LEAST_LEVEL)
    enough = (chunks_at >= LEAST_CHUNKS).sum(1) - 1  # the largest level with enough chunks
    level = np.maximum(np.minimum(level, enough), LEAST_LEVEL)
    filled = np.diff(offsets) > 0
    for k in range(2):
        keep = depth >= level[doc_of] + k
        stop = np.sort(np.r_[ends[keep] + 1, offsets[1:][filled]])
        owner = doc[stop - 1]
        rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
        last = np.r_[owner[1:] != owner[:-1], True]
        within = (rank < LETTERS - 1) | last  # the last letter takes all the rest
        stop, owner = stop[within], owner[within]
        start = np.r_[0, stop[:-1]]
        first = np.searchsorted(owner, np.arange(n + 1))
        letter = (c.span_hash(prefix, start, stop) >> np.uint64(32)) & np.uint64(LETTERS - 1)
        code[owner, k, np.arange(len(owner)) - first[owner]] = letter
        size[:, k] = np.diff(first)
    return Prints(level, code, size)


def _common(code_a, size_a, code_b, size_b) -> np.ndarray:
    """2 * longest common subsequence / both lengths, 0 without a common run."""
    n = len(size_a)
    out = np.zeros(n)
    short = np.minimum(size_a, size_b)
    for low in range(0, n, 1024):
        rows = slice(low, low + 1024)
        a, b, la, lb = code_a[rows], code_b[rows], size_a[rows], size_b[rows]
        run = np.minimum(short[rows], RUN)
        m = len(la)
        shared = np.zeros(m, bool)
        for w in range(1, RUN + 1):
            who = np.flatnonzero(run == w)
            if len(who):
                grams = []
                for x, lx in ((a, la), (b, lb)):
                    g = np.zeros((len(who), LETTERS - w + 1), np.int32)
                    for k in range(w):
                        g = g * LETTERS + x[who, k : LETTERS - w + 1 + k]
                    grams.append(np.where(np.arange(LETTERS - w + 1) < (lx[who] - w + 1)[:, None], g, -1 - len(grams)))
                shared[who] = (grams[0][:, :, None] == grams[1][:, None, :]).any((1, 2))
        mask = np.zeros((m, LETTERS), np.uint64)
        row = np.arange(m)
        for k in range(LETTERS):
            inside = la > k
            mask[row[inside], a[inside, k]] |= np.uint64(1) << np.uint64(k)
        v = np.full(m, ~np.uint64(0))
        with np.errstate(over="ignore"):
            for k in range(LETTERS):
                u = v & np.where(lb > k, mask[row, b[:, k]], np.uint64(0))
                v = (v + u) | (v - u)
        length = np.bitwise_count(~v).astype(float)
        out[rows] = np.where(shared, 2 * length / np.maximum(la + lb, 1), 0)
    return out


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """0 to 1 for each pair of rows."""
    out = np.zeros(len(a.level))
    for ka in range(2):
        for kb in range(2):
            rows = np.flatnonzero((a.level + ka == b.level + kb) & ((ka == kb) | (ka + kb == 1)))
            if len(rows):
                out[rows] = np.maximum(out[rows], _common(a.code[rows, ka], a.size[rows, ka], b.code[rows, kb], b.size[rows, kb]))
    same = (a.level == b.level) & (a.size == b.size).all(1) & (a.code == b.code).all((1, 2))
    return np.where(same, 1.0, out)


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in c.chunks(batch, "text"):
                found = prints(*c.text_buffer(c.column(part, "text")))
                yield pa.RecordBatch.from_arrays([c.column(part, "id"), c.column(part, "n_chars"), pa.array(found.strings())], ["id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", id_column)


def _walk(batches):
    """Rows of one or more ranges, each in walking order with its tail last."""
    held_range, held_id, held_text, held = None, None, None, NONE
    for batch in batches:
        for part in c.chunks(batch, "text"):
            own = prints(*c.text_buffer(c.column(part, "text")))
            ids, ranges, tails = (c.column(part, x).to_pylist() for x in ("id", "range", "tail"))
            texts = [x or "" for x in c.column(part, "text").to_pylist()]
            if held_range is not None:
                ids, ranges, tails, texts = [held_id, *ids], [held_range, *ranges], [False, *tails], [held_text, *texts]
                own = join(held, own)
            # a document's next is the row below it; a tail only serves as one
            now = [k for k in range(len(ids) - 1) if not tails[k] and ranges[k] == ranges[k + 1]]
            if now:
                edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in now]
                index = np.array(now)
                changed = NONE
                encoded = pa.record_batch([pa.array(edited, pa.large_string())], ["text"])
                for piece in c.chunks(encoded, "text"):
                    changed = join(changed, prints(*c.text_buffer(c.column(piece, "text"))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in now], part.schema.field("id").type),
                        pa.array([len(texts[k]) for k in now], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array(own[index].strings()),
                        pa.array(changed.strings()),
                        pa.array(likeness(own[index], changed)),
                        pa.array(likeness(own[index], own[index + 1])),
                    ],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            held_range = None
            if ids and not tails[-1]:
                held_range, held_id, held_text, held = ranges[-1], ids[-1], texts[-1], own[-1:]


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its second half replaced by the next one's start)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("place", F.coalesce("id", F.lit(_LEAST_ID)))
    n = c.shuffle_partitions(spark)
    bounds = sorted({int(x) for x in rows.approxQuantile("place", [k / n for k in range(1, n)], 0.25 / n)}) if n > 1 else []
    marks = ",".join(f"{b}L" if b > _LEAST_ID else "(-9223372036854775807L - 1L)" for b in bounds)
    rows = rows.withColumn("range", F.expr(f"size(filter(array({marks}), b -> b <= place))") if bounds else F.lit(0))
    tops = [(r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max("place").alias("top")).collect()]  # one row a range
    tops.sort(reverse=True)
    to = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}  # the first range's top closes the last range
    if not to:
        return rows.selectExpr(
            f"id as {id_column}", "0L as n_chars", "'' as edited_sha256", "'' as fingerprint", "'' as edited_fingerprint", "0D as near_edited", "0D as near_next"
        )
    target = F.element_at(F.create_map(*[x for k, v in to.items() for x in (F.lit(k).cast("long"), F.lit(v))]), F.col("place"))
    dealt = rows.select(
        "id",
        "text",
        "place",
        F.explode(
            F.when(target.isNotNull(), F.array(F.struct("range", F.lit(False).alias("tail")), F.struct(target.alias("range"), F.lit(True).alias("tail")))).otherwise(
                F.array(F.struct("range", F.lit(False).alias("tail")))
            )
        ).alias("to"),
    ).select("id", "text", "place", "to.range", "to.tail")
    return (
        dealt.repartitionByRange(n, "range")
        .sortWithinPartitions("range", "tail", F.desc("place"), "text")
        .select("id", "text", "range", "tail")
        .mapInArrow(_walk, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
        .withColumnRenamed("id", id_column)
    )
