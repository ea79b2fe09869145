"""Language ID: prediction by partial matching over bytes, one frozen context tree per language.

Each tree counts which byte follows the contexts of 0 to 3 bytes before it (case folded; a text starts after
line ends). A byte costs -log2(n / (N + T)) bits in the longest context that has seen it, plus
-log2(T / (N + T)) for every longer seen context that escapes (N bytes seen there, T of them different); bytes
no context has seen cost 8 bits. A text's language is the one whose tree gives it the shortest code.

Fitting: n-gram counts are summed on the cluster over a hash sample of the labelled rows of about
``SAMPLE_DOCS`` texts a language; only the counts reach the driver, which bakes trees into lookup tables, so that
scoring costs a few table reads a byte for all languages together. Every byte value met in fitting is a symbol of its
own; the others, which no context of any language has seen, share one, and all escape to the last level alike.

Defined results: ``und`` with score 0 for a null text, one without a letter, and for every text if nothing was
learned; equal code lengths go to the smallest name; null ids, repeated rows and other columns pass through
unread; an empty table gives no rows. A letter is a code point of Unicode category L. The score is the share of the best
language in 2**-(``TEMPER`` * bits a byte), so it tells how far the next language is whatever the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

ORDER = 3
SAMPLE_DOCS = 3000
TEMPER = 4
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = _ASCII_LETTER[65:91] = True


def windows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(4, bytes): each byte after the three before it, line ends before a text's first byte."""
    out = np.full((ORDER + 1, len(raw)), 10, np.uint8)
    out[ORDER] = raw
    for back in range(1, ORDER + 1):
        out[ORDER - back, back:] = raw[:-back]
        for k in range(back):  # these bytes belong to the text before
            at = offsets[:-1] + k
            at = at[at < offsets[1:]]
            out[ORDER - back, at] = 10
    return out


def gram_codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = windows(c.fold(raw), offsets).astype(np.uint32)
    return (rows[0] << 24) | (rows[1] << 16) | (rows[2] << 8) | rows[3]


@dataclass
class Trees:
    names: list[str]
    symbol: np.ndarray  # byte -> symbol
    size: int  # number of symbols; 0 is that of all bytes never seen
    one: np.ndarray  # (context, symbol, language): bits with one byte of context or less
    escape2: np.ndarray  # (context of two, language)
    table3: np.ndarray  # context of two and symbol -> row of rows3; 0: never seen
    rows3: np.ndarray
    context3: np.ndarray  # context of three -> its number; 0: never seen
    escape3: np.ndarray
    table4: np.ndarray
    rows4: np.ndarray

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): exact code lengths."""
        total = np.zeros((len(offsets) - 1, len(self.names)))
        if len(raw) == 0:
            return total
        s = self.symbol[windows(c.fold(raw), offsets)].astype(np.int64)
        context = self.context3[(s[0] * self.size + s[1]) * self.size + s[2]].astype(np.int64)
        row = self.table4[context * self.size + s[3]]
        each = self.rows4[row]
        miss = np.flatnonzero(row == 0)
        each[miss] = self.escape3[context[miss]] + self.two(s[1][miss], s[2][miss], s[3][miss])
        some = np.flatnonzero(np.diff(offsets) > 0)
        total[some] = np.add.reduceat(each, offsets[:-1][some], axis=0, dtype=np.float64)
        return total

    def two(self, b, a, s) -> np.ndarray:
        """Bits of s after b, a with two bytes of context or less."""
        row = self.table3[(b * self.size + a) * self.size + s]
        out = self.rows3[row]
        miss = np.flatnonzero(row == 0)
        out[miss] = self.escape2[b[miss] * self.size + a[miss]] + self.one[a[miss], s[miss]]
        return out


def _level(keys: np.ndarray, counts: np.ndarray, language: np.ndarray, n_languages: int, size: int):
    """Sum counts by (key, language); per context of the key (all but its last symbol) totals and escapes."""
    unique, inverse = np.unique(keys, return_inverse=True)
    n = np.zeros((len(unique), n_languages))
    np.add.at(n, (inverse, language), counts)
    contexts, of = np.unique(unique // size, return_inverse=True)
    total = np.zeros((len(contexts), n_languages))
    kinds = np.zeros_like(total)
    np.add.at(total, of, n)
    np.add.at(kinds, of, n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        seen = -np.log2(n / (total + kinds)[of])
    return unique, n, seen, contexts, of, escape


def bake(names: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Trees:
    """Trees from (language number, four bytes as one number, count) triples."""
    k = len(names)
    gram, count = gram.astype(np.int64), count.astype(float)
    seen_bytes = np.unique(np.concatenate([(gram >> shift) & 255 for shift in (24, 16, 8, 0)]))
    size = len(seen_bytes) + 1
    symbol = np.zeros(256, np.int32)
    symbol[seen_bytes] = np.arange(1, size)
    g = [symbol[(gram >> shift) & 255].astype(np.int64) for shift in (24, 16, 8, 0)]

    _, n0, seen0, _, _, escape0 = _level(np.r_[g[3], np.arange(size)], np.r_[count, np.zeros(size)], np.r_[language, np.zeros(size, int)], k, size)
    zero = np.where(n0 > 0, seen0, escape0 + 8)
    key, n, seen, contexts, of, escape = _level(g[2] * size + g[3], count, language, k, size)
    escape1 = np.zeros((size, k))
    escape1[contexts] = escape
    one = escape1[:, None, :] + zero[None, :, :]
    one[key // size, key % size] = np.where(n > 0, seen, one[key // size, key % size])

    key, n, seen, contexts, of, escape = _level((g[1] * size + g[2]) * size + g[3], count, language, k, size)
    escape2 = np.zeros((size**2, k))
    escape2[contexts] = escape
    rows3 = np.where(n > 0, seen, escape[of] + one[(key // size) % size, key % size])
    table3 = np.zeros(size**3, np.int32)
    table3[key] = np.arange(1, len(key) + 1)
    rows3 = np.r_[np.zeros((1, k)), rows3]
    out = Trees(names, symbol, size, one.astype(np.float32), escape2.astype(np.float32), table3, rows3.astype(np.float32), *[np.zeros(0)] * 4)

    key, n, seen, contexts, of, escape = _level(((g[0] * size + g[1]) * size + g[2]) * size + g[3], count, language, k, size)
    out.context3 = np.zeros(size**3, np.int32)
    out.context3[contexts] = np.arange(1, len(contexts) + 1)
    out.escape3 = np.r_[np.zeros((1, k)), escape].astype(np.float32)
    lower = out.two((key // size**2) % size, (key // size) % size, key % size)
    out.rows4 = np.r_[np.zeros((1, k)), np.where(n > 0, seen, escape[of] + lower)].astype(np.float32)
    out.table4 = np.zeros((len(contexts) + 1) * size, np.int32)
    out.table4[(of + 1) * size + key % size] = np.arange(1, len(key) + 1)
    return out


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees | None:
    learned = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~c.held_out(id_column)).select(
        F.col(id_column).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    sizes = {r["lang"]: r["count"] for r in learned.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])
    draw = (F.xxhash64("id", F.lit(29)).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    sample = learned.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            names = np.array(c.column(batch, "lang").to_pylist(), object)
            for name in dict.fromkeys(names):
                part = batch.filter(pa.array(names == name))
                for piece in c.chunks(part, "text"):
                    gram, n = np.unique(gram_codes(*c.text_buffer(c.column(piece, "text"))), return_counts=True)
                    held.setdefault(name, []).append((gram, n))
                    if len(held[name]) >= 16:
                        held[name] = [_sum(held[name])]
        for name, parts in held.items():
            gram, n = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sizes)
    code = total["lang"].map({name: k for k, name in enumerate(names)}).to_numpy(int)
    return bake(names, code, total["gram"].to_numpy(), total["n"].to_numpy())


def _sum(parts: list) -> tuple[np.ndarray, np.ndarray]:
    gram, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return gram, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(gram))


def predict_chunk(trees: Trees | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    raw, offsets = c.text_buffer(texts)
    n = len(offsets) - 1
    letters = np.diff(np.r_[0, np.cumsum(_ASCII_LETTER[raw])][offsets]) > 0
    for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
        letters[k] = any(map(str.isalpha, raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    if trees is None:
        return ["und"] * n, np.zeros(n)
    bits = trees.bits(raw, offsets)
    best = bits.argmin(1)
    behind = (bits - bits.min(1, keepdims=True)) * TEMPER / np.maximum(np.diff(offsets), 1)[:, None]
    score = 1 / np.exp2(-np.minimum(behind, 1000)).sum(1)
    return [trees.names[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def language_id(docs: DataFrame, trees: Trees | None = None, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; without ``trees`` they are fitted on the rows not held out."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees if trees is not None else fit(docs, id_column, text, lang))

    def predict(batches):
        for batch in batches:
            for part in c.chunks(batch, "text"):
                names, score = predict_chunk(model.value, c.column(part, "text"))
                yield pa.RecordBatch.from_arrays([c.column(part, "id"), c.column(part, "held_out"), pa.array(names, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("id"), c.held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_column)
