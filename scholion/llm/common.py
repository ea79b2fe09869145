"""What the operators of this package share: text buffers as numpy arrays, hashing, components.

Kernels run inside ``mapInArrow`` on byte-bounded chunks, so a task's memory follows
``CHUNK_BYTES`` (or the longest single text), never the size of a partition.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.operators.graph import connected_components  # noqa: F401
from scholion.session import cut_lineage, free_files, shared_folder  # noqa: F401

CHUNK_BYTES = 1 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int | None = None):
    """Slices of a record batch whose texts total at most ``limit`` bytes (or one long text)."""
    limit = limit or CHUNK_BYTES
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = np.asarray(x, U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


_BASE = U(0x9E3779B97F4A7C55)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
BYTE_CODE = stream(17, 256) | U(1)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]
_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = U(1)
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(raw: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P with P[i] = sum over j < i of code(byte j) * base**j: any span's hash is two lookups."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(code[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free, mixed hash of the spans [start, end)."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + U(0xD6E8FEB86659FD93) * (end - start).astype(U))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z and the Latin-1 capitals (UTF-8 lead byte C3) in lower case; lengths don't change."""
    out = _LOWER[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and, per text, where its words begin."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles, A-Z folded.

    A text with fewer words has its whole word sequence as its only shingle; one without words has none.
    """
    start, end, first = words(raw, offsets)
    if len(start) == 0:
        return [np.zeros(0, U)] * (len(offsets) - 1)
    word = span_hash(prefix_hash(raw, FOLDED_CODE), start, end)
    weight = stream(size, size) | U(1)
    gram = np.zeros(max(len(word) - size + 1, 0), U)
    out = []
    with np.errstate(over="ignore"):
        for k in range(size):
            gram += word[k : len(word) - size + 1 + k] * weight[k] if len(gram) else U(0)
        gram = mix(gram)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                out.append(np.unique(gram[a : b - size + 1]))
            elif b > a:
                out.append(mix((word[a:b] * weight[: b - a]).sum(dtype=U) + U(b - a))[None])
            else:
                out.append(np.zeros(0, U))
    return out


# ---------------------------------------------------------------- groups


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.parts = n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        self.parts -= 1
        return True


def held_out(id_column: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def release() -> None:
    """Give freed pages back to the system: workers and the driver live on between stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def default_model_dir() -> str:
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
