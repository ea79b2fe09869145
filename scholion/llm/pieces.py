"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi search.

The automaton reports, at every position, all pieces that end there (its output links, longest first); each
relaxes the best score of that position from the one where the piece starts, so one pass finds the segmentation
with the largest sum of piece scores (of equals, the one with the longer last piece). A character without a piece
of its own falls back to its UTF-8 byte pieces at ten below the lowest score. The vocabulary and its scores are
those of a model file whose path is a parameter; the driver reads it and broadcasts 32,000 pieces.

No piece holds a space behind another character, or a line feed or tab, so these places always part pieces and a
text is encoded unit by unit, each short unit once per worker (a bounded memo). If a vocabulary breaks that rule,
whole texts are the units.

Decoding inverts encoding exactly: spaces stand for the meta symbol, a literal meta symbol in a text goes through
byte pieces, the dummy space before a text is dropped.

Defined results: a null or empty text has no ids and decodes to the empty text; ids outside the vocabulary or of
control pieces decode to nothing; rows that share an id are encoded each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.llm import common as c

META = "▁"
MODEL = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
MEMO, MEMO_LENGTH = 200_000, 48


@dataclass
class Vocabulary:
    """pieces: id -> (text with spaces, score) of the ordinary ones; byte_ids: byte -> id."""

    pieces: dict[int, tuple[str, float]]
    byte_ids: list[int]
    size: int
    dummy_prefix: bool = True

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i] = (name.replace(META, " "), float(model.get_score(i)))
        return Vocabulary(pieces, byte_ids, model.get_piece_size())


def load_vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """From a local path, or from any path that Spark reads."""
    path = path or os.path.join(c.default_model_dir(), MODEL)
    if os.path.exists(path):
        return Vocabulary.load(path)
    content = spark.read.format("binaryFile").load(path).select("content").head()[0]
    with tempfile.NamedTemporaryFile(suffix=".model") as file:
        file.write(bytes(content))
        file.flush()
        return Vocabulary.load(file.name)


class Codec(dict):
    """Encoder and decoder; as a mapping, the bounded memo from a unit to its packed ids."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, (text, score) in vocabulary.pieces.items():
            self.automaton.add_word(text, (i, len(text), score))
        self.automaton.make_automaton()
        self.single = {text for text, _ in vocabulary.pieces.values() if len(text) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        parted = not any(re.search("[^ ] ", text) for text, _ in vocabulary.pieces.values())
        alone = "".join(x for x in "\n\t\r\x0b\x0c" if not any(x in text for text, _ in vocabulary.pieces.values())) or "\0"
        self.units = re.compile(f"[{alone}]| *[^ {alone}]+| +" if parted else "(?s).+").findall
        self.spelled = [b""] * vocabulary.size
        for i, (text, _) in vocabulary.pieces.items():
            self.spelled[i] = text.encode()
        for byte, i in enumerate(vocabulary.byte_ids):
            self.spelled[i] = bytes([byte])

    def search(self, unit: str) -> list[int]:
        """The ids of the best segmentation."""
        n, at, single, unknown = len(unit), 0, self.single, self.unknown
        best, came = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for last, (piece, length, score) in self.automaton.iter(unit):
            end = last + 1
            while at < end:
                at += 1
                if unit[at - 1] not in single:
                    best[at], came[at] = best[at - 1] + unknown, (-1, 1)
            total = best[end - length] + score
            if total > best[end]:
                best[end], came[end] = total, (piece, length)
        while at < n:
            at += 1
            best[at], came[at] = best[at - 1] + unknown, (-1, 1)
        out = []
        while n:
            piece, length = came[n]
            if piece < 0:
                out += [self.vocabulary.byte_ids[b] for b in reversed(unit[n - 1].encode())]
            else:
                out.append(piece)
            n -= length
        return out[::-1]

    def __missing__(self, unit: str) -> bytes:
        packed = np.array(self.search(unit), np.int32).tobytes()
        if len(unit) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[unit] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.vocabulary.dummy_prefix:
            text = " " + text
        return np.frombuffer(b"".join(map(self.__getitem__, self.units(text))), np.int32)

    def decode(self, ids) -> str:
        spelled, size = self.spelled, len(self.spelled)
        raw = b"".join([spelled[i] for i in ids if 0 <= i < size])
        if self.vocabulary.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec_of(broadcast) -> Codec:
    """One codec per worker process and broadcast vocabulary."""
    key = broadcast.value
    if id(key) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(key)] = Codec(key)
    return _CODECS[id(key)]


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded_sha256) of every row; the last is of the text decoded from the ids again."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(docs.sparkSession, path))

    def run(batches):
        codec = codec_of(vocabulary)
        for batch in batches:
            for part in c.chunks(batch, "text"):
                texts = c.column(part, "text").to_pylist()
                ids = [codec.encode(x or "") for x in texts]
                size = np.array([len(x) for x in ids], np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
                digest = [hashlib.sha256(codec.decode(x.tolist()).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([c.column(part, "id"), pa.array(size), lists, pa.array(digest)], ["id", "n_tokens", "ids", "decoded_sha256"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens int, ids array<int>, decoded_sha256 string").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) from lists of ids; a null list decodes to the empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(encoded.sparkSession, path))

    def run(batches):
        codec = codec_of(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [codec.decode(x or []) for x in c.column(part, "ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(part, "id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
