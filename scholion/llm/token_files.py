"""Token-id files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

Documents are dealt by ranges of their id and sorted, so that files follow ascending ids. Inside the ranges texts become
ids (``TextCodec``), which are stored once; from them come the frequency of every id, over all documents, and the running
number of ids before each document (prefix sums over ranges). A second pass over the stored ids writes the files through the
transactional sink, and the result is what the files give back.

A file is a run of blocks of about ``BLOCK_IDS`` ids, whole documents each, at most ``FILE_BYTES`` long unless one block is
longer. A block has a header (documents, ids, number of ids before it, bytes of control and of data), the documents' ids, a
byte each for null, their lengths, the control bytes and the data bytes. Every id is its rank, the most frequent 0, in as
few bytes as it needs; a control byte holds the byte counts, less one, of four ids. Decoding is table lookup: a control
byte is a row of a 256 x 16 table that says where the data bytes go. Ids by rank lie in a file of their own, as long as the
vocabulary at most.

``TextCodec`` gives the tokenizer's own ids. Texts are cut at once, as arrays of bytes, into the pieces of the vocabulary's pattern
(words, numbers, runs of signs, white space); the different pieces of a chunk are looked up among those a worker met last
(``MEMO``), and only new ones go to the tokenizer's model. Where bytes are of no simple class (apostrophes, letters beyond
U+023F, other signs), all between two single spaces is a piece and goes to the tokenizer; texts with special tokens and texts
longer than ``SEGMENT`` go to it by themselves.

Defined results: a null text is the empty text, which gives the end id alone. Null document ids come first; rows that
share an id are documents of their own, ordered by a hash of their text. Ids other than integers are refused. Strings of
special tokens in a text become their ids, as in the tokenizer, unless ``special`` is false. Other columns are ignored. An empty table gives no
rows and no files but that of the ranks. A block, and a worker's memory, holds the longest document whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource

from scholion.llm import common as c
from scholion.operators import ranking
from scholion.sources import sink
from scholion.sources.replay import _opened

MODEL, END = "byte_bpe_50k.json", 2
BLOCK_IDS, FILE_BYTES = 1 << 20, 64 << 20
MEMO = 400_000  # pieces of a generation; a worker holds two
LONGEST_UNIT = 64
SEGMENT = 1 << 20  # bytes of a text cut at once
MAGIC, HEADER = b"TOKFILE1", struct.Struct("<5q")
RANKS = "ranks.ids"
STORE = "zstd"  # of ids between the two passes


def default_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(MODEL)
    except ImportError:
        return os.path.join(c.default_model_dir(), MODEL)


def load_model(spark: SparkSession, path: str | None = None) -> str:
    """The tokenizer's JSON, from a local path or any that Spark reads."""
    path = path or default_path()
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0]).decode()


# ---------------------------------------------------------------- texts to ids


#: How byte-level vocabularies spell the bytes that aren't printable: as the letters from U+0100 on, in order.
SPELLED = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

#: Classes of bytes in the vocabulary's pattern. Letters are those of ASCII and U+00C0 to U+023F; a following byte counts as the letter it ends.
_LETTER, _DIGIT, _SIGN, _SPACE, _HARD = range(5)
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[ord("'")] = _HARD  # begins 's, 't, 're, ...
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
_CLASS[[32, 9, 10, 13]] = _SPACE
_SIMPLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+|[0-9]+|[!-&(-/:-@[-`{-~]+)")


def pieces(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that have ids of their own: the words, numbers, runs of signs and of white space of the
    vocabulary's pattern; where bytes are of no simple class, all from one single space between simple bytes to the next."""
    n = len(raw)
    kind, blank = _CLASS[raw], raw == 32
    space, first = kind == _SPACE, np.zeros(n + 1, bool)
    first[offsets] = True
    cut = first[:n].copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & ~blank[:-1]  # a space goes with what follows it
    cut[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]  # so does the last of a run of white space, or it is alone
    hard = kind == _HARD
    sign = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))  # no letters
    hard[sign] = True
    if hard.any():
        for _ in range(3):  # to the end of their characters
            hard[1:] |= hard[:-1] & (raw[1:] & 0xC0 == 0x80)
        solid = ~(hard | space)
        safe = first[:n].copy()
        safe[1:-1] |= blank[1:-1] & solid[:-2] & solid[2:]
        unit = np.r_[np.flatnonzero(safe), n]
        inside = np.zeros(len(unit) - 1, bool)
        inside[np.searchsorted(unit, np.flatnonzero(hard), "right") - 1] = True
        cut = np.where(np.repeat(inside, np.diff(unit)), safe, cut)
    return np.flatnonzero(cut)


class TextCodec:
    def __init__(self, model: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = not special
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        # cuts are proven for vocabularies that split words by the usual pattern and change no text before
        told = json.loads(model)
        split = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, found: list[bytes]) -> list[bytes]:
        """Ids of pieces: those that are one word of the pattern from the tokenizer's model, others from the tokenizer."""
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        young, old, tokenize, rest = self.young, self.old, self.model.tokenize, []
        out = list(map(young.get, found))
        for k in [k for k, x in enumerate(out) if x is None]:
            piece = found[k]
            ids = old.get(piece)
            if ids is None:
                if not _SIMPLE.fullmatch(piece):
                    rest.append(k)
                    continue
                spelled = piece.decode()  # refuses what is no text
                spelled = spelled.replace(" ", "\u0120") if piece.isascii() else piece.decode("latin-1").translate(SPELLED)
                ids = array(self.code, [t.id for t in tokenize(spelled)]).tobytes()
            out[k] = ids
            if len(piece) <= LONGEST_UNIT:
                young[piece] = ids
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, ids in zip(part, self.whole([found[k].decode() for k in part])):
                out[k] = ids
                if len(found[k]) <= LONGEST_UNIT:
                    young[found[k]] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column, packed; null is the empty text."""
        raw, offsets = c.text_buffer(texts)
        apart = np.diff(offsets) > (SEGMENT if self.cuts else 0)
        everything = raw.tobytes() if self.cuts else b""
        if any(m.encode() in everything for m in self.marks):
            apart |= np.array([any(m.encode() in everything[a:b] for m in self.marks) for a, b in zip(offsets, offsets[1:])], bool)
        alone = np.flatnonzero(apart)
        if len(alone):
            raw, offsets = c.text_buffer(pa.array(["" if x else t for x, t in zip(apart, texts.to_pylist())], pa.string()))
        out = [b""] * len(texts)
        if len(raw):
            start = pieces(raw, offsets)
            cut = pa.array(np.append(start, len(raw)), pa.int32()).buffers()[1]
            found = pa.Array.from_buffers(pa.binary(), len(start), [None, cut, pa.py_buffer(raw)]).dictionary_encode()
            ids = pa.array(self._ids(found.dictionary.to_pylist()), pa.binary()).take(found.indices)
            data, bounds = c.text_buffer(ids)
            data, bounds = data.tobytes(), bounds[np.searchsorted(start, offsets)].tolist()
            out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in alone.tolist():
            out[k] = self._long(texts[k].as_py())
        return out

    def _long(self, text: str) -> bytes:
        """The tokenizer on pieces of about a segment, cut at single spaces between words, or on the whole text."""
        if not self.cuts or len(text) <= SEGMENT or any(m in text for m in self.marks):
            return self.whole([text])[0]
        out, at = [], 0
        while len(text) - at > SEGMENT:
            cut = text.find(" ", at + SEGMENT)
            while 0 < cut < len(text) - 1 and (_loose(text[cut - 1]) or _loose(text[cut + 1])):
                cut = text.find(" ", cut + 1)
            if cut <= 0 or cut >= len(text) - 1:
                break
            out += self.whole([text[at:cut]])
            at = cut
        return b"".join([*out, *self.whole([text[at:]])])


def _loose(x: str) -> bool:
    return x.isspace() or x in "\u180e\u200b\ufeff"


_CODECS: dict[tuple, TextCodec] = {}


def codec_of(model, special: bool) -> TextCodec:
    """One codec a worker process."""
    key = (model.value if hasattr(model, "value") else model, special)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = TextCodec(*key)
    return _CODECS[key]


def tokenized(docs: DataFrame, model: str, special: bool = True, end: int = END) -> DataFrame:
    """(doc_id, ids, n_tokens, __part): compressed ids with the end id, in ascending document ids over ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = codec_of(shared, special)
        tail = np.array([end], codec.kind).tobytes()
        for batch in batches:
            for part in c.chunks(batch, "text", 4 * c.CHUNK_BYTES):
                packed = [x + tail for x in codec.encode_column(c.column(part, "text"))]
                size = np.array([len(x) for x in packed], np.int64) // codec.kind.itemsize
                packed = [pa.compress(x, codec=STORE, asbytes=True) for x in packed]
                yield pa.RecordBatch.from_arrays([c.column(part, "doc_id"), pa.array(packed, pa.binary()), pa.array(size)], ["doc_id", "ids", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    return ranking.in_ranges(rows, [], ["doc_id", "tie"], then=lambda x: x.mapInArrow(run, "doc_id long, ids binary, n_tokens long"))


def stored_ids(packed, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n * np.dtype(kind).itemsize, codec=STORE), kind)


def ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """All ids that occur, the most frequent first, then by id: as many as the vocabulary has at most."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            packed, sizes = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(sizes), 256):
                some = [stored_ids(packed[k].as_buffer(), sizes[k], kind) for k in range(at, min(at + 256, len(sizes)))]
                found = np.bincount(np.concatenate(some))
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = tokens.select("ids", "n_tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.uint32)


# ---------------------------------------------------------------- the coding

_CODES = np.array([[(x >> 2 * k & 3) + 1 for k in range(4)] for x in range(256)], np.uint8)
#: For every control byte which of the 16 bytes of four ids are stored.
STORED = np.arange(4)[None, None, :] < _CODES[:, :, None]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values; the last control byte is filled up with ones-byte codes."""
    filled = np.zeros(-(-len(values) // 4) * 4, "<u4")
    filled[: len(values)] = values
    code = (filled > 0xFF).astype(np.uint8) + (filled > 0xFFFF) + (filled > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), filled.view(np.uint8).reshape(-1, 4, 4)[STORED[control]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    stored = STORED[np.frombuffer(control, np.uint8)]
    out = np.zeros(stored.shape, np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")[:n]


def block(ids: list[int | None], lengths: np.ndarray, start: int, ranked: np.ndarray) -> bytes:
    control, data = pack(ranked)
    missing = np.array([x is None for x in ids], np.uint8)
    names = np.array([x or 0 for x in ids], "<i8")
    head = HEADER.pack(len(ids), len(ranked), start, len(control), len(data))
    return b"".join([head, names.tobytes(), missing.tobytes(), lengths.astype("<i8").tobytes(), control, data])


def blocks(content: bytes):
    """(document ids, null marks, lengths, start, ranks) of every block of a file."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    at = len(MAGIC)
    while at < len(content):
        docs, n, start, n_control, n_data = HEADER.unpack_from(content, at)
        at += HEADER.size
        names = np.frombuffer(content, "<i8", docs, at)
        missing = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        lengths = np.frombuffer(content, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        yield names, missing, lengths, start, unpack(content[at : at + n_control], content[at + n_control : at + n_control + n_data], n)
        at += n_control + n_data


# ---------------------------------------------------------------- files


def save_ranks(path: str, order: np.ndarray) -> None:
    system, at = _opened(f"{path}/{RANKS}")
    system.create_dir(os.path.dirname(at), recursive=True)
    with system.open_output_stream(at) as file:
        file.write(MAGIC + order.astype("<u4").tobytes())


def load_ranks(path: str) -> np.ndarray:
    system, at = _opened(f"{path}/{RANKS}")
    with system.open_input_file(at) as file:
        return np.frombuffer(file.read()[len(MAGIC) :], "<u4")


class TokenFiles(DataSource):
    """``format("token_files")``: writes (doc_id, ids, start, n_tokens, __part), reads (doc_id, start, n_tokens, ids as 32-bit little-endian)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite):
        return _TokenWriter(self.options["path"], self.options["kind"])

    def reader(self, schema):
        return _TokenReader(self.options["path"])


class _TokenWriter(sink.StagedWriter):
    def __init__(self, path: str, kind: str):
        super().__init__(path)
        self.kind = kind

    def files(self, batches):
        order = load_ranks(self.path)
        rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        for part, k, pieces in self._files(self._blocks(batches, rank)):
            yield f"part-{part:06d}-{k:06d}", MAGIC + b"".join(pieces), {}

    def _blocks(self, batches, rank):
        """(partition, packed block) of whole documents, BLOCK_IDS ids or one document more."""
        names, packed, start, held, part = [], [], 0, 0, 0
        for batch in batches:
            part = batch.column("__part")[0].as_py() if batch.num_rows else part
            for name, ids, before, n in zip(*[batch.column(x).to_pylist() for x in ("doc_id", "ids", "start", "n_tokens")]):
                start = start if names else before
                names.append(name)
                packed.append(stored_ids(ids, n, self.kind))
                held += len(packed[-1])
                if held >= BLOCK_IDS:
                    yield part, block(names, np.array([len(x) for x in packed]), start, rank[np.concatenate(packed)])
                    names, packed, held = [], [], 0
        if names:
            yield part, block(names, np.array([len(x) for x in packed]), start, rank[np.concatenate(packed)])

    @staticmethod
    def _files(found):
        pieces, size, k, part = [], 0, 0, 0
        for part, piece in found:
            if pieces and size + len(piece) > FILE_BYTES:
                yield part, k, pieces
                pieces, size, k = [], 0, k + 1
            pieces.append(piece)
            size += len(piece)
        if pieces:
            yield part, k, pieces


class _TokenReader(sink.StagedReader):
    def rows(self, entry, content):
        order = load_ranks(self.path).astype("<u4")
        for names, missing, lengths, start, ranked in blocks(content):
            ids = order[ranked]
            ends = np.cumsum(lengths)
            offsets = pa.array(np.append(0, 4 * ends).astype(np.int64))
            packed = pa.Array.from_buffers(pa.large_binary(), len(names), [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, mask=missing.astype(bool)), pa.array(start + ends - lengths), pa.array(lengths), packed], ["doc_id", "start", "n_tokens", "ids"]
            )


def write(docs: DataFrame, folder: str, path: str | None = None, special: bool = True, end: int = END) -> None:
    """Encode all documents and write the files of their ids into a fresh folder."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"document ids must be integers, not {kind}")
    spark.dataSource.register(TokenFiles)
    model = load_model(spark, path)
    width = TextCodec(model, special).kind.str
    tokens = tokenized(docs, model, special, end)
    c.free_files(spark)  # the texts that were shuffled
    save_ranks(folder, ranks(tokens, width))
    placed = ranking.running_sum(tokens, [], "n_tokens", "through").withColumn("start", F.col("through") - F.col("n_tokens"))
    placed.select("doc_id", "ids", "start", "n_tokens", ranking.PART).write.format("token_files").option("kind", width).mode("append").save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents from a folder's committed files."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(folder)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written to the shared folder."""
    folder = f"{c.shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
