"""Token-id files against the tokenizer itself, and the coding as an exact round trip."""

import random
import zlib

import numpy as np
import pytest

from scholion.llm import token_files

SCHEMA = "doc_id long, text string, ids string, start string, n_tokens string, __part string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_path())


def test_control_bytes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
        values[:2] = [0, 2**32 - 1][: len(values[:2])]
        control, data = token_files.pack(values)
        assert (token_files.unpack(control, data, n) == values).all()
        assert len(control) == -(-n // 4)


def test_units_give_the_tokenizers_ids(tokenizer, monkeypatch):
    with open(token_files.default_path(), encoding="utf-8") as file:
        model = file.read()
    codec = token_files.TextCodec(model)
    assert codec.cuts
    rng = random.Random(2)
    pieces = [" ", " ", " ", "  ", "\n", "\n ", " \n", "\t", "\r\n", "\xa0", "\u2003", "\x1c", "\x85", "\u200b", "\u180e", "a", "Word", "it's", "'ll", "don't", "\xe9", "\xdf"]
    pieces += ["123", "4", "...", "!?", "<|endoftext|>", "\u65e5\u672c", "\U0001f642", "e\u0301", "_", "'", "x" * 90]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    letters = [chr(x) for x in range(0x41, 0x250) if chr(x).isalpha()]
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ",", ".", "$$$", "'", ".\nThe", "\nA", "'s", "?\n\nOn", "<|", ")"]) for _ in range(40)) for _ in range(100)]
    texts += [" ".join(rng.choice(["some", "plain", "words", "it's", "12"]) for _ in range(200)), " ", "", "\n", " a", "a ", "  a  ", "a   b"]
    for memo, segment in ((token_files.MEMO, token_files.SEGMENT), (3, 40)):
        monkeypatch.setattr(token_files, "MEMO", memo)
        monkeypatch.setattr(token_files, "SEGMENT", segment)
        for at in range(0, len(texts), 50):
            some = texts[at : at + 50]
            for text, packed in zip(some, codec.encode(some)):
                assert np.frombuffer(packed, codec.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents_from_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Straße", "naïve", "42", "end."]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(-20, 200)]
    docs += [(300, None), (301, ""), (302, "long " * 40_000), (5, "repeated id"), (5, "repeated id"), (None, "no id"), (303, "a <|endoftext|> b")]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "i", "s", "n", "p") for d in docs], SCHEMA).repartition(7)
    found = sorted(token_files.round_trip(frame).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d[0] for d in docs), key=lambda x: (x is not None, x))
    want, start = {}, 0
    for d in docs:
        ids = tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [2]
        want.setdefault(d[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in found:
        assert r.start == start
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_ranks_are_by_frequency_over_all_documents(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(k, "the the the cat" if k % 2 else "cat the") for k in range(40)], "doc_id long, text string").repartition(5)
    token_files.write(docs, str(tmp_path / "t"))
    counts = {}
    for r in docs.collect():
        for i in [*tokenizer.encode(r.text).ids, 2]:
            counts[i] = counts.get(i, 0) + 1
    assert token_files.load_ranks(str(tmp_path / "t")).tolist() == sorted(counts, key=lambda i: (-counts[i], i))
    with pytest.raises(Exception, match="fresh folder"):
        token_files.write(docs, str(tmp_path / "t"))


def test_no_documents_and_ids_that_are_no_integers(spark):
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(TypeError):
        token_files.round_trip(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_pieces_are_those_of_the_tokenizers_pattern(tokenizer):
    rng = random.Random(4)
    parts = [" ", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "a", "Word", "\xe9t\xe9", "\xdf", "\u0111\u023f", "12", "7", "...", "$$$", "<", "|", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    whole = b"".join(raw)
    start = token_files.pieces(np.frombuffer(whole, np.uint8), offsets).tolist()
    want, at = [], 0
    for text in texts:
        for spelled, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text):
            want.append(at)
            at += len(spelled)  # a letter a byte
    assert start == want and at == len(whole)


def test_a_word_is_kept_once_whatever_signs_follow():
    with open(token_files.default_path(), encoding="utf-8") as file:
        codec = token_files.TextCodec(file.read())
    stems = [a + b + d for a in ("an", "er", "th") for b in ("tion", "sh", "ble") for d in ("ou", "\xe9l", "st")]
    signs = ["", ",", ".", "!!", "$$$", "%%%", "***", "###"]
    codec.encode([" ".join(["a"] + [stem + sign for stem in stems for sign in signs])])
    assert len(codec.young) <= len(stems) + len(signs) + 1  # not a unit for every word with every sign


@pytest.mark.parametrize("gap", [" ", "\xd7", "\xf7", "\u0301", "\xa0", "\x1c", "\u2019", "'", "\u0250", "\u65e5"])
def test_pieces_end_at_document_borders_and_around_other_characters(tokenizer, gap):
    with open(token_files.default_path(), encoding="utf-8") as file:
        codec = token_files.TextCodec(file.read())
    texts = [None, f"a{gap}", f"{gap}s", f"a {gap} s", f"it{gap}s {gap}a b", " ", f"\n{gap}", "", f"b  {gap}\n\nc d", "end ", " start"]
    column = token_files.pa.array(texts, token_files.pa.string())
    for some, rows in ((column, texts), (column.slice(3, 6), texts[3:9])):
        for text, packed in zip(rows, codec.encode_column(some)):
            assert np.frombuffer(packed, codec.kind).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
