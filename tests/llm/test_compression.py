"""Codes against plain loops in Python's integers."""

import hashlib
import math
import random

import pytest

from scholion.llm import compression

SCHEMA = "vec_id long, embedding array<double>, label int, row long, part int, weight string, error string"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [max(min(math.floor(256 * x), 2**27), -(2**27)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for length in {len(v) for _, v, _ in kept}:
        mine = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [k * length // parts for k in range(parts + 1)]
        books = [[tuple(v[a:b]) for _, v, _ in mine[:entries]] for a, b in zip(cut, cut[1:])]
        far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
        pick = lambda book, x: min(range(len(book)), key=lambda k: (far(book[k], x), k))
        for _ in range(rounds):
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                held = {}
                for _, v, _ in mine:
                    held.setdefault(pick(books[k], v[a:b]), []).append(v[a:b])
                for at, xs in held.items():
                    books[k][at] = tuple(sum(col) // len(xs) for col in zip(*xs))
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, label in mine:
            found = [pick(book, v[a:b]) for book, a, b in zip(books, cut, cut[1:])]
            out.append((i, "".join(f"{f:02x}" for f in found), sum(far(book[f], v[a:b]) for book, f, a, b in zip(books, found, cut, cut[1:])), digest, label))
    sums = {}
    for r in out:
        sums[r[4]] = sums.get(r[4], 0) + r[2]
    return sorted(map(repr, ((i, code, error, sums[label] if sums[label] < 2**63 else None, digest) for i, code, error, digest, label in out)))


def ours(frame):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    same = [rng.gauss(0, 0.2) for _ in range(64)]
    out = [(1000 - k, [rng.gauss(0, 0.1) if j % 5 else 0.25 for j in range(64)], rng.choice([1, 2, None])) for k in range(200)]
    out += [(2000 + k, list(same), 3) for k in range(90)]  # a third of all rows
    out += [(5, None, 1), (6, [], 1), (7, [0.0] * 63 + [None], 1), (8, [math.nan] + [0.0] * 63, 1), (9, [math.inf] * 64, 2), (None, same, None), (2001, same[::-1], 3)]
    out += [(k, [float(j * k) for j in range(7)], 9) for k in range(10)]  # another length, which 16 doesn't divide
    out += [(3000, [1e12, -1e300] + [0.0] * 62, 4), (3001, [-300000.5] * 64, 4)]
    rng.shuffle(out)
    return out


def test_codes_equal_plain_loops(spark, rows, monkeypatch):
    frame = spark.createDataFrame([(*r, 1, 2, "w", "e") for r in rows], SCHEMA).repartition(5)
    assert ours(compression.compress(frame)) == plain(rows)
    monkeypatch.setattr(compression, "HEAVY", 2)  # nearly all parts by the shuffled join
    assert ours(compression.compress(frame)) == plain(rows)
    monkeypatch.setattr(compression, "HEAVY", 10**9)  # all by the broadcast one
    assert ours(compression.compress(frame)) == plain(rows)


def test_few_or_no_vectors(spark):
    few = [(3, [0.1] * 16, None), (2, [0.1] * 16, None), (1, [-0.1] * 16, 5)]
    assert ours(compression.compress(spark.createDataFrame([(*r, 1, 2, "w", "e") for r in few], SCHEMA))) == plain(few)
    assert compression.compress(spark.createDataFrame([], SCHEMA)).collect() == []
