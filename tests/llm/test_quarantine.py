"""The replay against a plain simulation; cut conversations against whole ones."""

import random
import zlib

import pytest

from scholion.llm import quarantine

SCHEMA = "conv_id long, turn long, text string, place string, status string, role string"


def simulated(rows):
    """One conversation after the other, attempt by attempt."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, zlib.crc32((r[2] or "").encode())))
        ended = []
        for p, (_, turn, _) in enumerate(turns):
            h = lambda k: zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())  # noqa: B023, E731
            parent = ended[p - h(0) % 5] if 0 < h(0) % 5 <= p else None
            if parent and parent[0] != "delivered":
                ended.append(("blocked", 0, None, None))
                continue
            at = first = max(7 * p, parent[3]) if parent else 7 * p
            faulty, repaired = h(1) % 101 < 50, 7 * p + h(2) % 101
            for a in range(1, 7):
                if not faulty or (at >= repaired and h(a + 2) % 3):
                    ended.append(("delivered", a, first, at))
                    break
                if a == 6:
                    ended.append(("dead", 6, first, at))
                at += 10 * 2 ** (a - 1)
        order = sorted((p for p in range(len(turns)) if ended[p][0] == "delivered"), key=lambda p: (ended[p][3], p))
        state, said = 0, {}
        for n, p in enumerate(order, 1):
            state += n * zlib.crc32((turns[p][2] or "").encode())
            said[p] = (n, (state + 2**63) % 2**64 - 2**63)
        for p, (_, turn, _) in enumerate(turns):
            out.setdefault((conv, turn), []).append((*ended[p], *said.get(p, (None, None))))
    return sorted((str(k), repr(sorted(v, key=repr))) for k, v in out.items())


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.status, r.attempts, r.first_at, r.last_at, r.release_no, r.state))
    return sorted((str(k), repr(sorted(v, key=repr))) for k, v in out.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(0, t, f"text {t}" if t % 7 else None) for t in range(900)]  # one hot conversation
    out += [(k, 3 * t - 5, rng.choice(["", "é", "same", "x" * 5000])) for k in range(1, 60) for t in range(rng.randint(1, 20))]
    out += [(None, 1, "a"), (None, None, "b"), (7, None, None), (7, 4, "again"), (7, 4, "again"), (7, 4, "other")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece", [quarantine.PIECE, 16, 100])
def test_replay_equals_a_simulation(spark, rows, piece):
    frame = spark.createDataFrame([(*r, "p", "s", "r") for r in rows], SCHEMA).repartition(5)
    out = quarantine.replay(frame, piece)
    assert out.columns == quarantine.COLUMNS
    assert found(out) == simulated(rows)
    assert {r.status for r in out.collect()} == {"delivered", "dead", "blocked"}


def test_pieces_of_a_conversation_are_bounded_and_independent(spark, rows):
    turns = spark.createDataFrame([(*r, "p", "s", "r") for r in rows if r[0] == 0], SCHEMA)
    placed = quarantine.ranking.rank_within(quarantine.drawn(turns), "conv_id", ["turn"], "place").selectExpr("*").withColumn("place", quarantine.F.col("place") - 1)
    cut = sorted((r.place, r.piece, r.back) for r in quarantine.pieces(placed, 16).collect())
    assert len(cut) == 900 and len({p for _, p, _ in cut}) > 10
    piece = {place: p for place, p, _ in cut}
    assert all(piece[place - back] == p for place, p, back in cut if 0 < back <= place)


def test_an_empty_table_gives_no_rows(spark):
    assert quarantine.replay(spark.createDataFrame([], SCHEMA)).collect() == []
