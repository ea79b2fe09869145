"""Cursor paging as a stream: restarts, kills, repeated cursors, unreadable pages."""

import json
import os
import urllib.parse

from scholion.sources import cursor


def save(folder, at, items, following):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{urllib.parse.quote(at, safe='')}.json", "w") as file:
        json.dump({"items": items, "next": following}, file)


def drain(spark, folder, state, out, pages=2, fail_at=None):
    """One run over what is available; with ``fail_at`` the run dies in that batch after its rows were planned and read."""
    cursor.register(spark)
    stream = spark.readStream.format("cursor_pages").option("path", str(folder)).option("pages", pages).load()

    def write(df, batch):
        rows = [(r.page, r.place, json.loads(r.raw)) for r in df.collect()]
        if batch == fail_at:
            raise RuntimeError("killed")
        out[batch] = rows  # as a sink that replaces a batch it has seen

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    except Exception:
        assert fail_at is not None


def chain(folder, n):
    for k in range(n):
        save(folder, "*" if k == 0 else f"c/{k}", [f"i{k}", {"k": k}, "é"], f"c/{k + 1}" if k + 1 < n else None)
    return [(k, p, x) for k in range(n) for p, x in enumerate([f"i{k}", {"k": k}, "é"])]


def test_a_killed_run_loses_and_doubles_nothing(spark, tmp_path):
    expected, out = chain(tmp_path / "pages", 7), {}
    key = lambda rows: sorted(rows, key=str)
    for fail_at in (None, 1, None, 2, 2, None, None, None):
        drain(spark, tmp_path / "pages", tmp_path / "state", out, fail_at=fail_at)
    found = [x for rows in out.values() for x in rows]
    assert key(found) == key(expected) and max(map(len, out.values())) == 6  # two pages a batch
    before = dict(out)
    drain_again = spark.readStream.format("cursor_pages").option("path", str(tmp_path / "pages")).load()
    query = drain_again.writeStream.foreachBatch(lambda df, b: out.setdefault(b, df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(map(len, out.values())) == sum(map(len, before.values()))  # nothing new


def test_repeated_cursors_and_unreadable_pages(tmp_path):
    folder = tmp_path / "pages"
    save(folder, "*", [1], "b")
    save(folder, "b", [2], "c")
    save(folder, "c", [3], "b")
    reader = cursor.CursorReader({"path": str(folder), "pages": "2"})
    first = reader.latestOffset()
    again = cursor.CursorReader({"path": str(folder), "pages": "2"})  # a restart knows the cursors of the run before
    assert [p.value for p in again.partitions(reader.initialOffset(), first)] == [(0, "*"), (1, "b")]
    end = again.latestOffset()
    assert (end["page"], end["state"]) == (3, "partial") and again.latestOffset() == end
    assert [list(again.read(p)) for p in again.partitions(first, end)] == [[(2, "c", 0, "3")]]
    os.remove(folder / "c.json")
    broken = cursor.CursorReader({"path": str(folder), "pages": "9"})
    assert broken.latestOffset()["page"] == 2 and broken.latestOffset()["state"] == "open"
    save(folder, "c", [3], None)
    assert broken.latestOffset() | {"seen": ""} == {"page": 3, "cursor": "c", "seen": "", "state": "complete"}
    nothing = cursor.CursorReader({"path": str(tmp_path / "none")})
    assert nothing.latestOffset() == nothing.initialOffset() and nothing.partitions(nothing.initialOffset(), nothing.latestOffset()) == []
