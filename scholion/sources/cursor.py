"""Paging by cursor as a stream: ``spark.readStream.format("cursor_pages")``.

A service gives a page and the cursor of the next one, so the chain of cursors is followed in order, on the driver; the
pages themselves are read by tasks, one partition a page, and no item passes the driver. The stream's offset is the place in
the chain, so a restart from the checkpoint goes on at the cursor that it left, and a batch that was planned but not
finished is read again between the same two offsets.

Options: ``service`` (``saved_answers`` or ``row_groups``, or the dotted name of a class like them), ``path``, ``pages`` (most pages a batch,
1,000), ``start`` (first cursor). A page without a next cursor ends the stream; so does a cursor met before (state ``partial``:
its pages would repeat); a page that can't be read ends the batch before it, and the next batch tries it again. The offset holds a
16-digit digest of every cursor met, to know repeated ones after a restart, so it grows by 16 bytes a page.

Rows: page (0, 1, ... along the chain), cursor, place (on the page), raw (the item as JSON).
"""

from __future__ import annotations

import hashlib
import importlib
import io
import json
import urllib.parse
from typing import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scholion.sources.replay import _opened

PAGES = 1000
UNREADABLE = (OSError, ValueError, KeyError, TypeError)
DIGITS = 16


class SavedAnswers:
    """A folder of answers, one a cursor: ``{"items": [...], "next": cursor}`` in a file named by the quoted cursor."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def _answer(self, cursor: str) -> dict:
        system, name = _opened(f"{self.path}/{urllib.parse.quote(cursor, safe='')}.json")
        with system.open_input_file(name) as file:
            return json.load(io.BufferedReader(file))

    def following(self, cursor: str) -> str | None:
        answer = self._answer(cursor)
        answer["items"]
        return answer.get("next") or None

    def items(self, cursor: str) -> Iterator:
        return iter(self._answer(cursor)["items"])


class RowGroups:
    """Parquet files of a folder in the order of their names: a page a row group, its cursor ``file:group``. Following reads no rows."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self._files: list[str] | None = None

    def _names(self) -> list[str]:
        from pyarrow import fs

        if self._files is None:
            system, name = _opened(self.path)
            self._files = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(name)) if x.base_name.endswith(".parquet"))
        return self._files

    def _file(self, name: str):
        import pyarrow.parquet as pq

        system, full = _opened(f"{self.path}/{name}")
        return pq.ParquetFile(system.open_input_file(full))

    def _place(self, cursor: str) -> tuple[str, int]:
        name, _, group = cursor.rpartition(":")
        return (name, int(group)) if name else (self._names()[0], 0)  # any cursor without a file is the first

    def following(self, cursor: str) -> str | None:
        name, group = self._place(cursor)
        with self._file(name) as file:
            if group + 1 < file.num_row_groups:
                return f"{name}:{group + 1}"
        rest = self._names()[self._names().index(name) + 1 :]
        return f"{rest[0]}:0" if rest else None

    def items(self, cursor: str) -> Iterator[dict]:
        name, group = self._place(cursor)
        with self._file(name) as file:
            if group < file.num_row_groups:
                for batch in file.iter_batches(256, row_groups=[group]):
                    yield from batch.to_pylist()


def _service(options):
    name = options.get("service", "saved_answers")
    known = {"saved_answers": SavedAnswers, "row_groups": RowGroups}
    if name in known:
        return known[name](options)
    module, _, kind = name.rpartition(".")
    return getattr(importlib.import_module(module), kind)(options)


def _digest(cursor: str) -> str:
    return hashlib.sha256(cursor.encode()).hexdigest()[:DIGITS]


class _Page(InputPartition):
    def __init__(self, page: int, cursor: str):
        super().__init__((page, cursor))


class CursorReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.service = options, _service(options)
        self.most = int(options.get("pages", PAGES))
        self.at: dict | None = None  # how far the chain is planned
        self.chain: dict[int, str] = {}  # cursors of planned pages that aren't committed

    def initialOffset(self) -> dict:
        return {"page": 0, "cursor": self.options.get("start", "*"), "seen": "", "state": "open"}

    def _walk(self, at: dict, upto: int | None = None) -> dict:
        """Follow the chain from ``at`` for a batch, or up to a page."""
        page, cursor, seen, state = at["page"], at["cursor"], at["seen"], at["state"]
        met = {seen[k : k + DIGITS] for k in range(0, len(seen), DIGITS)}
        last = page + self.most if upto is None else upto
        while state == "open" and page < last:
            try:
                following = self.service.following(cursor)
            except UNREADABLE:
                if upto is not None:
                    raise  # a page of a planned batch: the batch can't be read again without it
                break
            self.chain[page] = cursor
            met.add(_digest(cursor))
            seen += _digest(cursor)
            page += 1
            if following is None:
                state = "complete"
            elif _digest(following) in met:
                state = "partial"
            else:
                cursor = following
        return {"page": page, "cursor": cursor, "seen": seen, "state": state}

    def latestOffset(self) -> dict:
        self.at = self._walk(self.at or self.initialOffset())
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:  # after a restart Spark plans the last batch of the checkpoint first
            self.at = end
        if any(page not in self.chain for page in range(start["page"], end["page"])):
            self._walk(start, end["page"])
        return [_Page(page, self.chain[page]) for page in range(start["page"], end["page"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page, cursor = partition.value
        for place, item in enumerate(_service(self.options).items(cursor)):
            yield page, cursor, place, json.dumps(item, ensure_ascii=False, default=str)

    def commit(self, end: dict) -> None:
        self.chain = {page: cursor for page, cursor in self.chain.items() if page >= end["page"]}


class CursorPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "page long, cursor string, place long, raw string"

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CursorPages)
