"""A transactional sink of files: tasks stage, one commit on the driver makes all of them visible, an abort none.

``StagedWriter`` is the mechanism: every task attempt writes into the job's own folder under names of its own and returns
what it wrote; the commit writes ``_manifest.json`` in one rename. Readers know a file only by the manifest, so what a lost
executor or a second attempt left is never seen, and is removed at commit. A failed job removes its folder. A target that
has a manifest is refused: results are never overwritten.

``DocumentFiles`` (``format("document_files")``) stores rows (name, content) as a file each and reads them back with their digest
checked. Paths are those that pyarrow's file systems know (local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scholion.sources.replay import _opened

MANIFEST = "_manifest.json"


class SinkError(ValueError):
    pass


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """Writes what ``files`` yields: (name, content, facts), the facts a small dict that goes into the manifest."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"job-{uuid.uuid4().hex}"
        system, at = _opened(f"{self.path}/{MANIFEST}")
        if system.get_file_info(at).is_file:
            raise SinkError(f"{path} holds committed files; use a fresh folder")
        # made here and not by the tasks: one that outlives an abort finds no folder to write into
        system.create_dir(posixpath.join(posixpath.dirname(at), self.job), recursive=True)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, dict]]:
        raise NotImplementedError

    def write(self, iterator):
        out, attempt = [], uuid.uuid4().hex[:12]
        system, folder = _opened(f"{self.path}/{self.job}")
        for k, (name, content, facts) in enumerate(self.files(iterator)):
            stored = f"{attempt}-{k:06d}"
            with system.open_output_stream(posixpath.join(folder, stored)) as file:
                file.write(content)
            out.append({"name": name, "stored": f"{self.job}/{stored}", "bytes": len(content), "crc32": zlib.crc32(content), **facts})
        return Written(out)

    def commit(self, messages):
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        twice = {a["name"] for a, b in zip(files, files[1:]) if a["name"] == b["name"]}
        if twice:
            raise SinkError(f"written twice: {sorted(twice)[:3]}")
        system, folder = _opened(self.path)
        known = {posixpath.basename(f["stored"]) for f in files}
        for info in system.get_file_info(fs.FileSelector(f"{folder}/{self.job}", allow_not_found=True)):
            if info.base_name not in known:
                system.delete_file(info.path)
        part = f"{folder}/{self.job}.manifest"
        with system.open_output_stream(part) as out:
            out.write(json.dumps({"version": 1, "files": files}).encode())
        system.move(part, f"{folder}/{MANIFEST}")

    def abort(self, messages):
        system, folder = _opened(f"{self.path}/{self.job}")
        for _ in range(5):  # tasks that end meanwhile may still add a file
            if system.get_file_info(folder).type.name != "Directory":
                break
            try:
                system.delete_dir(folder)
            except OSError:
                time.sleep(0.2)


def committed(path: str) -> list[dict]:
    """The manifest's entries, by name; a folder without one holds nothing."""
    system, at = _opened(f"{path.rstrip('/')}/{MANIFEST}")
    if not system.get_file_info(at).is_file:
        raise SinkError(f"{path} holds no committed files")
    with system.open_input_file(at) as file:
        return json.loads(file.read())["files"]


def content_of(path: str, entry: dict) -> bytes:
    """A stored file, refused if it isn't what was written."""
    system, at = _opened(f"{path.rstrip('/')}/{entry['stored']}")
    with system.open_input_file(at) as file:
        content = file.read()
    if len(content) != entry["bytes"] or zlib.crc32(content) != entry["crc32"]:
        raise SinkError(f"{entry['name']} differs from what was written")
    return content


class StagedReader(DataSourceReader):
    """A partition a file; subclasses turn a file into record batches."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(x) for x in committed(self.path)]

    def rows(self, entry: dict, content: bytes) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def read(self, partition):
        if partition is not None:  # a plan without partitions is read once with none
            yield from self.rows(partition.value, content_of(self.path, partition.value))


class DocumentFiles(DataSource):
    """``df.write.format("document_files").mode("append").save(path)`` of (name, content); the same to read."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content binary, crc32 long"

    def writer(self, schema, overwrite):
        if overwrite:
            raise SinkError("committed files aren't overwritten; use mode append and a fresh folder")
        return _DocumentWriter(self.options["path"])

    def reader(self, schema):
        return _DocumentReader(self.options["path"])


class _DocumentWriter(StagedWriter):
    def files(self, batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name:
                    raise SinkError("a document needs a name")
                yield name, content or b"", {}


class _DocumentReader(StagedReader):
    def rows(self, entry, content):
        kinds = pa.schema([("name", pa.string()), ("content", pa.binary()), ("crc32", pa.int64())])
        yield pa.RecordBatch.from_pylist([{"name": entry["name"], "content": content, "crc32": entry["crc32"]}], schema=kinds)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
