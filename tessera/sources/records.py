"""Length-prefixed record streams: a 4-byte little-endian size, then a message with url (1), body (2) and text (3).

``DocStreamSource`` is a Python data source (``spark.read.format("docstream").load(path)``), one partition
a file, gzip by suffix. A file is read record by record from the file system its path names (a plain path or
any URI that Arrow knows, such as file:, hdfs: or s3:), so driver and executors needn't share a disk. A torn
record at a file's end fails the read; with the option ``torn`` set to ``skip`` it ends the file.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator

from pyarrow import fs

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "url string, body string, text string"
FIELDS = ("url", "body", "text")


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode(data: bytes) -> tuple[str | None, str | None, str | None]:
    """Message to (url, body, text); absent fields are null, unknown ones skipped."""
    found: dict[int, str] = {}
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        field, kind = tag >> 3, tag & 7
        if kind == 2:
            size, at = read_varint(data, at)
            found[field] = data[at : at + size].decode("utf-8", "replace")
            at += size
        elif kind == 0:
            _, at = read_varint(data, at)
        else:
            at += {1: 8, 5: 4}[kind]
    return found.get(1), found.get(2), found.get(3)


def encode(url: str | None, body: str | None, text: str | None) -> bytes:
    out = b""
    for number, value in enumerate((url, body, text), 1):
        if value is not None:
            raw = value.encode("utf-8")
            out += write_varint(number << 3 | 2) + write_varint(len(raw)) + raw
    return out


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def read_records(path: str, torn: str = "fail") -> Iterator[tuple]:
    system, inner = file_system(path)
    with system.open_input_stream(inner, compression="gzip" if inner.endswith(".gz") else None) as f:
        while head := _exactly(f, 4):
            data = _exactly(f, struct.unpack("<i", head)[0]) if len(head) == 4 else None
            if data is None or len(data) < struct.unpack("<i", head)[0]:
                if torn == "skip":
                    return
                raise ValueError(f"{path} ends within a record")
            yield decode(data)


def _exactly(f, size: int) -> bytes:
    """``size`` bytes, fewer only at the end."""
    out = b""
    while len(out) < size and (part := f.read(size - len(out))):
        out += part
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def list_files(path: str) -> list[str]:
    """Files of a folder, or those that a pattern in the last part of the path names; hidden ones are left out."""
    system, inner = file_system(path)
    prefix = path[: len(path) - len(inner)]
    folder, name = posixpath.split(inner.rstrip("/"))
    pattern = name if any(c in name for c in "*?[") else None
    if pattern is None:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [path]
        folder = inner
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")) and (pattern is None or fnmatch.fnmatch(x.base_name, pattern)))
    return [prefix + n for n in names]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.torn = options["path"].split(","), options.get("torn", "fail")

    def partitions(self):
        return [_File(p) for path in self.paths for p in list_files(path)]

    def read(self, partition):
        yield from read_records(partition.value, self.torn)


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        name = posixpath.join(folder, f"part-{context.partitionId():05d}.gz")
        with system.open_output_stream(f"{folder}/.{context.partitionId()}-{context.attemptNumber()}", compression="gzip") as f:
            for row in rows:
                data = encode(*(row[c] for c in FIELDS))
                f.write(struct.pack("<i", len(data)) + data)
        system.move(f"{folder}/.{context.partitionId()}-{context.attemptNumber()}", name)
        return _Done()


class DocStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docstream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark) -> None:
    spark.dataSource.register(DocStreamSource)
