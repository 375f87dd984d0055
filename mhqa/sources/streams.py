"""Python data sources that stream large files: entries of JSON objects and arrays, numbered lines by byte ranges.

A path is one on a file system that all machines mount, or a URI that pyarrow knows. No file is held in memory as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK, RANGE = 1 << 20, 64 << 20


def open_binary(path: str) -> BinaryIO:
    """A readable, seekable byte stream."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def size_of(path: str) -> int:
    if "://" not in path or path.startswith("file://"):
        return os.path.getsize(path.removeprefix("file://"))
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).size


class JsonStream:
    """Values of a JSON file one by one, as they are written; ValueError for what isn't JSON."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK) -> None:
        import codecs

        self.stream, self.chunk = stream, chunk
        self.decode = codecs.getincrementaldecoder("utf-8")()
        self.buffer, self.at, self.ended = "", 0, False
        self.decoder = json.JSONDecoder()

    def _more(self) -> bool:
        """Reads on, more at a time the longer the value is; False at the end."""
        if self.ended:
            return False
        data = self.stream.read(max(self.chunk, len(self.buffer) - self.at))
        self.ended = not data
        self.buffer = self.buffer[self.at :] + self.decode.decode(data, final=self.ended)
        self.at = 0
        return True

    def peek(self) -> str:
        """The next sign that isn't white space, '' at the end."""
        while True:
            while self.at < len(self.buffer):
                if self.buffer[self.at] not in " \t\r\n":
                    return self.buffer[self.at]
                self.at += 1
            if not self._more():
                return ""

    def expect(self, signs: str) -> str:
        found = self.peek()
        if not found or found not in signs:
            raise ValueError(f"expected one of {signs!r}, found {found!r}")
        self.at += 1
        return found

    def value(self) -> str:
        """The text of the next value."""
        if not self.peek():
            raise ValueError("the file ends within a value")
        while True:
            try:
                _, end = self.decoder.raw_decode(self.buffer, self.at)
                if end < len(self.buffer) or self.ended:  # a number may go on in the next chunk
                    text, self.at = self.buffer[self.at : end], end
                    return text
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self._more()

    def entries(self) -> Iterator[str | None]:
        """The keys of an object, or None for each item of an array; the value stands next each time and must be read."""
        closing = {"{": "}", "[": "]"}[self.expect("{[")]
        if self.peek() == closing:
            self.at += 1
            return
        while True:
            key = None
            if closing == "}":
                key = json.loads(self.value())
                if not isinstance(key, str):
                    raise ValueError("a key must be a string")
                self.expect(":")
            yield key
            if self.expect("," + closing) == closing:
                return

    def finish(self) -> None:
        if self.peek():
            raise ValueError("something follows the value")


_ENTRIES = pa.schema([("path", pa.string()), ("section", pa.string()), ("key", pa.string()), ("pos", pa.int64()), ("value", pa.string())])


class _EntryReader(DataSourceReader):
    def __init__(self, paths: list[str], nested: bool) -> None:
        self.paths, self.nested = paths, nested

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        with open_binary(partition.value) as stream:
            source = JsonStream(stream)
            for section in source.entries() if self.nested else (None,):
                for pos, key in enumerate(source.entries()):
                    rows.append((partition.value, section, key, pos, source.value()))
                    size += len(rows[-1][-1])
                    if size > CHUNK:
                        yield self._batch(rows)
                        rows, size = [], 0
            source.finish()
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _ENTRIES)], schema=_ENTRIES)


class JsonEntries(DataSource):
    """``json_entries``: (path, section, key, pos, value) of the entries of one JSON object or array a file, in one pass, each value as JSON text.

    Options: ``paths``, one a line; ``nested`` (true): the root is an object, and the entries are those of its values, which ``section`` names.
    """

    @classmethod
    def name(cls) -> str:
        return "json_entries"

    def schema(self) -> str:
        return "path string, section string, key string, pos long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _EntryReader([p for p in self.options["paths"].split("\n") if p], self.options.get("nested", "false") == "true")


_LINES = pa.schema([("path", pa.string()), ("range", pa.int32()), ("number", pa.int64()), ("value", pa.string())])


class _LineReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int) -> None:
        self.paths, self.size = paths, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, k, k * self.size, (k + 1) * self.size)) for p in self.paths for k in range(-(-size_of(p) // self.size) or 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, index, start, end = partition.value
        with open_binary(path) as stream:
            stream.seek(max(start - 1, 0))
            if start:  # the line that crosses the border belongs to the range before
                stream.readline()
            number, lines, size = 0, [], 0
            while stream.tell() < end and (line := stream.readline()):
                number += 1
                lines.append(line.decode("utf-8").rstrip("\r\n"))
                size += len(line)
                if size > CHUNK:
                    yield self._batch(path, index, number, lines)
                    lines, size = [], 0
            yield self._batch(path, index, number, lines)

    @staticmethod
    def _batch(path: str, index: int, number: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([index] * n, pa.int32()), pa.array(range(number - n + 1, number + 1), pa.int64()), pa.array(lines, pa.string())], schema=_LINES)


class LineRanges(DataSource):
    """``line_ranges``: (path, range, number, value) of text files, one partition for each ``bytes`` of a file; ``number`` counts the lines of the range, blank ones too."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "path string, range int, number long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _LineReader([p for p in self.options["paths"].split("\n") if p], int(self.options.get("bytes", RANGE)))
