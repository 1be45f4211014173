"""Record files of any size as a Spark data source: parts of files are read by tasks of their own, written files appear at a commit.

A part is a range of bytes. It has the records whose first line begins in it, and reads on to their end; what begins
a record can be told from a line alone, so parts agree on the records wherever files are cut.

    spark.dataSource.register(RecordFiles)
    spark.read.format("recordloom").option("format", "ris").load("folder/*.ris")
    blocks.write.format("recordloom").option("format", "ris").mode("append").save("folder")
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from recordloom.sources import formats

#: Bytes of a part.
PART = 64 << 20
#: Bytes that are read at a time.
CHUNK = 1 << 20
#: Lines that begin a record, by format; files of a format without one are read whole by a task.
BEGINS = {"ris": re.compile(rb"\s*[Tt][Yy]\s*-"), "bibtex": re.compile(rb"\s*@"), "jsonl": re.compile(rb"")}
ENDINGS = {".ris": "ris", ".bib": "bibtex", ".bibtex": "bibtex", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}
#: The file ending that is written for a format.
WRITTEN = {"ris": ".ris", "bibtex": ".bib", "csl_json": ".jsonl"}

FIELDS = "path string, start long, place long, encoding string, fields map<string,string>"
LINES = "path string, start long, place long, encoding string, lines array<string>"


def filesystem(uri: str):
    """pyarrow's file system for a URI or a path, and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """Paths and sizes of a file, of a folder's files or of those that a pattern names, in order; hidden ones don't count."""
    from pyarrow import fs

    store, path = filesystem(uri)
    base = path
    while re.search(r"[*?\[]", base):
        base = os.path.dirname(base)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(uri)
    found = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    visible = [x for x in found if not any(p[0] in "._" for p in x[0][len(base) :].strip("/").split("/"))]
    return sorted(x for x in visible if base == path or fnmatch.fnmatch(x[0], path) and x[0].count("/") == path.count("/"))


def _lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines with their ends and places from `at`, which begins a line."""
    stream.seek(at)
    rest: list[bytes] = []
    while chunk := stream.read(CHUNK):
        *whole, last = chunk.split(b"\n")
        for line in whole:
            line = b"".join([*rest, line, b"\n"])
            rest = []
            yield at, line
            at += len(line)
        if last:
            rest.append(last)
    if rest:
        yield at, b"".join(rest)


def segments(stream, begins: re.Pattern | None, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """The records of a range as bytes, and whether the file ends there. What stands before a file's first record comes with the first part."""
    head = stream.read(2)
    if begins is None or head in (b"\xff\xfe", b"\xfe\xff"):  # a format or an encoding whose lines aren't told by bytes
        if start == 0:
            stream.seek(0)
            yield stream.read(), True
        return
    if start:  # a line that begins at `start` is the range's own
        stream.seek(start - 1)
        at = start - 1
        while chunk := stream.read(CHUNK):
            if (found := chunk.find(b"\n")) >= 0:
                at += found + 1
                break
            at += len(chunk)
        else:
            return
    else:
        at = 0
    held: list[bytes] = []
    inside = start == 0
    for place, line in _lines(stream, at):
        own = begins.match(line) is not None
        if place >= end and (own or not inside):
            if inside and held:
                yield b"".join(held), False
            return
        if own:
            if inside and held:
                yield b"".join(held), False
            inside, held = True, []
        if inside:
            held.append(line)
    if inside and held:
        yield b"".join(held), True


def blocks(text: str, last: bool) -> Iterator[list[str]]:
    """RIS records of a part of a file; an open one counts at the file's end only."""
    for block in formats.ris_blocks(text):
        if last or re.match(r"\s*[Ee][Rr]\s*-", block[-1]):
            yield block


def _items(text: str) -> Iterator[dict]:
    """Records of a JSON text; several values, one in a line, are one list."""
    try:
        yield from formats.read_json(text)
    except ValueError:
        yield from formats.read_json("[" + ",".join(x for x in text.splitlines() if x.strip()) + "]")


def parsed(fmt: str, text: str, last: bool, prefix: str) -> Iterator[dict]:
    if fmt == "ris":
        for block in blocks(text, last):
            yield from formats.read_ris("\n".join(block), prefix)
    elif fmt == "bibtex":
        yield from formats.read_bibtex(text, prefix)
    elif text.strip():
        yield from _items(text) if fmt == "json" else formats.read_json(f"[{text}]")


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partbytes", PART))
        self.prefix, self.raw = options.get("prefix", formats.CARRIED), options.get("lines", "false").lower()
        self.format = options.get("format") or ENDINGS.get(os.path.splitext(self.path.rstrip("/*"))[1].lower(), "")
        if self.format not in {*BEGINS, "json"} or self.raw != "false" and self.format != "ris":
            raise ValueError(f"unsupported record format: {self.format or self.path}")

    def partitions(self) -> list[InputPartition]:
        whole = self.format not in BEGINS
        return [Part(path, at, size if whole else min(size, at + self.size)) for path, size in listed(self.path) if size for at in range(0, 1 if whole else size, self.size)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = filesystem(self.path)
        place = 0
        with store.open_input_file(partition.path) as stream:
            for data, last in segments(stream, BEGINS.get(self.format), partition.start, partition.end):
                text, encoding = formats.decode(data)
                if self.raw == "count":
                    place += sum(1 for _ in blocks(text, last))
                    continue
                found = blocks(text, last) if self.raw == "true" else ({k: str(v) for k, v in r.items()} for r in parsed(self.format, text, last, self.prefix))
                for record in found:
                    yield partition.path, partition.start, place, encoding, record
                    place += 1
        if self.raw == "count":
            yield partition.path, partition.start, place, "", []


@dataclass
class Written(WriterCommitMessage):
    """A task's file under its temporary and its final name; blank if it had no rows."""

    temporary: str
    final: str
    records: int


class _Writer(DataSourceWriter):
    """Tasks write to a folder of temporary names; the commit gives those of the successful ones their own and lists them in `_manifest.json`."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.format = options.get("format", "")
        if self.format not in WRITTEN:
            raise ValueError(f"unsupported record format: {self.format}")

    def _folder(self):
        store, path = filesystem(self.uri)
        return store, path, f"{path}/_temporary-{self.run}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, path, temporary = self._folder()
        number, records = TaskContext.get().partitionId(), 0
        name = f"part-{number:05d}-{self.run[:8]}{WRITTEN[self.format]}"
        at = f"{temporary}/{uuid.uuid4().hex}"  # another for each attempt
        stream = None
        try:
            for row in iterator:
                if stream is None:
                    store.create_dir(temporary, recursive=True)
                    stream = store.open_output_stream(at)
                stream.write(row[-1].encode("utf-8", "surrogatepass"))
                records += 1
        finally:
            if stream is not None:
                stream.close()
        return Written(at if records else "", f"{path}/{name}", records)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path, temporary = self._folder()
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File] if self.overwrite else []
        kept = [m for m in messages if m is not None and m.temporary]
        for message in kept:
            store.move(message.temporary, message.final)
        for name in old:
            store.delete_file(name)
        with store.open_output_stream(f"{path}/_manifest.json" if self.overwrite else f"{path}/_manifest-{self.run[:8]}.json") as out:
            out.write(json.dumps({"files": [{"name": os.path.basename(m.final), "records": m.records} for m in kept]}).encode())
        self._clear(store, temporary)

    def abort(self, messages: list) -> None:
        store, _, temporary = self._folder()
        self._clear(store, temporary)

    @staticmethod
    def _clear(store, temporary: str) -> None:
        from pyarrow import fs

        if store.get_file_info(temporary).type == fs.FileType.Directory:
            store.delete_dir(temporary)


class RecordFiles(DataSource):
    """RIS, BibTeX and JSON files: path, start of the part, place in it, encoding and fields of each record.

    Options: format (ris, bibtex, json, jsonl; else by the path's ending), prefix of carried columns, partBytes, lines
    (true: a RIS record's lines instead of fields; count: a part's number of records as its place, nothing else). Written are the last column's texts, in the order of the partitions;
    formats are ris, bibtex and csl_json, which has an item in a line.
    """

    @classmethod
    def name(cls) -> str:
        return "recordloom"

    def schema(self) -> str:
        return FIELDS if self.options.get("lines", "false").lower() == "false" else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark) -> None:
    spark.dataSource.register(RecordFiles)


__all__ = ["RecordFiles", "filesystem", "listed", "register", "segments"]
