"""Spark data sources of the study's annotated corpora: ``spark.read.format(...)`` after ``register``.

Folders are listed once, on the driver; files and members are read by the tasks, by ranges where a file is large. Filters on the columns
that name a file, a member or a kind are pushed to the listing or the reader, with ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import gzip
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.cuts import file_system
from . import sinks

#: Bytes of a file that a task reads, and small files that it reads together.
RANGE_BYTES, FILES = 32 << 20, 64


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters through to them."""
    for source in (StandoffDocuments, PubTatorBlocks, ZippedQuestions):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of some ending, below a folder or the file itself."""
    return [f for f in sinks.listed(*file_system(path)) if re.search(ending, f[0])]


def wanted(filters: Iterable[Filter], column: str) -> set | None:
    """The values that filters leave of a column; None if they leave all."""
    held: set | None = None
    for f in filters:
        values = {f.value} if isinstance(f, EqualTo) and f.attribute == (column,) else set(f.value) if isinstance(f, In) and f.attribute == (column,) else None
        if values is not None:
            held = values if held is None else held & values
    return held


def split_filters(filters: list[Filter], columns: tuple[str, ...]) -> tuple[list[Filter], list[Filter]]:
    """Those that fix one of some columns to values, and the rest."""
    ours = [f for f in filters if isinstance(f, (EqualTo, In)) and f.attribute in [(c,) for c in columns]]
    return ours, [f for f in filters if not any(f is g for g in ours)]


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Member(InputPartition):
    path: str
    name: str


class _Reader(DataSourceReader):
    #: Columns whose filters are taken over whole.
    columns: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options = options
        self.path = options["path"]
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.taken, rest = split_filters(filters, self.columns)
        yield from rest

    def keeps(self, column: str, value) -> bool:
        left = wanted(self.taken, column)
        return left is None or value in left


class StandoffDocuments(DataSource):
    """Stand-off annotations with their document's text (SRC-07, SRC-08): ``.load(folder)`` of .ann files; the option ``texts`` names the
    folder of .txt files, the same unless given. A document without a text has the empty one.

    A row a text-bound annotation; status is ok, multi_code, discontinuous, concept_less or malformed. ``in_text``: the mention stands
    at its span.
    """

    @classmethod
    def name(cls) -> str:
        return "standoff_documents"

    def schema(self) -> str:
        return "doc_id string, ann_id string, status string, codes array<string>, start int, end int, mention string, text string, in_text boolean"

    def reader(self, schema) -> DataSourceReader:
        return _StandoffReader(dict(self.options))


class _StandoffReader(_Reader):
    columns = ("doc_id", "status")

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in listed(self.path, r"\.ann$") if self.keeps("doc_id", _stem(p))]
        return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        beside = file_system(self.options["texts"])[1] if "texts" in self.options else None
        for path in partition.paths:
            folder = beside or path.rpartition("/")[0]
            text = _whole(system, f"{folder}/{_stem(path)}.txt")
            for line in _whole(system, path).split("\n"):
                row = annotation(line)
                if row is not None and self.keeps("status", row[1]):
                    ann_id, status, codes, start, end, mention = row
                    at = start is not None and mention is not None and text[start:end] == mention
                    yield _stem(path), ann_id, status, codes, start, end, mention, text, at


def _stem(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


def _whole(system: pafs.FileSystem, path: str) -> str:
    """A file's text; empty where there is none."""
    if system.get_file_info(path).type == pafs.FileType.NotFound:
        return ""
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8")


def annotation(line: str) -> tuple | None:
    """(ann_id, status, codes, start, end, mention) of a text-bound annotation's line; None of another."""
    fields = line.rstrip("\r").split("\t")
    if not fields[0].startswith("T"):
        return None
    head = fields[1] if len(fields) > 1 else ""
    spans = [tuple(map(int, m)) for m in re.findall(r"(\d+) (\d+)(?=;|$)", head)]
    codes = re.findall(r"\b(\d{6,})\b(?!\s+\d+\s*$)(?=[^;]*\s)", head)
    if len(fields) < 3 or not spans:
        status = "malformed"
    elif "CONCEPT_LESS" in head:
        status = "concept_less"
    else:
        status = "discontinuous" if len(spans) > 1 else "multi_code" if len(codes) > 1 else "ok"
    return fields[0], status, codes, spans[0][0] if spans else None, spans[-1][1] if spans else None, fields[2] if len(fields) > 2 else None


class PubTatorBlocks(DataSource):
    """Blocks of title, abstract and annotations (SRC-05): ``.load(file or folder)``. A row a mention; text is title, blank, abstract.

    A plain file is read in ranges, a block by the task in whose range it begins; a .gz file by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "pubtator_blocks"

    def schema(self) -> str:
        return "pmid string, text string, start int, end int, mention string, types string, cui string"

    def reader(self, schema) -> DataSourceReader:
        return _PubTatorReader(dict(self.options))


class _PubTatorReader(_Reader):
    columns = ("pmid",)

    def partitions(self) -> list[InputPartition]:
        width = int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES)))
        out: list[InputPartition] = []
        for path, size in listed(self.path, r""):
            step = max(1, size if path.endswith(".gz") else width)
            out += [Range(path, at, min(size, at + step)) for at in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        for block in blocks(file_system(self.path)[0], partition):
            yield from (row for row in mentions(block) if self.keeps("pmid", row[0]))


def blocks(system: pafs.FileSystem, part: Range, read_bytes: int = 1 << 20) -> Iterator[str]:
    """The blocks that begin in a range: after the file's begin or an empty line. The last is read to its end, beyond the range."""
    with system.open_input_file(part.path) as raw:
        if part.path.endswith(".gz"):
            data = gzip.decompress(raw.read()).replace(b"\r\n", b"\n")
            yield from (b.decode("utf-8") for b in re.split(rb"\n(?:[ \t]*\n)+", data) if b.strip())
            return
        # two bytes before tell whether a block begins at the range's first
        at = max(0, part.begin - 2)
        raw.seek(at)
        held = b""

        def more() -> bool:
            nonlocal held
            got = raw.read(read_bytes)
            held += got
            return bool(got)

        if part.begin:
            while (cut := held.find(b"\n\n")) < 0:
                if not more():
                    return
            at, held = at + cut + 2, held[cut + 2 :]
        while True:
            while not held.lstrip(b"\n") and more():
                pass
            empty = len(held) - len(held.lstrip(b"\n"))
            at, held = at + empty, held[empty:]
            if not held or at >= part.end:
                return
            while (cut := held.find(b"\n\n")) < 0 and more():
                pass
            block = held if cut < 0 else held[:cut]
            if block.strip():
                yield block.decode("utf-8")
            size = len(held) if cut < 0 else cut + 2
            at, held = at + size, held[size:]


def mentions(block: str) -> Iterator[tuple]:
    """(pmid, text, start, end, mention, types, cui) of a block's annotations; none without a title."""
    lines = [line.rstrip("\r") for line in block.split("\n")]
    found = {mark: next((m for m in (re.match(rf"(\d+)\|{mark}\|(.*)$", line) for line in lines) if m), None) for mark in "ta"}
    if found["t"] is None:
        return
    text = f"{found['t'][2]} {found['a'][2] if found['a'] else ''}"
    number = lambda s: int(s) if re.match(r"\s*[+-]?\d+\s*\Z", s) else None
    for f in (line.split("\t") for line in lines):
        if len(f) >= 6:
            yield found["t"][1], text, number(f[1]), number(f[2]), f[3], f[4], f[5].removeprefix("UMLS:")


class ZippedQuestions(DataSource):
    """Questions of the JSON members of ZIP files (SRC-14): ``.load(file or folder)``; the option ``member`` is a pattern of their names.

    A task a member, read by its range: the rest of the archive stays where it is. An exact answer may be a text, a list, or a list of
    lists.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_questions"

    def schema(self) -> str:
        return "archive string, member string, id string, type string, body string, answers array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(dict(self.options))


class _ZipReader(_Reader):
    columns = ("member", "type")

    def partitions(self) -> list[InputPartition]:
        system, _ = file_system(self.path)
        pattern, out = self.options.get("member", r"\.json$"), []
        for path, _ in listed(self.path, r"\.zip$"):
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                out += [Member(path, n) for n in archive.namelist() if re.search(pattern, n) and self.keeps("member", n)]
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[tuple]:
        if not partition.path:
            return
        with file_system(self.path)[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            questions = json.loads(archive.read(partition.name))["questions"]
        for q in questions:
            if self.keeps("type", q.get("type")):
                yield partition.path.rpartition("/")[2], partition.name, q.get("id"), q.get("type"), q.get("body"), flat(q.get("exact_answer"))


def flat(answer) -> list[str]:
    """The texts of an exact answer, each once, as they come."""
    if answer is None:
        return []
    if isinstance(answer, list):
        return list(dict.fromkeys(x for a in answer for x in flat(a)))
    return [str(answer)]
