"""Files of a folder as a Spark data source, in batch and as a stream, and their parser as a table function of SQL."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from veredas.sources.readers import PARSERS

NAME = "parsed_files"
SCHEMA = "path string, number int, text string, error string, size long"
TASK_BYTES = 32_000_000
#: Files of these extensions are read line by line, and a large one by several tasks.
BY_LINE = ("jsonl", "csv", "log")
_CONTENT = {"number", "text", "error"}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Share(InputPartition):
    """What one task reads: (path, size, first byte, end); the end of a file that isn't cut is its size."""

    pieces: list[tuple[str, int, int, int]]


def listed(folder: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder whose names match, in the order of their paths."""
    from pyarrow import fs

    where, root = _filesystem(folder)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    visible = lambda f: not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.is_file and visible(f) and fnmatch.fnmatch(f.base_name, pattern))


def shares(files: list[tuple[str, int]], most: int = TASK_BYTES) -> list[Share]:
    """Tasks of near equal bytes, at most ``most`` unless one file that can't be cut has more: the largest pieces first, each to the task with the most room that it still fits."""
    pieces = []
    for path, size in files:
        step = most if path.rsplit(".", 1)[-1].lower() in BY_LINE else max(size, 1)
        pieces += [(path, size, at, min(size, at + step)) for at in range(0, max(size, 1), step)]
    tasks = max(1, -(-sum(p[3] - p[2] for p in pieces) // most))
    out: list[list] = [[0, []] for _ in range(tasks)]
    for piece in sorted(pieces, key=lambda p: (p[2] - p[3], p)):
        least = min(out, key=lambda x: x[0])
        if least[0] and least[0] + piece[3] - piece[2] > most:
            least = [0, []]
            out.append(least)
        least[0] += piece[3] - piece[2]
        least[1].append(piece)
    return [Share(sorted(p)) for _, p in out if p]


def _lines(source, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place of its first byte, line) of the lines that begin in [start, end); the one that runs into it belongs to the task before."""
    at = start
    if start:
        source.seek(start - 1)
        at += len(_line(source)) - 1
    while at < end:
        line = _line(source)
        if not line:
            return
        if line.strip():
            yield at, line.decode("utf-8").rstrip("\r\n")
        at += len(line)


def _line(source) -> bytes:
    return source.readline()


def _read(share: Share, names: list[str], folder: str) -> Iterator[tuple]:
    where, _ = _filesystem(folder)
    row = lambda **v: tuple(v.get(n) for n in names)
    opened = bool(_CONTENT & set(names))
    for path, size, start, end in share.pieces:
        if not opened:  # only what the listing tells is asked for
            if start == 0:
                yield row(path=path, size=size)
            continue
        ext = path.rsplit(".", 1)[-1].lower()
        try:
            if ext in BY_LINE:
                import io

                with io.BufferedReader(where.open_input_file(path), 1 << 20) as source:
                    for place, text in _lines(source, start, end):
                        yield row(path=path, number=place, text=text, size=size)
            elif ext in PARSERS:
                with where.open_input_file(path) as source:
                    texts = PARSERS[ext](source.read())
                for i, text in enumerate(texts):
                    yield row(path=path, number=i, text=text, size=size)
            else:
                yield row(path=path, error=f"no parser for .{ext}", size=size)
        except Exception as e:  # a damaged file is a row, not the end of the job
            yield row(path=path, error=f"{type(e).__name__}: {e}"[:200], size=size)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.most, self.names = int(options.get("taskBytes", TASK_BYTES)), schema.names

    def partitions(self) -> list[Share]:
        return shares(listed(self.folder, self.pattern), self.most) or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        yield from _read(partition, self.names, self.folder)


class _StreamReader(DataSourceStreamReader):
    """Offsets count the listings that are written to the folder of option ``log``: each has the files that were new then.

    A file is in one listing, whenever it was written or came, so no restart reads it twice and none is missed for its time.
    """

    def __init__(self, options: dict, schema: StructType):
        if "log" not in options:
            raise ValueError("a stream of files needs the option 'log': a folder that restarts find again")
        self.folder, self.pattern, self.log = options["path"], options.get("pattern", "*"), options["log"]
        self.most, self.names = int(options.get("taskBytes", TASK_BYTES)), schema.names

    def _listings(self) -> dict[int, list[tuple[str, int]]]:
        out = {}
        for path, _ in listed(self.log, "*.json"):
            where, _ = _filesystem(self.log)
            with where.open_input_file(path) as f:
                out[int(path.rsplit("/", 1)[-1][:-5])] = [tuple(x) for x in json.loads(f.read())]
        return out

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        known = self._listings()
        seen = {path for files in known.values() for path, _ in files}
        new = [f for f in listed(self.folder, self.pattern) if f[0] not in seen]
        last = max(known, default=0)
        if not new:
            return {"listing": last}
        where, root = _filesystem(self.log)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/.{last + 1}") as f:
            f.write(json.dumps(new).encode())
        where.move(f"{root}/.{last + 1}", f"{root}/{last + 1}.json")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        known = self._listings()
        return shares([f for n in range(start["listing"] + 1, end["listing"] + 1) for f in known.get(n, [])], self.most) or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        yield from _read(partition, self.names, self.folder)


class ParsedFiles(DataSource):
    """The parts of the files of a folder: paragraphs of DOCX files and texts, pages of PDFs, lines of JSONL, CSV and log files.

    Columns: path, number (of the part; of a line its first byte), text, error, size. A file that can't be read, or that no parser knows,
    is one row with an error. With a schema of fewer columns only those are made: with path and size alone no file is opened.
    Options: path, pattern (of file names), taskBytes, and for streams log.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)


@udtf
class Parse:
    """``parse(path, content [, form])`` in SQL: the parts of a file; with the form 'whole' one row of their number and joined text.

    A file without content has no rows, one of an unknown extension is an error.
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, form: AnalyzeArgument | None = None) -> AnalyzeResult:
        if form is not None and (not form.isConstantExpression or form.value not in ("parts", "whole")):
            raise ValueError("the form is 'parts' or 'whole'")
        whole = form is not None and form.value == "whole"
        return AnalyzeResult(StructType().add("parts" if whole else "number", IntegerType()).add("text", StringType()))

    def eval(self, path: str, content: bytes, form: str = "parts"):
        ext = path.rsplit(".", 1)[-1].lower()
        if ext not in PARSERS:
            raise ValueError(f"no parser for {path}")
        texts = PARSERS[ext](bytes(content)) if content else []
        if form == "whole":
            if texts:
                yield len(texts), "\n".join(texts)
        else:
            yield from enumerate(texts)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("parsed_files")`` and the SQL function ``parse`` known to a session."""
    spark.dataSource.register(ParsedFiles)
    spark.udtf.register("parse", Parse)
