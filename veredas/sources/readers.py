"""Readers with fixed schemas: tables, CSV rosters, JSON lines, documents, rubrics."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROSTER = "segmento string, ano_letivo string, serie string, turma string, nome string, documento string"
RESULTS = "custom_id string, status int, body string"
SHEET_ROWS = 10_000  # of a workbook, given out at a time
WORD_NAMESPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A database table; with a numeric key it is read in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def roster(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-8 CSV with a header; an empty document is null."""
    rows = spark.read.schema(ROSTER).option("header", True).option("enforceSchema", False).csv(path)
    return rows.withColumn("documento", F.nullif(F.trim("documento"), F.lit("")))


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch results, one JSON object a line; lines that aren't JSON are dropped."""
    return spark.read.schema(RESULTS).option("mode", "DROPMALFORMED").json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, and the content's hash, by which a file is taken in once."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", "content", F.sha2("content", 256).alias("digest"))


def parser_for(path: Column) -> Column:
    """The parser by a file's extension; others are an error."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(ext == "pdf", "PDF").when(ext == "docx", "DOCX").when(ext.isin("txt", "text", "md"), "TEXT")
    return known.otherwise(F.raise_error(F.concat(F.lit("no parser for "), path)))


def _docx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{WORD_NAMESPACE}t")) for p in body.iter(f"{WORD_NAMESPACE}p")]


def _pdf(content: bytes) -> list[str]:
    from pypdf import PdfReader  # not part of this library: only where PDFs are read

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def _text(content: bytes) -> list[str]:
    paragraphs = re.split(r"\n\s*\n", content.decode("utf-8-sig").replace("\r\n", "\n"))
    return [p.strip() for p in paragraphs if p.strip()]


Parser = Callable[[bytes], list[str]]
#: Parsers by extension: paragraphs of documents and texts, pages of PDFs.
PARSERS: dict[str, Parser] = {"docx": _docx, "pdf": _pdf, "txt": _text, "text": _text, "md": _text}


def _parts(found: DataFrame, chosen: Callable[[str], Parser]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                texts = chosen(path)(bytes(content)) if content else []
                if texts:
                    yield pd.DataFrame({"path": [path] * len(texts), "number": range(len(texts)), "text": texts})

    return found.select("path", "content").mapInPandas(run, "path string, number int, text string")


def parsed(found: DataFrame, parsers: Mapping[str, Parser] = PARSERS) -> DataFrame:
    """path, number, text: the parts that its parser finds in each file (path, content), in one pass over the files.

    ``parsers`` may have others, by extension in lower case. A file of any other extension is an error; one without content has no rows.
    """

    def chosen(path: str) -> Parser:
        ext = path.rsplit(".", 1)[-1].lower()
        if ext not in parsers:
            raise ValueError(f"no parser for {path}")
        return parsers[ext]

    return _parts(found, chosen)


def docx_paragraphs(found: DataFrame) -> DataFrame:
    """path, number, text of the paragraphs of DOCX files (path, content)."""
    return _parts(found, lambda _: _docx)


def docx_file(paragraphs: list[str]) -> bytes:
    """A minimal DOCX of plain paragraphs."""
    from xml.sax.saxutils import escape

    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD_NAMESPACE[1:-1]}"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def _sheet(content: bytes) -> Iterator[list[str | None]]:
    """The cells of the rows of the first sheet, which is taken apart as it is unpacked: a row is held at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("xl/worksheets/sheet1.xml") as f:
        above: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if node.tag.rpartition("}")[2] == "row":
                yield [_cell(c) for c in node if c.tag.rpartition("}")[2] == "c"]
                for n in above:  # what has been read of them
                    n.clear()


def _cell(c: ElementTree.Element) -> str | None:
    if not len(c):
        return None
    if len(c) == 1 and c[0].tag.endswith("}v"):
        return c[0].text or ""
    return "".join(t.text or "" for t in (*c.findall(".//{*}t"), *c.findall("{*}v")))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            numbered = enumerate(_sheet(content))
            while rows := list(itertools.islice(numbered, SHEET_ROWS)):
                yield pd.DataFrame({"path": path, "number": [i for i, _ in rows], "cells": [c for _, c in rows]})


def sheet_rows(found: DataFrame) -> DataFrame:
    """path, number, cells (as text) of the rows of workbooks' first sheets (path, content)."""
    return found.select("path", "content").mapInPandas(_cells, "path string, number int, cells array<string>")


def pdf_pages(found: DataFrame) -> DataFrame:
    """path, page, text of PDF files' text layers; needs the pypdf package on the executors."""
    return _parts(found, lambda _: _pdf).withColumnRenamed("number", "page")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, line of a text column."""
    return df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("number", "line"))


def layout_lines(df: DataFrame, key: str, text: str, page: str = "\f") -> DataFrame:
    """key, page, number, indent, line: page breaks split pages, leading blanks give a line's place."""
    pages = df.select(key, F.posexplode(F.split(text, page)).alias("page", "_text"))
    rows = pages.select(key, "page", F.posexplode(F.split("_text", "\n")).alias("number", "line"))
    return rows.withColumn("indent", F.length("line") - F.length(F.ltrim("line"))).withColumn("line", F.trim("line")).filter("line <> ''")


def sections(df: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """key, section, line count: the lines under each heading; those before the first are under none."""
    from pyspark.sql import Window

    rows = lines(df, key, text)
    title = F.nullif(F.regexp_extract("line", heading, 1), F.lit(""))
    place = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(title, ignorenulls=True).over(place)).groupBy(key, "section").agg(F.count(F.lit(1)).alias("n"))


def better_text(native: Column, other: Column, score) -> Column:
    """Of two extractions the one of higher score; the native one on a tie."""
    return F.when(F.coalesce(score(other), F.lit(0.0)) > F.coalesce(score(native), F.lit(0.0)), other).otherwise(native)


def rubric(spark: SparkSession, text: str) -> DataFrame:
    """competency, level, points of a rubric in a subset of YAML: ``C1:`` lines with ``- level: points`` below."""
    rows, current = [], None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        name, _, value = body.removeprefix("- ").partition(":")
        if not value.strip():
            current = name
        elif current is None:
            raise ValueError(f"rubric level without a competency: {line!r}")
        else:
            rows.append((current, name.strip(), int(value)))
    return spark.createDataFrame(rows, "competency string, level string, points int")
