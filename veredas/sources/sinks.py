"""Sinks: atomic replacement, append, upsert, rebuilt partitions, natural keys, reports and request lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from veredas.sources.shared import discard, exists, swap


def replace(df: DataFrame, path: str) -> int:
    """The whole table anew: staged beside, then swapped in. Returns its rows."""
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    n = df.sparkSession.read.parquet(staged).count()
    swap(df.sparkSession, staged, path)
    return n


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


PART = "key_part"  # the partition column of keyed tables


def _part(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(parts)).cast("int").alias(PART)


def keyed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a table that ``upsert`` and ``add_missing`` keep; none before their first call."""
    finish(spark, path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop(PART)


def finish(spark: SparkSession, path: str) -> None:
    """Takes up a change whose new partitions are all written beside the table, but whose driver was lost before they were in it."""
    staged = f"{path}.changed"
    if exists(spark, f"{staged}/_SUCCESS"):
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
        discard(spark, staged)


def _changed(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], parts: int, order: Sequence[Column]) -> int:
    """Puts new rows into the partitions of their keys, one row a key, the first by ``order`` (``_new`` is 1 for new ones)."""
    finish(spark, path)
    if exists(spark, path) and PART not in spark.read.parquet(path).columns:  # a plain table becomes a keyed one, once
        plain = f"{path}.keyed"
        spark.read.schema(new.schema).parquet(path).withColumn(PART, _part(keys, parts)).write.mode("overwrite").partitionBy(PART).parquet(plain)
        swap(spark, plain, path)
    rows = new.withColumn("_new", F.lit(1)).withColumn(PART, _part(keys, parts))
    touched = [r[0] for r in rows.select(PART).distinct().collect()]  # at most ``parts`` numbers
    if exists(spark, path):
        there = spark.read.schema(StructType([*new.schema.fields, StructField(PART, IntegerType())])).parquet(path)
        rows = rows.unionByName(there.filter(F.col(PART).isin(touched)).withColumn("_new", F.lit(0)))
    first = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order))
    staged = f"{path}.changed"
    kept = rows.withColumn("_first", first).filter("_first = 1").drop("_first", "_new").select(*new.columns, PART)
    kept.write.mode("overwrite").partitionBy(PART).parquet(staged)
    finish(spark, path)
    return len(touched)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], at: str, parts: int = 64) -> int:
    """New rows replace old ones of the same key; of several new ones the latest counts. Returns the number of partitions rewritten.

    Keys are hashed into ``parts`` partitions, the same number in every call; only those that new rows fall into are read
    and rewritten. They are written beside the table first: until that is done a lost driver changes nothing, and after it the next
    call or read of ``keyed`` puts them in place. The same rows again leave the table as it is. One writer at a time.
    """
    return _changed(spark, path, new, keys, parts, [F.desc("_new"), F.desc(at)])


def rebuild(df: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that the rows have, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def add_missing(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], parts: int = 64) -> int:
    """Adds rows whose natural key isn't there yet, one a key; returns the number of partitions rewritten.

    As with ``upsert`` a key has one partition, which is rewritten as a whole: so no key is there twice, whatever is added again.
    """
    return _changed(spark, path, rows.dropDuplicates(list(keys)), keys, parts, [F.asc("_new")])


def report(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def request_lines(df: DataFrame, path: str, custom_id: Column, body: Column) -> None:
    """One JSON object a line, with an identifier that comes from the row alone."""
    line = F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), body.alias("body")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


# The parts of a workbook of one sheet, and their names.
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}"><sheets><sheet name="1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


class SheetFile:
    """A workbook of one sheet, row by row: numbers as numbers, other values as text, nulls as empty cells. Only the packed file is held."""

    def __init__(self, name: str = "1"):
        from xml.sax.saxutils import quoteattr

        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        for file, part in PARTS.items():
            self.zip.writestr(file, part.replace('sheet name="1"', f"sheet name={quoteattr(name)}"))
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<worksheet xmlns="{SHEET}"><sheetData>'.encode())

    def add(self, rows: Iterable[Sequence[object]]) -> None:
        self.sheet.write("".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows).encode())

    def close(self) -> bytes:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        return self.out.getvalue()


def _cell(v: object) -> str:
    from xml.sax.saxutils import escape

    if v is None or v != v:
        return "<c/>"
    return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def sheet_file(rows: Iterable[Sequence[object]], name: str = "1") -> bytes:
    """A workbook of one sheet of the rows, as ``SheetFile`` makes it."""
    file = SheetFile(name)
    file.add(rows)
    return file.close()


def workbooks(df: DataFrame, by: str, order: Sequence[str], sheet: str = "1") -> DataFrame:
    """path, content: a workbook for each value of ``by``, its rows in order (nulls last) under the columns' names.

    A workbook's rows are sorted by the shuffle and streamed through one task, which holds a batch of them and the packed file.
    The number of partitions is Spark's, stated, so that small workbooks aren't put together into few tasks.
    """
    names = [c for c in df.columns if c != by]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda name, file: pa.RecordBatch.from_pydict({"path": [f"{name}.xlsx"], "content": [file.close()]})
        file = at = None
        for batch in batches:
            of = batch.column(0).to_pylist()
            rows = list(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)) if names else [()] * len(of)
            ends = [i for i in range(1, len(of)) if of[i] != of[i - 1]]
            for start, end in zip([0, *ends], [*ends, len(of)], strict=True):
                if start == end:  # an empty batch
                    continue
                if file is None or of[start] != at:
                    if file is not None:
                        yield made(at, file)
                    file, at = SheetFile(sheet), of[start]
                    file.add([names])
                file.add(rows[start:end])
        if file is not None:
            yield made(at, file)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(by, *names).repartition(parts, by).sortWithinPartitions(by, *[F.asc_nulls_last(c) for c in order])
    return dealt.mapInArrow(pack, "path string, content binary")


# The layouts of an essay report, with their sheets' names and columns.
REPORTS = {
    "submission_list": ("Entregas", ("Aluno", "Entregou")),
    "grades_total": ("Notas", ("Aluno", "Entregou", "Nota total")),
    "grades_per_competency": ("Notas por competência", ("Aluno", "Entregou", "C1", "C2", "C3", "C4", "C5", "Nota total")),
}


def report_layout(students: DataFrame, kind: str, by: str = "path") -> DataFrame:
    """``by`` and the columns of a report, of students (name, submitted, total, c1 ... c5); a kind that there isn't is an error.

    Submitted is Sim or Não; grades that are missing stay empty.
    """
    if kind not in REPORTS:
        raise ValueError(f"unknown report {kind!r}: one of {', '.join(REPORTS)}")
    known = {"Aluno": F.col("name"), "Entregou": F.when(F.coalesce("submitted", F.lit(False)), "Sim").otherwise("Não"), "Nota total": F.col("total"), **{f"C{i}": F.col(f"c{i}") for i in range(1, 6)}}
    return students.select(by, *[known[c].alias(c) for c in REPORTS[kind][1]])


def report_files(students: DataFrame, kind: str, by: str) -> DataFrame:
    """path, content: a workbook of a report for each value of ``by``, its sheet named as the layout says, students in the order of their names."""
    return workbooks(report_layout(students, kind, by), by, ["Aluno"], REPORTS[kind][0])
