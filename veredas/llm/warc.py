"""WARC archives by way of a chunked record table.

Writing: payloads are cut into chunks of ``CHUNK`` characters. A chunk is a row (record number, chunk number, bytes so
far, digest so far): the digest runs on from chunk to chunk, so the last row has the payload's, and no payload is
digested or copied whole. Which pages revisit others is decided on the last rows alone, without their bodies. The
chunk rows are then written as WARC: the first chunk's record is the page's, later ones are ``continuation`` segments
with a segment number and the record's identifier, as the format has it for oversized payloads. Every chunk carries
its own digest and the payload's so far. Of equal payloads of ``LEAST`` bytes or more, the page of the largest id is
stored, and the others are ``revisit`` records without a payload.

Reading: archives are streamed record by record: each record starts with a line that names its collection
(``WARC-Warcinfo-ID``, a fresh identifier), and that line divides the stream. Lengths and digests are checked against
the headers; a mismatch is an error. A record's chunks lie one after the other in a file and run through a digest
that only keeps its state. Records that two files share are read again, and only their chunks are shuffled.

A file is one gzip stream, not a member a record: Spark's writer has no other.

Nulls: a null html is an empty payload, a null url an empty one. A null page_id is never referred to: pages of null id
with an equal payload revisit the largest id, or are responses if there is none. Pages that repeat the
largest id are all responses. An empty table gives archives without pages. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veredas.llm.common import pick, remove, scratch_path, written

LEAST = 1000
CHUNK = 4096  # characters of a chunk
RECORDS = 40_000  # lines of two a chunk in a file
HELD = 4_000_000  # bytes of chunks that a task hands on at a time
MOST_BROADCAST = 500_000  # revisits, about 100 bytes each
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _mark(collection: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{collection}>\r\n"


def _chunker(chunk: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, of, told, held = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            ids, urls = batch.column("page_id"), batch.column("url")

            def handed(ids=ids, urls=urls) -> pa.RecordBatch:
                at, rest = pa.array(of, pa.int64()), zip(*told, strict=True)
                rec, no, last, body, size, digest = (list(c) for c in rest)
                out = [rec, ids.take(at), urls.take(at), no, last, body, size, digest]
                return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

            for i, html in enumerate(batch.column("html")):
                text, state, size = html.as_py() or "", hashlib.sha1(), 0
                for no, start in enumerate(range(0, max(1, len(text)), chunk), 1):
                    body = text[start : start + chunk]
                    data = body.encode("utf-8", "surrogatepass")
                    state.update(data)
                    size += len(data)
                    held += len(data)
                    of.append(i)
                    told.append((record, no, start + chunk >= len(text), body, size, state.hexdigest()))
                    if held >= HELD:
                        yield handed()
                        of, told, held = [], [], 0
                record += 1
            if of:
                yield handed()
                of, told, held = [], [], 0

    return run


def chunks(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a chunk: record, page_id, url, chunk_no (from 1), last, body, and the payload's size and digest so far."""
    rows = pick(pages, "page_id", "url", "html")
    kind = dict(rows.dtypes)["page_id"]
    out = rows.select("page_id", "url").limit(0).toArrow().schema
    schema = pa.schema([("record", pa.int64()), ("page_id", out.field("page_id").type), ("url", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("body", pa.string()), ("size", pa.int64()), ("digest", pa.string())])
    rows = rows.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_chunker(chunk, schema), f"record long, page_id {kind}, url string, chunk_no int, last boolean, body string, size long, digest string")


def revisits(table: DataFrame) -> DataFrame:
    """record, keep (the page that it revisits), payload, total: of the chunk table's records that store nothing."""
    ends = table.filter("last").select("record", "page_id", F.col("digest").alias("payload"), F.col("size").alias("total"))
    equal = ends.filter(F.col("total") >= LEAST).groupBy("payload", "total").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keep is not null").drop("n")
    return ends.join(equal, ["payload", "total"]).filter(~F.col("page_id").eqNullSafe(F.col("keep"))).select("record", "keep", "payload", "total")


def _identifier(collection: str, record: Column, number: Column | None = None) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(collection), record.cast("string"), *([number.cast("string")] if number is not None else [])).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, k, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def _headers(collection: str) -> Column:
    """A chunk's header lines, of the chunk table with keep, payload and total of revisits."""
    first, many, revisit = F.col("chunk_no") == 1, (F.col("chunk_no") > 1) | ~F.col("last"), F.col("keep").isNotNull()
    segment = many & ~revisit
    origin = _identifier(collection, F.col("record"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    return F.concat_ws(
        "\r\n",
        line("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, origin).otherwise(_identifier(collection, F.col("record"), F.col("chunk_no")))),
        F.lit(f"WARC-Date: {DATE}"),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, line("X-Payload-Length", F.col("total"))),
        F.when(revisit, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload"))),
        F.when(~revisit & F.col("last"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.sha1("body")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, line("X-Refers-To-Page", F.col("keep"))),
        F.when(segment, line("WARC-Segment-Number", F.col("chunk_no"))),
        F.when(segment, F.concat(F.lit("X-Digest-So-Far: sha1:"), F.col("digest"))),
        F.when(~first, line("WARC-Segment-Origin-ID", origin)),
        F.when(segment & F.col("last"), line("WARC-Segment-Total-Length", F.col("size"))),
        F.lit("Content-Type: text/html"),
        line("Content-Length", F.octet_length("body")),
    )


def write(pages: DataFrame, path: str, chunk: int = CHUNK, records: int = RECORDS, most_broadcast: int = MOST_BROADCAST) -> str:
    """Writes gzipped WARC files of at most ``records`` lines to ``path``; returns the collection's identifier."""
    spark, collection = pages.sparkSession, str(uuid.uuid4())
    mark = _mark(collection)
    table = written(chunks(pages, chunk), "warc-chunks")
    again = written(revisits(table), "warc-revisits")
    small = again.count() <= most_broadcast
    met = table.join(F.broadcast(again) if small else again, "record", "left").filter("keep is null or chunk_no = 1")
    if not small:  # a shuffle parts neighbours
        met = met.sortWithinPartitions("record", "chunk_no")
    met = met.withColumn("body", F.when(F.col("keep").isNotNull(), "").otherwise(F.col("body")))
    # the separator of lines is that of a header and its block, and of two records
    rows = met.select(F.explode(F.array(F.concat(F.lit(mark), _headers(collection)), "body")).alias("value"))
    about = "software: veredas\r\nformat: WARC File Format 1.1\r\n"
    info = f"{mark}WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{collection}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}"
    to = lambda df, mode: df.write.mode(mode).option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    to(spark.createDataFrame([([info, about],)], "v array<string>").select(F.explode("v").alias("value")).coalesce(1), "errorifexists")
    to(rows, "append")
    remove(table)
    remove(again)
    return collection


def _parsed(value: str) -> tuple[dict[str, str], bytes]:
    """A record's header fields and block, checked against its own length and digest."""
    head, _, rest = value.partition(END)
    fields = dict(line.partition(": ")[::2] for line in head.split("\r\n"))
    data = rest.encode("utf-8", "surrogatepass")
    known = fields.get("WARC-Block-Digest")
    if not data.endswith(b"\r\n\r\n") or len(data) - 4 != int(fields.get("Content-Length", -1)) or known and known != f"sha1:{hashlib.sha1(data[:-4]).hexdigest()}":
        raise ValueError(f"WARC record damaged: {fields.get('WARC-Record-ID')}")
    return fields, data[:-4]


def _lines(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return spark.read.option("lineSep", _mark(collection)).text(path).filter("value != ''")


NAMES = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "origin": "WARC-Segment-Origin-ID", "segment": "WARC-Segment-Number", "page_id": "X-Page-ID", "url": "WARC-Target-URI", "payload": "WARC-Payload-Digest", "refers_to": "X-Refers-To-Page"}


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [_parsed(v) for v in batch["value"]]
        yield pd.DataFrame([(*[f.get(n) for n in NAMES.values()], b.decode("utf-8", "surrogatepass")) for f, b in found if f["WARC-Type"] != "warcinfo"], columns=[*NAMES, "body"], dtype=object)


def records(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """The records of the archives, checked: their headers' fields as text, and their block."""
    return _lines(spark, path, collection).mapInPandas(_fields, ", ".join(f"{n} string" for n in [*NAMES, "body"]))


READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, parted string"


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a page. Between chunks only a digest's state is kept; ``parted`` names a record whose chunks aren't all here."""
    columns = [x.split()[0] for x in READ.split(", ")]
    open_, number, size, state = None, 0, 0, None
    for batch in batches:
        done = []
        part = lambda record, done=done: done.append((None, None, None, None, None, record))
        for value in batch["value"]:
            f, body = _parsed(value)
            kind, page = f["WARC-Type"], f.get("X-Page-ID") or None
            if kind == "warcinfo":
                continue
            if kind == "revisit":
                done.append((page, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], kind, f["X-Refers-To-Page"], None))
                continue
            record, segment = f.get("WARC-Segment-Origin-ID") or f["WARC-Record-ID"], int(f.get("WARC-Segment-Number", 1))
            if open_ and (record, segment) != (open_, number + 1):
                part(open_)
                open_ = None
            if open_ is None:
                if segment > 1:
                    part(record)
                    continue
                open_, number, size, state = record, 0, 0, hashlib.sha1()
            state.update(body)
            number, size = number + 1, size + len(body)
            told, last = f.get("X-Digest-So-Far"), f.get("WARC-Payload-Digest")
            if told and told[5:] != state.hexdigest() or last and last[5:] != state.hexdigest() or int(f.get("WARC-Segment-Total-Length", size)) != size:
                raise ValueError(f"WARC payload damaged: record {record}, chunk {segment}")
            if last:
                done.append((page, size, state.hexdigest(), "response", None, None))
                open_ = None
        yield pd.DataFrame(done, columns=columns).astype({"payload_bytes": "Int64"})
    if open_:
        yield pd.DataFrame([(None, None, None, None, None, open_)], columns=columns).astype({"payload_bytes": "Int64"})


def read(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives; ids are text."""
    lines = _lines(spark, path, collection)
    told = written(lines.mapInPandas(_streamed, READ), "warc-read")
    whole = told.filter("parted is null").drop("parted")
    parted = told.filter("parted is not null").select("parted").distinct()  # at most two records a file
    if parted.isEmpty():
        return whole
    field = lambda name: F.regexp_extract(F.concat(F.lit("\r\n"), F.substring_index("value", END, 1), F.lit("\r\n")), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    named = lines.select("value", F.coalesce(F.nullif(field("WARC-Segment-Origin-ID"), F.lit("")), field("WARC-Record-ID")).alias("parted"), F.coalesce(F.nullif(field("WARC-Segment-Number"), F.lit("")), F.lit("1")).cast("int").alias("segment"))
    # broadcast, so that the shuffle by record is repartition's own: a join's, Spark may read by mapper once it knows that one side is small, and then a record's chunks are apart
    met = named.join(F.broadcast(parted), "parted", "left_semi").repartition("parted").sortWithinPartitions("parted", "segment").select("value").mapInPandas(_streamed, READ)
    lost = F.raise_error(F.concat(F.lit("WARC record without all its chunks: "), F.col("parted")))
    return whole.unionAll(met.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("parted").isNull(), F.col("record_type")).otherwise(lost).alias("record_type"), "refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The pages written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or scratch_path(pages.sparkSession, "warc")
    found = read(pages.sparkSession, path, write(pages, path, chunk))
    kind = dict(pick(pages, "page_id").dtypes)["page_id"]
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
