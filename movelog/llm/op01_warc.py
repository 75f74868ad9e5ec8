"""WARC archives as a PySpark data source, and pages to archives and back.

Reading: one input partition is a bundle of files. Predicates on header fields are pushed into the
reader, which inflates a record's headers first and passes over the rest of an unwanted record by
the length its gzip member states; only the columns of the read schema are decoded, so payloads
stay untouched unless they are asked for. Writing: each task writes its own file, one gzip member a
record; the commit lists the files of the tasks that succeeded, so a lost executor's file is never
read. Paths go through pyarrow's file systems.

Defined results for pages: a null html is an empty payload, and empty payloads are equal; among
equal payloads every row with the largest page_id is a response; null urls are written as an empty
target; rows with a null page_id are written under an empty id and come back with a null one;
repeated rows give one record each; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialise, shared_dir, table

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, computed_digest string, payload binary"
#: Column -> header, for the columns that are a header's text.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_MANIFEST.json"
BUNDLE_BYTES = 64 << 20
HEAD_BYTES = 2048


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Bundle(InputPartition):
    files: list[str]


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder), and df.write.format("warc").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.names
        self.types = [{"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string()) for f in schema.fields]
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes predicates on header columns; hands the others back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = HEADERS.get(column)
            if header and isinstance(f, EqualTo):
                self.equal.append((header, frozenset([f.value])))
            elif header and isinstance(f, In):
                self.equal.append((header, frozenset(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.prefix.append((header, f.value))
            elif header and isinstance(f, IsNotNull):
                self.present.append(header)
            else:
                yield f

    def partitions(self) -> list[Bundle]:
        store, root = opened(self.path)
        infos = {os.path.basename(i.path): i for i in store.get_file_info(fs.FileSelector(root, recursive=False)) if i.is_file}
        if MANIFEST in infos:
            with store.open_input_stream(infos[MANIFEST].path) as f:
                names = json.loads(f.read())
        else:
            names = sorted(n for n in infos if n.endswith((".warc", ".warc.gz")))
        out, held = [], BUNDLE_BYTES + 1
        for name in names:
            if held + infos[name].size > BUNDLE_BYTES:
                out.append(Bundle([]))
                held = 0
            out[-1].files.append(infos[name].path)
            held += infos[name].size
        return out or [Bundle([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(h) in values for h, values in self.equal) and all((headers.get(h) or "").startswith(p) for h, p in self.prefix) and all(h in headers for h in self.present)

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        need_block = bool({"payload", "computed_digest", "payload_bytes"} & set(self.columns))
        rows: list[list] = []
        size = 0
        for name in partition.files:
            with store.open_input_file(name) as raw:
                file = io.BufferedReader(raw, 1 << 20)
                for headers, block in records(file, name.endswith(".gz"), self.wanted):
                    rows.append(self.row(headers, block() if need_block else b""))
                    size += len(rows[-1][-1] or b"") if "payload" in self.columns else 100
                    if size > 8 << 20:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def row(self, headers: dict[str, str], block: bytes) -> list:
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not headers.get("content-type", "").startswith("application/http"):
            head, payload = b"", block
        length = len(payload)
        if headers.get("warc-type") == "revisit":  # its block is the HTTP head of the response it stands for
            length = next((int(line[15:]) for line in head.split(b"\r\n") if line[:15].lower() == b"content-length:"), 0)
        out = []
        for column in self.columns:
            if column in HEADERS:
                out.append(headers.get(HEADERS[column]))
            elif column == "payload_bytes":
                out.append(length)
            elif column == "computed_digest":
                out.append(None if headers.get("warc-type") == "revisit" else digest(payload))
            else:
                out.append(payload if column == "payload" else None)
        return out

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), self.types, strict=True)], names=self.columns)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def records(file: io.BufferedReader, zipped: bool, wanted) -> Iterator[tuple[dict[str, str], object]]:
    """(headers, function that returns the block) of the records whose headers are wanted."""
    while True:
        if zipped:
            start = file.tell()
            fixed = file.read(10)
            if len(fixed) < 10:
                return
            skip = None
            if fixed[3] & 4:
                extra = file.read(struct.unpack("<H", file.read(2))[0])
                if extra[:2] == b"sl":  # compressed and full length of the member, as the WARC standard proposes
                    skip = start + struct.unpack("<I", extra[4:8])[0]
            for flag in (8, 16):
                if fixed[3] & flag:
                    while file.read(1) not in (b"\0", b""):
                        pass
            inflate = zlib.decompressobj(-15)
            text = b""
            while b"\r\n\r\n" not in text and not inflate.eof and (piece := inflate.unconsumed_tail or file.read(HEAD_BYTES)):
                text += inflate.decompress(piece, HEAD_BYTES)
        else:
            text = b""
            while (line := file.readline()) in (b"\r\n", b"\n"):
                pass
            while line.strip():
                text += line
                line = file.readline()
            if not text:
                return
            text += b"\r\n"
        head, _, rest = text.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        length = int(headers.get("content-length") or 0)
        if not zipped:
            at = file.tell()
            if wanted(headers):
                yield headers, lambda n=length: file.read(n)
            file.seek(at + length)
            continue
        if wanted(headers):

            def block(rest: bytes = rest, inflate=inflate, length: int = length) -> bytes:
                parts, have = [rest], len(rest)
                while have < length and not inflate.eof and (piece := inflate.unconsumed_tail or file.read(1 << 16)):
                    parts.append(inflate.decompress(piece))
                    have += len(parts[-1])
                return b"".join(parts)[:length]

            yield headers, block
        if skip is None:  # an archive of another writer: the member's end shows only by inflating it
            while not inflate.eof and (piece := inflate.unconsumed_tail or file.read(1 << 16)):
                inflate.decompress(piece, 1 << 16)
            skip = file.tell() - len(inflate.unused_data) + 8
        file.seek(skip)


def member(record: bytes) -> bytes:
    """One gzip member, with its lengths in an extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def warc_record(record_type: str, record_id: str, uri: str, date: str, payload_digest: str, refers_to: str | None, payload: bytes, payload_bytes: int) -> bytes:
    clean = lambda s: (s or "").replace("\r", "%0D").replace("\n", "%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean(uri)}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_type, record_id, target_uri, warc_date, payload_digest, refers_to, payload, payload_bytes."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("record_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to", "payload", "payload_bytes")]
                for row in zip(*columns, strict=True):
                    out.write(member(warc_record(*row)))
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(m.file for m in messages if m and m.records)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.file}")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 digits of base 32."""
    code = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """The records of an archive of pages: of equal payloads of least_bytes at least, the largest id responds."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Partial sums meet the hot payloads before the shuffle. They are written before they are joined, as
    # Spark splits a hot payload only in a join of two exchanges.
    keepers = materialise(rows.groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "warc-keepers")
    joined = rows.join(keepers, "payload_digest", "left")
    revisit = F.coalesce((F.col("keeper") != F.coalesce(F.col("page_id"), F.col("keeper") - 1)) & (F.col("payload_bytes") >= least_bytes), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id")).alias("record_id"),
        F.coalesce(F.col("target_uri"), F.lit("")).alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        "payload_digest",
        F.when(revisit, name(F.col("keeper"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
    )


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """columns: the schema to read, a part of SCHEMA; payloads are decoded only if it names them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(columns).load(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages of an archive."""
    found = read_warc(spark, path, "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, computed_digest string")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    stated = F.expr("substring(payload_digest, 6)")
    return found.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce("computed_digest", stated).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    return archived_pages(spark, path)


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, sha1(payload) AS code, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes FROM p),
d AS (SELECT page_id, target_uri, payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(code, CAST(5*i+1 AS INT), 5))::BIGINT >> (15 - 5*j)) & 31 AS INT) + 1, 1), '' ORDER BY i, j)
   FROM range(8) a(i), range(4) b(j)) AS payload_digest FROM h),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, target_uri FROM k""",
}
