"""WARC archives as a Spark data source, written and read in Python.

Reading plans partitions of whole files of about equal bytes, parses a record's headers
first, tests the pushed filters on them, and steps over the payload of records that fail or
whose payload is not asked for. ``.gz`` files hold one gzip member per record.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from cohortlens.llm.arrow import _located, list_files, ship

#: Bytes of files in one reading task, and of one written file, about.
PARTITION_BYTES = 64 << 20
FILE_BYTES = 256 << 20
#: Records in a batch that a reading task returns, and bytes of payload.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, content_type string, "
    "content_length long, payload_digest string, payload_length long, refers_to string, "
    "headers map<string,string>, path string, offset long, payload binary"
)
_HEADER = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "warc_date": "warc-date", "content_type": "content-type", "content_length": "content-length",
    "payload_digest": "warc-payload-digest", "payload_length": "warc-payload-length", "refers_to": "warc-refers-to",
}
_NUMBERS = ("content_length", "payload_length")
_TYPES = {"content_length": pa.int64(), "payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary(),
          "headers": pa.map_(pa.string(), pa.string())}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, IsNotNull: lambda x, v: True,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
}


def header_value(headers: dict[str, str], column: str):
    value = headers.get(_HEADER[column])
    return int(value) if value is not None and column in _NUMBERS else value


def passes(headers: dict[str, str], filters: list[Filter]) -> bool:
    """Whether a record's headers pass all filters; an absent header passes none."""
    for f in filters:
        value = header_value(headers, f.attribute[0])
        if value is None or not _TESTS[type(f)](value, getattr(f, "value", None)):
            return False
    return True


def records(stream, filters: list[Filter], with_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Offset, headers (lower-case names) and payload of the records that pass.

    ``stream`` needs ``readline``, ``read``, ``seek`` and ``tell``. The payload of an HTTP
    record is what follows the HTTP headers, of other records the whole block.
    """
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size, start = int(headers.get("content-length", 0)), stream.tell()
        if not passes(headers, filters):
            stream.seek(start + size)
            continue
        payload = None
        if with_payload:
            block = stream.read(size)
            if len(block) < size:
                raise ValueError(f"the record at byte {offset} is cut off")
            payload = block
            if headers.get("content-type", "").startswith("application/http"):
                payload = block.partition(b"\r\n\r\n")[2]
        else:
            stream.seek(start + size)
        yield offset, headers, payload


@dataclass
class _Files(InputPartition):
    files: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder = options["path"]
        self.columns = [f.name for f in schema.fields]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _HEADER:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, packed until a partition has enough bytes."""
        out, size = [_Files()], 0
        for path, n in list_files(self.folder):
            if "/_" in path[len(self.folder) :] or not path.endswith((".warc", ".warc.gz")):
                continue
            if out[-1].files and size + n > self.bytes:
                out.append(_Files())
                size = 0
            out[-1].files.append(path)
            size += n
        return out

    def _batch(self, rows: list) -> pa.RecordBatch:
        columns = []
        for c in self.columns:
            if c in _HEADER:
                values = [header_value(h, c) for _, _, h, _ in rows]
            else:
                k = {"path": 0, "offset": 1, "headers": 2, "payload": 3}[c]
                values = [list(r[2].items()) if k == 2 else r[k] for r in rows]
            columns.append(pa.array(values, _TYPES.get(c, pa.string())))
        return pa.RecordBatch.from_arrays(columns, self.columns)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.files:
            system, at = _located(path)
            with system.open_input_file(at) as raw:
                plain = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                stream = io.BufferedReader(plain, 1 << 16)
                for offset, headers, payload in records(stream, self.filters, "payload" in self.columns):
                    rows.append((path, offset, headers, payload))
                    size += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def record_bytes(row: dict) -> bytes:
    """One record: a response as an HTTP message, a revisit as its headers alone."""
    payload = row.get("payload") or b""
    block = _HTTP % len(payload) + (payload if row["record_type"] == "response" else b"")
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row.get("record_id")),
        ("WARC-Date", row.get("warc_date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", row.get("payload_digest")),
        ("WARC-Payload-Length", len(payload)), ("WARC-Refers-To", row.get("refers_to")),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    head = "".join(
        f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}\r\n" for k, v in fields if v is not None
    )
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.gzip = options.get("compression", "none") == "gzip"
        self.bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """Records of a task in files of about ``file_bytes``, under names of this attempt."""
        system, root = _located(self.folder)
        system.create_dir(f"{root}/_attempts", recursive=True)
        files, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= self.bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                    out, size = system.open_output_stream(f"{root}/_attempts/{files[-1]}", compression=None), 0
                data = record_bytes(row)
                size += out.write(gzip.compress(data, 6) if self.gzip else data) or len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        """Only files of attempts that count become visible."""
        system, root = _located(self.folder)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{root}/_attempts/{name}", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        system, root = _located(self.folder)
        for message in messages:
            for name in message.files if message else []:
                system.delete_file(f"{root}/_attempts/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to; choose a new folder to write anew")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known and let filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archived(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
             least_bytes: int = 100) -> DataFrame:
    """WARC records of pages: equal payloads of ``least_bytes`` or more are stored once.

    The page with the smallest id of a payload is the response, the others revisit it;
    smaller payloads are all responses. A null payload is empty. Rows that share the
    smallest id are all responses, and so are rows without an id whose payload has no page
    with one. Other columns are ignored; an empty table gives no records.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url).alias("target_uri"),
        F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    sums = rows.where(F.length("payload") >= least_bytes).select("id", "digest")
    first = sums.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(first.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.select(
        record_id("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, record_id("first")).alias("refers_to"), "payload",
    )


def record_id(column: str):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def page_id(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, sizes
    and digests of responses taken from the payloads themselves."""
    def load(kind: str, *columns: str) -> DataFrame:
        wanted = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in columns)
        return spark.read.format("warc").schema(wanted).load(folder).where(F.col("record_type") == kind)

    responses = load("response", "record_id", "record_type", "payload").select(
        page_id("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = load("revisit", "record_id", "record_type", "payload_digest", "payload_length", "refers_to").select(
        page_id("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type",
        page_id("refers_to").alias("refers_to"),
    )
    return responses.union(revisits)
