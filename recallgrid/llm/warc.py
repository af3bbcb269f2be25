"""WARC archives as a PySpark data source.

``register(spark)`` gives the format "warc". The reader plans one partition per archive file and parses each record's
header block first. Equality and membership filters on header columns, the record type among them, are pushed down and
decide before a payload is touched; payloads of records that fail them, and all payloads if the read schema leaves the
column out, are skipped by a seek, or in compressed archives read over. The writer makes files of a bounded size, which
appear when the job commits.

The writer's archives hold uncompressed records (WARC/1.1): a response is an HTTP header and the payload, a revisit the
HTTP header alone. ``.warc`` and ``.warc.gz`` files are read; a file is never split. Paths are those that pyarrow's file
systems reach, plain or as a URI.

Archives of other programs: ``payload_bytes`` of a response is the length behind its HTTP header, which takes reading the
block if that column is asked for; of a revisit that doesn't say it is null. A block of a response without an end of the
HTTP header has no payload. Header lines must end in CRLF, as the standard says. A record whose headers don't end, or lack
a whole number as Content-Length, and a block that is cut off, are a ValueError with the file and the byte: what follows
such a record can't be told, so nothing is dropped in silence. A block that is skipped isn't looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from recallgrid.llm.common import BROADCAST_ROWS
from recallgrid.session import shared_folder
from recallgrid.tables import discard, written

HEADER_SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long"
SCHEMA = HEADER_SCHEMA + ", payload binary"
#: Bytes after which the writer starts another file, which is also the unit of reading.
FILE_BYTES = 1 << 26
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Fixed value: the profile of a record whose payload another record holds.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def http_head(row: dict) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()


def head(row: dict, length: int, now: datetime) -> bytes:
    """The header block of a record whose block has ``length`` bytes; line breaks in values become spaces.

    A response is named after its page, so that revisits can refer to it; a record without a page, and a revisit, to
    which nothing refers, has a random name.
    """
    named = "<urn:page:{}>".format
    revisit = row["record_type"] == "revisit"
    lines = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{uuid.uuid4().urn}>" if revisit or row["page_id"] is None else named(row["page_id"]),
        "WARC-Date": now.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": None if row["refers_to"] is None else named(row["refers_to"]),
        "X-Page-ID": row["page_id"],
        "X-Payload-Length": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": length,
    }
    text = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in lines.items() if v is not None)
    return f"WARC/1.1\r\n{text}\r\n".encode("utf-8", "surrogatepass")


def parsed(raw: bytes) -> tuple[dict, int, bool]:
    """Column values of a header block, the length of the record's block, and whether that starts with an HTTP header.

    ``payload_bytes`` is null where the headers don't tell it.
    """
    lines = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    h = {name.lower(): value.strip() for name, colon, value in lines if colon}
    number = lambda x: int(x) if x and re.fullmatch(r"-?\d+", x) else None
    page = lambda x: number(x[10:-1]) if x and x.startswith("<urn:page:") else None
    length = number(h.get("content-length"))
    if length is None or length < 0:
        raise ValueError(f"a record without a length: {h.get('content-length')!r}")
    http = h.get("content-type", "").startswith("application/http")
    own, size = number(h.get("x-page-id")), number(h.get("x-payload-length"))
    values = {
        "page_id": page(h.get("warc-record-id")) if own is None else own,
        "record_type": h.get("warc-type"),
        "target_uri": h.get("warc-target-uri"),
        "payload_digest": h["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in h else None,
        "payload_bytes": length if size is None and not http and h.get("warc-type") != "revisit" else size,
        "refers_to": page(h.get("warc-refers-to")),
    }
    return values, length, http


def payload(block: bytes, http: bool) -> bytes:
    """What stands behind the HTTP header of a block, if it has one."""
    return block.partition(b"\r\n\r\n")[2] if http else block


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema.names, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, names: list[str], path: str) -> None:
        self.names, self.path = names, path
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.wanted.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        store, path = file_system(self.path)
        root = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return [Archive(root + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there is no file
            return
        store, path = file_system(partition.path)
        with store.open_input_stream(path, compression="gzip") if path.endswith(".gz") else store.open_input_file(path) as f:
            try:
                yield from self._rows(f)
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from e

    def _rows(self, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        early = [(c, ok) for c, ok in self.wanted if c != "payload_bytes"]
        sized = "payload_bytes" in self.names or len(early) < len(self.wanted)
        for values, http, block in records(f):
            if not all(values[c] in ok for c, ok in early):
                continue
            revisit = values["record_type"] == "revisit"
            if sized and values["payload_bytes"] is None and not revisit:
                values["payload_bytes"] = len(payload(block(), http))
            if all(values[c] in ok for c, ok in self.wanted):
                if "payload" in self.names:
                    values["payload"] = None if revisit else payload(block(), http)
                    held += len(values["payload"] or b"")
                rows.append(values)
            if len(rows) >= 4096 or held > 1 << 24:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], KINDS.get(c, pa.string())) for c in self.names], self.names)


def records(f: pa.NativeFile) -> Iterator[tuple[dict, bool, Callable[[], bytes]]]:
    """(header values, whether the block has an HTTP header, a reader of the block) of each record of an open archive.

    Reads headers alone, but for the blocks that are asked for before the next record.
    """
    seekable, at, ahead = f.seekable(), 0, b""  # ahead: bytes that were read from ``at`` on
    while True:
        while (stop := ahead.find(b"\r\n\r\n")) < 0:
            if not (more := f.read(1024)):
                if ahead.strip():
                    raise ValueError(f"a record without an end of headers at byte {at}")
                return
            ahead += more
        try:
            values, length, http = parsed(ahead[:stop].lstrip())
        except ValueError as e:
            raise ValueError(f"{e} at byte {at}") from e
        at, ahead = at + stop + 4, ahead[stop + 4 :]
        held: list[bytes] = []

        def block(length: int = length, ahead: bytes = ahead, held: list[bytes] = held, at: int = at) -> bytes:
            if not held:
                held.append(ahead[:length] + f.read(max(0, length - len(ahead))))
                if len(held[0]) < length:
                    raise ValueError(f"a block of {length} bytes that is cut off, at byte {at}")
            return held[0]

        yield values, http, block
        rest = length + 4  # the block and two line ends
        if not held and seekable and rest > len(ahead):
            f.seek(at + rest)
            ahead = b""
        else:
            left = max(0, length - len(ahead)) if not held else 0
            while left:
                left -= len(f.read(min(left, 1 << 20))) or left
            ahead = ahead[length:]
            while len(ahead) < 4 and (more := f.read(4 - len(ahead))):
                ahead += more
            ahead = ahead[4:]
        at += rest


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under a name that readers pass over; the commit renames the files of the attempts that succeeded."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        files: list[str] = []
        out, size, now = None, 0, datetime.now(timezone.utc)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{path}/{uuid.uuid4().hex}.warc.part")
                    out, size = store.open_output_stream(files[-1]), 0
                http, body = http_head(row), row["payload"] or b""
                for part in (head(row, len(http) + len(body), now), http, body, b"\r\n\r\n"):
                    out.write(part)
                    size += len(part)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = file_system(self.path)
        if self.overwrite and store.get_file_info(path).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.path.endswith(".warc"):
                    store.delete_file(f.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(name, name.removesuffix(".part"))

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = file_system(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.delete_file(name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archived(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> None:
    """Writes one record per row of ``pages`` to archives under ``path``.

    The payload is the UTF-8 html; null is empty. Of rows with equal payloads of at least ``least`` bytes, that with the
    smallest id is a response and the others are revisits that refer to it and hold no payload; rows that share that
    id, and rows with a null id, are responses (those that share an id share a record's name). White space in a URL,
    line breaks too, becomes single spaces. Other columns are ignored; an empty table writes no record.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= least).select("payload_digest", "page_id")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    again = repeated = written(large.join(first, "payload_digest").where("page_id > refers_to").distinct())
    if again.count() <= BROADCAST_ROWS:  # else Spark shuffles both sides
        again = F.broadcast(again)
    rows = rows.join(again, ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    rows = rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "payload": F.when(~revisit, F.col("payload"))})
    rows.select("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload").write.format("warc").mode("append").save(path)
    discard(repeated)


def report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives of ``pages``, read back.

    Length and digest of responses are those of the payloads that are read; revisits, which have none, are read by their
    headers, and payloads of the others are skipped for them: the record type is pushed down.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    archived(pages, path)
    back = spark.read.format("warc").load(path)
    body = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = back.where("record_type = 'response'").withColumns(body).select(*names)
    headers = spark.read.format("warc").schema(HEADER_SCHEMA).load(path)
    return whole.unionByName(headers.where("record_type = 'revisit'").select(*names))
