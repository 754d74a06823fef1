"""Web archives (WARC 1.1) as chunked record tables.

A record is rows of (record_id, chunk_no): a payload of any size passes through in pieces of CHUNK bytes, and each row
carries the length and SHA-1 digest of the payload up to its end, so the last row has those of the whole. Writing streams the
pieces of a record into an archive, reading streams them out; neither holds a payload, whatever its size.

Tasks write archives to the folder that driver and executors share, under names of their own, and return a row per
finished file. Only files with a row count, so lost or repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir
from .common import kind_of, written

#: Bytes of a chunk, and of an archive file after which the next one is begun.
CHUNK, FILE_BYTES = 256 << 10, 512 << 20
#: Payloads of fewer bytes are always stored.
LEAST = 1000
#: Rows and bytes handed to Spark at once.
_ROWS, _BYTES = 512, 4 << 20
#: Longest header line and most lines of a head that are read.
_LINE, _LINES = 1 << 16, 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def record_uuid(page_id: Column, digest: Column) -> Column:
    """A record's name, the same whenever it is computed."""
    x = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), digest).cast("binary"))
    parts = [F.substring(x, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def records_of(pages: DataFrame) -> DataFrame:
    """Chunks of a record for each row of pages (page_id, url, html): record_id, page_id, uri, record_type, refers_to (a record
    id), payload_bytes, payload_digest, chunk_no, last, data. Chunks of one record follow each other.

    The payload is html in UTF-8, null: empty. Of records with equal payloads of LEAST bytes or more that with the largest
    page_id is the response and holds it; the others are revisits. Rows that share that page_id are all responses; a
    null page_id is never the largest, and without any other all rows are responses. Only (page_id, digest) is grouped.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    equal = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    equal = written(equal.where("n > 1 and top is not null").drop("n"), "equal-payloads")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.when(revisit, 0).otherwise(F.col("payload_bytes")) / CHUNK) - 1).cast("int"))
    # all pieces are cut before they become rows, as each row would carry the whole payload otherwise
    pieces = F.transform(starts, lambda k: F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", k * CHUNK + 1, F.lit(CHUNK))))
    out = rows.join(equal, ["payload_digest", "payload_bytes"], "left").withColumns({
        "record_id": record_uuid(F.col("page_id"), F.col("payload_digest")), "record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, record_uuid(F.col("top"), F.col("payload_digest"))), "pieces": pieces,
    })
    columns = ["record_id", F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("uri"), "record_type", "refers_to", "payload_bytes", "payload_digest"]
    out = out.select(*columns, F.size("pieces").alias("chunks"), F.posexplode("pieces").alias("chunk_no", "data"))
    return out.withColumn("last", F.col("chunk_no") == F.col("chunks") - 1).drop("chunks")


def _head(row: dict, date: str) -> bytes:
    """The WARC and HTTP heads of a record. Values are percent-encoded, so that none can end its line."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    size = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    uri = quote(row["uri"], safe=":/?#[]@!$&'()*+,;=%-._~", errors="replace") if row["uri"] else row["record_id"]
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()),
        *([("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", _PROFILE)] if row["record_type"] == "revisit" else []),
        *([("Page-Id", quote(row["page_id"], safe=""))] if row["page_id"] is not None else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(size)),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + http


def write_archives(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes chunks (as of records_of) as .warc.gz files, each record a gzip member of its own: (path, n_records, n_bytes).

    A payload's digest is followed while it streams and has to be the announced one.
    """

    def write(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out = path = packer = running = None
        n = held = 0

        def put(data: bytes) -> None:
            nonlocal held
            out.write(data)
            held += len(data)

        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if row["chunk_no"] == 0:
                    if out is None:
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        path, n, held = f"{folder}/{name}", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    packer, running = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    put(packer.compress(_head(row, date)))
                running.update(row["data"])
                put(packer.compress(row["data"]))
                if row["last"]:
                    if row["record_type"] == "response" and running.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"{row['record_id']}: the payload isn't what was announced")
                    put(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
                    if held >= file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [held]})
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [held]})

    return written(records.mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


class _Stream:
    """Bytes of an archive in order, unpacked member by member if they are packed; holds about CHUNK of them."""

    def __init__(self, source, name: str):
        self.source, self.name, self.rest, self.unpacker, self.held, self.at, self.packed = source, name, b"", None, b"", 0, None

    def _more(self) -> bool:
        raw = self.rest or self.source.read(CHUNK)
        self.rest = b""
        if self.packed is None:
            self.packed = raw[:2] == b"\x1f\x8b"
        if not raw:
            if self.unpacker:
                raise ValueError(f"{self.name}: the archive ends within a record")
            return False
        self.held, self.at = self.held[self.at :], 0
        if not self.packed:
            self.held += raw
            return True
        self.unpacker = self.unpacker or zlib.decompressobj(31)
        self.held += self.unpacker.decompress(raw, CHUNK)
        self.rest = self.unpacker.unconsumed_tail
        if self.unpacker.eof:
            self.rest, self.unpacker = self.unpacker.unused_data, None
        return True

    def line(self) -> bytes | None:
        """Up to the next line end, without it; none at the end."""
        while (to := self.held.find(b"\n", self.at)) < 0:
            if len(self.held) - self.at > _LINE:
                raise ValueError(f"{self.name}: a header line is too long")
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError(f"{self.name}: the archive ends within a record")
                return None
        out, self.at = self.held[self.at : to], to + 1
        return out.removesuffix(b"\r")

    def take(self, most: int) -> bytes:
        """At least one byte, unless none is left, and no more than asked for."""
        while self.at == len(self.held):
            if not self._more():
                return b""
        out = self.held[self.at : self.at + most]
        self.at += len(out)
        return out

    def fields(self) -> tuple[dict[str, str], int]:
        """Names, in lower case, and values up to the next empty line; the bytes that this took."""
        out, size = {}, 0
        for _ in range(_LINES):
            line = self.line()
            if line is None:
                raise ValueError(f"{self.name}: the archive ends within a record")
            size += len(line) + 2
            if not line:
                return out, size
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        raise ValueError(f"{self.name}: a record has too many header lines")


def _digest(value: str | None) -> str | None:
    """A declared SHA-1 digest as hexadecimal, from base 32 or 16; none for other kinds."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return base64.b32decode(text).hex() if len(text) == 32 else bytes.fromhex(text).hex()
    except ValueError:
        return None


def _records(stream: _Stream):
    """Rows of all chunks of an archive, record by record."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{stream.name}: {line[:40]!r} stands where a record should begin")
        head, _ = stream.fields()
        left = int(head.get("content-length", "0"))
        base = {
            "record_id": head.get("warc-record-id", "").strip("<>"), "page_id": unquote(head["page-id"]) if "page-id" in head else None, "uri": head.get("warc-target-uri"), "record_type": head.get("warc-type"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "declared_digest": _digest(head.get("warc-payload-digest")),
        }
        if left and head.get("content-type", "").startswith("application/http"):
            status = stream.line()
            _, size = stream.fields()
            left -= len(status or b"") + 2 + size
        running, seen, k = hashlib.sha1(), 0, 0
        while True:
            data = bytearray()
            while left > 0 and len(data) < CHUNK:
                part = stream.take(min(left, CHUNK - len(data)))
                if not part:
                    raise ValueError(f"{stream.name}: the archive ends within a record")
                data += part
                left -= len(part)
            running.update(data)
            seen += len(data)
            yield base | {"chunk_no": k, "last": left <= 0, "n_bytes": seen, "digest": running.copy().hexdigest(), "data": bytes(data)}
            k += 1
            if left <= 0:
                break


_CHUNKS = "record_id string, page_id string, uri string, record_type string, refers_to string, declared_digest string, chunk_no int, last boolean, n_bytes long, digest string, data binary"


def read_archives(files: DataFrame) -> DataFrame:
    """The chunk table of archives, packed or plain, at files (path): record_id, page_id, uri, record_type, refers_to,
    declared_digest, chunk_no, last, n_bytes, digest (both of the payload up to and with this chunk), data.

    A payload is the body of an HTTP response, else the whole block. Every record has a chunk at least, though an
    empty one. Each file goes to one task. Files that end within a record or don't begin with one are an error that names them.
    """

    def read(batches):
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as source:
                    rows, size = [], 0
                    for row in _records(_Stream(source, path)):
                        rows.append(row)
                        size += len(row["data"])
                        if len(rows) >= _ROWS or size >= _BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    paths = files.select("path")
    return paths.repartitionByRange(max(1, min(paths.count(), 20_000)), "path").mapInArrow(read, _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row per record: what its last chunk says of the whole payload."""
    last = chunks.where("last").select("record_id", "page_id", "uri", "record_type", "refers_to", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "declared_digest")
    return written(last, "records")


def resolved(records: DataFrame, kind: str = "long") -> DataFrame:
    """Per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), uri.

    A revisit gets the length and digest of the payload that it refers to; if that record isn't there, only the
    digest that it declares. kind: the type of page_id.
    """
    rows = records.where("record_type in ('response', 'revisit')").withColumn("page_id", F.col("page_id").cast(kind))
    wanted = rows.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    found = rows.where("record_type = 'response'").join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to"))
    found = written(found.agg(*[F.max(c).alias(f"of_{c}") for c in ("page_id", "payload_bytes", "payload_digest")]), "referred-records")
    again = rows.where("record_type = 'revisit'").join(found, "refers_to", "left")
    again = again.select("page_id", F.col("of_payload_bytes").alias("payload_bytes"), F.coalesce("of_payload_digest", "declared_digest").alias("payload_digest"), "record_type", F.col("of_page_id").alias("refers_to"), "uri")
    return rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"), "uri").unionByName(again)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as archives and reads them back; resolved() of what is there."""
    return resolved(records(read_archives(write_archives(records_of(pages), folder))), kind_of(pages, "page_id"))
