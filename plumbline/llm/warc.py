"""WARC archives: written with one gzip member per record, read back sequentially.

Tasks write archives to the shared folder through pyarrow's file systems (file, hdfs, s3, gs), first under the name of
the attempt and then, whole, under the final name, so a repeated task replaces its archive. The reader takes one archive
at a time as a stream of chunks: it inflates member by member, reads a record's headers, then exactly as many bytes as
Content-Length says, and verifies block and payload digests. It never holds more than a chunk and one record's payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shared_folder, ship, text_of

LEAST = 100  # bytes from which equal payloads are stored once
CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # records of one table carry one date, so that reruns write equal archives


class WarcError(ValueError):
    """An archive that breaks the format or fails a digest."""


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = hashlib.sha256(payload).hexdigest()
    if not revisit:
        block += payload
    uri = "".join(c if "\x20" < c and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        part, stream, final, done = 0, None, "", []
        count = size = 0

        def finish() -> None:
            stream.close()
            store.move(f"{final}.{task.taskAttemptId()}", final)
            done.append((final, count, size))

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    final = f"{root}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
                    stream, part, count, size = store.open_output_stream(f"{final}.{task.taskAttemptId()}", compression=None), part + 1, 0, 0
                data = record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["refers_to"], row["revisit"])
                stream.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    finish()
                    stream = None
        if stream is not None:
            finish()
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"]
        )

    return run


class Members:
    """The gzip members of a stream, each read as a file of its own."""

    def __init__(self, stream):
        self.stream, self.raw, self.inflate, self.ready = stream, b"", None, b""

    def begin(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def some(self) -> bytes:
        """The next bytes of the member, at most a chunk; none at its end."""
        while not self.ready and not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise WarcError("an archive ends inside a record")
            try:
                self.ready = self.inflate.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"a damaged gzip member: {e}") from e
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        out, self.ready = self.ready, b""
        return out

    def until(self, mark: bytes, held: bytes = b"") -> tuple[bytes, bytes]:
        """Everything before a mark, and what was read behind it."""
        while mark not in held:
            more = self.some()
            if not more:
                raise WarcError("a record ends inside its headers")
            held += more
        before, _, behind = held.partition(mark)
        return before, behind


def read_records(stream) -> Iterator[dict]:
    """The records of an archive in order, digests verified."""
    members = Members(stream)
    while members.begin():
        head, held = members.until(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if version.encode() != VERSION:
            raise WarcError(f"unknown version {version!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        left, block, body = int(headers["Content-Length"]), hashlib.sha256(), hashlib.sha256()
        http, payload, pieces = b"", None, []
        while left:
            piece = held or members.some()
            if not piece:
                raise WarcError("a record is shorter than its Content-Length")
            piece, held = piece[:left], piece[left:]
            left -= len(piece)
            block.update(piece)
            if payload is None:
                http += piece
                if b"\r\n\r\n" in http:
                    http, _, piece = http.partition(b"\r\n\r\n")
                    payload = piece
                else:
                    continue
            body.update(piece)
            pieces.append(piece)
        while len(held) < 4:
            more = members.some()
            if not more:
                break
            held += more
        if held != b"\r\n\r\n" or members.some():
            raise WarcError("a record is longer than its Content-Length")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = headers["WARC-Type"] == "revisit"
        if block.hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
            raise WarcError(f"block digest of {headers['WARC-Record-ID']} differs")
        payload = b"".join(pieces)
        if not revisit and (body.hexdigest() != digest or len(payload) != length):
            raise WarcError(f"payload digest of {headers['WARC-Record-ID']} differs")
        yield {
            "page_id": _page(headers["WARC-Record-ID"]),
            "url": headers["WARC-Target-URI"],
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": headers["WARC-Type"],
            "refers_to": _page(headers.get("WARC-Refers-To")),
            "payload": None if revisit else payload,
        }


_FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
}


def _reader(folder: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([(f, _FIELDS[f]) for f in fields])

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], _FIELDS[f]) for f in fields], schema=schema)

        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in read_records(stream):
                        rows.append(row)
                        held += 200 + (len(row["payload"] or b"") if "payload" in fields else 0)
                        if held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page to ``folder``; the archives with their records and bytes.

    Of pages with equal payloads of at least LEAST bytes the one with the smallest page_id is stored, the others refer
    to it. A null html is an empty payload, a null url is urn:none, a null page_id comes back as null (and is never
    what others refer to). Rows that repeat a page_id are all written. Other columns are not read.
    """
    ship(pages.sparkSession)
    html = text_of("html")
    page = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    page = page.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    equal = page.filter(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    equal = cut(equal.filter("pages > 1 AND first IS NOT NULL").select("digest", "first"))
    revisit = F.col("first").isNotNull() & (F.col("n") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = page.join(equal, "digest", "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    return cut(told.mapInArrow(_writer(folder), "archive string, records bigint, bytes bigint"))


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of archives (a column ``archive`` of paths in ``folder``'s file system)."""
    kinds = {"page_id": "bigint", "url": "string", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint", "payload": "binary"}
    fields = [f for f in kinds if payload or f != "payload"]
    return archives.select("archive").mapInArrow(_reader(folder, fields), ", ".join(f"{f} {kinds[f]}" for f in fields))


def digest(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder, read the archives back; the contract's columns."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    archives = write_archives(pages, folder)
    return read_archives(archives, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
