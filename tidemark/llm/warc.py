"""WARC archives: one gzip member for each record, written and read by Spark tasks.

Archives lie in the shared folder and are opened through ``pyarrow.fs``, so any
store that it reaches will do. A task writes one archive under a name of its
own and moves it into place when it is whole; a repeated task replaces it by
the same records. The reader decompresses and frames incrementally, so its
memory follows the largest record, not the archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared.scratch import Scratch


#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes read from an archive, and payload bytes gathered for a batch, at a time.
CHUNK, BATCH = 1 << 16, 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"


class DigestError(ValueError):
    """A payload does not have the digest that its record states."""


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves out the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        context = TaskContext.get()
        final = f"{root}/pages-{context.partitionId():05d}.warc.gz"
        own = f"{final}.{context.taskAttemptId()}"
        store.create_dir(root, recursive=True)
        records = size = 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                    out.write(member)
                    records, size = records + 1, size + len(member)
        if records:
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(own, final)
            yield pa.RecordBatch.from_pylist([{"archive": f"{folder}/{final.rpartition('/')[2]}", "records": records, "bytes": size}], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
        else:
            store.delete_file(own)

    return run


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one after the other."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        unpack, content = zlib.decompressobj(31), []
        while not unpack.eof:
            content.append(unpack.decompress(rest))
            rest = b"" if unpack.eof else stream.read(CHUNK)
            if not rest and not unpack.eof:
                raise EOFError("the archive ends within a record")
        rest = unpack.unused_data
        yield b"".join(content)


def _headers(block: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and where the body begins."""
    end = block.index(b"\r\n\r\n")
    first, *lines = block[:end].decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(content: bytes) -> dict:
    """A record's fields; the framing and a response's digest must hold."""
    version, head, at = _headers(content)
    length = int(head["content-length"])
    if not version.startswith("WARC/1.") or content[at + length :] != b"\r\n\r\n":
        raise ValueError("the record is not framed as its length says")
    block = content[at : at + length]
    _, http, body = _headers(block)
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    payload = block[body:] if kind == "response" else None
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
        raise DigestError(head["warc-record-id"])
    return {"page_id": _page(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": kind, "payload_digest": digest, "payload_bytes": int(http["content-length"]), "refers_to": _page(head.get("warc-refers-to")), "payload": payload}


def _read(keep_html: bool):
    names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = _store(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for found in map(parse, members(stream)):
                        html = found["payload"].decode() if keep_html and found["payload"] is not None else None
                        rows.append({n: found[n] for n in names} | {"html": html})
                        size += 500 + len(html or "")
                        if size > BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def write_archives(pages: DataFrame, scratch: Scratch, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest.

    Further columns are ignored. A null html is an empty payload, a null url an
    empty URI. Of equal payloads of ``LEAST_REVISIT`` bytes or more the
    smallest page_id is the response, rows with a larger one are revisits; rows
    with a null id, and repeats of the smallest, are responses. A very long
    payload is held whole while its record is written and read. An empty table
    gives an empty manifest.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    large = scratch.keep(large, "digests")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    # Written first, so that adaptive execution can split the join where very many pages are copies of one.
    first = scratch.keep(first.select("digest", "refers_to"), "first")
    revisits = large.join(first, "digest").where("page_id > refers_to").dropDuplicates(["page_id", "digest"])
    marked = pages.join(scratch.keep(revisits, "revisits"), ["page_id", "digest"], "left")
    manifest = marked.mapInArrow(_write(folder or f"{scratch.path}/archives"), MANIFEST)
    manifest = scratch.keep(manifest, "manifest")
    scratch.drop("digests", "first", "revisits")
    return manifest


def read_archives(manifest: DataFrame, keep_html: bool = True) -> DataFrame:
    """The records of the manifest's archives, one task for each archive; an empty manifest has none.

    A task reads its archive record by record, so it holds one payload at a
    time, however long, and repeated payloads are records each for itself.
    """
    parts = max(1, manifest.count())
    return manifest.select("archive").repartition(parts).mapInArrow(_read(keep_html), RECORD)
