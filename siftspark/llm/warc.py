"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

A monolithic file is one gzip stream over all records, from which nothing can be read
but from the start. The normaliser inflates such a stream once, in chunks, rewrites
every record as a gzip member of its own and writes a sidecar index with each member's
offset and length. One record is held in memory at a time, never a whole archive.

Archives lie in the folder that driver and executors share and are opened through
pyarrow's file systems, so any store that these know will do. File names carry the task
attempt, and the manifest lists those of the attempt that succeeded: a lost executor's
half-written files are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import cut, fresh_path

#: Uncompressed bytes after which a writer begins a new archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Records of one payload from which its rows are not dealt by it: at most one payload in so many records is.
HOT = 100_000
#: Tasks at most that archives are dealt to.
TASKS = 20_000
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
REVISITS = "array<struct<nth:long,refers_to:string>>"
RECORDS = "record_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, archive string, offset long, length long, intact boolean"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return quote(value, safe="".join(map(chr, range(33, 127)))) if any(ord(c) < 33 or ord(c) > 126 for c in value) else value


def _uid(record_id: str | None) -> str:
    """A record id as a URN that holds on one line; unnamed() gives the id back. A null id has a random one."""
    return f"<urn:uuid:{uuid.uuid4()}>" if record_id is None else f"<urn:page:{quote(record_id, safe='')}>"


def unnamed(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn is not None and urn.startswith("<urn:page:") else None


def record(record_id: str | None, uri: str | None, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """A response record with an HTTP block, or a revisit of refers_to, which keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uid(record_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if uri is not None:
        head.append(("WARC-Target-URI", _line(uri)))
    if refers_to is not None:
        head += [("WARC-Refers-To", _uid(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def header(raw: bytes) -> dict[str, str]:
    """The named fields of a header, keys in lower case."""
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def inflated(read) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members; read(n) gives its next n bytes."""
    inflate = zlib.decompressobj(31)
    while data := read(CHUNK):
        while data:
            if out := inflate.decompress(data, CHUNK):
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)
    if rest := inflate.flush():
        yield rest


def records_of(parts: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record in a stream of bytes; a truncated last record is an error."""
    have = bytearray()
    while True:
        while (at := have.find(b"\r\n\r\n")) < 0:
            more = next(parts, None)
            if more is None:
                if have.strip():
                    raise ValueError("the archive ends within a record header")
                return
            have += more
        head = bytes(have[:at]).lstrip()
        size = int(header(head)["content-length"])
        while len(have) < at + 4 + size + 4:
            more = next(parts, None)
            if more is None:
                raise ValueError("the archive ends within a record")
            have += more
        yield head, bytes(have[at + 4 : at + 4 + size])
        del have[: at + 4 + size + 4]


def as_revisit(head: bytes, block: bytes, refers_to: str) -> tuple[bytes, bytes]:
    """Header and block of a response turned into a revisit of refers_to: the block keeps its HTTP header alone."""
    http = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    kept = [line for line in head.split(b"\r\n")[1:] if not line.lower().startswith((b"warc-type:", b"content-length:"))]
    added = [f"WARC-Type: revisit\r\nWARC-Refers-To: {_uid(refers_to)}\r\nWARC-Profile: {PROFILE}\r\nContent-Length: {len(http)}".encode()]
    return b"\r\n".join([VERSION, *kept, *added]), http


def _write(folder: str, date: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        name, raw, nth, archives, out = "", 0, 0, 0, None
        task = TaskContext.get()
        for batch in batches:
            done = []
            for key, uri, payload in zip(*batch.columns, strict=True):
                if out is None:
                    name, raw, nth, deflate = f"mono-{task.partitionId():06d}-{task.taskAttemptId()}-{archives:04d}.warc.gz", 0, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out, archives = fs.open_output_stream(f"{top}/{name}", compression=None), archives + 1
                body = payload.as_py()
                data = record(None if key.as_py() is None else str(key.as_py()), uri.as_py(), body, date)
                out.write(deflate.compress(data))
                done.append((f"{folder}/{name}", nth, digest32(body), len(body)))
                raw, nth = raw + len(data), nth + 1
                if raw >= limit:
                    out.write(deflate.flush())
                    out.close()
                    out = None
            columns = [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "archive", "nth", "digest", "size"])
        if out is not None:
            out.write(deflate.flush())
            out.close()

    return run


def write_monolithic(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (key, uri, payload) as response records to archives of one gzip stream each.

    Returns a row per record: key, archive, nth (its place there), digest, size. Pages are
    written by the task that reads them; payloads are not shuffled.
    """
    kind = pages.schema["key"].dataType.simpleString()
    return cut(pages.select("key", "uri", "payload").mapInArrow(_write(folder, date, limit), f"key {kind}, archive string, nth long, digest string, size long"))


def revisits_of(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, revisits) of all archives of records: which become revisits, and of what. An archive's list is bounded by the archive's size."""
    first = records.groupBy("digest", "size").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
    first = cut(first.withColumnRenamed("digest", "_d").withColumnRenamed("size", "_n"))
    same = (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_n"))
    # payloads of very many records are few enough to be sent everywhere; so their rows, of which one task might hold a third, stay where they are
    often, seldom = F.broadcast(first.where(F.col("copies") > HOT)), first.where(F.col("copies") <= HOT)
    marked = records.join(often, same, "left").withColumnRenamed("first", "_hot").drop("_d", "_n", "copies").join(seldom, same, "left").withColumn("first", F.coalesce("_hot", "first"))
    again = (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return marked.groupBy("archive").agg(F.sort_array(F.collect_list(F.when(again, F.struct("nth", F.col("first").cast("string").alias("refers_to"))))).alias("revisits"))


def _dealt(manifest: DataFrame) -> DataFrame:
    """manifest dealt over as many tasks as it has archives."""
    return manifest.repartitionByRange(max(1, min(TASKS, manifest.count())), "archive")


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out_fs, top = pafs.FileSystem.from_uri(folder)
        out_fs.create_dir(top, recursive=True)
        for batch in batches:
            done = []
            for archive, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, source = pafs.FileSystem.from_uri(archive)
                name = f"{source.rpartition('/')[2].removeprefix('mono-').removesuffix('.warc.gz')}-{task.taskAttemptId()}.warc.gz"
                again = {x["nth"]: x["refers_to"] for x in revisits or ()}
                offset = count = 0
                with fs.open_input_stream(source, compression=None) as stream, out_fs.open_output_stream(f"{top}/{name}", compression=None) as out, out_fs.open_output_stream(f"{top}/{name}.idx", compression=None) as index:
                    for head, block in records_of(inflated(stream.read)):
                        if count in again:
                            head, block = as_revisit(head, block, again[count])
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()
                        out.write(member)
                        named = header(head)
                        index.write((json.dumps([offset, len(member), named.get("warc-record-id"), named.get("warc-type"), named.get("warc-target-uri")]) + "\n").encode())
                        offset, count = offset + len(member), count + 1
                done.append((f"{folder}/{name}", count, offset))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            fs, source = pafs.FileSystem.from_uri(archive)
            if fs.get_file_info(source).type != pafs.FileType.NotFound:
                fs.delete_file(source)
        yield batch


def normalise(manifest: DataFrame, folder: str, remove: bool = False) -> DataFrame:
    """Rewrites the archives of manifest (archive[, revisits]) with a gzip member for each record and a sidecar .idx; returns their manifest.

    A sidecar line is JSON: offset, length, record id, type, target URI. Archives of one
    member, of many members and empty ones are read alike. Records that revisits names by
    their place become revisit records. With remove, the inputs are deleted once all are
    rewritten.
    """
    revisits = F.col("revisits") if "revisits" in manifest.columns else F.lit(None)
    sources = cut(_dealt(cut(manifest.select("archive", revisits.cast(REVISITS).alias("revisits")))))
    new = cut(sources.mapInArrow(_normalise(folder), MANIFEST))
    if remove:
        sources.select("archive").mapInArrow(_remove, "archive string").count()
    return new


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(archive)
                with fs.open_input_file(path) as data, fs.open_input_stream(f"{path}.idx", compression=None) as lines:
                    rows, held, rest = [], 0, b""
                    while part := lines.read(CHUNK):
                        *whole, rest = (rest + part).split(b"\n")
                        for offset, length, *_ in map(json.loads, whole):
                            data.seek(offset)
                            head, block = next(records_of(iter([zlib.decompress(data.read(length), 31)])))
                            named = header(head)
                            http, _, body = block.partition(b"\r\n\r\n")
                            digest, revisit = named["warc-payload-digest"].removeprefix("sha1:"), named["warc-type"] == "revisit"
                            size = int(header(http)["content-length"])
                            intact = revisit or (len(body) == size and digest32(body) == digest)
                            uid = [unnamed(named.get(k)) for k in ("warc-record-id", "warc-refers-to")]
                            rows.append((uid[0], named.get("warc-target-uri"), named["warc-type"], uid[1], digest, size, body if with_payload and not revisit else None, archive, offset, length, intact))
                            held += len(body) * with_payload
                            if len(rows) >= 2000 or held >= 16 << 20:
                                yield batch_of(rows)
                                rows, held = [], 0
                    yield batch_of(rows)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each read at the offset that the sidecar names; intact: its payload has its digest."""
    return _dealt(manifest.select("archive")).mapInArrow(_read(payloads), RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per page, normalises the archives and returns their manifest.

    Of pages with equal payloads of least_bytes or more, those with the smallest key
    are responses, the others revisits that refer to it; smaller payloads are all
    responses. A null payload is empty. Repeated rows of the smallest key are all
    responses; a null key is never the smallest unless a payload has no other, in which
    case all its records are responses. A null key is read back as null, any other as its text. A null uri leaves the target URI out. An empty
    table gives no archive.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key_col).alias("key"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    written = write_monolithic(rows, f"{folder}/mono")
    return normalise(revisits_of(written, least_bytes), f"{folder}/records", remove=True)
