"""WARC archives: records compressed one by one with a Zstandard dictionary that each archive carries."""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_facts, lean, scratch

#: Magic numbers of skippable frames: of the leading one that holds the dictionary, and of fillers.
DICTIONARY_MAGIC, FILLER_MAGIC = 0x184D2A5D, 0x184D2A50
#: Bytes of a dictionary, and of the archive's records from which it is trained.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 4 << 20
LEVEL = 3
#: Compressed bytes at which an archive is ended and the next one begun.
ARCHIVE_BYTES = 32 << 20
#: A filler frame of one byte, which is the line end that Spark's text writer puts after each archive.
FILLER = struct.pack("<II", FILLER_MAGIC, 1)
DATE = "2024-01-01T00:00:00Z"
TARGET = re.compile(rb"[\x00-\x20\x7f]")


def record_name(page_id: int | None, url: str | None, digest: str) -> bytes:
    """The id of a page's record; a suffix tells records of one page apart."""
    return b"<urn:page:%s:%016x" % (b"" if page_id is None else b"%d" % page_id, xxhash.xxh64_intdigest((url or "").encode("utf-8", "surrogatepass"), int(digest[:15], 16)))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, length: int, suffix: bytes) -> bytes:
    """One WARC/1.1 record: response with its payload, or revisit (refers_to set) without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    kind = b"response" if refers_to is None else b"revisit"
    body = http + (payload if refers_to is None else b"")
    uri = TARGET.sub(lambda m: b"%%%02X" % m[0][0], (url or "").encode("utf-8", "surrogatepass")) or b"about:blank"
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + record_name(page_id, url, digest) + suffix + b">", b"WARC-Target-URI: " + uri, b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_name(refers_to, refers_url, digest) + b">"]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there are too few records to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b" ")


def archives(records, limit: int = ARCHIVE_BYTES):
    """Archives of records: dictionary frame, a frame for each record, a filler.

    Records are held until SAMPLE_BYTES of them are there to train on, and then compressed as they
    come; an archive ends with the record that brings it to limit bytes.
    """
    held, size, coder, frames = [], 0, None, []

    def start() -> zstandard.ZstdCompressor:
        nonlocal size
        data = dictionary(held)
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        own = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), write_content_size=True)
        frames.append(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        frames.extend(map(own.compress, held))
        held.clear()
        size = sum(map(len, frames))
        return own

    for r in records:
        if coder is None:
            held.append(r)
            size += len(r)
            if size < min(limit, SAMPLE_BYTES):
                continue
            coder = start()
        else:
            frames.append(coder.compress(r))
            size += len(frames[-1])
        if size >= limit:
            yield b"".join([*frames, FILLER])
            frames, size, coder = [], 0, None
    if held:
        start()
    if frames:
        yield b"".join([*frames, FILLER])


def records(archive):
    """The records of an archive (bytes or a buffer)."""
    coder, at, view = None, 0, memoryview(archive)
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC and coder is None:
                data = bytes(view[at + 8 : at + 8 + size])
                kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
            at += 8 + size
            continue
        one = (coder or zstandard.ZstdDecompressor()).decompressobj()
        parts, pos = [], at
        while not one.eof:
            piece = view[pos : pos + 4096]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(piece))
            pos += len(piece)
        at = pos - len(one.unused_data)
        yield b"".join(parts)


def parsed(raw: bytes) -> dict:
    """A record's fields, its digest checked against the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    body = rest[: int(fields[b"Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"a payload differs from its digest {digest}")
    ids = [fields.get(k, b"<urn:page::").split(b":")[2] for k in (b"WARC-Record-ID", b"WARC-Refers-To")]
    page, refers_to = (int(i) if i else None for i in ids)
    return {"page_id": page, "url": fields[b"WARC-Target-URI"].decode("utf-8", "surrogatepass"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers_to, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, path: str, *, least: int = 1000, limit: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row, in archives of about limit bytes under path.

    Of rows with equal payloads of `least` bytes or more the one with the largest id is the response
    and the others revisit it; shorter payloads are all responses. Null payloads are empty, null
    urls about:blank, null ids stay null (and are never revisited while another id is there); rows that repeat the id of
    the response are responses. Empty partitions and empty tables write no archive. Record ids are made of page id, url and digest;
    all but those of the responses that are revisited end in task and place, so that repeated rows have their own.

    Archives go through Spark's text writer, hence its commit protocol and any file system it knows:
    a value is one archive and a file of its own, and ends with the header of a one-byte skippable
    frame, whose byte is the line end that this writer adds. The dictionary of an archive is trained
    on its own first SAMPLE_BYTES of records, which the join has brought into hash order.

    Small partitions are written together, by as many tasks as SAMPLE_BYTES (or limit) goes into all
    payloads, and no fewer than run at once: else each would be an archive whose dictionary outweighs
    its records.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    out = group_facts(rows, ["digest", "length"], [F.col("page_id"), F.col("url")], [F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("m")], [F.sum("n").alias("n"), F.max("m").alias("newest")], F.expr(f"n > 1 and length >= {least}"))
    other = ~F.col("page_id").eqNullSafe(F.col("newest.page_id"))
    out = out.withColumns({"refers_to": F.when(other, F.col("newest.page_id")), "refers_url": F.col("newest.url"), "is_newest": F.coalesce(~other & F.col("url").eqNullSafe(F.col("newest.url")), F.lit(False)) & F.col("newest").isNotNull()})

    @lean("warc")
    def run(batches):
        task, seen = TaskContext.get().partitionId(), set()

        def each():
            n = 0
            for b in batches:
                for *r, is_newest in zip(*(b[c] for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url", "length", "is_newest")), strict=True):
                    page_id, url, payload, digest, refers_to, refers_url, length = (x.as_py() for x in r)
                    key = (page_id, digest) if is_newest.as_py() else None
                    suffix = b"" if key and key not in seen else b":%d-%d" % (task, n)
                    if key:
                        seen.add(key)
                    n += 1
                    yield record(page_id, url, payload, digest, refers_to, refers_url, length, suffix)

        for archive in archives(each(), limit):
            yield pa.record_batch([pa.array([archive], pa.binary())], names=["archive"])

    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, (rows.agg(F.sum("length")).first()[0] or 0) // min(limit, SAMPLE_BYTES))
    out = out.select("page_id", "url", "payload", "digest", "refers_to", "refers_url", "length", "is_newest").coalesce(tasks).mapInArrow(run, "archive binary")
    out.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of the records under path.

    Digests of payloads are checked. A revisit's payload is null; its length and digest are those of
    the full payload.
    """

    @lean("warc")
    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            for content in b["content"]:
                rows, size = [], 0
                for raw in records(content.as_buffer()):
                    rows.append(parsed(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of pages into the shared folder and reads them back: the columns of read_archives, a row a page.

    Odd rows are treated as write_archives says; an empty table gives no rows; other columns are ignored.
    """
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
