"""WARC archives with one Zstandard frame a record and the volume's own dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Fixed values of the formats: magic of the dictionary's skippable frame, of an ordinary skippable frame, of a dictionary.
DICTIONARY_FRAME, PLAIN_FRAME = 0x184D2A5D, 0x184D2A50
RECORD_DATE = "1970-01-01T00:00:00Z"  # the same bytes for the same input
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The text writer ends each row with this byte; it is the content of the volume's last skippable frame.
END = b"\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, kind: str, refers: int | None, length: int) -> bytes:
    """One WARC/1.1 record; a revisit holds the response's HTTP header (with the payload's length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, block and payload of a record; checks the payload of a response against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError(f"record {h['WARC-Record-ID']}: the payload does not match its digest")
    return h | {"payload": payload, "length": length, "sha": sha}


def volume(records: list[bytes], dict_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 3) -> bytes:
    """An archive of its own: the dictionary (trained on records spread over the volume), a frame for each record, the end.

    Too few or too small records to train on: an empty dictionary frame, and the records are compressed without one.
    """
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = [r[: 64 << 10] for r in records[::step] if r]
    data = b""
    if len(sample) >= 8:
        try:
            data = zstandard.train_dictionary(min(dict_bytes, max(1024, total // 16)), sample, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    own = zstandard.ZstdCompressionDict(data) if data else None
    write = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True) if own else zstandard.ZstdCompressor(level=level, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(data)), data, *map(write.compress, records), struct.pack("<II", PLAIN_FRAME, len(END))])


def read_volume(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    if not raw:
        return
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    own = zstandard.ZstdCompressionDict(raw[8 : 8 + size]) if size else None
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        magic, size = struct.unpack_from("<II", raw, at)
        if magic & 0xFFFFFFF0 == PLAIN_FRAME:
            at += 8 + size
            continue
        one = (zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()).decompressobj()
        out = [one.decompress(view[at : at + (1 << 16)])]
        end = min(at + (1 << 16), len(raw))
        while not one.eof:
            if end >= len(raw):
                raise ValueError("a record is cut short")
            out.append(one.decompress(view[end : end + (1 << 20)]))
            end = min(end + (1 << 20), len(raw))
        at = end - len(one.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, volume_bytes: int = 16 << 20) -> None:
    """Write (page_id, url, payload, sha, kind, refers_to, length) as archives of some ``volume_bytes`` of records each.

    Every volume is one row of Spark's text writer, which commits whole files and so survives lost or repeated tasks on any
    file system; its line end is the content of the volume's closing skippable frame.
    """

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for page_id, url, payload, sha, kind, refers, length in zip(*(b.column(c) for c in ("page_id", "url", "payload", "sha", "kind", "refers_to", "length")), strict=True):
                r = record(page_id.as_py(), url.as_py(), payload.as_py() or b"", sha.as_py(), kind.as_py(), refers.as_py(), length.as_py())
                held.append(r)
                size += len(r)
                if size >= volume_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([volume(held)], pa.binary())], ["volume"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([volume(held)], pa.binary())], ["volume"])

    rows = pages.mapInArrow(pack, "volume binary")
    rows.select(F.col("volume").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive of every record below ``path``."""

    def unpack(batches):
        for b in batches:
            for name, raw in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                for r in read_volume(raw.as_py()):
                    h = parse(r)
                    ident = lambda x: int(y) if x and (y := x.removeprefix("<urn:x-page:").removesuffix(">")) else None
                    rows.append((ident(h["WARC-Record-ID"]), h["length"], h["sha"], h["WARC-Type"], ident(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), name.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive"]
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, ddl)


def archive(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Archive every row of ``pages`` (page_id, url, html); payload: the html in UTF-8.

    Of equal payloads of at least ``revisit_from`` bytes the one of the largest page_id is a response and the others are
    revisits that refer to it; smaller payloads are all responses. Null html: an empty payload. Null url: no target. Rows of
    null page_id are responses, and none of them is referred to. Repeated rows each get a record; all that carry the largest
    page_id are responses. Empty table: no archive. Payloads are compared by SHA-1 and length.
    """
    raw = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], raw.alias("payload"), F.unhex(F.sha1(raw)).alias("key"), F.octet_length(raw).cast("long").alias("length"))
    long = F.col("length") >= revisit_from
    # one small row for each payload that occurs more than once; written, so that the join below can split a payload's many copies
    firsts = rows.filter(long & F.col("page_id").isNotNull()).groupBy("key", "length").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = materialize(firsts, "warc-copies")
    rows = rows.join(firsts, ["key", "length"], "left")
    again = F.col("first").isNotNull() & long & (F.col("page_id") != F.col("first"))
    again = F.coalesce(again, F.lit(False))
    rows = rows.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), base32(F.hex("key")).alias("sha"),
        F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"), "length")
    write_archives(rows, path)


def base32(hexed):
    """Base32 of 20 bytes given as 40 hexadecimal digits: eight letters of each ten digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(4):
        value = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(alphabet), F.shiftright(value, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
