"""Zstandard WARC archives: one frame per record, dictionary in a leading
skippable frame."""
from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.llm._arrow import slices
from mktlens.session import cut_lineage

FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that holds the dictionary
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
URN = "urn:page:"
NO_ID = "urn:page-without-id:"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing -------------------------------------------------------------


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: str | None, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the response ``refers_to``
    (the HTTP head alone; the digest is that of the payload it repeats)."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NO_ID if page_id is None else URN + _header_value(page_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{_header_value(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [
        f"WARC-Payload-Digest: sha1:{sha1_32(payload)}", f"WARC-Block-Digest: sha1:{sha1_32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = 16 << 10) -> zstandard.ZstdCompressionDict:
    """Trained on the archive's first records up to 64 times its size; of too few
    records, their beginning as raw content."""
    sample, total = [], 0
    for r in records:
        sample.append(r[: 8 * size])
        total += len(sample[-1])
        if total >= 64 * size:
            break
    if len(sample) >= 16:
        try:
            return zstandard.train_dictionary(size, sample)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(sample)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    d = dictionary(records)
    raw = d.as_bytes()
    comp = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(comp.compress(r) for r in records)


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", archive_bytes: int = 4 << 20,
                   date: str = "1970-01-01T00:00:00Z", smallest_revisit: int = 0) -> DataFrame:
    """One WARC record per row, gathered into archives of about ``archive_bytes``
    of payload: rows (path, content), as Spark's ``binaryFile`` source reads files.

    Of rows with equal payloads of at least ``smallest_revisit`` bytes, that with
    the largest id is the response (all of them, if several rows have that id) and
    the others revisit it; a null id is below all others, and where all ids are
    null all are responses.  Largest ids come from a map-side combined aggregate
    over digests; only digests met more than once take part in the join, whose hot
    keys AQE splits on the side of the pages.  Null html: an empty payload.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("_id"), F.col(uri_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("_d", F.sha1(F.encode("text", "UTF-8")))
    large = rows.where(F.octet_length("text") >= smallest_revisit)
    first = large.groupBy("_d").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    # stored (a row per repeated payload), so that both sides of the join are dealt
    # anew and a hot payload's pages can be split
    joined = rows.join(cut_lineage(first), "_d", "left")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, "text", archive_bytes):
            cols = [part.column(i).to_pylist() for i in range(4)]
            content = archive([record(i, u, t.encode(), r, date) for i, u, t, r in zip(*cols)])
            path = f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    return joined.select("id", "url", "text", refers.alias("refers")).mapInArrow(run, "path string, content binary")


# --- reading -------------------------------------------------------------


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and block sizes."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[pos : pos + 3], "little")
        if pos + 3 > len(data):
            raise ValueError("a frame is cut short")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError("a block of a reserved type")
        pos += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise ValueError("a frame is cut short")
    return pos


def frames(data: bytes) -> Iterator[bytes]:
    """The content of every frame; the dictionary comes from a skippable frame at
    the start (plain, or compressed itself), other skippable frames are passed."""
    at, dec = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut short")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = data[8 : 8 + size]
                if raw[:4] == FRAME_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else dec
            at += 8 + size
            continue
        if data[at : at + 4] != FRAME_MAGIC:
            raise ValueError("no frame where one should begin")
        end = frame_end(data, at)
        yield dec.decompressobj().decompress(data[at:end])
        at = end


def parse(raw: bytes) -> dict:
    """Fields and payload of one record, checked: version line, needed fields,
    lengths of block and payload, digests, and the closing line ends."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header field: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record without {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its header")
    block = rest[:size]
    digest = fields.get("warc-block-digest")
    if digest and digest != f"sha1:{sha1_32(block)}":
        raise ValueError("a block's digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP head")
    m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    n = int(m[1]) if m else len(payload)
    of_payload = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != n or of_payload and of_payload != sha1_32(payload)):
        raise ValueError("a payload's length or digest differs")
    return {"fields": fields, "payload": payload if fields["warc-type"] == "response" else None, "payload_bytes": n, "digest": of_payload or sha1_32(payload)}


def _urn(value: str | None) -> str | None:
    if value is None:
        return None
    text = value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value
    if text == NO_ID:
        return None
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text.removeprefix(URN))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives given as rows (path, content), such as
    ``spark.read.format("binaryFile").load(...)``: one archive is one task's at a
    time, decoded frame by frame, so memory is bounded by the archive size and
    one record.  A corrupt archive raises.  Columns: path, record_id, target_uri,
    payload_bytes, payload_digest, record_type, refers_to, payload."""
    names = ["path", "record_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in names])

    def rows(path: str, data: bytes) -> Iterator[dict]:
        for raw in frames(data):
            r = parse(raw)
            f = r["fields"]
            uri = f.get("warc-target-uri")
            yield {
                "path": path, "record_id": _urn(f["warc-record-id"]), "target_uri": uri and re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), uri),
                "payload_bytes": r["payload_bytes"], "payload_digest": r["digest"], "record_type": f["warc-type"],
                "refers_to": _urn(f.get("warc-refers-to")), "payload": r["payload"] if with_payload else None,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                part, size = [], 0
                for r in rows(path.as_py(), data.as_py()):
                    part.append(r)
                    size += len(r["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part, size = [], 0
                yield pa.RecordBatch.from_pylist(part, schema)

    return archives.select("path", "content").mapInArrow(
        run, "path string, record_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )
