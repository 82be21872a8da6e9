"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

``write_archives`` makes one file of each bounded group of records; ``read_archives``
loads the dictionary, walks the frames by their headers, decodes each and validates it.
Both go through Spark's own sinks and sources, so any file system that Spark reaches
will do: files are written by the text sink, whose line separator is an empty skippable
frame, and read by the binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers of skippable frames (fixed values of the format).
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
_FRAME_MAGIC = 0xFD2FB528
_FIELDS = "record_id string, refers_to string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, payload binary, error string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(record_id: str, uri: str, date: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of what it refers to, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head[5:5] = [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(records: list[bytes], dictionary_bytes: int) -> bytes:
    """Frames of the records, after a dictionary trained on them where they are enough for one."""
    out, trained = [], None
    if dictionary_bytes and len(records) >= 16:
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, records)
        except zstandard.ZstdError:  # too little or too uniform data for a dictionary
            trained = None
    if trained is not None:
        packed = zstandard.ZstdCompressor(write_checksum=True).compress(trained.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True, write_content_size=True)
    out += map(compressor.compress, records)
    return b"".join(out)


def write_archives(df: DataFrame, path: str, archive_records: int = 1000, archive_bytes: int = 16 << 20, dictionary_bytes: int = 16384) -> None:
    """Write ``df`` (record_id, uri, date, payload, digest, length, refers_to) to files under ``path``.

    ``digest`` and ``length`` are the payload's hexadecimal SHA-1 and bytes, also for a
    revisit, whose payload is not written.

    A file has ``archive_records`` records at most and about ``archive_bytes`` bytes of
    them, or one longer record. Null payloads are empty, repeated rows and ids are each
    written, and other columns are not read. An empty table writes no archive.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                held.append(_record(r.record_id, r.uri or "", r.date, r.payload or b"", base64.b32encode(bytes.fromhex(r.digest)).decode(), r.length, r.refers_to))
                size += len(held[-1])
                if size >= archive_bytes or len(held) >= archive_records:
                    yield pd.DataFrame({"archive": [_archive(held, dictionary_bytes)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [_archive(held, dictionary_bytes)]})

    rows = df.select("record_id", "uri", "date", "payload", "digest", "length", "refers_to")
    rows.mapInPandas(pack, "archive binary").select(F.col("archive").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) of an archive, found from the headers of frames and blocks."""
    at, end = 0, len(data)
    while at < end:
        if end - at < 8:
            raise ValueError("truncated frame")
        magic, length = struct.unpack_from("<II", data, at)
        start = at
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + length
        elif magic == _FRAME_MAGIC:
            at += zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                if at + 3 > end:
                    raise ValueError("truncated block")
                head = int.from_bytes(data[at : at + 3], "little")
                last, kind = bool(head & 1), head >> 1 & 3
                at += 3 + (1 if kind == 1 else head >> 3)
            if zstandard.get_frame_parameters(data[start : start + 18]).has_checksum:
                at += 4
        else:
            raise ValueError("not a Zstandard frame")
        if at > end:
            raise ValueError("truncated frame")
        yield magic, data[start:at]


def _parse(raw: bytes) -> dict:
    """Fields of one record, after its version, headers, lengths and digests are validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        fields[key.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"no {min(missing)}")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("wrong content length")
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{sha1_base32(block)}":
        raise ValueError("wrong block digest")
    revisit = fields["warc-type"] == "revisit"
    http, _, payload = block.partition(b"\r\n\r\n")
    told = [int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if not revisit and digest and digest != sha1_base32(payload):
        raise ValueError("wrong payload digest")
    if not revisit and told and told[0] != len(payload):
        raise ValueError("wrong payload length")
    strip = lambda x: x[1:-1] if x and x.startswith("<") else x
    return {
        "record_id": strip(fields["warc-record-id"]), "refers_to": strip(fields.get("warc-refers-to")), "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "payload_digest": digest,
        "payload_bytes": (told[0] if told else None) if revisit else len(payload), "payload": None if revisit else payload, "error": None,
    }


def parse_archive(data: bytes, max_record_bytes: int = (1 << 31) - 1) -> Iterator[dict]:
    """Records of one archive; a broken one is a record with ``error`` alone, and broken framing ends it.

    ``max_record_bytes`` is what a cell of a row can hold, so no larger record can come from a row.
    """
    decoder = zstandard.ZstdDecompressor()
    first = True
    try:
        for magic, frame in _frames(memoryview(data)):
            if magic == DICTIONARY_MAGIC and first:
                raw = bytes(frame[8:])
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=max_record_bytes) if raw[:4] == struct.pack("<I", _FRAME_MAGIC) else raw
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            first = False
            if magic != _FRAME_MAGIC:
                continue
            try:
                yield _parse(decoder.decompress(frame, max_output_size=max_record_bytes))
            except (ValueError, zstandard.ZstdError) as e:
                yield {"error": str(e)}
    except (ValueError, zstandard.ZstdError) as e:
        yield {"error": str(e)}


def read_archives(spark: SparkSession, path: str, rows_at_once: int = 200) -> DataFrame:
    """One row for each record of the archives under ``path``, in the fields of the format.

    A record that fails validation has ``error`` and nulls. Repeated record ids each give
    their row, and archives without records, or no archives, none. A file is read whole by
    one task, so archives should be of the customary size, up to about 1 GB.
    """
    columns = [x.split()[0] for x in _FIELDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                held = []
                for record in parse_archive(bytes(data)):
                    held.append(record)
                    if len(held) >= rows_at_once:
                        yield pd.DataFrame(held, columns=columns).astype({"payload_bytes": "Int64"})
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, _FIELDS)


def plan_records(df: DataFrame, id_col: str, uri_col: str, payload_col: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records of rows for ``write_archives``: of equal payloads (by length and SHA-1) of at
    least ``least_bytes`` bytes, that with the largest id is the response, others revisit it.

    Null payloads are empty. A null id counts as the smallest. Of repeated ids in one group
    each is a response. An empty table has no records. Other columns of ``df`` are not read,
    whatever their names.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("hex"))
    # groups of one need no join; the others have one row each here, whatever their size
    groups = rows.where(F.col("length") >= least_bytes).groupBy("hex", "length").agg(F.max("id").alias("keeper"), F.count("*").alias("c")).where("c > 1").select("hex", "length", "keeper")
    rows = rows.join(groups, ["hex", "length"], "left")
    urn = lambda c: F.concat(F.lit("urn:row:"), F.coalesce(c.cast("string"), F.lit("null")))
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    return rows.select(
        urn(F.col("id")).alias("record_id"), "uri", F.lit(date).alias("date"), F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("hex").alias("digest"), "length", F.when(revisit, urn(F.col("keeper"))).alias("refers_to"),
    )

