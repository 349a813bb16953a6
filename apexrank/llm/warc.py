"""WARC archives under Zstandard: a dictionary in the leading skippable frame, one frame per record, headers and lengths validated."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settle

#: Fixed values of the format: the skippable frame that holds a dictionary, a zstd frame, and a zstd dictionary.
DICT_FRAME = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICT_MAGIC = 0xEC30A437
DIGEST = "sha256:"
#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100
#: Payloads that the dictionary is trained on, bytes of each, and bytes of the dictionary.
DICT_ROWS, DICT_SLICE, DICT_BYTES = 400, 4096, 16 << 10
#: Compressed bytes after which an archive is closed and the next one is begun.
ARCHIVE_BYTES = 16 << 20


class WarcError(ValueError):
    pass


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A zstd dictionary, or none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [p[:DICT_SLICE] for p in payloads if p]).as_bytes() if len(payloads) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, uri: str, digest: str, kind: str, refers_to: int | None, payload: bytes, length: int) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's length is kept in its own header."""
    one_line = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    name = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {one_line(uri)}",
        f"WARC-Payload-Digest: {DIGEST}{digest}",
        f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record's headers and block; WarcError unless version, headers, lengths and digest hold."""
    head, cut, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError as bad:
        raise WarcError(f"headers are not UTF-8: {bad.reason}") from None
    if not cut or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key or key != key.strip():
            raise WarcError(f"malformed header: {line[:80]!r}")
        fields[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise WarcError(f"missing header: {key}")
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"content length {fields['content-length']} does not match {len(rest) - 4} bytes")
    block = rest[:length]
    claimed = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit" and not fields.get("x-payload-length", "").isdigit():
        raise WarcError("a revisit does not tell its payload's length")
    if fields["warc-type"] == "response" and claimed.startswith(DIGEST) and hashlib.sha256(block).hexdigest() != claimed[len(DIGEST) :]:
        raise WarcError("payload digest does not match the block")
    return {"fields": fields, "block": block}


def archive_head(dictionary: bytes) -> bytes:
    """The skippable frame, with the dictionary itself compressed; nothing if there is no dictionary."""
    if not dictionary:
        return b""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICT_FRAME, len(body)) + body


def read_archive(stream, most: int = 1 << 31, faults: bool = False):
    """Yields the records of an archive (a binary file object) one by one; a frame has to hold one whole record. A fault raises
    WarcError; with faults, it is yielded instead, and the archive is left where frames can't be told apart any more."""
    data, options = b"", {}
    data = stream.read(8)
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICT_FRAME:
        size = struct.unpack("<I", data[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise WarcError("the dictionary frame is cut short")
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            try:
                body = zstandard.ZstdDecompressor().decompress(body, max_output_size=16 << 20)
            except zstandard.ZstdError as bad:
                raise WarcError(f"the dictionary is damaged: {bad}") from None
        if body[:4] != struct.pack("<I", DICT_MAGIC):
            raise WarcError("the leading frame holds no dictionary")
        options, data = {"dict_data": zstandard.ZstdCompressionDict(body)}, b""
    reader = zstandard.ZstdDecompressor(**options)
    while data or (data := stream.read(1 << 18)):
        frame, parts, size = reader.decompressobj(), [], 0
        try:
            while True:
                parts.append(frame.decompress(data))
                size += len(parts[-1])
                if size > most:
                    raise WarcError("a record is larger than allowed")
                if frame.eof:
                    data = frame.unused_data
                    break
                if not (data := stream.read(1 << 18)):
                    raise WarcError("the last frame is cut short")
        except (WarcError, zstandard.ZstdError) as bad:
            fault = bad if isinstance(bad, WarcError) else WarcError(f"a frame is damaged: {bad}")
            if not faults:
                raise fault from None
            yield {"fault": str(fault)}
            return
        try:
            found = parse_record(b"".join(parts))
        except WarcError as bad:
            if not faults:
                raise
            found = {"fault": str(bad)}
        yield found


def _writer(folder: str, dictionary: bytes):
    """mapInArrow: writes archives below folder, each under a name of its own that is put in place once it is whole, and
    yields the names. A task that runs twice leaves files whose names nobody has yielded; only yielded names are read."""

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        level = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        buffer, size, done = [], 0, []

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}.part") as out:
                out.write(archive_head(dictionary))
                for frame in buffer:
                    out.write(frame)
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((name, len(buffer)))
            buffer.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload_digest", "record_type", "refers_to", "payload", "payload_bytes")]
            for row in zip(*columns, strict=True):
                page, url, digest, kind, refers, payload, length = (x.as_py() for x in row)
                frame = level.compress(record(page, url, digest, kind, refers, payload, length))
                buffer.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
                    size = 0
        if buffer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["name", "records"])

    return run


def _number(name: str | None) -> int | None:
    tail = (name or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _reader(faults: bool):
    """mapInArrow: archives (content) to their records; with faults, also a row with only `fault` for each record that is refused."""
    schema = FIELDS | ({"fault": pa.string()} if faults else {})

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for found in read_archive(io.BytesIO(content.as_buffer()), faults=faults):
                    if "fault" in found:
                        rows.append((*[None] * len(FIELDS), found["fault"]))
                        continue
                    f = found["fields"]
                    kind = f["warc-type"]
                    uri = f.get("warc-target-uri", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    block = found["block"] if kind == "response" else None
                    length = len(block) if block is not None else int(f.get("x-payload-length", len(found["block"])))
                    row = (_number(f["warc-record-id"]), uri, length, f.get("warc-payload-digest", "").removeprefix(DIGEST), kind, _number(f.get("warc-refers-to")), block)
                    rows.append((*row, None) if faults else row)
                    size += len(found["block"])
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each row of pages (page_id, url, html).

    Among equal payloads of REVISIT_BYTES or more, the least page_id is the response and others revisit it; rows with a null
    page_id or a repeated least page_id are responses. Shorter payloads are responses. A null html is an empty payload.

    Digests are counted before anything meets: only groups of two or more are joined back, by digest and bytes, and their
    table is written, so the side of a very large group can be split."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    named = rows.where(f"payload_bytes >= {REVISIT_BYTES}").select("page_id", "payload_bytes", "payload_digest")
    groups = named.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = settle(groups, "digests")
    out = rows.join(groups, ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes records (as plan_records() gives them, all rows, repeated ones too; other columns are left out) below folder, a URI that
    driver and executors share; returns (name, records) of the whole archives. A record of any length is one frame; no row, no archive."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own = records.select("page_id", "url", "payload_digest", "record_type", "refers_to", "payload", "payload_bytes")
    return settle(own.mapInArrow(_writer(folder, dictionary), "name string, records bigint"), "archives")


def read_archives(spark, folder: str, names: DataFrame, faults: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of the records of the archives in names (name, ..),
    in which a repeated name counts once. A refused record fails the job; with faults it is a row with nulls and the reason in
    `fault`, null for sound records. Payloads of any length are given whole (null for a revisit); no names, no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    own = F.element_at(F.split("path", "/"), -1)
    kept = files.withColumn("name", own).join(names.select("name"), "name", "left_semi").select("content")
    return kept.mapInArrow(_reader(faults), READ + (", fault string" if faults else ""))


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def draw_payloads(pages: DataFrame, most: int = DICT_ROWS) -> list[bytes]:
    """The heads of at most `most` payloads, those of the least hash of page_id and payload. Only a share of rows near that bound is
    sorted and leaves the executors."""
    heads = pages.where("html is not null").select(F.substring(F.col("html").cast("string"), 1, DICT_SLICE).alias("html"), F.col("page_id").cast("bigint").alias("page_id"))
    total = heads.count()
    drawn = heads.select("html", F.xxhash64("page_id", "html").alias("h"))
    if total > 2 * most:
        drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * 2 * most / total))
    return [r.html.encode() for r in drawn.orderBy("h").limit(most).collect()]


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes every row of pages (page_id, url, html) as a record of Zstandard archives in the shared folder, and returns what
    the archives hold, read back and validated. The dictionary is trained on up to DICT_ROWS payloads drawn by hash; see
    draw_payloads(). A payload of any length is one record. Nulls, ties and repeated rows: see plan_records(). Other columns are
    ignored; an empty table writes no archive and gives no rows."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    names = write_archives(plan_records(pages), folder, train_dictionary(draw_payloads(pages)))
    return read_archives(spark, folder, names) if not names.isEmpty() else spark.createDataFrame([], READ)
