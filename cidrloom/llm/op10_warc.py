"""WARC in Zstandard archives: one frame per record, the dictionary in a leading skippable frame.

Each task writes its records to archives of its own in the shared folder (any store pyarrow opens by URI) under names
that no other attempt uses; the names are kept as a table, so an attempt that failed leaves nothing that is read. A
dictionary is trained on the first records of an archive. The reader walks frame by frame, without loading an archive,
and checks magic numbers, header syntax, record lengths and payload digests; a fault names the archive and the offset.

Of records with equal payloads of at least `min_bytes`, those with the largest page id are responses, the others
revisit it. Defined cases: null html is an empty payload, a null url leaves the target out; a null page id never wins
(without any other id all are responses); repeated rows are records of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cidrloom.llm.kit import new_path, shared_folder

ARCHIVE_BYTES = 64_000_000  # an archive is closed once it holds so many bytes of records
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 2_000_000, 32_768
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]


def record_id(page_id: int | None) -> str:
    """A URN whose low half is the page id; a null id gets a random one of another version."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.UUID(int=(0x7061676500008000 << 64) | (page_id & (1 << 64) - 1))}>"


def page_of(urn: str) -> int | None:
    number = uuid.UUID(urn.removeprefix("<urn:uuid:").removesuffix(">")).int
    if number >> 64 != 0x7061676500008000:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_stream(path, buffer_size=1 << 20)


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary, or none when the sample is too small to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes() if len(records) > 15 else b""
    except zstandard.ZstdError:
        return b""


def archives(records: Iterator[bytes], folder: str) -> Iterator[tuple[str, int, int]]:
    """Write `records` to new archives under `folder`; gives (name, records, bytes) of each."""
    waiting: list[bytes] = []
    out = packer = name = None
    count = size = 0

    def start():
        nonlocal out, packer, name, count, size
        name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        out, count, size = _open(name, write=True), 0, 0
        words = dictionary_of(waiting)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)

    def put(data: bytes):
        nonlocal count, size
        out.write(packer.compress(data))
        count, size = count + 1, size + len(data)

    for data in records:
        if out is None:
            waiting.append(data)
            if len(waiting) < SAMPLE_RECORDS and sum(map(len, waiting)) < SAMPLE_BYTES:
                continue
            start()
            for x in waiting:
                put(x)
            waiting = []
        else:
            put(data)
        if size >= ARCHIVE_BYTES:
            out.close()
            yield name, count, size
            out = None
    if out is None and waiting:
        start()
        for x in waiting:
            put(x)
    if out is not None:
        out.close()
        yield name, count, size


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write one record per row of `page_id, url, html`; gives the table of archives, already stored."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_same", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    groups = rows.filter("_same is not null").groupBy("_same").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # Payloads of their own have no partner and need no shuffle of the group side: only groups of two or more are joined.
    rows = rows.join(groups, "_same", "left").select("page_id", "url", "html", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))

    def work(batches):
        def each():
            for batch in batches:
                ids, urls, html, refers = (batch.column(i) for i in range(4))
                for i in range(batch.num_rows):
                    yield record(ids[i].as_py(), urls[i].as_py(), html[i].as_buffer().to_pybytes(), refers[i].as_py())

        for name, count, size in archives(each(), folder):
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})

    spark = pages.sparkSession
    path = new_path(spark, "warc-names")
    rows.mapInArrow(work, "archive string, records long, bytes long").write.parquet(path)
    return spark.read.parquet(path)


def _exactly(source, n: int, where: str) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError(f"{where}: archive ends inside a frame")
    return data


def frames(source, name: str) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, frame, skippable) for every frame of a stream, by the frame and block headers."""
    offset = 0
    while head := source.read(4):
        where = f"{name} at {offset}"
        if len(head) < 4:
            raise ValueError(f"{where}: archive ends inside a frame")
        magic = struct.unpack("<I", head)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = _exactly(source, 4, where)
            frame = _exactly(source, struct.unpack("<I", size)[0], where)
            yield offset, (frame if magic == DICTIONARY_MAGIC else b""), True
            offset += 8 + len(frame)
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"{where}: no Zstandard frame")
        flags = _exactly(source, 1, where)
        f = flags[0]
        single = f >> 5 & 1
        extra = _exactly(source, (1 - single) + (0, 1, 2, 4)[f & 3] + ((1 if single else 0), 2, 4, 8)[f >> 6], where)
        parts = [head, flags, extra]
        last = False
        while not last:
            mark = _exactly(source, 3, where)
            block = int.from_bytes(mark, "little")
            last = bool(block & 1)
            parts += [mark, _exactly(source, 1 if block >> 1 & 3 == 1 else block >> 3, where)]
        if f >> 2 & 1:
            parts.append(_exactly(source, 4, where))
        frame = b"".join(parts)
        yield offset, frame, False
        offset += len(frame)


def parse(data: bytes, where: str) -> dict:
    """Headers, payload and derived values of one record; every length and the digest are checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(VERSION):
        raise ValueError(f"{where}: no WARC header")
    fields = {}
    for line in head[len(VERSION) :].decode().split("\r\n"):
        field, colon, value = line.partition(": ")
        if not colon or field in fields:
            raise ValueError(f"{where}: bad header line {line[:80]!r}")
        fields[field] = value
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"} - fields.keys()
    if missing:
        raise ValueError(f"{where}: no {sorted(missing)}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: the record's length differs from its Content-Length")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    said = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")]
    if not sep or len(said) != 1:
        raise ValueError(f"{where}: no HTTP header")
    size, digest = int(said[0][16:]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit") or (kind == "revisit") != ("WARC-Refers-To" in fields):
        raise ValueError(f"{where}: bad record type {kind!r}")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{where}: the payload differs from its length or digest")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def records_in(name: str) -> Iterator[dict]:
    """Every record of one archive, in order."""
    unpacker = zstandard.ZstdDecompressor()
    with _open(name) as source:
        for offset, frame, skippable in frames(source, name):
            if skippable:
                if offset == 0 and frame:
                    words = zstandard.ZstdDecompressor().decompress(frame) if frame[:4] == struct.pack("<I", FRAME_MAGIC) else frame
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
                continue
            yield parse(unpacker.decompress(frame), f"{name} at {offset}")


def read(names: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives listed in column `archive`, one task or less per archive."""
    fields = _FIELDS + ([("payload", pa.binary())] if payload else [])

    def work(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in records_in(name):
                    rows.append(r)
                    size += len(r["payload"] or b"") if payload else 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pydict({f: pa.array([x[f] for x in rows], t) for f, t in fields})
                        rows, size = [], 0
                yield pa.RecordBatch.from_pydict({f: pa.array([x[f] for x in rows], t) for f, t in fields})

    count = max(1, names.count())
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return names.select("archive").repartition(count, "archive").mapInArrow(work, ", ".join(f"{f} {kinds[t]}" for f, t in fields))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read(write(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", min_bytes))
