"""WARC archives in seekable Zstandard bundles.

A bundle is a chain of independent Zstandard frames, each of several whole WARC
records, and a seek table in a skippable frame at its end, after the published
seekable format. An index maps each record to its bundle, frame and offset inside
the frame, so one record is read by decompressing one frame. Payloads that were seen
before are revisit records, which name the record that holds the payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import discard, shared_dir, staged

#: Fixed values of the seekable format.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DAY = "2024-01-01T00:00:00Z"


def warc_record(record_id: str, key: str, url: str | None, length: int, digest: str, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One record; without a payload it is a revisit of the record ``refers_to`` and holds the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {_DAY}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page: {key}"]
    if payload is None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:uuid:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at the offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, data[end + 4 : end + 4 + int(headers["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the end of a bundle."""
    size = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != FOOTER:
        raise ValueError("no seek table")
    out, at = [], 0
    for compressed, _ in struct.iter_unpack("<II", file.read_at(8 * n, size - 9 - 8 * n)):
        out.append((at, compressed))
        at += compressed
    return out


class _Bundle:
    """Writes frames under a name of its own; the bundle counts once its index rows are committed, so a lost or repeated task leaves only a file that nothing names."""

    def __init__(self, folder: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.file, self.frames, self.size = fs.open_output_stream(f"{path}/{self.name}", compression=None), [], 0

    def add(self, data: bytes, packer: zstandard.ZstdCompressor) -> None:
        packed = packer.compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data)))
        self.size += len(packed)

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()


_INDEX = "record_key string, record_id string, payload_digest string, bundle string, frame int, at bigint"
_RECORD = "record_key string, record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to_id string"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, bundle, buffer, offsets = zstandard.ZstdCompressor(level=3), None, bytearray(), []

        def flush() -> pa.RecordBatch:
            nonlocal bundle, offsets
            bundle = bundle or _Bundle(folder)
            bundle.add(bytes(buffer), packer)
            keys, ids, digests, at = zip(*offsets, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids), pa.array(digests), pa.array([bundle.name] * len(at)), pa.array([len(bundle.frames) - 1] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["record_key", "record_id", "payload_digest", "bundle", "frame", "at"])
            buffer.clear()
            offsets = []
            if bundle.size >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
            return out

        for batch in batches:
            columns = (batch.column(c) for c in ("record_key", "url", "html", "n", "digest", "refers_to_id"))
            for key, url, html, n, digest, refers in zip(*columns, strict=True):
                payload = None if html.as_py() is None else html.as_py().encode("utf-8", "surrogatepass")
                record_id = str(uuid.uuid4())
                offsets.append((key.as_py(), record_id, digest.as_py(), len(buffer)))
                buffer += warc_record(record_id, key.as_py(), url.as_py(), n.as_py(), digest.as_py(), payload, refers.as_py())
                if len(buffer) >= FRAME_BYTES:
                    yield flush()
        if offsets:
            yield flush()
        if bundle is not None:
            bundle.close()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name, frame, file, table, data = None, None, None, [], b""
        for batch in batches:
            out = []
            for key, record_id, bundle, number, at in zip(*(batch.column(c).to_pylist() for c in ("record_key", "record_id", "bundle", "frame", "at")), strict=True):
                if bundle != name:
                    name, frame, file = bundle, None, fs.open_input_file(f"{path}/{bundle}")
                    table = read_seek_table(file)
                if number != frame:
                    offset, size = table[number]
                    frame, data = number, zstandard.ZstdDecompressor().decompress(file.read_at(size, offset))
                headers, block = read_record(data, at)
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                length = int(head.rpartition(b"Content-Length: ")[2])
                if headers["WARC-Record-ID"] != f"<urn:uuid:{record_id}>" or headers["X-Page"] != key:
                    raise ValueError(f"the index of {key} names another record")
                if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {key} is damaged")
                refers = headers.get("WARC-Refers-To", "<urn:uuid:>")[10:-1] or None
                out.append((key, record_id, length, digest, headers["WARC-Type"], refers))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_key", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"])

    return run


def write_bundles(pages: DataFrame, folder: str, *, least_bytes: int = 100) -> DataFrame:
    """Write a record per row to bundles in ``folder``; returns the index (record_key, record_id,
    payload_digest, bundle, frame, at).

    ``pages`` needs page_id, url and html; other columns are ignored. Of records
    with equal payloads of at least ``least_bytes`` bytes, the least page_id's is a
    response and the others revisit it. Null html is an empty payload; null urls
    have no target header. Rows that repeat the least page_id are all responses (one
    of them, with the least record id, is revisited); null ids revisit if an equal
    payload has an id, else they are responses. A record's key is its page_id, its
    id a name of its own, so repeated rows have records of their own under
    one key. An empty table writes nothing.

    Responses are written first and their ids known before revisits are written,
    which need no html. Only payloads that occur more than once are looked up, so the
    html of others is never moved for them.
    """
    html = F.coalesce("html", F.lit(""))
    page = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    facts = staged(page.drop("html"), "warc-facts")
    firsts = facts.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1 and first_id is not null")
    firsts = staged(firsts.select("digest", "first_id"), "warc-firsts")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("record_key")
    none = F.lit(None).cast("string")

    responses = page.join(firsts, "digest", "left").filter(~other).select(key, "url", "html", "n", "digest", none.alias("refers_to_id"))
    index = staged(responses.mapInArrow(_write(folder), _INDEX), "warc-index")
    # a page_id may have several records; the one with this payload is revisited
    ids = index.select(F.col("payload_digest").alias("digest"), F.col("record_key").alias("first_key"), "record_id")
    named = firsts.withColumn("first_key", F.col("first_id").cast("string")).join(ids, ["digest", "first_key"]).groupBy("digest", "first_id").agg(F.min("record_id").alias("refers_to_id"))
    revisits = facts.join(staged(named, "warc-named"), "digest").filter(other).select(key, "url", none.alias("html"), "n", "digest", "refers_to_id")
    more = staged(revisits.mapInArrow(_write(folder), _INDEX), "warc-index")
    discard(facts, firsts)
    return index.unionByName(more)


#: Frames that a task reads: of 1 MB each before compression.
FRAMES = 64


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read the records of an index back: record_key, record_id, payload_bytes, payload_digest, record_type, refers_to_id.

    Frames are dealt over tasks by their number, as the index is far smaller than
    what it points to. The digests of responses are computed anew and compared with
    their headers.
    """
    block = F.floor(F.col("frame") / (FRAMES // 8)).cast("int")
    frames = index.agg(F.count_distinct("bundle", "frame")).first()[0]
    dealt = index.repartition(max(1, -(-frames // FRAMES)), "bundle", block).sortWithinPartitions("bundle", "frame", "at")
    return dealt.drop("payload_digest").mapInArrow(_read(folder), _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with refers_to (the page that a revisit names); an error if what it names is missing or has another payload."""
    known = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("record_key").alias("refers_to"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    revisited = records.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    out = records.join(known.join(revisited, "refers_to_id", "left_semi"), "refers_to_id", "left")
    wrong = (F.col("record_type") == "revisit") & ~((F.col("_n") == F.col("payload_bytes")) & (F.col("_d") == F.col("payload_digest"))).eqNullSafe(True)
    return out.withColumn("record_type", F.when(wrong, F.raise_error(F.concat(F.lit("no such payload to revisit: "), "record_key"))).otherwise(F.col("record_type")))


def archive_round_trip(pages: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """Write the pages to bundles in the shared folder, read all records back and resolve revisits, with page_id and refers_to in the type of page_id."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    kind = pages.schema["page_id"].dataType
    records = staged(read_bundles(write_bundles(pages, folder, least_bytes=least_bytes), folder), "warc-records")
    out = resolved(records)
    page_id = F.when(F.col("record_key") != "null", F.col("record_key").cast(kind))
    return out.select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
