"""WARC archives in seekable Zstandard bundles.

A bundle is a row of an archive table: independent Zstandard frames of about ``FRAME`` bytes of records, then the seek
table of the seekable format in a skippable frame (sizes of each frame, their number, a magic number), and an index of its
records (record identifier, frame, offset and length in the unpacked frame). One record can be had by unpacking one frame.
The archive is written by Spark's own committed writer, so a task that runs again leaves no second copy.

Of records with equal payloads (SHA-256 and length) the one with the smallest page id is a response, the others revisit it.
Rows meet by page, so pages with one common payload aren't gathered, nor are rows that repeat one page.

``read`` goes through each bundle's index, from identifiers to frames and places in them; ``fetch`` gets some records by
their identifiers; ``export`` writes the bundles as files that WARC tools for Zstandard open.

Defined results: null html is an empty payload; a null url leaves out the target; a row whose id is null or repeats the
smallest id of its payload is a response. Identifiers are unique: rows that repeat a page and payload have a number at the
end, but for the first of them, to which revisits refer. Other columns are ignored; no page makes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import column, meet, scan, written

FRAME, BUNDLE = 1 << 18, 1 << 23
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle string, data binary, records array<struct<record_id:string,frame:int,offset:int,length:int>>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, sha1: str, copy: int = 0) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{sha1}{f':{copy}' if copy else ''}>"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, copy: int = 0) -> tuple[str, bytes]:
    """Its identifier and bytes; first: the page it revisits; copy: what tells it from others of its page and payload."""
    sha1 = digest(payload)
    name = record_id(page, sha1, copy)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]-._')}")
    if first is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, sha1)}"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[dict]:
    """The records in some unpacked bytes, payloads checked against their digests."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        sha1, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
        if not revisit and (digest(payload) != sha1 or len(payload) != int(sizes["Content-Length"])):
            raise ValueError(f"{head['WARC-Record-ID']} doesn't match its digest")
        page = lambda x: int(p) if (p := x.strip("<>").split(":")[2]) else None
        yield {"record_id": head["WARC-Record-ID"], "page_id": page(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_digest": sha1, "payload_bytes": int(sizes["Content-Length"]), "refers_to": page(head["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def bundle(frames: list[bytes]) -> bytes:
    """Each of the frames packed by itself, then the seek table."""
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    packed = [packer.compress(f) for f in frames]
    table = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames, strict=True)) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of each frame, from the bundle's last bytes."""
    count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(count):
        packed, raw = struct.unpack_from("<II", data, len(data) - 9 - 8 * (count - i))
        out.append((at, packed, raw))
        at += packed
    return out


def unpack(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, raw = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=raw)


def bundles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) as rows of an archive. Payloads under least bytes are never revisited."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html"))
    each = rows.groupBy("page_id", "sha", "size").agg(F.min("at").alias("lead"), F.count(F.lit(1)).alias("n"))
    able = each.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = able.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    again = meet(able, first, ["sha", "size"], ["first"]).where("page_id > first").unionByName(able.where("n > 1").withColumn("first", F.lit(None).cast("long")))
    again = again.groupBy("page_id", "sha", "size").agg(F.max("first").alias("first"), F.max("lead").alias("lead"), F.max("n").alias("n"))
    copy = F.when(F.col("page_id").isNull() | ((F.col("n") > 1) & (F.col("at") != F.col("lead"))), F.col("at") + 1).otherwise(0)
    typed = meet(rows, again.withColumn("times", F.col("n")), ["page_id", "sha", "size"], ["first", "lead", "times"], "left").withColumnRenamed("times", "n")
    typed = typed.select("page_id", "url", "html", "first", copy.cast("long").alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        index: list[dict] = []
        now, held = bytearray(), 0

        def out() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.warc.zst"]), pa.array([bundle(frames)], pa.binary()), pa.array([index], kind)], ["bundle", "data", "records"])

        for batch in batches:
            for k in range(len(batch)):
                page, url, html, first_page, copy = (column(batch, x)[k].as_py() for x in ("page_id", "url", "html", "first", "copy"))
                name, raw = record(page, url, html.encode(), first_page, copy)
                index.append({"record_id": name, "frame": len(frames), "offset": len(now), "length": len(raw)})
                now += raw
                if len(now) >= FRAME:
                    held += len(now)
                    frames.append(bytes(now))
                    now = bytearray()
                if held >= BUNDLE:
                    yield out()
                    frames, index, held, number = [], [], 0, number + 1
        if now:
            frames.append(bytes(now))
        if frames:
            yield out()

    return typed.mapInArrow(run, BUNDLES)


def read(archive: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of an archive, each where its bundle's index has it: record_id, page_id, url, record_type, payload_digest,
    payload_bytes, refers_to, payload. A record that isn't the one its identifier names is an error."""
    kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(column(batch, "data"), column(batch, "records").to_pylist(), strict=True):
                raw = data.as_py()
                for k, frame in enumerate(seek_table(raw)):
                    whole = unpack(raw, frame)
                    found = [_at(whole, r) for r in records if r["frame"] == k]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in kinds], [n for n, _ in kinds])

    return archive.select("data", "records").mapInArrow(run, "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads)


def _at(frame: bytes, place: dict) -> dict:
    """The record that an index entry places in an unpacked frame."""
    (found,) = parse(frame[place["offset"] : place["offset"] + place["length"]])
    if found["record_id"] != place["record_id"]:
        raise ValueError(f"{place['record_id']} isn't at byte {place['offset']} of its frame")
    return found


def export(archive: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as a file folder/part-...warc.zst, to any file system that PyArrow has, and gives (bundle, bytes).
    A task that runs again writes the same names, each put in place once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for name, data in zip(column(batch, "bundle").to_pylist(), column(batch, "data"), strict=True):
                raw, new = data.as_py(), f"{at}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(new) as f:
                    f.write(raw)
                store.move(new, f"{at}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(raw)], pa.int64())], ["bundle", "bytes"])

    return archive.select("bundle", "data").mapInArrow(run, "bundle string, bytes long")


def fetch(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted (record_id), each by unpacking the one frame that holds it."""
    at = archive.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*").join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    by = at.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(column(batch, "data"), column(batch, "places").to_pylist(), strict=True):
                raw, frames, found = data.as_py(), {}, []
                table = seek_table(raw)
                for p in places:
                    frame = frames.setdefault(p["frame"], None) or frames.update({p["frame"]: unpack(raw, table[p["frame"]])}) or frames[p["frame"]]
                    found.append(_at(frame, p))
                yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in found]), pa.array([r["record_type"] for r in found]), pa.array([r["payload"] for r in found], pa.binary())], ["record_id", "record_type", "payload"])

    return archive.select("bundle", "data").join(by, "bundle").mapInArrow(run, "record_id string, record_type string, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = written(bundles(scan(spark, sf_dir, "pages")))
    return read(archive, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLES: dict[str, str] = {}
