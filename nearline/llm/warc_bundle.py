"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole WARC
records (the first is a warcinfo record), and a footer in a skippable frame: the
compressed and the plain size of every frame.  The index maps a record id to its
bundle, frame and offset inside the plain frame, so one record costs one seek and
one frame.  A bundle closes by its compressed or its plain size, whichever comes
first, and is read by ranges of frames, so no task holds a whole one.

Tasks write bundles into a shared folder under names that hold the task attempt;
the stored index names only the bundles of attempts that succeeded, so a lost
executor leaves at most an unreferenced file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearline.session import materialize, scratch_path

#: Fixed values of the seekable format: magic of its skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the format: what a revisit record stands for.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FRAME_BYTES, BUNDLE_BYTES, PLAIN_BYTES = 256 << 10, 64 << 20, 512 << 20
#: Frames that one reading task takes together, and the payload bytes that it returns at once.
RANGE_FRAMES, BATCH_BYTES = 64, 8 << 20
INDEX = "record_id string, page_id long, bundle string, frame int, offset int, length int"
RECORD = ("record_id string, page_id long, record_type string, uri string, payload_digest string, refers_to_record string, "
          "payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    name = f"{'' if page_id is None else page_id}:{payload_digest}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>"


def record(kind: str, own: str, page_id: int | None, uri: str | None, payload_digest: str, refers: str | None, body: bytes) -> bytes:
    """One WARC record; line ends in the address are escaped, as a header is one line.

    The block of a response is an HTTP message around the payload; that of a revisit is empty.
    """
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    else:
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers:
        head.append(f"WARC-Refers-To: {refers}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def bundle_info(name: str) -> bytes:
    """The warcinfo record that opens the bundle of this name."""
    own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>"
    body = b"software: nearline\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}",
            "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (the block, for other records than responses) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block


class BundleWriter:
    """Collects records into frames; ``finish`` returns the file's bytes."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.out, self.table, self.open, self.size = [], [], [], 0
        self.written = self.plain = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.size and self.size + len(raw) > self.frame_bytes:
            self._close()
        at = (len(self.table), self.size)
        self.open.append(raw)
        self.size += len(raw)
        self.plain += len(raw)
        return at

    def _close(self) -> None:
        if self.size:
            done = self.pack.compress(b"".join(self.open))
            self.out.append(done)
            self.table.append((len(done), self.size))
            self.written += len(done)
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self._close()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE, len(body)) + body


class BundleReader:
    """Random access to the frames of an open seekable file."""

    def __init__(self, file, size: int):
        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        file.seek(size - 9 - 8 * frames)
        raw = file.read(8 * frames)
        self.frames, at = [], 0
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", raw, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.file.seek(at)
        return self.unpack.decompress(self.file.read(packed), max_output_size=plain)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, key, least): least is the response's page id where the row revisits it.

    Only narrow rows (id and digest) meet by digest, so a payload with any
    number of copies never gathers its bytes in one task.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    big = rows.where(F.length("payload") >= least_bytes).select("page_id", "key").distinct()
    least = big.groupBy("key").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (big.join(least, "key").where("page_id is null or page_id > least")
             .select(F.col("page_id").alias("p"), F.col("key").alias("k"), "least"))
    return rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left").drop("p", "k")


def write_bundles(marked: DataFrame, folder: str | None = None, level: int = 3, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, plain_bytes: int = PLAIN_BYTES) -> DataFrame:
    """Write the records of ``mark_revisits`` into bundles under ``folder`` (shared; a URI); returns the stored index.

    Every row becomes a record: null addresses and ids leave their header out, an
    empty payload is a response of no bytes, repeated rows are repeated records,
    a payload larger than a frame has one of its own.  An empty table writes no bundle.
    """
    folder = (folder or scratch_path(marked.sparkSession, "warc")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = 0

        def start():
            name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            writer = BundleWriter(level, frame_bytes)
            writer.add(bundle_info(name.rsplit("/", 1)[1]))
            return name, writer, []

        name, writer, rows = start()

        def flush():
            nonlocal name, writer, rows, number
            system, path = pafs.FileSystem.from_uri(name)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path, compression=None) as f:
                f.write(writer.finish())
            done = pa.RecordBatch.from_pylist([r | {"bundle": name} for r in rows], schema=INDEX_SCHEMA)
            number += 1
            name, writer, rows = start()
            return done

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, body, least = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "least"))
                sha = digest(body)
                own = record_id(page, sha)
                raw = (record("response", own, page, url, sha, None, body) if least is None
                       else record("revisit", own, page, url, sha, record_id(least, sha), b""))
                frame, offset = writer.add(raw)
                rows.append({"record_id": own, "page_id": page, "frame": frame, "offset": offset, "length": len(raw)})
                if writer.written >= bundle_bytes or writer.plain >= plain_bytes:
                    yield flush()
        if rows:
            yield flush()

    return materialize(marked.select("page_id", "url", "payload", "least").mapInArrow(run, INDEX), "warc-index")


INDEX_SCHEMA = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()),
                          ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])


def read_records(index: DataFrame, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """The records that ``index`` points to, read from their bundles by seeking.

    Ranges of ``range_frames`` frames are dealt to tasks, which hold one plain frame
    and about ``BATCH_BYTES`` of payloads at a time.  A record whose id or whose
    payload's digest differs from the index or its header raises.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, reader, held, plain, out, size = None, None, None, -1, b"", [], 0
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["bundle"] != path:
                        if file is not None:
                            file.close()
                        system, inside = pafs.FileSystem.from_uri(r["bundle"])
                        file = system.open_input_file(inside)
                        path, reader, held = r["bundle"], BundleReader(file, file.size()), -1
                    if r["frame"] != held:
                        held, plain = r["frame"], reader.frame(r["frame"])
                    out.append(checked(r, plain))
                    size += len(out[-1]["payload"])
                    if size >= BATCH_BYTES or len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=RECORD_SCHEMA)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=RECORD_SCHEMA)
        finally:
            if file is not None:
                file.close()

    # The explicit count keeps adaptive coalescing, which sees only the narrow index, from gathering all reads in one task.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.floor(F.col("frame") / F.lit(range_frames))
    return (index.select("record_id", "bundle", "frame", "offset", "length").repartition(parts, "bundle", span)
            .sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORD))


def checked(entry: dict, plain: bytes) -> dict:
    """The row of ``RECORD`` for an index entry and its plain frame."""
    fields, body = parse(plain[entry["offset"]:entry["offset"] + entry["length"]])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Record-ID"] != entry["record_id"] or (fields["WARC-Type"] == "response" and digest(body) != sha):
        raise ValueError(f"damaged record {entry['record_id']} in {entry['bundle']}")
    page, uri = fields.get("X-Page-ID"), fields.get("WARC-Target-URI")
    return {"record_id": entry["record_id"], "page_id": None if page is None else int(page), "record_type": fields["WARC-Type"],
            "uri": None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "payload_digest": sha, "refers_to_record": fields.get("WARC-Refers-To"), "payload": body}


RECORD_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]])
                           for x in RECORD.split(", ")])


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record per page, read all of them back, and resolve revisits to their responses.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.  A
    null or missing html is an empty payload.  Of equal payloads the smallest
    page id is the response; null ids revisit it (if all are null, all are
    responses).  Repeated rows of the response's id and payload are responses
    too.  Payloads under ``least_bytes`` are always responses.  Other columns are
    ignored; an empty table gives no rows.
    """
    index = write_bundles(mark_revisits(pages, id_col, url_col, body_col, least_bytes), folder)
    got = read_records(index).select("record_id", "page_id", "record_type", "payload_digest", "refers_to_record",
                                     F.length("payload").cast("long").alias("size"))
    got = materialize(got, "warc-records")
    full = (got.where("record_type = 'response'").groupBy(F.col("record_id").alias("target"))
            .agg(F.min("page_id").alias("refers_to"), F.min("size").alias("full")))
    return (got.join(full, F.col("refers_to_record") == F.col("target"), "left")
            .select("page_id", F.coalesce("full", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
