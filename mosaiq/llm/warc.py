"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is one gzip member. A reading task takes a byte range: it scans for the gzip magic, accepts a candidate only
if it decodes to a WARC header, its Content-Length agrees with what was decoded and another member or the end of the
file follows, and then owns every record that starts inside its range, reading past the end to finish the last one. So
the tasks of a file need no index and no record is read twice or missed.

Which page is stored and which refers to it is found from ids and digests alone. The digests that several pages share are
brought to the pages by a broadcast if they are at most BROADCAST_DIGESTS, else by a join that moves the pages.

A writing task makes one file in the shared folder and reports it in a manifest, a table there; files of failed or
repeated attempts aren't in the manifest and are never read. Memory is that of one record and one batch.

Defined cases: a null payload is empty; equal payloads of at least min_bytes are stored once, by the largest id (rows that
repeat that id are all responses); a null id is written and read back as null and is never referred to; empty tables
give no file and an empty result; other columns are ignored. A record that breaks off or doesn't match its digest ends the
read with a ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .common import prepare, written

MAGIC = b"\x1f\x8b\x08"
URN = "urn:mosaiq:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: Digests of payloads that several pages share, up to which they are broadcast: about 20 MB.
BROADCAST_DIGESTS = 200_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 4) -> bytes:
    """One gzip member. refers_to: the id whose record holds the payload, null if this one does."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{URN}{'' if page_id is None else page_id}>",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{URN}{refers_to}>", "WARC-Profile": PROFILE}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header and block of a decoded record; None if it isn't one."""
    if not raw.startswith(b"WARC/1."):
        return None
    head, gap, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = fields.get("content-length", "")
    if not gap or not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    return fields, rest[:-4]


class _Window:
    """A part of a file that slides on. What lies behind `at` is let go when more is read."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.base, self.place, self.data = file, at, 0, bytearray()

    @property
    def at(self) -> int:
        return self.base + self.place

    def __len__(self) -> int:
        return len(self.data) - self.place

    def more(self) -> bool:
        if self.place > CHUNK:
            del self.data[: self.place]
            self.base, self.place = self.base + self.place, 0
        self.file.seek(self.base + len(self.data))
        got = self.file.read(CHUNK)
        self.data += got
        return bool(got)

    def ahead(self, n: int, size: int) -> bytes:
        """Up to size bytes from n bytes on, read if need be."""
        while len(self) < n + size and self.more():
            pass
        return bytes(self.data[self.place + n : self.place + n + size])

    def find(self, what: bytes) -> bool:
        """Goes on to the next occurrence; false, and on to the end, if there is none."""
        while True:
            k = self.data.find(what, self.place)
            if k >= 0:
                self.place = k
                return True
            self.place = max(self.place, len(self.data) - len(what) + 1)
            if not self.more():
                self.place = len(self.data)
                return False


def _member(w: _Window) -> tuple[bytes, int] | None:
    """The decoded member that starts at the window's start and its packed length; None if there is none."""
    unpack, out, used, step = zlib.decompressobj(31), [], 0, CHUNK >> 6
    try:
        while not unpack.eof:
            piece = w.ahead(used, step)
            if not piece:
                return None
            used, step = used + len(piece), min(2 * step, CHUNK)
            out.append(unpack.decompress(piece))
            if len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(out), used - len(unpack.unused_data)


def read_range(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record that starts in [start, end)."""
    w, known = _Window(file, start), False
    while w.at < end and w.ahead(0, 1):
        if not known and (not w.find(MAGIC) or w.at >= end):
            return
        got = _member(w)
        found = got and parse(got[0])
        if found and w.ahead(got[1], len(MAGIC)) not in (b"", MAGIC):
            found = None
        if found:
            yield w.at, *found
            known = True
            w.place += got[1]
        elif known:
            raise ValueError(f"broken record at byte {w.at}")
        else:
            w.place += 1


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """_id, _url, _payload and _refers: null for a response, else the id of the response with the same payload."""
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("_payload"))
    p = p.withColumn("_sha", F.unhex(F.sha1("_payload")))
    shared = p.where(F.octet_length("_payload") >= min_bytes).groupBy("_sha").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_sha").alias("_key"), "_first")
    shared = written(shared, "digests")
    if shared.count() <= broadcast_digests:
        shared = F.broadcast(shared)
    return p.join(shared, p["_sha"] == shared["_key"], "left").select("_id", "_url", "_payload", F.when(F.col("_id").isNull() | (F.col("_first") != F.col("_id")), F.col("_first")).alias("_refers"))


def archives(roles: DataFrame, folder: str) -> DataFrame:
    """Writes the records; a row (path, bytes) for each file of the attempts that counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store, place = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    store.create_dir(place.rpartition("/")[0])
                    out = store.open_output_stream(place, compression=None)
                out.write(record(page_id, url, payload, refers))
        if out is not None:
            n = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{place.rpartition('/')[2]}"], "bytes": [n]})

    return written(roles.mapInArrow(run, "path string, bytes long"), "manifest")


def write_archives(roles: DataFrame, folder: str) -> list[tuple[str, int]]:
    """The same as a list, for a number of files that the driver can hold."""
    return sorted((r["path"], r["bytes"]) for r in archives(roles, folder).collect())


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, files: DataFrame | list[tuple[str, int]], split_bytes: int = 32 << 20, payload: bool = True) -> DataFrame:
    """A row for each record of the files (path, bytes). A revisit's payload is null. Payload digests are checked."""
    prepare(spark)
    files = files if isinstance(files, DataFrame) else spark.createDataFrame(files, "path string, bytes long")
    files = files.where("bytes > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.select("path", F.explode(starts).alias("lo"), "bytes").select("path", "lo", F.least("bytes", F.col("lo") + split_bytes).alias("hi"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = splits.repartitionByRange(int(n), "path", "lo")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def number(text: str) -> int | None:
        digits = text.strip("<>").removeprefix(URN)
        return int(digits) if digits else None

    def row(head: dict[str, str], block: bytes) -> tuple:
        sha, refers, body = head["warc-payload-digest"].removeprefix("sha1:"), head.get("warc-refers-to"), None
        if head["warc-type"] == "response":
            body = block.partition(b"\r\n\r\n")[2]
            if digest(body) != sha:
                raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
        return (number(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"]) if body is None else len(body), sha, head["warc-type"], number(refers) if refers else None, body if payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(place) as f:
                    for _, head, block in read_range(f, lo, hi):
                        rows.append(row(head, block))
                        held += len(block) if payload else 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return splits.mapInArrow(run, SCHEMA)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, split_bytes: int = 32 << 20) -> DataFrame:
    """Writes the pages as WARC files into the shared folder and reads their records back."""
    spark = pages.sparkSession
    prepare(spark)
    files = archives(with_roles(pages, id_col, url_col, payload_col, min_bytes), scratch_path(spark, "warc"))
    return read_archives(spark, files, split_bytes, payload=False)
