"""WARC archives: a writer and a sequential reader.

Each record is one gzip member.  Members are written by Spark's own text writer, so
any store and its commit protocol will do: a gzip member ends with the high byte of
its uncompressed size, which is 0 below 16 MiB, and that byte serves as the line
separator; the bytes between are the rows.  Larger records go to archives of their
own, one folder for each value of that byte.  The files are plain ``.warc.gz``.

The reader takes archives one by one, decompresses member by member in small pieces,
frames the block by ``Content-Length`` and verifies block and payload digests.

Of pages with equal payloads of at least ``least_bytes`` the one with the largest id
is a response; the others are revisits that refer to it and hold HTTP headers only.

Defined cases: null payload is empty; null url leaves the target out; pages with a
null id are revisits of a page with one, else responses; a page id repeated with its
payload is a response each time; an empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_ID = re.compile(r"<urn:x-page:(-?\d+|none)>")
READ_SCHEMA = (
    "archive string, place long, page_id long, record_type string, target string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to long, fault string"
)


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    found = _ID.fullmatch(urn or "")
    return int(found[1]) if found and found[1] != "none" else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, compressed to one gzip member (deterministic)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n") + out.compress(block) + out.compress(b"\r\n\r\n") + out.flush()


class WarcReader:
    """Iterates ``(place, headers, block)`` over the members of one archive; ``place``
    is the member's offset.  ``read(n)`` gives the next bytes of the archive."""

    def __init__(self, read, piece: int = 1 << 16):
        self.read, self.piece = read, piece

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        held, place = b"", 0
        while True:
            held = held or self.read(self.piece)
            if not held:
                return
            unpack, used = zlib.decompressobj(31), 0
            head, block, want, after = bytearray(), bytearray(), None, bytearray()
            while not unpack.eof:
                held = held or self.read(self.piece)
                if not held:
                    raise WarcError(f"the member at {place} is cut short")
                try:
                    data = unpack.decompress(held)
                except zlib.error as e:
                    raise WarcError(f"the member at {place} is not gzip: {e}") from e
                used += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
                if want is None:
                    head += data
                    end = head.find(b"\r\n\r\n")
                    if end < 0:
                        continue
                    headers = self._headers(bytes(head[:end]), place)
                    want = int(headers["content-length"])
                    data = bytes(head[end + 4 :])
                take = data[: want - len(block)]
                block += take
                after += data[len(take) :]
            if want is None or len(block) != want or after != b"\r\n\r\n":
                raise WarcError(f"the record at {place} does not fit its Content-Length")
            yield place, headers, bytes(block)
            place += used

    @staticmethod
    def _headers(raw: bytes, place: int) -> dict[str, str]:
        lines = raw.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"no WARC record at {place}")
        found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not found.get("content-length", "").isdigit():
            raise WarcError(f"the record at {place} has no Content-Length")
        return found


def parse(headers: dict[str, str], block: bytes) -> dict:
    """The fields of a record, its digests verified."""
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise WarcError("the block fails its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    revisit = headers.get("warc-type") == "revisit"
    claimed = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and claimed != digest(payload):
        raise WarcError("the payload fails its digest")
    return {
        "page_id": _page_id(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target": headers.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": int(size[1]) if size else len(payload),
        "payload_digest": claimed,
        "refers_to": _page_id(headers.get("warc-refers-to")),
    }


def _members(batches, date: str):
    for batch in batches:
        ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        held, size = [], 0
        for page_id, url, html, to in zip(ids, urls, batch.column(2), refers, strict=True):
            held.append(record(page_id, url, (html.as_py() or "").encode("utf-8", "surrogatepass"), to, date))
            size += len(held[-1])
            if size > 1 << 23:
                yield _cut(held)
                held, size = [], 0
        if held:
            yield _cut(held)


def _cut(members: list[bytes]) -> pa.RecordBatch:
    last = pa.array([m[-1] for m in members], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in members], pa.binary()), last], names=["body", "last"])


def mark_revisits(pages: DataFrame, *, id_col: str, payload_col: str, least_bytes: int = 0, salts: int = 16) -> DataFrame:
    """``pages`` with ``refers_to``.  Keepers of repeated payloads are salted, so pages
    of one hot payload are spread over tasks."""
    payload = common.text_or_empty(payload_col)
    keyed = pages.withColumn("__key", F.sha2(payload, 256)).withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    # the page id is in the group, or rows would be told apart by nothing but chance
    again = keyed.filter(F.octet_length(payload) >= least_bytes).groupBy("__key").agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__n"))
    keepers = common.staged(again.filter("__n > 1").drop("__n"), "keepers").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = keyed.join(keepers.hint("shuffle_hash"), ["__key", "__salt"], "left")
    other = F.col("__keep").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__keep"))
    return joined.select(*pages.columns, F.when(other, F.col("__keep")).alias("refers_to"))


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z",
) -> list[str]:
    """Write one record for each page; returns the folders of archives.
    ``archive_bytes``: about how much payload goes into one archive."""
    common.ship(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("html"))
    size = F.octet_length(common.text_or_empty("html"))
    most, mean = slim.agg(F.max(size + F.coalesce(F.octet_length("url"), F.lit(0)) * 3), F.avg(size)).first()
    if most is None:
        return []
    marked = mark_revisits(slim, id_col="id", payload_col="html", least_bytes=least_bytes).select("id", "url", "html", "refers_to")
    members = marked.mapInArrow(lambda it: _members(it, date), "body binary, last int")
    each = max(1, int(archive_bytes / max(mean, 1024)))
    if most < (1 << 24) - 4096:  # every member ends with a zero byte
        parts = {0: members}
    else:
        members = common.staged(members, "members")
        parts = {r["last"]: members.filter(F.col("last") == r["last"]) for r in members.select("last").distinct().collect()}
    for last, some in parts.items():
        # a wrong last byte must fail the write, not spoil an archive
        body = F.when(F.col("last") == last, F.col("body")).otherwise(F.raise_error(F.lit("a member is larger than was measured")).cast("binary"))
        some.select(body.cast("string").alias("value")).write.option("lineSep", chr(last)).option("maxRecordsPerFile", each).text(f"{path}/{last:03d}")
    return [f"{path}/{last:03d}" for last in parts]


def _read(batches, with_payload: bool, strict: bool):
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            stream, archive = pa.BufferReader(content.as_buffer()), name.as_py()
            rows, size, place = [], 0, 0
            try:
                for place, headers, block in WarcReader(stream.read):
                    try:
                        row = parse(headers, block)
                    except WarcError as e:
                        if strict:
                            raise
                        row = {"fault": str(e)}
                    size += len(row["payload"] or b"") if with_payload and "payload" in row else 0
                    rows.append(row | {"archive": archive, "place": place} | ({} if with_payload else {"payload": None}))
                    if len(rows) >= 5000 or size > 1 << 23:
                        yield table(rows)
                        rows, size = [], 0
            except WarcError as e:
                if strict:
                    raise
                rows.append({"archive": archive, "place": place, "fault": str(e)})
            yield table(rows)


def read_warc(spark: SparkSession, paths: list[str], *, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """One row per record: ``archive``, ``place`` (offset of its member), ``page_id``,
    ``record_type``, ``target``, ``payload``, ``payload_bytes``, ``payload_digest``,
    ``refers_to``, ``fault``.  ``strict`` fails on a faulty record; otherwise it is a row
    with its fault, and the rest of an archive that cannot be framed is one such row."""
    common.ship(spark)
    if not paths:
        return spark.createDataFrame([], READ_SCHEMA)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(lambda it: _read(it, with_payload, strict), READ_SCHEMA)
