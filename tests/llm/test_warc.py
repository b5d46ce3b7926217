import base64
import glob
import gzip
import hashlib
import io

import pytest

from gapscan.llm.warc import WarcError, WarcReader, parse, read_warc, record, write_warc


def brute(rows):
    known: dict[bytes, list] = {}
    for i, _, html in rows:
        known.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [x for x in known[payload] if x is not None]
        keep = max(ids) if ids else None
        to = None if keep is None or i == keep else keep
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


ROWS = [(1, "http://a/é \n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (None, "u", "only"),
        (5, "u", "é" * 70_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "\x00\n\x1f\x8b"), (7, "u", "\x00\n\x1f\x8b"), (-8, "u", "neg")]


def columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_and_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    folders = write_warc(pages, path, archive_bytes=3000)
    back = read_warc(spark, folders)
    assert columns(back) == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in back.collect() if r.payload is not None}
    assert payloads[7] == "\x00\n\x1f\x8b".encode() and payloads[5] == ("é" * 70_000).encode()
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path}/*/part-*"))
    assert whole.count(b"WARC-Record-ID") == len(ROWS)


def test_the_table(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert columns(read_warc(spark, write_warc(pages, str(tmp_path / "w")), with_payload=False)) == brute(rows)


def test_a_record_beyond_sixteen_megabytes(spark, tmp_path):
    rows = [(1, "u", "z" * (17 << 20)), (2, "u", "small"), (3, "u", "z" * (17 << 20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folders = write_warc(pages, str(tmp_path / "w"))
    assert len(folders) == 2
    assert columns(read_warc(spark, folders, with_payload=False)) == brute(rows)


def test_faults(spark, tmp_path):
    good = record(1, "u", b"hello", None, "2024-01-01T00:00:00Z")
    for piece in (1, 7, 1 << 16):
        got = list(WarcReader(io.BytesIO(good * 3).read, piece))
        assert [p for p, _, _ in got] == [0, len(good), 2 * len(good)] and parse(*got[1][1:])["payload"] == b"hello"
    raw = gzip.decompress(good)
    for bad in (good[:-20], b"junk", gzip.compress(raw.replace(b"Content-Length: ", b"Content-Length: 9", 1)), gzip.compress(raw + b"x")):
        with pytest.raises(WarcError):
            [parse(h, b) for _, h, b in WarcReader(io.BytesIO(bad).read)]
    flipped = gzip.compress(raw.replace(b"hello", b"jello"))
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(good + flipped + good)
    rows = read_warc(spark, [str(folder)], strict=False).collect()
    assert [r.fault is None for r in rows] == [True, False, True]
    with pytest.raises(Exception, match="digest"):
        read_warc(spark, [str(folder)]).collect()


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_warc(spark, write_warc(none, str(tmp_path / "w"))).count() == 0
