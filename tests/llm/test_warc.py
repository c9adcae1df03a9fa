import base64
import hashlib
import random

import pytest
import zstandard

from inkstone.llm import warc

from .conftest import rows


def expected(pages, least=0):
    groups = {}
    for page_id, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        shared = len(payload) >= least
        top = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            first = i == top and not seen
            seen |= first
            out.append((i, len(payload), digest, "response" if first or not shared else "revisit", None if first or not shared else top))
    return sorted(out, key=repr)


PAGES = [(k, f"http://a.example/{k}", f"<p>{k % 40} ünï</p>" * (1 + k % 7)) for k in range(300)] + [(900, None, None), (901, "http://x/\r\ny z", ""), (902, "http://x", None), (950, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 1, 60])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index, folder = warc.write(spark, frame, min_bytes=least)
    found = warc.read(index, folder)
    assert rows(found, *COLUMNS) == expected(PAGES, least)
    payloads = {r["page_id"]: r["payload"] for r in found.filter("record_type = 'response'").collect()}
    assert all(payloads[i] == (h or "") for i, _, h in PAGES if i in payloads)
    urls = {r["page_id"]: r["url"] for r in found.collect()}
    assert all(urls[i] == (u or "") for i, u, _ in PAGES)


def test_bundles_are_plain_zstandard_and_seekable(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index, folder = warc.write(spark, frame, parts=2)
    path = folder.removeprefix("file://")
    for name in {r["bundle"] for r in index.collect()}:
        with open(f"{path}/{name}", "rb") as source:
            table = warc.read_seek_table(source)
            source.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
        assert sum(plain for _, _, plain in table) == len(whole)
        at, count = 0, 0
        while at < len(whole):
            _, _, _, at = warc.parse_record(whole, at)
            count += 1
        assert count == index.filter(index["bundle"] == name).count()
    assert index.select("record_id").distinct().count() == len(PAGES)


def test_ties_odd_rows_and_clashing_columns(spark):
    pages = [(1, "b", "same"), (1, "a", "same"), (0, "c", "same"), (None, "d", "same"), (None, "e", None), (5, "f", None), (7, "g", "x" * 2_000_000), (7, "h", "other")]
    frame = spark.createDataFrame([(*p, 1, 2, "z", 9) for p in pages], "page_id long, url string, html string, digest long, n long, copy string, shared long")
    index, folder = warc.write(spark, frame)
    found = warc.read(index, folder)
    assert rows(found, *COLUMNS) == expected(pages)
    assert [r["url"] for r in found.filter("page_id = 1 and record_type = 'response'").collect()] == ["a"]
    index, folder = warc.write(spark, frame.filter("false"))
    assert index.count() == 0 and warc.read(index, folder).count() == 0


def test_damage_is_noticed():
    record = bytearray(warc.warc_record(1, "u", b"payload", "response", None, warc.payload_digest(b"payload"), warc.record_id(1)))
    assert warc.parse_record(bytes(record))[2] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(bytes(record[:-1]))
    random.Random(1).shuffle(record)
    with pytest.raises((ValueError, KeyError)):
        warc.parse_record(bytes(record))
