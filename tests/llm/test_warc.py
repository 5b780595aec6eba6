import hashlib

import pytest

from topspin.llm import warc

LONG = "<p>" + "é" * 100


def expected(rows):
    first = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 100:
            first[h] = min(k, first.get(h, k))
    out = []
    for k, u, h in rows:
        data, ref = (h or "").encode(), first.get(h)
        ref = None if ref is None or ref == k else ref
        out.append((None if k is None else k, u, len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref, data if ref is None else None))
    return out


@pytest.mark.parametrize("frame", [1 << 10, 1 << 20])
def test_round_trip(spark, monkeypatch, frame):
    monkeypatch.setattr(warc, "FRAME_BYTES", frame)
    rows = [(i, f"http://x/{i}?a=b c\r\nü", ["", LONG, LONG + "x", "short", None, "y" * 99, "z" * 100][i % 7]) for i in range(60)]
    rows += [(3, "again", "short"), (1, "http://x/1", LONG), (None, None, LONG), (100, None, "big " * 400_000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    folder = warc.archive_folder(spark)
    index = warc.write(pages, folder)
    got = [(int(r.page_id) if r.page_id else None, r.url, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None, r.payload and bytes(r.payload)) for r in warc.read(index).collect()]
    fix = [(*r[:-1], r[-1] or None) for r in expected(rows)]
    assert sorted(((*r[:-1], r[-1] or None) for r in got), key=str) == sorted(fix, key=str)
    one = index.where("record_id = '100'")
    assert [r.payload_bytes for r in warc.read(one).collect()] == [1_600_000]


def test_bundles_are_zstandard_with_a_seek_table(tmp_path):
    import zstandard

    w = warc.BundleWriter(str(tmp_path / "b.zst"))
    places = [w.add(bytes([i]) * 200_000) for i in range(9)]
    w.close()
    assert [p[0] for p in places] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
    r = warc.BundleReader(str(tmp_path / "b.zst"))
    for i, (frame, at, length) in enumerate(places):
        assert r.frame(frame)[at : at + length] == bytes([i]) * 200_000
    with open(tmp_path / "b.zst", "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole == b"".join(bytes([i]) * 200_000 for i in range(9))


@pytest.mark.parametrize("text", ["http://x/a%20b?q=%2F", "100 %", "%zz%", "http://x/ü\r\nX: y", "a>b\r\nX: y", "<urn:x>", "日本 %E6%97", ": ", "", "a%0d%0ab\x00"])
def test_ids_and_addresses_come_back(text):
    data = warc.record(text, text, b"x", 1, hashlib.sha256(b"x").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert (found := warc.parse(data))["page_id"] == text and found["url"] == text and found["payload"] == b"x"
    back = warc.parse(warc.record("a", None, None, 1, "d", text, "1970-01-01T00:00:00Z"))
    assert back["refers_to"] == text and back["url"] is None and back["record_type"] == "revisit"


def test_text_ids(spark):
    ids = ["a>b\r\nX: y", "50%25", "ü"]
    pages = spark.createDataFrame([(i, i, LONG) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: (r.url, r.refers_to) for r in warc.read(warc.write(pages, warc.archive_folder(spark))).collect()}
    least = min(ids)
    assert got == {i: (i, None if i == least else least) for i in ids}


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, warc.archive_folder(spark))).count() == 0
