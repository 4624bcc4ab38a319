import hashlib

import pytest
import zstandard

from tessera.llm import warc as w

PAGES = "page_id long, url string, html string, archive string"


def test_query(same_as_duckdb):
    same_as_duckdb(w.op3_warc, w.OP3_SQL)


def test_archive_has_its_dictionary_in_front_and_a_frame_a_record():
    records = [w.page_record(k, f"http://a/{k}", f"<html><body>page number {k} {'same words ' * 40}</body></html>".encode(), None, "2020-01-01T00:00:00Z") for k in range(300)]
    data = w.archive_bytes(records)
    frames = list(w.frames(data))
    assert int.from_bytes(frames[0][:4], "little") == 0x184D2A5D and len(frames) == 301
    trained = zstandard.ZstdCompressionDict(bytes(frames[0][8:]))
    assert trained.dict_id() and bytes(frames[0][8:12]) == b"\x37\xa4\x30\xec"
    for frame, record in zip(frames[1:], records, strict=True):
        assert zstandard.ZstdDecompressor(dict_data=trained).decompress(frame) == record
    alone = sum(len(zstandard.ZstdCompressor(level=w.LEVEL).compress(r)) for r in records)
    assert sum(map(len, frames[1:])) < alone / 2
    read = list(w.read_records(data))
    assert [f["WARC-Record-ID"] for f, _ in read] == [f"<urn:x-page:{k}>" for k in range(300)]


@pytest.mark.parametrize("records", [[], [w.record("response", {"A": "b"}, b"")], [w.record("response", {}, bytes(range(256)) * 400)]])
def test_small_archives(records):
    assert [block for _, block in w.read_records(w.archive_bytes(records))] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]


def test_cut_archives_are_an_error():
    data = w.archive_bytes([w.record("response", {}, b"x" * 2000)])
    with pytest.raises(Exception):  # noqa: B017
        list(w.read_records(data[:-3]))


def test_pages_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE", 20_000)
    big, small = "é<p>" * 300, "x" * 999
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\n" * 500), (None, "u", big), (9, "u", "y" * 100_000), (10, "u", "z" * 1000), (10, "u", "z" * 1000)]
    df = spark.createDataFrame([(*r, "other") for r in rows], PAGES)
    archives = w.write_archives(df, f"file://{tmp_path}/warc")
    got = w.read_archives(archives).collect()
    assert sum(r.records for r in archives.collect()) == len(got) == len(rows)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = 3 if page in (1, 2) else None
        want.append((page or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", other))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:3])
    assert not list(tmp_path.glob("warc/.*"))
    assert w.read_archives(w.write_archives(df.limit(0), f"file://{tmp_path}/none")).collect() == []
