import base64
import hashlib

import pyarrow.fs as pafs
import pytest

from newsloom.llm import warc

PAGES = [
    (3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, "http://a/3\r\nX: y", "<p>é\r\n\r\nWARC/1.1</p>"), (4, None, None),
    (5, "u", ""), (6, "u", "x" * 300_000), (7, "u", "x" * 300_000), (None, "u", "none"), (8, "u", "tie"), (8, "u", "tie"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, same string")


def expected(least=0):
    out = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        ids = [p[0] for p in PAGES if (p[2] or "") == (h or "") and p[0] is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, pages):
    for least in (0, 100):
        index = warc.write_archive(pages, least, frame_bytes=1000, bundle_bytes=100_000)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(index).collect()]
        assert sorted(got, key=repr) == expected(least)
        assert sorted([r.page_id for r in index.collect()], key=repr) == sorted([p[0] for p in PAGES], key=repr)


def test_single_records_are_fetched_by_offset(spark, pages):
    index = warc.write_archive(pages, frame_bytes=500)
    wanted = spark.createDataFrame([(2,), (6,), (99,)], "page_id long")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.fetch(index, wanted).collect()}
    assert got == {2: PAGES[2][2], 6: PAGES[5][2]}


def test_seek_table_covers_the_frames(spark, pages):
    row = warc.write_archive(pages.coalesce(1), frame_bytes=500).orderBy("bundle", "frame", "record_start").first()
    fs, path = pafs.FileSystem.from_uri(row.bundle)
    with fs.open_input_file(path) as file:
        frames = warc.seek_table(file)
        assert frames[0][:2] == (row.frame_start, row.frame_bytes)
        assert warc.read_frame(file, *frames[0])[row.record_start :].startswith(b"WARC/1.1\r\n")


def test_damage_is_noticed():
    record = warc.warc_record(1, "u", b"payload", "response", None)
    assert warc.parse_record(record)[0]["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record.replace(b"payload", b"pAyload"))


def test_empty_table(spark, pages):
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_few_rows_at_a_time_become_python_objects(tmp_path, monkeypatch):
    import pyarrow as pa

    sizes, chunks = [], warc.text_chunks

    def spy(batches, column):
        for chunk in chunks(batches, column):
            sizes.append(sum(len(p) for p in chunk.column(column).to_pylist()))
            yield chunk

    monkeypatch.setattr(warc, "text_chunks", spy)
    rows = [{"page_id": i, "url": "u", "payload": b"x" * 400_000, "kind": "response", "refers_to": None} for i in range(20)]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("kind", pa.string()), ("refers_to", pa.int64())])
    found = [r["page_id"] for b in warc._write(f"file://{tmp_path}", 1 << 18, 1 << 25)(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]
    assert sorted(found) == list(range(20)) and max(sizes) <= 2 << 20
