import base64
import hashlib

import zstandard

from corvid.llm import warc
from corvid.llm.shared import filesystem, work_dir

SCHEMA = "page_id long, url string, html string, first string, record_type string, file int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def _b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_records_come_back_for_odd_rows(spark):
    rows = [(1, "http://a/1", "<p>ä</p>"), (2, None, None), (3, "http://a/\r\n3", ""), (4, "http://a/4", "<p>ä</p>"), (5, "u", "x" * 300_000),
            (6, "u", "line\r\n\r\nline"), (None, "u", "<p>ä</p>"), (7, "u", "same"), (7, "u", "same"), (8, "u", "same")]
    out = warc.archive_pages(_pages(spark, rows)).collect()
    assert len(out) == len(rows)
    text = {}
    for i, _, html in rows:
        text.setdefault(i, html or "")
    for r in out:
        assert (r.payload_bytes, r.payload_digest) == (len(text[r.page_id].encode()), _b32(text[r.page_id]))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=str)
    assert got == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 2), (4, "revisit", 1), (5, "response", None),
                          (6, "response", None), (None, "revisit", 1), (7, "response", None), (7, "response", None), (8, "revisit", 7)], key=str)


def test_small_payloads_may_all_be_responses(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "long enough"), (4, "u", "long enough")]
    out = {r.page_id: r.record_type for r in warc.archive_pages(_pages(spark, rows), min_revisit_bytes=6).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    assert warc.archive_pages(_pages(spark, [])).count() == 0


def test_dictionary_frame_and_random_access(spark):
    rows = [(i, f"http://host/{i}", f"<html><head><title>page number {i}</title></head><body>{'some shared markup ' * 9}{i * i}</body></html>") for i in range(600)]
    folder = work_dir(spark, "warc-test")
    files = [r.file for r in warc.write_archives(_pages(spark, rows), folder).collect()]
    records = warc.read_archives(spark.createDataFrame([(f,) for f in files], "file string"), folder).collect()
    assert sorted(r.page_id for r in records) == list(range(600))
    fs, path = filesystem(f"{folder}/{files[0]}")
    head = fs.open_input_stream(path, compression=None).read(200_000)
    assert head[:4] == warc.DICT_FRAME.to_bytes(4, "little")
    size = int.from_bytes(head[4:8], "little")
    assert head[8:12] == warc.DICT_MAGIC and 8 + size < len(head)
    # one record alone, with the dictionary out of the file
    for r in records[:3]:
        got = warc.read_record(f"{folder}/{r.file}", r.offset)
        assert got["payload"].decode() == rows[r.page_id][2] and got["WARC-Target-URI"] == rows[r.page_id][1]
    plain = zstandard.ZstdCompressor(level=3)
    written = warc.write_archives(_pages(spark, rows), folder + "-2").collect()
    assert all(r.bytes > 8 + size for r in written) and sum(r.records for r in written) == 600
    records_alone = sum(len(plain.compress(warc._record(i, u, t.encode(), _b32(t), len(t), i, "1970-01-01T00:00:00Z"))) for i, u, t in rows)
    assert records_alone > 1.5 * sum(r.bytes - 8 - size for r in written)  # what the dictionary saves
