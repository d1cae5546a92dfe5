import base64
import hashlib
import io

import pytest
import zstandard

from pactlake.llm import warc
from tests.conftest import SF, canonical


def want(rows):
    first, out = {}, []
    for i, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", i)
    for i, html in rows:
        raw = (html or "").encode()
        kind = "response" if first[html or ""] == i else "revisit"
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first[html or ""] if kind == "revisit" else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op8_warc(spark, SF).collect()), key=str) == want(pages)


def archive(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return warc.write_archives(df, f"file://{tmp_path}/warc")


def test_odd_rows_round_trip(spark, tmp_path):
    rows = [(5, "http://a", "same"), (3, "http://b\r\nX: 1", "same"), (9, None, None), (8, "u", ""), (7, "u", "é\r\n\r\n" * 100_000), (7, "u", "é\r\n\r\n" * 100_000), (None, None, "only")]
    manifest = archive(spark, tmp_path, rows)
    got = warc.read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want([(r[0], r[2]) for r in rows])
    assert {bytes(r.payload).decode() for r in got if r.page_id == 7} == {"é\r\n\r\n" * 100_000}
    assert [r.url for r in got if r.page_id == 9] == [None]
    assert sum(r.records for r in manifest.collect()) == len(rows)


def test_each_record_is_a_frame_behind_a_dictionary(spark, tmp_path):
    manifest = archive(spark, tmp_path, [(i, "http://x", f"<html>page {i} " + "lorem ipsum dolor " * 20) for i in range(200)])
    for r in manifest.collect():
        raw = open(r.path.removeprefix("file://"), "rb").read()
        assert raw[:4] == b"\x5d\x2a\x4d\x18"
        assert raw.count(warc.FRAME_MAGIC) >= r.records + 1  # the dictionary's and one a record
        assert len(list(warc.read_archive(io.BytesIO(raw)))) == r.records
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(raw[:-3])))


def test_small_samples_and_empty_tables(spark, tmp_path):
    assert warc.train_dictionary([]) == b"" and warc.train_dictionary([b"abc"]) == b"abc"
    manifest = archive(spark, tmp_path, [])
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0
    assert zstandard.ZstdDecompressor().decompress(warc.leading_frame(b"abc")[8:]) == b"abc"


def test_query_equals_sql(spark, duck):
    got = warc.op8_warc(spark, SF)
    want = duck.execute(warc.SQL["op8_warc"])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([c[0] for c in want.description], want.fetchall())
