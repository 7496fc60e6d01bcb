import hashlib

import pytest

from lotlight.llm import warc

from .conftest import odd_texts, prose

SCHEMA = "page_id long, url string, html string, key string, digest string, record_id int"


def want(rows, least):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        last = max((r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == data), default=None)
        again = len(data) >= least and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    p = warc.WarcParams(segment_bytes=700, chunk_bytes=300, records_per_archive=20)
    rows = [(k, f"http://h/{k}" if k % 3 else None, t, "k", "d", 1) for k, t in enumerate(odd_texts() + [prose(3, 400)] * 6 + ["WARC/1.1\r\n\r\nx\r\n0\r\n\r\n"] * 2)]
    rows += [rows[7], rows[8], rows[8], rows[4], (None, None, prose(3, 300), "k", "d", 1)]  # repeated rows, one of many segments, and one without an id
    df = spark.createDataFrame(rows, SCHEMA)
    warc.write_archives(df, f"{tmp_path}/a", p)
    got = sorted((tuple(r) for r in warc.read_archives(spark, f"{tmp_path}/a").collect()), key=repr)
    assert got == want(rows, p.revisit_bytes)


def test_empty_table_and_missing_segment(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
    p = warc.WarcParams(segment_bytes=500)
    records = list(warc._records("<urn:uuid:1>", 1, "u", b"y" * 5000, None, p))
    assert len(records) > 5
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0").write_bytes(b"".join(r + warc.END for k, r in enumerate(records) if k != 2))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(spark, f"{tmp_path}/cut").count()


def test_framing():
    for n in (0, 1, 10, 8192, 20_001):
        data = bytes(k % 251 for k in range(n))
        assert warc.unchunked(warc.chunked(data, 100)) == data
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
