import base64
import hashlib
import io

import pyarrow.fs as fs
import pytest
import zstandard

from sightline.llm.queries import op6_warc
from sightline.llm.warc import build_dictionary, parse_record, read_archive, record_bytes, skippable, write_archives, archive_round_trip
from tests.llm.conftest import rows_of


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages):
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    first = {}
    for i, p in sorted(payloads.items()):
        first.setdefault(p, i)
    return {
        i: (len(p), digest(p), "response" if first[p] == i else "revisit", None if first[p] == i else first[p])
        for i, p in payloads.items()
    }


def found(rows):
    return {r["page_id"]: tuple(r)[1:] for r in rows}


def test_all_pages(spark, small):
    rows = op6_warc(spark, small).collect()
    pages = rows_of("pages")
    assert len(rows) == len(pages) and found(rows) == brute(pages)


def test_archives_on_disk(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    archives = write_archives(pages, f"file://{tmp_path}/warc").collect()
    by_id = {r["page_id"]: r for r in rows_of("pages")}
    seen = {}
    for a in archives:
        with open(a["path"], "rb") as f:
            records = list(read_archive(f))
        assert len(records) == a["records"]
        for data in records:
            headers, _, payload = parse_record(data)
            seen[int(headers["WARC-Record-ID"].strip("<>").split(":")[-1])] = (headers, payload)
    assert set(seen) == set(by_id)
    for i, (headers, payload) in seen.items():
        assert headers["WARC-Target-URI"] == by_id[i]["url"]
        if headers["WARC-Type"] == "response":
            assert payload == by_id[i]["html"].encode()
    whole = sum(len(r["html"]) for r in by_id.values())
    assert sum(f.size for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/warc"))) < 0.6 * whole


def test_copies_and_odd_rows(spark):
    rows = [
        (5, "http://a/\n x", "same"), (3, None, "same"), (9, "http://b", "same"), (1, "u", None), (2, "u", ""), (4, "ü", "é" * 100_000),
        (7, "u", "x\r\n\r\ny"), (7, "u", "x\r\n\r\ny"), (8, "u", "x\r\n\r\ny"), (7, "u", "other"), (None, "u", "same"), (None, "u", "alone"),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, URL int, digest string").repartition(3)
    got = sorted((tuple(r) for r in archive_round_trip(df).collect()), key=str)
    pay = lambda i, t, kind, to: (i, len(t.encode()), digest(t.encode()), kind, to)
    assert got == sorted([
        pay(3, "same", "response", None), pay(5, "same", "revisit", 3), pay(9, "same", "revisit", 3), pay(None, "same", "revisit", 3),
        pay(1, "", "response", None), pay(2, "", "revisit", 1), pay(4, "é" * 100_000, "response", None),
        pay(7, "x\r\n\r\ny", "response", None), pay(7, "x\r\n\r\ny", "response", None), pay(8, "x\r\n\r\ny", "revisit", 7),
        pay(7, "other", "response", None), pay(None, "alone", "response", None),
    ], key=str)
    large = {r["page_id"]: r["record_type"] for r in archive_round_trip(df, min_bytes=6).collect()}
    assert large[5] == large[2] == "response" and large[8] == "revisit"
    assert archive_round_trip(df.limit(0)).collect() == []


def test_one_record_at_a_time():
    records = [record_bytes(i, "http://x", bytes([65 + i % 20]) * (i * 500), None, "2026-01-01T00:00:00Z") for i in range(30)]
    for dictionary in (build_dictionary(records, 4096), build_dictionary(records[:1], 4096), b""):
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        tool = zstandard.ZstdCompressor(**known)
        data = skippable(dictionary) + b"".join(tool.compress(r) for r in records)
        assert list(read_archive(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        parse_record(records[3][:-5] + b"zz\r\n\r\n")
