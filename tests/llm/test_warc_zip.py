import gzip
import io
import json
import zipfile

import pytest

from flowloom.llm import warc_zip as wz
from flowloom.sources.sinks import scratch_path

ROWS = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a\r\nX: y/4", ""),
    (5, "http://a/5", "x" * 200_000), (5, "http://a/5", "x" * 200_000), (None, "http://a/6", "<p>é</p>"),
    (6, "u", "WARC/1.1\r\n\r\nPK\x05\x06 \r\n\r\n"), (None, None, "only"),
]


@pytest.fixture(scope="module")
def records(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    packages = wz.write_packages(pages, scratch_path(spark, "packages"), package=1000)
    assert packages.count() > 3
    return wz.read_records(wz.locate_records(packages)).collect()


def test_round_trip(records):
    assert len(records) == len(ROWS) and all(r["valid"] for r in records)
    assert sorted(r["payload_bytes"] for r in records) == sorted(len((h or "").encode()) for _, _, h in ROWS)
    assert sum(r["record_type"] == "response" for r in records) == 6
    full = {r["payload_digest"]: bytes(r["payload"]) for r in records if r["record_type"] == "response"}
    assert full == {wz.base32_sha1((h or "").encode()): (h or "").encode() for _, _, h in ROWS}


def test_largest_id_is_the_response(records):
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in records}
    assert {(2, "response", None), (1, "revisit", 2), (None, "revisit", 2), (4, "response", None), (3, "revisit", 4)} <= kinds
    assert {(5, "response", None), (None, "response", None)} <= kinds and (5, "revisit", 5) not in kinds


def test_short_payloads_can_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    packages = wz.write_packages(pages, scratch_path(spark, "packages"), least_bytes=3)
    assert {r["record_type"] for r in wz.read_records(wz.locate_records(packages)).collect()} == {"response"}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, payload int, sha1 int")
    packages = wz.write_packages(pages, scratch_path(spark, "packages"))
    assert wz.read_records(wz.locate_records(packages)).collect() == []


def test_zip64_directory_and_compressed_members(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc", b"a" * 100)
        z.writestr("indexes/i", b"i" * 50)
        z.writestr("packed", b"p" * 500, zipfile.ZIP_DEFLATED)
    assert b"PK\x06\x06" in path.read_bytes()
    reader = wz.RangeReader(str(path))
    found = wz.members(reader)
    assert set(found) == {"archive/a.warc", "indexes/i"}
    assert reader.read(*found["archive/a.warc"]) == b"a" * 100
    assert reader.read(*found["indexes/i"]) == b"i" * 50


def test_damaged_files_are_told(tmp_path):
    path = tmp_path / "bad.zip"
    path.write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError, match="not a ZIP"):
        wz.members(wz.RangeReader(str(path)))
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("a", b"1")
    for mark, text in ((b"PK\x01\x02", "central directory"), (b"PK\x03\x04", "local header")):
        path.write_bytes(whole.getvalue().replace(mark, b"XXXX"))
        with pytest.raises(ValueError, match=text):
            wz.members(wz.RangeReader(str(path)))


def package(path, archives, indexes=(), method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w") as z:
        for name, records in archives.items():
            z.writestr(name, b"".join(records))
        for name, lines in indexes:
            z.writestr(name, lines, method)
    return str(path)


def record(i, packed=True):
    body = f"page {i} ".encode() * (i + 1) * (70_000 if i == 2 else 1)
    plain = wz.make_record(i, f"http://a/{i}", body, wz.base32_sha1(body), None)
    return gzip.compress(plain) if packed else plain


def listing(records, name="archive/a.warc.gz"):
    at, lines = 0, []
    for r in records:
        lines.append(f"key 2026 {json.dumps({'offset': str(at), 'length': len(r), 'filename': name})}")
        at += len(r)
    return lines


def found(spark, *paths):
    packages = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = wz.read_records(wz.locate_records(packages)).collect()
    assert all(r["valid"] for r in rows)
    return sorted(r["page_id"] for r in rows)


@pytest.mark.parametrize("packed", [True, False])
def test_archives_without_an_index_lose_nothing(spark, tmp_path, packed):
    records = [record(i, packed) for i in range(6)]
    name = "archive/a.warc.gz" if packed else "archive/a.warc"
    assert found(spark, package(tmp_path / "a.zip", {name: records, "archive/b.warc.gz": [record(9)]})) == [*range(6), 9]


def test_deflated_packed_and_partial_indexes(spark, tmp_path):
    records = [record(i) for i in range(6)]
    lines = listing(records)
    all_of = {"archive/a.warc.gz": records}
    deflated = package(tmp_path / "d.zip", all_of, [("indexes/i.cdxj", "\n".join(lines))], zipfile.ZIP_DEFLATED)
    packed = package(
        tmp_path / "p.zip", all_of,
        [("indexes/i.cdx.gz", gzip.compress("\n".join(listing(records, "a.warc.gz")).encode())), ("indexes/i.idx", "no json")],
    )
    partial = package(tmp_path / "q.zip", all_of, [("indexes/i.cdxj", "\n".join(lines[:3]))])
    assert found(spark, deflated, packed, partial) == sorted([*range(6)] * 3)


def test_what_cannot_be_read_is_told(tmp_path):
    path = package(tmp_path / "x.zip", {"archive/a.warc.gz": [record(1)]}, [("indexes/i.cdxj", listing([record(1)], "archive/z.warc.gz")[0])])
    with pytest.raises(ValueError, match="does not hold"):
        list(wz.package_records(wz.RangeReader(path)))
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", record(1))
    with pytest.raises(ValueError, match="by range"):
        list(wz.package_records(wz.RangeReader(str(tmp_path / "y.zip"))))
    cut_off = package(tmp_path / "c.zip", {"archive/a.warc.gz": [record(1), record(2)[:-20]]})
    with pytest.raises(EOFError):
        list(wz.package_records(wz.RangeReader(cut_off)))


def test_reading_tasks_follow_bytes(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 50) for i in range(200)], "page_id long, url string, html string")
    located = wz.locate_records(wz.write_packages(pages.repartition(2), scratch_path(spark, "packages")))
    monkeypatch.setattr(wz, "READ", 5000)
    read = wz.read_records(located)
    assert read.rdd.getNumPartitions() >= 5 and read.count() == 200
