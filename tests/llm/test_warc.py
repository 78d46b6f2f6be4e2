import glob
import gzip
import hashlib
import os

import pytest

from chronocohort.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def archive(spark, tmp_path, rows):
    folder = str(tmp_path / "archives")
    warc.write(warc.plan(spark.createDataFrame(rows, PAGES)), folder)
    return folder


def test_round_trip(spark, tmp_path):
    same, big = "é" * 700, "x" * (17 << 20)
    rows = [(1, "http://a/\r\nX: y", same, "clash"), (5, None, same, None), (5, "http://b", same, None), (3, "http://c", "short", None), (4, "http://d", "short", None), (None, "http://e", same, None), (7, "", None, None), (8, "u", big, None), (9, "u", "", None)]
    folder = archive(spark, tmp_path, rows)
    got = sorted(warc.read(spark, folder).collect(), key=lambda r: (r.page_id is None, r.page_id, r.url or ""))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    assert [r.page_id for r in got] == [w[0] for w in want]
    for r, (page, url, html, _) in zip(got, want):
        data = (html or "").encode()
        revisit = html == same and page != 5
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to, r.verified) == (("revisit", 5, False) if revisit else ("response", None, True))
        assert r.payload == (None if revisit else data)
    assert got[0].url == "http://a/%0D%0AX:%20y"


def test_files_are_plain_gzip_members(spark, tmp_path):
    folder = archive(spark, tmp_path, [(i, f"http://p/{i}", f"<p>{i}</p>", None) for i in range(30)])
    files = [f for f in glob.glob(f"{folder}/**/*", recursive=True) if os.path.basename(f).startswith("part-")]
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert data.count(b"WARC/1.1\r\n") == 30


def test_damage_is_found(spark):
    one = warc.member(1, "u", b"payload", None)
    assert len(list(warc.Reader(memoryview(one + one)))) == 2
    with pytest.raises(ValueError):
        list(warc.Reader(memoryview(one + one[:-20])))
    import zlib

    wrong = zlib.compress(zlib.decompress(one, 31).replace(b"payload", b"paxload"), wbits=31)
    with pytest.raises(ValueError):
        [warc._row(h, b, True) for h, b in warc.Reader(memoryview(wrong))]


def test_archives_are_cut_by_bytes(spark, tmp_path):
    folder = str(tmp_path / "small")
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 20, None) for i in range(50)]
    warc.write(warc.plan(spark.createDataFrame(rows, PAGES).coalesce(1)), folder, archive_bytes=4000)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{folder}/*/part-*")]
    assert len(sizes) > 3 and max(sizes) <= 4000
    assert warc.read(spark, folder, with_payload=False).where("payload is null").count() == 50


def test_empty(spark, tmp_path):
    assert warc.read(spark, archive(spark, tmp_path, [])).count() == 0
