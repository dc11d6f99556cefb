import gzip
import hashlib
import io
import zipfile

import pytest

from planweave.llm import warc
from planweave.llm.common import shared_folder
from planweave.llm.warc import ZipArchive, ZipWriter, open_folder, read_archives, warc_round_trip, write_archives


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip64_packages_open_anywhere():
    out = io.BytesIO()
    writer = ZipWriter(out)
    writer.add("a/é.warc", [b"one", b"", b"two"])
    writer.add("index", [b""])
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a/é.warc") == b"onetwo"
    archive = ZipArchive(Bytes(out.getvalue()))
    assert {m.name: m.size for m in archive.members.values()} == {"a/é.warc": 6, "index": 0}
    assert archive.read(archive.start("a/é.warc"), 6) == b"onetwo"


def test_plain_packages_with_comment_and_compressed_member():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK in a comment"
        z.writestr("s", b"x" * 100)
        z.writestr("d", b"y" * 100, zipfile.ZIP_DEFLATED)
    archive = ZipArchive(Bytes(out.getvalue()))
    assert archive.read(archive.start("s"), 100) == b"x" * 100
    with pytest.raises(ValueError, match="compressed"):
        archive.start("d")
    with pytest.raises(ValueError, match="end of central"):
        ZipArchive(Bytes(b"no archive"))


ROWS = [(1, "u", "a" * 1000), (2, "u", "a" * 1000), (3, None, "a" * 999), (4, "u\r\nx: y", "a" * 999), (5, "u", None), (6, "u", ""), (7, "ü", "é\r\n\r\n" * 300), (None, "u", "a" * 1000), (8, "u", "b" * 3_000_000)]


def expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(i, best.get(h, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = best.get(h) if len(raw) >= 1000 and i is not None and best.get(h) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    for size in (1, 1 << 26):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        assert sorted(map(tuple, warc_round_trip(spark, df).collect()), key=repr) == expected(ROWS)


def test_payloads_and_urls_come_back(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/warc-test"
    store, path = open_folder(folder)
    store.create_dir(path)
    names = spark.createDataFrame(write_archives(df, folder).collect(), "name string")
    got = {r.page_id: r for r in read_archives(names, folder).collect() if r.record_type == "response" and r.page_id}
    for i, u, h in ROWS:
        if i in got:
            assert bytes(got[i].payload).decode() == (h or "")
            assert got[i].url == (u if u is None else u.replace("\r", "%0D").replace("\n", "%0A"))


def test_empty_repeated_and_clashing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_round_trip(spark, empty).count() == 0
    df = spark.createDataFrame([(1, "u", "a" * 2000, 1, "x"), (1, "u", "a" * 2000, 1, "x"), (1, "u", "c" * 2000, 1, "x"), (2, "u", "a" * 2000, 1, "x")], "page_id long, url string, html string, payload int, content string")
    assert sorted((r.page_id, r.refers_to or 0) for r in warc_round_trip(spark, df).collect()) == [(1, 0), (1, 2), (1, 2), (2, 0)]


def test_sql(against_duckdb):
    against_duckdb("op6_warc")


def test_packages_of_others(spark, tmp_path):
    records = [gzip.compress(warc.record(i, "u", b"p%d" % i, hashlib.sha1(b"p%d" % i).hexdigest(), None)) for i in range(4)]
    head = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    with zipfile.ZipFile(tmp_path / "one.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", head + records[0] + records[1])
        z.writestr("archive/b.warc.gz", records[2] + records[3])
        # of b one record is indexed, a has no index
        z.writestr("indexes/index.cdx.gz", gzip.compress(b'u)/ 2024 {"offset": "%d", "length": "%d", "filename": "b.warc.gz"}\n' % (len(records[2]), len(records[3]))))
        z.writestr("datapackage.json", "{}")
    names = spark.createDataFrame([("one.wacz",)], "name string")
    assert sorted((r.page_id, bytes(r.payload)) for r in read_archives(names, str(tmp_path)).collect()) == [(0, b"p0"), (1, b"p1"), (3, b"p3")]


def test_many_members_without_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(65_535):
            z.writestr(str(i), b"")
    assert len(ZipArchive(Bytes(out.getvalue())).members) == 65_535
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("\xe9".encode().decode("cp437")), b"x")
    assert len(ZipArchive(Bytes(out.getvalue())).members) == 1


def test_many_revisits_are_joined_with_the_same_result(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", "same " * 300 if i % 3 else f"own {i} " * 200) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    sent = sorted(map(tuple, warc.warc_round_trip(spark, df).collect()))
    monkeypatch.setattr(warc, "SENT_REVISITS", 0)
    assert sorted(map(tuple, warc.warc_round_trip(spark, df).collect())) == sent and sum(r[3] == "revisit" for r in sent) == 25
