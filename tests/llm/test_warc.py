"""Archives: SQL on the whole table, the ZIP directory, odd pages."""

import gzip
import hashlib
import io
import zipfile

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tidegauge.llm import warc, zips


def test_same_as_sql(spark, data):
    assert not differences(entry.queries()["op3_warc"](spark, data), connect(data), entry.oracle_sql()["op3_warc"])


class Buffer:
    def __init__(self, raw):
        self.raw, self.size = raw, len(raw)

    def read(self, start, length):
        return self.raw[start:start + length]


@pytest.mark.parametrize("comment", [b"", b"x PK\x05\x06 trap " * 5])
@pytest.mark.parametrize("count", [0, 3, 70_000])
def test_directories(count, comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(count):
            with z.open(zipfile.ZipInfo(f"ä{i}"), "w", force_zip64=i % 2 == 0) as f:
                f.write(b"v%d" % i)
        z.comment = comment
    file = Buffer(out.getvalue())
    found = zips.members(file)
    assert len(found) == count
    for i in {0, 1, 2, count - 1} & set(range(count)):
        assert file.read(zips.data_start(file, found[i]), found[i].size) == b"v%d" % i and found[i].name == f"ä{i}"


def test_large_offsets_in_the_zip64_field():
    """A member header beyond 4 GB, told by the extra field of its entry."""
    far = 5 << 30
    entry_ = (b"PK\x01\x02" + bytes(6) + b"\0\0" + bytes(8) + b"\xff" * 8 + (1).to_bytes(2, "little")
              + (28).to_bytes(2, "little") + bytes(10) + b"\xff" * 4 + b"m" + (1).to_bytes(2, "little")
              + (24).to_bytes(2, "little") + (7).to_bytes(8, "little") + (7).to_bytes(8, "little") + far.to_bytes(8, "little"))
    start = far + 100
    end64 = b"PK\x06\x06" + bytes(28) + (1).to_bytes(8, "little") + len(entry_).to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = b"PK\x06\x07" + bytes(4) + (start + len(entry_)).to_bytes(8, "little") + bytes(4)
    tail = entry_ + end64 + locator + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)

    class Far:
        size = start + len(tail)

        def read(self, at, length):
            return (bytes(max(0, start - at)) + tail[max(0, at - start):])[:length] if at < start else tail[at - start:at - start + length]

    member, = zips.members(Far())
    assert (member.name, member.size, member.header) == ("m", 7, far)


PAGES = [(5, "http://a/ü b", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "u", None), (7, "u\r\nEvil: 1", ""), (None, "n", "<p>x</p>"),
         (3, None, "<p>x</p>"), (1, "z", "é" * 5000), (None, "w", "alone"), (None, "w", "both"), (None, "v", "both")]


def test_odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first")
    rows = warc.archived(df).collect()
    assert len(rows) == len(PAGES)
    by = {(r["page_id"], r["payload_digest"]): r for r in rows}
    x = warc.payload_digest(b"<p>x</p>")
    assert (by[3, x]["record_type"], by[3, x]["refers_to"]) == ("response", None)
    assert (by[5, x]["record_type"], by[5, x]["refers_to"], by[5, x]["payload"]) == ("revisit", 3, None)
    assert by[None, x]["refers_to"] == 3 and by[9, warc.payload_digest(b"")]["refers_to"] == 7
    assert by[1, warc.payload_digest("é".encode() * 5000)]["payload"] == bytearray("é".encode() * 5000)
    assert sum(r["record_type"] == "response" for r in rows) == 7
    assert all(r["payload_bytes"] == 8 for r in rows if r["payload_digest"] == x)
    assert {r["record_type"] for r in warc.archived(df, min_bytes=100).collect()} == {"response"}
    assert warc.archived(df.limit(0)).count() == 0


def test_many_slices(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a.wacz"
    out = warc.ArchiveWriter(path)
    texts = [hashlib.sha256(b"%d" % i).hexdigest().encode() * (i % 50) for i in range(300)]
    for i, t in enumerate(texts):
        out.add(warc.record(str(i), "u", t, None, False, "2000-01-01T00:00:00Z"))
    out.close()
    assert zipfile.ZipFile(path).testzip() is None
    with warc.Ranges(path) as file:
        runs = warc.slices_of(file, 5000)
    assert len(runs) > 20 and sum(len(n) for _, n in runs) == 300
    rows = warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    assert sorted((int(r["page_id"]), bytes(r["payload"])) for r in rows) == list(enumerate(texts))


def packed(i):
    return gzip.compress(warc.record(str(i), f"http://h/{i}", b"page %d " % i * (i % 9 * 500), None, False, "2000-01-01T00:00:00Z"), 1, mtime=0)


@pytest.mark.parametrize("index", ["none", "json", "tabs"])
def test_several_members_and_foreign_indexes(spark, tmp_path, index):
    path, parts, lines = f"{tmp_path}/several.wacz", {"a.warc.gz": range(20), "b.warc.gz": range(20, 50), "none.warc.gz": []}, []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        for name, ids in parts.items():
            body = b""
            for i in ids:
                raw = packed(i)
                lines.append((name, i, len(body), len(raw)))
                body += raw
            z.writestr(f"archive/{name}", body)
        lines = lines[::-1] + lines[:3]  # out of order, some twice
        if index == "json":
            z.writestr("indexes/index.cdxj", "!meta\n" * 2 + "\n".join(
                f'com,h)/{i} 2000 {{"url": "http://h/{i}", "filename": "{n}", "offset": "{o}", "length": "{size}"}}' for n, i, o, size in lines))
        elif index == "tabs":
            z.writestr("indexes/places.tsv", "\n".join(f"{o}\t{size}\tarchive/{n}" for n, _, o, size in lines))
    rows = warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    assert sorted((int(r["page_id"]), bytes(r["payload"])) for r in rows) == [(i, b"page %d " % i * (i % 9 * 500)) for i in range(50)]


def test_members_are_walked_in_small_steps_and_bad_places_raise():
    body = b"".join(packed(i) for i in range(12))
    assert [n for _, n in warc._walked(Buffer(b"xx" + body), 2, len(body), 7)] == [len(packed(i)) for i in range(12)]
    with pytest.raises(ValueError, match="within a record"):
        warc._walked(Buffer(body), 0, len(body) - 3)
    for name, line in (("x.warc.gz", "0\t5\ty.warc.gz"), ("x.warc.gz", "0\t999999999"), ("", "0\t1")):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            if name:
                z.writestr(f"archive/{name}", body)
            z.writestr("indexes/i.tsv", line)
        with pytest.raises(ValueError, match="points outside|does not name"):
            warc.located_records(Buffer(out.getvalue()))
