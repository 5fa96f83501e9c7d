import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf_dir}/pages.parquet'")
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in warc.op5_arc_to_warc(spark, sf_dir).collect()), key=key) == sorted(con.execute(warc.OP5_SQL).fetchall(), key=key)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\n\nhttp://x 0.0.0.0 20240101000000 text/html 3\nabc", b"\x00\xff raw \r\n", b"", b"HTTP/1.1 204 No Content\r\nA: b\r\n\r\n"]
    data = warc.write_arc("a.arc", version, [(f"http://h/{i}", "20240229123456", b) for i, b in enumerate(blocks)])
    assert [b for _, b, _ in warc.read_arc(data)][1:] == blocks
    got = list(warc.convert(data))
    assert [g[2] for g in got] == ["warcinfo", "response", "resource", "resource", "response"]
    assert got[1][0] == 5 and got[1][4] == "2024-02-29T12:34:56Z" and got[1][9].startswith(b"body")
    assert got[1][10] == hashlib.sha1(got[1][9]).hexdigest() and len({g[1] for g in got}) == 5
    assert {g[7] for g in got[1:]} == {got[0][1]} and got[0][7] is None
    assert list(warc.convert(data)) == got
    names = list(warc.read_arc(data))[1][0]
    assert list(names) == warc.FIELDS[version]


V1 = (
    b"filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain 200\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 124 + b"\n"
    b"\nhttp://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html 57\nHTTP/1.0 200 Document follows\r\nServer: X\r\n\r\n<html></html>\n"
    b"\ndns:www.dryswamp.edu 10.0.0.1 19961104142100 text/dns 32\n19961104 www.dryswamp.edu 1.2.3.\n"
    b"\nhttp://h/a page with blanks.html 1.2.3.4 1997 text/html; charset=iso-8859-1 3\nabc\n"
)
V2_HEAD = b"2 0 Somebody\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = (
    b"filedesc://f2.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 f2.arc " + str(len(V2_HEAD)).encode() + b"\n" + V2_HEAD
    + b"\nhttp://x/y z 9.9.9.9 20010203040506 text/html 200 fac069150613fe55599cc7fa88aa089d - 209 f2.arc 26\nHTTP/1.0 200 OK\r\n\r\n<p>body\n"
    + b"\ndns:x 8.8.8.8 20010203040505 text/dns 1 - - 400 f2.arc 5\nanswr\n"
)


def test_archives_written_by_hand():
    got = list(warc.convert(V1, "one"))
    assert [(g[2], g[3], g[4], g[5], g[6]) for g in got[1:]] == [
        ("response", "http://www.dryswamp.edu:80/index.html", "1996-11-04T14:21:03Z", "127.10.100.2", "application/http; msgtype=response"),
        ("resource", "dns:www.dryswamp.edu", "1996-11-04T14:21:00Z", "10.0.0.1", "text/dns"),
        ("resource", "http://h/a%20page%20with%20blanks.html", "1997-01-01T00:00:00Z", "1.2.3.4", "text/html;charset=iso-8859-1"),
    ]
    assert got[0][2:4] == ("warcinfo", "IA-001102.arc") and b"converted from the ARC file IA-001102.arc, version 1 0 Alexa" in got[0][9]
    assert got[1][9] == b"<html></html>" and got[3][9] == b"abc" and got[2][9].startswith(b"19961104 www")
    two = list(warc.convert(V2))
    assert [(g[2], g[3], g[5], g[6]) for g in two[1:]] == [("response", "http://x/y%20z", "9.9.9.9", "application/http; msgtype=response"), ("resource", "dns:x", "8.8.8.8", "text/dns")]
    assert two[1][9] == b"<p>body"
    assert len({g[1] for g in got + two + list(warc.convert(V1, "other"))}) == len(got) * 2 + len(two)


def test_bad_records_are_reported_and_passed_over(spark):
    broken = V1.replace(b"text/dns 32\n", b"text/dns x\n") + b"http://late/ 1.1.1.1 20000101000000 text/plain 2\nok\nhttp://cut/ 1.1.1.1 2000 text/plain 99999\nrest"
    found = []
    got = [g[3] for g in warc.convert(broken, "b", found)]
    assert got == ["IA-001102.arc", "http://www.dryswamp.edu:80/index.html", "http://h/a%20page%20with%20blanks.html", "http://late/"]
    assert len(found) == 2 and "header" in found[0][1] and "length" in found[1][1] and broken[found[0][0] :].startswith(b"dns:")
    rows = [("b", bytearray(broken)), ("v2", bytearray(V2)), ("junk", bytearray(b"http://h/ junk\n")), ("none", None), ("empty", bytearray(b""))]
    files = spark.createDataFrame(rows, "name string, data binary")
    assert warc.from_arc(files).count() == 4 + 3
    assert sorted((r.name, r.place) for r in warc.problems_of(files).collect()) == sorted([("b", found[0][0]), ("b", found[1][0]), ("junk", 0)])
    assert warc.from_arc(files.limit(0)).count() == 0 == warc.problems_of(files.limit(0)).count()


def test_malformed_archives():
    good = warc.write_arc("a.arc", 1, [("http://h/", "2024", b"xyz")])
    assert list(warc.convert(good))[1][4] == "2024-01-01T00:00:00Z"
    for bad in (good.replace(b"text/html 3\n", b"text/html 300\n"), good.replace(b"text/html 3\n", b"text/html x\n"), good.replace(b"http://h/ 0.0.0.0", b"http://h/"), b"http://h/ junk\n", good.replace(b"\n1 0 ", b"\n9 0 ")):
        with pytest.raises(warc.ArcError):
            list(warc.convert(bad))
    assert list(warc.read_arc(b"")) == []


def test_repeated_rows_have_identifiers_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x")] * 5, "page_id long, url string, html string").repartition(3)
    assert warc.from_arc(warc.to_arc(pages)).where("type = 'response'").select("record_id").distinct().count() == 5


def test_edge_cases(spark, monkeypatch):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a b/\n", None), (2, None, ""), (3, "u", big), (9, "u", big), (4, "v", big), (5, "w", other), (5, "w", other), (6, "s", "short"), (7, "s", "short"), (None, "n", big), (None, "n", "alone " * 400), (None, "n", "alone " * 400), (8, "l", "WARC/1.1\r\n\r\n" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("date", F.lit(1))
    want = []
    for page_id, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(b) >= 1000 and same and page_id != max(same)
        want.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    for size in (8 << 20, 100):
        monkeypatch.setattr(warc, "ARC_BYTES", size)
        monkeypatch.setattr(warc, "WARC_BYTES", size)
        assert sorted((tuple(r) for r in warc.archived(pages).collect()), key=str) == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000)], "page_id long, url string, html string")
    warc.write_warc(warc.deduplicated(warc.from_arc(warc.to_arc(pages))), f"{tmp_path}/w", 100)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    got = {h["WARC-Type"]: (h, b) for h, b in warc.parse_warc(data)}
    assert set(got) == {"response", "revisit", "warcinfo"}
    assert got["response"][0]["WARC-Warcinfo-ID"] == got["warcinfo"][0]["WARC-Record-ID"] and got["warcinfo"][0]["Content-Type"] == "application/warc-fields"
    assert got["revisit"][0]["WARC-Refers-To"] == got["response"][0]["WARC-Record-ID"]
    assert got["revisit"][0]["WARC-Payload-Digest"] == got["response"][0]["WARC-Payload-Digest"]
    assert got["response"][1].endswith(b"x" * 2000) and b"xxx" not in got["revisit"][1]


def test_addresses_and_types_are_kept(spark, tmp_path):
    files = spark.createDataFrame([("one", bytearray(V1))], "name string, data binary")
    warc.write_warc(warc.deduplicated(warc.from_arc(files)), f"{tmp_path}/w", 100, "none")
    got = {h.get("WARC-Target-URI"): h for p in (tmp_path / "w").glob("part-*") for h, _ in warc.parse_warc(p.read_bytes())}
    dns = got["dns:www.dryswamp.edu"]
    assert dns["WARC-IP-Address"] == "10.0.0.1" and dns["Content-Type"] == "text/dns" and dns["WARC-Type"] == "resource"
    assert got[None]["WARC-Filename"] == "IA-001102.arc" and "WARC-IP-Address" not in got[None]
