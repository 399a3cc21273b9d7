"""Archives not written here: records framed by their length, each a gzip member of its own."""

import gzip

from tracewing.llm import warc


def record(kind, block, *fields, version="WARC/1.0", end="\r\n"):
    lines = [version, f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
    return end.join(lines).encode() + end.encode() * 2 + block + b"\r\n\r\n"


HTML = "<p>é WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc</p>".encode()
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def archive():
    return [
        record("warcinfo", b"software: other/1.0\r\nformat: WARC File Format 1.0\r\n", "WARC-Filename: a.warc.gz", "Content-Type: application/warc-fields"),
        record("response", HTTP + HTML, "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("revisit", HTTP, "WARC-Refers-To: <urn:x>", "Content-Type: application/http;msgtype=response", version="WARC/1.1"),
        record("resource", bytes(range(256)) * 50, "warc-target-uri: http://b/", "X-Long: one", "  two", end="\n"),
        record("resource", b""),
        record("metadata", b"WARC/" * 400 + b"WARC/1.0\r\n\r\n\r\n"),
    ]


def read(spark, path):
    return sorted(warc.read_records(spark, str(path)).collect(), key=lambda r: (r.file, r.offset))


def check(rows):
    assert [r.fields["warc-type"] for r in rows] == ["warcinfo", "response", "request", "revisit", "resource", "resource", "metadata"]
    assert [r.offset for r in rows] == list(range(7)) and all(r.complete for r in rows)
    assert rows[0].version == "WARC/1.0" and rows[3].version == "WARC/1.1"
    assert bytes(rows[1].payload) == HTML and bytes(rows[1].block) == HTTP + HTML
    assert rows[1].fields["warc-target-uri"] == "http://a/" and rows[3].fields["warc-refers-to"] == "<urn:x>"
    assert bytes(rows[2].payload) == bytes(rows[3].payload) == bytes(rows[5].payload) == b""
    assert bytes(rows[4].payload) == bytes(range(256)) * 50 and rows[4].fields["x-long"] == "one two"
    assert bytes(rows[6].block).startswith(b"WARC/WARC/") and len(rows[6].block) == 2014


def test_a_member_for_each_record(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, archive())))
    check(read(spark, tmp_path))


def test_plain_files_cut_anywhere(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(archive()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000b", "3777b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            check(read(spark, tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_damage_and_emptiness(spark, tmp_path):
    records = archive()
    (tmp_path / "a.warc").write_bytes(b"junk before\r\n" + records[1] + records[4][:-100])
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"no archive, though it has WARC/1.0 in it")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(records[5]))
    rows = read(spark, tmp_path)
    assert [(r.file[-6:], r.fields["warc-type"], r.complete) for r in rows] == [
        ("a.warc", "response", True), ("a.warc", "resource", False), ("arc.gz", "resource", True),
    ]


def test_archives_written_here_are_framed_too(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é"), (2, "u", "é"), (3, None, None)], "page_id long, url string, html string")
    warc.write_archive(warc.plan_revisits(warc.records(pages)), str(tmp_path / "own"))
    rows = read(spark, tmp_path / "own")
    assert sorted((r.fields["x-page-id"], r.fields["warc-type"], bytes(r.payload), r.complete) for r in rows) == [
        ("1", "revisit", b"", True), ("2", "response", "é".encode(), True), ("3", "response", b"", True),
    ]
