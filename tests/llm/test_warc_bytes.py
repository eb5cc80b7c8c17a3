import gzip
import io

from sensorloom.llm import warc


def record(kind, block, number, length=None, version="1.1", name="Content-Length"):
    length = len(block) if length is None else length
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{name}: {length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response(page, charset="utf-8"):
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + page


def test_version_lines_inside_a_page(spark, tmp_path):
    page = b"<p>a record begins with\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nand so on</p>"
    (tmp_path / "a.warc").write_bytes(record("response", response(page), 1) + record("response", response(b"second"), 2))
    got = {r.record_id: r.payload for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got == {"urn:uuid:1": page.decode(), "urn:uuid:2": "second"}


def test_charsets_and_bytes(spark, tmp_path):
    latin, broken = "caf\u00e9".encode("latin-1"), b"\xff\xfe\x00binary"
    meta = "<meta charset=windows-1252><p>\u20ac</p>".encode("cp1252")
    (tmp_path / "a.warc").write_bytes(record("response", response(latin, "iso-8859-1"), 1) + record("response", response(latin), 2) + record("resource", broken, 3) + record("response", b"HTTP/1.1 200 OK\r\n\r\n" + meta, 4) + record("response", response(b"x", "no-such"), 5))
    got = {r.record_id: r for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got["urn:uuid:1"].payload == got["urn:uuid:2"].payload == "caf\u00e9" and "\u20ac" in got["urn:uuid:4"].payload and got["urn:uuid:5"].payload == "x"
    assert got["urn:uuid:1"].payload_digest == got["urn:uuid:2"].payload_digest
    raw = [bytes(r.raw) for r in warc.read_records(spark, str(tmp_path)).collect() if "resource" in r.headers]
    assert raw == [broken]


def test_lengths_that_are_large_absent_or_no_numbers(spark, tmp_path):
    parts = [record("response", response(b"one"), 1, 3_000_000_000), record("response", response(b"two"), 2), record("response", response(b"three"), 3, "many"), record("response", response(b"four"), 4, name="X-Length"), record("response", response(b"five"), 5)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert [r.complete for r in got] == [False, True, False, False, True] and bytes(got[0].raw).startswith(response(b"one"))
    assert {r.record_id for r in warc.read_responses(spark, str(tmp_path)).collect()} == {"urn:uuid:2", "urn:uuid:5"}


def test_both_versions_and_gzip_members(spark, tmp_path):
    (tmp_path / "old.warc").write_bytes(b"".join(record("response", response(b"old%d" % i), i, version="1.0") for i in range(5)))
    packed = io.BytesIO()
    for i in range(5, 8):
        packed.write(gzip.compress(record("response", response(b"new%d" % i), i)))
    (tmp_path / "new.warc.gz").write_bytes(packed.getvalue())
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "noise.warc").write_bytes(b"this is no record\r\n\r\n")
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert sorted(r.payload for r in got) == [*(f"new{i}" for i in range(5, 8)), *(f"old{i}" for i in range(5))]
    assert warc.read_records(spark, str(tmp_path), "WARC/1.0").count() == 5
    assert warc.derive(warc.read_responses(spark, str(tmp_path))).count() == 16
