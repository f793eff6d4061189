import base64
import gzip
import hashlib
import random

import pytest
from brindle.llm import archives as A
from brindle.sources.tables import new_path

PAGES = "page_id long, url string, html string, doc_id int, payload string"


def expected(rows, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by the contract."""
    out, best = [], {}
    for k, _, h in rows:
        data = (h or "").encode()
        if len(data) >= least:
            best[data] = max(best.get(data, k), k, key=lambda x: (x is not None, x))
    for k, _, h in rows:
        data = (h or "").encode()
        revisit = data in best and best[data] != k
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best[data] if revisit else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], PAGES)


def test_pages_come_back(spark):
    rng = random.Random(1)
    bodies = [None, "", "<p>é😀</p>", "a\r\n\r\nWARC/1.1\r\n", "HTTP/1.1 200 OK\r\n\r\nin the text", "\n\n\n", "x" * 300_000, "<b>same</b>", "lone \r"]
    rows = [(k, rng.choice(["http://a.example/x y", "https://b.example/é", None, ""]), rng.choice(bodies)) for k in rng.sample(range(1000), 200)]
    for least in (0, 5):
        found = A.archived_pages(frame(spark, rows).repartition(5), least).collect()
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
        assert sorted(got, key=str) == sorted(expected(rows, least), key=str)
        assert len({r.record_id for r in found}) == len(rows)


def test_identifiers_follow_the_archive_not_its_file(spark):
    rows = [(k, "http://h", f"text {k % 3}") for k in range(30)]
    ids = []
    for _ in range(2):
        path = new_path(spark, "arc")
        A.write_arc(frame(spark, rows).repartition(3, "page_id"), path)
        ids.append({r.record_id for r in A.arc_records(spark, path).collect()})
    assert ids[0] == ids[1] and len(ids[0]) == 30
    assert A.archive_name(A.version_block(2, "f.arc", "1999")) == "f.arc"


def test_null_and_repeated_ids(spark):
    rows = [(None, "http://x", "t"), (4, "http://x", "t"), (4, "http://x", "t"), (5, "http://y", "u"), (5, "http://y", "u")]
    found = A.archived_pages(frame(spark, rows)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in found) == [("4", "response", None), ("4", "revisit", 4), ("5", "response", None), ("5", "revisit", 5), ("None", "revisit", 4)]
    assert A.archived_pages(frame(spark, [])).count() == 0


def test_both_versions_and_declared_lengths():
    for version in (1, 2):
        data = A.version_block(version, "f.arc", "19990102030405") + b"\n"
        data += A.arc_record(version, "http://h/a b", "1999", 12, b"line\nhttp://not/a header 0 0 0 3\n", "f.arc") + b"\n"
        data += A.arc_record(version, "dns:h", "19990102030405", None, b"", "f.arc") + b"\n"
        for stored in (data, gzip.compress(data[:40]) + gzip.compress(data[40:])):
            first, second = A.read_arc(stored)
            assert first.fields["URL"] == "http://h/a%20b" and first.fields["Content-type"] == "text/html"
            assert A.split_http(first.fields["URL"], first.block)[1] == b"line\nhttp://not/a header 0 0 0 3\n"
            assert A.warc_date(first.fields["Archive-date"]) == "1999-01-01T00:00:00Z"
            assert A.split_http("dns:h", second.block)[0] == b""
            assert ("Result-code" in first.fields) == (version == 2)
        with pytest.raises(ValueError, match="cut off"):
            list(A.read_arc(data[:-20]))
    with pytest.raises(ValueError, match="version block"):
        list(A.read_arc(b"http://x 0 0 0 0\n"))
    with pytest.raises(ValueError, match="fields"):
        list(A.read_arc(b"filedesc://x 0.0.0.0 1999 text/plain 12\n1 0 x\nA B C\n"))
    old = b"filedesc://x 0.0.0.0 1999 text/plain 6\n1 0 x\n\nhttp://a b/c 0.0.0.0 1999 text/html 2\nhi\n"
    assert next(A.read_arc(old)).fields["URL"] == "http://a%20b/c"


def test_warc_says_what_is_in_it(spark):
    arc, warc = new_path(spark, "a"), new_path(spark, "w")
    A.write_arc(frame(spark, [(1, "http://x", "same"), (2, "http://y", "same")]), arc)
    A.convert(spark, arc, warc)
    records = [x for r in spark.read.format("binaryFile").load(warc).collect() for x in A.read_warc(bytes(r.content))]
    kinds = {h["warc-type"]: (h, b) for h, b in records}
    assert set(kinds) == {"warcinfo", "response", "revisit"}
    h, block = kinds["revisit"]
    assert h["warc-refers-to"] == kinds["response"][0]["warc-record-id"] and h["warc-refers-to-target-uri"] == "http://y"
    assert block.endswith(b"\r\n\r\n") and b"Content-Length: 4" in block
    assert kinds["response"][0]["warc-block-digest"] == "sha1:" + A.base32_sha1(kinds["response"][1])
