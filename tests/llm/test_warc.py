import base64
import gzip
import hashlib
import io

from tessera.llm import warc
from tessera.llm.common import new_path


def pages(spark):
    rows = [(1, "http://a/\r\nx", "<p>same</p>"), (5, "http://b", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://c", None), (4, "http://d", ""), (6, "http://e", "é" * 5000), (None, "http://f", "<p>same</p>"), (7, "u", "\x1f\x8b\x08 not gzip WARC/1.1"), (8, "u", "twice"), (8, "u", "twice")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    df = pages(spark)
    files = warc.write_warc(df, new_path(spark, "warc-test"))
    for size in (64, 1000, 1 << 20):
        got = warc.read_warc(files, range_bytes=size).collect()
        assert len(got) == df.count()
        texts = {(r[0] or -1): (r[2] or "").encode() for r in df.collect()}
        last = {b"<p>same</p>": 5, b"": 4}
        for r in got:
            body = texts[r["page_id"] or -1]
            top = last.get(body, r["page_id"])
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert (r["record_type"], r["refers_to"]) == (("response", None) if top == r["page_id"] else ("revisit", top))
            assert r["payload"] == (body if r["record_type"] == "response" else None)
    assert {r["url"] for r in got if r["page_id"] == 1} == {"http://a/%0D%0Ax"}
    assert sum(r["length"] for r in files.collect()) == sum(r["length"] for r in warc.list_archives(spark, files.first()["path"].rsplit("/", 1)[0]).where("path like '%.gz'").collect())


def test_small_payloads_and_empty_table(spark):
    df = pages(spark)
    kinds = [r["refers_to"] for r in warc.dedupe_payloads(df, min_bytes=12).collect()]
    assert set(kinds) == {None}
    files = warc.write_warc(df.where("false"), new_path(spark, "warc-test"))
    assert files.count() == 0 and warc.read_warc(files).count() == 0


def test_members_are_plain_gzip_and_junk_is_passed_over():
    data = b"".join(warc.member("response", [("WARC-Record-ID", warc.record_id(k))], b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + k]) * k * 50, 6) for k in range(5))
    assert gzip.decompress(data).count(b"WARC/1.1") == 5
    junk = b"\x1f\x8b\x08junk" + data[:300] + b"\x1f\x8b\x08" + data

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    whole = [o for o, _ in warc.RangeScanner(File(junk), len(junk), 0, len(junk)).records()]
    for step in (7, 100, 999):
        parts = [o for s in range(0, len(junk), step) for o, _ in warc.RangeScanner(File(junk), len(junk), s, min(s + step, len(junk))).records()]
        assert set(whole) <= set(parts) and len(parts) == len(set(parts))
    assert warc.page_of(warc.record_id(-3)) == -3 and warc.page_of(warc.record_id(None)) is None
