import base64
import hashlib

from quarry.llm.common import shared_dir
from quarry.llm.warc import archive_digests, export_warc, read_archive, write_archive

ROWS = [(5, "http://a/", "<p>x</p>"), (2, "http://b/ x\r\ny", "<p>x</p>"), (3, None, "é" * 50000), (4, "u", None), (6, "v", ""), (7, "w", "unique"), (9, "http://c", "<p>x</p>"), (9, "http://c", "<p>x</p>")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*r, b"clash") for r in ROWS], "page_id long, url string, html string, payload binary")
    out = archive_digests(pages).collect()
    assert len(out) == len(ROWS) and all(r.verified for r in out)
    first = {}
    for p, _, h in ROWS:
        first[h or ""] = min(p, first.get(h or "", p))
    html = {p: h or "" for p, _, h in ROWS}
    for r in out:
        body = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        lead = first[html[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == lead else ("revisit", lead))
    folder = f"{shared_dir(spark)}/warc-test"
    write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len(set(html.values()))
    for r in read_archive(spark, folder).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert bytes(r.payload) == html[r.page_id].encode() and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert body == (html[r.page_id].encode() if b"Type: response" in head else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head
    assert archive_digests(pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark):
    folder = f"{shared_dir(spark)}/warc-small"
    write_archive(spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id long, url string, html string"), folder, min_bytes=3)
    assert {r.header.split("\r\n")[1] for r in read_archive(spark, folder).collect()} == {"WARC-Type: response"}


def records_of(data):
    """(headers, body) of the records of a WARC file, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines[1:])
        body = end + 4
        stop = body + int(head["Content-Length"])
        yield head, data[body:stop]
        assert data[stop : stop + 4] == b"\r\n\r\n"
        at = stop + 4


def test_exported_files_are_read_by_content_length(spark, tmp_path):
    folder = f"{shared_dir(spark)}/warc-export"
    rows = [(f"p {i}\n>" if i % 4 == 0 else str(i), f"http://a/{i}", t) for i, t in enumerate(["a\r\n\r\nWARC/1.1\r\n", "\n\n", None, "\u00e9\n" * 5000, "a\r\n\r\nWARC/1.1\r\n", "x", "x\n"])]
    write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), folder)
    export_warc(spark, folder, f"file://{tmp_path}/out")
    found = [r for f in sorted((tmp_path / "out").glob("part-*")) for r in records_of(f.read_bytes())]
    assert len(found) == len(rows)
    of = {h["WARC-Record-ID"]: (h, b) for h, b in found}
    for page, url, text in rows:
        head, body = next(v for v in of.values() if v[0]["WARC-Target-URI"] == url)
        if head["WARC-Type"] == "revisit":
            head, body = of[head["WARC-Refers-To"]]
        assert body == (text or "").encode()
        assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    out = {r.page_id: r for r in archive_digests(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert out["p 4\n>"].refers_to == "p 0\n>" and all(r.verified for r in out.values())
