import gzip
import hashlib
import json

from lexloom.llm import warc

from compare import same

PAGE = '<!DOCTYPE html><html><head><title> A &amp;\n B </title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One <b>two</b>&nbsp;three<br>four</p><a HREF=\'/x?a=1&amp;b=2\'>link</a><a class="k" href="http://e/">e</a> 1 < 2 &lt;b&gt;</body></html>'


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, block string, payload string")


def test_records(spark):
    source = warc.responses(pages(spark, [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (None, "http://c/", "plain & é")])).cache()
    derived = warc.derive(source).collect()
    assert len(derived) == 8 and len({r.record_id for r in derived}) == 8
    by = {r.record_id: r for r in source.collect()}
    for r in derived:
        of = by[r.refers_to]
        assert (r.target_uri, r.date, r.payload_digest, r.headers) == (of.target_uri, of.date, of.payload_digest, of.headers)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert of.payload_digest == "sha256:" + hashlib.sha256(of.payload.encode()).hexdigest()
    of = lambda uri, kind: next(r for r in derived if r.target_uri == uri and r.record_type == kind)
    assert of("http://a/", "conversion").block == "One two three\nfour\nlinke 1 < 2 <b>"
    about = json.loads(of("http://a/", "metadata").block)
    assert about["title"] == "A & B" and about["links"] == ["/x?a=1&b=2", "http://e/"] and about["source_headers"] == {"content-type": "text/html; charset=utf-8", "content-length": str(len(PAGE.encode()))}
    assert of("", "conversion").block == "" and of("http://c/", "conversion").block == "plain & é"


def test_files(spark, tmp_path):
    source = warc.responses(pages(spark, [(1, "http://a/", PAGE), (2, "http://b/", "WARC/1.0\r\n\r\n tricky")]))
    derived = warc.derive(source)
    every = source.drop("payload").unionByName(derived)
    members = [bytes(r.member) for r in warc.warc_members(every).collect()]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    back = warc.read_warc(spark, str(tmp_path / "x.warc.gz"))
    key = lambda r: (r.record_id, r.record_type, r.refers_to, r.target_uri, r.content_length, r.block_digest, r.payload_digest, sorted(r.headers.items()), r.block)
    assert sorted(map(str, map(key, back.collect()))) == sorted(map(str, map(key, every.collect())))
    again = warc.derive(back)
    assert sorted(r.block for r in again.collect() if r.record_type == "conversion") == sorted(r.block for r in derived.collect() if r.record_type == "conversion")


def member(lines, block):
    return gzip.compress("\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block + b"\r\n\r\n")


def test_broken_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nx-Own: 1\r\nX-OWN: 2\r\n\r\n<p>\xe9t\xe9 \xff</p>"
    whole = member(["WARC-Type: response", "WARC-Record-ID: <urn:a>", "WARC-Target-URI: http://a/", f"Content-Length: {len(http)}"], http)
    bad = member(["WARC-Type: response", "Content-Length: -3"], b"xyz")
    none = member(["WARC-Type: response"], b"xyz")
    for name, data, n in (("whole", whole, 1), ("bad length", bad + none + whole, 1), ("cut", whole + whole[:-20], 1), ("cut in its head", whole + whole[:15], 1), ("broken", whole + whole[:30] + b"\0" * 40, 1), ("plain", gzip.decompress(whole) * 2, 2), ("cut plain", gzip.decompress(whole)[:-30], 0), ("empty", b"", 0), ("noise", b"\x1f\x8bnoise", 0), ("padded", whole + b"\0" * 9, 1)):
        assert len(list(warc.parse(data))) == n, name
    (tmp_path / "x.warc.gz").write_bytes(whole)
    got = warc.read_warc(spark, str(tmp_path / "x.warc.gz"))
    row = got.first()
    assert bytes(row.raw) == http and row.content_length == len(http) and "\ufffd" in row.block and row.headers == {"content-type": "text/html", "x-own": "1, 2"}
    derived = {r.record_type: r for r in warc.derive(got).collect()}
    assert json.loads(derived["metadata"].block)["source_headers"] == row.headers == derived["conversion"].headers
    assert list(warc.parse(warc.warc_member(derived["conversion"])))[0]["headers"] == row.headers


def test_pages_that_close_nothing(spark):
    """Linear in the page's length: these would take hours otherwise."""
    n = 200_000
    rows = [(1, "a", "kept <script>x" * n), (2, "b", "<p" * n), (3, "c", "<!--" * n), (4, "d", "<title>" * n), (5, "e", "<a href" * n), (6, "f", "x" + "</script" * n), (7, "g", "&" * n + "<b>y")]
    texts = {r.target_uri: r.block for r in warc.derive(warc.responses(pages(spark, rows))).collect() if r.record_type == "conversion"}
    assert texts["a"] == "kept" and texts["c"] == texts["d"] == "" and texts["g"].endswith("y")


def test_query(spark, sf):
    same(warc.query(spark, sf), warc.SQL, sf)


def test_empty(spark):
    assert warc.derive(warc.responses(pages(spark, []))).count() == 0
