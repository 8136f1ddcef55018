import base64
import hashlib
import json
import re
import time
import uuid
from html.parser import HTMLParser

from pyspark.sql import functions as F

from fieldflow.llm import warc

PAGE = """<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style>
<script>var x = "<p>no</p>";</script></head><body><!-- hidden <a href="/no">x</a> --><p>One &lt;two&gt;</p>
<P>Three<br/>four <a class='k' href='/a?b=1&amp;c=2'>five</a></P><img src=pic.png><noscript>never</noscript>
<ul><li>six</li><li>  seven \t eight</li></ul></body></html>"""
SCHEMA = "page_id long, url string, html string"


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def made(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("payload", "uri", "record_id", "a.b")})
    return warc.derivatives(warc.responses(pages)).collect()


def test_text_and_links():
    assert warc.plain_text(PAGE) == "A & B\nOne <two>\nThree\nfour five\nsix\nseven eight"
    assert warc.links_of(PAGE) == [{"path": "A@/href", "url": "/a?b=1&c=2"}, {"path": "IMG@/src", "url": "pic.png"}]
    assert warc.plain_text("a<script>x") == "a" and warc.plain_text("1 < 2 & 3 > 2") == "1 < 2 & 3 > 2"


def test_marks_that_never_close_cost_no_more_than_their_length():
    for mark in ("<a", "<script", "<title>", "<!--", "<a href='", "<html lang", "</"):
        start = time.thread_time()
        warc.plain_text(mark * 50_000)
        warc.links_of(mark * 50_000)
        warc.title_of(mark * 50_000)
        assert time.thread_time() - start < 10


def test_records_are_linked_and_digested(spark):
    meta, text = sorted(made(spark, [(1, "http://x/y", PAGE)]), key=lambda r: r.record_type, reverse=True)
    assert (meta.record_type, text.record_type) == ("metadata", "conversion")
    assert meta.refers_to == text.refers_to == warc.response_id(1, "http://x/y", sha1(PAGE))
    assert meta.record_id != text.record_id and meta.payload_digest == text.payload_digest == sha1(PAGE)
    for r in (meta, text):
        head = dict(x.split(": ", 1) for x in r.header.split("\r\n")[1:] if x)
        assert r.header.startswith("WARC/1.0\r\n") and r.header.endswith("\r\n\r\n")
        assert head["WARC-Refers-To"] == r.refers_to and head["WARC-Target-URI"] == "http://x/y"
        assert head["WARC-Block-Digest"] == r.block_digest == sha1(r.block)
        assert int(head["Content-Length"]) == len(r.block.encode())
    about = json.loads(meta.block)
    assert about["html"]["title"] == "A & B" and about["html"]["lang"] == "de" and len(about["html"]["links"]) == 2
    assert about["envelope"]["payload-digest"] == sha1(PAGE) and about["envelope"]["http-status"] == 200
    assert about["envelope"]["http-headers"]["Content-Length"] == str(len(PAGE.encode()))
    assert text.block == warc.plain_text(PAGE)


def test_odd_pages(spark):
    rows = [(None, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" * 200_000), (4, "ü", "é" * 100_000), (5, "u", "<a href=>")]
    got = made(spark, rows)
    assert len(got) == 12 and len({r.record_id for r in got}) == 10
    assert {r.block for r in got if r.record_type == "conversion" and r.row_key in (None, 2, 3)} == {""}
    assert made(spark, []) == []


def test_written_files_hold_every_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", PAGE) for i in range(20)], SCHEMA)
    records = warc.responses(pages)
    warc.write_derivatives(records, str(tmp_path / "w"))
    import gzip

    for kind in ("metadata", "conversion"):
        text = "".join(gzip.open(f, "rt", newline="").read() for f in (tmp_path / "w" / f"record_type={kind}").glob("part-*"))
        assert text.count("WARC/1.0\r\n") == 20 and text.endswith("\r\n\r\n")


def test_repeated_headers_and_missing_status(spark):
    blocks = ["HTTP/1.1 302 Found\r\nSet-Cookie: a=1\r\nVia:x\r\nSet-Cookie: b=2: c\r\n\r\n", None, "", "HTTP/1.1", "HTTP/1.1 \r\nA: b\r\n\r\n"]
    schema = "row_key long, uri string, date string, http_header string, payload string"
    records = spark.createDataFrame([(i, "u", warc.DATE, x, "<p>x") for i, x in enumerate(blocks)], schema)
    made = {r.row_key: json.loads(r.block)["envelope"] for r in warc.derivatives(records).collect() if r.record_type == "metadata"}
    assert made[0]["http-headers"] == {"Set-Cookie": ["a=1", "b=2: c"], "Via": "x"}
    assert [made[i]["http-status"] for i in range(5)] == [302, None, None, None, None]
    assert made[1]["http-headers"] == made[3]["http-headers"] == {} and made[4]["http-headers"] == {"A": "b"}


class Reader(HTMLParser):
    """Text and links of a page by a parser of its own."""

    HIDDEN = {"script", "style", "noscript", "template"}
    BREAKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav title blockquote pre".split())
    LINKS = {"a", "link", "img", "script", "iframe"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts, self.links = None, [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        found = [(a, v) for a, v in attrs if a in ("href", "src") and v is not None]
        if tag in self.LINKS and found:
            self.links.append({"path": f"{tag.upper()}@/{found[0][0]}", "url": found[0][1]})
        self.hidden = tag if tag in self.HIDDEN else None
        self.parts.append(" " if self.hidden else "\n" if tag in self.BREAKS else "")

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
        elif tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def handle_comment(self, data):
        self.parts.append(" ")

    def text(self):
        lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def test_every_given_page_against_a_parser(spark, sf_dir):
    """All records of a whole table: links, digests, identifiers and texts made anew in plain Python."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(None, None, None), (10**6, "http://p/", PAGE), (10**6, "http://p/", PAGE)]
    expected = []
    for key, url, page in rows:
        page = page or ""
        read = Reader(page)
        refers = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(['response', str(key), url or '', sha1(page)]))}>"
        expected.append((str(key), refers, str(url), sha1(page), read.text(), read.links))
    got = {}
    for r in made(spark, rows):
        head = [x.partition(": ")[::2] for x in r.header.split("\r\n")[1:] if x]
        names = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", *(["WARC-Target-URI"] if r.uri else [])]
        assert [n for n, _ in head] == [*names, "WARC-Date", "Content-Type", "WARC-Block-Digest", "Content-Length"]
        own = uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join([r.record_type, r.refers_to, sha1(r.block)]))
        assert r.record_id == f"<urn:uuid:{own}>" and dict(head)["WARC-Record-ID"] == r.record_id
        got.setdefault((str(r.row_key), r.refers_to, str(r.uri), r.payload_digest), {}).setdefault(r.record_type, []).append(r.block)
    assert len(rows) == sum(len(x["metadata"]) for x in got.values()) == sum(len(x["conversion"]) for x in got.values())
    for key, refers, url, payload, text, links in expected:
        mine = got[key, refers, url, payload]
        assert set(mine["conversion"]) == {text}
        assert all(json.loads(x)["html"]["links"] == links for x in mine["metadata"])


def test_the_source_record_is_kept(spark):
    """Identifier, date, URI and header lines of a response that has its own WARC header block."""
    block = (
        "WARC/1.1\r\nWARC-Type: response\r\nwarc-record-id: <urn:uuid:11111111-2222-3333-4444-555555555555>\r\n"
        "WARC-Date: 2020-02-02T02:02:02Z\r\nWARC-Target-URI: http://given/\r\nWARC-IP-Address: 10.0.0.1\r\n"
        "WARC-Concurrent-To: <urn:a>\r\nWARC-Concurrent-To: <urn:b>\r\nWARC-Payload-Digest: sha1:GIVEN\r\n\r\n"
    )
    http = "HTTP/1.1 200 OK\r\nB: 1\r\na: 2\r\nb: 3\r\n\r\n"
    schema = "row_key long, uri string, date string, http_header string, payload string, warc_header string"
    rows = [(1, "http://x/", "2024", http, PAGE, block), (2, "http://x/", "2024", http, PAGE, None), (3, None, None, None, None, "")]
    records = spark.createDataFrame(rows, schema)
    got = {(r.row_key, r.record_type): r for r in warc.derivatives(records).collect()}
    assert len(got) == 6
    for kind in ("metadata", "conversion"):
        r = got[1, kind]
        assert (r.refers_to, r.uri, r.date) == ("<urn:uuid:11111111-2222-3333-4444-555555555555>", "http://given/", "2020-02-02T02:02:02Z")
        assert "WARC-Refers-To: <urn:uuid:11111111-2222-3333-4444-555555555555>\r\n" in r.header
        assert got[2, kind].refers_to == warc.response_id(2, "http://x/", sha1(PAGE)) and got[2, kind].date == "2024"
        assert got[3, kind].refers_to == warc.response_id(3, None, sha1(""))
    about = json.loads(got[1, "metadata"].block)["envelope"]
    assert about["warc-header-lines"] == [line.split(": ", 1) for line in block.split("\r\n")[1:-2]]
    assert about["http-header-lines"] == [["B", "1"], ["a", "2"], ["b", "3"]] and about["http-headers"] == {"B": "1", "a": "2", "b": "3"}
    assert about["payload-digest"] == sha1(PAGE) and about["refers-to"] == got[1, "metadata"].refers_to
    assert "warc-header-lines" not in json.loads(got[2, "metadata"].block)["envelope"]
    plain = {(r.row_key, r.record_type): r for r in warc.derivatives(records.drop("warc_header")).collect()}
    assert plain[2, "metadata"] == got[2, "metadata"] and plain[2, "conversion"] == got[2, "conversion"]
