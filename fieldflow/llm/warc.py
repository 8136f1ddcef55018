"""Derivatives of archived web responses: a metadata record and a plain-text record for each response.

A response record has a WARC header block, an HTTP header block and a payload. Its metadata record is a
JSON document with the response's headers and digests and what the page says of itself (title, language,
links); its conversion record is the page's text without markup, scripts and styles. Both refer to the
response by its record identifier, keep its target URI and date, and carry their own block digest.

A response that comes with its own WARC header block (column ``warc_header``) keeps what stands there: both records refer to its
WARC-Record-ID, take its target URI and date, and the metadata holds all its header lines in order, digests included,
beside the digests taken here. Identifiers are made up only where none is given.

Records depend on their own response alone: one pass, no shuffle, and a lost task repeats only its part.

Defined results: a null or empty payload gives a conversion of no bytes and metadata without links; a null
URI is kept as null; made-up identifiers are digests of (row key, URI, payload), so runs agree and repeated rows
repeat their records; no responses give no records; further columns are passed over. A header name that
comes again keeps all its values, as a list, names that differ in case being different, and all header lines also stand in a
list in their order; a header block without a status has a null one; of a WARC header that comes again the first counts, in any
case of letters. Of an unclosed script,
style or comment the rest of the page is dropped, as a browser would.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflow.llm import frames

DATE = "2024-01-01T00:00:00Z"
# Inside a tag no pattern passes a "<", so marks that never close cost no more than their length.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|blockquote|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!?/?[a-zA-Z!][^<>]*>")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^<>]*?\b(href|src)\s*=\s*(\"[^\"<>]*\"|'[^'<>]*'|[^\s<>]+)", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>", re.I)
_TITLE_END = re.compile(r"</title|\Z", re.I)
_STATUS = re.compile(r"HTTP/\S+ +([0-9]{3})(?![^ \r\n])")
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)


def digest(block: bytes) -> str:
    """A labelled digest as WARC headers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(markup: str) -> str:
    """The text of a page, a line per block, without markup, scripts and styles."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", markup)))
    lines = (_BLANK.sub(" ", line).strip() for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(markup: str) -> str | None:
    """The first title's text; null without one."""
    start = _TITLE.search(markup)
    return entities.unescape(markup[start.end() : _TITLE_END.search(markup, start.end()).start()]).strip() if start else None


def links_of(markup: str) -> list[dict]:
    """Tag, attribute and address of every link, in order."""
    found = _LINK.findall(_HIDDEN.sub(lambda m: m[0][: m[0].find(">") + 1] if m[1] else "", markup))
    return [{"path": f"{tag.upper()}@/{attr.lower()}", "url": entities.unescape(url.strip("\"'"))} for tag, attr, url in found]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records from (page_id, url, html): row_key, uri, date, http_header and payload."""
    picked = frames.pick(pages, page_id="long", url="string", html="string")
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload).cast("string")
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return picked.select(
        F.col("page_id").alias("row_key"),
        F.col("url").alias("uri"),
        F.lit(date).alias("date"),
        header.alias("http_header"),
        payload.alias("payload"),
    )


def status_of(http: str) -> int | None:
    """The number in the first line; null without one."""
    found = _STATUS.match(http)
    return int(found[1]) if found else None


def header_lines(block: str) -> list[list[str]]:
    """[name, value] of every header line after the first line of a block, in order."""
    lines = (line.partition(":") for line in block.split("\r\n\r\n")[0].split("\r\n")[1:])
    return [[name, value.strip(" \t")] for name, colon, value in lines if colon]


def headers_of(http: str) -> dict[str, str | list[str]]:
    """Header values by name; those of a name that comes again are a list, in their order."""
    found: dict[str, list[str]] = {}
    for name, value in header_lines(http):
        found.setdefault(name, []).append(value)
    return {name: values if len(values) > 1 else values[0] for name, values in found.items()}


_RECORD = "row_key long, record_type string, record_id string, refers_to string, uri string, date string, header string, block string, block_digest string, payload_digest string"


def _record(key, kind, uri, date, block, refers, extra) -> dict:
    raw = block.encode()
    own = record_id(kind, refers, digest(raw))
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": own,
        "WARC-Refers-To": refers,
        **({"WARC-Target-URI": uri} if uri is not None else {}),
        "WARC-Date": date,
        **extra,
        "WARC-Block-Digest": digest(raw),
        "Content-Length": str(len(raw)),
    }
    header = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return {
        "row_key": key, "record_type": kind, "record_id": own, "refers_to": refers, "uri": uri, "date": date,
        "header": header, "block": block, "block_digest": digest(raw), "payload_digest": None,
    }


def response_id(key, uri, payload_digest: str) -> str:
    return record_id("response", str(key), uri or "", payload_digest)


def _derive(batches):
    fields = [f.strip().split(" ") for f in _RECORD.split(",")]
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in fields])
    for batch in batches:
        out = []
        for key, uri, date, http, payload, own in zip(*(c.to_pylist() for c in batch.columns)):
            whole = digest(payload.encode())
            source = header_lines(own) if own else []
            given = {name.lower(): value for name, value in reversed(source)}
            uri, date = given.get("warc-target-uri", uri), given.get("warc-date", date)
            refers = given.get("warc-record-id") or response_id(key, uri, whole)
            lang = _LANG.search(payload)
            about = {
                "envelope": {
                    "refers-to": refers,
                    "target-uri": uri,
                    "date": date,
                    "block-digest": digest((http + payload).encode()),
                    "payload-digest": whole,
                    "payload-length": len(payload.encode()),
                    "http-headers": headers_of(http),
                    "http-header-lines": header_lines(http),
                    "http-status": status_of(http),
                },
                "html": {
                    "title": title_of(payload),
                    "lang": lang[1] if lang else None,
                    "links": links_of(payload),
                },
            }
            if source:
                about["envelope"]["warc-header-lines"] = source
            meta = json.dumps(about, ensure_ascii=False, sort_keys=True)
            for kind, mime, block in (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", plain_text(payload))):
                record = _record(key, kind, uri, date, block, refers, {"Content-Type": mime})
                out.append(record | {"payload_digest": whole})
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: row_key, record_type, record_id, refers_to, uri, date, header, block, digests.

    A column ``warc_header``, if there is one, holds the response's own WARC header block, from its version line on.
    ``payload_digest`` is that of the response's payload; header and block joined by nothing, and two line
    ends after them, are the record as a file holds it.
    """
    names = ["uri", "date", "http_header", "payload", *(["warc_header"] if "warc_header" in records.columns else [])]
    picked = frames.pick(records, row_key="long", **dict.fromkeys(names, "string"))
    if "warc_header" not in names:
        picked = picked.withColumn("warc_header", F.lit(None).cast("string"))
    return picked.fillna("", ["http_header", "payload"]).mapInArrow(_derive, _RECORD)


def write_derivatives(records: DataFrame, path: str) -> None:
    """A folder of gzip text files a record type; a file is a run of whole records."""
    made = derivatives(records)
    text = F.concat("header", "block", F.lit("\r\n\r")).alias("value")  # and the line end that the writer adds
    made.select(text, "record_type").write.partitionBy("record_type").option("lineSep", "\n").option("compression", "gzip").text(path)
