r"""Derived records of web archives: of each response a metadata record with its links and a conversion record with its plain text.

Records are rows: record_id, record_type, refers_to, target_uri, date, content_type, content_length, block_digest, payload_digest, headers, block.
A derived record refers to its response and keeps its target, date, payload digest and all of the response's headers, names in lower case; a metadata
record lists them in its block too, and a file of derived records has them in a named field. Digests are labelled (sha256:hex). Extraction is regular
expressions that Java's engine and RE2 read alike; none goes back over a page, so an unclosed comment, script, style or title takes the rest of its page.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# What text extraction takes out, puts a line end for, and reads as a character.
DROPPED = r"(?is)<!--(?:.*?-->|.*)|<script\b(?:.*?</script[^<>]*>|.*)|<style\b(?:.*?</style[^<>]*>|.*)|<title\b(?:.*?</title[^<>]*>|.*)"
LINE = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>"
TAG = r"<[!/?A-Za-z][^<>]*>"
BLANK, LINES = r"[ \t\x0B\f\r\x{A0}]+", r" ?\n[ \n]*"
TITLE = r"(?i)<title\b[^<>]*>([^<]*)"
HREF = r"(?i)<a\b[^<>]*?\bhref\s*=\s*[\"']([^\"'>]*)[\"']"
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "euro": "€", "laquo": "«", "raquo": "»", "amp": "&"}

RECORD = ["record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "headers", "block"]
#: The date of records of pages that come without one.
NO_DATE = "1970-01-01T00:00:00Z"


def unescaped(c: Column) -> Column:
    for name, character in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(character))
    return c


def plain_text(html: Column) -> Column:
    """Visible text: a line for each block of the page, blanks joined, no empty lines. The title is metadata."""
    text = F.regexp_replace(html, DROPPED, "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\n]", " "), LINE, "\n")
    text = unescaped(F.regexp_replace(text, TAG, ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BLANK, " "), LINES, "\n"), r"^[ \n]+|[ \n]+$", "")


def title_of(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescaped(F.regexp_extract(html, TITLE, 1)), r"[ \t\n\x0B\f\r]+", " "), "^ | $", "")


def links_of(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """pages (page_id, url, html; others ignored) as response records, with `payload` beside the record's columns.

    The record's id comes from page_id and url, so rows that repeat both repeat the id. A null page is an empty one, a null url is empty.
    """
    url, payload = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    base = pages.select(F.col("page_id").cast("string").alias("page"), url.alias("target_uri"), payload.alias("payload"), http.alias("http"))
    headers = F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("content-length"), F.octet_length("payload").cast("string"))
    block = F.concat("http", "payload")
    return base.select(
        _urn(F.coalesce("page", F.lit("")), F.col("target_uri")).alias("record_id"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.octet_length(block).cast("long").alias("content_length"), _digest(block).alias("block_digest"), _digest(F.col("payload")).alias("payload_digest"), headers.alias("headers"), block.alias("block"), "payload",
    )


def derive(records: DataFrame) -> DataFrame:
    """Two records of each response (rows of other types are left out): metadata and conversion, columns RECORD.

    Ids come from the response's id and the new type, so a second run gives the same. No shuffle; a page is one row throughout. A response without `payload`
    (as read_warc() gives it) is cut at its first empty line.
    """
    own = records.where("record_type = 'response'")
    if "payload" not in records.columns:
        own = own.withColumn("payload", F.when(F.instr("block", "\r\n\r\n") > 0, F.expr("substring(block, instr(block, '\r\n\r\n') + 4)")).otherwise(F.col("block")))
    about = F.to_json(F.struct(F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", "block_digest", F.col("headers").alias("source_headers"), title_of(F.col("payload")).alias("title"), links_of(F.col("payload")).alias("links")))
    blocks = F.array(F.struct(F.lit("metadata").alias("type"), F.lit("application/json").alias("ct"), about.alias("block")), F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("ct"), plain_text(F.col("payload")).alias("block")))
    each = own.select("record_id", "target_uri", "date", "payload_digest", "headers", F.explode(blocks).alias("b"))
    return each.select(
        _urn(F.col("record_id"), F.col("b.type")).alias("record_id"), F.col("b.type").alias("record_type"), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("b.ct").alias("content_type"),
        F.octet_length("b.block").cast("long").alias("content_length"), _digest(F.col("b.block")).alias("block_digest"), "payload_digest", "headers", F.col("b.block").alias("block"),
    )


_FIELDS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest"}
#: The field of a derived record that keeps its response's headers, as JSON in ASCII.
_HEADERS = "X-Source-Headers"
#: Bytes that are unpacked at a time, and characters of blocks in a batch.
_STEP, _BATCH = 1 << 20, 1 << 24


def warc_member(record) -> bytes:
    """One record as a gzip member of a WARC file."""
    block = (record["block"] or "").encode("utf-8", "surrogatepass")
    lines = ["WARC/1.1"]
    for field, column in _FIELDS.items():
        if (value := record[column]) is not None:
            lines.append(f"{field}: {f'<{value}>' if column in ('record_id', 'refers_to') else value}")
    if record["record_type"] != "response" and record["headers"]:
        lines.append(f"{_HEADERS}: {json.dumps(dict(record['headers']))}")
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def warc_members(records: DataFrame) -> DataFrame:
    """record_id and member: members in any order, put one after another, are a .warc.gz file."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record_id": batch["record_id"], "member": [warc_member(r) for r in batch.to_dict("records")]})

    return records.select(*_FIELDS.values(), "headers", "block").mapInPandas(make, "record_id string, member binary")


def _unpacked(data: bytes) -> Iterator[bytes]:
    """A file's bytes, gzip members unpacked a part at a time; a member that is cut or broken ends it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while at < len(data) and not member.eof:
            part = data[at : at + _STEP]
            try:
                yield member.decompress(part)
            except zlib.error:
                return
            at += len(part) - len(member.unused_data)


class _Buffer:
    """What is unpacked of a file and not yet read."""

    def __init__(self, data: bytes):
        self.parts, self.held = _unpacked(data), bytearray()

    def _more(self) -> bool:
        part = next(self.parts, None)
        self.held += part or b""
        return part is not None

    def to(self, mark: bytes) -> bytes | None:
        """Up to the mark, which goes too; None, and nothing left, without one."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                self.held.clear()
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self._more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _pairs(lines: list[str]) -> dict[str, str]:
    """Header lines by name in lower case; values of a repeated name are joined by commas."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, gzipped or plain, with `raw` (the block's bytes) beside the record's columns.

    One record is unpacked at a time. A record whose length is no number is left out, and reading goes on at the next one; a record
    that the file's end cuts short, or whose gzip member is broken, is left out with all after it. block is the bytes as UTF-8, what is no UTF-8 replaced;
    lengths and digests are those of the bytes.
    """
    buffer = _Buffer(data)
    while buffer.to(b"WARC/") is not None and (head := buffer.to(b"\r\n\r\n")) is not None:
        fields = _pairs(head.decode("utf-8", "replace").split("\r\n")[1:])
        length = fields.get("content-length", "")
        if not length.isascii() or not length.isdigit():
            continue
        raw = buffer.take(int(length))
        if raw is None:
            return
        out = {column: fields.get(field.lower()) for field, column in _FIELDS.items()}
        out |= {c: out[c].strip("<>") for c in ("record_id", "refers_to") if out[c]}
        if out["record_type"] == "response":
            headers = _pairs(raw.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:])
        else:
            try:
                headers = {str(k): str(v) for k, v in json.loads(fields.get(_HEADERS.lower(), "{}")).items()}
            except (ValueError, AttributeError):
                headers = {}
        yield out | {"content_length": int(length), "headers": headers, "block": raw.decode("utf-8", "replace"), "raw": raw}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: columns RECORD and `raw`, the block's bytes. A file is read by one task, which holds it packed and one batch of records."""
    schema = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, headers map<string,string>, block string, raw binary"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for row in parse(bytes(data)):
                    rows.append(row)
                    size += row["content_length"]
                    if size >= _BATCH:
                        yield pd.DataFrame(rows, columns=[*RECORD, "raw"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=[*RECORD, "raw"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return derive(responses(read(spark, sf_dir, "pages"))).withColumn("headers", F.to_json("headers"))


def _sql_unescaped(x: str, names=ENTITIES) -> str:
    for name in names:
        x = f"replace({x}, '&{name};', '{ENTITIES[name].replace(chr(39), chr(39) * 2)}')"
    return x


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {by}, 'g')"


_TEXT = _sub(_sub(_sub(_sql_unescaped(_sub(_sub(_sub(_sub("payload", DROPPED, "''"), r"[\n]", "' '"), LINE, "chr(10)"), TAG, "''")), BLANK, "' '"), LINES, "chr(10)"), r"^[ \n]+|[ \n]+$", "''")
_NAME = _sub(_sub(_sql_unescaped(f"regexp_extract(payload, {_quoted(TITLE)}, 1)"), r"[ \t\n\x0B\f\r]+", "' '"), "^ | $", "''")


def _sql_urn(x: str) -> str:
    cut = " || '-' || ".join(f"substr(md5({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'urn:uuid:' || {cut}"


SQL = f"""
WITH r AS (
  SELECT coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, {_sql_urn("coalesce(page_id::text, '') || chr(10) || coalesce(url, '')")} AS id FROM pages),
p AS (
  SELECT *, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload)::text || chr(13) || chr(10) || chr(13) || chr(10) || payload) AS response_digest FROM r),
b AS (
  SELECT *, 'metadata' AS record_type, 'application/json' AS content_type, to_json({{'refers_to': id, 'target_uri': target_uri, 'date': '{NO_DATE}', 'payload_digest': payload_digest, 'block_digest': response_digest,
    'source_headers': {{'content-type': 'text/html; charset=utf-8', 'content-length': strlen(payload)::text}}, 'title': {_NAME}, 'links': list_transform(regexp_extract_all(payload, {_quoted(HREF)}, 1), lambda x: replace(x, '&amp;', '&'))}})::text AS block FROM p
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {_TEXT} FROM p)
SELECT {_sql_urn("id || chr(10) || record_type")} AS record_id, record_type, id AS refers_to, target_uri, '{NO_DATE}' AS date, content_type, strlen(block)::bigint AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest,
  to_json({{'content-type': 'text/html; charset=utf-8', 'content-length': strlen(payload)::text}})::text AS headers, block FROM b
"""
