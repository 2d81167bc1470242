"""WARC derivative builder: linked metadata and plain-text conversion records from responses.

Pages become response records with the headers and digests a crawler gives them. From each response
two records are derived: a metadata record (outlinks, title, language, length) and a conversion
record (the page's plain text). Both name the response in WARC-Refers-To and carry over its
WARC-Target-URI, WARC-Date and WARC-Payload-Digest; each has its own block digest. Records can be
written to, and read from, WARC/1.1 bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_REST = r"""(?:(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*>)"""  # of a tag; a quoted > doesn't end it
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|title|head|body|html|blockquote|pre|hr|td|th|form)\b" + _REST, re.I)
_TAG = re.compile(r"</?[a-zA-Z]" + _REST + r"|<![^>]*>|<\?[^>]*>")
_SPACE, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
_TITLE, _LANG = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I), re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, source_headers string, content_length long, block string"
SCHEMA = pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest", "source_headers")), ("content_length", pa.int64()), ("block", pa.string())])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    """A urn that depends on the parts alone, so a rerun names its records alike."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(map(str, parts)).encode()).digest()[:16], version=4)}>"


def plain_text(page: str) -> str:
    """Visible text: no markup, scripts, styles or comments; entities decoded; a line for each block element, no blank lines."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", page))))
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def links(page: str) -> list[str]:
    return [html.unescape(a or b or c) for a, b, c in _LINK.findall(_HIDDEN.sub("", page))]


def response(page_id, url, page) -> dict:
    """The response record of a page: an HTTP head and the page as its block."""
    body = page.encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return {"page_id": page_id, "warc_type": "response", "record_id": record_id("response", page_id, url, digest(body)), "refers_to": None, "target_uri": url, "warc_date": DATE, "content_type": "application/http; msgtype=response", "payload_digest": digest(body), "block_digest": digest(head.encode() + body), "source_headers": head[:-4], "content_length": len(head) + len(body), "block": head + page}


def derivatives(r: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    page = r["block"].partition("\r\n\r\n")[2]
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [("title", _SPACE.sub(" ", html.unescape(title[1])).replace("\n", " ").strip() if title else ""), ("languages", lang[1] if lang else ""), ("length", len(page)), *(("outlink", " ".join(x.split())) for x in links(page))]
    about, text = "".join(f"{k}: {v}\r\n" for k, v in fields), plain_text(page)
    made = []
    for kind, content_type, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode("utf-8", "surrogatepass")
        made.append({**r, "warc_type": kind, "record_id": record_id(kind, r["record_id"]), "refers_to": r["record_id"], "content_type": content_type, "block_digest": digest(data), "content_length": len(data), "block": block})
    return made


def build(pages: DataFrame, with_responses: bool = False) -> DataFrame:
    """Two records a page, metadata and conversion (RECORD's columns); its response before them if with_responses.

    source_headers keeps the response's HTTP head. An empty page has an empty conversion block. Rows
    whose html is null had no response and give nothing. A null url leaves target_uri null; a null
    page_id stays null. Rows that repeat give equal records, of equal ids. An empty table gives no
    rows. Extra columns aren't read.
    """

    def work(batches):
        for b in slices(batches):
            out = []
            for page_id, page, url in zip(*(c.to_pylist() for c in b.columns)):
                r = response(page_id, url, page)
                out += [r] * with_responses + derivatives(r)
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("text"), F.col("url").cast("string").alias("url")).where("text is not null")
    return read.mapInArrow(work, RECORD)


_NAMES = (("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"), ("warc_date", "WARC-Date"), ("content_type", "Content-Type"), ("payload_digest", "WARC-Payload-Digest"), ("block_digest", "WARC-Block-Digest"))


def field(v) -> str:
    """A header's value: what would end its line, or isn't printable, percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), str(v))


def to_bytes(r: dict) -> bytes:
    """A record in WARC/1.1. The response's HTTP head goes in X-Source-Headers, base64. Line ends in a url come out percent-encoded."""
    data = r["block"].encode("utf-8", "surrogatepass")
    head = [f"WARC-Type: {r['warc_type']}", *(f"{name}: {field(r[k])}" for k, name in _NAMES if r[k] is not None), "X-Source-Headers: " + base64.b64encode(r["source_headers"].encode()).decode()]
    if r["page_id"] is not None:
        head.append(f"X-Page-ID: {r['page_id']}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(data)}\r\n\r\n").encode() + data + b"\r\n\r\n"


def from_bytes(data: bytes) -> list[dict]:
    """The records of WARC/1.1 bytes; a block whose digest or length doesn't fit is an error."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n" or digest(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"the record at {at} is damaged")
        out.append({"page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "warc_type": fields["WARC-Type"], **{k: fields.get(name) for k, name in _NAMES}, "source_headers": base64.b64decode(fields["X-Source-Headers"]).decode(), "content_length": n, "block": block.decode("utf-8", "surrogatepass")})
        at = end + 8 + n
    return out


def parse(data: bytes):
    """Records of any WARC/1.x bytes, gzip members or plain: (fields by lower-case name, block's bytes). Damaged bytes are an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)  # all members
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(at, end)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not first.startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        fields: dict[str, str] = {}
        for x in lines:
            name, _, value = x.partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        if end + 4 + n > len(data):
            raise ValueError(f"the record at {at} is cut off")
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data[at : at + 2] == b"\r\n":
            at += 2


def read(spark, path: str) -> DataFrame:
    """The response records (RECORD's columns) of the *.warc and *.warc.gz files below path. A payload that isn't UTF-8 is read by the charset
    its HTTP head names, bytes that don't fit replaced; page_id is null unless the record has X-Page-ID."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("content")

    def work(batches):
        for b in batches:
            for c in b.column(0):
                out = []
                for f, block in parse(c.as_py()):
                    if f.get("warc-type") != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    charset = re.search(rb"charset=[\"']?([\w-]+)", head, re.I)
                    try:
                        page = body.decode(charset[1].decode() if charset else "utf-8", "replace")
                    except LookupError:
                        page = body.decode("utf-8", "replace")
                    top = head.decode("latin-1")
                    out.append({
                        "page_id": int(f["x-page-id"]) if "x-page-id" in f else None, "warc_type": "response", "record_id": f.get("warc-record-id"), "refers_to": None, "target_uri": f.get("warc-target-uri"), "warc_date": f.get("warc-date"),
                        "content_type": f.get("content-type"), "payload_digest": f.get("warc-payload-digest") or digest(body), "block_digest": f.get("warc-block-digest") or digest(block), "source_headers": top, "content_length": len(block), "block": top + "\r\n\r\n" + page,
                    })
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return files.mapInArrow(work, RECORD)


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records, such as read() gives; rows of null block give nothing."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([d for r in b.to_pylist() for d in derivatives(r)], schema=SCHEMA)

    return responses.where("warc_type = 'response' and block is not null").select(*SCHEMA.names).mapInArrow(work, RECORD)


def write(records: DataFrame, path: str) -> None:
    """Store records as WARC/1.1 bytes, a Parquet row (page_id, warc) each: joined end to end, the cells are a WARC file."""
    names = [f.name for f in SCHEMA]

    def work(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({"page_id": pa.array([r["page_id"] for r in rows], pa.int64()), "warc": pa.array([to_bytes(r) for r in rows], pa.binary())})

    records.select(*names).mapInArrow(work, "page_id long, warc binary").write.parquet(path)
