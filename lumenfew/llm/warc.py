"""WARC derivatives: linked metadata and plain-text conversion records from responses.

A response record gives two more: a ``conversion`` (its text as text/plain) and a
``metadata`` record (JSON: the source's WARC and HTTP headers, digests, title, links). Both
name the response in WARC-Refers-To; the metadata also names the conversion. Identifiers
are UUIDs made from what they name, so a lost task makes the same ones again. Digests are
SHA-1 in base 32, as WARC files have them.

``write`` stores records as WARC files (UTF-8 content; gzip if asked for) through Spark's
text writer, with the format's two line ends between records; ``read`` parses WARC files,
gzip members included, through Spark's binary reader.

Defined cases: a null body counts as empty and yields an empty conversion; a null URL is
left out of the headers; line ends in a URL are percent-encoded; null dates take ``DATE``; repeated rows and ties yield equal
identifiers; an empty table gives no rows; very long pages are read whole, in time linear in
their length; broken records give no row, and a response without an identifier gets one made
from its block; other columns pass through ``derivatives``, but those named like a result
are replaced. ``read`` holds a file in one task: archives of 1 GB are past its bounds, cut
them at their members first.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.llm.common import session, table

DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("7b0f3c0a-0000-5000-8000-000000000000")
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "head")} | {"": re.compile("-->")}
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_GAP = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_TITLE_END = re.compile(r"</title", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\bhref\s*=\s*[\"']", re.I)
#: A record's first line, and where a line begins with it.
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_LINE = re.compile(rb"(?<=\n)WARC/\d+\.\d+\r\n")


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, '|'.join(map(str, parts)))}>"


def without_hidden(page: str) -> str:
    """The page with a space for each comment, script and the like; one that never closes stays. Linear: a missing end is looked for once."""
    out, at, found, missing = [], 0, 0, set()
    while m := _OPEN.search(page, found):
        name = (m[1] or "").lower()
        end = None if name in missing else _CLOSE[name].search(page, m.end())
        if end is None:
            missing.add(name)
            found = m.end()
        else:
            out += [page[at : m.start()], " "]
            at = found = end.end()
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The visible text of an HTML page: one line a block."""
    page = without_hidden(page)
    last = page.rfind(">") + 1  # no tag closes beyond
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", page[:last])) + page[last:])
    return _LINES.sub("\n", _GAP.sub(" ", text)).strip()


def links(page: str) -> list[str]:
    """The targets of anchors. Linear: an anchor is looked through once, a quoted value may pass its end."""
    page = without_hidden(page)
    page = page[: page.rfind(">") + 1]  # no tag closes beyond
    out, at = [], 0
    while anchor := _ANCHOR.search(page, at):
        at = anchor.end()
        href = _HREF.search(page, anchor.start(), at)
        # a value that a quote opens inside the tag ends at the next quote, wherever that is
        begun = _QUOTED.search(page, anchor.start(), at)
        if begun and (href is None or begun.start() <= href.start()):
            href = _HREF.match(page, begun.start())
        if href:
            out.append(html.unescape(href[1] or href[2] or href[3] or ""))
            at = max(at, href.end())
    return out


def title_of(page: str) -> str | None:
    """What stands between the first title tag and the next end of one. Linear: both are looked for once."""
    begin = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = begin and _TITLE_END.search(page, begin.end())
    return html.unescape(page[begin.end() : end.start()]).strip() if end else None


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the line ends that follow it. Line ends in a header's value are percent-encoded, or it would end the header."""
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def unzipped(content: bytes) -> bytes:
    """The bytes of gzip members one after another; what follows a broken member is left out."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content) + member.flush())
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out)


def parse(content: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, plain or of gzip members.

    A record without a whole head, a length or all of its block gives nothing; header lines
    without a colon are passed over; reading goes on at the next line that is a record's first.
    """
    if content[:2] == b"\x1f\x8b":
        content = unzipped(content)
    out, at = [], 0
    done = True  # here a record may begin without a line end before it
    while begin := (done and _VERSION.match(content, at)) or _LINE.search(content, at):
        end = content.find(b"\r\n\r\n", begin.end() - 2)
        if end < 0:
            break
        for begin in _LINE.finditer(content, begin.end(), end):
            pass  # a head was cut short: the last one before the empty line is whole
        lines = content[begin.start() : end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
        size = headers.get("Content-Length", "")
        stop = end + 4 + int(size) if size.isascii() and size.isdigit() else -1
        if 0 <= stop <= len(content):
            out.append((headers, content[end + 4 : stop]))
            at, done = stop, True
        else:
            at, done = end + 4, False
    return out


def response(url: str | None, page: str, date: str, key: object) -> tuple[str, bytes]:
    """Identifier and record of a page that is not in WARC form yet."""
    body = page.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    name = record_id("response", key, url, date, digest(body))
    target = [("WARC-Target-URI", url)] if url is not None else []
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date), *target, ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http + body)), ("Content-Type", "application/http; msgtype=response")]
    return name, record(headers, http + body)


def derive(headers: dict[str, str], block: bytes) -> tuple[dict, bytes, bytes]:
    """A response's facts, its conversion record and its metadata record."""
    http, _, body = block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    source, date = headers.get("WARC-Record-ID") or record_id("unnamed", digest(block)), headers.get("WARC-Date", DATE)
    target = [("WARC-Target-URI", headers["WARC-Target-URI"])] if "WARC-Target-URI" in headers else []
    text = plain_text(page)
    content = text.encode()
    conversion, metadata = record_id("conversion", source), record_id("metadata", source)
    title = title_of(page)
    found = links(page)
    status, *lines = http.decode("latin-1").split("\r\n")
    facts = {"refers_to": source, "conversion": conversion, "warc_headers": headers, "http_status": status, "http_headers": dict(x.split(": ", 1) for x in lines if ": " in x), "payload_digest": digest(body), "text_digest": digest(content), "title": title, "links": found}
    note = json.dumps(facts, ensure_ascii=False).encode()
    common = lambda kind, name, mime, block: record([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Date", date), *target, ("WARC-Block-Digest", digest(block)), ("Content-Type", mime)], block)
    own = {"response_id": source, "conversion_id": conversion, "metadata_id": metadata, "payload_digest": facts["payload_digest"], "source_payload_digest": headers.get("WARC-Payload-Digest"), "text": text, "text_digest": facts["text_digest"], "title": facts["title"], "n_links": len(found)}
    return own, common("conversion", conversion, "text/plain", content), common("metadata", metadata, "application/json", note)


_FACTS = "response_id string, conversion_id string, metadata_id string, payload_digest string, source_payload_digest string, text string, text_digest string, title string, n_links int"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages (``page_id, url, html``) as response records: ``page_id, record`` (binary)."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            made = [response(u, h, date, k)[1] for k, u, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return rows.mapInArrow(run, "page_id string, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Each response in ``record`` (binary) with its facts, ``conversion`` and ``metadata`` (binary records); other types give no row."""
    keep = [c for c in records.columns if c not in ("record", "conversion", "metadata", *[f.split()[0] for f in _FACTS.split(", ")])]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name in keep], _FACTS, "conversion binary, metadata binary"])
    names = [f.split()[0] for f in _FACTS.split(", ")]
    kinds = [pa.string()] * 8 + [pa.int32()]

    def run(batches):
        for b in batches:
            at, facts, first, second = [], [], [], []
            for i, content in enumerate(b.column(len(keep)).to_pylist()):
                for headers, block in parse(content or b""):
                    if headers.get("WARC-Type") == "response":
                        own, conversion, metadata = derive(headers, block)
                        at.append(i)
                        facts.append(own)
                        first.append(conversion)
                        second.append(metadata)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(index) for i in range(len(keep))), *(pa.array([f[n] for f in facts], k) for n, k in zip(names, kinds, strict=True)), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=[*keep, *names, "conversion", "metadata"])

    return records.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], "record").mapInArrow(run, schema)


def write(records: DataFrame, column: str, path: str, compressed: bool = False) -> None:
    """Store binary records as WARC files, one a partition."""
    writer = records.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
    (writer.option("compression", "gzip") if compressed else writer).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: ``headers`` (map) and ``block`` (binary)."""

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                found = parse(content)
                yield pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string())), pa.array([x for _, x in found], pa.binary())], names=["headers", "block"])

    return session(spark).read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, block binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's derivatives: identifiers, digests, text, and the metadata record's content."""
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    whole = F.decode("metadata", "utf-8")
    body = F.substr(whole, F.instr(whole, "\r\n\r\n") + 4)
    return made.select(F.col("page_id").cast("long").alias("page_id"), *[f.split()[0] for f in _FACTS.split(", ")], body.alias("metadata_json"), F.octet_length("conversion").cast("long").alias("conversion_bytes"))
