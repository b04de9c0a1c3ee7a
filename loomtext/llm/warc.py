"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both refer to the response by WARC-Refers-To, keep its target, date, HTTP and WARC headers, and carry the digest of the source's
payload beside the digest of their own block. Record ids are derived from the source's id and the
type, so a rerun gives the same records.

Response rows: record_id, target_uri, date, http_headers (status line and header lines), payload (text), and, if the source
is a WARC file, body (the payload's bytes) and warc_headers (its header lines, digests included). Where body isn't null it is
hashed and decoded: the digest is that of the bytes without the transfer coding, before the content coding is undone; the text
follows Content-Encoding (gzip, deflate, br, zstd) and the charset of byte order mark, Content-Type, meta or XML declaration, else
UTF-8 or windows-1252. Where it is null, payload is the text and its UTF-8 form is hashed.

A body that isn't text (its media type, or zero bytes where none is given) or can't be decoded has a metadata record and no
conversion. Text that isn't markup (text/plain, JSON) is its own conversion.

Result rows: the columns of RECORD. Edge cases: a null or empty payload gives an empty conversion block and its digest; null headers
are no headers; a null target stays null, links are then kept as written; malformed HTML is read as far as it goes: an
unclosed script, style or comment runs to the end of the text, as in HTML; of a head only the title, scripts, styles, closed
templates and closed noscripts are left out, whether it is closed or not; an unclosed template or noscript keeps its text; a "<" without an end is
text; long payloads are one block, read in time linear in their length; repeated rows give repeated records; an empty table gives none; extra columns named in `keep` are carried.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import by_bytes

RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_digest string, source_headers string, source_warc_headers string, length long, block string"

#: Elements that begin and end lines of their own.
_BLOCKS = frozenset("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr table thead tbody article section header footer nav main aside form blockquote pre title body html figure option".split())
#: A tag: slash, name, attributes. A quote counts only after "=", so an apostrophe elsewhere hides nothing. Possessive: never read twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_COMMENT_END = re.compile(r"--!?>")
_END_TAG = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in ("script", "style", "title")}
_CHARSET_VALUE = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META = re.compile(rb"<meta[^>]*?\bcharset\s*=\s*[\"']?\s*([\w:.-]+)", re.I)
_XML = re.compile(rb"\A\s*<\?xml[^>]*?\bencoding\s*=\s*[\"']([\w:.-]+)", re.I)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_MARKUP = re.compile(r"(?:text|application)/(?:html|xml)|[\w.-]+/[\w.+-]+\+xml")
_TEXTUAL = re.compile(r"text/.+|application/(?:json|javascript|ecmascript|x-javascript|x-ndjson|warc-fields)|[\w.-]+/[\w.+-]+\+json")
#: Labels as browsers read them, and codecs that no page means.
_LABELS = dict.fromkeys(("iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "latin-1", "l1", "ascii", "us-ascii"), "cp1252") | dict.fromkeys(("gb2312", "gbk", "x-gbk"), "gb18030") | dict.fromkeys(("shift_jis", "shift-jis", "sjis", "x-sjis", "windows-31j"), "cp932") | dict.fromkeys(("euc-kr", "ks_c_5601-1987"), "cp949") | {"big5": "big5hkscs", "iso-8859-9": "cp1254", "tis-620": "cp874", "windows-874": "cp874", "utf-16": "utf-16-le"}
_NO_CHARSET = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "unicode-escape", "raw-unicode-escape", "utf-7", "utf7", "utf_7"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Page:
    """What a page holds: its text, the first title, the language, the charset it declares and its links, as written."""

    text: str = ""
    title: str | None = None
    language: str | None = None
    charset: str | None = None
    links: list[str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def scan(page: str) -> Page:
    """One pass over the markup, in time linear in its length: every search goes on where the last one ended, and a search that has
    found nothing isn't repeated."""
    out, parts = Page(), []
    at, last, tag, in_head = 0, page.rfind(">"), _TAG, False
    noscript, templates = None, []  # where they began: in parts, and in links
    open_ended: set[str] = set()

    def end_of(name: str, start: int):
        if name in open_ended:
            return None
        m = _END_TAG[name].search(page, start, last + 1)
        if not m:
            open_ended.add(name)
        return m

    while (start := page.find("<", at)) >= 0 and start < last:
        if start > at:
            parts.append(page[at:start])
        second = page[start + 1]
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                at = page.index(">", start + 4) + 1
            else:
                m = _COMMENT_END.search(page, start + 4)
                at = m.end() if m else len(page)
            parts.append(" ")
            continue
        if second in "/!?" and not re.match("/[a-zA-Z]", page[start + 1 : start + 3]):
            at = page.index(">", start) + 1
            continue
        m = tag.match(page, start)
        if not m and "a" <= second.lower() <= "z" or second == "/" and not m:
            tag = _PLAIN_TAG  # a quote stays open to the end: from here on no quote counts
            m = tag.match(page, start)
        if not m:
            parts.append("<")
            at = start + 1
            continue
        close, name, at = m[1], m[2].lower(), m.end()
        if not close and name in ("script", "style"):
            end = end_of(name, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name in ("svg", "body") or close and name == "head":
            in_head, noscript = False, None if name != "svg" else noscript
        if name == "head" and not close:
            in_head = True
        elif name == "title" and not close:
            if (out.title is None or in_head) and (end := end_of("title", at)):
                if out.title is None:
                    out.title = " ".join(html.unescape(page[at : end.start()]).split())
                if in_head:
                    parts.append(" ")
                    at = end.end()
                    continue
        elif name == "noscript":
            if close and noscript is not None:
                del parts[noscript:]
                parts.append(" ")
            noscript = None if close else len(parts)
        elif name == "template":
            if not close:
                templates.append((len(parts), len(out.links)))
            elif templates:
                begun, links = templates.pop()
                del parts[begun:], out.links[links:]
                parts.append(" ")
                noscript = noscript if noscript is not None and noscript < begun else None
        elif not close and name in ("a", "meta", "html"):
            own = _attributes(m[3])
            if name == "a" and "href" in own:
                out.links.append(own["href"].strip())
            elif name == "meta" and out.charset is None:
                found = own.get("charset") or (_CHARSET_VALUE.search(own.get("content", "")) or ["", ""])[1]
                out.charset = found.strip() or None
            elif name == "html" and out.language is None:
                out.language = own.get("lang")
        if name in _BLOCKS:
            parts.append("\n")
    parts.append(page[at:])
    lines = html.unescape("".join(parts)).split("\n")
    out.text = "\n".join(x for line in lines if (x := " ".join(line.split())))
    return out


def plain_text(page: str) -> str:
    """Text between tags: blocks on lines of their own, blanks run together, entities resolved once."""
    return scan(page).text


def header(headers: str | None, name: str) -> str:
    """The value of a header, of repeated ones joined by commas; empty if there is none."""
    lines = (x.partition(":") for x in (headers or "").split("\n"))
    return ", ".join(v.strip() for k, _, v in lines if k.strip().lower() == name)


def media_type(http: str | None, own: str | None = None) -> str:
    """The media type of a payload, in lower case: the record's own where the block isn't HTTP; empty if none is given."""
    got = header(http, "content-type")
    if not got and http is None:
        got = header(own, "content-type")
    got = re.split("[;,]", got)[0].strip().lower()
    return got if "/" in got else ""


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked message; data itself if it isn't one, as when a crawler stored it decoded."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0 and re.fullmatch(rb"[0-9a-fA-F]{1,15}", line := data[at:end].split(b";")[0].strip()):
        size = int(line, 16)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
        if not size or at >= len(data):  # the last chunk, or a truncated one
            return b"".join(out)
        if data[at - 2 : at] != b"\r\n":
            break
    return data


def _inflated(data: bytes, coding: str) -> bytes | None:
    """The body without one content coding, as far as it goes; as it is if a crawler removed the coding; None if it can't be read."""
    if coding in ("", "identity", "none", "utf-8") or not data:
        return data
    if coding in ("gzip", "x-gzip", "deflate"):
        out, rest = [], data
        while rest:
            zipped = rest[:2] == b"\x1f\x8b"
            if coding != "deflate" and not zipped:
                break
            for bits in (31,) if zipped else (15, -15):
                z, got, tail = zlib.decompressobj(bits), bytearray(), b""
                try:
                    for i in range(0, len(rest), 1 << 12):
                        got += z.decompress(rest[i : i + (1 << 12)])
                        if z.eof:
                            tail = z.unused_data + rest[i + (1 << 12) :]
                            break
                    break
                except zlib.error:
                    if bits < 0:  # without a header any bytes may begin like a stream
                        got.clear()
                    elif got:
                        break
            if got or z.eof:
                out.append(bytes(got))
            rest = tail if zipped else b""
        if out:
            return b"".join(out)
    elif coding in ("br", "zstd"):
        out, stream = [], pa.CompressedInputStream(pa.BufferReader(data), "brotli" if coding == "br" else "zstd")
        try:
            while part := stream.read(1 << 16):
                out.append(part)
        except OSError:
            pass
        if out:
            return b"".join(out)
    try:
        data.decode()
    except UnicodeDecodeError:
        return None
    return None if b"\0" in data else data


def text_of(body: bytes, http: str | None, own: str | None = None) -> str | None:
    """The body's text; None if it isn't text or can't be decoded."""
    media = media_type(http, own)
    if media and not _MARKUP.fullmatch(media) and not _TEXTUAL.fullmatch(media):
        return None
    for coding in reversed(header(http, "content-encoding").lower().split(",")):
        if (body := _inflated(body, coding.strip())) is None:
            return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    m = re.search(r"charset\s*=\s*[\"']?\s*([\w:.-]+)", header(http if http is not None else own, "content-type"), re.I)
    names = [m[1].lower()] if m else []
    if not media or _MARKUP.fullmatch(media):
        for pattern in (_XML, _META):
            if m := pattern.search(body[:1024] if pattern is _XML else body[:4096]):
                name = m[1].decode().lower()
                names.append("utf-8" if name.startswith("utf-16") else name)  # it was read as ASCII
    for name in names:
        if name not in _NO_CHARSET:
            try:
                return body.decode(_LABELS.get(name, name), "replace")
            except (LookupError, ValueError):
                pass
    if not media and b"\0" in body:
        return None
    try:
        return body.decode()
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def conversion(text: str, media: str, page: Page) -> str:
    """Plain text of a payload: without tags if it is markup (or of no known type), else itself."""
    if media and not _MARKUP.fullmatch(media):
        return text
    if media.endswith("xml") and media != "application/xhtml+xml":
        return plain_text(_CDATA.sub(lambda m: html.escape(m[1]), text))
    return page.text


def fields(page: Page, target: str | None, headers: str | None, source: str, own: str | None = None) -> str:
    """The block of the metadata record: lines of application/warc-fields."""
    out = [f"{name}: {value}" for name, value in (("title", page.title), ("language", page.language), ("charset", page.charset)) if value is not None]
    lines = [x for x in (headers or "").splitlines() if x.strip()]
    if lines and ":" not in lines[0].split(" ")[0]:
        out.append(f"http-status: {lines.pop(0)}")
    out += [f"http-header: {x}" for x in lines]
    out += [f"warc-header: {x}" for x in (own or "").split("\n") if x.strip()]
    out.append(f"source-payload-digest: {source}")
    for link in page.links:
        try:
            out.append(f"outlink: {urljoin(target, link) if target else link}")
        except ValueError:
            out.append(f"outlink: {link}")
    return "".join(f"{' '.join(x.split())}\r\n" for x in out)


def _derive(keep: list[str]):
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for b in by_bytes(batches, "_body"):
            rows, at = [], []
            for i, r in enumerate(b.select(["record_id", "target_uri", "date", "http_headers", "_own", "_raw", "_body"]).to_pylist()):
                body, http, warc = r["_body"] or b"", r["http_headers"], r["_own"]
                if r["_raw"]:
                    body = _unchunked(body) if "chunked" in header(http, "transfer-encoding").lower() else body
                    page = text_of(body, http, warc)
                else:
                    page = body.decode("utf-8", "replace")
                source, media = digest(body), media_type(http, warc)
                found = scan(page) if page and (not media or _MARKUP.fullmatch(media)) else Page()
                blocks = [("metadata", "application/warc-fields", fields(found, r["target_uri"], http, source, warc))]
                if page is not None:
                    blocks.append(("conversion", "text/plain; charset=UTF-8", conversion(page, media, found)))
                for kind, form, block in blocks:
                    raw = block.encode()
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['record_id']}#{kind}")
                    rows.append((kind, f"<urn:uuid:{own}>", r["record_id"], r["target_uri"], r["date"], form, digest(raw), source, http, warc, len(raw), block))
                    at.append(i)
            kept = b.select(keep).take(pa.array(at, pa.int64()))
            kinds = [pa.int64() if n == "length" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], names=[*keep, *names])

    return run


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records of each response, with the columns `keep` (none of which may have a record column's name) before them."""
    names = {x.split()[0] for x in RECORD.split(", ")}
    if names & set(keep):
        raise ValueError(f"columns clash with a record's: {sorted(names & set(keep))}")
    have = set(responses.columns)
    text = F.col("payload").cast("binary") if "payload" in have else F.lit(None).cast("binary")
    body = F.col("body") if "body" in have else F.lit(None).cast("binary")
    warc = F.col("warc_headers") if "warc_headers" in have else F.lit(None).cast("string")
    rows = responses.select(*keep, "record_id", "target_uri", "date", "http_headers", warc.alias("_own"), body.isNotNull().alias("_raw"), F.coalesce(body, text).alias("_body"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_derive(list(keep)), ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), RECORD]))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows for a table of fetched pages (page_id, url, html), as a crawler would have stored them."""
    h = F.md5(F.concat_ws("#", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("\r\n"))
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), F.col("html").alias("payload"))


def serialize(record: dict) -> bytes:
    """One record in WARC/1.1 form. The source's digest and header lines are fields of their own, so nothing of a row is lost."""
    raw = (record["block"] or "").encode()
    head = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record.get("refers_to")), ("WARC-Target-URI", record.get("target_uri")), ("WARC-Date", record.get("date")), ("WARC-Block-Digest", digest(raw)), ("X-Source-Payload-Digest", record.get("source_digest"))]
    for name, lines in (("X-Source-HTTP-Header", record.get("source_headers")), ("X-Source-WARC-Header", record.get("source_warc_headers"))):
        head += [(name, x.strip()) for x in (lines or "").split("\n") if x.strip()]
    head += [("Content-Type", record.get("content_type")), ("Content-Length", str(len(raw)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + raw + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write the records as WARC files below `folder` (a URI all executors reach) when the result is computed: one file a task, each record a gzip
    member of its own, after a warcinfo record. Result: file, records, bytes. A file gets its name when it is complete, so a
    repeated task leaves the same files; a task without records writes none."""

    def run(batches):
        from pyarrow import fs

        task, (store, root) = TaskContext.get(), fs.FileSystem.from_uri(folder)
        name, out, count, size = f"part-{task.partitionId():06d}.warc.gz", None, 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{root}/_{name}.{task.taskAttemptId()}", compression=None)
                    info = {"warc_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "date": r["date"], "content_type": "application/warc-fields", "block": "format: WARC File Format 1.1\r\n"}
                    size += out.write(gzip.compress(serialize(info), mtime=0))
                size += out.write(gzip.compress(serialize(r), mtime=0))
                count += 1
        if out is not None:
            out.close()
            store.move(f"{root}/_{name}.{task.taskAttemptId()}", f"{root}/{name}")
            yield pa.record_batch({"file": pa.array([name]), "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    at = records.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(records.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)
    return records.select([x.split()[0] for x in RECORD.split(", ")]).mapInArrow(run, "file string, records long, bytes long")


def _lines(data: bytes) -> str:
    """Header lines as text: UTF-8, or Latin-1 where they aren't."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of a file, gzip members undone if it has any; a truncated or broken member ends it."""
    z = None
    for k, data in enumerate(chunks):
        if not k and data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
        if z is None:
            yield data
            continue
        while data:
            try:
                yield z.decompress(data, 1 << 22)
            except zlib.error:
                return
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail


#: The largest block that is read; a larger one, which no Arrow value holds, is passed over.
LARGEST = (1 << 31) - 1


def _length(lines: str) -> int | None:
    """The block's length as the header says; 0 without one, None for one that is no length."""
    said = header(lines, "content-length").split(",")[-1].strip() or "0"
    return int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None


def records(data: bytes | Iterator[bytes], skipped: list[str] | None = None) -> Iterator[tuple[str, bytes]]:
    """(header lines, block) of each record, one at a time; a truncated last record ends the file.

    After a record whose length isn't one, reading goes on at the next record mark that follows an empty line; a block over LARGEST is passed over. The
    header lines of both kinds are put into `skipped`.
    """
    chunks = _inflate(iter([data]) if isinstance(data, bytes) else data)
    held = bytearray()

    def fill() -> bool:
        for more in chunks:
            if more:
                held.extend(more)
                return True
        return False

    mark = b"WARC/"
    while True:
        while (start := held.find(mark)) < 0:
            del held[: 1 - len(mark)]
            if not fill():
                return
        del held[: start + len(mark) - 5]
        mark = b"WARC/"
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not fill():
                return
        lines = _lines(bytes(held[:end])).partition("\r\n")[2]
        size = _length(lines)
        if size is None or size > LARGEST:
            if skipped is not None:
                skipped.append(lines)
            if size is None:  # the block may hold anything, but its end is an empty line
                del held[:end]
                mark = b"\r\n\r\nWARC/"
                continue
            left = end + 4 + size
            while len(held) < left:
                left -= len(held)
                held.clear()
                if not fill():
                    return
            del held[:left]
            continue
        while len(held) < end + 4 + size:
            if not fill():
                return
        yield lines, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, repeated ones joined by line feeds, block) of each record; a truncated last record ends the file."""
    for lines, block in records(data):
        out: dict[str, str] = {}
        for x in lines.split("\r\n"):
            k, _, v = x.partition(":")
            k = k.strip().lower()
            out[k] = f"{out[k]}\n{v.strip()}" if k in out else v.strip()
        yield out, block


def _response(lines: str, block: bytes) -> tuple:
    """A response row. A block that isn't HTTP is all body; payload is the text of the body, null if it has none."""
    if header(lines, "content-type").lower().startswith("application/http") or block.startswith(b"HTTP/"):
        m = re.search(rb"\r?\n\r?\n", block)
        http, body = (_lines(block[: m.start()]), block[m.end() :]) if m else (_lines(block), b"")
    else:
        http, body = None, block
    plain = _unchunked(body) if "chunked" in header(http, "transfer-encoding").lower() else body
    ids = (header(lines, k) or None for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    return (*ids, http, text_of(plain, http, lines), lines, body)


#: Bytes of bodies in one Arrow batch of read responses.
BATCH = 16 << 20


def _opened(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(_uri(path))
    with store.open_input_stream(at, compression=None) as f:
        while data := f.read(1 << 20):
            yield data


def _uri(path: str) -> str:
    """As pyarrow's file systems name it."""
    scheme, _, rest = path.partition(":")
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"s3:{rest}" if scheme in ("s3a", "s3n") else path


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response rows of the WARC files (gzip or not) at `path`.

    Files are streamed record by record, so their size doesn't matter; a task holds one record and one batch. A store that only Spark reaches
    is read by Spark instead, a file of at most 2 GB as one value. Records without a proper length, or with a block of 2 GB and more, are left out, with
    a warning that counts them in the task's log.
    """
    kinds = {"record_id": "string", "target_uri": "string", "date": "string", "http_headers": "string", "payload": "string", "warc_headers": "string", "body": "binary"}
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        from pyarrow import fs

        streams = first is None or bool(fs.FileSystem.from_uri(_uri(first[0])))
    except (OSError, ValueError, pa.ArrowException):
        streams = False

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.binary() if k == "binary" else pa.string()) for j, k in enumerate(kinds.values())], names=list(kinds))

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                rows, size, skipped = [], 0, []
                for lines, block in records(_opened(x) if streams else x, skipped):
                    if header(lines, "warc-type").lower() == "response":
                        rows.append(_response(lines, block))
                        size += len(block)
                    if size >= BATCH:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)
                if skipped:
                    warnings.warn(f"{len(skipped)} records left out of {x if streams else 'a file'}", stacklevel=1)

    return files.select("path" if streams else "content").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
