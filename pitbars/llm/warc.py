"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A record is a row (type, ids, headers, block), so all work stays distributed; files are written by Spark's text writer with
the record end of the format as line end, and read by the lengths in the headers. Each response gives one conversion
record (the text of its page) and one metadata record (title, language, links and the source's HTTP headers). Both refer
to the response by its id and carry its target, its date and its payload digest; the metadata record also names the
conversion record. Ids are made from the source id, so a task that runs again writes the same records.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.llm.common import over_batches

DATE = "2024-01-01T00:00:00Z"
#: Patterns of the conversion, in order, with what replaces a match, as SQL states them: for pages that close their head. Here
#: ``without_head`` stands in place of the head's pattern, and ``values`` in place of LANG and LINK (double quotes only).
STEPS = (
    (r"(?is)<!--.*?(-->|$)", ""),
    (r"(?is)<script\b[^<>]*>.*?(</script[^<>]*>|$)", ""),
    (r"(?is)<style\b[^<>]*>.*?(</style[^<>]*>|$)", ""),
    (r"(?is)<head\b[^<>]*>.*?(</head[^<>]*>|$)", "\n"),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|body|html)\b[^<>]*>", "\n"),
    (r"</?[a-zA-Z][^<>]*>|<![^<>]*>", ""),
)
BLANKS = ((r"[ \t\r\x0b\x0c]+", " "), (r" ?\n ?", "\n"), (r"\n+", "\n"))
TITLE, LANG, LINK = r"(?is)<title[^<>]*>([^<]*)", r'(?is)<html[^<>]*\slang="([^"<>]*)"', r'(?is)<a\s[^<>]*href="([^"<>]*)"'
_STEPS = [(re.compile(p), r) for p, r in STEPS]
_BEFORE_HEAD, _AFTER_HEAD = _STEPS[:3], _STEPS[4:]
_BLANKS = [(re.compile(p), r) for p, r in BLANKS]
_TITLE = re.compile(TITLE)
_HEAD = re.compile(r"(?i)<head(?=[\s/>])[^<>]*>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)[^<>]*>")
#: Elements that can stand in a head; of the second kind, what is between their tags belongs to them.
_IN_HEAD = frozenset("base basefont bgsound link meta noscript object script style template title".split())
_CLOSE = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("noscript", "object", "template", "title")}
_ATTRIBUTES = r"""(?is)<%s(?=[\s/])((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)"""
_HTML, _A = re.compile(_ATTRIBUTES % "html"), re.compile(_ATTRIBUTES % "a")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")

RECORD = (
    "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, source_payload_digest string, block_digest string, content_length long, block string"
)


def _tidy(text: str) -> str:
    for p, r in _BLANKS:
        text = p.sub(r, text)
    return text.strip(" \n")


def _head_end(page: str, at: int) -> int:
    """Where a head ends whose content starts at ``at``: after </head>, or where it is left out, before the first text or tag
    that can't stand in a head."""
    pos, bare, unclosed = at, None, set()
    while tag := _TAG.search(page, pos):
        if bare is None and page[pos : tag.start()].strip():
            bare = pos
        name = tag[2].lower()
        if tag[1] and name == "head":
            return tag.end()
        if name not in _IN_HEAD:
            return tag.start() if bare is None else bare
        pos = tag.end()
        if not tag[1] and name in _CLOSE:
            close = None if name in unclosed else _CLOSE[name].search(page, pos)
            if close:
                pos = close.end()
            else:
                unclosed.add(name)
                if name == "title":
                    pos = found if (found := page.find("<", pos)) >= 0 else len(page)
    return pos if bare is None else bare


def without_head(page: str) -> str:
    out, pos = [], 0
    while head := _HEAD.search(page, pos):
        out += [page[pos : head.start()], "\n"]
        pos = _head_end(page, head.end())
    return "".join(out) + page[pos:]


def values(tag: re.Pattern, name: str, page: str) -> Iterator[str]:
    """The values of an attribute, in double quotes, single quotes or none; the first where a tag repeats it."""
    for m in tag.finditer(page):
        for a in _ATTRIBUTE.finditer(m[1]):
            if a[1].lower() == name and a.lastindex > 1:
                yield a[a.lastindex]
                break


def plain_text(page: str) -> str:
    """The text of a page: markup, scripts, styles and the head go, blocks become lines, entities characters."""
    for p, r in _BEFORE_HEAD:
        page = p.sub(r, page)
    page = without_head(page)
    for p, r in _AFTER_HEAD:
        page = p.sub(r, page)
    return _tidy(entities.unescape(page) if "&" in page else page)


def urn(*parts: str) -> str:
    h = hashlib.md5(":".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _urn(digest: Column) -> Column:
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE
) -> DataFrame:
    """Response records of a table of pages, with the page's id. A null page has an empty payload, a null id or address
    the empty string in its headers."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(head, body)
    uri = F.coalesce(F.col(url_col), F.lit(""))
    name = F.concat_ws(":", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), uri)
    return pages.select(
        F.col(id_col).alias("source_key"),
        F.lit("response").alias("warc_type"),
        _urn(F.md5(name)).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("concurrent_to"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)).alias("source_payload_digest"),
        F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256)).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records, two rows for every response in ``records`` (other types give none).

    Rows with the columns of ``responses``; ``source_key`` is carried through. A null or empty block, or one without
    HTTP headers, is an empty page: its records are there, without text, title or links. Payload digests are kept as they
    stand in the source, or computed where it has none. Repeated rows give repeated records, an empty table none, and columns
    that aren't part of a record are not read.
    """
    key = f"source_key {dict(records.dtypes)['source_key']}, "
    names = ["source_key", *(c.split()[0] for c in RECORD.split(", "))]

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for source, uri, record_id, date, digest, block in zip(
                *(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True
            ):
                head, _, page = (block or "").partition("\r\n\r\n")
                uri, record_id, date = uri or "", record_id or "", date or ""
                digest = digest or "sha256:" + hashlib.sha256(page.encode()).hexdigest()
                conversion, metadata = urn("conversion", record_id), urn("metadata", record_id)
                title = _TITLE.search(page)
                fields = [
                    ("title", _tidy(entities.unescape(title[1])).replace("\n", " ") if title else ""),
                    ("language", next(values(_HTML, "lang", page), "")),
                    *(("outlink", x) for x in values(_A, "href", page)),
                    *(("source-http-header", x) for x in head.split("\r\n") if x),
                ]
                about = "".join(f"{k}: {v}\r\n" for k, v in fields)
                for kind, own, other, media, body in (
                    ("metadata", metadata, conversion, "application/warc-fields", about),
                    ("conversion", conversion, metadata, "text/plain; charset=utf-8", plain_text(page)),
                ):
                    data = body.encode()
                    rows.append((source, kind, own, record_id, other, uri, date, media, digest,
                                 "sha256:" + hashlib.sha256(data).hexdigest(), len(data), body))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    slim = records.where("warc_type = 'response'").select(
        "source_key", "target_uri", "record_id", "date", "source_payload_digest", "block"
    )
    return over_batches(slim, run, key + RECORD)


HEADERS = {
    "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to",
    "WARC-Concurrent-To": "concurrent_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date",
    "Content-Type": "content_type", "WARC-Payload-Digest": "source_payload_digest", "WARC-Block-Digest": "block_digest",
    "Content-Length": "content_length",
}


def write_warc(records: DataFrame, path: str, records_per_file: int = 20000) -> None:
    """Write records as gzipped WARC files; Spark commits them, so a task that failed leaves nothing behind."""
    line = lambda name, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(col).cast("string"), F.lit("\r\n")))
    head = F.concat(*[F.coalesce(line(n, c), F.lit("")) for n, c in HEADERS.items()])
    text = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), F.coalesce("block", F.lit("")))
    (
        records.select(text.alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped or not, cut by their Content-Length; one file is read at a time per task."""
    import gzip

    import pandas as pd

    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for data in files["content"]:
                data, rows, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, [], 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    found = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if ": " in x)
                    n = int(found.get("Content-Length", 0))
                    row = dict.fromkeys(names) | {HEADERS[k]: v for k, v in found.items() if k in HEADERS}
                    rows.append(row | {"content_length": n, "block": data[end + 4 : end + 4 + n].decode()})
                    at = end + 4 + n + 4
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)
