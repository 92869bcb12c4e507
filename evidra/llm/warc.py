"""WARC archives with a two-level capture index.

write(): each task writes its pages as gzip members of one archive file in the shared folder and returns a capture line for each
record. The lines, sorted by reversed-host URL key, are cut in blocks of BLOCK_LINES, each compressed by itself; the sparse directory
(first and last key, file, offset, length of each block) is the second level. lookup() finds the captures of many keys: each key goes to
the index files that can hold it, a file's keys meet its part of the directory in one task, and bisection of that part and then of a
block gives the lines, so that neither directory nor keys are ever in one place. read() reads records by the ranges that a lookup gives;
find() does the same for one URL on the driver.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is the response and the others are
revisits; smaller payloads are always responses. Null html is an empty payload; null urls have the key ``-``. Rows that repeat a
page_id each get a record. A record with a null page_id is always a response. Files of failed or repeated task
attempts have names of their own and no capture line points to them. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table

MIN_REVISIT = 1000
BLOCK_LINES = 1000
STAMP = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.b.example.com:80/x?q -> com,example,b)/x?q"""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return re.sub(r"\s+", "%20", url or "") or "-"
    if not host:
        return re.sub(r"\s+", "%20", url or "") or "-"
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    port = f":{port}" if port and port not in (80, 443) else ""
    return re.sub(r"\s+", "%20", f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}")


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no content of its own."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {STAMP}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record of another length than it says")
    return fields, rest[:n]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Archive:
    root: str
    lines: DataFrame  #: key, page_id, file, offset, length
    directory: DataFrame  #: first_key, last_key, file, offset, length, n
    files: list[tuple[str, str, str]]  #: first and last key and name of each index file, sorted; as many as index() had tasks


def write(pages: DataFrame, root: str | None = None) -> Archive:
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    sums = pages.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    heads = sums.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # an id may come with several payloads; the digest tells them apart
    refers = sums.join(heads, "digest").where("page_id <> refers_to").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    digest = F.sha1(F.col("html").cast("binary"))
    rows = pages.withColumn("digest", digest)
    rows = rows.join(refers, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")
    rows = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, offset = None, 0
        try:
            for pdf in batches:
                if out is None:
                    fs, base = _files(root)
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                lines = []
                for page, url, html, digest, refers in zip(*(pdf[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    raw = _gzip(record(page, url, html.encode(), digest, refers))
                    out.write(raw)
                    lines.append((surt(url), page, name, offset, len(raw)))
                    offset += len(raw)
                yield pd.DataFrame(lines, columns=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    lines = cut(rows.mapInPandas(archive, "key string, page_id string, file string, offset long, length long"))
    directory = index(lines, root)
    files = directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()
    return Archive(root, lines, directory, sorted((r["first"], r["last"], r["file"]) for r in files))


def index(lines: DataFrame, root: str) -> DataFrame:
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, offset, wait = None, 0, []

        def put() -> tuple:
            nonlocal offset, wait
            raw = _gzip("".join(x[1] for x in wait).encode())
            out.write(raw)
            row = (wait[0][0], wait[-1][0], name, offset, len(raw), len(wait))
            offset, wait = offset + len(raw), []
            return row

        done = []
        for pdf in batches:
            if out is None:
                fs, base = _files(root)
                fs.create_dir(base, recursive=True)
                name = f"index-{uuid.uuid4().hex}.cdx.gz"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for key, page, file, at, n in zip(*(pdf[c] for c in ("key", "page_id", "file", "offset", "length"))):
                wait.append((key, f"{key} {json.dumps({'page': page, 'file': file, 'offset': int(at), 'length': int(n)})}\n"))
                if len(wait) == BLOCK_LINES:
                    done.append(put())
        if wait:
            done.append(put())
        if out is not None:
            out.close()
            yield pd.DataFrame(done, columns=["first_key", "last_key", "file", "offset", "length", "n"])

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a key of many captures is spread by the page
    ordered = lines.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return cut(ordered.mapInPandas(blocks, "first_key string, last_key string, file string, offset long, length long, n int"))


def _range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def _block(fs, base: str, file: str, offset: int, length: int) -> list[str]:
    return zlib.decompress(_range(fs, f"{base}/{file}", offset, length), 31).decode().splitlines()


def holders(files: list[tuple[str, str, str]], key: str) -> list[str]:
    """The index files that can hold a key; a key of many captures may be in several."""
    at, out = bisect.bisect_left(files, key, key=lambda f: f[1]), []
    while at < len(files) and files[at][0] <= key:
        out.append(files[at][2])
        at += 1
    return out


class Blocks:
    """The part of the directory that belongs to one index file, and its blocks, of which the last read one is kept."""

    def __init__(self, root: str, file: str, rows: list[tuple]) -> None:
        """rows: (first_key, last_key, offset, length) of each block."""
        self.fs, self.base = _files(root)
        self.file, self.rows = file, sorted(rows, key=lambda r: r[2])
        self.at, self.keys, self.lines = -1, [], []

    def captures(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the records of a key."""
        at = bisect.bisect_left(self.rows, key, key=lambda r: r[1])
        while at < len(self.rows) and self.rows[at][0] <= key:
            if at != self.at:
                self.at, self.lines = at, _block(self.fs, self.base, self.file, int(self.rows[at][2]), int(self.rows[at][3]))
                self.keys = [x.split(" ", 1)[0] for x in self.lines]
            for x in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                got = json.loads(x.split(" ", 1)[1])
                yield got["file"], got["offset"], got["length"]
            at += 1


def url_keys(urls: DataFrame) -> DataFrame:
    """The distinct keys of a column url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": [surt(u) for u in pdf["url"]]})

    return urls.select("url").distinct().mapInPandas(run, "key string").distinct()


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """(file, offset, length) of all captures of distinct keys."""
    root, files = archive.root, archive.files

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(name, key) for key in pdf["key"] for name in holders(files, key)], columns=["index_file", "key"])

    def look(file: tuple, keys: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows = Blocks(root, file[0], list(zip(*(blocks[c] for c in ("first_key", "last_key", "offset", "length")))))
        return pd.DataFrame([c for key in sorted(keys["key"]) for c in rows.captures(key)], columns=["file", "offset", "length"])

    wanted = keys.select("key").mapInPandas(route, "index_file string, key string")
    return wanted.groupBy("index_file").cogroup(archive.directory.groupBy("file")).applyInPandas(look, "file string, offset long, length long")


def read(archive: Archive, captures: DataFrame) -> DataFrame:
    """Records from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    root = archive.root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _files(root)
        name, f = None, None
        for pdf in batches:
            rows = []
            for file, at, n in zip(pdf["file"], pdf["offset"], pdf["length"]):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                f.seek(int(at))
                rows.append(_row(f.read(int(n))))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if f is not None:
            f.close()

    n = int(archive.lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = captures.repartition(n, "file", F.floor(F.col("offset") / 4_000_000)).sortWithinPartitions("file", "offset")
    out = at.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def _row(raw: bytes) -> tuple:
    fields, body = parse(zlib.decompress(raw, 31))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload has another digest")
    ident = lambda x: x[10:-1] or None if x else None
    return ident(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, kind, ident(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]


def find(archive: Archive, url: str) -> list[tuple]:
    """Records of one URL: bisection of the index files, of the directory's part of each, and of the block, then range reads."""
    key = surt(url)
    fs, base = _files(archive.root)
    out = []
    for name in holders(archive.files, key):
        part = archive.directory.where(F.col("file") == name).select("first_key", "last_key", "offset", "length").collect()
        for file, at, n in Blocks(archive.root, name, [tuple(r) for r in part]).captures(key):
            out.append(_row(_range(fs, f"{base}/{file}", at, n)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write(pages)
    return read(archive, lookup(archive, url_keys(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest,
    max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to
FROM m
"""
