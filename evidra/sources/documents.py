"""Documents: kind by magic bytes, text and tables of HTML, header rows and numeric cells of free tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tags


def kind(content: Column, path: Column) -> Column:
    """pdf, image, docx, pptx, xlsx, zip, html, text or other. Office files name their main folder near the start of the archive."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    names = F.decode(content, "ISO-8859-1")
    zipped = F.when(F.contains(names, F.lit("word/document.xml")), "docx").when(F.contains(names, F.lit("ppt/presentation.xml")), "pptx").when(F.contains(names, F.lit("xl/workbook.xml")), "xlsx").otherwise("zip")
    image = head.startswith("89504E47") | head.startswith("FFD8FF") | head.startswith("474946") | head.startswith("49492A00") | head.startswith("4D4D002A")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(image, "image")
        .when(head.startswith("504B0304"), zipped)
        .when(text.rlike(r"^\s*(<!doctype html|<html|<head|<body)") | F.lower(path).rlike(r"\.html?$"), "html")
        .when(~text.rlike(r"[\x00-\x08\x0e-\x1f]"), "text")
        .otherwise("other")
    )


def read(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, sha256, kind, text): text of html and plain text files; others need an extractor (see extract)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    f = files.select("path", F.sha2("content", 256).alias("sha256"), kind(F.col("content"), F.col("path")).alias("kind"), "content")
    plain = F.decode("content", "UTF-8")
    return f.select("path", "sha256", "kind", F.when(F.col("kind") == "html", strip_tags(plain)).when(F.col("kind") == "text", plain).alias("text"), "content")


def extract(docs: DataFrame) -> DataFrame:
    """(path, page, method, text) of pdf and docx files, where their libraries are installed; otherwise method is ``unavailable``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, what, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                rows += [(path, i, m, t) for i, (m, t) in enumerate(_pages(what, bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "method", "text"])

    return docs.where(F.col("kind").isin("pdf", "docx", "pptx")).select("path", "kind", "content").mapInPandas(run, "path string, page int, method string, text string")


def _pages(what: str, content: bytes) -> list[tuple[str, str | None]]:
    import io
    import zipfile

    if what == "docx":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
        return [("docx", re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml)).strip())]
    if what == "pptx":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            return [("pptx", re.sub(r"<[^>]+>", "", re.sub(r"</a:p>", "\n", z.read(n).decode("utf-8", "replace"))).strip()) for n in slides]
    try:
        import pypdf
    except ImportError:
        return [("unavailable", None)]
    return [("pypdf", p.extract_text()) for p in pypdf.PdfReader(io.BytesIO(content)).pages]


class _Tables(HTMLParser):
    """Cells of every table, in order; a table in a cell belongs to itself."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.open:
            rows = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in self.open.pop() if r]
            if rows:
                self.done.append(rows)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] and self.open[-1][-1] and not self.skip:
            self.open[-1][-1][-1] += data


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells) of every table row."""
    kind_of = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[html]):
                p = _Tables()
                p.feed(text or "")
                rows += [(k, t, r, cells) for t, table in enumerate(p.done) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind_of}, table_no int, row_no int, cells array<string>")


def office_tables(docs: DataFrame) -> DataFrame:
    """(path, page, table_no, row_no, cells) of the tables in docx and pptx files; page is the slide, or 1. docs: rows of read()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (path, page, t, r, cells)
                for path, what, content in zip(pdf["path"], pdf["kind"], pdf["content"])
                for page, tables in enumerate(_office(what, bytes(content)), 1)
                for t, table in enumerate(tables)
                for r, cells in enumerate(table)
            ]
            yield pd.DataFrame(rows, columns=["path", "page", "table_no", "row_no", "cells"])

    wanted = docs.where(F.col("kind").isin("docx", "pptx")).select("path", "kind", "content")
    return wanted.mapInPandas(run, "path string, page int, table_no int, row_no int, cells array<string>")


def _office(what: str, content: bytes) -> Iterator[list[list[list[str]]]]:
    """The tables of each part. Word and slide markup differ in the namespace only."""
    import io
    import zipfile
    from xml.etree import ElementTree

    parts = r"word/document\.xml" if what == "docx" else r"ppt/slides/slide\d+\.xml"
    named = lambda node, name: (x for x in node.iter() if x.tag.rpartition("}")[2] == name)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(parts, n)), key=lambda n: int("0" + "".join(re.findall(r"\d+", n)))):
            root = ElementTree.fromstring(z.read(name))
            text = lambda cell: re.sub(r"\s+", " ", " ".join("".join(t.text or "" for t in named(p, "t")) for p in named(cell, "p"))).strip()
            yield [[[text(c) for c in row if c.tag.rpartition("}")[2] == "tc"] for row in table if row.tag.rpartition("}")[2] == "tr"] for table in named(root, "tbl")]


def rejections(docs: DataFrame, assessed: DataFrame) -> DataFrame:
    """(path, kind, sha256, n_words, reason) of documents that were judged irrelevant: what is kept of them. assessed: (path, n_words,
    probability, decision) of relevance.assess()."""
    out = assessed.where("decision = 'IRRELEVANT'").select("path", "n_words", F.round("probability", 3).alias("_p"))
    reason = F.concat(F.lit("relevance "), F.col("_p").cast("string"), F.lit(" is at or below the limit"))
    return docs.select("path", "kind", "sha256").join(out, "path").select("path", "kind", "sha256", "n_words", reason.alias("reason"))


def header_row(rows: DataFrame, keys: list[str], scan: int = 10, least: int = 3) -> DataFrame:
    """(keys, header_no, header): the first row with enough text cells and no number among them; else the first row."""
    text = F.filter("cells", lambda c: (F.trim(c) != "") & number_cell(c).isNull())
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    good = (F.size(text) >= least) & (F.size(text) == F.size(filled)) & (F.col("row_no") < scan)
    best = rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(good, F.struct("row_no", "cells"))), F.min(F.struct("row_no", "cells"))).alias("h"))
    return best.select(*keys, F.col("h.row_no").alias("header_no"), F.col("h.cells").alias("header"))


def number_cell(c: Column) -> Column:
    """``1,5`` and ``85%`` are numbers."""
    return F.replace(F.regexp_replace(F.trim(c), r"\s*%$", ""), F.lit(","), F.lit(".")).try_cast("double")


def long_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, column, value, value_num) below the header; a column is numeric if over 90 % of its filled cells parse."""
    head = header_row(rows, keys)
    j = rows.join(head, keys).where("row_no > header_no").select(*keys, "row_no", "header", F.posexplode("cells").alias("_i", "value"))
    j = j.select(*keys, "row_no", F.upper(F.regexp_replace(F.trim(F.get("header", F.col("_i"))), r"[\s\-]+", "_")).alias("column"), "value")
    j = j.where((F.col("column") != "") & (F.trim("value") != ""))
    ok = j.groupBy(*keys, "column").agg((F.avg(number_cell(F.col("value")).isNotNull().cast("double")) > 0.9).alias("numeric"))
    return j.join(ok, [*keys, "column"]).select(*keys, "row_no", "column", "value", F.when(F.col("numeric"), number_cell(F.col("value"))).alias("value_num"))


def table_sources(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, score): what each free table is, by the best covered header signature (0.6 at least)."""
    from ..operators.detect import MIN_SCORE, SIGNATURES

    head = header_row(rows, keys)
    h = head.withColumn("h", F.transform("header", lambda c: F.upper(F.regexp_replace(F.trim(c), r"[\s\-]+", "_"))))
    flat = [(s, v) for s, variants in SIGNATURES.items() for v in variants]
    scored = F.array(*[F.struct((F.size(F.array_intersect("h", F.array(*[F.lit(c) for c in v]))) / len(v)).alias("score"), F.lit(-i).alias("order"), F.lit(s).alias("source")) for i, (s, v) in enumerate(flat)])
    best = h.withColumn("b", F.array_max(scored))
    return best.select(*keys, F.when(F.col("b.score") >= MIN_SCORE, F.col("b.source")).otherwise("UNKNOWN").alias("source"), F.col("b.score").alias("score"))
