"""Tables from files and records, all text until a typed projection is applied, with their lineage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..session import pinned

DELIMITERS = (",", ";", "\t", "|")
HEAD_CHARS = 64_000


def normalise_header(name: str) -> str:
    """Trimmed, upper case, runs of blanks and dashes as one underscore."""
    return re.sub(r"[\s\-]+", "_", name.strip().lstrip("﻿")).upper()


def normalise_headers(df: DataFrame) -> DataFrame:
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = normalise_header(c) or "UNNAMED"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def sniff_delimiter(head: str) -> str:
    """The delimiter that splits the first lines most evenly; commas if none does."""
    lines = [x for x in head[:HEAD_CHARS].lstrip("﻿").splitlines() if x.strip()][:20]

    def fit(d: str) -> tuple[int, int]:
        counts = [len(re.sub(r'"[^"]*"', "", x).split(d)) - 1 for x in lines]
        return (min(counts, default=0), max(counts, default=0))

    best = max(DELIMITERS, key=fit)
    return best if fit(best)[1] else ","


def _head(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(20).collect()  # 20 lines, by Spark's own reader
    return "\n".join(r["value"] for r in rows)


def _lineage(df: DataFrame, upload: bool) -> DataFrame:
    return df.withColumn("_src_file", F.col("_metadata.file_path")).withColumn("_upload", F.lit(upload))


def read_csv(spark: SparkSession, path: str, upload: bool = False) -> DataFrame:
    sep = sniff_delimiter(_head(spark, path))
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return _names(df, upload)


def _names(df: DataFrame, upload: bool) -> DataFrame:
    columns = df.columns
    named = normalise_headers(df.limit(0)).columns
    return _lineage(df, upload).withColumnsRenamed(dict(zip(columns, named)))


def read_json(spark: SparkSession, path: str, upload: bool = False) -> dict[str, DataFrame]:
    """``[records]`` is one table named after nothing; ``{name: [records]}`` is a table for each name."""
    df = spark.read.json(path, multiLine=True)
    nested = [f for f in df.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    if nested and len(nested) == len(df.columns):
        return {f.name: normalise_headers(df.select(F.explode(f.name).alias("r")).select("r.*")).withColumn("_upload", F.lit(upload)) for f in nested}
    return {"": _names(df, upload)}


def read_parquet(spark: SparkSession, path: str, upload: bool = False) -> DataFrame:
    return _names(spark.read.parquet(path), upload)


def read_xlsx(spark: SparkSession, path: str, upload: bool = False) -> dict[str, DataFrame]:
    """A table for each sheet with rows; needs openpyxl. One task a file reads it."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("reading workbooks needs openpyxl") from e

    def sheets(batches):
        import io
        import json

        import openpyxl
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                book = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
                for sheet in book.worksheets:
                    rows = [[None if v is None else str(v) for v in r] for r in sheet.iter_rows(values_only=True)]
                    if len(rows) > 1:
                        head = [normalise_header(h or "") or f"UNNAMED_{i}" for i, h in enumerate(rows[0])]
                        yield pd.DataFrame({"sheet": sheet.title, "columns": json.dumps(head), "row": [json.dumps(dict(zip(head, r))) for r in rows[1:]]})

    flat = spark.read.format("binaryFile").load(path).select("content").mapInPandas(sheets, "sheet string, columns string, row string")
    flat = pinned(flat, "sheets")  # each workbook is opened once
    out = {}
    for r in flat.groupBy("sheet").agg(F.first("columns").alias("c")).collect():
        import json

        schema = ", ".join(f"`{c}` string" for c in json.loads(r["c"]))
        out[r["sheet"]] = flat.where(F.col("sheet") == r["sheet"]).select(F.from_json("row", schema).alias("r")).select("r.*").withColumn("_upload", F.lit(upload))
    return out


def from_records(spark: SparkSession, records: list[dict], label: str = "records") -> DataFrame:
    """Rows given in memory, as an upload; columns are the union of all records', values text."""
    names = list(dict.fromkeys(k for r in records for k in r))
    schema = ", ".join(f"`{n}` string" for n in names) or "`EMPTY` string"
    rows = [tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in records]
    df = normalise_headers(spark.createDataFrame(rows, schema))
    return df.withColumn("_src_file", F.lit(label)).withColumn("_upload", F.lit(True))


READERS = {".csv": read_csv, ".tsv": read_csv, ".txt": read_csv, ".json": read_json, ".parquet": read_parquet, ".xlsx": read_xlsx}


def read_file(spark: SparkSession, path: str, upload: bool = False) -> dict[str, DataFrame]:
    """Tables of one file by its extension; an unknown one is a ValueError."""
    match = re.search(r"(\.\w+)/?$", path)
    reader = READERS.get(match[1].lower() if match else "")
    if reader is None:
        raise ValueError(f"unsupported file: {path}")
    got = reader(spark, path, upload)
    return got if isinstance(got, dict) else {"": got}


def discover(spark: SparkSession, directory: str, recursive: bool = False) -> list[str]:
    """Paths of supported files, sorted; listed by Spark's file index, so any store that Spark reads will do."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory).select("path").collect()
    return sorted(r["path"] for r in rows if re.search(r"\.(csv|tsv|txt|json|parquet|xlsx)$", r["path"].lower()))


def load(spark: SparkSession, paths: list[str], upload: bool = False) -> dict[str, list[DataFrame]]:
    """Tables by the source that their headers tell; unknown ones under UNKNOWN."""
    out: dict[str, list[DataFrame]] = {}
    for path in paths:
        for df in read_file(spark, path, upload).values():
            out.setdefault(detect.detect([c for c in df.columns if not c.startswith("_")]).source, []).append(detect.rename_keys(df))
    return out


def typed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Casts that never fail: what does not parse is null, and so is NaN."""
    out = {}
    for c, t in schema.items():
        if c in df.columns:
            x = F.trim(F.col(c).cast("string"))
            x = F.try_to_timestamp(x) if t == "timestamp" else x.try_cast(t)
            out[c] = F.when(~F.isnan(x), x) if t in ("double", "float") else x
    return df.withColumns(out)
