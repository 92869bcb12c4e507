"""Snapshots, run records and pruning."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet") -> list[str]:
    """Every table under its name; an earlier snapshot there is replaced table by table."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.option("header", "true").csv(f"{directory}/{name}") if fmt == "csv" else writer.format(fmt).save(f"{directory}/{name}")
    return sorted(tables)


def save_run(spark: SparkSession, directory: str, stages: list[tuple[str, float, int]]) -> str:
    """Appends one run: (run, stage, seconds, rows)."""
    run = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    rows = [(run, s, float(t), int(n)) for s, t, n in stages]
    spark.createDataFrame(rows, "run string, stage string, seconds double, rows long").coalesce(1).write.mode("append").json(f"{directory}/runs")
    return run


def runs(spark: SparkSession, directory: str, keep: int = 50) -> DataFrame:
    """The newest runs."""
    df = spark.read.schema("run string, stage string, seconds double, rows long").json(f"{directory}/runs")
    newest = df.select("run").distinct().orderBy(F.desc("run")).limit(keep)
    return df.join(newest, "run", "left_semi")


def previous_run(spark: SparkSession, directory: str, exclude: str | None = None) -> str | None:
    df = runs(spark, directory)
    row = (df.where(F.col("run") != exclude) if exclude else df).agg(F.max("run")).first()
    return row[0]


class Versions:
    """Tables that are replaced all at once. A version is written to a folder of its own and counts once its record is appended, the last
    step; if anything fails before, readers and the next attempt still see the version before."""

    RECORD = "seq long, version string, tables array<string>"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _records(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.RECORD).json(f"{self.root}/records")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.RECORD)
            raise

    def publish(self, tables: dict[str, DataFrame]) -> str:
        now = datetime.now(timezone.utc)
        version = f"{now.strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
        row = (int(now.timestamp() * 1_000_000), version, sorted(tables))
        self.spark.createDataFrame([row], self.RECORD).coalesce(1).write.mode("append").json(f"{self.root}/records")
        return version

    def current(self) -> dict[str, DataFrame]:
        row = self._records().agg(F.max(F.struct("seq", "version", "tables")).alias("r")).first()["r"]
        return {n: self.spark.read.parquet(f"{self.root}/versions/{row['version']}/{n}") for n in row["tables"]} if row else {}

    def rebuild(self, build) -> str:
        """Publishes what build(current tables) gives; an error in it, or while its tables are written, leaves the version as it was."""
        return self.publish(build(self.current()))
