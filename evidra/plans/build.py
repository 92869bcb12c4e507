"""Derived tables that are kept up to date: after an upload only what it reaches is computed again.

A build knows its sources and how each table follows from others. Every source has the hash of its content, every table a hash of its
own version and of what it is made from; a table whose hash is recorded is kept as it lies, its files unread. All tables count at once:
one record names the path and hash of each, written last, so that a failed update leaves everything as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, detect, profile, recompute
from ..operators.canonical import TRIAL
from ..sources import tabular
from . import serve


@dataclass(frozen=True)
class Table:
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"  #: to be changed with make


@dataclass
class Outcome:
    built: list[str]
    kept: list[str]


class Build:
    RECORD = "seq long, entries map<string, struct<path:string, hash:string>>"

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], profiles: tuple[str, ...] = ()) -> None:
        """tables: in an order in which each follows what it is made from. profiles: sources whose profiles are kept as well."""
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = dict(tables) | {f"profile_{s}": Table((s,), profile.profile) for s in profiles}

    def _record(self) -> tuple[int, dict[str, tuple[str, str]]]:
        try:
            rows = self.spark.read.schema(self.RECORD).json(f"{self.root}/records")
            row = rows.agg(F.max_by(F.struct("seq", "entries"), "seq").alias("r")).first()["r"]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["seq"], {k: (v["path"], v["hash"]) for k, v in row["entries"].items()}) if row else (0, {})

    def current(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(path) for n, (path, _) in self._record()[1].items()}

    def path(self, name: str) -> str:
        return self._record()[1][name][0]

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def update(self, sources: dict[str, DataFrame]) -> Outcome:
        """Takes new contents of some sources. A source that is the same as before, in whatever order its rows come, changes nothing."""
        seq, entries = self._record()
        entries, outcome = dict(entries), Outcome([], [])
        for name, df in sources.items():
            path = self._write(name, df)
            stored = self.spark.read.schema(df.schema).parquet(path)
            row = profile.content_hash(stored).first()
            content = hashlib.sha256(f"{row['rows']}:{row['hash']}:{stored.schema.simpleString()}".encode()).hexdigest()
            if entries.get(name, ("", ""))[1] != content:
                entries[name] = (path, content)
        for name, t in self.tables.items():
            if not all(i in entries for i in t.inputs):
                continue  # a source that it needs has never come
            mark = hashlib.sha256(":".join([t.version, *(entries[i][1] for i in t.inputs)]).encode()).hexdigest()
            if entries.get(name, ("", ""))[1] == mark:
                outcome.kept.append(name)
                continue
            made = t.make(*[self.spark.read.parquet(entries[i][0]) for i in t.inputs])
            entries[name] = (self._write(name, made), mark)
            outcome.built.append(name)
        self.spark.createDataFrame([(seq + 1, entries)], self.RECORD).coalesce(1).write.mode("append").json(f"{self.root}/records")
        return outcome


TRAITS = ["YIELD_T_HA", "MOISTURE_PCT", "DISEASE_SCORE"]

#: The canonical model. Sources: bridge, observations, operations, master, recommendations, genomics, summary.
CANONICAL = {
    "linked_operations": Table(("operations", "bridge"), canonical.linked_operations),
    "excluded": Table(("linked_operations",), lambda ops: recompute.excluded_records(ops, TRIAL, F.col("OPERATION_TYPE_LID"), F.col("STATUS_LID"), ["irrigation"])),
    "trial_material": Table(("observations", "bridge", "excluded"), lambda o, b, x: canonical.trial_material(o, b, x, TRAITS)),
    "trials": Table(("bridge", "linked_operations", "trial_material", "excluded"), canonical.trials),
    "materials": Table(("master", "recommendations", "bridge"), canonical.materials),
    "candidates": Table(("recommendations", "trial_material"), canonical.candidates),
    "long_view": Table(("trial_material", "summary", "materials"), canonical.long_view),
    "genomic_means": Table(("trial_material", "genomics"), canonical.genomic_means),
}


# fixed values: sources as they are recognised, and what the model calls them
SOURCES = {
    "trial_germplasm_bridge": "bridge", "observations": "observations", "field_operations": "operations", "germplasm": "master",
    "candidate_recommendations": "recommendations", "genomics": "genomics", "trial_recommendations": "summary", "trait_dictionary": "traits",
}
TYPES = {
    "NUMBER_VALUE": "double", "REPLICATION_NO": "int", "PLANNED_DATE": "timestamp", "ACTUAL_DATE": "timestamp", "GENOMIC_BREEDING_VALUE": "double",
    "N_TRIALS": "int", "N_TRIALS_USED": "int", "YIELD_VS_CHECK_PCT": "double", "START_YEAR": "int",
}


def sources_in(spark: SparkSession, directory: str, recursive: bool = False) -> dict[str, DataFrame]:
    """The model's sources among the files of a directory: recognised by their headers, files of one source put together (rows that several
    hold count once), typed, and plots with the code of their trait. Files that are not recognised are left out."""
    found: dict[str, DataFrame] = {}
    for path in tabular.discover(spark, directory, recursive):
        for df in tabular.read_file(spark, path).values():
            df = df.select(*[c for c in df.columns if not c.startswith("_")])
            name = SOURCES.get(detect.detect(df.columns).source)
            if name:
                found[name] = found[name].unionByName(df, allowMissingColumns=True) if name in found else df
    found = {n: tabular.typed(df.distinct(), TYPES) for n, df in found.items()}
    traits = found.pop("traits", None)
    if traits is not None and "observations" in found and "TRAIT_CODE" not in found["observations"].columns:
        codes = traits.groupBy("TRAIT_GUID").agg(F.min("TRAIT_CODE").alias("TRAIT_CODE"))
        found["observations"] = found["observations"].join(codes, "TRAIT_GUID", "left")
    return found


def from_directory(spark: SparkSession, directory: str, root: str, recursive: bool = False) -> tuple[Build, Outcome]:
    """Files to model in one call: what the sources of a directory allow is built, or brought up to date, and published at once."""
    build = Build(spark, root, CANONICAL)
    return build, build.update(sources_in(spark, directory, recursive))


def catalog(build: Build) -> serve.Catalog:
    """The published tables for read-only SQL."""
    return serve.Catalog(build.spark, build.current())
