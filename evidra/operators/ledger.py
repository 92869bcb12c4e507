"""An append-only table whose rows can be proved to be those that were appended.

Rows come in batches. Every row has its place in the batch and the hash of its content; the hashes of a batch are hashed in groups of
FAN, those again, up to one root; and the record of a batch holds its size, its root and the hash of the record before, so that the
newest hash stands for all that was ever appended. Whoever keeps that hash elsewhere can tell whether anything was changed since. All
of it is groups of FAN rows or a row a batch, whatever a batch holds.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import in_ranges

FAN = 256
RECORD = "batch long, path string, n long, root string, previous string, hash string"
EMPTY = hashlib.sha256(b"").hexdigest()


def leaf(columns: list[str]) -> Column:
    """Hash of a row: names, values and which of them are null."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null"))) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *cells), 256)


def root_of(leaves: DataFrame, n: int) -> str:
    """The root over (pos, hash), n rows of them."""
    level, left = leaves.select("pos", "hash"), n
    while left > 1:
        groups = level.groupBy(F.floor(F.col("pos") / FAN).alias("pos"))
        level = groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"))
        left = -(-left // FAN)
    rows = level.limit(2).collect()
    return rows[0]["hash"] if len(rows) == 1 else EMPTY


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def records(self) -> DataFrame:
        try:
            return self.spark.read.schema(RECORD).json(f"{self.path}/records")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], RECORD)
            raise

    def head(self) -> str | None:
        """The newest hash, to be kept elsewhere."""
        row = self.records().agg(F.max_by("hash", "batch")).first()
        return row[0]

    def append(self, rows: DataFrame) -> str:
        """rows: any columns; equal rows may repeat. Returns the new head."""
        last = self.records().agg(F.max(F.struct("batch", "hash")).alias("r")).first()["r"]
        batch, previous = (last["batch"] + 1, last["hash"]) if last else (0, EMPTY)
        parted = in_ranges(rows.withColumn("hash", leaf(rows.columns)), "hash")
        counts = sorted((r["_p"], r["n"]) for r in parted.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
        starts, n = [], 0
        for p, k in counts:
            starts.append((p, n))
            n += k
        first = F.broadcast(self.spark.createDataFrame(starts, "_p int, _start long"))
        nth = F.row_number().over(Window.partitionBy("_p").orderBy("hash"))
        placed = parted.join(first, "_p").withColumn("pos", F.col("_start") + nth - 1).drop("_p", "_start")
        path = f"{self.path}/rows/{batch:08d}-{uuid.uuid4().hex}"
        placed.write.parquet(path)
        stored = self.spark.read.parquet(path)
        root = root_of(stored, n)
        own = _record_hash(batch, n, root, previous)
        self.spark.createDataFrame([(batch, path, n, root, previous, own)], RECORD).coalesce(1).write.mode("append").json(f"{self.path}/records")
        return own

    def read(self) -> DataFrame:
        """All rows, with their batch."""
        out = None
        for r in self.records().orderBy("batch").collect():  # a row a batch
            part = self.spark.read.parquet(r["path"]).drop("hash", "pos").withColumn("batch", F.lit(r["batch"]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], "batch long")

    def verify(self, head: str | None = None) -> DataFrame:
        """(batch, pos, fault) in order, none if all is as it was appended: a row was changed, removed or added (pos says which), the rows of a
        batch are not those of its root, a record is not the one that the next one names, or the newest is not the head that was kept."""
        rows = sorted(self.records().collect(), key=lambda r: r["batch"])  # a row a batch
        schema = "batch long, pos long, fault string"
        found, previous, frames = [], EMPTY, []
        for i, r in enumerate(rows):
            if r["batch"] != i or r["previous"] != previous or r["hash"] != _record_hash(r["batch"], r["n"], r["root"], r["previous"]):
                found.append((r["batch"], None, "chain"))
            previous = r["hash"]
            try:
                df = self.spark.read.parquet(r["path"])
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                found.append((r["batch"], None, "rows are gone"))
                continue
            own = leaf([c for c in df.columns if c not in ("hash", "pos")])
            place = F.lit(r["batch"]).cast("long").alias("batch")
            frames.append(df.where(F.col("hash") != own).select(place, "pos", F.lit("changed").alias("fault")))
            there = df.groupBy("pos").agg(F.count(F.lit(1)).alias("k"))
            every = self.spark.range(r["n"]).withColumnRenamed("id", "pos").join(there, "pos", "full")
            odd = F.when(F.col("k").isNull(), "removed").when((F.col("k") > 1) | (F.col("pos") >= r["n"]), "added")
            frames.append(every.withColumn("fault", odd).where("fault is not null").select(place, "pos", "fault"))
            if root_of(df.withColumn("hash", own), df.count()) != r["root"]:
                found.append((r["batch"], None, "root"))
        if head is not None and previous != head:
            found.append((len(rows), None, "head"))
        out = self.spark.createDataFrame(found, schema)
        for f in frames:
            out = out.unionByName(f)
        return out.orderBy("batch", F.col("pos").asc_nulls_last(), "fault")


def _record_hash(batch: int, n: int, root: str, previous: str) -> str:
    return hashlib.sha256(f"{batch}:{n}:{root}:{previous}".encode()).hexdigest()
