"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def session(app: str = "evidra", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under that of spark.checkpoint.dir. Only a local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder of spark.checkpoint.dir and read again: what is read twice is the same rows in the same files,
    whatever a second run of the plan would give."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS = 500_000  #: rows of a partition that dealt() aims at


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key to as many partitions as that many rows need, so that a task's memory does not grow with the table. Few rows are
    left to Spark, which makes at least a partition for each core."""
    n = -(-rows // ROWS)
    return df.repartition(n, key) if n > df.sparkSession.sparkContext.defaultParallelism else df


def in_ranges(df: DataFrame, order: str, descending: bool = False) -> DataFrame:
    """df with _p, the number of the range of its order column that a row lies in. Ranges are sampled anew by each run of a plan, so
    that the rows are written with their range's number before anything is counted by it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(order).desc() if descending else F.col(order).asc()
    return pinned(df.repartitionByRange(n, by).withColumn("_p", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """df with running sums of columns (new name -> column) over the distinct values of order, and the totals. Sums go by ranges, and
    one row for each range, of which there are as many as shuffle partitions, gives the offsets."""
    parted = in_ranges(df, order, descending)
    rows = sorted(tuple(r) for r in parted.groupBy("_p").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect())
    before, total = [], [0] * len(sums)
    for p, *parts in rows:
        before.append((p, *total))
        total = [a + b for a, b in zip(total, parts)]
    schema = "_p int" + "".join(f", _before{i} long" for i in range(len(sums)))
    starts = F.broadcast(df.sparkSession.createDataFrame(before, schema))  # a row for each range
    w = Window.partitionBy("_p").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(starts, "_p")
    out = out.withColumns({name: F.sum(F.col(c)).over(w) + F.col(f"_before{i}") for i, (name, c) in enumerate(sums.items())})
    return out.drop("_p", *[f"_before{i}" for i in range(len(sums))]), dict(zip(sums, total))


def previous(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with _was_<column>: the value in the row before, by the order column (null in the first). Rows are compared inside ranges, and
    one row for each range, of which there are as many as shuffle partitions, carries the values over their edges."""
    parted = in_ranges(df, order)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ends = sorted((r["_p"], r["last"]) for r in parted.groupBy("_p").agg(F.max_by(F.struct(*columns), order).alias("last")).collect())
    carried = [(p, *(ends[i - 1][1] if i else [None] * len(columns))) for i, (p, _) in enumerate(ends)]
    schema = "_p int" + "".join(f", `_edge_{c}` {kinds[c]}" for c in columns)
    w = Window.partitionBy("_p").orderBy(order)
    out = parted.join(F.broadcast(df.sparkSession.createDataFrame(carried, schema)), "_p").withColumn("_n", F.row_number().over(w))
    out = out.withColumns({f"_was_{c}": F.when(F.col("_n") > 1, F.lag(c).over(w)).otherwise(F.col(f"_edge_{c}")) for c in columns})
    return out.drop("_p", "_n", *[f"_edge_{c}" for c in columns])
