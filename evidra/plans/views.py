"""Reports about a build: its identifiers, its issues, its trials and its last run, each as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identifiers

#: fixed values: severities, the worst first
SEVERITIES = ("critical", "warning", "info")


def patterns(columns: dict[str, tuple[DataFrame, str]], top: int = 5) -> DataFrame:
    """(name, shape, pattern, n, n_distinct, share, least, largest, n_gaps) of key columns: their most frequent shapes, and what the counter at
    the end of the values runs over. columns: name -> (frame, column)."""
    out = None
    for name, (df, column) in columns.items():
        run = identifiers.counter(df, column).select("least", "largest", "n_gaps")  # one row
        part = identifiers.families(df, column, top).join(F.broadcast(run)).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "shape", "pattern", "n", "n_distinct", "share", "least", "largest", "n_gaps")


def issues(found: DataFrame) -> DataFrame:
    """Issues in the order to read them: by severity, then by how many records they are about."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    return found.withColumn("priority", rank).orderBy("priority", F.desc("count"), "id")


def trials(decided: DataFrame, tested: DataFrame, facts: DataFrame, trial: str, name: str, material: str) -> DataFrame:
    """decided trials with the number of materials tested and of documents that name them. tested: (trial, material); facts: rows of
    facts.extract() with the document in ``document``; name: the column of the id that documents use."""
    n = tested.groupBy(F.col(trial).alias("_t")).agg(F.count_distinct(material).alias("n_materials"))
    named = facts.select("document", F.explode(F.flatten(F.map_values("ids"))).alias("_id")).groupBy(F.upper("_id").alias("_id")).agg(F.count_distinct("document").alias("n_documents"))
    out = decided.join(n, F.col(trial) == F.col("_t"), "left").join(named, F.upper(F.col(name).cast("string")) == F.col("_id"), "left")
    return out.drop("_t", "_id").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_materials", "n_documents")})


def diagnostics(runs: DataFrame, identities: DataFrame, drift: DataFrame) -> DataFrame:
    """(section, name, value, ok) of the last run: seconds of its stages, the numeric checks, and drift against the run before."""
    last = runs.agg(F.max("run").alias("run"))
    stages = runs.join(F.broadcast(last), "run").select(F.lit("run").alias("section"), F.col("stage").alias("name"), F.col("seconds").alias("value"), F.lit(True).alias("ok"))
    checks = identities.select(F.lit("numeric").alias("section"), F.col("check").alias("name"), "value", F.col("passed").alias("ok"))
    moved = drift.select(F.lit("drift").alias("section"), F.col("column").alias("name"), "value", (F.col("status") == "stable").alias("ok"))
    return stages.unionByName(checks).unionByName(moved)
