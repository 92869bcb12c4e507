"""Reported summaries against the same figures recomputed from raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(reported: DataFrame, recomputed: DataFrame, key: str, pairs: dict[str, tuple[str, float]], label: str | None = None, examples: int = 5) -> DataFrame:
    """For each reported column: compared, max_abs_diff, tolerance, outside_tolerance, missing_on_one_side, examples.

    pairs: reported column -> (recomputed column, tolerance). One join and one aggregate for all columns.
    """
    mine = recomputed.select(F.col(key).alias("_k"), *[F.col(m).cast("double").alias(f"_m{i}") for i, (m, _) in enumerate(pairs.values())])
    j = reported.join(mine, F.col(key) == F.col("_k"), "left")
    cells = []
    for i, (col, (_, tol)) in enumerate(pairs.items()):
        a, b = F.col(col).cast("double"), F.col(f"_m{i}")
        cells.append(F.struct(F.lit(col).alias("field"), a.alias("a"), b.alias("b"), F.lit(float(tol)).alias("tol")))
    x = j.select(F.col(label or key).cast("string").alias("label"), F.explode(F.array(*cells)).alias("c")).select("label", "c.*")
    diff = F.abs(F.col("a") - F.col("b"))
    off = diff > F.col("tol")
    agg = x.groupBy("field").agg(
        F.count(diff).alias("compared"),
        F.max(diff).alias("max_abs_diff"),
        F.first("tol").alias("tolerance"),
        F.count_if(off).alias("outside_tolerance"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("missing_on_one_side"),
    )
    if not examples:
        return agg
    from pyspark.sql import Window

    w = Window.partitionBy("field").orderBy("label")
    few = x.where(off).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples)
    few = few.groupBy("field").agg(F.array_sort(F.collect_list("label")).alias("examples"))
    return agg.join(few, "field", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def ratio_of_means(rows: DataFrame, key: str, numerator: str, denominator: str) -> DataFrame:
    """(key, ratio_pct): 100 * mean(numerator) / mean(denominator), not the mean of ratios."""
    return rows.groupBy(key).agg((100.0 * F.try_divide(F.avg(numerator), F.avg(denominator))).alias("ratio_pct"))


def excluded_records(operations: DataFrame, key: str, kind: Column, status: Column, listed: list[str]) -> DataFrame:
    """(key): records with a missed operation of a listed kind."""
    return operations.where((F.upper(status) == "MISSED") & F.upper(kind).isin(*[x.upper() for x in listed]) & F.col(key).isNotNull()).select(key).distinct()
