"""Drift between two runs: schema, population stability, mean shift, total variation and identity of inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import quantiles

FLOOR = 1e-4
MAX_LEVELS = 30
# fixed values: bands of the stability index
STABLE, MODERATE = 0.1, 0.25


def edges(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Inner decile edges of each numeric column, exact with linear interpolation, all from the same passes over long rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    return {r[0]: sorted(set(r[1:])) for r in quantiles(long, ["column"], "x", [i / 10 for i in range(1, 10)]).collect()}


def bin_of(c: Column, cuts: list[float]) -> Column:
    """Index of the bin: the number of edges below the value."""
    out = F.lit(0)
    for e in cuts:
        out = out + (c > e).cast("int")
    return F.when(c.isNotNull(), out)


FINGERPRINT = "column string, kind string, type string, bin int, edge double, level string, n long, total long, mean double, sd double"


def binned(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(column, bin, n, mean, var) of every column in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), bin_of(F.col(c).cast("double"), e).alias("bin"), F.col(c).cast("double").alias("x")) for c, e in cuts.items()])
    rows = df.select(F.explode(cells).alias("x")).select("x.*").where("bin is not null")
    return rows.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, total, levels) of columns of at most MAX_LEVELS levels."""
    from . import profile

    n = profile.value_counts(df, columns).where("value is not null")
    per = n.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("levels")).where(F.col("levels") <= MAX_LEVELS)
    return n.join(F.broadcast(per), "column")  # a row a column


def fingerprint(df: DataFrame, numeric: list[str], nominal: list[str] = ()) -> DataFrame:
    """What is kept of a run to compare the next one with, a few rows a column: of numeric columns each decile bin with its upper edge and
    rows, the mean and deviation; of nominal ones each level and its rows; of every column its type."""
    return df.sparkSession.createDataFrame(_fingerprint(df, list(numeric), list(nominal)), FINGERPRINT)


def _fingerprint(df: DataFrame, numeric: list[str], nominal: list[str]) -> list[tuple]:
    kinds = dict(df.dtypes)
    rows = [(c, "type", kinds[c], None, None, None, None, None, None, None) for c in df.columns]
    cuts = edges(df, numeric) if numeric else {}
    parts: dict[str, dict[int, tuple]] = {c: {} for c in cuts}
    for r in binned(df, cuts).collect() if cuts else []:
        parts[r["column"]][r["bin"]] = (r["n"], r["mean"], r["var"])
    for c, e in cuts.items():
        total = sum(n for n, _, _ in parts[c].values())
        mean = sum(n * m for n, m, _ in parts[c].values()) / total
        squares = sum(n * (v + (m - mean) ** 2) for n, m, v in parts[c].values())
        sd = math.sqrt(squares / (total - 1)) if total > 1 else None
        rows += [(c, "bin", kinds[c], i, e[i] if i < len(e) else None, None, parts[c].get(i, (0,))[0], total, mean, sd) for i in range(len(e) + 1)]
    if nominal:
        rows += [(r["column"], "level", kinds[r["column"]], None, None, r["value"], r["n"], r["total"], None, None) for r in levels(df, nominal).collect()]
    return rows


def since(fingerprint: DataFrame, current: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(column, kind, value, mean_shift_sd, worst, status): stability of numeric and variation of nominal columns against a stored
    fingerprint, whose run is not read again; worst and status are those of the whole table. Empty bins count as the floor. Columns that
    are gone are left out here; schema_since() names them."""
    return _since([tuple(r) for r in fingerprint.collect()], current, floor)  # a few rows a column


def _since(old: list[tuple], current: DataFrame, floor: float = FLOOR) -> DataFrame:
    spark, there = current.sparkSession, set(current.columns)
    bins = sorted((r for r in old if r[1] == "bin" and r[0] in there), key=lambda r: (r[0], r[3]))
    was_levels = {(r[0], r[5]): r[6] / r[7] for r in old if r[1] == "level" and r[0] in there}
    cuts: dict[str, list[float]] = {}
    for r in bins:
        cuts.setdefault(r[0], []).extend([r[4]] if r[4] is not None else [])
    rows = []
    now: dict[str, dict[int, tuple]] = {c: {} for c in cuts}
    for r in binned(current, cuts).collect() if cuts else []:
        now[r["column"]][r["bin"]] = (r["n"], r["mean"])
    for c in cuts:
        own = [r for r in bins if r[0] == c]
        total = sum(n for n, _ in now[c].values())
        psi = 0.0
        for r in own:
            e, a = max(r[6] / r[7], floor), max(now[c].get(r[3], (0,))[0] / total if total else 0.0, floor)
            psi += (a - e) * math.log(a / e)
        shift = (sum(n * m for n, m in now[c].values()) / total - own[0][8]) / own[0][9] if total and own[0][9] else None
        rows.append((c, "psi", psi, shift))
    schema = "column string, kind string, value double, mean_shift_sd double"
    out = spark.createDataFrame(rows, schema)
    if was_levels:
        from . import profile

        # what the current run holds may be many levels: they stay a table
        n = profile.value_counts(current, sorted({c for c, _ in was_levels})).where("value is not null")
        n = n.join(F.broadcast(n.groupBy("column").agg(F.sum("n").alias("total"))), "column").select("column", F.col("value").alias("level"), (F.col("n") / F.col("total")).alias("q"))
        j = spark.createDataFrame([(c, v, p) for (c, v), p in was_levels.items()], "column string, level string, p double").join(n, ["column", "level"], "full")
        gap = F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2
        out = out.unionByName(j.groupBy("column").agg(F.lit("tvd").alias("kind"), gap.alias("value"), F.lit(None).cast("double").alias("mean_shift_sd")))
    worst = out.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("worst"))  # one row
    return out.join(F.broadcast(worst)).withColumn("status", status(F.col("worst")))


def schema_since(fingerprint: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change) between the run of a fingerprint and a table."""
    was = {r["column"]: r["type"] for r in fingerprint.where("kind = 'type'").collect()}
    return _changes(current.sparkSession, was, dict(current.dtypes))


def stability(previous: DataFrame, current: DataFrame, columns: list[str], floor: float = FLOOR) -> DataFrame:
    """(column, psi, mean_shift_sd, status). Bins are the previous run's deciles."""
    out = _since(_fingerprint(previous, columns, []), current, floor)
    return out.select("column", F.col("value").alias("psi"), "mean_shift_sd", status(F.col("value")).alias("status"))


def status(psi: Column) -> Column:
    return F.when(psi < STABLE, "stable").when(psi < MODERATE, "moderate").otherwise("major")


def variation(previous: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, tvd): half the sum of absolute differences of the levels' shares, for columns of at most MAX_LEVELS levels."""
    return _since(_fingerprint(previous, [], columns), current).select("column", F.col("value").alias("tvd"))


def schema_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change): added, removed or retyped."""
    return _changes(previous.sparkSession, dict(previous.dtypes), dict(current.dtypes))


def schema_report(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change, was_filled, now_filled): schema_changes() with the cells that are not null in either run."""
    changes = schema_changes(previous, current)
    filled = None
    for name, df in (("was_filled", previous), ("now_filled", current)):
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        cells = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in df.columns])).alias("x")).select("x.*")
        filled = cells if filled is None else filled.join(cells, "column", "full")
    return changes.join(filled, "column").select("column", "change", "was_filled", "now_filled")


def _changes(spark, was: dict[str, str], now: dict[str, str]) -> DataFrame:
    rows = [(c, "added") for c in now if c not in was] + [(c, "removed") for c in was if c not in now]
    rows += [(c, f"{was[c]} -> {now[c]}") for c in now if c in was and was[c] != now[c]]
    return spark.createDataFrame(rows, "column string, change string")


def keys_lost(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(seen, lost, gained) keys between the runs."""
    a = previous.select(F.col(key).alias("k")).distinct().withColumn("was", F.lit(True))
    b = current.select(F.col(key).alias("k")).distinct().withColumn("now", F.lit(True))
    j = a.join(b, "k", "full")
    return j.agg(F.count_if(F.col("now")).alias("seen"), F.count_if(F.col("now").isNull()).alias("lost"), F.count_if(F.col("was").isNull()).alias("gained"))


def file_hashes(spark, path: str) -> DataFrame:
    """(path, length, sha256) of input files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def inputs_changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path) of files that are new or whose content differs. Both sides are rows of file_hashes()."""
    was = previous.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    j = current.join(was, F.col("path") == F.col("_p"), "left")
    return j.where(F.col("_h").isNull() | (F.col("_h") != F.col("sha256"))).select("path")


def report(previous: DataFrame, current: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """since() of two tables."""
    return _since(_fingerprint(previous, numeric, nominal), current)
