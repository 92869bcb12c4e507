"""The grammar of identifier columns: shapes, per-position entropy, capacity and gaps of counters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import runs, shape
from ..session import previous
from .profile import GUID

SIZES = {"A": 26, "a": 26, "9": 10}


def families(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """(shape, pattern, n, n_distinct, share) of the most frequent shapes, by falling count, then shape."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v"))
    n = values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("shape", shape(F.col("v")))
    per = n.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    total = per.agg(F.sum("n").alias("total"))
    out = per.join(F.broadcast(total)).select("shape", runs(F.col("shape")).alias("pattern"), "n", "n_distinct", (F.col("n") / F.col("total")).alias("share"))
    return out.orderBy(F.desc("n"), "shape").limit(top)


def positions(df: DataFrame, column: str, family: str) -> DataFrame:
    """(pos, class, n_symbols, entropy, symbol) of the distinct values of one shape; symbol is set where it never varies."""
    values = df.where(shape(F.col(column)) == family).select(F.col(column).alias("v")).distinct()
    chars = values.select(F.posexplode(F.split("v", ""))).where("col <> ''")
    n = chars.groupBy("pos", "col").agg(F.count(F.lit(1)).alias("n"))
    h = F.greatest(F.lit(0.0), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"))
    return n.groupBy("pos").agg(
        shape(F.min("col")).alias("class"), F.count(F.lit(1)).alias("n_symbols"), h.alias("entropy"), F.when(F.count(F.lit(1)) == 1, F.min("col")).alias("symbol")
    )


def gaps(df: DataFrame, column: str, pattern: str = r"(\d+)$") -> DataFrame:
    """(lo, hi): runs of missing numbers of a counter. Neighbours are compared, no sequence of all numbers is made."""
    n = df.select(F.regexp_extract(column, pattern, 1).try_cast("long").alias("n")).where("n is not null").distinct()
    steps = previous(n, "n", ["n"])
    return steps.where(F.col("n") - F.col("_was_n") > 1).select((F.col("_was_n") + 1).alias("lo"), (F.col("n") - 1).alias("hi"))


def counter(df: DataFrame, column: str, pattern: str = r"(\d+)$") -> DataFrame:
    """One row: least, largest, n_distinct, n_gaps, contiguous."""
    n = df.select(F.regexp_extract(column, pattern, 1).try_cast("long").alias("n")).where("n is not null").distinct()
    out = n.agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("n_distinct"))
    missing = F.col("largest") - F.col("least") + 1 - F.col("n_distinct")
    return out.select("least", "largest", "n_distinct", missing.alias("n_gaps"), (missing == 0).alias("contiguous"))


def guids(df: DataFrame, column: str) -> DataFrame:
    """One row about a GUID column: n, n_distinct, n_prefixes and whether a counter made them (one prefix, dense last group)."""
    v = df.where(F.col(column).rlike(GUID)).select(F.upper(column).alias("v"))
    x = v.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("n", F.substring("v", 1, 23).alias("prefix"), F.conv(F.substring("v", 25, 12), 16, 10).cast("decimal(20,0)").alias("tail"))
    out = x.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.count_distinct("prefix").alias("n_prefixes"), F.min("tail").alias("lo"), F.max("tail").alias("hi"))
    dense = F.col("hi") - F.col("lo") + 1 <= 10 * F.col("n_distinct")
    return out.select("n", "n_distinct", "n_prefixes", ((F.col("n_prefixes") == 1) & dense).alias("sequential"))


def format_regex(pos: list, strict: bool = False) -> tuple[str, int]:
    """Regular expression and capacity of a family from the rows of positions(): digits are open, other symbols that never vary stay."""
    parts, capacity = [], 1
    for r in sorted(pos, key=lambda r: r["pos"]):
        if r["class"] == "9" and not (strict and r["symbol"] is not None):
            parts.append(r"\d")
            capacity *= 10
        elif r["symbol"] is not None:
            parts.append(re.escape(r["symbol"]))
        else:
            parts.append({"A": "[A-Z]", "a": "[a-z]"}.get(r["class"], "."))
            capacity *= SIZES.get(r["class"], 1)
    out, i = "", 0
    while i < len(parts):
        j = i
        while j < len(parts) and parts[j] == parts[i] and parts[i] in (r"\d", "[A-Z]", "[a-z]"):
            j += 1
        n = max(j - i, 1)
        out += parts[i] + (f"{{{n}}}" if n > 1 else "")
        i += n
    return f"^{out}$", capacity


def learn(df: DataFrame, columns: list[str], dominant: float = 0.95) -> dict[str, str]:
    """For each id column whose most frequent shape covers nearly all values, the pattern of its ids in running text."""
    out = {}
    for c in columns:
        best = families(df, c, 1).first()
        if best and best["share"] > dominant:
            regex, _ = format_regex(positions(df, c, best["shape"]).collect())
            out[c] = r"\b" + regex[1:-1] + r"\b"
    return out
