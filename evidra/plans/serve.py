"""Read access to decided tables: filtered lists, cards, comparison and guarded SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 500, 10_000


def candidates(decided: DataFrame, key: str, colour: str | None = None, atypical: bool | None = None, min_used: int = 0, used: str = "N_TRIALS_USED", limit: int | None = None) -> DataFrame:
    """RED before AMBER before GREEN, then by key; null counts of used records are 0."""
    out = decided
    if colour:
        out = out.where(F.upper("colour") == colour.upper())
    if atypical is not None:
        out = out.where(F.coalesce(F.col("atypical"), F.lit(False)) == atypical)
    if min_used:
        out = out.where(F.coalesce(F.col(used), F.lit(0)) >= min_used)
    rank = F.when(F.col("colour") == "RED", 0).when(F.col("colour") == "AMBER", 1).otherwise(2)
    out = out.orderBy(rank, key)
    return out.limit(limit) if limit is not None else out


def one(df: DataFrame, key: str, value) -> dict:
    """One row as a dict; an unknown key is a KeyError."""
    row = df.where(F.col(key) == value).limit(1).collect()
    if not row:
        raise KeyError(value)
    return row[0].asDict(recursive=True)


def compare(encoded: DataFrame, key: str, ids: list, most: int = 6) -> DataFrame:
    """(a, b, distance) of a few records."""
    if not 2 <= len(ids) <= most:
        raise ValueError(f"compare 2 to {most} records")
    few = encoded.where(F.col(key).isin(*ids)).select(key, "x")
    d2 = F.aggregate(F.zip_with("a.x", "b.x", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, y: acc + y)
    return few.alias("a").crossJoin(F.broadcast(few.alias("b"))).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.sqrt(d2).alias("distance"))


class Catalog:
    """Named tables for read-only SQL. Names are checked against the plan's own relations, so that no file or other table is reached."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables

    def sql(self, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        q = query.strip().rstrip(";").strip()
        if ";" in re.sub(r"'(?:[^']|'')*'", "''", q):
            raise ValueError("one statement only")
        if not re.match(r"(?is)^(select|with)\b", q):
            raise ValueError("only SELECT or WITH")
        if not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(q)
        text = plan.toString()
        names = {m.strip().lower() for m in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", text)}
        ctes = {m.strip().lower() for m in re.findall(r"(?i)(?:\bwith\b(?:\s+recursive)?|,)\s*([a-z_]\w*)\s*(?:\([^()]*\))?\s+as\s*\(", q)}
        unknown = names - {t.lower() for t in self.tables} - ctes
        if unknown or re.search(r"UnresolvedTableValuedFunction|'UnresolvedTVF", text):
            raise ValueError(f"unknown tables: {sorted(unknown) or 'table functions'}")
        used = [n for n in self.tables if n.lower() in names]
        for name in used:
            self.tables[name].createOrReplaceTempView(name)
        try:
            return self.spark.sql(q).limit(limit)  # resolved here: the views are not needed any more
        finally:
            for name in used:
                self.spark.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self.tables)


def envelope(df: DataFrame, order: list, limit: int = 20) -> tuple[dict, DataFrame]:
    """What a tool returns: total, returned, truncated and limit, and the first rows."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    total = df.count()
    return {"total": total, "returned": min(limit, total), "truncated": total > limit, "limit": limit}, df.orderBy(*order).limit(limit)


def cards(decided: DataFrame, rows: DataFrame, key: str, trial: str, verdict: str, statement: str, most: int = 50) -> DataFrame:
    """decided with what its records say: n_trials, n_fail and up to most trials (trial, verdict, statement), in order of the trial."""
    w = Window.partitionBy(key).orderBy(trial)
    ranked = rows.withColumn("_n", F.row_number().over(w))
    one = F.when(F.col("_n") <= most, F.struct(F.col(trial).cast("string").alias("trial"), F.col(verdict).alias("verdict"), F.col(statement).alias("statement"), F.col("_n").alias("n")))
    per = ranked.groupBy(F.col(key).alias("_k")).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col(verdict) == "FAIL").alias("n_fail"), F.array_sort(F.collect_list(one), lambda a, b: a["n"] - b["n"]).alias("trials")
    )
    out = decided.join(per, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumns({"n_trials": F.coalesce("n_trials", F.lit(0)), "n_fail": F.coalesce("n_fail", F.lit(0))})


def context(items: DataFrame, key: str, text: str, bits: str, budget: int, required: str | None = None) -> DataFrame:
    """(key, lines, tokens, n_items, n_left_out, tokens_of_all, saved): of each key's items as much information as a budget of tokens takes.

    An item costs a quarter of its characters in tokens, rounded up, and brings bits. Required items (a boolean column) come first, then
    those that bring most a token; items are taken in that order as long as all so far fit, in one pass of a window. A required item
    that alone exceeds the budget is left out as any other. saved is the share of tokens that is not sent.
    """
    cost = F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")
    first = F.coalesce(F.col(required), F.lit(False)) if required else F.lit(False)
    rows = items.where(F.length(text) > 0).select(F.col(key), F.col(text).alias("_t"), cost.alias("_c"), first.alias("_first"), F.coalesce(F.col(bits).cast("double"), F.lit(0.0)).alias("_b"))
    order = Window.partitionBy(key).orderBy(F.desc("_first"), F.desc(F.col("_b") / F.col("_c")), "_t")
    rows = rows.withColumn("_run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(order))
    fits = F.col("_run") <= budget
    taken = F.array_sort(F.collect_list(F.when(fits, F.struct("_n", "_t"))))  # within the budget, hence bounded
    out = rows.groupBy(key).agg(
        F.transform(taken, lambda x: x["_t"]).alias("lines"), F.coalesce(F.sum(F.when(fits, F.col("_c"))), F.lit(0)).alias("tokens"), F.count_if(fits).alias("n_items"),
        F.count_if(~fits).alias("n_left_out"), F.sum("_c").alias("tokens_of_all"),
    )
    return out.withColumn("saved", 1 - F.col("tokens") / F.col("tokens_of_all"))
