"""Relational operators with the semantics that the data model needs: order-aware dedup, latest rows, references, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned, running


def keep(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a stated order."""
    by = [c.desc() if last else c.asc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the largest sequence number of each key, by aggregation: no sort, and partial sums shrink hot keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def carry_forward(df: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Missing cells take the last known value of their key."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def current_state(df: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """One row a key: each column's last known value."""
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(F.max(seq).alias(seq), *known)


def references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(reference, n_references, n_resolved, share): non-null references that the parent table holds."""
    named = child.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(1).alias("_n"), F.lit(False).alias("_held"))
    held = parent.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("_k"), F.lit(0).alias("_n"), F.lit(True).alias("_held"))
    # the keys of both tables meet in one aggregate: nothing is sorted, and a task holds each key once
    keys = named.unionByName(held).groupBy("_k").agg(F.sum("_n").alias("n"), F.bool_or("_held").alias("_held"))
    return keys.agg(
        F.lit(name).alias("reference"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_references"),
        F.coalesce(F.sum(F.when(F.col("_held"), F.col("n"))), F.lit(0)).alias("n_resolved"),
        F.try_divide(F.coalesce(F.sum(F.when(F.col("_held"), F.col("n"))), F.lit(0)), F.sum("n")).alias("share"),
    )


def reassign_orphans(child: DataFrame, keys: list[str], parents: DataFrame, target: str) -> DataFrame:
    """Adds n_options and proposed: the one parent that shares the keys, if there is exactly one."""
    options = parents.groupBy(*keys).agg(F.count_distinct(target).alias("n_options"), F.min(target).alias("_only"))
    out = child.join(options, keys, "left").withColumn("n_options", F.coalesce("n_options", F.lit(0)))
    return out.withColumn("proposed", F.when(F.col("n_options") == 1, F.col("_only"))).drop("_only")


def lineage(materials: DataFrame, key: str, label: str, parents: dict[str, str]) -> DataFrame:
    """(key, one column a parent): the parent's label, or its key if it is unknown."""
    names = materials.groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_label"))
    out = materials
    for out_name, column in parents.items():
        found = names.withColumnsRenamed({"_k": f"_k_{out_name}", "_label": f"_l_{out_name}"})
        out = out.join(found, F.col(column) == F.col(f"_k_{out_name}"), "left")
        out = out.withColumn(out_name, F.coalesce(F.col(f"_l_{out_name}").cast("string"), F.col(column).cast("string"))).drop(f"_k_{out_name}", f"_l_{out_name}")
    return out.select(key, *parents)


def labels(df: DataFrame, column: str, prefix: str, width: int = 2) -> DataFrame:
    """(column, label): prefix-01.. in sorted order of the distinct values.

    Ranks come from range-partitioned counts and offsets, so that no single task sorts all values.
    """
    values = df.where(F.col(column).isNotNull()).select(column, F.lit(1).alias("_one")).distinct()
    ranked, _ = running(values, column, {"_rank": "_one"})
    return ranked.select(column, F.format_string(f"{prefix}-%0{width}d", "_rank").alias("label"))


def null_propagating_sum(c: Column) -> Column:
    """A total that is unknown as soon as one part is."""
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def merge_turns(messages: DataFrame, key: str, seq: str, role: str, text: str, sep: str = "\n") -> DataFrame:
    """Neighbouring messages of the same role become one: (key, first seq, role, text)."""
    w = Window.partitionBy(key).orderBy(seq)
    new = F.coalesce((F.lag(role).over(w) != F.col(role)).cast("int"), F.lit(1))
    runs = messages.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(text).alias("_t"))))
    out = runs.groupBy(key, "_run").agg(F.min(seq).alias(seq), F.first(role).alias(role), parts.alias("_parts"))
    return out.select(key, seq, role, F.array_join(F.transform("_parts", lambda x: x["_t"]), sep).alias(text))


def search(tables: dict[str, tuple[DataFrame, str, list[str]]], needle: str) -> DataFrame:
    """(kind, id, matched) of rows one of whose texts contains the needle, in any case. tables: kind -> (frame, id, text columns)."""
    out = None
    for kind, (df, key, columns) in tables.items():
        hit = F.coalesce(*[F.when(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())), F.lit(c)) for c in columns])
        part = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), hit.alias("matched")).where("matched is not null")
        out = part if out is None else out.unionByName(part)
    return out


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[int, DataFrame]:
    """The number of all rows, and one page of them."""
    return df.count(), df.orderBy(*order).offset(offset).limit(limit)


def short_list(values: Column, limit: int = 12) -> Column:
    """The first ids of an array and how many more there are."""
    more = F.concat(F.lit("... +"), (F.size(values) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(values) > limit, F.concat(F.slice(values, 1, limit), F.array(more))).otherwise(values)


def last_turns(messages: DataFrame, key: str, seq: str, role: str, text: str, n: int, eligible: Column, sep: str = "\n") -> DataFrame:
    """The last n eligible messages of each key, neighbours of one role merged."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    kept = messages.where(eligible).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return merge_turns(kept, key, seq, role, text, sep)


FEW_GROUPS = 10_000  #: so many groups' brackets are broadcast
ACCURACY = 10_000  #: of the sketch: its ranks are off by one in as many at most


def quantiles(df: DataFrame, keys: list[str], column: str, at: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles with linear interpolation, for groups of any size.

    A sketch brackets each quantile between two values. Only values inside a bracket, a few in ten thousand, are told apart; the others
    are counted by the gap between brackets that they lie in. Running sums over those few give the ranks. That the ranks fall inside
    the brackets is checked; if they don't, or if there are many groups, all values are ranked.
    """
    spark, key = df.sparkSession, F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_"))
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(key.alias("_k"), x.alias("_x"))
    near = 3.0 / ACCURACY
    cuts = [min(1.0, max(0.0, q + d)) for q in at for d in (-near, near)]
    sketch = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_total"), F.percentile_approx("_x", cuts, ACCURACY).alias("_b"))
    groups = sketch.limit(FEW_GROUPS + 1).collect()
    if len(groups) > FEW_GROUPS:
        return _ranged_quantiles(df, keys, column, at)
    held = rows.join(F.broadcast(spark.createDataFrame(groups, sketch.schema)), "_k")
    inside = F.lit(False)
    for i in range(len(at)):
        inside = inside | F.col("_x").between(F.col("_b")[2 * i], F.col("_b")[2 * i + 1])
    held = held.select("_k", "_total", "_x", F.size(F.filter("_b", lambda cut: cut < F.col("_x"))).alias("_gap"), F.when(inside, F.col("_x")).alias("_in"))
    few = held.groupBy("_k", "_total", "_gap", "_in").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"))
    run = F.sum("_n").over(Window.partitionBy("_k").orderBy("_least").rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.withColumn("_run", run)  # ranks from 0: this value has those from _run - _n to _run - 1
    picks = []
    for i, q in enumerate(at):
        place = (F.col("_total") - 1) * F.lit(float(q))
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_run") - F.col("_n") <= rank) & (rank < F.col("_run")), F.col("_in"))).alias(f"_{name}{i}"))
    found = ranked.groupBy("_k", "_total").agg(*picks)
    got = found.collect()  # a row a group
    if any(v is None for r in got for v in r[2:]):
        return _ranged_quantiles(df, keys, column, at)
    return _between(spark.createDataFrame(got, found.schema), keys, at)


def _between(found: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    out = []
    for i, q in enumerate(at):
        place = (F.col("_total") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{i}") + (place - F.floor(place)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], *out)


def _ranged_quantiles(df: DataFrame, keys: list[str], column: str, at: list[float]) -> DataFrame:
    """The same for any number of groups. Values are counted first; the counts lie in ranges of (keys, value), so that no task sorts or holds a whole group, and ranks follow
    from running sums within a range and the sums of the group's ranges before it.
    """
    spark, key = df.sparkSession, F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_"))
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(key.alias("_k"), x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = pinned(counts.repartitionByRange(n, "_k", "_x").withColumn("_p", F.spark_partition_id()), "quantiles")
    # a group's ranges follow each other, so that there are no more of these sums than ranges and groups
    ranges = parted.groupBy("_k", "_p").agg(F.sum("_n").alias("_s"))
    w = Window.partitionBy("_k").orderBy("_p")
    before = F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_s").over(Window.partitionBy("_k"))
    ranges = ranges.select("_k", "_p", before.alias("_before"), total.alias("_total"))
    inside = F.sum("_n").over(Window.partitionBy("_p", "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = parted.withColumn("_run", inside).join(ranges, ["_k", "_p"])
    last = F.col("_before") + F.col("_run")  # ranks from 0: this value has those from last - _n to last - 1
    first = last - F.col("_n")
    picks = []
    for i, q in enumerate(at):
        place = (F.col("_total") - 1) * F.lit(float(q))
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((first <= rank) & (rank < last), F.col("_x"))).alias(f"_{name}{i}"))
    found = ranked.groupBy("_k", "_total").agg(*picks)
    return _between(found, keys, at)
