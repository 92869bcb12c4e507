"""Queries over the driver's tables, one or more for each operator; their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, encoding, text
from ..operators import audit, calibration, drift, facts, identifiers, ledger, neighbours, profile, quality, reconcile, recompute, relational, relevance, rules, search, spectral, topology, verification
from ..session import folder, table
from ..sources import documents
from . import canonical, serve, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(canonical.QUERIES)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and negative zero made zero: sums depend on the order of rows in the last bits."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


# ------------------------------------------------------------------------------------------------ orders as trials

ORDER_RULES = rules.TrialRules(
    [
        rules.Threshold("yield", "o_totalprice", ">=", 150000.0, 1.0, "price meets threshold", "price below target"),
        rules.Threshold("moisture", "mean_discount", "<=", 0.06, 0.1904, "discount meets threshold", "discount above target"),
        rules.Threshold("disease", "mean_tax", "<=", 0.05, 0.5644, "tax acceptable", "tax elevated"),
        rules.Threshold("genomic_value", "n_lines", ">=", 2.0, 0.0758, "lines favourable", "lines below target"),
    ],
    rules.Threshold("extra", "mean_quantity", ">", 20.0, bad="quantity below target"),
    weighted_cut=0.15,
    cut=0.4,
)


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the means of their lines; every eleventh price is unknown. Sums are exact in cents, so that any order of rows gives the same."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1)) / 100).alias("mean_discount"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count(F.lit(1)) / 100).alias("mean_tax"),
        (F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("mean_quantity"),
    )
    orders = table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    official = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "HOLD").otherwise("PASS")
    out = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", price.alias("o_totalprice"), official.alias("official"))
    return out.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query
def rules_trial_verdict(spark, d):
    out = ORDER_RULES.evaluate(order_facts(spark, d), "o_orderkey", "orders", "official")
    return rounded(out.select("o_orderkey", "official", "computed", "verdict", "colour", "agrees", "severity", "reason"))


@query
def rules_gate_and_severity_modes(spark, d):
    df = order_facts(spark, d)
    return df.select("o_orderkey", replace(ORDER_RULES, mode="gate").verdict().alias("gate"), replace(ORDER_RULES, mode="severity").verdict().alias("severity"))


@query
def rules_evidence_rows(spark, d):
    out = ORDER_RULES.evaluate(order_facts(spark, d), "o_orderkey", "orders")
    e = out.select("o_orderkey", F.explode("evidence").alias("e"))
    return rounded(e.select("o_orderkey", "e.rule", "e.field", "e.value_num", "e.op", "e.threshold", "e.passed", "e.statement"))


@query
def rules_shortfalls(spark, d):
    df = order_facts(spark, d)
    return rounded(df.select("o_orderkey", *[t.shortfall().alias(f"short_{t.name}") for t in ORDER_RULES.thresholds]))


@query
def rules_candidate_share(spark, d):
    orders = ORDER_RULES.evaluate(order_facts(spark, d), "o_orderkey", "orders", "official").select("o_custkey", "verdict")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.round("c_acctbal").alias("value"))
    out = rules.candidate_verdicts(orders, "o_custkey", cust, "value", rules.ShareRules(0.6, 0.5, 102.0, 3))
    return rounded(out.select("o_custkey", "n_records", "fail_share", "verdict", "colour"))


PART_RAG = rules.RagRules(
    [
        rules.Criterion("price_ratio", "ratio_pct", "price vs brand", True, 60, 95, must_word="minimum", percent=True),
        rules.Criterion("size", "p_size", "size", False, 45.0, 30.0),
        rules.Criterion("tax", "tax_mean", "tax", False, None, 0.045, 0.06),
    ],
    ["price_ratio", "size"],
    ["price_ratio", "size", "tax", "marker", "trials"],
    marker_field="p_type",
    marker_bad="STANDARD",
    used_field="n_used",
    min_used=20,
    green_field=None,
)


def part_facts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"), (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count(F.lit(1)) / 100).alias("tax_mean")
    )
    brand = parts.groupBy("p_brand").agg((F.sum(F.round(F.col("p_retailprice") * 100).cast("long")) / F.count(F.lit(1)) / 100).alias("brand_price"))
    j = parts.join(brand, "p_brand").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    used = F.when(F.col("p_partkey") % 17 == 0, F.lit(0)).otherwise(F.coalesce("n_lines", F.lit(0)))
    return j.select("p_partkey", "p_brand", "p_type", "p_size", F.round(100 * F.col("p_retailprice") / F.col("brand_price"), 2).alias("ratio_pct"), F.round("tax_mean", 4).alias("tax_mean"), used.alias("n_used"))


@query
def rules_candidate_rag(spark, d):
    out = PART_RAG.evaluate(part_facts(spark, d))
    return out.select("p_partkey", "computed_colour", "colour", "reason")


@query
def rules_record_verdict(spark, d):
    p = part_facts(spark, d)
    v = rules.record_verdict(F.col("n_used") > 0, F.col("ratio_pct"), F.col("p_size") / 5.0, F.col("tax_mean") * 500)
    return p.select("p_partkey", v.alias("verdict"))


@query
def rules_parity(spark, d):
    out = ORDER_RULES.evaluate(order_facts(spark, d), "o_orderkey", "orders", "official")
    return rounded(rules.parity(out, "official", "computed"))


@query
def rules_confusion(spark, d):
    out = ORDER_RULES.evaluate(order_facts(spark, d), "o_orderkey", "orders", "official")
    return rules.confusion(out, "official", "computed")


@query
def rules_evidence_reread(spark, d):
    df = order_facts(spark, d)
    decided = ORDER_RULES.evaluate(df, "o_orderkey", "orders")
    changed = df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rounded(rules.reread_mismatches(decided, changed, "o_orderkey", ["o_totalprice", "n_lines"]))


@query
def rules_what_if(spark, d):
    df = order_facts(spark, d).withColumn("alt", F.col("o_totalprice") * 0.8)
    return rules.what_if(df, ORDER_RULES, {"o_totalprice": "alt"}, "official")


@query
def rules_mismatch_causes(spark, d):
    # every mismatch is diagnosed; n counts those whose id is divisible by 100, n_all all of them
    out = rules.diagnose(order_facts(spark, d), replace(ORDER_RULES, mode="severity"), "o_orderkey", "official", 5, (0.3, 0.5))
    return out.groupBy("cause").agg(F.count_if(F.col("o_orderkey") % 100 == 0).alias("n"), F.count(F.lit(1)).alias("n_all"))


# ------------------------------------------------------------------------------------------------ recompute and reconcile


@query
def recompute_summary(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    reported = lines.select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 29 == 0, F.lit(None)).otherwise(F.round(F.col("cents") / 100) + F.when(F.col("l_orderkey") % 13 == 0, 2).otherwise(0)).alias("total"),
        (F.col("n") + F.when(F.col("l_orderkey") % 17 == 0, 1).otherwise(0)).alias("n_lines"),
    )
    mine = lines.select("l_orderkey", (F.col("cents") / 100).alias("total_mine"), F.col("n").alias("n_mine"))
    out = recompute.compare(reported, mine, "l_orderkey", {"total": ("total_mine", 0.501), "n_lines": ("n_mine", 0.0)}, examples=0)
    return rounded(out.select("field", "compared", "max_abs_diff", "tolerance", "outside_tolerance", "missing_on_one_side"), 4)


@query
def recompute_ratio_of_means(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(recompute.ratio_of_means(lines, "l_suppkey", "l_extendedprice", "p_retailprice"), 4)


@query
def recompute_excluded_orders(spark, d):
    ops = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "F", "MISSED").otherwise("DONE").alias("status"))
    gone = recompute.excluded_records(ops, "l_orderkey", F.col("kind"), F.col("status"), ["r"])
    orders = table(spark, d, "orders").join(gone, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_kept"))


def _upload(spark, d):
    """All orders again: some as they are, some changed, some with new keys; typed as text."""
    o = table(spark, d, "orders")
    key = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey"))
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 100).when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    return o.select(key.cast("string").alias("o_orderkey"), price.cast("string").alias("o_totalprice"), F.concat(F.lit(" "), "o_orderstatus").alias("o_orderstatus"))


@query
def reconcile_keyed(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = reconcile.classify(base, _upload(spark, d), "o_orderkey")
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "outcome", F.size("conflicts").alias("n_conflicts"))


@query
def reconcile_keyless(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    base = table(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_quantity", "l_returnflag")
    up = lines.withColumn("l_quantity", F.col("l_quantity").cast("string"))
    _, log = reconcile.add_rows(base, up)
    return log.select("outcome", F.col("n").cast("long").alias("n"))


@query
def reconcile_natural_key(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name")
    up = base.select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 4 == 0, 100000).otherwise(0)).alias("s_suppkey"), F.when(F.col("s_suppkey") % 8 == 0, F.concat("s_name", F.lit("x"))).otherwise(F.col("s_name")).alias("s_name"))
    out = reconcile.classify(base, up, "s_suppkey", "s_name")
    return out.select("s_suppkey", "outcome")


@query
def canonical_values(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, " NaN ").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0"))).when(F.col("o_orderkey") % 5 == 2, "TRUE").when(F.col("o_orderkey") % 5 == 3, F.concat("o_orderstatus", F.lit("  "))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    kind = F.regexp_extract(canon.canon(F.col("raw")), "^(num|bool|ts):", 1)
    return o.select(raw.alias("raw"), "o_custkey").select(F.coalesce(F.when(canon.canon(F.col("raw")).isNull(), "missing").otherwise(F.when(kind == "", "text").otherwise(kind))).alias("kind"), canon.same(F.col("raw"), F.col("o_custkey")).alias("is_key")).groupBy("kind", "is_key").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------ joins, references, lineage


def astray(key, n: int):
    """A foreign key that for every n-th value points nowhere: the tables themselves hold no orphan."""
    return F.when(key % n == 0, key + 1_000_000_000).otherwise(key)


@query
def join_reference_share(spark, d):
    orders, cust = table(spark, d, "orders"), table(spark, d, "customer")
    lines = table(spark, d, "lineitem").withColumn("l_orderkey", astray(F.col("l_orderkey"), 9))
    orders = orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 10 != 4, astray(F.col("o_custkey"), 7)))
    out = relational.references(lines, "l_orderkey", orders, "o_orderkey", "lineitem.l_orderkey -> orders")
    out = out.unionByName(relational.references(orders, "o_custkey", cust, "c_custkey", "orders.o_custkey -> customer"))
    return rounded(out)


@query
def join_orphans_flagged(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("hit"))
    lines = table(spark, d, "lineitem").join(orders, astray(F.col("l_orderkey"), 9) == F.col("k"), "left")
    return lines.groupBy("l_returnflag").agg(F.count_if(F.col("hit").isNull()).alias("n_orphans"), F.count(F.lit(1)).alias("n_lines"))


@query
def join_orphan_reassignment(spark, d):
    solvent = lambda c: (c > 0).cast("int")
    owners = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), solvent(F.col("s_acctbal")).alias("solvent"), F.col("s_suppkey").alias("owner"))
    lost = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), solvent(F.col("c_acctbal")).alias("solvent"))
    return relational.reassign_orphans(lost, ["nation", "solvent"], owners, "owner").select("c_custkey", "n_options", F.col("proposed").cast("string").alias("proposed"))


@query
def join_feature_table(spark, d):
    cust, nation, region = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderdate").alias("first_order"))
    j = cust.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.year("first_order").alias("first_year"))


@query
def join_lineage(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") > 10, F.floor(F.col("p_partkey") / 2)).alias("mother"), (F.col("p_partkey") + 100).alias("father"))
    return relational.lineage(parts, "p_partkey", "p_name", {"mother_name": "mother", "father_name": "father"}).select("p_partkey", F.col("mother_name").cast("string").alias("mother_name"), F.col("father_name").cast("string").alias("father_name"))


@query
def join_compare_suppliers(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.array(F.round("s_acctbal", 2), F.col("s_nationkey").cast("double")).alias("x"))
    return rounded(serve.compare(s, "s_suppkey", [1, 2, 3, 5, 8, 13]), 4)


@query
def join_latest_review(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    last = relational.latest(table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts")
    return rounded(users.join(last, "user_id", "left").select("user_id", "event_id", "value"))


@query
def join_check_yield(spark, d):
    lines = table(spark, d, "lineitem")
    checks = lines.where("l_returnflag = 'R'").groupBy("l_orderkey").agg((F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("check_mean"))
    own = lines.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg((F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("own_mean"))
    return rounded(own.join(checks, "l_orderkey", "left").select("l_orderkey", "own_mean", "check_mean", (100 * F.col("own_mean") / F.col("check_mean")).alias("vs_check_pct")))


@query
def join_nested_messages(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count(F.lit(1)).alias("n_turns"))


# ------------------------------------------------------------------------------------------------ aggregates, windows, sets


@query
def agg_grouped(spark, d):
    li = table(spark, d, "lineitem")
    out = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("l_quantity").alias("avg_qty"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("min_ship"), F.sum("l_extendedprice").alias("sum_price"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"),
    )
    return rounded(out, 3)


@query
def agg_conditional_share(spark, d):
    li = table(spark, d, "lineitem")
    flag = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_returnflag"))
    return rounded(li.groupBy("l_suppkey").agg((100 * F.avg(F.coalesce(flag == "R", F.lit(False)).cast("double"))).alias("returned_pct")))


@query
def agg_pivot_mean(spark, d):
    li = table(spark, d, "lineitem")
    out = li.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return rounded(out.select("l_suppkey", F.col("A").alias("qty_a"), F.col("N").alias("qty_n"), F.col("R").alias("qty_r")))


@query
def agg_sorted_unique_list(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query
def agg_distinct_pairs(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count_distinct(F.struct("o_orderpriority", F.year("o_orderdate"))).alias("n_environments"))


@query
def agg_value_counts(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = e.agg(F.sum("n").alias("total"))
    return rounded(e.join(F.broadcast(total)).select("event_type", "n", (F.col("n") / F.col("total")).alias("share")))


@query
def agg_keep_first_and_last(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    first = relational.keep(e, ["user_id"], [F.col("ts")]).select("user_id", F.col("event_id").alias("first_id"))
    last = relational.keep(e, ["user_id"], [F.col("ts")], last=True).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@query
def agg_crosstab_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@query
def agg_rollup_region(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    return rounded(c.rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents")))


@query
def agg_statistics(spark, d):
    o = table(spark, d, "orders")
    ranks = relational.quantiles(o, ["o_orderpriority"], "o_totalprice", [0.5, 0.9]).withColumnsRenamed({"q0": "median", "q1": "p90"})
    moments = o.groupBy("o_orderpriority").agg(
        F.stddev_samp("o_totalprice").alias("std"), F.corr("o_totalprice", F.col("o_custkey").cast("double")).alias("corr"), F.max(F.abs(F.col("o_totalprice") - 100000)).alias("max_gap")
    )
    return rounded(ranks.join(moments, "o_orderpriority"), 3)


@query
def agg_largest_three(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select("o_orderkey", "o_totalprice")


@query
def agg_null_propagating_cost(spark, d):
    e = table(spark, d, "events").withColumn("cost", F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100).cast("long")))
    return e.groupBy("user_id").agg(relational.null_propagating_sum(F.col("cost")).cast("string").alias("cost"), F.count(F.lit(1)).alias("n"))


@query
def window_carry_forward(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return rounded(relational.carry_forward(e, ["user_id"], "ts", ["last_purchase"]).select("user_id", "event_id", "last_purchase"))


@query
def window_current_state(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("error_id"))
    return rounded(relational.current_state(e, ["user_id"], "event_id", ["purchase", "error_id"]).select("user_id", "purchase", "error_id"))


@query
def window_running_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w).alias("running_cents"))


@query
def window_merge_turns(spark, d):
    c = table(spark, d, "conversations").withColumn("side", F.when(F.col("role") == "assistant", "assistant").otherwise("other"))
    out = relational.merge_turns(c, "conv_id", "turn", "side", "text")
    return out.select("conv_id", "turn", "side", "text")


@query
def window_labels(spark, d):
    return relational.labels(table(spark, d, "customer"), "c_mktsegment", "LOC")


@query
def set_operations(spark, d):
    o = table(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "minus": a.subtract(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("key_sum"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def set_union_by_name(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_nationkey < 5").select("c_custkey", "c_mktsegment")
    b = c.where("c_nationkey >= 20").select("c_custkey", "c_acctbal")
    return a.unionByName(b, allowMissingColumns=True)


# ------------------------------------------------------------------------------------------------ filters, search, serving


@query
def serve_candidates(spark, d):
    decided = PART_RAG.evaluate(part_facts(spark, d))
    return serve.candidates(decided, "p_partkey", colour="amber", min_used=3, used="n_used", limit=25).select("p_partkey", "colour", "n_used")


@query
def serve_colour_counts(spark, d):
    decided = PART_RAG.evaluate(part_facts(spark, d))
    return decided.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))


@query
def serve_text_search(spark, d):
    tables = {
        "customer": (table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"]),
        "supplier": (table(spark, d, "supplier"), "s_suppkey", ["s_name"]),
        "nation": (table(spark, d, "nation"), "n_nationkey", ["n_name"]),
    }
    return relational.search(tables, "0000007")


@query
def serve_index_search(spark, d):
    """The same by an index, which also holds the texts of documents and benchmark items."""
    tables = {
        "customer": (table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"]),
        "supplier": (table(spark, d, "supplier"), "s_suppkey", ["s_name"]),
        "item": (table(spark, d, "benchmark"), "item_id", ["text"]),
        "document": (table(spark, d, "documents"), "doc_id", ["text"]),
    }
    index = search.TextIndex(spark, folder(spark, "text-index"))
    for name in ("customer", "supplier", "document", "item"):  # four uploads
        index.add(search.entity_texts({name: tables[name]}))
    out = index.search("Über")
    for needle in ("000017", "ER T"):
        out = out.unionByName(index.search(needle))
    return out.groupBy("kind", "id", "field").agg(F.count(F.lit(1)).alias("needles"))


@query
def serve_context(spark, d):
    """Of each customer's orders, as evidence lines, what 40 tokens take; urgent ones are required, rare states bring more bits."""
    o = table(spark, d, "orders")
    n = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))  # a row a state
    total = n.agg(F.sum("n").alias("total"))
    bits = n.join(F.broadcast(total)).select("o_orderstatus", F.log2(F.col("total") / F.col("n")).alias("bits"))
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is "), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit(", and its priority was judged to be high")).otherwise(""))
    items = o.join(F.broadcast(bits), "o_orderstatus").select("o_custkey", line.alias("line"), "bits", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    out = serve.context(items, "o_custkey", "line", "bits", 40, "urgent")
    return rounded(out.withColumn("lines", F.array_join("lines", "; ")))


@query
def serve_app_list(spark, d):
    df = table(spark, d, "customer").where(F.col("c_mktsegment").ilike("%u%") & F.col("c_name").ilike("%1%"))
    total, page = relational.page(df, [F.desc("c_acctbal"), F.col("c_custkey")], 20, 10)
    return page.select("c_custkey", "c_acctbal", F.lit(total).cast("long").alias("total"))


@query
def serve_quarantine_flags(spark, d):
    ops = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.when(F.col("l_discount") > 0.08, "missed").when(F.col("l_tax") > 0.06, "Delayed").otherwise("DONE").alias("status"), F.when(F.col("l_linestatus") == "O", "paper").otherwise("APP").alias("via"))
    return quality.operation_flags(ops, "kind", "status", "via").groupBy("kind").agg(F.count_if("IS_DELAYED").alias("n_delayed"), F.count_if("IS_MISSED").alias("n_missed"), F.count_if("IS_OFFLINE").alias("n_offline"))


@query
def serve_read_only_sql(spark, d):
    cat = serve.Catalog(spark, {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")})
    return cat.sql("WITH t AS (SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT * FROM t;", limit=500)


@query
def audit_effective_colours(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("part").alias("level"), F.col("user_id").cast("string").alias("record"), F.element_at(F.create_map(F.lit("error"), F.lit("RED"), F.lit("view"), F.lit("AMBER")), F.col("event_type")).alias("new_colour"))
    latest = relational.latest(e.where("new_colour is not null"), ["level", "record"], "seq")
    decided = PART_RAG.evaluate(part_facts(spark, d))
    return audit.colour_counts(audit.effective(decided, latest, "p_partkey", "part"))


# ------------------------------------------------------------------------------------------------ profiles, identifiers, drift


@query
def profile_entropy(spark, d):
    o = profile.entropy(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])
    c = table(spark, d, "customer").withColumn("half", F.when(F.col("c_custkey") % 2 == 0, "x"))
    return rounded(o.unionByName(profile.entropy(c, ["c_mktsegment", "half"])))


@query
def profile_roles(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.lit("k").alias("constant"), F.lit(None).cast("string").alias("empty"), F.col("c_name").alias("FREE_COMMENT"))
    out = profile.profile(c, order_by="c_custkey")
    return out.select("column", "rows", "non_null", "distinct", "kind", "role")


@query
def profile_token_estimate(spark, d):
    return profile.token_estimate(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query
def profile_identifiers(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit(" cust-"), F.col("c_custkey").cast("string")).alias("ROW_ID"), F.col("c_name").alias("LABEL"))
    return profile.identifiers(c)


@query
def identifier_families(spark, d):
    a = identifiers.families(table(spark, d, "customer"), "c_name").withColumn("source", F.lit("customer"))
    b = identifiers.families(table(spark, d, "orders"), "o_orderpriority").withColumn("source", F.lit("priority"))
    return rounded(a.unionByName(b).select("source", "shape", "n", "n_distinct", "share"))


@query
def identifier_positions(spark, d):
    out = identifiers.positions(table(spark, d, "supplier"), "s_name", "Aaaaaaaa#999999999")
    return rounded(out.select("pos", "class", "n_symbols", "entropy", "symbol"))


def _counted(spark, d):
    """All customers; every 37th number and its neighbour name another counter's value, so that the counter has gaps."""
    n = F.col("c_custkey")
    return table(spark, d, "customer").select(F.when(n % 37 < 2, F.concat(F.lit("Customer#"), F.lpad((n + 5_000_000).cast("string"), 9, "0"))).otherwise(F.col("c_name")).alias("c_name"))


@query
def view_patterns(spark, d):
    columns = {"customer": (_counted(spark, d), "c_name"), "supplier": (table(spark, d, "supplier"), "s_name")}
    return rounded(views.patterns(columns))


@query
def identifier_gaps(spark, d):
    return identifiers.gaps(_counted(spark, d), "c_name")


@query
def identifier_counter(spark, d):
    return identifiers.counter(_counted(spark, d), "c_name")


def _years(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderdate < timestamp_ntz'1998-01-01'"), o.where("o_orderdate >= timestamp_ntz'1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)


@query
def drift_stability(spark, d):
    a, b = _years(spark, d)
    return rounded(drift.stability(a, b, ["o_totalprice"]), 4)


@query
def drift_variation(spark, d):
    a, b = _years(spark, d)
    b = b.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    return rounded(drift.variation(a, b, ["o_orderstatus", "o_orderpriority"]))


@query
def drift_keys(spark, d):
    a, b = _years(spark, d)
    return drift.keys_lost(a, b, "o_custkey")


# ------------------------------------------------------------------------------------------------ encodings, neighbours, spectra


SPECS = [
    encoding.Spec("o_totalprice", "affine"),
    encoding.Spec("o_orderpriority", "ordinal", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    encoding.Spec("o_orderstatus", "nominal", ("F", "O", "P")),
    encoding.Spec("o_orderdate", "cyclic"),
    encoding.Spec("absent", "affine"),
]


@query
def encode_table(spark, d):
    o = table(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")))
    out, names = encoding.encode(o, SPECS, "o_orderkey")
    return rounded(out.select("o_orderkey", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(names))]))


@query
def neighbours_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x * 1000).cast("double")).alias("x"))
    return neighbours.knn(v.where("id % 100 = 0"), v, 5, exclude_self=True).select("id", "neighbour", "distance2", "rank")


@query
def spectral_contributions(spark, d):
    o = table(spark, d, "orders")
    enc, names = encoding.encode(o, SPECS[:2] + [SPECS[3]], "o_orderkey")
    model = spectral.fit(enc, names)
    s = spectral.score(enc, "o_orderkey", model)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return rounded(s.select("o_orderkey", "t2", "q", (F.abs(total - F.col("t2")) < 1e-8).alias("adds_up")), 4)


@query
def topology_barcode(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rounded(topology.persistence(v))


# ------------------------------------------------------------------------------------------------ calibration


def _labelled(spark, d):
    labels = table(spark, d, "labels")
    return table(spark, d, "documents").join(labels, "doc_id").select("doc_id", "source", "lang", "n_chars", "quality")


@query
def calibrate_bayes_ceiling(spark, d):
    return rounded(calibration.bayes_ceiling(_labelled(spark, d), ["source", "lang"], "quality"))


@query
def calibrate_roc(spark, d):
    return rounded(calibration.roc(_labelled(spark, d), "n_chars", "quality").select("threshold", "tp", "fp", "tpr", "fpr"))


@query
def calibrate_auc(spark, d):
    return rounded(calibration.auc(_labelled(spark, d), "n_chars", "quality"))


@query
def calibrate_flags(spark, d):
    out = calibration.flags(order_facts(spark, d), ORDER_RULES.thresholds, "o_orderkey")
    return out.groupBy("yield", "moisture", "disease", "genomic_value").agg(F.count(F.lit(1)).alias("n"))


@query
def calibrate_cut_cv(spark, d):
    df = order_facts(spark, d).withColumn("s", F.round(rules.severity(ORDER_RULES.thresholds), 3)).withColumn("y", (F.col("official") == "FAIL").cast("int"))
    return calibration.cross_validate(df, "s", "y")


@query
def calibrate_out_of_fold(spark, d):
    df = order_facts(spark, d).withColumn("y", (F.col("official") == "FAIL").cast("int"))
    return calibration.out_of_fold(df, "o_orderkey", ["o_totalprice", "mean_discount", "mean_tax"], "y", 5, 2)


@query
def calibrate_margins(spark, d):
    """Weights of the relative shortfalls that tell failed orders best from held ones."""
    short = [t.shortfall().alias(t.name) for t in ORDER_RULES.thresholds]
    df = order_facts(spark, d).where("official <> 'PASS'").select("o_orderkey", *short, (F.col("official") == "FAIL").cast("int").alias("y"))
    names = [t.name for t in ORDER_RULES.thresholds]
    df = df.na.fill(0.0, names)
    return calibration.margin_cv(df, "o_orderkey", names, "y", c=1.0, tolerance=0.01).select("repeat", "fold", F.array_join(F.transform("weights", lambda w: F.round(w, 4).cast("string")), ",").alias("weights"), F.round("cut", 4).alias("cut"), "accuracy", (F.col("gap") <= 0.01).alias("certified"))


@query
def calibrate_overtraining(spark, d):
    df = order_facts(spark, d).withColumn("y", (F.col("official") == "FAIL").cast("int"))
    return rounded(calibration.overtraining(df, "o_orderkey", ["o_totalprice", "mean_discount", "mean_tax"], "y", 5, 2))


# ------------------------------------------------------------------------------------------------ text


@query
def text_shapes(spark, d):
    o = table(spark, d, "orders").select(text.shape(F.col("o_orderpriority")).alias("shape"))
    return o.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).withColumn("pattern", text.runs(F.col("shape")))


LEXICON = {"the": 1.0, "of": 2.0}


@query
def text_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(canon.fold(F.coalesce(F.col("text"), F.lit(""))), 256).alias("folded"))


@query
def text_char_grams(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.explode(text.char_ngrams(F.col("text"))).alias("gram"))
    return b.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("n"))


@query
def text_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("body"))


@query
def text_html_tables(spark, d):
    # the given pages hold no table: each gets one after its html, and every third a second one
    one = F.concat(F.lit('<TABLE class="x">\n<tr><th>Id</th><th>Length</th></tr><tr><td>'), "page_id", F.lit("</td>\n<td><b>"), F.length("html"), F.lit(" %</b></td></tr></TABLE>"))
    two = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>between</p><table><tbody><tr><td>"), F.col("page_id") * 2, F.lit("</td></tr></tbody></table>"))).otherwise("")
    pages = table(spark, d, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), one, two))
    rows = documents.html_tables(pages, "page_id")
    return rows.select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query
def text_facts(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Order SYN-MZ-"), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit(": yield of "), F.format_string("%d,%d", F.col("o_orderkey") % 10, F.col("o_custkey") % 10), F.lit(" t/ha.\nSeen in SYN-TR-0001 only. Humedad: 18 % yes")).alias("text"))
    out = facts.extract(c, "o_orderkey")
    return out.select("o_orderkey", "sentence_no", "field", "value", "unit", "matched", F.array_join(F.flatten(F.map_values("ids")), ",").alias("ids"))


@query
def text_lexicon(spark, d):
    lexicon = {"the": 1.0, "of the": 3.0, "und": 2.0}
    docs = table(spark, d, "documents").select("doc_id", canon.fold(F.coalesce(F.col("text"), F.lit(""))).alias("folded"))
    docs = docs.select("doc_id", relevance.density(F.col("folded"), lexicon).alias("feature"))
    return rounded(docs, 5)


@query
def text_tfidf_cosine(spark, d):
    # a search: its queries are the documents whose id is divisible by 100
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").select("doc_id", "text")
    return rounded(relevance.similarity(docs, "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text"), 5)


def labelled_items(spark, d):
    """The benchmark's items as labelled examples."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("example"), "text", (F.col("item_id") % 2).cast("int").alias("label"))


@query
def text_relevance_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = relevance.assess(docs, "doc_id", "text", labelled_items(spark, d), LEXICON, known_ids=spark.createDataFrame([("SYN-MZ-00001",)], "id string"), grammar=[r"\b[A-Z]{3}-\d{4,}\b"])
    return rounded(out.withColumn("reasons", F.array_join("reasons", "; ")), 6)


@query
def text_leave_one_out(spark, d):
    return rounded(relevance.leave_one_out(labelled_items(spark, d), LEXICON), 6)


@query
def verify_turn_numbers(spark, d):
    c = table(spark, d, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    a = c.where("role = 'assistant'").join(prev, ["conv_id", "turn"])
    return verification.check(a, "text", "evidence").select("conv_id", "turn", F.array_join(F.array_sort("unknown_numbers"), ",").alias("unknown_numbers"), F.array_join(F.array_sort("unknown_words"), ",").alias("unknown_words"), "status")


@query
def verify_cited_values(spark, d):
    """Statements about every order's price in thousands, its lines and its weight, of which some are rounded, some wrong and some of a
    field that is not stored."""
    o = table(spark, d, "orders")
    n, k = F.col("o_orderkey"), F.col("o_totalprice") / 1000
    price = F.when(n % 4 == 0, F.format_string("%.1f", k + 0.3)).otherwise(F.format_string("%.1f", F.floor(k * 10 + 0.5) / 10))
    answers = o.select("o_orderkey", F.concat(F.lit("The yield is "), price, F.lit(" t/ha. Moisture was "), (n % 7).cast("string"), F.when(n % 5 == 0, F.lit(" %. Plant height 3 cm!")).otherwise(F.lit(" %."))).alias("text"))
    cells = F.array(F.struct(F.lit("YIELD_T_HA").alias("field"), k.alias("value_num")), F.struct(F.lit("MOISTURE_PCT").alias("field"), (n % 7).cast("double").alias("value_num")))
    evidence = o.select("o_orderkey", F.explode(cells).alias("x")).select("o_orderkey", "x.*")
    out = verification.cited_values(answers, "o_orderkey", "text", evidence)
    return out.groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_ledger(spark, d):
    """Four appended batches of orders: what they hold, and that nothing is found wrong with them."""
    ledger_ = ledger.Ledger(spark, folder(spark, "ledger"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for part in range(4):
        ledger_.append(o.where(F.col("o_orderkey") % 4 == part))
    whole = ledger_.verify(ledger_.head()).agg(F.lit("as appended").alias("state"), F.count(F.lit(1)).alias("faults"))
    rows = ledger_.read()
    sums = rows.groupBy("batch").agg(F.concat(F.lit("batch "), F.first("batch").cast("string")).alias("state"), F.count(F.lit(1)).alias("faults")).drop("batch")
    return whole.unionByName(sums)


@query
def verify_repeated_warnings(spark, d):
    w = table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.lit(" value above limit "), (F.col("event_id") % 3).cast("string")).alias("message"))
    return verification.distinct_warnings(w, ["user_id"], "event_id", "message").select("user_id", "event_id")


# ------------------------------------------------------------------------------------------------ data quality


@query
def quality_issues(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    ops = lines.select("l_orderkey", "l_linenumber", "l_shipdate", F.when(F.col("l_linestatus") == "O", "PLANNED").otherwise("DONE").alias("status"))
    ops = ops.withColumn("l_orderkey", astray(F.col("l_orderkey"), 9))
    trials = orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    issues = [
        quality.issue(quality.without_parent(ops.withColumnRenamed("l_orderkey", "o_orderkey"), trials, ["o_orderkey"]), "linkage.orphans", "linkage", "warning", F.col("o_orderkey"), "proposed"),
        quality.issue(quality.year_mismatch(ops.withColumnRenamed("l_orderkey", "o_orderkey"), trials, "o_orderkey", "l_shipdate", "year"), "temporal.year", "temporal", "critical", F.col("o_orderkey"), "applied"),
        quality.issue(quality.stale_planned(ops, "status", "l_shipdate"), "status.planned", "status", "warning", F.col("l_orderkey"), "proposed"),
        quality.issue(orders.where("o_totalprice is null"), "completeness.price", "completeness", "info", F.col("o_orderkey"), "not_fixable"),
    ]
    return quality.union(issues).select("id", "category", "severity", "count", F.array_join("affected", ",").alias("affected"), "fix_status")


@query
def quality_order_violations(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.element_at(F.create_map(F.lit("A"), F.lit("PLANTING"), F.lit("N"), F.lit("HARVEST"), F.lit("R"), F.lit("IRRIGATION")), F.col("l_returnflag")).alias("kind"), "l_shipdate")
    return quality.order_violations(li, "l_orderkey", "kind", "l_shipdate").select("l_orderkey")


@query
def quality_single_environment(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    return quality.single_environment(o, "o_custkey", ["year", "o_orderpriority"])


@query
def quality_feature_gate(spark, d):
    return rounded(quality.gate(table(spark, d, "lineitem"), F.col("l_discount") < 0.09))


# ------------------------------------------------------------------------------------------------ flagship


@query
def supplier_triage(spark, d):
    """Suppliers by price against the parts' mean (ratio of means), share of returns and mean discount: colour, reason, order."""
    li, parts, sup = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    j = li.select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").join(parts.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.count(F.lit(1))
    agg = j.groupBy("l_suppkey").agg(
        n.alias("n_used"),
        (100 * F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.sum(F.round(F.col("p_retailprice") * F.col("l_quantity") * 100).cast("long"))).alias("ratio_pct"),
        (100 * F.sum((F.col("l_returnflag") == "R").cast("long")) / n).alias("returned_pct"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / n).alias("discount_pct"),
    )
    rag = rules.RagRules(
        [
            rules.Criterion("returned", "returned_pct", "returns", False, 36.0, 33.5, percent=True),
            rules.Criterion("discount", "discount_pct", "mean discount", False, None, 5.05, 5.2, percent=True),
        ],
        ["returned"], ["returned", "discount", "trials"], used_field="n_used", min_used=2, green_field=None,
    )
    facts_ = sup.select("s_suppkey", "s_name").join(agg, F.col("s_suppkey") == F.col("l_suppkey"), "left").drop("l_suppkey").withColumn("n_used", F.coalesce("n_used", F.lit(0)))
    out = rag.evaluate(facts_)
    rank = F.when(F.col("colour") == "RED", 0).when(F.col("colour") == "AMBER", 1).otherwise(2)
    return rounded(out.select("s_suppkey", "s_name", "n_used", "ratio_pct", "returned_pct", "discount_pct", "colour", rank.alias("priority")).orderBy("priority", "s_suppkey"), 4)


# ------------------------------------------------------------------------------------------------ reports


@query
def rules_baseline(spark, d):
    out = ORDER_RULES.evaluate(order_facts(spark, d), "o_orderkey", "orders", "official").withColumn("said", F.when(F.col("o_orderkey") % 19 == 0, "other").otherwise(F.col("reason")))
    return rounded(rules.baseline(out, "o_orderkey", "official", "computed", "said", "reason")).withColumn("not_explained", F.array_join("not_explained", ","))


@query
def serve_envelope(spark, d):
    decided = PART_RAG.evaluate(part_facts(spark, d)).where("colour = 'AMBER'")
    head, rows = serve.envelope(decided, [F.col("p_partkey")], 20)
    return rows.select("p_partkey", *[F.lit(v).alias(k) for k, v in head.items()])


@query
def serve_cards(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("verdict"), F.col("o_orderpriority").alias("statement"))
    out = serve.cards(cust, orders, "o_custkey", "o_orderkey", "verdict", "statement", most=3)
    text_ = F.array_join(F.transform("trials", lambda t: F.concat_ws(":", t["trial"], t["verdict"], t["statement"])), ";")
    return out.select("o_custkey", "c_name", "n_trials", "n_fail", F.coalesce(text_, F.lit("")).alias("trials"))


@query
def profile_ingestion(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.lit("k").alias("constant"), F.lit(None).cast("string").alias("empty"))
    return rounded(profile.ingestion({"customer": c, "nation": table(spark, d, "nation")}))


@query
def profile_renormalised(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("k").alias("constant"), "c_mktsegment", F.lit(None).cast("string").alias("empty"))
    return profile.renormalise(c, profile.profile(c))


@query
def drift_report(spark, d):
    a, b = _years(spark, d)
    return rounded(drift.report(a, b, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]), 4)


@query
def drift_schema(spark, d):
    o = table(spark, d, "orders")
    changed = {"o_custkey": F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).cast("string"), "extra": F.when(F.col("o_orderkey") % 5 == 0, 1)}
    return drift.schema_report(o, o.drop("o_orderpriority").withColumns(changed))


@query
def spectral_identities(spark, d):
    """All checks; measured is what they speak of, where it can be found in another way."""
    enc, names = encoding.encode(table(spark, d, "orders"), SPECS[:2] + [SPECS[3]], "o_orderkey")
    model = spectral.fit(enc, names)
    return spectral.identities(enc, "o_orderkey", model, rules_evidence_reread(spark, d).count()).select("check", "passed", F.round("measured", 3).alias("measured"))


@query
def window_last_turns(spark, d):
    c = table(spark, d, "conversations").withColumn("side", F.when(F.col("role") == "assistant", "assistant").otherwise("other"))
    return relational.last_turns(c, "conv_id", "turn", "side", "text", 3, F.col("role") != "system").select("conv_id", "turn", "side", "text")


@query
def text_document_summary(spark, d):
    n = F.col("o_orderkey")
    c = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Lines SYN-MZ-00009 and SYN-MZ-0000"), (n % 7).cast("string"), F.when(n % 3 == 0, F.lit(": yield is 4 t/ha. Moisture 12 %.")).otherwise(F.lit(" were seen in SYN-TR-0001.")), F.lit("\n\nSYN-MZ-00009 again.")).alias("text"))
    out = facts.summary(facts.extract(c, "o_orderkey"), "o_orderkey")
    return out.select("o_orderkey", F.array_join("entities", ",").alias("entities"), "n_facts", F.array_join("fields", ",").alias("fields"))


@query
def reconcile_repeated_keys(spark, d):
    """All orders again and every third twice more under a new key, one of them changed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    fresh = o.where("o_orderkey % 3 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 50_000_000)
    changed = fresh.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.lit("zz")).otherwise(F.col("o_orderstatus")))
    merged, log = reconcile.merge(o, [o.unionByName(fresh).unionByName(changed)], "o_orderkey")
    rows = merged.agg(F.lit("rows").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return log.select("outcome", "n").unionByName(rows)
