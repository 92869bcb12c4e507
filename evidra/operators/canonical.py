"""The canonical model out of recognised sources: materials, trials, what was tested where, candidate metrics, and checks across sources.

Everything is declared as joins and aggregates; nothing is collected. A source that is absent is None, and what depends on it is left
out. Names are those of the data model; tables with other names are renamed before they come here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from . import quality, recompute
from .relational import quantiles

MATERIAL, TRIAL, ENTRY = "MATERIAL_GUID", "TRIAL_GUID", "TRIAL_ENTRY_GUID"


def existing(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that the table has, in the order asked for."""
    return [c for c in columns if c in df.columns]


def upper(c: str) -> Column:
    return F.upper(F.col(c).cast("string"))


def with_master(summary: DataFrame, master: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """The summary with those columns of the master that it does not have itself; a master that repeats a key counts once."""
    more = [c for c in existing(master, extra) if c not in summary.columns]
    if not more:
        return summary
    one = master.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*more)).alias("_m"))
    return summary.join(one, key, "left").select(*summary.columns, *[F.col(f"_m.{c}").alias(c) for c in more])


def with_first_date(trials: DataFrame, operations: DataFrame, kind: str, date: str, name: str, key: str = TRIAL) -> DataFrame:
    """The earliest date of operations of a kind for each trial."""
    first = operations.where(F.col("OPERATION_TYPE_LID") == kind).groupBy(key).agg(F.min(date).alias(name))
    return trials.join(first, key, "left")


def roles(bridge: DataFrame) -> DataFrame:
    """(material, role): check if any of its entries is one."""
    return bridge.groupBy(MATERIAL).agg(F.when(F.bool_or(F.col("ENTRY_ROLE_LID") == "CHECK"), "check").otherwise("entry").alias("_role"))


def materials(master: DataFrame, candidates: DataFrame, bridge: DataFrame) -> DataFrame:
    """The material master, each once, with its role: candidate, check or other."""
    keep = existing(master, [MATERIAL, "MATERIAL_ID", "LINE_GUID", "HIGHNAME", "STATUS_LID", "FEMALE_PARENT_MATERIAL_GUID", "MALE_PARENT_MATERIAL_GUID", "PEDIGREE", "GENERATION_CODE"])
    rest = [c for c in keep if c != MATERIAL]
    one = master.where(F.col(MATERIAL).isNotNull()).groupBy(MATERIAL).agg(F.min(F.struct(*rest)).alias("_r")).select(MATERIAL, "_r.*") if rest else master.select(MATERIAL).distinct()
    wanted = candidates.select(MATERIAL).distinct().withColumn("_candidate", F.lit(True))
    out = one.join(wanted, MATERIAL, "left").join(roles(bridge), MATERIAL, "left")
    role = F.when(F.col("_candidate"), "candidate").when(F.col("_role") == "check", "check").otherwise("other")
    return out.withColumn("role", role).drop("_candidate", "_role").withColumnsRenamed({"MATERIAL_ID": "candidate_id"})


def linked_operations(operations: DataFrame, bridge: DataFrame) -> DataFrame:
    """Operations with the trial of their field entity, and their flags."""
    of = bridge.where(F.col("FIELD_ENTITY_ID").isNotNull()).groupBy("FIELD_ENTITY_ID").agg(F.max(TRIAL).alias(TRIAL))
    out = operations.drop(TRIAL).join(of, F.col("ATTACHED_TO_FIELD_ENTITY_ID") == F.col("FIELD_ENTITY_ID"), "left").drop("FIELD_ENTITY_ID")
    return quality.operation_flags(out, "OPERATION_TYPE_LID", "STATUS_LID", "RECORDED_VIA")


def trial_material(observations: DataFrame, bridge: DataFrame, excluded: DataFrame, traits: list[str]) -> DataFrame:
    """One row a trial, material and role: means of its traits over plots, replicates, yield against the trial's checks, and whether it
    counts. excluded: (trial) whose results may not be used. traits: the trait codes, one column each."""
    n = observations.count()  # both sides are dealt by the entry to partitions of so many plots that a task can sort
    entries = dealt(bridge, ENTRY, n).groupBy(ENTRY).agg(F.min(F.struct(TRIAL, MATERIAL, "ENTRY_ROLE_LID", F.col("REPLICATION_NO").alias("_rep"))).alias("_e")).select(ENTRY, "_e.*")
    plots = dealt(observations.drop(TRIAL, MATERIAL), "TRIAL_ENTRY_RELATIONSHIP_GUID", n).join(entries, F.col("TRIAL_ENTRY_RELATIONSHIP_GUID") == F.col(ENTRY))
    means = [F.avg(F.when(F.col("TRAIT_CODE") == t, F.col("NUMBER_VALUE"))).alias(t) for t in traits]
    tm = plots.groupBy(TRIAL, MATERIAL, F.col("ENTRY_ROLE_LID").alias("role")).agg(*means, F.count_distinct("_rep").alias("n_reps"))
    if "YIELD_T_HA" in traits:
        checks = tm.where("role = 'CHECK'").groupBy(TRIAL).agg(F.avg("YIELD_T_HA").alias("CHECK_YIELD_T_HA"))
        tm = tm.join(checks, TRIAL, "left").withColumn("YIELD_VS_CHECK_PCT", F.try_divide(100 * F.col("YIELD_T_HA"), F.col("CHECK_YIELD_T_HA")))
    gone = excluded.select(TRIAL).distinct().withColumn("_gone", F.lit(True))
    tm = tm.join(gone, TRIAL, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    return tm.withColumns({"used": (F.col("role") == "TRIAL_ENTRY") & ~F.col("_gone"), "excluded_reason": F.when(F.col("_gone"), F.lit("irrigation missed"))}).drop("_gone")


def trials(bridge: DataFrame, operations: DataFrame | None, tm: DataFrame, excluded: DataFrame) -> DataFrame:
    """What bridge and operations tell of each trial. The sowing date is the earliest actual date, else the earliest planned one."""
    out = bridge.groupBy(TRIAL).agg(
        F.count_distinct(ENTRY).alias("n_entries"), F.count_distinct(MATERIAL).alias("n_materials"),
        F.count_if(F.col("ENTRY_ROLE_LID") == "CHECK").alias("n_checks"), F.count_distinct("REPLICATION_NO").alias("n_reps"),
    )
    if operations is not None:
        sown = upper("OPERATION_TYPE_LID") == "SOWING"
        date = F.coalesce(F.min(F.when(sown, F.col("ACTUAL_DATE"))), F.min(F.when(sown, F.col("PLANNED_DATE")))).alias("SOWING_DATE")
        flags = [F.count_if(F.col(c)).alias(c) for c in ("IS_DELAYED", "IS_MISSED", "IS_OFFLINE")]
        out = out.join(operations.groupBy(TRIAL).agg(date, *flags), TRIAL, "left").withColumn("START_YEAR", F.year("SOWING_DATE"))
    if "CHECK_YIELD_T_HA" in tm.columns:
        out = out.join(tm.groupBy(TRIAL).agg(F.max("CHECK_YIELD_T_HA").alias("CHECK_YIELD_T_HA")), TRIAL, "left")
    gone = excluded.select(TRIAL).distinct().withColumn("_gone", F.lit(True))
    return out.join(gone, TRIAL, "left").withColumn("excluded_for_candidates", F.coalesce("_gone", F.lit(False))).drop("_gone")


def candidates(recommendations: DataFrame, tm: DataFrame, lab: DataFrame | None = None) -> DataFrame:
    """The candidates' metrics out of trials: a ratio of means over usable trials, means of the rest, and lab columns as lab_*. tm: one row
    a trial, material and role, as trial_material() gives it, so that rows of a material and role are its trials."""
    mine = tm.where("role = 'TRIAL_ENTRY'")
    used = F.col("used")
    aggs = [F.count(TRIAL).alias("n_trials"), F.count(F.when(used, F.col(TRIAL))).alias("n_trials_used")]
    if "YIELD_T_HA" in tm.columns:
        own, check = F.avg(F.when(used, F.col("YIELD_T_HA"))), F.avg(F.when(used, F.col("CHECK_YIELD_T_HA")))
        aggs += [F.try_divide(100 * own, check).alias("yield_vs_check_pct"), own.alias("MEAN_YIELD_T_HA")]
    aggs += [F.avg(F.when(used, F.col(c))).alias(name) for c, name in (("DISEASE_SCORE", "disease_mean"), ("MOISTURE_PCT", "moisture_mean")) if c in tm.columns]
    out = recommendations.select(MATERIAL).distinct().join(mine.groupBy(MATERIAL).agg(*aggs), MATERIAL, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_trials", "n_trials_used")})
    return out if lab is None else out.join(lab.withColumnsRenamed({c: f"lab_{c}" for c in lab.columns if c != MATERIAL}), MATERIAL, "left")


def long_view(tm: DataFrame, trials: DataFrame, materials: DataFrame) -> DataFrame:
    """A row for each candidate and trial, with the trial's summary and the candidate's id."""
    cols = existing(trials, [TRIAL, "TRIAL_ID", "location", "START_YEAR", "YIELD_T_HA", "MOISTURE_PCT", "DISEASE_SCORE", "PLANT_HEIGHT_CM", "FLOWERING_DAYS", "TRIAL_RECOMMENDATION"])
    return tm.join(trials.select(*cols), TRIAL, "left").join(materials.select(MATERIAL, "candidate_id"), MATERIAL, "left")


def genomic_means(tm: DataFrame, genomics: DataFrame) -> DataFrame:
    """(trial, gbv_recomputed, resistant_pct_recomputed) over the materials seen in each trial; an unknown marker counts as not resistant."""
    j = tm.select(TRIAL, MATERIAL).join(genomics.select(MATERIAL, *existing(genomics, ["GENOMIC_BREEDING_VALUE", "MARKER_DISEASE_RESISTANCE"])), MATERIAL)
    aggs = [F.avg("GENOMIC_BREEDING_VALUE").alias("gbv_recomputed")] if "GENOMIC_BREEDING_VALUE" in j.columns else []
    if "MARKER_DISEASE_RESISTANCE" in j.columns:
        hit = F.coalesce(F.col("MARKER_DISEASE_RESISTANCE") == "RESISTANT", F.lit(False))
        aggs.append((100 * F.avg(hit.cast("double"))).alias("resistant_pct_recomputed"))
    return j.groupBy(TRIAL).agg(*aggs)


# ------------------------------------------------------------------------------------------------ checks across sources

FINDING = ("check", "severity", "checked", "found", "median", "largest", "worst", "statement")
#: fixed values: the names of the checks
CHECKS = (
    "referential_integrity", "trial_gbv_reconciliation", "trial_resistance_reconciliation", "operations_vs_observations", "trial_design_environments", "genomics_qc", "data_gap",
)


def _finding(row: DataFrame, name: str, words: str, bad: str = "warning") -> DataFrame:
    """row: one row of (checked, found), and median, largest and worst where differences are compared. words: a format of found and
    checked, in this order."""
    none = {"median": "double", "largest": "double", "worst": "array<string>"}
    return row.select(
        F.lit(name).alias("check"), F.when(F.col("found") > 0, bad).otherwise("info").alias("severity"),
        F.col("checked").cast("long").alias("checked"), F.col("found").cast("long").alias("found"),
        *[F.col(c) if c in row.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()],
        F.format_string(words, F.col("found"), F.col("checked")).alias("statement"),
    )


def unknown_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of the child, and how many the parent lacks."""
    known = parent.select(F.col(key).alias("_k")).distinct()
    j = child.select(key).where(F.col(key).isNotNull()).distinct().join(known, F.col(key) == F.col("_k"), "left")
    return j.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_k").isNull()).alias("found"))


def beyond(j: DataFrame, reported: str, recomputed: str, tolerance: float, key: str = TRIAL) -> DataFrame:
    """One row: rows of both, those that differ by more than the tolerance, the median and the largest difference, and the worst three
    of these as ``key: difference``."""
    gaps = j.select(F.col(key).cast("string").alias("_k"), F.abs(F.col(reported) - F.col(recomputed)).alias("gap"))
    counts = gaps.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("gap") > tolerance).alias("found"), F.max("gap").alias("largest"))
    middle = quantiles(gaps, [], "gap", [0.5]).agg(F.max("q0").alias("median"))
    worst = gaps.where(F.col("gap") > tolerance).orderBy(F.desc("gap"), "_k").limit(3)  # three rows
    named = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("g"), "_k"))), lambda x: F.concat(x["_k"], F.lit(": "), F.round(-x["g"], 4).cast("string")))
    return counts.join(F.broadcast(middle)).join(F.broadcast(worst.agg(named.alias("worst"))))


def findings(tm: DataFrame, trials: DataFrame, materials: DataFrame, genomics: DataFrame, operations: DataFrame | None, gaps: list[str] = (), tolerance_gbv: float = 1.0, tolerance_pct: float = 5.0) -> DataFrame:
    """(check, severity, checked, found, median, largest, worst, statement): references, genomic summaries, operations without observation, single environments,
    genomic quality, and one row for each known gap. Checks whose columns are absent are left out."""
    lost = unknown_keys(tm, materials, MATERIAL).unionByName(unknown_keys(tm, trials, TRIAL)).agg(F.sum("checked").alias("checked"), F.sum("found").alias("found"))
    out = [_finding(lost, "referential_integrity", "%d of %d observed materials and trials are missing from their master table", "critical")]
    again = genomic_means(tm, genomics)
    j = trials.join(again, TRIAL)
    if "GENOMIC_BREEDING_VALUE_MEAN" in trials.columns and "gbv_recomputed" in again.columns:
        out.append(_finding(beyond(j, "GENOMIC_BREEDING_VALUE_MEAN", "gbv_recomputed", tolerance_gbv), "trial_gbv_reconciliation", "%d of %d trials report another mean breeding value than their materials have"))
    if "RESISTANT_MATERIAL_PCT" in trials.columns and "resistant_pct_recomputed" in again.columns:
        out.append(_finding(beyond(j, "RESISTANT_MATERIAL_PCT", "resistant_pct_recomputed", tolerance_pct), "trial_resistance_reconciliation", "%d of %d trials report another resistant share than their materials have"))
    if operations is not None and {TRIAL, MATERIAL} <= set(operations.columns):
        seen = tm.select(TRIAL, MATERIAL).distinct().withColumn("_seen", F.lit(True))
        ops = operations.join(seen, [TRIAL, MATERIAL], "left").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_seen").isNull()).alias("found"))
        out.append(_finding(ops, "operations_vs_observations", "%d of %d operations name a material without observation in that trial"))
    if {"location", "START_YEAR"} <= set(trials.columns):
        places = tm.select(TRIAL, MATERIAL).join(trials.select(TRIAL, "location", "START_YEAR"), TRIAL)
        # a place or year that is unknown is one environment of its own
        n = places.groupBy(MATERIAL).agg(F.count_distinct(F.struct("location", "START_YEAR")).alias("n"))
        out.append(_finding(n.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("n") == 1).alias("found")), "trial_design_environments", "%d of %d candidates were seen in a single place and year"))
    if "QC_STATUS_LID" in genomics.columns:
        failed = F.coalesce(F.col("QC_STATUS_LID") != "PASS", F.lit(True))
        out.append(_finding(genomics.agg(F.count(F.lit(1)).alias("checked"), F.count_if(failed).alias("found")), "genomics_qc", "%d of %d genomic samples did not pass"))
    if gaps:
        rows = [("data_gap", "info", 0, 0, None, None, None, g) for g in gaps]
        out.append(tm.sparkSession.createDataFrame(rows, "check string, severity string, checked long, found long, median double, largest double, worst array<string>, statement string"))
    return reduce(DataFrame.unionByName, out)


def recomputation_findings(compared: DataFrame) -> DataFrame:
    """compared: rows of recompute.compare(); a warning for each field beyond its tolerance."""
    words = F.format_string("%s: recomputed for %d records, largest difference %s (tolerance %s)", "field", "compared", F.round("max_abs_diff", 4).cast("string"), F.col("tolerance").cast("string"))
    return compared.select(F.lit("recomputed_summary").alias("check"), F.when(F.col("outside_tolerance") > 0, "warning").otherwise("info").alias("severity"), "field", "outside_tolerance", words.alias("statement"))


def issues(recommendations: DataFrame, tm: DataFrame, trials: DataFrame, materials: DataFrame, operations: DataFrame, references: DataFrame, compared: DataFrame) -> DataFrame:
    """The issues of a drop without a trial master, in the schema of quality.issue(). references: rows of relational.references()."""
    out = [
        quality.issue(trials, "design.no_trial_master", "design", "warning", F.col(TRIAL), "not_fixable"),
        quality.issue(recommendations.where(F.coalesce(F.col("N_TRIALS_USED").try_cast("double"), F.lit(0.0)) == 0), "completeness.genotyped_without_trials", "completeness", "info", F.col(MATERIAL), "none_needed"),
        quality.issue(materials.where("role = 'check'"), "design.commercial_checks", "design", "info", F.col(MATERIAL), "none_needed"),
        quality.issue(operations.where("IS_DELAYED"), "operations.delayed", "temporal", "info", F.col(TRIAL), "none_needed"),
        quality.issue(operations.where("IS_MISSED"), "operations.missed", "completeness", "warning", F.col(TRIAL), "applied"),
        quality.issue(operations.where("IS_OFFLINE"), "operations.recorded_offline", "provenance", "warning", F.col(TRIAL), "proposed"),
    ]
    if "BREEDER_DECISION" in recommendations.columns:
        out.append(quality.issue(recommendations.where("BREEDER_DECISION is null"), "decision.breeder_decision_empty", "completeness", "info", F.col(MATERIAL), "proposed"))
    parents = existing(materials, ["FEMALE_PARENT_MATERIAL_GUID", "MALE_PARENT_MATERIAL_GUID"])
    known = reduce(lambda a, c: a | F.col(c).isNotNull(), parents, F.lit(False))
    empty = materials.agg(F.bool_or(known).alias("_any"), F.count(F.lit(1)).alias("_n")).where("not _any and _n > 0")
    lost = materials.select(MATERIAL).join(F.broadcast(empty))
    out.append(quality.issue(lost, "completeness.pedigree_empty", "completeness", "info", F.lit(None).cast("string"), "not_fixable"))
    # each with what it means and what to do about it
    bad = references.where("share < 1").withColumn("_missing", F.col("n_references") - F.col("n_resolved"))
    out.append(_counted(bad, "_missing", "reference", "integrity.referential", "linkage"))
    out.append(_counted(compared.where("outside_tolerance > 0"), "outside_tolerance", "field", "consistency.summary_recomputed", "aggregation"))
    return quality.explained(quality.union(out))


def _counted(bad: DataFrame, n: str, name: str, id: str, category: str) -> DataFrame:
    """An issue whose count is a sum; it is reported as info where nothing is wrong."""
    total = F.coalesce(F.sum(n), F.lit(0)).cast("long")
    return bad.agg(total.alias("count"), F.array_sort(F.collect_list(F.col(name).cast("string"))).alias("affected")).select(
        F.lit(id).alias("id"), F.lit(category).alias("category"), F.when(F.col("count") > 0, "warning").otherwise("info").alias("severity"), "count", "affected",
        F.to_json(F.struct(F.col("count").alias("n"))).alias("evidence"), F.when(F.col("count") > 0, "proposed").otherwise("none_needed").alias("fix_status"),
    )


def verdict_counts(rows: DataFrame, key: str, official: str = "official", computed: str = "computed", ambiguous: str = "ambiguous", explained: str = "explained") -> DataFrame:
    """Per key: how many trials there are, by verdict (official, else computed), how many are ambiguous and how many no data explain."""
    verdict = F.coalesce(F.col(official), F.col(computed))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(verdict == v).alias(f"n_{v.lower()}") for v in ("PASS", "HOLD", "FAIL", "EXCLUDED")],
        F.count_if(F.coalesce(F.col(ambiguous), F.lit(False))).alias("n_ambiguous"), F.count_if(F.coalesce(~F.col(explained), F.lit(False))).alias("n_not_explained"),
    )


def compare_summary(recommendations: DataFrame, recomputed: DataFrame, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """recompute.compare() over those fields that both sides have."""
    both = {f: v for f, v in fields.items() if f in recommendations.columns and v[0] in recomputed.columns}
    return recompute.compare(recommendations, recomputed, MATERIAL, both, examples=0)


# fixed values: reported field, recomputed column and half a unit of the last printed decimal
SUMMARY_FIELDS = {
    "N_TRIALS": ("n_trials", 0.0), "N_TRIALS_USED": ("n_trials_used", 0.0), "YIELD_VS_CHECK_PCT": ("yield_vs_check_pct", 0.0501), "DISEASE_SCORE_MEAN": ("disease_mean", 0.00501),
    "MOISTURE_PCT_MEAN": ("moisture_mean", 0.0501), "GERMINATION_PCT": ("lab_GERMINATION_PCT", 0.0501), "FUMONISIN_PPM": ("lab_FUMONISIN_PPM", 0.00501),
}
