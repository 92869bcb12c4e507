"""Data issues, one frame each, in one schema: id, category, severity, count, affected, evidence, fix_status; explained() adds what they
are called and mean."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


OFFLINE = ("PAPER", "WHATSAPP", "PDF_REPORT")  # fixed values


def issue(df: DataFrame, id: str, category: str, severity: str, affected: Column, fix_status: str, evidence: dict[str, Column] | None = None) -> DataFrame:
    """One row about all rows of df; no row if df is empty. Up to 12 affected ids are named, in order."""
    ev = F.to_json(F.struct(*[c.alias(k) for k, c in (evidence or {"n": F.count(F.lit(1))}).items()]))
    ids = df.select(affected.cast("string").alias("_id")).where("_id is not null").distinct().orderBy("_id").limit(13)
    few = ids.agg(F.array_sort(F.collect_list("_id")).alias("few"))
    n_ids = F.count_distinct(affected.cast("string"))
    agg = df.agg(F.count(F.lit(1)).alias("count"), n_ids.alias("_n"), ev.alias("evidence")).where("count > 0")
    named = F.when(F.col("_n") > 12, F.concat(F.slice("few", 1, 12), F.array(F.concat(F.lit("... +"), (F.col("_n") - 12).cast("string"), F.lit(" more"))))).otherwise(F.col("few"))
    return agg.join(F.broadcast(few)).select(
        F.lit(id).alias("id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), "count", named.alias("affected"), "evidence", F.lit(fix_status).alias("fix_status")
    )


def union(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


@dataclass(frozen=True)
class Text:
    """What an issue is called, where it comes from, what is done about it, what that means, and what to ask whoever knows."""

    title: str
    root_cause: str
    fix: str
    impact: str
    question: str | None = None


TEXTS = {
    "linkage.orphans": Text("Operations of an unknown trial", "the trial key of the operation is in no trial table", "moved to the only trial of the same material and place, where there is one", "orphans count for no trial", "Which trial do these operations belong to?"),
    "temporal.year": Text("Operations dated in another year than their trial", "the year of the date and of the trial differ by a constant", "the offset is kept beside the date, which stays as it is", "dates of these trials are no feature of a model"),
    "status.planned": Text("Planned operations whose date has passed", "the status was never updated", "flagged as not reported", "nobody can tell whether they were done", "Were these operations carried out?"),
    "completeness.price": Text("Records without a price", "the export has an empty cell", "left empty", "totals leave them out"),
    "design.no_trial_master": Text("Place and year of trials are unknown", "the drop has no trial master", "the year is taken from the sowing date, the place stays empty", "effects of place and year cannot be told apart", "Can the trial master be shared?"),
    "decision.breeder_decision_empty": Text("No decision has been recorded", "the decision column is empty", "decisions are recorded in the override log", "suggestions have nothing to be measured by"),
    "completeness.genotyped_without_trials": Text("Candidates with markers but without trials", "they are in no field bridge yet", "shown as amber with that reason", "nothing is claimed about their performance"),
    "design.commercial_checks": Text("Checks are references, not candidates", "their entries are marked as checks", "used for comparison with the checks' yield only", "they get no colour"),
    "operations.delayed": Text("Operations done late", "the actual date lies after the planned one", "reported", "a delay excludes no trial"),
    "operations.missed": Text("Operations that were not done", "their status is missed", "trials that missed their irrigation are not used", "their candidates are judged by fewer trials"),
    "operations.recorded_offline": Text("Records that came on paper or by message", "somebody typed them in", "the original can be uploaded and is checked against the record", "errors of typing are possible", "Are the originals at hand?"),
    "completeness.pedigree_empty": Text("No parents are known", "both parent columns are empty in the export", "lineage is shown as unavailable", "nothing can be inferred from relatives"),
    "integrity.referential": Text("References between the tables", "some references name keys that are missing", "checked at every build", "no join drops a row in silence"),
    "consistency.summary_recomputed": Text("Reported summaries recomputed from plots", "some summaries differ by more than their rounding", "both values are shown", "decisions rest on numbers that can be reproduced", "How was the summary computed?"),
    "provenance.conflict": Text("Uploads that contradict an export", "the same key has another value", "the export stays, the upload is kept as evidence", "somebody has to look", "Which value is right?"),
    "provenance.duplicate": Text("Uploads of rows that are already there", "the same rows came twice", "ignored", "none"),
}


def explained(issues: DataFrame, texts: dict[str, Text] = TEXTS) -> DataFrame:
    """issues with title, root_cause, fix, impact and question; those of an id without texts stay null."""
    rows = [(i, t.title, t.root_cause, t.fix, t.impact, t.question) for i, t in texts.items()]
    table = issues.sparkSession.createDataFrame(rows, "id string, title string, root_cause string, fix string, impact string, question string")
    return issues.join(F.broadcast(table), "id", "left")  # a row for each kind of issue


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("fix_status").agg(F.count(F.lit(1)).alias("n_issues"), F.sum("count").alias("n_records"))


def operation_flags(ops: DataFrame, kind: str, status: str, channel: str) -> DataFrame:
    """Flags instead of deletes."""
    up = lambda c: F.upper(F.col(c).cast("string"))
    return ops.withColumns({"IS_DELAYED": up(status) == "DELAYED", "IS_MISSED": up(status) == "MISSED", "IS_OFFLINE": up(channel).isin(*OFFLINE)})


def year_mismatch(ops: DataFrame, trials: DataFrame, trial: str, date: str, year: str) -> DataFrame:
    """Operations dated in another year than their trial, with the offset."""
    j = ops.join(trials.select(F.col(trial).alias("_t"), F.col(year).alias("_y")), F.col(trial) == F.col("_t"), "left")
    return j.withColumn("year_offset", F.year(date) - F.col("_y")).where("year_offset <> 0").drop("_t", "_y")


def order_violations(ops: DataFrame, trial: str, kind: str, date: str, first: str = "PLANTING", later: tuple[str, ...] = ("HARVEST", "IRRIGATION")) -> DataFrame:
    """(trial, first date, later dates) where something that must come later came first."""
    p = ops.groupBy(trial).pivot(kind, [first, *later]).agg(F.min(date))
    bad = F.lit(False)
    for k in later:
        bad = bad | F.coalesce(F.col(k) < F.col(first), F.lit(False))
    return p.where(bad)


def stale_planned(ops: DataFrame, status: str, date: str, at=None) -> DataFrame:
    """Operations that are still PLANNED though their date has passed; at: a date, else the latest date of the table."""
    ref = F.lit(at) if at is not None else F.lit(ops.agg(F.max(date)).first()[0])
    return ops.where((F.col(status) == "PLANNED") & (F.col(date) <= ref))


def without_parent(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def single_environment(rows: DataFrame, material: str, environment: list[str]) -> DataFrame:
    """(material) seen in one environment only."""
    n = rows.groupBy(material).agg(F.count_distinct(F.struct(*environment)).alias("n"))
    return n.where("n = 1").select(material)


def gate(ops: DataFrame, ok: Column, least: float = 0.8) -> DataFrame:
    """(share_ok, usable): whether a feature may be used at all."""
    share = F.coalesce(F.avg(ok.cast("double")), F.lit(0.0))
    return ops.agg(share.alias("share_ok"), (share >= least).alias("usable"))


def empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column) that never hold a value."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.sparkSession.createDataFrame([(c,) for c in columns if row[c] == 0], "column string")


def corrections(orphans: DataFrame, record: str, field: str, original: str) -> DataFrame:
    """The log of proposed reassignments; a record without a single option is quarantined."""
    status = F.when(F.col("proposed").isNotNull(), "proposed").otherwise("quarantined")
    return orphans.select(
        F.col(record).cast("string").alias("record"), F.lit(field).alias("field"), F.col(original).cast("string").alias("original"),
        F.col("proposed").cast("string").alias("derived"), status.alias("status"), F.concat(F.lit("options: "), F.col("n_options").cast("string")).alias("method"),
    )
