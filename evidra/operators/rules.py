"""Thresholds compiled to Columns: verdicts, colours, reasons and the evidence that produced them.

Null never satisfies or fails a criterion: it gives no evidence. Comparisons run inside code generation, without Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..session import pinned

OPS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}
COLOUR = {"PASS": "GREEN", "HOLD": "AMBER", "FAIL": "RED"}
EVIDENCE = "struct<rule:string,source:string,field:string,record:string,value:string,value_num:double,op:string,threshold:double,passed:boolean,statement:string>"


@dataclass(frozen=True)
class Threshold:
    name: str
    field: str
    op: str
    value: float
    weight: float = 1.0
    good: str = "meets threshold"
    bad: str = "misses threshold"

    def passes(self) -> Column:
        return OPS[self.op](F.col(self.field), F.lit(self.value))

    def shortfall(self) -> Column:
        """How far a value falls short, relative to the threshold; null if there is no value or the threshold is 0."""
        if self.value == 0:
            return F.lit(None).cast("double")
        gap = F.lit(self.value) - F.col(self.field) if self.op in (">=", ">") else F.col(self.field) - F.lit(self.value)
        return F.greatest(F.lit(0.0), gap / abs(self.value))


def evidence(t: Threshold, source: str, record: Column) -> Column:
    """One evidence struct, null without a value."""
    text = F.when(t.passes(), F.lit(t.good)).otherwise(F.lit(t.bad))
    made = F.struct(
        F.lit(t.name).alias("rule"),
        F.lit(source).alias("source"),
        F.lit(t.field).alias("field"),
        record.cast("string").alias("record"),
        F.col(t.field).cast("string").alias("value"),
        F.col(t.field).cast("double").alias("value_num"),
        F.lit(t.op).alias("op"),
        F.lit(float(t.value)).alias("threshold"),
        t.passes().alias("passed"),
        text.alias("statement"),
    )
    return F.when(F.col(t.field).isNotNull(), made)


def severity(thresholds: list[Threshold], weighted: bool = False) -> Column:
    out = F.lit(0.0)
    for t in thresholds:
        out = out + F.coalesce(t.shortfall() * (t.weight if weighted else 1.0), F.lit(0.0))
    return out


@dataclass(frozen=True)
class TrialRules:
    """Verdict of one record from its thresholds; modes gate, severity and weighted_severity differ in when a miss is a FAIL."""

    thresholds: list[Threshold]
    extra: Threshold | None = None
    mode: str = "weighted_severity"
    cut: float = 0.35
    weighted_cut: float = 0.2483
    fail_if_any: tuple[str, ...] = ("yield",)

    def verdict(self) -> Column:
        required = F.lit(True)
        missing = F.lit(False)
        for t in self.thresholds:
            missing = missing | F.col(t.field).isNull()
            required = required & t.passes()
        if self.extra:
            required = required & F.coalesce(self.extra.passes(), F.lit(True))
        if self.mode == "gate":
            fails = F.lit(False)
            for t in self.thresholds:
                if t.name in self.fail_if_any:
                    fails = fails | ~t.passes()
        elif self.mode in ("severity", "weighted_severity"):
            weighted = self.mode == "weighted_severity"
            fails = severity(self.thresholds, weighted) > F.lit(self.weighted_cut if weighted else self.cut)
        else:
            raise ValueError(f"unknown mode {self.mode}")
        return F.when(missing, "HOLD").when(required, "PASS").when(fails, "FAIL").otherwise("HOLD")

    def evaluate(self, df: DataFrame, record: str, source: str, official: str | None = None) -> DataFrame:
        """Adds computed, verdict (the official one first), colour, agrees, severity, reason and evidence."""
        every = [*self.thresholds, *([self.extra] if self.extra else [])]
        computed = self.verdict()
        shown = F.coalesce(F.col(official), computed) if official else computed
        out = df.withColumn("computed", computed).withColumn("verdict", shown if official else F.col("computed"))
        misses = F.concat_ws("; ", *[F.when(~t.passes(), F.lit(t.bad)) for t in every])
        return out.withColumns(
            {
                "colour": colour(F.col("verdict")),
                "agrees": (F.col(official) == F.col("computed")) if official else F.lit(None).cast("boolean"),
                "severity": severity(self.thresholds, self.mode == "weighted_severity"),
                "reason": F.when(misses == "", F.lit("all criteria met")).otherwise(misses),
                "evidence": F.array_compact(F.array(*[evidence(t, source, F.col(record)) for t in every])),
            }
        )


def colour(verdict: Column) -> Column:
    out = F.lit(None).cast("string")
    for v, c in COLOUR.items():
        out = F.when(verdict == v, c).otherwise(out)
    return out


# fixed values: thresholds of the trial rules
TRIAL_RULES = TrialRules(
    [
        Threshold("yield", "YIELD_T_HA", ">=", 9.0, 1.0, "yield meets threshold", "yield below target"),
        Threshold("moisture", "MOISTURE_PCT", "<=", 22.0, 0.1904, "moisture meets threshold", "moisture above target"),
        Threshold("disease", "DISEASE_SCORE", "<=", 5.0, 0.5644, "disease score acceptable", "disease risk elevated"),
        Threshold("genomic_value", "GENOMIC_BREEDING_VALUE_MEAN", ">=", 102.0, 0.0758, "genomic value favourable", "genomic value below target"),
    ],
    Threshold("resistant_material", "RESISTANT_MATERIAL_PCT", ">", 40.0),
)


@dataclass(frozen=True)
class ShareRules:
    """A candidate's verdict from the share of its records that failed, and a value of its own. Fixed values as defaults."""

    fail_share: float = 0.6
    pass_share: float = 0.2
    value_at_least: float = 102.0
    min_records: int = 3

    def verdict(self, n: Column, fail_share: Column, value: Column) -> Column:
        good = (fail_share <= self.pass_share) & (n >= self.min_records) & (value >= self.value_at_least)
        return F.when(n == 0, "HOLD").when(fail_share >= self.fail_share, "FAIL").when(good, "PASS").otherwise("HOLD")


def candidate_verdicts(records: DataFrame, key: str, values: DataFrame, value: str, rules: ShareRules = ShareRules()) -> DataFrame:
    """records: (key, verdict); values: (key, value), one row a candidate. Candidates without records are on hold."""
    agg = records.groupBy(key).agg(F.count(F.lit(1)).alias("n_records"), F.avg((F.col("verdict") == "FAIL").cast("double")).alias("fail_share"))
    out = values.join(agg, key, "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return out.withColumn("verdict", rules.verdict(F.col("n_records"), F.col("fail_share"), F.col(value))).withColumn("colour", colour(F.col("verdict")))


@dataclass(frozen=True)
class Criterion:
    """must: beyond it RED; target: beyond it AMBER; second: beyond it the AMBER wording changes."""

    name: str
    field: str
    label: str
    higher_is_better: bool
    must: float | None = None
    target: float | None = None
    second: float | None = None
    must_word: str = "limit"
    second_word: str = "limit"
    percent: bool = False

    def beyond(self, limit: float) -> Column:
        return F.col(self.field) < limit if self.higher_is_better else F.col(self.field) > limit

    def says(self, word: str, limit: float) -> Column:
        unit = "%" if self.percent else ""
        side = "below" if self.higher_is_better else "above"
        shown = fixed(F.col(self.field), 1)
        limit_text = f"{limit:g}" if self.percent else f"{limit:.1f}"
        return F.concat(F.lit(f"{self.label} "), shown, F.lit(f"{unit} {side} {word} {limit_text}{unit}"))

    def red(self) -> Column:
        return F.lit(False) if self.must is None else F.coalesce(self.beyond(self.must), F.lit(False))

    def amber(self) -> Column:
        if self.target is None:
            return F.lit(False)
        return F.coalesce(self.beyond(self.target), F.lit(False)) & ~self.red()

    def red_text(self) -> Column:
        return F.when(self.red(), self.says(self.must_word, self.must)) if self.must is not None else F.lit(None).cast("string")

    def amber_text(self) -> Column:
        if self.target is None:
            return F.lit(None).cast("string")
        text = self.says("target", self.target)
        if self.second is not None:
            text = F.when(self.beyond(self.second), self.says(self.second_word, self.second)).otherwise(text)
        return F.when(self.amber(), text)


@dataclass(frozen=True)
class RagRules:
    """Two tiers of criteria, a marker and a minimum of usable records. No field data is AMBER before anything else."""

    criteria: list[Criterion]
    order_red: list[str]
    order_amber: list[str]
    marker_field: str | None = None
    marker_bad: str = "SUSCEPTIBLE"
    marker_text: str = "disease-susceptible marker"
    used_field: str | None = "N_TRIALS_USED"
    min_used: int = 2
    no_data: str = "No field data yet (genotyped only) - cannot judge performance"
    green_field: str | None = "YIELD_VS_CHECK_PCT"
    green: str = "Beats checks (%s%%) with all field and lab checks passing"

    def evaluate(self, df: DataFrame, official: str | None = None) -> DataFrame:
        """Adds computed_colour, colour (the official one first), reason and agrees."""
        by = {c.name: c for c in self.criteria}
        red, amber = F.lit(False), F.lit(False)
        for c in self.criteria:
            red, amber = red | c.red(), amber | c.amber()
        texts = {n: by[n].amber_text() for n in self.order_amber if n in by}
        if self.marker_field:
            bad = F.coalesce(F.col(self.marker_field) == self.marker_bad, F.lit(False))
            amber, texts["marker"] = amber | bad, F.when(bad, self.marker_text)
        none = F.lit(False)
        if self.used_field:
            used = F.coalesce(F.col(self.used_field), F.lit(0))
            few = (used > 0) & (used < self.min_used)
            none, amber = used == 0, amber | few
            texts["trials"] = F.when(few, F.concat(F.lit("only "), used.cast("int").cast("string"), F.lit(" usable trial")))
        computed = F.when(none, "AMBER").when(red, "RED").when(amber, "AMBER").otherwise("GREEN")
        reds = F.concat_ws("; ", *[by[n].red_text() for n in self.order_red])
        ambers = F.concat_ws("; ", *[texts[n] for n in self.order_amber if n in texts])
        good = F.format_string(self.green, fixed(F.col(self.green_field), 0)) if self.green_field else F.lit("all criteria met")
        reason = F.when(none, self.no_data).when(red, reds).when(amber, ambers).otherwise(good)
        out = df.withColumn("computed_colour", computed).withColumn("reason", reason)
        if official:
            return out.withColumns({"colour": F.coalesce(F.col(official), F.col("computed_colour")), "agrees": F.col(official) == F.col("computed_colour")})
        return out.withColumn("colour", F.col("computed_colour"))


# fixed values: limits and wording of the candidate rules
RAG_RULES = RagRules(
    [
        Criterion("yield_vs_check", "YIELD_VS_CHECK_PCT", "yield vs checks", True, 95, 103, must_word="minimum", percent=True),
        Criterion("disease", "DISEASE_SCORE_MEAN", "disease score", False, 6.0, 4.0),
        Criterion("moisture", "MOISTURE_PCT_MEAN", "harvest moisture", False, None, 23.0, 25.0),
        Criterion("germination", "GERMINATION_PCT", "germination", True, None, 90, 85, second_word="minimum", percent=True),
        Criterion("fumonisin", "FUMONISIN_PPM", "fumonisin", False, 4.0),
    ],
    ["yield_vs_check", "disease", "fumonisin"],
    ["yield_vs_check", "disease", "moisture", "germination", "marker", "trials"],
    marker_field="MARKER_DISEASE_RESISTANCE",
)


def record_verdict(used: Column, ratio: Column, disease: Column, moisture: Column) -> Column:
    """A candidate's result in one trial by the candidate limits: EXCLUDED, FAIL, HOLD or PASS; missing values never fail."""
    by = {c.name: c for c in RAG_RULES.criteria}
    yes = lambda c: F.coalesce(c, F.lit(False))
    fail = yes(ratio < by["yield_vs_check"].must) | yes(disease > by["disease"].must)
    hold = yes(ratio < by["yield_vs_check"].target) | yes(disease > by["disease"].target) | yes(moisture > by["moisture"].target)
    return F.when(~yes(used), "EXCLUDED").when(fail, "FAIL").when(hold, "HOLD").otherwise("PASS")


def record_statement(yields: Column, ratio: Column, disease: Column, moisture: Column, excluded: Column) -> Column:
    parts = [("yield %s t/ha", yields, 2), ("%s%% of checks", ratio, 1), ("disease %s", disease, 2), ("moisture %s%%", moisture, 1)]
    text = F.concat_ws(", ", *[F.when(c.isNotNull(), F.format_string(f, fixed(c, n))) for f, c, n in parts])
    note = F.when(F.coalesce(excluded, F.lit("")) != "", F.concat(F.lit(" (excluded: "), excluded, F.lit(")"))).otherwise("")
    return F.concat(text, note)


def reread_mismatches(decided: DataFrame, tables: DataFrame, record: str, fields: list[str], tol: float = 1e-9) -> DataFrame:
    """Evidence whose cited number is not what the table holds now: (record, field, cited, found)."""
    cited = decided.select(F.explode("evidence").alias("e")).select("e.record", "e.field", F.col("e.value_num").alias("cited"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("found")) for f in fields])
    now = tables.select(F.col(record).cast("string").alias("record"), F.explode(cells).alias("c")).select("record", "c.field", "c.found")
    j = cited.where(F.col("field").isin(*fields)).join(now, ["record", "field"], "left")
    return j.where(F.col("found").isNull() | (F.abs(F.col("cited") - F.col("found")) > tol))


def confusion(df: DataFrame, official: str, computed: str) -> DataFrame:
    return df.groupBy(F.col(official).alias("official"), F.col(computed).alias("computed")).agg(F.count(F.lit(1)).alias("n"))


def parity(df: DataFrame, official: str, computed: str) -> DataFrame:
    """agree, total (with an official verdict) and accuracy."""
    known = F.col(official).isNotNull()
    return df.agg(
        F.count_if(known & (F.col(official) == F.col(computed))).alias("agree"),
        F.count_if(known).alias("total"),
        F.try_divide(F.count_if(known & (F.col(official) == F.col(computed))), F.count_if(known)).alias("accuracy"),
    )


def what_if(df: DataFrame, rules: TrialRules, replace: dict[str, str], official: str) -> DataFrame:
    """One row: verdicts that change if some fields take other columns' values, and parity with both. One pass, no self-join."""
    base = df.withColumns({"_base": rules.verdict(), "_official": F.col(official)})
    alt = base.withColumns({f: F.col(c) for f, c in replace.items()}).withColumn("_alt", rules.verdict())
    return alt.agg(
        F.count_if(F.col("_base") != F.col("_alt")).alias("n_changed"),
        F.count_if(F.col("_base") == F.col("_official")).alias("parity_reported"),
        F.count_if(F.col("_alt") == F.col("_official")).alias("parity_recomputed"),
    )


def diagnose(df: DataFrame, rules: TrialRules, record: str, official: str, k: int = 5, band: tuple[float, float] | None = None, only: Column | None = None) -> DataFrame:
    """A root cause for each disagreement with the official verdict: WEIGHTING, BOUNDARY, LABEL_CONFLICT or MISSING_FACTOR.

    Disagreeing records (those that meet the condition ``only``, if there is one) are the queries of a nearest-neighbour search over
    all labelled records, in z-scores of the criteria. Records are written once; verdicts are compared by their 64-bit hash.
    """
    from dataclasses import replace

    from . import neighbours

    fields = [t.field for t in rules.thresholds] + ([rules.extra.field] if rules.extra else [])
    weighted = replace(rules, mode="weighted_severity")
    rows = df.where(F.col(official).isNotNull()).select(
        F.col(record).alias("id"), F.col(official).alias("official"), rules.verdict().alias("computed"), weighted.verdict().alias("weighted"),
        severity(rules.thresholds).alias("severity"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(fields)],
        (only if only is not None else F.lit(True)).alias("_asked"),
    )
    rows, x = pinned(rows, "records"), [f"_x{i}" for i in range(len(fields))]
    stats = rows.agg(*[g(c).alias(f"{n}{c}") for c in x for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.lit(stats[f"m{c}"]), F.lit(stats[f"s{c}"])), F.lit(0.0)) + F.lit(0.0) for c in x}
    rows = rows.withColumns(z)
    wrong = rows.where("official <> computed and _asked").drop("_asked")
    near = neighbours.near_places(rows.select("id", F.xxhash64("official").alias("label"), *x), wrong.select(*x), x, k + 1)
    others = F.slice(F.filter("near", lambda r: r["id"] != F.col("id")), 1, k)
    like = lambda verdict: F.size(F.filter("_others", lambda r: r["label"] == F.xxhash64(verdict)))
    out = wrong.join(near, x).withColumn("_others", others).withColumns({"like_engine": like("computed"), "like_official": like("official")})
    inside = F.col("severity").between(*band) if band and rules.mode == "severity" else F.lit(False)
    cause = (
        F.when(F.lit(rules.mode != "weighted_severity") & (F.col("weighted") == F.col("official")), "WEIGHTING")
        .when(inside, "BOUNDARY")
        .when(F.col("like_engine") > F.col("like_official"), "LABEL_CONFLICT")
        .otherwise("MISSING_FACTOR")
    )
    return out.select(F.col("id").alias(record), "official", "computed", "severity", "like_engine", "like_official", cause.alias("cause"))


def baseline(df: DataFrame, record: str, official: str, computed: str, official_reason: str, reason: str) -> DataFrame:
    """One row: parity, how many records the rules do not explain (up to 12 of them named), and how many reason texts are the same."""
    known = F.col(official).isNotNull()
    agree = known & (F.col(official) == F.col(computed))
    counts = df.agg(
        F.count_if(agree).alias("agree"), F.count_if(known).alias("total"), F.try_divide(F.count_if(agree), F.count_if(known)).alias("accuracy"),
        F.count_if(known & (F.col(official) != F.col(computed))).alias("n_not_explained"), F.count_if(F.col(official_reason) == F.col(reason)).alias("identical_reasons"),
        F.count(F.lit(1)).alias("n_reasons"),
    )
    few = df.where(known & (F.col(official) != F.col(computed))).select(F.col(record).cast("string").alias("r")).orderBy("r").limit(12)
    return counts.join(F.broadcast(few.agg(F.array_sort(F.collect_list("r")).alias("not_explained"))))
