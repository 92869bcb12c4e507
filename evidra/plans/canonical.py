"""Queries of the canonical model, over the driver's tables as a drop of field trials: orders modulo 500 are trials, lines are plots,
suppliers are materials (every tenth a check), and orders are field operations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, recompute, relational
from ..operators.canonical import ENTRY, MATERIAL, TRIAL
from ..session import folder, pinned, table
from . import build


class Drop:
    """The sources of the drop under the data model's names. kept: what a query reads many times is made once and written."""

    def __init__(self, spark: SparkSession, d: str, kept: bool = False) -> None:
        self._keep = pinned if kept else lambda df, name: df
        li, sup, orders = (table(spark, d, n) for n in ("lineitem", "supplier", "orders"))
        entry = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        keyed = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias(MATERIAL))
        role = F.when(F.col(MATERIAL) % 10 == 0, "CHECK").otherwise("TRIAL_ENTRY")
        bridge = keyed.select(
            entry.alias(ENTRY), (F.col("l_orderkey") % 500).alias(TRIAL), MATERIAL, role.alias("ENTRY_ROLE_LID"), F.col("l_linenumber").alias("REPLICATION_NO"), F.col("l_orderkey").alias("FIELD_ENTITY_ID")
        )
        self.bridge = self._keep(bridge, "bridge")
        trait = F.when(F.col("l_returnflag") == "A", "YIELD_T_HA").when(F.col("l_returnflag") == "N", "MOISTURE_PCT").otherwise("DISEASE_SCORE")
        # every 23rd plot names an entry that the bridge lacks
        self.observations = li.select((entry + F.when(F.col("l_orderkey") % 23 == 0, 10_000_000_000).otherwise(0)).alias("TRIAL_ENTRY_RELATIONSHIP_GUID"), trait.alias("TRAIT_CODE"), F.col("l_quantity").alias("NUMBER_VALUE"))
        key = F.col("o_orderkey")
        ops = orders.select(
            F.when(key % 13 == 0, key + 1_000_000_000).otherwise(key).alias("ATTACHED_TO_FIELD_ENTITY_ID"),
            F.when(F.col("o_orderstatus") == "F", "sowing").when(F.col("o_orderstatus") == "O", "Irrigation").otherwise("HARVEST").alias("OPERATION_TYPE_LID"),
            F.col("o_orderdate").alias("PLANNED_DATE"), F.when(key % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("ACTUAL_DATE"),
            F.when((F.col("o_orderpriority") == "1-URGENT") & (key % 50 == 1), "MISSED").when(F.col("o_orderpriority") == "2-HIGH", "Delayed").otherwise("DONE").alias("STATUS_LID"),
            F.when(F.col("o_custkey") % 5 == 0, "paper").otherwise("APP").alias("RECORDED_VIA"), (F.col("o_custkey") % 100).alias(MATERIAL),
        )
        self.recorded = ops
        self.operations = self._keep(canonical.linked_operations(ops, self.bridge), "operations")
        self.excluded = recompute.excluded_records(self.operations, TRIAL, F.col("OPERATION_TYPE_LID"), F.col("STATUS_LID"), ["irrigation"])
        self.master = sup.where("s_suppkey % 17 <> 3").select(
            F.col("s_suppkey").alias(MATERIAL), F.col("s_name").alias("MATERIAL_ID"), *[F.lit(None).cast("string").alias(c) for c in ("FEMALE_PARENT_MATERIAL_GUID", "MALE_PARENT_MATERIAL_GUID")]
        )
        self.recommendations = sup.where("s_suppkey % 10 <> 0").select(
            F.col("s_suppkey").alias(MATERIAL), F.lit(20).alias("N_TRIALS"), F.when(F.col("s_suppkey") % 7 != 0, F.lit("5")).alias("N_TRIALS_USED"), F.round(F.col("s_acctbal") / 100).alias("YIELD_VS_CHECK_PCT"),
            F.when(F.col("s_suppkey") % 3 == 0, "PASS").alias("BREEDER_DECISION"),
        )
        self.genomics = sup.select(
            F.col("s_suppkey").alias(MATERIAL), F.round("s_acctbal").alias("GENOMIC_BREEDING_VALUE"), F.when(F.col("s_nationkey") % 3 == 0, "RESISTANT").when(F.col("s_nationkey") % 3 == 1, "SUSCEPTIBLE").alias("MARKER_DISEASE_RESISTANCE"),
            F.when(F.col("s_suppkey") % 6 != 0, "PASS").alias("QC_STATUS_LID"),
        )
        t = F.col("id")
        self.summary = spark.range(480).select(
            t.alias(TRIAL), F.concat(F.lit("T"), t.cast("string")).alias("TRIAL_ID"), F.lit(4500.0).alias("GENOMIC_BREEDING_VALUE_MEAN"), (t % 60).cast("double").alias("RESISTANT_MATERIAL_PCT"), (t % 4).alias("location"), (t % 2 + 2020).alias("START_YEAR")
        )

    @cached_property
    def _trial_material(self) -> DataFrame:
        return self._keep(canonical.trial_material(self.observations, self.bridge, self.excluded, ["YIELD_T_HA", "MOISTURE_PCT", "DISEASE_SCORE"]), "trial_material")

    def trial_material(self) -> DataFrame:
        return self._trial_material

    def trials(self) -> DataFrame:
        return canonical.trials(self.bridge, self.operations, self.trial_material(), self.excluded)

    def materials(self) -> DataFrame:
        return canonical.materials(self.master, self.recommendations, self.bridge)

    def candidates(self) -> DataFrame:
        return canonical.candidates(self.recommendations, self.trial_material())

    def compared(self) -> DataFrame:
        return canonical.compare_summary(self.recommendations, self.candidates(), canonical.SUMMARY_FIELDS)

    def references(self) -> DataFrame:
        a = relational.references(self.bridge, MATERIAL, self.master, MATERIAL, "bridge -> master")
        b = relational.references(self.observations, "TRIAL_ENTRY_RELATIONSHIP_GUID", self.bridge, ENTRY, "observation -> bridge")
        return a.unionByName(b).unionByName(relational.references(self.genomics, MATERIAL, self.genomics, MATERIAL, "genomics -> genomics"))


def _six(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def canonical_trial_material(spark, d):
    return _six(Drop(spark, d).trial_material())


def canonical_trials(spark, d):
    return _six(Drop(spark, d).trials()).withColumn("SOWING_DATE", F.date_format("SOWING_DATE", "yyyy-MM-dd"))


def canonical_materials(spark, d):
    return Drop(spark, d).materials().select(MATERIAL, "candidate_id", "role")


def canonical_candidates(spark, d):
    return _six(Drop(spark, d).candidates())


def canonical_long_view(spark, d):
    x = Drop(spark, d)
    return canonical.long_view(x.trial_material().select(TRIAL, MATERIAL, "role", "used"), x.summary, x.materials())


def canonical_master_columns(spark, d):
    """Orders as summaries; the customer master adds only what they lack."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias(TRIAL), "o_orderkey", F.lit(1).alias("NO_OF_REPLICATIONS"))
    master = table(spark, d, "customer").where("c_custkey % 9 <> 4").select(F.col("c_custkey").alias(TRIAL), F.col("c_mktsegment").alias("TRIAL_TYPE_LID"), F.lit(9).alias("NO_OF_REPLICATIONS"))
    return canonical.with_master(orders, master, TRIAL, ["BEGIN_DATE", "NO_OF_REPLICATIONS", "TRIAL_TYPE_LID"])


def canonical_first_operation(spark, d):
    x = Drop(spark, d)
    out = canonical.with_first_date(x.summary.select(TRIAL), x.operations, "sowing", "PLANNED_DATE", "PLANTING_DATE")
    return out.withColumn("PLANTING_DATE", F.date_format("PLANTING_DATE", "yyyy-MM-dd"))


def canonical_genomic_means(spark, d):
    x = Drop(spark, d)
    return _six(canonical.genomic_means(x.trial_material(), x.genomics))


def canonical_findings(spark, d):
    x = Drop(spark, d, kept=True)
    out = canonical.findings(x.trial_material(), x.summary, x.materials(), x.genomics, x.operations, ["operations source is partial"])
    return _six(out.withColumn("worst", F.array_join("worst", ", ")))


def canonical_recomputation(spark, d):
    return canonical.recomputation_findings(Drop(spark, d).compared()).drop("statement")


def canonical_issues(spark, d):
    x = Drop(spark, d)
    out = canonical.issues(x.recommendations, x.trial_material(), x.trials(), x.materials(), x.operations, x.references(), x.compared())
    return out.select("id", "category", "severity", "count", F.array_join("affected", ",").alias("affected"), "fix_status", (F.col("question").isNotNull() & F.col("title").isNotNull()).alias("asks"))


def canonical_incremental(spark, d):
    """The model after an upload that takes a seventh of the materials from the master: what each table holds, and whether it was built."""
    x = Drop(spark, d)
    store = build.Build(spark, folder(spark, "build"), build.CANONICAL, ("master",))
    sources = {"bridge": x.bridge, "observations": x.observations, "operations": x.recorded, "master": x.master, "recommendations": x.recommendations, "genomics": x.genomics, "summary": x.summary}
    store.update(sources)
    outcome = store.update({"master": x.master.where(F.col(MATERIAL) % 7 != 1), "genomics": x.genomics.orderBy(F.desc(MATERIAL))})
    tables, out = store.current(), None
    for name in ("materials", "long_view", "candidates", "genomic_means", "trial_material"):
        df = tables[name]
        known = F.count("candidate_id") if "candidate_id" in df.columns else F.lit(None).cast("long")
        one = df.agg(F.lit(name).alias("table"), F.lit(name in outcome.built).alias("built"), F.count(F.lit(1)).alias("n"), known.alias("known"))
        out = one if out is None else out.unionByName(one)
    return out


def canonical_verdict_counts(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.element_at(F.create_map(*[F.lit(x) for x in ("F", "FAIL", "P", "HOLD", "O", "PASS")]), F.col("o_orderstatus"))).alias("official"),
        F.when(F.col("o_orderkey") % 5 == 0, "EXCLUDED").otherwise("HOLD").alias("computed"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") > 200000).alias("ambiguous"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") > 50000).alias("explained"),
    )
    return canonical.verdict_counts(rows, "o_custkey")


QUERIES = {f.__name__: f for f in (
    canonical_trial_material, canonical_trials, canonical_materials, canonical_candidates, canonical_long_view, canonical_master_columns, canonical_first_operation,
    canonical_genomic_means, canonical_findings, canonical_recomputation, canonical_issues, canonical_incremental, canonical_verdict_counts,
)}

_DROP = """
k AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS m FROM lineitem GROUP BY ALL),
bridge AS (SELECT l_orderkey * 10 + l_linenumber AS e, l_orderkey % 500 AS t, m, CASE WHEN m % 10 = 0 THEN 'CHECK' ELSE 'TRIAL_ENTRY' END AS role, l_linenumber AS rep, l_orderkey AS fe FROM k),
obs AS (SELECT l_orderkey * 10 + l_linenumber + CASE WHEN l_orderkey % 23 = 0 THEN 10000000000 ELSE 0 END AS e, l_returnflag AS f, l_quantity AS v FROM lineitem),
ops AS (SELECT l.t, CASE o_orderstatus WHEN 'F' THEN 'sowing' WHEN 'O' THEN 'Irrigation' ELSE 'HARVEST' END AS kind, o_orderdate AS planned, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 2 DAY END AS actual,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 1 THEN 'MISSED' WHEN o_orderpriority = '2-HIGH' THEN 'Delayed' ELSE 'DONE' END AS status, o_custkey % 5 = 0 AS offline, o_custkey % 100 AS m
    FROM orders LEFT JOIN (SELECT DISTINCT fe, t FROM bridge) l ON CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END = l.fe),
ex AS (SELECT DISTINCT t FROM ops WHERE status = 'MISSED' AND kind = 'Irrigation' AND t IS NOT NULL),
p AS (SELECT t, m, role, avg(v) FILTER (WHERE f = 'A') AS y, avg(v) FILTER (WHERE f = 'N') AS mo, avg(v) FILTER (WHERE f = 'R') AS di, count(DISTINCT rep) AS n_reps FROM obs JOIN bridge USING (e) GROUP BY ALL),
c AS (SELECT t, avg(y) AS cy FROM p WHERE role = 'CHECK' GROUP BY t),
tm AS (SELECT p.*, cy, CASE WHEN cy <> 0 THEN 100 * y / cy END AS vs, role = 'TRIAL_ENTRY' AND p.t NOT IN (SELECT t FROM ex) AS used, p.t IN (SELECT t FROM ex) AS gone FROM p LEFT JOIN c ON p.t = c.t),
rec AS (SELECT s_suppkey AS m, CASE WHEN s_suppkey % 7 <> 0 THEN 5 END AS used, round(s_acctbal / 100) AS vs, s_suppkey % 3 = 0 AS decided FROM supplier WHERE s_suppkey % 10 <> 0),
master AS (SELECT s_suppkey AS m, s_name FROM supplier WHERE s_suppkey % 17 <> 3),
mat AS (SELECT m, s_name, CASE WHEN m IN (SELECT m FROM rec) THEN 'candidate' WHEN m IN (SELECT m FROM bridge WHERE role = 'CHECK') THEN 'check' ELSE 'other' END AS role FROM master),
cand AS (SELECT rec.m, count(DISTINCT t) AS n, count(DISTINCT t) FILTER (WHERE tm.used) AS nu, avg(y) FILTER (WHERE tm.used) AS my, avg(cy) FILTER (WHERE tm.used) AS mcy,
    avg(di) FILTER (WHERE tm.used) AS mdi, avg(mo) FILTER (WHERE tm.used) AS mmo FROM rec LEFT JOIN (SELECT * FROM tm WHERE role = 'TRIAL_ENTRY') tm ON rec.m = tm.m GROUP BY rec.m),
su AS (SELECT range AS t, 'T' || range AS id, range % 60 AS rp, range % 4 AS location, range % 2 + 2020 AS year FROM range(480)),
ge AS (SELECT s_suppkey AS m, round(s_acctbal) AS g, coalesce(s_nationkey % 3 = 0, false) AS r, s_suppkey % 6 <> 0 AS ok FROM supplier),
gm AS (SELECT t, avg(g) AS g, 100 * avg(r::INT) AS r FROM tm JOIN ge ON tm.m = ge.m GROUP BY t),
cmp AS (SELECT 'N_TRIALS' AS field, abs(20 - n) AS diff, 0.0::DOUBLE AS tol FROM cand UNION ALL SELECT 'N_TRIALS_USED', abs(used - nu), 0.0 FROM cand JOIN rec USING (m)
    UNION ALL SELECT 'YIELD_VS_CHECK_PCT', abs(vs - 100 * my / mcy), 0.0501 FROM cand JOIN rec USING (m)),
af AS (SELECT 0)
"""

_TRIALS = """tr AS (SELECT b.t, n_entries, n_materials, n_checks, n_reps, sow, d, x, o, cy, b.t IN (SELECT t FROM ex) AS gone FROM
    (SELECT t, count(DISTINCT e) AS n_entries, count(DISTINCT m) AS n_materials, count(*) FILTER (WHERE role = 'CHECK') AS n_checks, count(DISTINCT rep) AS n_reps FROM bridge GROUP BY t) b
    LEFT JOIN (SELECT t, coalesce(min(actual) FILTER (WHERE kind = 'sowing'), min(planned) FILTER (WHERE kind = 'sowing')) AS sow, count(*) FILTER (WHERE status = 'Delayed') AS d,
        count(*) FILTER (WHERE status = 'MISSED') AS x, count(*) FILTER (WHERE offline) AS o FROM ops GROUP BY t) q ON b.t = q.t
    LEFT JOIN (SELECT t, max(cy) AS cy FROM tm GROUP BY t) z ON b.t = z.t)"""


def _found(check: str, rows: str, words: str, bad: str = "warning") -> str:
    """rows: a query of (checked, found), or of (k, gap, tol) for differences."""
    before, middle, after = words.split("%d")
    more = "NULL::DOUBLE AS median, NULL::DOUBLE AS largest, NULL::VARCHAR AS worst"
    if " gap" in rows:
        top = f"SELECT k, gap FROM ({rows}) WHERE gap > tol ORDER BY gap DESC, k::VARCHAR LIMIT 3"
        rows = f"""SELECT count(*) AS checked, count(*) FILTER (WHERE gap > tol) AS found, round(median(gap), 6) AS median, round(max(gap), 6) AS largest, (SELECT coalesce(string_agg(k || ': ' || round(gap, 4)::DOUBLE, ', ' ORDER BY gap DESC, k::VARCHAR), '') FROM ({top})) AS worst FROM ({rows})"""
        more = "median, largest, worst"
    return f"""SELECT '{check}' AS "check", CASE WHEN found > 0 THEN '{bad}' ELSE 'info' END AS severity, checked::BIGINT AS checked, found::BIGINT AS found, {more}, '{before}' || found || '{middle}' || checked || '{after}' AS statement FROM ({rows})"""


def _issue(id: str, category: str, severity: str, rows: str, fix: str) -> str:
    """rows: a query of one column a, the affected id of each row."""
    return f"""SELECT '{id}' AS id, '{category}' AS category, '{severity}' AS severity, count(*) AS count, CASE WHEN count(DISTINCT a) > 12
        THEN array_to_string(list_sort(list_distinct(list(a::VARCHAR) FILTER (WHERE a IS NOT NULL)))[1:12], ',') || ',... +' || count(DISTINCT a) - 12 || ' more'
        ELSE coalesce(array_to_string(list_sort(list_distinct(list(a::VARCHAR) FILTER (WHERE a IS NOT NULL))), ','), '') END AS affected, '{fix}' AS fix_status FROM ({rows}) HAVING count(*) > 0"""


ORACLES = {
    "canonical_trial_material": f"""WITH {_DROP} SELECT t AS "TRIAL_GUID", m AS "MATERIAL_GUID", role, round(y, 6) AS "YIELD_T_HA", round(mo, 6) AS "MOISTURE_PCT", round(di, 6) AS "DISEASE_SCORE", n_reps,
        round(cy, 6) AS "CHECK_YIELD_T_HA", round(vs, 6) AS "YIELD_VS_CHECK_PCT", used, CASE WHEN gone THEN 'irrigation missed' END AS excluded_reason FROM tm""",
    "canonical_trials": f"""WITH {_DROP}, {_TRIALS} SELECT t AS "TRIAL_GUID", n_entries, n_materials, n_checks, n_reps, strftime(sow, '%Y-%m-%d') AS "SOWING_DATE", d AS "IS_DELAYED", x AS "IS_MISSED", o AS "IS_OFFLINE",
        year(sow)::INT AS "START_YEAR", round(cy, 6) AS "CHECK_YIELD_T_HA", gone AS excluded_for_candidates FROM tr""",
    "canonical_materials": f"""WITH {_DROP} SELECT m AS "MATERIAL_GUID", s_name AS candidate_id, role FROM mat""",
    "canonical_candidates": f"""WITH {_DROP} SELECT m AS "MATERIAL_GUID", n AS n_trials, nu AS n_trials_used, round(100 * my / mcy, 6) AS yield_vs_check_pct, round(my, 6) AS "MEAN_YIELD_T_HA",
        round(mdi, 6) AS disease_mean, round(mmo, 6) AS moisture_mean FROM cand""",
    "canonical_long_view": f"""WITH {_DROP} SELECT tm.t AS "TRIAL_GUID", tm.m AS "MATERIAL_GUID", tm.role, used, id AS "TRIAL_ID", location, year AS "START_YEAR", s_name AS candidate_id
        FROM tm LEFT JOIN su ON tm.t = su.t LEFT JOIN mat ON tm.m = mat.m""",
    "canonical_master_columns": """SELECT o_custkey AS "TRIAL_GUID", o_orderkey, 1 AS "NO_OF_REPLICATIONS", c_mktsegment AS "TRIAL_TYPE_LID" FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 4) ON o_custkey = c_custkey""",
    "canonical_first_operation": f"""WITH {_DROP} SELECT su.t AS "TRIAL_GUID", strftime(d, '%Y-%m-%d') AS "PLANTING_DATE" FROM su LEFT JOIN (SELECT t, min(planned) AS d FROM ops WHERE kind = 'sowing' GROUP BY t) x ON su.t = x.t""",
    "canonical_genomic_means": f"""WITH {_DROP} SELECT t AS "TRIAL_GUID", round(g, 6) AS gbv_recomputed, round(r, 6) AS resistant_pct_recomputed FROM gm""",
    "canonical_findings": f"WITH {_DROP} " + " UNION ALL ".join([
        _found("referential_integrity", "SELECT sum(n) AS checked, sum(bad) AS found FROM (SELECT count(*) AS n, count(*) FILTER (WHERE m NOT IN (SELECT m FROM master)) AS bad FROM (SELECT DISTINCT m FROM tm) UNION ALL SELECT count(*), count(*) FILTER (WHERE t NOT IN (SELECT t FROM su)) FROM (SELECT DISTINCT t FROM tm))", "%d of %d observed materials and trials are missing from their master table", "critical"),
        _found("trial_gbv_reconciliation", "SELECT t AS k, abs(4500 - g) AS gap, 1 AS tol FROM gm JOIN su USING (t)", "%d of %d trials report another mean breeding value than their materials have"),
        _found("trial_resistance_reconciliation", "SELECT t AS k, abs(rp - r) AS gap, 5 AS tol FROM gm JOIN su USING (t)", "%d of %d trials report another resistant share than their materials have"),
        _found("operations_vs_observations", "SELECT count(*) AS checked, count(*) FILTER (WHERE x.t IS NULL) AS found FROM ops LEFT JOIN (SELECT DISTINCT t, m FROM tm) x ON ops.t = x.t AND ops.m = x.m", "%d of %d operations name a material without observation in that trial"),
        _found("trial_design_environments", "SELECT count(*) AS checked, count(*) FILTER (WHERE n = 1) AS found FROM (SELECT m, count(DISTINCT (location, year)) AS n FROM tm JOIN su USING (t) GROUP BY m)", "%d of %d candidates were seen in a single place and year"),
        _found("genomics_qc", "SELECT count(*) AS checked, count(*) FILTER (WHERE NOT ok) AS found FROM ge", "%d of %d genomic samples did not pass"),
        """SELECT 'data_gap', 'info', 0, 0, NULL, NULL, NULL, 'operations source is partial'""",
    ]),
    "canonical_recomputation": f"""WITH {_DROP} SELECT 'recomputed_summary' AS "check", CASE WHEN count(*) FILTER (WHERE diff > tol) > 0 THEN 'warning' ELSE 'info' END AS severity, field,
        count(*) FILTER (WHERE diff > tol) AS outside_tolerance FROM cmp GROUP BY field""",
    "canonical_incremental": f"""WITH {_DROP}, kept AS (SELECT * FROM mat WHERE m % 7 <> 1) SELECT 'materials' AS "table", true AS built, count(*) AS n, count(s_name) AS known FROM kept
        UNION ALL SELECT 'long_view', true, count(*), count(s_name) FROM tm LEFT JOIN kept ON tm.m = kept.m UNION ALL SELECT 'candidates', false, count(*), NULL FROM cand
        UNION ALL SELECT 'genomic_means', false, count(*), NULL FROM gm UNION ALL SELECT 'trial_material', false, count(*), NULL FROM tm""",
    "canonical_issues": f"WITH {_DROP}, {_TRIALS}, i AS (" + " UNION ALL ".join([
        _issue("design.no_trial_master", "design", "warning", "SELECT t AS a FROM tr", "not_fixable"),
        _issue("completeness.genotyped_without_trials", "completeness", "info", "SELECT m AS a FROM rec WHERE used IS NULL", "none_needed"),
        _issue("design.commercial_checks", "design", "info", "SELECT m AS a FROM mat WHERE role = 'check'", "none_needed"),
        _issue("operations.delayed", "temporal", "info", "SELECT t AS a FROM ops WHERE status = 'Delayed'", "none_needed"),
        _issue("operations.missed", "completeness", "warning", "SELECT t AS a FROM ops WHERE status = 'MISSED'", "applied"),
        _issue("operations.recorded_offline", "provenance", "warning", "SELECT t AS a FROM ops WHERE offline", "proposed"),
        _issue("decision.breeder_decision_empty", "completeness", "info", "SELECT m AS a FROM rec WHERE NOT decided", "proposed"),
        _issue("completeness.pedigree_empty", "completeness", "info", "SELECT NULL::VARCHAR AS a FROM mat", "not_fixable"),
        """SELECT 'integrity.referential', 'linkage', CASE WHEN sum(bad) > 0 THEN 'warning' ELSE 'info' END, coalesce(sum(bad), 0)::BIGINT, coalesce(string_agg(r, ',' ORDER BY r) FILTER (WHERE bad > 0), ''), CASE WHEN sum(bad) > 0 THEN 'proposed' ELSE 'none_needed' END
            FROM (SELECT 'bridge -> master' AS r, count(*) FILTER (WHERE m NOT IN (SELECT m FROM master)) AS bad FROM bridge UNION ALL SELECT 'observation -> bridge', count(*) FILTER (WHERE e NOT IN (SELECT e FROM bridge)) FROM obs)""",
        """SELECT 'consistency.summary_recomputed', 'aggregation', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'info' END, count(*), coalesce(string_agg(DISTINCT field, ',' ORDER BY field), ''), CASE WHEN count(*) > 0 THEN 'proposed' ELSE 'none_needed' END FROM cmp WHERE diff > tol""",
    ]) + ") SELECT *, id IN ('design.no_trial_master', 'operations.recorded_offline', 'consistency.summary_recomputed') AS asks FROM i",
    "canonical_verdict_counts": """WITH x AS (SELECT o_custkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'HOLD' WHEN 'O' THEN 'PASS' END END, CASE WHEN o_orderkey % 5 = 0 THEN 'EXCLUDED' ELSE 'HOLD' END) AS v,
        o_orderkey % 7 <> 0 AND o_totalprice > 200000 AS amb, o_orderkey % 11 <> 0 AND NOT o_totalprice > 50000 AS unexplained FROM orders)
        SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE v = 'PASS') AS n_pass, count(*) FILTER (WHERE v = 'HOLD') AS n_hold, count(*) FILTER (WHERE v = 'FAIL') AS n_fail, count(*) FILTER (WHERE v = 'EXCLUDED') AS n_excluded,
        count(*) FILTER (WHERE amb) AS n_ambiguous, count(*) FILTER (WHERE unexplained) AS n_not_explained FROM x GROUP BY o_custkey""",
}
