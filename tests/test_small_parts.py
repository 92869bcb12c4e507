"""Public functions that no query runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import canon
from evidra.operators import audit, calibration, drift, profile, quality, recompute, reconcile, relational, spectral, verification
from evidra.sources import documents
from evidra.streaming import ingest


def test_content_hash_ignores_order_and_sees_every_cell(spark):
    rows = [(i, f"v{i % 7}", None if i % 3 else 1.5) for i in range(200)]
    of = lambda r: profile.content_hash(spark.createDataFrame(r, "a int, b string, c double")).first()["hash"]
    assert of(rows) == of(rows[::-1]) and len({of(rows), of(rows[1:]), of([*rows, rows[0]]), of([(0, "v1", 1.5), *rows[1:]])}) == 4


def test_justifications_are_used_again_for_the_same_evidence_only(spark):
    evidence = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 2.5)], "a int, b double").select(audit.evidence_hash(F.struct("a", "b")).alias("h"))
    h = [r["h"] for r in evidence.collect()]
    assert h[0] == h[1] != h[2] and len(h[0]) == 64
    cards = spark.createDataFrame([("c1", "v1", "h1"), ("c1", "v2", "h1"), ("c2", "v1", "h1")], "candidate_id string, rule_version string, evidence_hash string")
    reviews = spark.createDataFrame([("c1", "v1", "h1", True, "old", 1), ("c1", "v1", "h1", True, "new", 2), ("c1", "v1", "h1", False, "unverified", 3), ("c2", "v1", "h2", True, "other", 4)], "candidate_id string, rule_version string, evidence_hash string, verified boolean, justification string, seq int")
    assert sorted((r["candidate_id"], r["rule_version"], r["justification"]) for r in audit.reusable(cards, reviews).collect()) == [("c1", "v1", "new"), ("c1", "v2", None), ("c2", "v1", None)]


def test_provenance_issues_of_a_merge(spark):
    log = spark.createDataFrame([("duplicate", 3), ("conflict", 2), ("natural_clash", 1), ("new", 9), ("duplicate", 0)], "outcome string, n long")
    got = {r["id"]: (r["count"], r["severity"], r["fix_status"]) for r in reconcile.provenance_issues(log, "lab").collect()}
    assert got == {"provenance.conflict": (3, "warning", "proposed"), "provenance.duplicate": (3, "info", "applied")}
    assert {r["id"] for r in quality.explained(reconcile.provenance_issues(log, "lab")).where("title is not null").collect()} == set(got)


def test_corrections_empty_columns_and_short_lists(spark):
    orphans = spark.createDataFrame([(1, "old", "T9", 1), (2, "old", None, 4)], "op int, trial string, proposed string, n_options int")
    got = [tuple(r) for r in quality.corrections(orphans, "op", "trial", "trial").orderBy("record").collect()]
    assert got == [("1", "trial", "old", "T9", "proposed", "options: 1"), ("2", "trial", "old", None, "quarantined", "options: 4")]
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b string, c string")
    assert [r["column"] for r in quality.empty_columns(df, ["a", "b", "c"]).collect()] == ["b"]
    ids = spark.createDataFrame([(["a"] * 12,), (["b"] * 15,), ([],)], "x array<string>").select(relational.short_list(F.col("x")).alias("x")).collect()
    assert [len(r["x"]) for r in ids] == [12, 13, 0] and ids[1]["x"][-1] == "... +3 more"


def test_not_a_number_becomes_null_and_ambiguous_is_a_band(spark):
    df = spark.createDataFrame([(1, float("nan"), 0.3), (2, 1.0, 0.35), (3, None, 0.65), (4, float("inf"), 0.66)], "i int, x double, p float")
    assert [r["x"] for r in canon.clean_nan(df).orderBy("i").collect()] == [None, 1.0, None, math.inf]
    assert [r["a"] for r in df.select("i", calibration.ambiguous(F.col("p").cast("decimal(3,2)")).alias("a")).orderBy("i").collect()] == [False, True, True, False]
    assert df.where("i = 2").select(verification.fallback(F.lit("C1"), F.lit("RED"), F.lit("yield is low")).alias("t")).first()["t"] == "C1 is RED: yield is low."


def test_drivers_are_the_largest_contributions(spark):
    scored = spark.createDataFrame([(1, [0.5, 3.0, -1.0, 2.0])], "k int, contributions array<double>")
    assert [(d["name"], d["value"]) for d in spectral.drivers(scored, "k", list("abcd"), 2).first()["drivers"]] == [("b", 3.0), ("d", 2.0)]


def test_all_numeric_identities_hold_and_see_a_wrong_basis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) * [1, 5, 0.2, 2]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    model = spectral.fit(df, list("abcd"), 0.9)
    good = {r["check"]: r for r in spectral.identities(df, "id", model, 0).collect()}
    assert len(good) == 11 and all(r["passed"] for r in good.values())
    assert good["energy_of_all_components"]["measured"] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    turned = spectral.Model(model.mean, model.basis @ np.linalg.qr(rng.normal(size=(model.k, model.k)))[0] + 0.01, model.values, model.n, model.names)
    assert not all(r["passed"] for r in spectral.identities(df, "id", turned).collect())
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert spectral.condition(model)["condition"] == pytest.approx(s[0] / s[-1]) and spectral.condition(model)["digits_at_risk"] == pytest.approx(np.log10(s[0] / s[-1]))


def test_a_stored_fingerprint_stands_for_the_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    old = spark.createDataFrame([(float(v), float(i % 4), "ab"[i % 2]) for i, v in enumerate(rng.normal(size=900))], "x double, z double, c string")
    new = spark.createDataFrame([(float(v), None, "abc"[i % 3], 1) for i, v in enumerate(rng.normal(0.5, 2, size=700))], "x double, z double, c string, extra int")
    drift.fingerprint(old, ["x", "z"], ["c"]).write.json(f"file://{tmp_path}/run1")
    kept = spark.read.schema(drift.FINGERPRINT).json(f"file://{tmp_path}/run1")
    got = {r["column"]: r for r in drift.since(kept, new).collect()}
    a, b = (np.array([r["x"] for r in df.collect()]) for df in (old, new))
    edges = np.quantile(a, np.arange(1, 10) / 10)
    p, q = (np.maximum(np.bincount(np.searchsorted(edges, v), minlength=10) / len(v), 1e-4) for v in (a, b))
    assert got["x"]["value"] == pytest.approx(((q - p) * np.log(q / p)).sum(), rel=1e-9)
    assert got["x"]["mean_shift_sd"] == pytest.approx((b.mean() - a.mean()) / a.std(ddof=1), rel=1e-9)
    assert got["c"]["value"] == pytest.approx((abs(1 / 2 - 234 / 700) + abs(1 / 2 - 233 / 700) + 233 / 700) / 2) and got["z"]["mean_shift_sd"] is None
    assert {(r["column"], r["change"]) for r in drift.schema_since(kept, new).collect()} == {("extra", "added")}
    assert got["c"]["worst"] == max(r["value"] for r in got.values())


@pytest.mark.parametrize("groups", [1, 3])
def test_quantiles_by_brackets_equal_numpy(spark, groups):
    rng = np.random.default_rng(groups)
    rows = [(int(i % groups), float(v)) for i, v in enumerate(np.round(rng.exponential(3, 30_000), 2))] + [(0, 7.0)] * 9_000 + [(9, 1.0), (9, None), (10, None)]
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    for f in (relational.quantiles, relational._ranged_quantiles):
        got = {r["g"]: [r[f"q{i}"] for i in range(len(at))] for r in f(df, ["g"], "x", at).collect()}
        assert set(got) == {*range(groups), 9}
        for g in got:
            assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], at))


def test_examples_of_a_comparison(spark):
    a = spark.createDataFrame([(f"r{i:02}", float(i)) for i in range(40)], "k string, v double")
    b = spark.createDataFrame([(f"r{i:02}", float(i + (i % 2))) for i in range(40)], "k string, w double")
    r = recompute.compare(a, b, "k", {"v": ("w", 0.5)}, examples=3).first()
    assert (r["outside_tolerance"], r["examples"]) == (20, ["r01", "r03", "r05"])


def test_sources_of_free_tables(spark):
    from evidra.operators.detect import SIGNATURES

    source, variants = next(iter(SIGNATURES.items()))
    head = list(variants[0])
    rows = [("d", 0, head), ("d", 1, ["1"] * len(head)), ("e", 0, ["no", "such", "header"])]
    got = {r["doc"]: (r["source"], r["score"]) for r in documents.table_sources(spark.createDataFrame(rows, "doc string, row_no int, cells array<string>"), ["doc"]).collect()}
    assert got["d"] == (source, 1.0) and got["e"][0] == "UNKNOWN"


def test_streams_drop_repeats_and_count_by_window(spark, tmp_path):
    schema = "at timestamp, k string, v int"
    rows = [("2024-01-01 00:00:01", "a", 1), ("2024-01-01 00:00:01", "a", 1), ("2024-01-01 00:00:30", "a", 2), ("2024-01-01 00:02:00", "b", 1)]
    spark.createDataFrame(rows, "at string, k string, v int").select(F.to_timestamp("at").alias("at"), "k", "v").write.parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for name, df in (("rows", ingest.distinct_rows(read, "at", "10 minutes", ["at", "k", "v"])), ("counts", ingest.counts(read, "at", "10 minutes", "1 minute", "k"))):
        mode = "append" if name == "rows" else "complete"
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("rows").count() == 3
    assert sorted((str(r["start"]), r["k"], r["n"]) for r in spark.table("counts").collect()) == [("2024-01-01 00:00:00", "a", 3), ("2024-01-01 00:02:00", "b", 1)]


def test_reports_of_a_build(spark):
    from evidra.plans import views

    found = spark.createDataFrame([("a", "info", 9), ("b", "critical", 1), ("c", "warning", 2), ("d", "warning", 5)], "id string, severity string, count long")
    assert [r["id"] for r in views.issues(found).collect()] == ["b", "d", "c", "a"]
    decided = spark.createDataFrame([(1, "SYN-TR-0001", "PASS"), (2, "SYN-TR-0002", "FAIL")], "g int, TRIAL_ID string, verdict string")
    tested = spark.createDataFrame([(1, "m1"), (1, "m1"), (1, "m2")], "g int, m string")
    facts_ = spark.createDataFrame([("doc1", {"trial_id": ["SYN-TR-0001"]}), ("doc1", {"trial_id": ["SYN-TR-0001", "SYN-TR-0002"]}), ("doc2", {"trial_id": ["syn-tr-0001"]})], "document string, ids map<string, array<string>>")
    rows = views.trials(decided, tested, facts_, "g", "TRIAL_ID", "m").collect()
    got = {r["g"]: (r["n_materials"], r["n_documents"]) for r in rows}
    assert len(rows) == 2 and {r["verdict"] for r in rows} == {"PASS", "FAIL"}
    assert got == {1: (2, 2), 2: (0, 1)}
    runs = spark.createDataFrame([("r1", "load", 2.0), ("r2", "load", 1.0), ("r2", "decide", 3.0)], "run string, stage string, seconds double")
    checks = spark.createDataFrame([("roundtrip", 1e-15, True)], "check string, value double, passed boolean")
    moved = spark.createDataFrame([("x", 0.3, "major")], "column string, value double, status string")
    assert sorted(tuple(r) for r in views.diagnostics(runs, checks, moved).collect()) == [("drift", "x", 0.3, False), ("numeric", "roundtrip", 1e-15, True), ("run", "decide", 3.0, True), ("run", "load", 1.0, True)]
