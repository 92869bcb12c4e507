import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import canon, encoding, text
from evidra.operators import audit, calibration, detect, drift, facts, identifiers, profile, quality, reconcile, relational, rules, spectral, topology, verification
from evidra.plans import serve
from evidra.sources import documents, sinks, tabular


def test_canonical_values_agree_however_they_are_typed(spark):
    groups = [["TRUE", "true", " True "], ["1001", "1001.0", " 1001"], ["2024-01-05", "2024-01-05 00:00:00"], ["", "NaN", "NULL", "nat", None]]
    df = spark.createDataFrame([(g, v) for g, vs in enumerate(groups) for v in vs], "g int, v string")
    assert {r["g"]: r["n"] for r in df.groupBy("g").agg(F.size(F.collect_set(F.coalesce(canon.canon(F.col("v")), F.lit("-")))).alias("n")).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}


def test_fold_removes_marks(spark):
    assert spark.createDataFrame([("  Génomico\n ÁÑ ",)], "t string").select(canon.fold(F.col("t"))).first()[0] == "genomico an"


def test_headers_tell_the_source():
    assert not detect.detect(["FOO", "BAR", "MATERIAL_GUID"]).confident
    genomics = detect.SIGNATURES["genomics"][0]
    got = detect.detect([c for c in genomics if c != "MARKER_MATURITY"])
    assert got.source == "genomics" and math.isclose(got.score, 7 / 8)


@pytest.mark.parametrize("values,bits", [(["x", "y"] * 5, 1.0), (["x", None] * 5, 1.0), (["c"] * 4, 0.0), ([None] * 4, 0.0)])
def test_entropy_counts_null_as_a_symbol(spark, values, bits):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert profile.entropy(df).first()["entropy"] == pytest.approx(bits)


def test_uploading_an_export_again_changes_nothing(spark):
    base = spark.createDataFrame([("a", 1.5, True), ("b", None, False)], "k string, x double, f boolean")
    up = base.select("k", F.col("x").cast("string").alias("x"), F.upper(F.col("f").cast("string")).alias("f"))
    merged, log = reconcile.merge(base, [up, up], "k")
    assert merged.count() == 2 and {(r["upload"], r["outcome"], r["n"]) for r in log.collect()} == {(0, "duplicate", 2), (1, "duplicate", 2)}


def test_a_conflict_keeps_the_export(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, x string")
    up = spark.createDataFrame([("a", "9"), ("c", "3")], "k string, x string")
    merged, log = reconcile.merge(base, [up], "k")
    assert sorted(map(tuple, merged.collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert {r["outcome"]: r["n"] for r in log.collect()} == {"conflict": 1, "new": 1}


def test_rag_tiers_and_missing_values(spark):
    schema = "id string, YIELD_VS_CHECK_PCT double, DISEASE_SCORE_MEAN double, MOISTURE_PCT_MEAN double, GERMINATION_PCT double, FUMONISIN_PPM double, MARKER_DISEASE_RESISTANCE string, N_TRIALS_USED int"
    rows = [
        ("none", 50.0, 9.0, None, None, None, None, 0), ("red", 90.0, 7.0, 30.0, 99.0, 1.0, None, 3), ("amber", 100.0, 3.0, 26.0, 84.0, 1.0, "SUSCEPTIBLE", 1),
        ("green", 110.0, 3.0, 20.0, 95.0, 1.0, "RESISTANT", 3), ("unknown", None, None, None, None, None, None, 2),
    ]
    out = {r["id"]: r for r in rules.RAG_RULES.evaluate(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["colour"] for k, r in out.items()} == {"none": "AMBER", "red": "RED", "amber": "AMBER", "green": "GREEN", "unknown": "GREEN"}
    assert out["none"]["reason"].startswith("No field data yet")
    assert out["red"]["reason"] == "yield vs checks 90.0% below minimum 95%; disease score 7.0 above limit 6.0"
    assert out["amber"]["reason"].split("; ") == ["yield vs checks 100.0% below target 103%", "harvest moisture 26.0 above limit 25.0", "germination 84.0% below minimum 85%", "disease-susceptible marker", "only 1 usable trial"]


def test_trial_rules(spark):
    schema = "id string, YIELD_T_HA double, MOISTURE_PCT double, DISEASE_SCORE double, GENOMIC_BREEDING_VALUE_MEAN double, RESISTANT_MATERIAL_PCT double, official string"
    rows = [("pass", 9.5, 20.0, 4.0, 103.0, None, "PASS"), ("hold", 9.5, 20.0, 4.0, None, 50.0, "FAIL"), ("fail", 5.0, 20.0, 9.0, 103.0, 50.0, None), ("extra", 9.5, 20.0, 4.0, 103.0, 30.0, "HOLD")]
    out = {r["id"]: r for r in rules.TRIAL_RULES.evaluate(spark.createDataFrame(rows, schema), "id", "trials", "official").collect()}
    assert {k: r["computed"] for k, r in out.items()} == {"pass": "PASS", "hold": "HOLD", "fail": "FAIL", "extra": "HOLD"}
    assert out["hold"]["verdict"] == "FAIL" and out["hold"]["agrees"] is False and out["fail"]["agrees"] is None
    assert len(out["hold"]["evidence"]) == 4


def test_bayes_ceiling(spark):
    df = spark.createDataFrame(zip([1, 1, 1, 0, 0], "FFHHH"), "a int, y string")
    r = calibration.bayes_ceiling(df, ["a"], "y").first()
    assert (r["reachable"], r["total"], r["conflicting_inputs"]) == (4, 5, 1)


def test_logistic_is_monotone():
    x = np.array([[0.0], [1.0], [3.0], [4.0]])
    y = np.array([0, 0, 1, 1])
    assert calibration.logistics(x, y, np.ones((1, 4), bool))[0][0, 1] > 0


def test_counter_gaps_and_patterns(spark):
    df = spark.createDataFrame([("ID-001",), ("ID-002",), ("ID-005",)], "v string")
    assert [tuple(r) for r in identifiers.gaps(df, "v").collect()] == [(3, 4)]
    assert identifiers.learn(df, ["v"]) == {"v": r"\bID\-\d{3}\b"}
    assert spark.range(1).select(text.runs(F.lit("AAA-AA-99999"))).first()[0] == "A{3}-A{2}-9{5}"


def test_sequential_guids(spark):
    df = spark.createDataFrame([(f"00000000-0000-0000-0000-{i:012X}",) for i in range(5)], "v string")
    assert identifiers.guids(df, "v").first()["sequential"]


def test_fact_with_decimal_comma(spark):
    df = spark.createDataFrame([(2, "SYN-MZ-00001: rendimiento de 8,7 t/ha.")], "page int, text string")
    r = facts.extract(df, "page").first()
    assert (r["field"], r["value"], r["unit"], r["ids"]) == ("YIELD_T_HA", 8.7, "t/ha", {"candidate_id": ["SYN-MZ-00001"]})


def test_two_clusters_have_one_long_bar(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 0.3, (20, 2)), rng.normal(5, 0.3, (20, 2))])
    df = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(pts)], "id long, x array<double>")
    bars = topology.persistence(df, block=16).persist()
    expected = sorted(math.sqrt(d) for _, _, d in topology.tree(((pts[:, None] - pts[None]) ** 2).sum(-1)))
    assert sorted(r["length"] for r in bars.collect()) == pytest.approx(expected)
    assert topology.summary(bars, bars).select("n_edges", "groups", "wasserstein").first() == (39, 2, 0.0)


def test_no_drift_between_a_table_and_itself(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    r = drift.stability(df, df, ["x"]).first()
    assert abs(r["psi"]) < 1e-6 and r["status"] == "stable" and drift.variation(df, df, ["c"]).first()["tvd"] == 0


def test_spectrum_of_a_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) @ np.array([[1, 0, 2.0], [0, 1, -1.0]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    model = spectral.fit(df, ["a", "b", "c"], 0.999)
    assert model.k == 2 and model.certificate()["rank"] == 2
    scored = spectral.score(df, "id", model).toPandas()
    centred = x - x.mean(0)
    expected = np.einsum("ij,jk,ik->i", centred, np.linalg.pinv(np.cov(centred.T)), centred)
    assert scored.sort_values("id")["t2"].to_numpy() == pytest.approx(expected, rel=1e-6)
    assert [sum(c) for c in scored["contributions"]] == pytest.approx(scored["t2"].tolist())
    assert spectral.betainc(2, 3, 0.4) == pytest.approx(0.5248) and spectral.t2_limit(100, 5) == pytest.approx(12.326418, abs=1e-5)


def test_helmert_is_orthonormal():
    h = encoding.helmert(5)
    assert h.T @ h == pytest.approx(np.eye(4)) and h.sum(0) == pytest.approx(np.zeros(4))


def test_overrides_are_append_only_and_the_last_one_holds(spark, tmp_path):
    log = audit.OverrideLog(spark, f"file://{tmp_path}/log")
    log.record("u", "candidate", "m1", "RED", "AMBER", "FIELD_OBSERVATION")
    log.record("u", "candidate", "m1", "RED", "GREEN", "OTHER", "seen it")
    with pytest.raises(ValueError):
        log.record("u", "candidate", "m1", "RED", "GREEN", "OTHER")
    decided = spark.createDataFrame([("m1", "RED"), ("m2", "AMBER")], "id string, colour string")
    out = audit.effective(decided, log.latest(), "id", "candidate")
    assert {(r["id"], r["colour"], r["effective_colour"]) for r in out.collect()} == {("m1", "RED", "GREEN"), ("m2", "AMBER", "AMBER")}
    assert log.read().count() == 2 and not hasattr(log, "delete")


def test_answers_are_checked_against_evidence(spark):
    rows = [("Yield 7,70 of SYN-MZ-00001", "SYN-MZ-00001 7.7", "RED"), ("It is 9", "7", "RED"), ("AB-12 is fine", "none", "RED"), ("twice as good", "good", "RED"), ("It is green", "x", "RED")]
    out = verification.check(spark.createDataFrame(rows, "a string, e string, c string"), "a", "e", "c")
    assert [r["status"] for r in out.collect()] == ["verified", "unknown_number", "unknown_id", "number_word", "wrong_colour"]


def test_sql_is_read_only_and_bound_to_its_tables(spark):
    cat = serve.Catalog(spark, {"t": spark.range(9)})
    assert cat.sql("select * from t;", 5).count() == 5
    assert cat.sql("with x as (select id from t) select count(*) as n from x").first()["n"] == 9
    for bad in ("drop table t", "select 1; select 2", "select * from parquet.`/root`", "select * from secrets"):
        with pytest.raises(ValueError):
            cat.sql(bad)


def test_csv_with_odd_headers_and_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Material Guid;Trial-Id;Value\nm1;t1;1,5\nm2;t2;\n", encoding="utf-8")
    df = tabular.read_file(spark, f"file://{tmp_path}/a.csv")[""]
    assert [c for c in df.columns if not c.startswith("_")] == ["MATERIAL_GUID", "TRIAL_ID", "VALUE"] and df.count() == 2
    with pytest.raises(ValueError):
        tabular.read_file(spark, "x.bin")


def test_json_of_several_tables_and_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"one": [{"a": 1}, {"a": 2}], "two": [{"b": "x"}]}')
    got = tabular.read_file(spark, f"file://{tmp_path}/a.json")
    assert {k: v.count() for k, v in got.items()} == {"one": 2, "two": 1}
    assert tabular.from_records(spark, [{"a b": 1}, {"c": None}]).columns[:2] == ["A_B", "C"]
    assert tabular.typed(spark.createDataFrame([("NaN", "2024-02-30"), ("2", "2024-02-01")], "x string, d string"), {"x": "double", "d": "timestamp"}).where("x is null and d is null").count() == 1


def test_free_table_with_a_title_row(spark):
    html = "<table><tr><td>Title</td></tr><tr><th>Name</th><th>Value A</th><th>Share</th></tr><tr><td>x</td><td>1,5</td><td>85%</td></tr><tr><td>y</td><td>2,0</td><td>9 %</td></tr></table><script><table></script>"
    rows = documents.html_tables(spark.createDataFrame([(1, html)], "id long, html string"), "id")
    cells = documents.long_cells(rows, ["id", "table_no"]).where("value_num is not null").orderBy("row_no", "column").collect()
    assert [(r["column"], r["value_num"]) for r in cells] == [("SHARE", 85.0), ("VALUE_A", 1.5), ("SHARE", 9.0), ("VALUE_A", 2.0)]


def test_document_kinds(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1.4 x", "b.html": b"<html><p>hi</p></html>", "c.txt": b"plain", "d.png": b"\x89PNG\r\n", "e.bin": b"\x00\x01\x02"}.items():
        (tmp_path / name).write_bytes(content)
    got = documents.read(spark, f"file://{tmp_path}")
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in got.collect()} == {"a.pdf": "pdf", "b.html": "html", "c.txt": "text", "d.png": "image", "e.bin": "other"}


def test_snapshot_and_runs(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert sinks.snapshot({"t": spark.range(3)}, root) == ["t"] and spark.read.parquet(f"{root}/t").count() == 3
    first = sinks.save_run(spark, root, [("build", 1.0, 3)])
    second = sinks.save_run(spark, root, [("build", 2.0, 3)])
    assert sinks.previous_run(spark, root, second) == first and sinks.runs(spark, root, 1).select("run").distinct().count() == 1


def test_issue_names_a_few_and_counts_all(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("k"))
    r = quality.issue(df, "x", "c", "info", F.col("k"), "none_needed").first()
    assert r["count"] == 30 and len(r["affected"]) == 13 and r["affected"][-1] == "... +18 more"
    assert quality.issue(df.where("k = 'none'"), "x", "c", "info", F.col("k"), "none_needed").count() == 0


def test_turns_of_one_role_merge(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "b"), (1, 2, "s", "c"), (1, 3, "u", "d")], "c int, t int, r string, x string")
    assert [tuple(r) for r in relational.merge_turns(df, "c", "t", "r", "x").orderBy("t").collect()] == [(1, 0, "u", "a\nb"), (1, 2, "s", "c"), (1, 3, "u", "d")]


def test_stream_of_uploads_equals_one_batch(spark, tmp_path):
    from evidra.streaming import ingest

    base, up, log, ck = (f"file://{tmp_path}/{n}" for n in ("base", "up", "log", "ck"))
    spark.createDataFrame([("a", "1")], "k string, x string").write.parquet(f"{base}/batch=-1")
    spark.createDataFrame([("a", "1"), ("b", "2")], "k string, x string").write.parquet(up)
    stream = ingest.read_uploads(spark, up, "k string, x string")
    ingest.ingest(stream, base, log, "k", ck).awaitTermination()
    kept = spark.read.option("recursiveFileLookup", "true").parquet(base)
    assert sorted(map(tuple, kept.collect())) == [("a", "1"), ("b", "2")]


def test_a_new_key_comes_in_once(spark):
    base = spark.createDataFrame([("1", "a", "N1"), ("1", "b", "N1")], "k string, x string, name string")
    up = spark.createDataFrame([("2", "p", "N2"), ("2", "p", "N2"), ("3", "p", "N3"), ("3", "q", "N3"), ("4", "p", "N2"), (None, "z", None), ("1", "a", "N1"), (" 2 ", "p", "N2")], "k string, x string, name string")
    out = sorted((r["k"] or "", r["x"], r["outcome"]) for r in reconcile.classify(base, up, "k", "name").collect())
    assert out == [("", "z", "new"), (" 2 ", "p", "new"), ("1", "a", "duplicate"), ("2", "p", "duplicate"), ("2", "p", "duplicate"), ("3", "p", "new"), ("3", "q", "conflict"), ("4", "p", "natural_clash")]
    merged, log = reconcile.merge(base, [up, up], "k", "name")
    assert merged.count() == 2 + 3 + 1  # a row without a key is new each time; all else is held by then
    assert {(r["upload"], r["outcome"]): r["n"] for r in log.collect()}[1, "new"] == 1


def test_cells_of_any_type_have_the_canon_of_their_text(spark):
    df = spark.sql("select * from values (1, 2.5D, true, timestamp'2024-01-05 10:00:00'), (null, double('nan'), null, null), (-0, -0.0D, false, timestamp'1999-12-31 00:00:00') as t(a, b, c, d)")
    for c, kind in df.dtypes:
        rows = df.select(canon.canon(F.col(c), kind).alias("typed"), canon.canon(F.col(c).cast("string")).alias("text")).collect()
        assert all(r["typed"] == r["text"] for r in rows)


def test_ranks_and_running_sums_are_exact_beyond_what_range_sampling_sees(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(1 << 50)) / 7.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y")).repartition(13)
    top = calibration.roc(df, "s", "y").agg(F.max("tp"), F.max("fp"), F.count(F.lit(1))).first()
    assert tuple(top) == (333_334, 666_666, n)
    ranks = relational.labels(df, "s", "V", 7).agg(F.count_distinct("label"), F.min("label"), F.max("label")).first()
    assert tuple(ranks) == (n, "V-0000001", "V-1000000")


def test_two_writers_of_overrides_get_different_numbers(spark, tmp_path):
    logs = [audit.OverrideLog(spark, f"file://{tmp_path}/log") for _ in range(2)]
    for i in range(3):
        for log in logs:
            log.record("u", "candidate", "m1", "RED", "AMBER" if i < 2 else "GREEN", "DATA_ERROR")
    got = logs[0].read().collect()
    assert len({r["seq"] for r in got}) == 6 and logs[1].latest().first()["new_colour"] == "GREEN"


def test_fixed_decimals_follow_the_binary_value(spark):
    values = [94.85, 0.25, 0.35, 2.5, 3.5, -94.85, -0.25, 1e15, 0.05, 1.005, 2.675, 123456.785, -2.5, 0.0, 99.95, 7.0] + [i / 20 for i in range(1, 400, 2)] + [i / 200 for i in range(1, 600, 2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(text.fixed(F.col("v"), digits)).collect()]
        want = [f"{v:.{digits}f}" for v in values]
        assert [x.replace("-0", "0", 1) if float(x) == 0 else x for x in got] == [x.replace("-0", "0", 1) if float(x) == 0 else x for x in want]
    assert spark.createDataFrame([(None,)], "v double").select(text.fixed(F.col("v"), 1)).first()[0] is None


def test_sentences_of_paragraphs_and_broken_lines(spark):
    cases = {"a\nb. c\n\nd; e\ff": ["a b.", "c", "d;", "e", "f"], "x:\ny": ["x:\ny"], "\n one \n": ["one"], "": [], "1. 2!  3?": ["1.", "2!", "3?"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", facts.sentences(F.col("t")).alias("s")).collect()} == cases


def test_the_longest_synonym_with_a_number_is_the_fact(spark):
    t = "disease 3, disease score of 5; days to flowering: 60 days. plant height none but height = 12,5 cm. gbv 1 gbv 2"
    got = {r["field"]: (r["value"], r["unit"], r["matched"]) for r in facts.extract(spark.createDataFrame([(1, t)], "k int, text string"), "k").collect()}
    assert got == {"DISEASE_SCORE": (5.0, None, "disease score"), "FLOWERING_DAYS": (60.0, "d", "days to flowering"), "PLANT_HEIGHT_CM": (12.5, "cm", "height"), "GENOMIC_BREEDING_VALUE": (1.0, None, "gbv")}


def test_a_failed_rebuild_leaves_the_version_before(spark, tmp_path):
    store = sinks.Versions(spark, f"file://{tmp_path}/store")
    assert store.current() == {}
    store.rebuild(lambda now: {"t": spark.range(3)})
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    for bad in (lambda now: {"a": now["t"], "t": broken}, lambda now: 1 / 0):
        with pytest.raises(Exception):
            store.rebuild(bad)
        assert sorted(store.current()) == ["t"] and store.current()["t"].count() == 3
    store.rebuild(lambda now: {"t": now["t"].union(now["t"])})
    assert store.current()["t"].count() == 6


def test_changed_inputs(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string")
    assert sorted(r["path"] for r in drift.inputs_changed(was, now).collect()) == ["b", "c"]


def test_quantiles_of_groups_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 5000), (None, 777)) for v in rng.integers(0, 900, n)] + [("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in relational.quantiles(df, ["g"], "v", at).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, found in got.items():
        assert found == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], at).tolist())
    assert relational.quantiles(df.limit(0), [], "v", at).count() == 0


def test_tables_of_office_files_and_rejected_documents(spark, tmp_path):
    import zipfile

    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    word = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl>' + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("TRAIT", "VALUE"), ("A &amp; B", "1,5"))) + "</w:tbl></w:body></w:document>"
    slide = lambda t: f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:sld>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", word)
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", "<p/>")
        for i in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{i}.xml", slide(f"s{i}"))
    docs = documents.read(spark, f"file://{tmp_path}")
    got = {(r["path"][-6:], r["page"], r["table_no"], r["row_no"]): r["cells"] for r in documents.office_tables(docs).collect()}
    assert got == {("a.docx", 1, 0, 0): ["TRAIT", "VALUE"], ("a.docx", 1, 0, 1): ["A & B", "1,5"], ("b.pptx", 1, 0, 0): ["s1"], ("b.pptx", 2, 0, 0): ["s2"], ("b.pptx", 3, 0, 0): ["s10"]}
    judged = docs.select("path", F.lit(7).alias("n_words"), F.lit(0.12345).alias("probability"), F.when(F.col("kind") == "docx", "IRRELEVANT").otherwise("RELEVANT").alias("decision"))
    stub = documents.rejections(docs, judged).collect()
    assert len(stub) == 1 and stub[0]["kind"] == "docx" and len(stub[0]["sha256"]) == 64 and stub[0]["reason"] == "relevance 0.123 is at or below the limit"
