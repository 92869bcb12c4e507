"""What showed only on larger tables or on other partitions of them."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidra import session
from evidra.functions import canon
from evidra.operators import calibration, facts, neighbours, relational, relevance, rules, search, spectral, topology
from evidra.plans import canonical


def test_spectra_of_partitions_without_rows(spark):
    rows = spark.range(0, 500, 1, 4).select(F.col("id").alias("k"), F.array(F.sin("id"), F.cos("id"), (F.col("id") % 7).cast("double")).alias("x"))
    few = rows.where("k < 100")  # all in the first of four partitions
    for df in (few, few.repartition(9, F.lit(1))):
        model = spectral.fit(df, ["a", "b", "c"])
        x = np.array([r["x"] for r in few.collect()])
        assert model.n == 100 and np.allclose(model.values, np.linalg.svd(x - x.mean(0), compute_uv=False))
        assert spectral.identities(df, "k", model).where("not passed").count() == 0


def test_lists_of_long_texts_come_in_parts():
    texts = ["abcabc", "", "ab", "a" * 90, "grüße 𝄞𝄞𝄞 мир", "the quick brown fox jumps over the lazy dog and the cat " * 3, "abc", "xyz abc"]
    want = {}
    for no, t in enumerate(texts):
        for g in search.trigrams(t):
            want.setdefault((g, no // 4), set()).add(no % 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["no", "folded"])
    got = {}
    for part in search._lists(4, 40)(iter([batch.slice(0, 5), batch.slice(5)])):
        for row in part.to_pylist():
            assert len(row["places"]) == len(set(row["places"]))
            got.setdefault((row["gram"], row["block"]), set()).update(row["places"])
    assert got == want
    assert list(search._lists(4, 40)(iter([]))) == []


def test_an_index_makes_no_row_for_each_text_and_trigram(spark, tmp_path):
    index = search.TextIndex(spark, f"file://{tmp_path}/i")
    plans = []
    whole = index._sorted
    index._sorted = lambda lists: plans.append(lists._jdf.queryExecution().executedPlan().toString()) or whole(lists)
    index.add(spark.range(30).select(F.lit("k").alias("kind"), "id", F.lit("f").alias("field"), F.format_string("the same words %d", "id").alias("text")))
    assert len(plans) == 1 and "Generate" not in plans[0] and "MapInArrow" in plans[0]
    assert index.search("same words 7").count() == 1


def test_neighbours_in_bounded_memory():
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(3000, 2)).round(1), rng.normal(size=(9000, 2)).round(1)  # many ties
    ids, qid = rng.permutation(9000), np.arange(3000)
    seen, whole = [], neighbours._distances
    neighbours._distances = lambda a, b: seen.append(len(a) * len(b)) or whole(a, b)
    try:
        got_q, d, i = neighbours.nearest(qid, q, iter([(ids[:5000], p[:5000]), (ids[5000:], p[5000:])]), 5, True)
    finally:
        neighbours._distances = whole
    assert max(seen) <= neighbours.LEAF * neighbours.AT_ONCE and sum(seen) < 0.7 * 3000 * 9000
    for row in range(0, 3000, 50):
        dist = whole(q[got_q[row]][None], p)[0]
        want = [j for j in np.lexsort((ids, dist)) if ids[j] != got_q[row]][:5]
        assert ids[want].tolist() == i[row].tolist() and dist[want].tolist() == d[row].tolist()
    _, d, i = neighbours.nearest(qid[:2], q[:2], iter([(ids[:3], p[:3])]), 5, False)
    assert np.isfinite(d).sum(1).tolist() == [3, 3]


def test_a_batch_is_folded_some_texts_at_a_time(spark):
    text = "grüße an alle " * 200
    batch = pa.array([text, None] * 5000, pa.string())
    tracemalloc.start()
    out = canon._decomposed.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 10_000 and out[0].as_py() == canon.fold_text(text) and out.null_count == 5000
    assert peak < 0.2 * batch.nbytes  # Arrow's own buffers aside
    df = spark.createDataFrame([(1, "Grüße"), (2, None), (3, "ab"), (4, "ﬁne  Ế")], "id int, t string").repartition(3)
    assert {r[0]: r[1] for r in df.select("id", canon.fold(F.col("t"))).collect()} == {1: "gruße", 2: None, 3: "ab", 4: "fine e"}


def test_a_summary_extracts_facts_once(spark):
    docs = spark.createDataFrame([(1, "SYN-MZ-00009 and SYN-MZ-00002.\n\nSYN-MZ-00009: yield is 4 t/ha."), (2, "Yield was 3. Moisture 12 %."), (3, "nothing")], "id int, text string")
    out = facts.summary(facts.extract(docs, "id"), "id", 1)
    assert {r["id"]: (r["entities"], r["n_facts"], r["fields"]) for r in out.collect()} == {1: (["SYN-MZ-00002"], 1, ["YIELD_T_HA"]), 2: ([], 2, ["MOISTURE_PCT", "YIELD_T_HA"])}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_areas_need_one_sort_and_no_table(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(s), int(y)) for g, s, y in zip(rng.integers(0, 3, 600), rng.integers(0, 90, 600) / 7, rng.integers(0, 2, 600))]
    rows += [(None, 1.0, 1), (None, 2.0, 0), (7, 1.0, 1), (0, None, 1), (0, 1.0, None)]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # groups go over batches and ranges
    try:
        for group in (F.col("g"), F.struct("g")):
            df = spark.createDataFrame(rows, "g int, s double, y int").select(group.alias("g"), "s", "y")
            got = {r["g"] if not isinstance(r["g"], tuple) else r["g"][0]: r for r in calibration.auc_by(df, "g", "s", "y").collect()}
            assert set(got) == {None, 0, 1, 2, 7} and got[7]["auc"] is None
            for g in (None, 0, 1, 2):
                up, down = ([s for h, s, y in rows if h == g and s is not None and y == label] for label in (1, 0))
                area = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
                assert (got[g]["p"], got[g]["n"]) == (len(up), len(down)) and abs(got[g]["auc"] - area) < 1e-12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert set(os.listdir(root)) == before  # nothing was written on the way


def test_findings_read_the_lines_once(spark, data, capsys):
    canonical.QUERIES["canonical_findings"](spark, data).explain()
    assert "FileScan parquet [l_" not in capsys.readouterr().out  # what they share is written before


def test_blocks_of_a_barcode_meet_in_teams(spark, monkeypatch):
    monkeypatch.setattr(topology, "TASK_EDGES", 50)
    x = np.random.default_rng(8).normal(size=(320, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    got = sorted(r["length"] for r in topology.persistence(df, block=10).collect())
    assert np.allclose(got, np.sqrt(sorted(d for _, _, d in topology.tree(((x[:, None] - x[None]) ** 2).sum(-1)))))
    (edges,) = [f for f in set(os.listdir(root)) - before if f.startswith("edges-")]
    assert spark.read.parquet(f"file://{root}/{edges}").count() < 5000  # each pair of blocks by itself leaves about 9,400


def test_references_are_counted_without_a_join(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (5,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "p long")
    none, nothing = child.where("k > 99"), parent.where("p > 99")
    got = [tuple(relational.references(a, "k", b, "p", "r").first()) for a, b in ((child, parent), (child, nothing), (none, parent), (none, nothing))]
    assert got == [("r", 4, 3, 0.75), ("r", 4, 0, 0.0), ("r", 0, 0, None), ("r", 0, 0, None)]
    plan = relational.references(child, "k", parent, "p", "r")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_plots_meet_their_entries_in_partitions_of_bounded_size(spark, data, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    sizes = lambda df: sorted(tuple(r) for r in df.select("TRIAL_GUID", "MATERIAL_GUID", "role", "n_reps", "used", F.round("YIELD_T_HA", 6)).collect())
    few = canonical.Drop(spark, data).trial_material()
    assert "RepartitionByExpression" not in plan(few)  # few rows are left to Spark
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(session, "ROWS", n // 20)
    many = canonical.Drop(spark, data).trial_material()
    assert f", {-(-n // (n // 20))}" in "".join(line for line in plan(many).splitlines() if "RepartitionByExpression" in line)
    assert sizes(many) == sizes(few)
    # a trial is a row already, so that no row is copied for each count
    assert "Expand" not in plan(canonical.Drop(spark, data).candidates())


def test_known_ids_travel_to_the_texts(spark, monkeypatch):
    texts = ["see syn-mz-00042 now", "--Syn-MZ-00042", "SYN-MZ-00042-b", "xSYN-MZ-00042", "_AB_12_", "ab_12", "", None, "ß ab_1 straße ab_12", "(SYN-MZ-00042)", "ıd ab-_"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    examples = spark.createDataFrame([(1, "the yield of maize", 1), (2, "a hotel bill", 0)], "example int, text string, label int")
    known = spark.createDataFrame([("SYN-MZ-00042",), ("AB_12",), ("AB_12_",), ("AB-_",), (None,)], "id string")
    many = known.unionByName(spark.range(30).select(F.format_string("ID%d", "id").alias("id")))
    assess = lambda ids: relevance.assess(docs, "i", "t", examples, {"yield": 1.0}, ids)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(assess(known))
    assert [r[0] for r in got if "names an id that is known" in r[-1]] == [0, 1, 4, 5, 8, 9, 10] and rows(assess(many)) == got
    plan = assess(known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no row for each id of a text
    monkeypatch.setattr(relevance, "KNOWN_IDS", 3)
    assert "Join" in assess(known)._jdf.queryExecution().optimizedPlan().toString() and rows(assess(known)) == got


def test_ngrams_of_new_tokens_are_looked_up_at_once(monkeypatch):
    reference = relevance.Reference(["the yield of maize / 12 %", "the hotel bill", "поле зерно 今日は", "", "𝄞𝄞 maize maize"])
    tokens = relevance.tokens_of("the maized hotels 99 % поле 今日 z ẑ 𝄞 bill the the")
    want = sorted(reference.index[g] for t in tokens for g in relevance.grams_of(t) if g in reference.index)
    assert reference.packed is not None and sorted(reference._met(tokens)) == want and len(want) > 20
    found = reference._found(tokens)
    whole = reference.cosines(tokens)
    monkeypatch.setattr(relevance, "TOKENS_AT_ONCE", 2)
    monkeypatch.setattr(relevance, "KNOWN_TOKENS", 3)
    assert reference.cosines(tokens).tolist() == whole.tolist() and len(reference.known) <= 6
    reference.packed = None  # as with a reference of too many characters
    plain = reference._found(tokens)
    ends = np.cumsum(plain[1])[:-1]
    assert plain[1].tolist() == found[1].tolist() and [sorted(x) for x in np.split(plain[0], ends)] == [sorted(x) for x in np.split(found[0], ends)]
    assert relevance.Reference([]).cosines(tokens).tolist() == [] and relevance.Reference([""]).cosines(tokens).tolist() == [0.0]


def test_neighbours_by_cells_equal_all_distances(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 150)  # many cells, so that queries cross their bounds
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=3000).round(1), rng.integers(0, 4, 3000), rng.normal(size=3000)])
    x[:400] = x[0]  # one place of many rows
    x[400:900, 2] = 0.0
    x[2990:] += 50  # far from everything, in a place each
    rows = spark.createDataFrame([(int(i), int(i) % 3, *map(float, r)) for i, r in zip(rng.permutation(3000), x)], "id long, label long, a double, b double, c double").repartition(7)
    table = {r["id"]: (r["label"], np.array(r[2:])) for r in rows.collect()}
    ids = np.array(sorted(table))
    points = np.array([table[i][1] for i in ids])
    cells = neighbours.Cells.cut(["a", "b", "c"], points, 20)
    assert cells.n == 20 and np.bincount(cells.of(points)).min() > 0 and neighbours.Cells.cut(["a"], np.ones((9, 1)), 5).n == 1
    out = neighbours.near_places(rows, rows.where("id % 2 = 0").select("a", "b", "c"), ["a", "b", "c"], 6).collect()
    assert sorted(tuple(r)[:3] for r in out) == sorted({tuple(map(float, table[i][1])) for i in ids if i % 2 == 0})
    for r in out:
        d = neighbours._distances(np.array([tuple(r)[:3]]), points)[0]
        want = np.lexsort((ids, d))[:6]
        assert [(n["distance2"], n["id"], n["label"]) for n in r["near"]] == [(d[j], ids[j], table[ids[j]][0]) for j in want]
    few = neighbours.near_places(rows.where("id < 3"), rows.where("id < 2").select("a", "b", "c"), ["a", "b", "c"], 6).collect()
    assert {len(r["near"]) for r in few} == {3} and neighbours.near_places(rows.limit(0), rows.limit(0).select("a", "b", "c"), ["a", "b", "c"], 6).count() == 0


def test_records_are_computed_once_for_their_diagnosis(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rng = np.random.default_rng(9)
    facts = [(i, str(rng.choice(["PASS", "FAIL", "HOLD"])), float(rng.normal()), float(rng.integers(3))) for i in range(300)]
    df = spark.createDataFrame(facts, "id long, official string, a double, b double").mapInPandas(counted, "id long, official string, a double, b double")
    criteria = rules.TrialRules([rules.Threshold("one", "a", ">=", 0.0, 1.0, "high", "low"), rules.Threshold("two", "b", "<=", 1.0, 1.0, "few", "many")], weighted_cut=0.2, cut=0.3, mode="severity")
    got = {r["id"]: r for r in rules.diagnose(df, criteria, "id", "official").collect()}
    assert read.value == 300
    x = np.array([r[2:] for r in facts])
    z = (x - x.mean(0)) / x.std(0)
    assert len(got) > 100
    for i, r in got.items():
        d = ((z - z[i]) ** 2).sum(1)
        d[i] = np.inf
        near = [facts[j][1] for j in np.lexsort((np.arange(300), d.round(9)))[:5]]
        assert (r["like_engine"], r["like_official"]) == (near.count(r["computed"]), near.count(r["official"])) and r["official"] == facts[i][1] != r["computed"]
