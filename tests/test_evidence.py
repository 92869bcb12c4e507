"""The ledger under tampering, cited values, contexts, learned patterns, issues with texts."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidra.operators import canonical, facts, ledger, quality, verification
from evidra.plans import serve
from evidra.plans.canonical import Drop


@pytest.fixture
def kept(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    for batch in range(3):
        book.append(spark.range(700).select((F.col("id") + 1000 * batch).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") / 7).alias("v"), F.lit("x").alias("s")))
    return book


def tamper(book, batch, change):
    """Rewrites a batch's rows as one file, behind the ledger's back."""
    path = book.records().where(f"batch = {batch}").first()["path"].removeprefix("file://")
    files = glob.glob(f"{path}/*.parquet")
    rows = change(pq.read_table(path).to_pandas().sort_values("pos").reset_index(drop=True))
    schema = pq.read_schema(files[0])
    for f in glob.glob(f"{path}/*") + glob.glob(f"{path}/.*crc"):
        os.remove(f)
    import pyarrow as pa

    pq.write_table(pa.Table.from_pandas(rows, schema=schema, preserve_index=False), files[0])


def test_an_untouched_ledger_has_no_faults(spark, kept, tmp_path):
    head = kept.head()
    assert kept.verify(head).count() == 0 and kept.read().count() == 2100 and kept.records().count() == 3
    assert ledger.Ledger(spark, f"file://{tmp_path}/none").verify().count() == 0 and ledger.Ledger(spark, f"file://{tmp_path}/none").head() is None
    assert kept.append(spark.createDataFrame([], "k long, v double, s string")) == kept.head() != head and kept.verify(kept.head()).count() == 0
    assert [r["fault"] for r in kept.verify(head).collect()] == ["head"]


def test_the_first_row_that_was_changed_is_named(kept):
    def change(rows):
        rows.loc[[411, 600], "v"] = 9.0
        return rows

    tamper(kept, 1, change)
    assert [tuple(r) for r in kept.verify(kept.head()).collect()] == [(1, 411, "changed"), (1, 600, "changed"), (1, None, "root")]


def test_removed_and_added_rows_are_named(kept):
    tamper(kept, 0, lambda rows: rows.drop([3, 699]))
    tamper(kept, 2, lambda rows: rows.loc[[*range(700), 5]])
    assert [tuple(r) for r in kept.verify().collect()] == [(0, 3, "removed"), (0, 699, "removed"), (0, None, "root"), (2, 5, "added"), (2, None, "root")]


def test_a_change_with_its_hash_breaks_the_root_and_one_with_its_record_the_chain(spark, kept):
    head = kept.head()
    path = kept.records().where("batch = 1").first()["path"]
    changed = spark.read.parquet(path).withColumn("v", F.when(F.col("pos") == 8, 1.5).otherwise(F.col("v")))
    rows = changed.withColumn("hash", ledger.leaf(["k", "v", "s"])).toPandas().sort_values("pos").reset_index(drop=True)
    tamper(kept, 1, lambda _: rows)
    assert [tuple(r) for r in kept.verify(head).collect()] == [(1, None, "root")]
    old = kept.records().where("batch = 1").first()
    root = ledger.root_of(spark.read.parquet(path), 700)
    forged = (1, path, 700, root, old["previous"], ledger._record_hash(1, 700, root, old["previous"]))
    others = [tuple(r) for r in kept.records().where("batch <> 1").collect()]
    spark.createDataFrame([*others, forged], ledger.RECORD).write.json(f"{kept.path}/forged")
    book = ledger.Ledger(spark, kept.path)
    book.records = lambda: spark.read.schema(ledger.RECORD).json(f"{kept.path}/forged")
    assert [tuple(r) for r in book.verify(head).collect()] == [(2, None, "chain")]


def test_values_are_supported_at_the_decimals_printed(spark):
    answers = spark.createDataFrame([(1, "The yield was 8.7 t/ha. Moisture: 12 %. Plant height 181 cm."), (2, "Rendimiento de 8,65 t/ha; disease score 3"), (3, "yield 9 t/ha"), (4, "nothing here"), (5, None)], "id int, text string")
    evidence = spark.createDataFrame([(1, "YIELD_T_HA", 8.66), (1, "MOISTURE_PCT", 12.6), (1, "YIELD_T_HA", 2.0), (2, "YIELD_T_HA", 8.66), (2, "DISEASE_SCORE", 3.49), (2, "DISEASE_SCORE", None), (3, "YIELD_T_HA", 8.5)], "id int, field string, value_num double")
    got = {(r["id"], r["field"]): (r["stored"], r["status"]) for r in verification.cited_values(answers, "id", "text", evidence).collect()}
    assert got == {
        (1, "YIELD_T_HA"): (8.66, "supported"), (1, "MOISTURE_PCT"): (12.6, "contradicted"), (1, "PLANT_HEIGHT_CM"): (None, "unknown"),
        (2, "YIELD_T_HA"): (8.66, "contradicted"), (2, "DISEASE_SCORE"): (3.49, "supported"), (3, "YIELD_T_HA"): (8.5, "supported"),
    }


def test_a_context_takes_what_fits(spark):
    rows = [(1, "a" * 40, 5.0, False), (1, "b" * 8, 2.0, False), (1, "c" * 4, 0.1, True), (1, "d" * 400, 900.0, False), (1, "", 9.0, True), (2, "e" * 100, 1.0, True), (3, "f", None, None)]
    df = spark.createDataFrame(rows, "k int, t string, bits double, must boolean")
    got = {r["k"]: r for r in serve.context(df, "k", "t", "bits", 20, "must").collect()}
    # the required line, then 900 bits for 100 tokens, which does not fit, and what comes after it in this order
    assert got[1]["lines"] == ["c" * 4] and got[1]["n_left_out"] == 3 and got[1]["tokens_of_all"] == 113
    assert got[2]["lines"] == [] and got[2]["saved"] == 1.0 and got[3]["lines"] == ["f"] and got[3]["saved"] == 0.0


def test_learned_patterns_join_the_fixed_ones(spark):
    df = spark.createDataFrame([(f"LOT{i:04}", f"SYN-MZ-{i:05}") for i in range(40)], "lot string, m string")
    patterns = facts.id_patterns(df, {"lot_id": "lot", "candidate_id": "m"})
    assert set(patterns) == {"candidate_id", "trial_id", "guid", "lot_id"} and patterns["trial_id"] == facts.IDS["trial_id"]
    docs = spark.createDataFrame([(1, "LOT0007 was sown beside SYN-MZ-00012.")], "d int, text string")
    assert facts.extract(docs, "d", ids=patterns).first()["ids"] == {"lot_id": ["LOT0007"], "candidate_id": ["SYN-MZ-00012"]}
    assert facts.about(facts.extract(docs, "d", ids=patterns), "lot0007").count() == 1


def test_issues_say_what_they_mean(spark, data):
    x = Drop(spark, data)
    issues = canonical.issues(x.recommendations, x.trial_material(), x.trials(), x.materials(), x.operations, x.references(), x.compared())
    rows = issues.collect()
    assert {"id", "title", "category", "severity", "count", "affected", "root_cause", "evidence", "fix_status", "fix", "impact", "question"} == set(issues.columns)
    assert len(rows) == 10 and all(r["title"] and r["root_cause"] and r["fix"] and r["impact"] for r in rows)
    assert {r["fix_status"]: r["n_issues"] for r in quality.summary(issues).collect()}
    unknown = quality.explained(spark.createDataFrame([("new.kind",)], "id string")).first()
    assert unknown["title"] is None
