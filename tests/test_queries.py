import pytest

from evidra.plans.oracles import ORACLES
from evidra.plans.queries import QUERIES

from .same import assert_same


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, data, name):
    assert_same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df())


def test_mismatch_causes_name_every_mismatch_that_was_asked_for(spark, data):
    from evidra.operators import rules
    from evidra.plans import queries

    got = {r["cause"]: r["n"] for r in QUERIES["rules_mismatch_causes"](spark, data).collect()}
    df = queries.order_facts(spark, data).select("o_orderkey", "official", queries.replace(queries.ORDER_RULES, mode="severity").verdict().alias("computed"))
    assert sum(got.values()) == df.where("o_orderkey % 100 = 0 and official <> computed").count() > 0
    assert set(got) <= {"WEIGHTING", "BOUNDARY", "LABEL_CONFLICT", "MISSING_FACTOR"} and rules.diagnose is not None


def test_mismatch_causes_cover_every_mismatch(spark, data):
    from evidra.plans import queries

    rows = QUERIES["rules_mismatch_causes"](spark, data).collect()
    df = queries.order_facts(spark, data).withColumn("computed", queries.replace(queries.ORDER_RULES, mode="severity").verdict())
    assert sum(r["n_all"] for r in rows) == df.where("official <> computed").count() > 10 * sum(r["n"] for r in rows)


def test_contributions_add_up_and_the_residual_is_what_the_components_leave(spark, data):
    rows = QUERIES["spectral_contributions"](spark, data).collect()
    assert all(r["adds_up"] and r["t2"] >= 0 and r["q"] >= 0 for r in rows) and len({r["o_orderkey"] for r in rows}) == len(rows)
    # the mean of t2 over all rows is (n - 1) k / n
    n, t2 = len(rows), sum(r["t2"] for r in rows)
    assert t2 / (n - 1) == pytest.approx(round(t2 / (n - 1)), abs=1e-3)


def test_cross_validated_cuts(spark, data):
    rows = QUERIES["calibrate_cut_cv"](spark, data).collect()
    assert len(rows) == 250 and all(0.5 < r["accuracy"] <= 1 and r["cut"] >= 0 for r in rows)


def test_out_of_fold_probabilities(spark, data):
    rows = QUERIES["calibrate_out_of_fold"](spark, data).collect()
    assert len({r["o_orderkey"] for r in rows}) == len(rows) > 0 and all(0 <= r["p_fail"] <= 1 for r in rows)


def test_numbers_of_turns_against_plain_python(spark, data):
    import re

    turns = {(r["conv_id"], r["turn"]): (r["role"], r["text"] or "") for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    plain = lambda t: {(m.rstrip("0").rstrip(".") if "." in m else m) for m in (x.replace(",", ".") for x in re.findall(r"\d+(?:[.,]\d+)?", re.sub(r"(?i)\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b", " ", t)))}
    for r in QUERIES["verify_turn_numbers"](spark, data).collect():
        answer, evidence = turns[r["conv_id"], r["turn"]], turns[r["conv_id"], r["turn"] - 1]
        unknown = plain(answer[1]) - plain(evidence[1])
        assert answer[0] == "assistant" and set(r["unknown_numbers"].split(",")) - {""} == unknown
        assert (r["status"] == "unknown_number") == bool(unknown) or r["status"] == "unknown_id"


def test_relevance_gate_judges_every_document(spark, data):
    rows = QUERIES["text_relevance_gate"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["probability"] <= 1 and r["decision"] in ("RELEVANT", "UNCERTAIN", "IRRELEVANT")
        if r["n_words"] < 5:
            assert r["decision"] == "UNCERTAIN"


def test_barcode_equals_a_spanning_tree_of_all_distances(spark, data):
    import numpy as np

    x = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()], float)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    inside, best, deaths = np.zeros(len(x), bool), d[0].copy(), []
    inside[0] = True
    for _ in range(len(x) - 1):  # Prim
        j = int(np.where(inside, np.inf, best).argmin())
        deaths.append(best[j])
        inside[j], best = True, np.minimum(best, d[j])
    got = sorted(r["length"] for r in QUERIES["topology_barcode"](spark, data).collect())
    assert got == pytest.approx(sorted(deaths), abs=2e-6)


def test_margins_are_certified(spark, data):
    rows = QUERIES["calibrate_margins"](spark, data).collect()
    assert len(rows) == 6 and all(r["certified"] and 0.4 <= r["accuracy"] <= 1 for r in rows) and [r["fold"] for r in rows if r["repeat"] is None] == [None]


def test_overtraining_is_the_difference_of_two_areas(spark, data):
    r = QUERIES["calibrate_overtraining"](spark, data).first()
    assert 0.4 < r["test_auc"] <= 1 and r["gap"] == pytest.approx(r["train_auc"] - r["test_auc"], abs=2e-6)


def test_leave_one_out_judges_every_item(spark, data):
    rows = QUERIES["text_leave_one_out"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/benchmark.parquet").count() and all(0 < r["probability"] < 1 for r in rows)
