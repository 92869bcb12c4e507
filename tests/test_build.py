"""Tables that are kept up to date: what is built, what is read, and that the outcome is that of building everything."""

import pytest
from pyspark.sql import functions as F

from evidra.plans import build
from evidra.plans.canonical import Drop

from .same import assert_same


def sources(x):
    return {"bridge": x.bridge, "observations": x.observations, "operations": x.recorded, "master": x.master, "recommendations": x.recommendations, "genomics": x.genomics, "summary": x.summary}


def test_an_upload_rebuilds_only_what_it_reaches(spark, data, tmp_path):
    x = Drop(spark, data)
    store = build.Build(spark, f"file://{tmp_path}/a", build.CANONICAL, ("recommendations",))
    first = store.update(sources(x))
    assert set(first.built) == set(store.tables) and not first.kept
    before = store.current()
    files = {n: sorted(df.inputFiles()) for n, df in before.items()}
    again = store.update({"genomics": x.genomics.orderBy(F.rand())})
    assert not again.built and {n: sorted(df.inputFiles()) for n, df in store.current().items()} == files
    fresh = x.recommendations.where("MATERIAL_GUID % 3 <> 1")
    seen = []
    spied = {n: build.Table(t.inputs, lambda *a, n=n, t=t: seen.append((n, {f for df in a for f in df.inputFiles()})) or t.make(*a), t.version) for n, t in build.CANONICAL.items()}
    store = build.Build(spark, f"file://{tmp_path}/a", spied, ("recommendations",))
    done = store.update({"recommendations": fresh})
    assert set(done.built) == {"materials", "candidates", "long_view", "profile_recommendations"}
    read = set().union(*[f for _, f in seen])
    assert not any(f in read for n in ("observations", "genomics", "operations", "linked_operations", "trials") for f in files[n])
    other = build.Build(spark, f"file://{tmp_path}/b", build.CANONICAL, ("recommendations",))
    other.update(sources(x) | {"recommendations": fresh})
    one, two = store.current(), other.current()
    assert one.keys() == two.keys()
    for n in build.CANONICAL:
        assert_same(one[n].toPandas(), two[n].toPandas())


def test_a_failed_update_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    fails = []

    def doubled(t):
        if fails:
            raise RuntimeError("broken")
        return t.select((F.col("a") * 2).alias("b"))

    store = build.Build(spark, f"file://{tmp_path}/s", {"twice": build.Table(("t",), doubled), "never": build.Table(("t", "absent"), lambda t, u: t)})
    assert store.current() == {} and store.update({"t": df}).built == ["twice"]
    fails.append(1)
    with pytest.raises(RuntimeError):
        store.update({"t": df.unionAll(df)})
    assert sorted(r[0] for r in store.current()["twice"].collect()) == [2, 4] and store.current()["t"].count() == 2
    fails.clear()
    assert store.update({"t": df.unionAll(df)}).built == ["twice"] and store.current()["twice"].count() == 4
    newer = build.Build(spark, f"file://{tmp_path}/s", {"twice": build.Table(("t",), doubled, "2")})
    assert newer.update({}).built == ["twice"] and newer.update({}).kept == ["twice"]


def test_from_a_directory_to_a_served_model(spark, data, tmp_path):
    """The sources as CSV files with the headers that they are recognised by; a second file of one source adds to it."""
    x = Drop(spark, data)
    drop = tmp_path / "drop"

    def save(name, df, columns):
        df = df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        (drop / name).parent.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_csv(drop / name, index=False, sep=";")

    from evidra.operators.detect import SIGNATURES

    plots = x.observations.withColumn("TRAIT_GUID", F.concat(F.lit("t-"), "TRAIT_CODE")).drop("TRAIT_CODE")
    extra = ["TRIAL_ENTRY_RELATIONSHIP_GUID", "TRAIT_GUID", "NUMBER_VALUE"]
    plots = plots.withColumn("OBSERVATION_ID", F.monotonically_increasing_id())
    save("plots a.csv", plots.where("NUMBER_VALUE > 20"), [*SIGNATURES["observations"][0], *extra])
    save("plots b.csv", plots.where("NUMBER_VALUE <= 21"), [*SIGNATURES["observations"][0], *extra])
    codes = spark.createDataFrame([(f"t-{c}", c) for c in build.TRAITS], "TRAIT_GUID string, TRAIT_CODE string")
    save("traits.csv", codes, SIGNATURES["trait_dictionary"][0])
    save("bridge.csv", x.bridge, SIGNATURES["trial_germplasm_bridge"][0])
    save("ops.csv", x.recorded, SIGNATURES["field_operations"][0])
    save("master.csv", x.master, SIGNATURES["germplasm"][0])
    save("candidates.csv", x.recommendations, SIGNATURES["candidate_recommendations"][0])
    (drop / "notes.csv").write_text("some;other\n1;2\n")
    store, outcome = build.from_directory(spark, f"file://{drop}", f"file://{tmp_path}/store")
    assert {"materials", "trials", "candidates", "trial_material"} <= set(outcome.built) and "long_view" not in outcome.built  # no summary of trials came
    tables = store.current()
    numbers = ["TRIAL_GUID", "MATERIAL_GUID", "YIELD_T_HA", "MOISTURE_PCT", "DISEASE_SCORE", "CHECK_YIELD_T_HA"]
    got, want = (df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in numbers], "role", "used").toPandas() for df in (tables["trial_material"], x.trial_material()))
    assert_same(got, want)
    assert tables["materials"].groupBy("role").count().collect() and tables["materials"].count() == x.materials().count()
    sql = build.catalog(store)
    assert sql.sql("select count(*) as n from trials").first()["n"] == x.trials().count()
    assert not [t for t in spark.catalog.listTables() if t.name in tables]
    with pytest.raises(ValueError):
        sql.sql("select * from elsewhere")
    assert build.from_directory(spark, f"file://{drop}", f"file://{tmp_path}/store")[1].built == []
