"""Models of folds, cuts and areas against NumPy over collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra import session
from evidra.operators import calibration, topology


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(100, 20, 600), rng.normal(0, 1, 600), rng.exponential(3, 600)])
    y = (rng.random(600) < 1 / (1 + np.exp(-((x[:, 0] - 100) / 20 + x[:, 1] - 0.5)))).astype(int)
    data = [(int(i), *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    data += [(1000, None, 1.0, 1.0, 1), (1001, 1.0, 1.0, 1.0, None), (1002, 100.0, 0.0, 1.0, 1), (1002, 100.0, 0.0, 1.0, 1)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int").repartition(5)


def newton(x, y, l2=1.0):
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z, w, ridge = np.column_stack([np.ones(len(x)), (x - mean) / sd]), np.zeros(x.shape[1] + 1), np.diag([0.0, *[l2] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return lambda v: 1 / (1 + np.exp(-(w[0] + ((v - mean) / sd) @ w[1:])))


def area(y, s):
    p, n = s[y == 1], s[y != 1]
    return np.mean((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None]))


def test_out_of_fold_probabilities_and_the_overtraining_gap(spark, rows):
    k, repeats = 4, 2
    kept = rows.where("a is not null and y is not null")
    fold = [calibration._fold(3 + r, "id", k).alias(f"f{r}") for r in range(repeats)]
    pdf = kept.select("*", *fold).toPandas().sort_values("id").reset_index(drop=True)
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    mean, train, test = np.zeros(len(pdf)), [], []
    for r in range(repeats):
        for f in range(k):
            out = (pdf[f"f{r}"] == f).to_numpy()
            model = newton(x[~out], y[~out])
            mean[out] += model(x[out]) / repeats
            train.append(area(y[~out], model(x[~out])))
            test.append(area(y[out], model(x[out])))
    got = calibration.out_of_fold(rows, "id", ["a", "b", "c"], "y", k, repeats, seed=3).toPandas().sort_values("id")
    assert got["p_fail"].to_numpy() == pytest.approx(mean, abs=1e-8)
    gap = calibration.overtraining(rows, "id", ["a", "b", "c"], "y", k, repeats, seed=3).first()
    assert (gap["train_auc"], gap["test_auc"], gap["test_sd"], gap["gap"]) == pytest.approx((np.mean(train), np.mean(test), np.std(test), np.mean(train) - np.mean(test)), abs=1e-9)


def test_labels_of_one_kind_and_no_rows(spark, rows):
    got = calibration.out_of_fold(rows.where("y = 1"), "id", ["a", "b"], "y", 3, 2).agg(F.min("p_fail")).first()[0]
    assert got > 0.999
    assert calibration.out_of_fold(rows.limit(0), "id", ["a", "b"], "y", 3, 2).count() == 0


def test_areas_by_group(spark):
    rng = np.random.default_rng(0)
    data = [(int(g), float(rng.integers(0, 9)), int(rng.random() < 0.4)) for g in rng.integers(0, 6, 800)] + [(9, 1.0, 1)]
    got = {r["g"]: r for r in calibration.auc_by(spark.createDataFrame(data, "g int, s double, y int"), "g", "s", "y").collect()}
    for g in range(6):
        s, y = (np.array([r[i] for r in data if r[0] == g]) for i in (1, 2))
        assert got[g]["auc"] == pytest.approx(area(y, s)) and got[g]["p"] == y.sum()
    assert got[9]["auc"] is None


def test_cuts_of_all_folds_equal_numpy(spark):
    rng = np.random.default_rng(8)
    data = [(round(float(v), 1), int(v + rng.normal() > 2)) for v in rng.exponential(2, 300)] + [(None, 1), (1.0, None)]
    k, repeats = 4, 5
    df = spark.createDataFrame(data, "s double, y int")
    grid = calibration.fold_counts(df, "s", "y", k, repeats, 2).select("o.*", *[f"{c}{f}" for c in "pn" for f in range(k)]).toPandas().sort_values(["r", "s"])
    assert grid[[c for c in grid.columns if c[0] in "pn"]].to_numpy().sum() == 300 * repeats
    got = {(r["repeat"], r["fold"]): r for r in calibration.cross_validate(df, "s", "y", k, repeats, 2).collect()}
    assert len(got) == k * repeats
    for r in range(repeats):
        g = grid[grid["r"] == r]
        s, p, n = g["s"].to_numpy(), g[[f"p{f}" for f in range(k)]].to_numpy(), g[[f"n{f}" for f in range(k)]].to_numpy()
        middles = (s[1:] + s[:-1]) / 2
        for f in range(k):
            pt, nt = p.sum(1) - p[:, f], n.sum(1) - n[:, f]
            hits = np.array([pt[s > m].sum() + nt[s <= m].sum() for m in middles])
            cut = np.median(middles[hits == hits.max()])
            right = p[s > cut, f].sum() + n[s <= cut, f].sum()
            assert got[r, f]["cut"] == pytest.approx(cut) and got[r, f]["accuracy"] == pytest.approx(right / (p[:, f].sum() + n[:, f].sum()))
    one = calibration.cut_summary(calibration.cross_validate(df, "s", "y", k, repeats, 2)).first()
    assert one["cut_p05"] <= one["cut_median"] <= one["cut_p95"] and 0.5 < one["accuracy"] <= 1
    lone = calibration.cross_validate(spark.createDataFrame([(2.0, 1), (2.0, 0), (2.0, 0)], "s double, y int"), "s", "y", 2, 1).collect()
    assert [r["cut"] for r in lone] == [2.0, 2.0] and calibration.cross_validate(df.limit(0), "s", "y").count() == 0


def test_values_of_the_row_before(spark):
    df = spark.range(0, 500).select((F.col("id") * 1_000_003 % 7919).alias("n")).distinct()
    got = sorted((r["n"], r["_was_n"]) for r in session.previous(df, "n", ["n"]).collect())
    want = sorted(r["n"] for r in df.collect())
    assert got == list(zip(want, [None, *want[:-1]]))


def prim(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inside, best, out = np.zeros(len(x), bool), d[0].copy(), []
    inside[0] = True
    for _ in range(len(x) - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        out.append(float(best[j]))
        inside[j], best = True, np.minimum(best, d[j])
    return sorted(out)


@pytest.mark.parametrize("last", [10**6, 0])
def test_spanning_trees_by_cells_and_rounds(spark, last):
    """Clusters of different sizes, copies, a line of points, and points far out; without a last task all edges come from rounds."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal((0, 0), 1, (150, 2)), rng.normal((40, 0), 0.2, (120, 2)), np.c_[np.arange(60), np.full(60, 90.0)], [[500.0, 500.0]], np.repeat([[3.0, 3.0]], 40, 0)])
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")
    got = sorted(r["length"] for r in topology.persistence(df, block=25, pivots=12, last=last).collect())
    assert got == pytest.approx(prim(x), abs=1e-9)
    cells, partners = topology._cells(df, 12, 25)
    assert partners.where("not alone").count() < 12 * 12  # some cells need no trees with each other


def test_barcodes_of_few_points(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0]), (3, [3.0])], "id long, x array<double>")
    assert sorted(r["length"] for r in topology.persistence(df).collect()) == [0.0, 3.0]
    assert topology.persistence(df.limit(1)).count() == 0 and topology.persistence(df.limit(0)).count() == 0


def test_betti_curve_and_distance_of_barcodes(spark):
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 30, 90) / 4)[::-1], np.sort(rng.exponential(4, 40))[::-1]
    frames = [spark.createDataFrame([(float(v),) for v in x], "length double") for x in (a, b)]
    want = np.abs(a - np.r_[b, np.zeros(50)]).mean()
    assert topology.wasserstein(*frames) == pytest.approx(want) == topology.wasserstein(*frames[::-1]) and topology.wasserstein(frames[0], frames[0]) == 0
    assert [(r["radius"], r["components"]) for r in topology.betti(frames[0], [0.0, 2.0, 100.0]).collect()] == [(t, int((a > t).sum()) + 1) for t in (0.0, 2.0, 100.0)]


def primal(x, y, w, b, c):
    return w @ w / 2 + c * np.maximum(1 - np.where(y == 1, 1, -1) * (x @ w + b), 0).sum()


def plain_margin(x, y, c, rounds=300, wide=30.0):
    """Dual coordinate ascent in memory, the offset as the weight of a wide constant: the objective at its weights."""
    z = np.column_stack([x, np.full(len(x), wide)]) * np.where(y == 1, 1.0, -1.0)[:, None]
    alpha, w, norm, rng = np.zeros(len(z)), np.zeros(z.shape[1]), (z * z).sum(1), np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(z)):
            step = np.clip(alpha[i] + (1 - z[i] @ w) / norm[i], 0, c) - alpha[i]
            alpha[i] += step
            w += step * z[i]
    return primal(x, y, w[:-1], w[-1] * wide, c)


def test_widest_margin_of_separable_rows(spark):
    """The separator of two clusters is known: half way between the nearest points."""
    data = [(i, float(v), float(u), int(v > 2)) for i, (v, u) in enumerate([(0, 0), (1, 0), (1, 1), (3, 0), (3, 1), (5, 2), (4, -3), (0, 4)])]
    m = calibration.fit_margins(spark.createDataFrame(data, "id int, a double, b double, y int"), "id", ["a", "b"], "y", k=2, tolerance=1e-4)
    weights, cut = m.scaled()
    assert weights[-1].tolist() == pytest.approx([1, 0], abs=1e-2) and cut[-1] == pytest.approx(2, abs=1e-2) and m.gap.max() <= 1e-4


def test_margins_of_overlapping_rows_carry_a_certificate(spark, rows):
    m = calibration.fit_margins(rows, "id", ["a", "b", "c"], "y", c=0.5, k=3, repeats=1, seed=3)
    pdf = rows.where("a is not null and y is not null").select("*", calibration._fold(3, "id", 3).alias("f")).toPandas()
    assert m.gap.max() <= 1e-3 and len(m.gap) == 4
    for i in range(4):
        part = pdf[pdf["f"] != i] if i < 3 else pdf
        x, y = part[["a", "b", "c"]].to_numpy(), part["y"].to_numpy()
        value = primal(x, y, m.weights[i], m.offset[i], 0.5)
        assert value == pytest.approx(m.objective[i], rel=1e-6)
        rng = np.random.default_rng(i)
        for size in (1e-3, 1e-2, 0.1):  # no neighbour is better by more than the gap says
            for _ in range(30):
                other = primal(x, y, m.weights[i] * (1 + size * rng.normal(size=3)), m.offset[i] + size * rng.normal(), 0.5)
                assert other >= value * (1 - m.gap[i]) - 1e-9
    cv = {(r["repeat"], r["fold"]): r for r in calibration.margin_cv(rows, "id", ["a", "b", "c"], "y", c=0.5, k=3, seed=3).collect()}
    for f in range(3):
        part = pdf[pdf["f"] == f]
        want = ((part[["a", "b", "c"]].to_numpy() @ m.weights[f] + m.offset[f] > 0) == (part["y"] == 1)).mean()
        assert cv[0, f]["accuracy"] == pytest.approx(want) and cv[0, f]["weights"][0] == pytest.approx(1)
    assert cv[None, None]["accuracy"] > 0.6


def test_margins_are_no_worse_than_dual_ascent_in_memory(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) + np.repeat([[0.0, 0.0], [1.5, 1.0]], 30, 0)
    y = np.repeat([0, 1], 30)
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, y int")
    m = calibration.fit_margins(df, "id", ["a", "b"], "y", c=1.0, k=2)
    assert m.objective[-1] <= plain_margin(x, y, 1.0) * (1 + 1e-3) and m.gap.max() <= 1e-3
    assert calibration.fit_margins(df.limit(0), "id", ["a", "b"], "y", k=2).objective.tolist() == [0.0] * 3
