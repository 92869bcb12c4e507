"""How far rules can agree with labels: ceilings, ROC, severity cuts, max-margin weights and a logistic model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned, previous, running


FEW_ROWS = 1_000  #: of a value, that are dealt one by one


def bayes_ceiling(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: the most labels that any function of the features can get right, and inputs with several labels."""
    n = df.where(F.col(label).isNotNull()).groupBy(*features, label).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(*features).agg(F.max("n").alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("best"), F.lit(0)).alias("reachable"),
        F.count_if(F.col("labels") > 1).alias("conflicting_inputs"), F.try_divide(F.sum("best"), F.sum("n")).alias("ceiling"),
    )


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) from the highest score down, ties together. label is 0 or 1.

    Only distinct scores are sorted; they are counted first, and running sums go by ranges of the score, offset by the sums before.
    """
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n")
    )
    run, total = running(counts, "threshold", {"tp": "p", "fp": "n"}, descending=True)
    rate = lambda c: F.col(c) / max(total[c], 1)
    return run.select("threshold", "tp", "fp", rate("tp").alias("tpr"), rate("fp").alias("fpr"), "p", "n")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): area under the ROC by trapezoids; each tie group is one trapezoid."""
    r = roc(df, score, label)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return r.agg(F.try_divide(area, F.sum("p") * F.sum("n")).alias("auc"))


def auc_by(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, p, n, auc) for each group. Distinct scores are dealt once to sorted ranges of (group, score), so that no group has to fit in
    a task; a range tells of each of its groups the pairs inside and how many rows of either label it has, and what lies above a range
    is known from these few rows."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(group).alias("g"), F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n")
    )
    order = [F.col("g").desc(), F.col("s").desc()]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = counts.schema["g"].dataType.simpleString()
    parts = counts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_pairs, f"g {kind}, s double, p long, n long, pairs long")
    above = F.coalesce(F.sum("p").over(Window.partitionBy("g").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = parts.withColumn("pairs", F.col("pairs") + 2 * above * F.col("n")).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("p", "n", "pairs")])
    return whole.select(F.col("g").alias(group), "p", "n", F.try_divide(F.col("pairs") / 2, F.col("p") * F.col("n")).alias("auc"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (g, s, p, n) one row for each g: its first s, sums of p and n, and twice the pairs, in whole numbers: positives above each
    negative, ties by half."""
    own, p, n, pairs = None, 0, 0, 0  # the group that is open, as a row of its own

    def closed() -> pa.RecordBatch:
        rest = [pa.array([v], pa.int64()) for v in (p, n, pairs)]
        return pa.RecordBatch.from_arrays([*own, *rest], names=["g", "s", "p", "n", "pairs"])

    for batch in batches:
        groups, up, down = batch.column("g"), batch.column("p").to_numpy(), batch.column("n").to_numpy()
        at = 0
        while at < batch.num_rows:
            key, end, beyond = groups[at].as_py(), at, batch.num_rows
            while beyond - end > 1:  # a group's rows lie side by side
                middle = (end + beyond) // 2
                end, beyond = (middle, beyond) if groups[middle].as_py() == key else (end, middle)
            if own is None or own[0][0].as_py() != key:
                if own is not None:
                    yield closed()
                own, p, n, pairs = [groups.take(pa.array([at])), batch.column("s").take(pa.array([at]))], 0, 0, 0
            here, below = up[at:beyond], down[at:beyond]
            pairs += int((below * (2 * (p + np.cumsum(here)) - here)).sum())
            p, n, at = p + int(here.sum()), n + int(below.sum()), beyond
    if own is not None:
        yield closed()


def flags(df: DataFrame, thresholds: list, record: str) -> DataFrame:
    """(record, one boolean for each threshold), null without a value."""
    return df.select(record, *[t.passes().alias(t.name) for t in thresholds])


def split(values: np.ndarray, n: np.ndarray, k: int, seed: int) -> np.ndarray:
    """[value, fold]: n rows of each value dealt to k folds at random, each row to one; the same in whatever batch a value comes."""
    bits = (values + 0.0).view(np.uint64)
    out = np.zeros((len(n), k), np.int64)
    few = np.flatnonzero(n <= FEW_ROWS)
    at = np.repeat(few, n[few])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
    h = bits[at] * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    np.add.at(out, (at, (h % np.uint64(k)).astype(np.int64)), 1)
    for i in np.flatnonzero(n > FEW_ROWS):
        out[i] = np.random.default_rng([seed, int(bits[i])]).multinomial(n[i], [1 / k] * k)
    return out


def logistics(x: np.ndarray, y: np.ndarray, used: np.ndarray, l2: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset and weights, mean, deviation) of a ridge logistic regression (offset free) for each row of used, which marks its rows of x;
    all by Newton's method side by side. x is standardised by the rows that a model uses; x may also hold one table a model.

    A model whose rows are of one label gives that label (probability next to 0 or 1); one without rows gives one half.
    """
    many = np.broadcast_to(x, (len(used), *x.shape)) if x.ndim == 2 else x
    n = np.maximum(used.sum(1), 1)[:, None]
    mean = np.einsum("mn,mnd->md", used, many) / n
    sd = np.sqrt(np.maximum(np.einsum("mn,mnd->md", used, (many - mean[:, None]) ** 2) / n, 0))
    sd = np.where(sd > 0, sd, 1.0)
    z = np.concatenate([np.ones((*many.shape[:2], 1)), (many - mean[:, None]) / sd[:, None]], 2)
    w = np.zeros((len(used), z.shape[2]))
    ridge = np.diag([0.0, *[l2] * (z.shape[2] - 1)])
    ones, rows = (used * y).sum(1), used.sum(1)
    live = np.flatnonzero((ones > 0) & (ones < rows))
    w[(ones == rows) & (rows > 0), 0], w[(ones == 0) & (rows > 0), 0] = 30.0, -30.0
    for _ in range(rounds):
        if not len(live):
            break
        p = 1 / (1 + np.exp(-np.clip(np.einsum("mnd,md->mn", z[live], w[live]), -500, 500)))
        gradient = np.einsum("mnd,mn->md", z[live], (p - y) * used[live]) + w[live] @ ridge
        curvature = np.einsum("mnd,mn,mne->mde", z[live], p * (1 - p) * used[live], z[live]) + ridge + 1e-12 * np.eye(z.shape[2])
        step = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
        w[live] -= step
        live = live[np.abs(step).max(1) >= 1e-10]
    return w, mean, sd


def fold_counts(df: DataFrame, score: str, label: str, k: int, repeats: int, seed: int) -> DataFrame:
    """(o: struct<r, s>, p0.., n0..): of each repeat and distinct score the rows of either label in each fold. Rows are counted by score
    first and the counts are dealt, each label by itself, as their score and repeat say."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy((F.col(score).cast("double") + 0.0).alias("s"))
    counts = rows.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    names = [f"{c}{f}" for c in "pn" for f in range(k)]

    def deal(batches):
        for pdf in batches:
            s, p, n = (pdf[c].to_numpy() for c in ("s", "p", "n"))
            for r in range(repeats):
                dealt = [split(s, c, k, 2 * (seed * repeats + r) + label) for label, c in ((1, p), (0, n))]
                yield pd.DataFrame({"r": r, "s": s} | dict(zip(names, np.concatenate(dealt, 1).T)))

    dealt = counts.mapInPandas(deal, "r int, s double" + "".join(f", {c} long" for c in names))
    return dealt.select(F.struct("r", "s").alias("o"), *names)


def cross_validate(df: DataFrame, score: str, label: str, k: int = 5, repeats: int = 50, seed: int = 0) -> DataFrame:
    """(repeat, fold, cut, accuracy): severity cuts by repeated folds. A row is taken for label 1 above the cut; of the middles between
    neighbouring scores, the cut is the median of those that are most accurate on the other folds, and its accuracy is that on the fold.

    Every fold's hits at every middle follow from running sums over ranges of (repeat, score), in one pass for all; the median of a
    plateau is found by its rank in a second one. What is known of all repeats and folds is one row each.
    """
    spark = df.sparkSession
    folds = list(range(k))
    grid = pinned(fold_counts(df, score, label, k, repeats, seed), "cuts")
    names = [f"{c}{f}" for c in "pn" for f in folds]
    totals = {r["r"]: r for r in grid.groupBy(F.col("o.r").alias("r")).agg(*[F.sum(c).alias(c) for c in names]).collect()}
    if not totals:
        return spark.createDataFrame([], "repeat int, fold int, cut double, accuracy double")
    before, sums = [], dict.fromkeys(names, 0)
    for r in sorted(totals):
        before.append((r, *[sums[c] for c in names], *[totals[r][c] for c in names]))
        sums = {c: sums[c] + totals[r][c] for c in names}
    known = spark.createDataFrame(before, "r int" + "".join(f", {x}_{c} long" for x in ("b", "t") for c in names))
    run, _ = running(previous(grid, "o", ["o"]), "o", {f"c_{c}": c for c in names})
    run = run.where(F.col("_was_o.r") == F.col("o.r")).withColumn("r", F.col("o.r")).join(F.broadcast(known), "r")
    # up to the score before, of either label and fold
    low = {c: F.col(f"c_{c}") - F.col(c) - F.col(f"b_{c}") for c in names}
    other = lambda c, f, of: sum((of(f"{c}{g}") for g in folds if g != f), F.lit(0))
    hits = [other("n", f, low.get) + other("p", f, lambda c: F.col(f"t_{c}")) - other("p", f, low.get) for f in folds]
    middles = run.select("r", ((F.col("_was_o.s") + F.col("o.s")) / 2).alias("m"), F.posexplode(F.array(*hits)).alias("f", "hits"))
    middles = pinned(middles.select("r", "f", "m", "hits"), "middles")
    best = middles.groupBy("r", "f").agg(F.max("hits").alias("hits"))  # a row a repeat and fold
    plateau = middles.join(F.broadcast(best), ["r", "f", "hits"]).select(F.struct("r", "f", "m").alias("o"), F.lit(1).alias("one"))
    ranked, _ = running(plateau, "o", {"rank": "one"})
    widths = {(r["r"], r["f"]): r["n"] for r in plateau.groupBy("o.r", "o.f").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, start = [], 0
    for r, f in sorted(widths):
        n = widths[r, f]
        places.append((r, f, start + (n + 1) // 2, start + n // 2 + 1))
        start += n
    places = F.broadcast(spark.createDataFrame(places, "r int, f int, lower long, upper long"))
    ranked = ranked.select("o.r", "o.f", "o.m", "rank").join(places, ["r", "f"]).where("rank in (lower, upper)")
    # a single score leaves no middle: it is the cut itself
    cuts = {(r["r"], r["f"]): r["cut"] for r in ranked.groupBy("r", "f").agg(F.avg("m").alias("cut")).collect()}
    lone = None if cuts else grid.agg(F.max("o.s")).first()[0]
    rows = [(r, [cuts.get((r, f), lone) for f in folds]) for r in sorted(totals)]
    judged = grid.withColumn("r", F.col("o.r")).join(F.broadcast(spark.createDataFrame(rows, "r int, cuts array<double>")), "r")
    right = [F.sum(F.when(F.col("o.s") > F.col("cuts")[f], F.col(f"p{f}")).otherwise(F.col(f"n{f}"))) for f in folds]
    all_of = [F.sum(F.col(f"p{f}") + F.col(f"n{f}")) for f in folds]
    done = judged.groupBy("r", "cuts").agg(F.array(*[F.try_divide(a, b) for a, b in zip(right, all_of)]).alias("accuracy"))
    return done.select(F.col("r").alias("repeat"), F.posexplode(F.arrays_zip("cuts", "accuracy")).alias("fold", "x")).select(
        "repeat", "fold", F.col("x.cuts").alias("cut"), F.col("x.accuracy").alias("accuracy")
    )


def cut_summary(validated: DataFrame) -> DataFrame:
    """One row: mean accuracy and its deviation over all folds, the median cut and its 5th and 95th hundredth."""
    q = F.percentile("cut", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = validated.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_sd"), q.alias("q"))
    return out.select("accuracy", "accuracy_sd", F.col("q")[1].alias("cut_median"), F.col("q")[0].alias("cut_p05"), F.col("q")[2].alias("cut_p95"))


@dataclass
class Folds:
    """Logistic models of repeated folds, fitted to all rows: model r * k + f is fitted without fold f of repeat r."""

    record: str
    features: list[str]
    k: int
    repeats: int
    seed: int
    weights: np.ndarray  #: [model, 1 + features], of features centred and scaled by centre and scale
    centre: np.ndarray
    scale: np.ndarray
    rounds: int
    rows: DataFrame  #: what they were fitted to, as written: (features, _y, _f0, _f1, ..: the fold in each repeat)

    def fold(self, r: int) -> Column:
        return _fold(self.seed + r, self.record, self.k)

    def probabilities(self) -> Column:
        """An array with the probability that each model gives."""
        x = [F.lit(1.0), *[(F.col(f).cast("double") - float(c)) / float(s) for f, c, s in zip(self.features, self.centre, self.scale)]]
        return F.array(*[1 / (1 + F.exp(-sum((v * float(a) for v, a in zip(x[1:], w[1:])), x[0] * float(w[0])))) for w in self.weights])


def _fold(seed: int, record: str, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(record)), F.lit(k)).cast("int")


def _summed(rows: DataFrame, sums, width: int, models: int) -> np.ndarray:
    """[model, number]: what sums(batch) gives, added up. A task adds up its batches and sends one row for each model and number; of
    these there are as many in the end as the models have numbers, whatever the rows."""

    def run(batches):
        total = np.zeros((models, width))
        for pdf in batches:
            total += sums(pdf)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    out = np.zeros(models * width)
    for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(models, width)


def fit_folds(df: DataFrame, record: str, features: list[str], label: str, k: int = 5, repeats: int = 10, l2: float = 1.0, seed: int = 0, rounds: int = 50) -> Folds:
    """Newton's method over all rows with a label and all features: in each round every model's gradient and curvature are summed in
    one pass over the rows, for all folds and repeats at once; only models that still move are computed. The ridge is on weights of
    features standardised by the rows that the model is fitted to, and the offset is free. A record's fold is a hash of its id."""
    d, models = len(features), repeats * k
    x = [F.col(f).cast("double").alias(f) for f in features]
    rows = df.where(F.col(label).isNotNull()).select(record, *x, F.col(label).cast("int").alias("_y")).na.drop(subset=features)
    rows = pinned(rows.select(*features, "_y", *[_fold(seed + r, record, k).alias(f"_f{r}") for r in range(repeats)]), "folds")
    first = rows.agg(F.count(F.lit(1)), *[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    if not first[0]:
        return Folds(record, features, k, repeats, seed, np.zeros((models, d + 1)), np.zeros(d), np.ones(d), 0, rows)
    centre = np.array(first[1 : d + 1], float)
    scale = np.array([v if v > 0 else 1.0 for v in first[d + 1 :]], float)
    names = [f"_f{r}" for r in range(repeats)]

    def parts(pdf):
        z = np.column_stack([np.ones(len(pdf)), (pdf[features].to_numpy(float) - centre) / scale])
        folds = pdf[names].to_numpy()
        used = (folds[:, :, None] != np.arange(k)).reshape(len(pdf), models).astype(float)
        return z, pdf["_y"].to_numpy(float), used

    def moments(pdf):
        z, y, used = parts(pdf)
        return np.column_stack([used.sum(0), used.T @ y, used.T @ z[:, 1:], used.T @ (z[:, 1:] ** 2)])

    m = _summed(rows, moments, 2 + 2 * d, models)
    n = np.maximum(m[:, :1], 1)
    spread = np.sqrt(np.maximum(m[:, 2 + d :] / n - (m[:, 2 : 2 + d] / n) ** 2, 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    w = np.zeros((models, d + 1))
    w[(m[:, 1] == m[:, 0]) & (m[:, 0] > 0), 0], w[(m[:, 1] == 0) & (m[:, 0] > 0), 0] = 30.0, -30.0
    live, done = np.flatnonzero((m[:, 1] > 0) & (m[:, 1] < m[:, 0])), 0
    for done in range(1, rounds + 1):
        if not len(live):
            break

        def derivatives(pdf, w=w.copy(), live=live):
            z, y, used = parts(pdf)
            p = 1 / (1 + np.exp(-np.clip(z @ w[live].T, -500, 500)))
            used = used[:, live]
            gradient = ((p - y[:, None]) * used).T @ z
            curvature = (p * (1 - p) * used).T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
            return np.concatenate([gradient, curvature], 1)

        got = _summed(rows, derivatives, (d + 1) * (d + 2), len(live))
        ridge = np.zeros((len(live), d + 1))
        ridge[:, 1:] = l2 * spread[live] ** 2
        gradient = got[:, : d + 1] + ridge * w[live]
        curvature = got[:, d + 1 :].reshape(-1, d + 1, d + 1) + ridge[:, :, None] * np.eye(d + 1) + 1e-12 * np.eye(d + 1)
        step = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
        w[live] -= step
        live = live[np.abs(step).max(1) >= 1e-9]
    return Folds(record, features, k, repeats, seed, w, centre, scale, done, rows)


def logistic(rows: DataFrame, features: list[str], label: str, l2: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset and weights, mean, deviation) of logistics() for one model of all rows, whose sums a pass a step adds up."""
    d = len(features)
    n, ones, *first = rows.agg(F.count(F.lit(1)), F.sum(label), *[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    w = np.zeros(d + 1)
    if not n:
        return w, np.zeros(d), np.ones(d)
    mean, sd = np.array(first[:d], float), np.array([v if v > 0 else 1.0 for v in first[d:]], float)
    if ones in (0, n):
        w[0] = 30.0 if ones else -30.0
        return w, mean, sd
    ridge = np.diag([0.0, *[l2] * d])
    for _ in range(rounds):

        def derivatives(pdf, w=w.copy()):
            z = np.column_stack([np.ones(len(pdf)), (pdf[features].to_numpy(float) - mean) / sd])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            return np.r_[(p - pdf[label].to_numpy(float)) @ z, ((p * (1 - p))[:, None] * z).T.dot(z).ravel()][None]

        got = _summed(rows, derivatives, (d + 1) * (d + 2), 1)[0]
        step = np.linalg.solve(got[d + 1 :].reshape(d + 1, d + 1) + ridge + 1e-12 * np.eye(d + 1), got[: d + 1] + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w, mean, sd


def out_of_fold(df: DataFrame, record: str, features: list[str], label: str, k: int = 5, repeats: int = 10, l2: float = 1.0, seed: int = 0) -> DataFrame:
    """(record, p_fail): mean over the repeats of the probability by the model that was fitted without the record's fold."""
    models = fit_folds(df, record, features, label, k, repeats, l2, seed)
    rows = df.where(F.col(label).isNotNull()).na.drop(subset=features)
    p = rows.select(record, models.probabilities().alias("_p"), *[models.fold(r).alias(f"_f{r}") for r in range(repeats)])
    return p.select(record, (sum((F.get("_p", F.col(f"_f{r}") + r * k) for r in range(repeats)), F.lit(0.0)) / repeats).alias("p_fail"))


def overtraining(df: DataFrame, record: str, features: list[str], label: str, k: int = 5, repeats: int = 10, l2: float = 1.0, seed: int = 0) -> DataFrame:
    """One row: the mean area under the ROC of all models over the rows they were fitted to and over those held out, the latter's
    deviation, and the gap."""
    models = fit_folds(df, record, features, label, k, repeats, l2, seed)
    held = F.array(*[F.col(f"_f{r}") for r in range(repeats)])
    each = models.rows.select(F.col("_y").alias("y"), held.alias("_f"), F.posexplode(models.probabilities()).alias("model", "p"))
    # one number for a model and whether it never saw the row
    each = each.select("y", "p", (2 * F.col("model") + (F.get("_f", (F.col("model") / k).cast("int")) == F.col("model") % k).cast("int")).alias("g"))
    areas = auc_by(each, "g", "p", "y").select((F.col("g") % 2 == 1).alias("held_out"), "auc")
    of = lambda test: F.when(F.col("held_out") == test, F.col("auc"))
    out = areas.agg(F.avg(of(False)).alias("train_auc"), F.avg(of(True)).alias("test_auc"), F.stddev_pop(of(True)).alias("test_sd"))
    return out.withColumn("gap", F.col("train_auc") - F.col("test_auc"))


@dataclass
class Margins:
    """Maximum-margin separators: one for each fold (fitted without it) and, last, one of all rows. Label 1 where weights . x > cut, with
    the first weight 1 (or -1 where it points the other way)."""

    record: str
    features: list[str]
    k: int
    repeats: int
    seed: int
    weights: np.ndarray  #: [model, features], not scaled
    offset: np.ndarray
    objective: np.ndarray  #: half the squared weights plus c times the hinge losses
    gap: np.ndarray  #: how much less the objective could be at most, as a share of it
    passes: int

    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, cut) divided by the size of the first weight."""
        first = np.where(np.abs(self.weights[:, :1]) > 0, np.abs(self.weights[:, :1]), 1.0)
        return self.weights / first, -self.offset / first[:, 0]


STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def fit_margins(df: DataFrame, record: str, features: list[str], label: str, c: float = 100.0, k: int = 5, repeats: int = 1, seed: int = 0, tolerance: float = 1e-3, passes: int = 200) -> Margins:
    """Linear support vector machines over all rows, of all folds and of all rows at once.

    The hinge is rounded off over a band, in which Newton's method applies: a pass over the rows sums each model's gradient and curvature,
    another one its loss at several lengths of the step. Every pass also gives a feasible point of the dual (how far each row is into
    the band), so that the difference of primal and dual bounds what is left to gain; the band is narrowed until that is small enough.
    """
    d, models = len(features), repeats * k + 1
    x = [F.col(f).cast("double").alias(f) for f in features]
    rows = df.where(F.col(label).isNotNull()).select(record, *x, F.col(label).cast("int").alias("_y")).na.drop(subset=features)
    names = [f"_f{r}" for r in range(repeats)]
    rows = pinned(rows.select(*features, "_y", *[_fold(seed + r, record, k).alias(f"_f{r}") for r in range(repeats)]), "margins")
    first = rows.agg(F.count(F.lit(1)), *[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    centre = np.array([v or 0.0 for v in first[1 : d + 1]], float)
    scale = np.array([v if v else 1.0 for v in first[d + 1 :]], float)
    ridge = np.array([*(1 / scale**2), 0.0])  # of weights on standardised features; the offset is free

    def parts(pdf):
        z = np.column_stack([(pdf[features].to_numpy(float) - centre) / scale, np.ones(len(pdf))])
        folds = pdf[names].to_numpy()
        used = np.column_stack([(folds[:, :, None] != np.arange(k)).reshape(len(pdf), models - 1), np.ones(len(pdf), bool)])
        return z, np.where(pdf["_y"].to_numpy() == 1, 1.0, -1.0), used.astype(float)

    w, best, bound = np.zeros((models, d + 1)), np.full(models, np.inf), np.zeros(models)
    gap, kept = np.full(models, np.inf), w.copy()
    band, damp, done = np.full(models, 4.0), np.full(models, 1e-6), 0  # all rows lie in the first band
    live = np.arange(models) if first[0] else np.empty(0, int)
    gap[np.setdiff1d(np.arange(models), live)] = best[np.setdiff1d(np.arange(models), live)] = 0.0
    while len(live) and done < passes:

        def derivatives(pdf, w=w[live], band=band[live], live=live):
            z, y, used = parts(pdf)
            left = (1 - y[:, None] * (z @ w.T)) * 1.0
            used = used[:, live]
            into = np.clip(left / band, 0, 1) * used
            curved = ((left > 0) & (left < band)) * used / band
            loss = np.maximum(left, 0) * used
            smooth = (np.where(left < band, np.maximum(left, 0) ** 2 / (2 * band), left - band / 2)) * used
            curvature = np.einsum("bi,bm,bj->mij", z, curved, z, optimize=True).reshape(len(live), -1)
            return np.column_stack([loss.sum(0), smooth.sum(0), (into * (y > 0)[:, None]).T @ z, (into * (y < 0)[:, None]).T @ z, curvature])

        got = _summed(rows, derivatives, 2 + 2 * (d + 1) + (d + 1) ** 2, len(live))
        own = w[live]
        half = (ridge * own * own).sum(1) / 2
        primal, smooth = half + c * got[:, 0], half + c * got[:, 1]
        up, down = c * got[:, 2 : 3 + d], c * got[:, 3 + d : 4 + 2 * d]  # of either label; the last is how far all its rows are in
        pull = up - down
        # the label that is further in is drawn back, so that nothing of the offset is left
        least = np.minimum(up[:, -1], down[:, -1])
        fair = up * (least / np.maximum(up[:, -1], 1e-300))[:, None] - down * (least / np.maximum(down[:, -1], 1e-300))[:, None]
        dual = 2 * least - (fair[:, :-1] ** 2 / ridge[:-1]).sum(1) / 2
        better = primal < best[live]
        best[live], kept[live] = np.where(better, primal, best[live]), np.where(better[:, None], own, kept[live])
        bound[live] = np.maximum(bound[live], dual)
        gap[live] = np.maximum(best[live] - bound[live], 0) / np.maximum(best[live], 1e-300)
        gradient = ridge * own - pull
        curvature = c * got[:, 4 + 2 * d :].reshape(-1, d + 1, d + 1) + (ridge + damp[live][:, None] * (up + down)[:, -1:] + 1e-12)[:, :, None] * np.eye(d + 1)
        step = -np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
        promised = -(gradient * step).sum(1) / 2
        tried = own[:, None] + step[:, None] * np.array(STEPS)[None, :, None]

        def losses(pdf, tried=tried, band=band[live], live=live):
            z, y, used = parts(pdf)
            left = 1 - y[:, None, None] * np.einsum("bi,msi->bms", z, tried, optimize=True)
            wide = band[None, :, None]
            smooth = np.where(left < wide, np.maximum(left, 0) ** 2 / (2 * wide), left - wide / 2)
            return (smooth * used[:, live][:, :, None]).sum(0)

        value = (ridge * tried * tried).sum(2) / 2 + c * _summed(rows, losses, len(STEPS), len(live))
        done += 2
        pick = value.argmin(1)
        lower = value[np.arange(len(live)), pick]
        w[live] = np.where((lower < smooth)[:, None], tried[np.arange(len(live)), pick], own)
        # settled in this band once most of what is missing is the band's own; steps that bring nothing of what they promise are damped
        settled = (smooth - dual <= 0.5 * (primal - smooth)) | (promised <= 1e-10 * smooth)
        good = smooth - lower > 0.1 * promised
        damp[live] = np.where(settled, 1e-9, np.clip(np.where(good, damp[live] / 10, damp[live] * 10), 1e-9, 1e6))
        band[live] = np.where(settled, band[live] / 10, band[live])
        live = live[(gap[live] > tolerance) & (band[live] > 1e-12)]
    out = kept[:, :d] / scale
    return Margins(record, features, k, repeats, seed, out, kept[:, d] - out @ centre, best, gap, done)


def margin_cv(df: DataFrame, record: str, features: list[str], label: str, c: float = 100.0, k: int = 5, repeats: int = 1, seed: int = 0, tolerance: float = 1e-3) -> DataFrame:
    """(repeat, fold, weights, cut, accuracy, gap): separators fitted on the other folds, their first weight scaled to 1, and how they do on
    the fold; the row without repeat and fold is that of all rows."""
    m = fit_margins(df, record, features, label, c, k, repeats, seed, tolerance)
    rows = df.where(F.col(label).isNotNull()).na.drop(subset=features)
    weights, cut = m.scaled()
    says = [sum((F.col(f).cast("double") * float(v) for f, v in zip(features, w)), F.lit(0.0)) > F.lit(float(t)) for w, t in zip(weights, cut)]
    right = [(s == (F.col(label) == 1)).cast("double") for s in says]
    held = [F.avg(F.when(_fold(seed + i // k, record, k) == i % k, right[i])) for i in range(repeats * k)]
    got = rows.agg(*held, F.avg(right[-1])).first()
    out = [(i // k if i < repeats * k else None, i % k if i < repeats * k else None, weights[i].tolist(), float(cut[i]), got[i], float(m.gap[i])) for i in range(len(cut))]
    return df.sparkSession.createDataFrame(out, "repeat int, fold int, weights array<double>, cut double, accuracy double, gap double")


def ambiguous(p, band: tuple[float, float] = (0.35, 0.65)):
    return p.between(*band)
