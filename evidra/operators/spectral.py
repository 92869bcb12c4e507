"""Centred singular value decomposition of an encoded table, atypicality and contributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import helmert as _helmert


@dataclass
class Model:
    mean: np.ndarray
    basis: np.ndarray  #: [dim, k]
    values: np.ndarray  #: all singular values
    n: int
    names: list[str]

    @property
    def k(self) -> int:
        return self.basis.shape[1]

    @property
    def variances(self) -> np.ndarray:
        return self.values[: self.k] ** 2 / max(self.n - 1, 1)

    def certificate(self) -> dict:
        """What the truncation leaves out."""
        total = float((self.values**2).sum())
        kept = float((self.values[: self.k] ** 2).sum())
        nonzero = self.values[self.values > 1e-12 * max(self.values.max(initial=0), 1e-300)]
        return {
            "n": self.n, "dim": len(self.mean), "rank": len(nonzero), "components": self.k, "energy": kept / total if total else 1.0,
            "residual_norm": math.sqrt(max(total - kept, 0.0)), "condition": float(nonzero[0] / nonzero[-1]) if len(nonzero) else None,
        }


def fit(encoded: DataFrame, names: list[str], energy: float = 0.95) -> Model | None:
    """encoded: (key, x). Tall-skinny QR: every partition reduces its rows to a triangle, Spark stacks those, and the driver's SVD is of
    partitions x dim rows at most. This keeps the condition of X, where a Gramian would square it. None unless n > dim > 1."""
    dim = len(names)
    n, *means = encoded.agg(F.count(F.lit(1)), *[F.avg(F.get("x", F.lit(i))) for i in range(dim)]).first()
    if not n > dim > 1:
        return None
    mean = np.array(means, float)

    def triangle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.empty((0, dim))
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                r = np.linalg.qr(np.vstack([r, np.vstack(pdf["x"].iloc[lo : lo + 4096]) - mean]), mode="r")
        if len(r):  # a partition without rows has no triangle: an empty column of lists has no type that Arrow could take
            yield pd.DataFrame({"r": list(r)})

    small = encoded.select("x").mapInPandas(triangle, "r array<double>")
    # a second level, so that the driver sees few rows however many partitions there are
    parts = max(1, int(math.isqrt(encoded.rdd.getNumPartitions())))
    rows = small.withColumnRenamed("r", "x").repartition(parts).mapInPandas(lambda b: _stack(b, dim), "r array<double>").collect()
    _, s, vt = np.linalg.svd(np.vstack([x["r"] for x in rows]), full_matrices=False)
    rank = int((s > max(n, dim) * np.finfo(float).eps * s[0]).sum())
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    k = min(int(np.searchsorted(share, energy - 1e-12) + 1), max(rank, 1))
    return Model(mean, vt[:k].T, s, int(n), names)


def _stack(batches: Iterator[pd.DataFrame], dim: int) -> Iterator[pd.DataFrame]:
    r = np.empty((0, dim))
    for pdf in batches:
        if len(pdf):
            r = np.linalg.qr(np.vstack([r, np.vstack(pdf["x"])]), mode="r")
    if len(r):
        yield pd.DataFrame({"r": list(r)})


def _dot(x: Column, v: np.ndarray) -> Column:
    lit = F.array(*[F.lit(float(a)) for a in v])
    return F.aggregate(F.zip_with(x, lit, lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)


def score(encoded: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, scores, t2, q, contributions): Hotelling's statistic, the squared residual, and each coordinate's share of t2 (they add up)."""
    mean = F.array(*[F.lit(float(m)) for m in model.mean])
    x = encoded.select(key, F.zip_with("x", mean, lambda a, m: a - m).alias("c"))
    x = x.select(key, "c", F.array(*[_dot(F.col("c"), model.basis[:, j]) for j in range(model.k)]).alias("scores"))
    inv = F.array(*[F.lit(float(1 / v)) for v in model.variances])
    w = x.withColumn("w", F.zip_with("scores", inv, lambda s, i: s * i))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, y: a + y)
    t2 = total(F.zip_with("w", "scores", lambda a, b: a * b))
    q = total(F.transform("c", lambda a: a * a)) - total(F.transform("scores", lambda a: a * a))
    each = F.array(*[F.get("c", F.lit(i)) * _dot(F.col("w"), model.basis[i]) for i in range(len(model.mean))])
    return w.select(key, "scores", t2.alias("t2"), F.greatest(q, F.lit(0.0)).alias("q"), each.alias("contributions"))


def drivers(scored: DataFrame, key: str, names: list[str], top: int = 3) -> DataFrame:
    """(key, drivers): the coordinates that contribute most."""
    pairs = F.zip_with("contributions", F.array(*[F.lit(n) for n in names]), lambda v, n: F.struct(v.alias("value"), n.alias("name")))
    return scored.select(key, F.slice(F.sort_array(pairs, asc=False), 1, top).alias("drivers"))


def whiten(scored: DataFrame, key: str, model: Model) -> DataFrame:
    sd = F.array(*[F.lit(float(1 / math.sqrt(v))) for v in model.variances])
    return scored.select(key, F.zip_with("scores", sd, lambda s, d: s * d).alias("x"))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * f


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if betainc(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def chi2_quantile(q: float, dof: float) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(q)
    return dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3


def t2_limit(n: int, k: int, q: float = 0.975) -> float:
    """(n - 1)^2 / n times a beta quantile; chi-squared where n is too small for it."""
    return (n - 1) ** 2 / n * beta_quantile(q, k / 2, (n - k - 1) / 2) if n > k + 1 else chi2_quantile(q, k)


def identities(encoded: DataFrame, key: str, model: Model, evidence_mismatches: int | None = None) -> DataFrame:
    """(check, value, tolerance, passed, measured): identities that hold to rounding if the decomposition is right; measured is the
    quantity itself where it has a meaning of its own. Sums of squares and products are added up in Spark (k x k and dim x dim numbers);
    no row reaches the driver. condition() tells how many digits are at risk."""
    k, dim, n = model.k, len(model.mean), max(model.n - 1, 1)
    scored = score(encoded, key, model)
    mean = F.array(*[F.lit(float(m)) for m in model.mean])
    centred = encoded.select(F.zip_with("x", mean, lambda a, m: a - m).alias("c"))

    def products(df: DataFrame, column: str, size: int) -> np.ndarray:
        """Sum over rows of column' column."""
        cells = [F.sum(F.get(column, F.lit(i)) * F.get(column, F.lit(j))) for i in range(size) for j in range(i, size)]
        flat, out = list(df.agg(*cells).first()), np.zeros((size, size))
        out[np.triu_indices(size)] = flat
        return out + np.triu(out, 1).T

    basis, lam = model.basis, model.values[:k] ** 2
    gram = products(centred, "c", dim)
    crossed = products(scored, "scores", k)
    white = products(whiten(scored, key, model), "x", k) / n
    # the same distances by an explicit inverse on the space of the kept components, and what is left by differences
    kept_space = basis @ basis.T
    inverse = np.linalg.pinv(kept_space @ (gram / n) @ kept_space, rcond=1e-12)
    both = score(encoded.select(F.struct(F.lit(0).alias("k"), "x").alias("_row"), "x"), "_row", model).withColumn("c", F.zip_with("_row.x", mean, lambda a, m: a - m))
    explicit = sum((F.get("c", F.lit(i)) * _dot(F.col("c"), inverse[i]) for i in range(dim)), F.lit(0.0))
    back = F.array(*[_dot(F.col("scores"), basis[i]) for i in range(dim)])
    rest = F.aggregate(F.zip_with("c", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    gaps = both.agg(F.max(F.abs(explicit - F.col("t2")) / F.greatest(explicit, F.lit(1e-12))).alias("t2"), F.max(F.abs(rest - F.col("q"))).alias("q")).first()
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    row = scored.agg(F.max(F.abs(total - F.col("t2"))).alias("gap"), F.sum("q").alias("left")).first()
    energy, kept = float((model.values**2).sum()), float(lam.sum())
    helmert = 0.0
    for levels in range(2, 9):
        h = np.array(_helmert(levels))
        helmert = max(helmert, np.abs(h.T @ h - np.eye(levels - 1)).max(), np.abs(h.sum(0)).max())
    off = lambda m: float(np.abs(m - np.eye(len(m))).max())
    rows = [
        ("orthogonality_basis", off(basis.T @ basis), 1e-12, None),
        ("orthogonality_scores", off(crossed / np.sqrt(np.outer(lam, lam))), 1e-8, None),
        ("roundtrip", float(gaps["q"]) / energy, 1e-9, None),
        ("eigen_equation_residual", float(max(np.linalg.norm(gram @ basis[:, i] - lam[i] * basis[:, i]) for i in range(k)) / lam[0]), 1e-9, None),
        ("energy_of_all_components", abs(float(np.trace(gram)) - energy) / energy, 1e-9, energy),
        ("truncation_identity", abs(float(row["left"]) / energy - (energy - kept) / energy), 1e-9, None),
        ("whitening_covariance", off(white), 1e-8, float(model.n)),
        ("mahalanobis_by_inverse", float(gaps["t2"]), 1e-6, None),
        ("contributions_sum_to_t2", float(row["gap"]), 1e-8, None),
        ("helmert_orthonormal", float(helmert), 1e-12, None),
    ]
    if evidence_mismatches is not None:
        rows.append(("evidence_reread_mismatches", float(evidence_mismatches), 0.0, float(evidence_mismatches)))
    checked = [(name, v, t, v <= t, m) for name, v, t, m in rows]
    return encoded.sparkSession.createDataFrame(checked, "check string, value double, tolerance double, passed boolean, measured double")


def condition(model: Model) -> dict:
    """The condition of the data, and decimal digits at risk: twice as many if a covariance were formed and decomposed."""
    least = float(model.values[-1])
    kappa = float(model.values[0]) / least if least > 0 else math.inf
    return {"condition": kappa, "digits_at_risk": math.log10(kappa), "digits_at_risk_of_covariance": 2 * math.log10(kappa)}
