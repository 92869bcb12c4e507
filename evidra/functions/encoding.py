"""Numeric encodings of typed columns, as one projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def helmert(k: int) -> np.ndarray:
    """Orthonormal basis [k, k - 1] of the contrasts of k categories."""
    out = np.zeros((k, k - 1))
    for j in range(1, k):
        out[:j, j - 1] = 1 / math.sqrt(j * (j + 1))
        out[j, j - 1] = -j / math.sqrt(j * (j + 1))
    return out


def nominal(c: Column, categories: list[str]) -> list[Column]:
    """Helmert coordinates of a category; unknown and null give zeros."""
    basis = helmert(len(categories))
    cols = []
    for j in range(len(categories) - 1):
        e = F.lit(0.0)
        for i, cat in enumerate(categories):
            e = F.when(c == cat, F.lit(float(basis[i, j]))).otherwise(e)
        cols.append(e)
    return cols


def ordinal(c: Column, order: list[str]) -> Column:
    """(rank - centre) / standard deviation of the ranks; unknown and null give 0."""
    ranks = np.arange(len(order))
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.coalesce(F.when(at > 0, (at - 1 - float(ranks.mean())) / float(ranks.std() or 1.0)), F.lit(0.0))


def cyclic(c: Column, period: float = 365.25, harmonics: int = 1) -> list[Column]:
    """cos and sin of the day of the year; null gives 0."""
    out = []
    for m in range(1, harmonics + 1):
        angle = F.lit(2 * math.pi * m) * (F.dayofyear(c) - 1) / period
        out += [F.coalesce(F.cos(angle), F.lit(0.0)), F.coalesce(F.sin(angle), F.lit(0.0))]
    return out


@dataclass(frozen=True)
class Spec:
    """kind: affine, nominal, ordinal or cyclic."""

    column: str
    kind: str
    levels: tuple[str, ...] = ()


def encode(df: DataFrame, specs: list[Spec], key: str, standardise: bool = True) -> tuple[DataFrame, list[str]]:
    """(key, x array<double>) and the names of the coordinates. Specs of absent columns are skipped.

    Means and deviations come from one aggregate row. Without standardise, numbers keep their units and nulls take the mean.
    """
    specs = [s for s in specs if s.column in df.columns]
    numeric = [s.column for s in specs if s.kind == "affine"]
    stats = {}
    if numeric:
        row = df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in numeric}
    cols, names = [], []
    for s in specs:
        c = F.col(s.column)
        if s.kind == "affine":
            mean, sd = stats[s.column]
            if standardise:
                cols.append(F.coalesce((c - F.lit(mean)) / F.lit(sd), F.lit(0.0)) if sd else F.lit(0.0))
            else:
                cols.append(F.coalesce(c.cast("double"), F.lit(float(mean or 0.0))))
            names.append(s.column)
        elif s.kind == "nominal":
            more = nominal(c, list(s.levels))
            cols += more
            names += [f"{s.column}~{j}" for j in range(len(more))]
        elif s.kind == "ordinal":
            cols.append(ordinal(c, list(s.levels)))
            names.append(s.column)
        elif s.kind == "cyclic":
            more = cyclic(c)
            cols += more
            names += [f"{s.column}~cos", f"{s.column}~sin"]
        else:
            raise ValueError(f"unknown kind {s.kind}")
    return df.select(F.col(key), F.array(*[c.cast("double") for c in cols]).alias("x")), names
