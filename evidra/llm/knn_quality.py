"""Quality classification by votes of the nearest labelled texts in a latent space.

Texts become hashed counts of word shapes, pairs of shapes, words and immediate repeats; TF-IDF of a bounded labelled sample and its
truncated SVD (randomised range finder) give latent vectors. The labelled vectors (at most 2 * PER_CLASS of them) are broadcast; every
document gets its exact cosines with all of them, block by block, and its K nearest vote with the square of their similarity as weight.

The sample is balanced: at most about PER_CLASS ids a label, chosen by a hash of the id; whole texts. An id with several labels takes
the largest, one with several texts the least; null labels are no labels. Null text is empty: texts without words score 0, as nothing speaks for them. Without labels of both kinds
the score is the share of label 1 (0.5 without any). Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, cut, drawn, fold, share, table

PER_CLASS = 1500
DIMS = 48
K = 25
SHAPES, PAIRS, WORDS = 512, 1024, 1024
FEATURES = SHAPES + PAIRS + WORDS + 2
BLOCK_TOKENS = 100_000


def shape(word: str) -> str:
    """Letters as a, A or Aa by case, digits as 0, other characters as they are; runs once."""
    case = lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa"
    out = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", case, word[:64]))
    return re.sub(r"(.)\1+", r"\1\1", out)


def _hash(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


class Features:
    """Hashed counts; the features of a word are computed once and kept in rows of a table."""

    def __init__(self) -> None:
        self.codes = Memo(self._code)

    @staticmethod
    def _code(word: bytes) -> int:
        """Three hashes in one number: shape, word, and the word itself for repeats."""
        w = word.decode("utf-8", "replace")
        return _hash(shape(w), SHAPES) | _hash(w.lower(), WORDS) << 10 | (zlib.crc32(word) & 0x7FFFFFFF) << 20

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Counts [text, feature], dense: for blocks of bounded size."""
        self.codes.trim()
        words = [t.encode("utf-8", "replace").split() for t in texts]
        n = [len(w) for w in words]
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64, sum(n))
        out = np.zeros(len(texts) * FEATURES, np.float32)
        if not len(code):
            return out.reshape(len(texts), FEATURES)
        x = np.column_stack([code & 1023, code >> 10 & 1023, code >> 20])
        doc = np.repeat(np.arange(len(texts)), n)
        base = doc * FEATURES
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        prev = np.concatenate([[0], x[:-1, 0]])
        same = np.concatenate([[False], x[1:, 2] == x[:-1, 2]]) & ~first
        pair = (prev * 31 + x[:, 0]) % PAIRS
        keys = [base + x[:, 0], (base + SHAPES + pair)[~first], base + SHAPES + PAIRS + x[:, 1], base[same] + FEATURES - 2, base[~same] + FEATURES - 1]
        return np.bincount(np.concatenate(keys), minlength=len(out)).astype(np.float32).reshape(len(texts), FEATURES)


@dataclass
class Neighbours:
    idf: np.ndarray
    basis: np.ndarray  #: [feature, dim]
    vectors: np.ndarray  #: [labelled text, dim], unit length; none if the labels are of one kind
    labels: np.ndarray
    prior: float  #: share of label 1


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def blocks(texts: list[str], limit: int = BLOCK_TOKENS * 6) -> Iterator[tuple[int, int]]:
    """Slices of at most 256 texts and about limit characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= 256 or size + len(t) > limit):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features = Features()
    for pdf in batches:
        texts = pdf["text"].tolist()
        for lo, hi in blocks(texts):
            m = features.matrix(texts[lo:hi])
            yield pd.DataFrame({"label": pdf["label"].iloc[lo:hi], "counts": [r.astype("<f4").tobytes() for r in m]})


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(label, text): the labelled texts that are fitted on."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("label") == label) & drawn("quality-sample", "doc_id", share(per_class, n)))
    # the sample's ids are counted before they are broadcast; were they more than the bound, an ordinary join would do
    marks = cut(marks.where(keep).select(F.col("doc_id").alias("_id"), "label"))
    if marks.count() <= 4 * per_class * max(1, len(counts)):
        marks = F.broadcast(marks)
    rows = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id"))
    # an id that several rows have gives one text, so that the sample's bound holds for rows too
    return rows.groupBy("_id").agg(F.first("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text")).select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dims: int = DIMS, seed: int = 3) -> Neighbours:
    got = sample(docs, labels, per_class).mapInPandas(_counts, "label int, counts binary").toPandas()
    got = got.sort_values(["label", "counts"]).reset_index(drop=True)  # ids play no part
    if got["label"].nunique() < 2:  # nothing to tell apart
        prior = float((got["label"] == 1).mean()) if len(got) else 0.5
        return Neighbours(np.zeros(FEATURES, np.float32), np.zeros((FEATURES, dims), np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), prior)
    counts = np.vstack([np.frombuffer(x, "<f4") for x in got["counts"]])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.2).astype(np.float32)
    x = weigh(counts, idf)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], dims + 8)).astype(np.float32)
    for _ in range(3):  # subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt[:dims].T).astype(np.float32)
    return Neighbours(idf, basis, unit(x @ basis).astype(np.float32), got["label"].to_numpy(), float((got["label"] == 1).mean()))


def vote(sims: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Share of label 1 among the k nearest, weighted by squared similarity; ties of the k-th by index."""
    n = sims.shape[1]
    k = min(k, n)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(k), sims.shape)
    edge = np.take_along_axis(sims, near, 1).min(1)
    for i in np.flatnonzero((sims >= edge[:, None]).sum(1) > k):  # more reach the edge than fit
        above, tied = np.flatnonzero(sims[i] > edge[i]), np.flatnonzero(sims[i] == edge[i])
        near[i] = np.concatenate([above, tied[: k - len(above)]])
    w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** 2 + 1e-9
    return (w * (labels[near] == 1)).sum(1) / w.sum(1)


def classify(docs: DataFrame, model: Neighbours, k: int = K) -> DataFrame:
    """(doc_id, score). A score depends on the text alone, so that a labelled text is one of its own neighbours."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, features = shared.value, Features()
        for pdf in batches:
            texts, out = pdf["text"].tolist(), np.empty(len(pdf))
            for lo, hi in blocks(texts):
                counts = features.matrix(texts[lo:hi])
                voted = vote(unit(weigh(counts, m.idf) @ m.basis) @ m.vectors.T, m.labels, k) if len(m.labels) else m.prior
                out[lo:hi] = np.where(counts.any(1), voted, 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": out})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    out = classify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
