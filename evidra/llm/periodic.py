"""Periodic runs of words, by the divide and conquer of Main and Lorentz on interned word ids.

A run is a stretch of consecutive words with a smallest period q, at least MIN_WORDS words and two periods long, that cannot be extended
to either side with that period. The words of a text are interned, so that words compare as integers. A stretch is halved; Z-functions
of the right half and of the reversed left half give, for every period, how far equality a period apart reaches to both sides of the
midpoint, hence every repetition that crosses it; those that a word outside would extend belong to an ancestor, which finds them whole.
The halves follow by the same rule. Intervals found for several periods keep the smallest.

All equalities that make a run of at least MIN_WORDS words hold over GRAM words or more, so that each of its words lies in a window of
GRAM words that occurs twice in the text. Only stretches of such windows are searched, which loses no run and spares most texts.

Rows are judged one by one, wherever they lie: nothing is shuffled, and a task holds one text at a time besides its batch. Null text
has no words. Texts of fewer than MIN_WORDS words have no run. Null doc_ids and repeated rows are kept as they are, other columns are
ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_col

MIN_WORDS = 12
GRAM = MIN_WORDS // 2
BATCH_BYTES = 4_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Interned(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def z_function(s: list[int]) -> list[int]:
    """Of every place the length of the longest common prefix of s and s from there on (0 at the first)."""
    n, z = len(s), [0] * len(s)
    first, left, right = s[0] if s else None, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != first:
            continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def crossing(s: list[int], left: int, middle: int, right: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions of s[left:right] next to or across the middle that nothing in all of s extends."""
    n, half, size = len(s), middle - left, right - left
    ahead = s[middle:right]
    back = s[left:middle][::-1]
    whole = s[left:right]
    forward = z_function([*ahead, -1, *whole])[len(ahead) + 1 :]  # what ahead and whole[i:] begin with
    forward.append(0)
    backward = z_function([*back, -1, *whole[::-1]])[half + 1 :]  # what s[left:middle] and whole[: size - i] end with
    backward.append(0)
    for step, most in ((1, size - half), (-1, half)):  # a period lies right of the middle, or left of it
        for q in range(1, most + 1):
            at = half + step * q
            reach, behind = forward[at], backward[size - at]
            if reach + behind < q or reach + behind + q < least:
                continue
            start, end = (middle - behind, middle + reach + q) if step == 1 else (middle - behind - q, middle + reach)
            if (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == n or s[end] != s[end - q]):
                yield start, end, q


def repetitions(s: list[int], least: int = MIN_WORDS) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of the runs of a sequence."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(s))]
    while todo:
        left, right = todo.pop()
        if right - left < least:
            continue
        middle = (left + right) // 2
        for start, end, q in crossing(s, left, middle, right, least):
            if q < found.get((start, end), q + 1):
                found[start, end] = q
        todo += [(left, middle), (middle, right)]
    return found


def repeating_stretches(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Maximal stretches of words that windows of gram words cover that occur twice or more (by hash: at worst a stretch too many)."""
    n = len(ids) - gram + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return []
    starts = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    cuts = np.flatnonzero(np.diff(starts) > gram)  # windows that overlap or touch are one stretch
    return [(int(a), int(b) + gram) for a, b in zip(starts[np.r_[0, cuts + 1]], starts[np.r_[cuts, len(starts) - 1]])]


def runs_of(words: list[bytes], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < least:
        return []
    ids = np.fromiter(map(Interned().__getitem__, words), np.int64, len(words))
    found = []
    for a, b in repeating_stretches(ids.astype(np.uint64), least // 2):
        found += [(a + start, end - start, q) for (start, end), q in repetitions(ids[a:b].tolist(), least).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """What is left when every run keeps its first period only."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB, so that long texts don't pile up."""
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed_text (what is left of the words, joined by one space)."""
    kind = {f.name: f.dataType for f in docs.schema}["doc_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in _sliced(batches):
            n, found, left = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                here = runs_of(words, least)
                n.append(len(words))
                found.append([{"start": a, "length": b, "period": q} for a, b, q in here])
                left.append(b" ".join(collapsed(words, here) if here else words).decode())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(item)), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed_text"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(judge, f"doc_id {kind.simpleString()}, n_words long, runs {RUNS}, collapsed_text string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten has a period from some word on: with h the crc32 of the doc_id, g = floor(h / 10) and n
    words, texts with h % 10 = 0 repeat from word a = g % n on the p = 1 + floor((n - a) / (3 + g % 8)) words from there."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words_col(F.col("text"))).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    at = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    again = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return at.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
