"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut in passages of WIDTH words. Document frequencies of their words are counted over the passages of all documents.
A randomised SVD gives the latent space: each partition multiplies its TF-IDF passages A by a random matrix and back, Spark adds up
A'(A R) (words of the items x dimensions), and its orthonormal basis is the space. Then every document slides a window over its whole
text; windows whose TF-IDF weight lies mostly in words of the items (an upper bound of any cosine) are projected and their cosines with all item
passages computed; candidates are verified by the longest common subsequence of the item and the text around the window, and by the
item's answer, where the benchmark has an answer column. Without an answer the LCS decides alone, and the share of the item's rarest
words that are there is reported only. Items shorter than a window or
of very frequent words alone are also looked up by words: of its rarest words so many that an LCS of 0.8 holds one of them, each place of which in a document is verified.

Words are lower-cased and stripped of punctuation at both ends. Items go in blocks of bounded size, so that what is broadcast is bounded
at any size of the benchmark. Null texts hold nothing; items of fewer than MIN_WORDS words must occur as they are, in one run. Repeated
rows give one pair. Null ids are kept. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, Memo, stored, table

WIDTH = 16
STRIDE = 4
DIMS = 256
COSINE = 0.6
SHARE = COSINE**2  #: least share of a window's squared weight in words of the items: no more than this is the square of any cosine
LCS = 0.8
ANSWER = 0.8
MIN_WORDS = 6
BLOCK_ITEMS = 5000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def norm(word: bytes) -> str:
    x = word.decode("utf-8", "replace").lower()
    return x if x.isalpha() else _EDGE.sub("", x)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(norm, (text or "").encode("utf-8", "replace").split()) if w]


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]  #: word ids
    answers: list[np.ndarray | None]
    vocab: dict[str, int]
    idf: np.ndarray | None = None
    other: float = 0.0  #: idf of words that no item has
    basis: np.ndarray | None = None
    passages: np.ndarray | None = None  #: unit latent vectors
    owner: np.ndarray | None = None  #: item of each passage
    by_word: dict[int, list[int]] | None = None  #: items to be tried wherever a word occurs


class Coder:
    """Word ids of texts; -1 for words that no item has. Tokens of punctuation alone are left out."""

    def __init__(self, vocab: dict[str, int]) -> None:
        self.known = Memo(lambda w: vocab.get(x, -1) if (x := norm(w)) else -2)

    def __call__(self, text: str | None) -> np.ndarray:
        self.known.trim()
        words = (text or "").encode("utf-8", "replace").split()
        ids = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        return ids[ids != -2] if len(ids) and ids.min() == -2 else ids


def load_items(rows: list) -> Items:
    vocab: dict[str, int] = {}
    ids, words, answers = [], [], []
    for r in rows:
        w = item_words(r["text"])
        if w:
            ids.append(r["item_id"])
            words.append(np.array([vocab.setdefault(x, len(vocab)) for x in w], np.int32))
            a = item_words(r["answer"]) if "answer" in r.__fields__ else []
            answers.append(np.array([vocab.setdefault(x, len(vocab)) for x in a], np.int32) if a else None)
    return Items(ids, words, answers, vocab)


def coded(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id as text, ids): word ids of every whole text, written once for the passes that follow."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [coder(t).astype("<i4").tobytes() for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return stored(rows.mapInPandas(run, "doc_id string, ids binary"), "coded")


def document_frequencies(docs: DataFrame, items: Items) -> None:
    """Sets idf: over disjoint passages of WIDTH words of all coded documents."""
    size = len(items.vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(size, np.int64), 0
        for pdf in batches:
            for raw in pdf["ids"]:
                ids = np.frombuffer(raw, "<i4")
                n += -(-len(ids) // WIDTH)
                at = np.flatnonzero(ids >= 0)
                np.add.at(df, np.unique(at // WIDTH * size + ids[at]) % size, 1)
        rows = np.flatnonzero(df)
        yield pd.DataFrame({"word": np.append(rows, -1), "df": np.append(df[rows], n)})

    got = docs.select("ids").mapInPandas(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toPandas()
    n = int(got.loc[got["word"] < 0, "df"].sum()) + len(items.ids)
    df = np.zeros(len(items.vocab))
    df[got.loc[got["word"] >= 0, "word"]] = got.loc[got["word"] >= 0, "df"]
    idf = np.log((1 + n) / (1 + df))
    idf[df > 0.3 * n] = 0  # words of most passages say nothing
    items.idf = idf.astype(np.float32)
    items.other = float(np.median(idf)) if len(idf) else 0.0
    items.by_word = {}
    for i, words in enumerate(items.words):
        if len(words) < WIDTH or (items.idf[words] ** 2).sum() <= 1e-6:
            found, often = np.unique(words, return_counts=True)
            order = np.argsort(df[found], kind="stable")
            # at most so many words are missing, so that one of the words up to here is there
            missing = len(words) - math.ceil(least_lcs(len(words)))
            for w in found[order[: int(np.searchsorted(np.cumsum(often[order]), missing + 1)) + 1]].tolist():
                items.by_word.setdefault(w, []).append(i)


@dataclass
class Windows:
    """Windows of several documents that mostly hold words of the items."""

    ids: np.ndarray  #: word ids of the documents, one after the other
    start: np.ndarray
    end: np.ndarray  #: of the window, within its document
    doc: np.ndarray  #: number of its document
    first: np.ndarray  #: where each document begins, and the end of the last

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of rows[word id] over each window."""
        at = self.start[:, None] + np.arange(WIDTH)[None, :]
        x = self.ids[np.minimum(at, len(self.ids) - 1)]
        ok = (at < self.end[:, None]) & (x >= 0)
        return np.einsum("pwd,pw->pd", rows[np.maximum(x, 0)], ok.astype(np.float32))

    def part(self, lo: int, hi: int) -> Windows:
        return Windows(self.ids, self.start[lo:hi], self.end[lo:hi], self.doc[lo:hi], self.first)


def windows(docs: list[np.ndarray], items: Items, stride: int, share: float = SHARE) -> Windows:
    """Of all windows of the documents, those whose squared weight lies in words of the items to the given share."""
    n = np.array([len(d) for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    ids = np.concatenate(docs) if len(docs) else np.empty(0, np.int32)
    count = np.where(n > WIDTH, -(-(n - WIDTH) // stride) + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(docs)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    # the last window of a document ends with it
    start = first[doc] + np.minimum(k * stride, np.maximum(n[doc] - WIDTH, 0))
    end = np.minimum(start + WIDTH, first[doc + 1])
    square = (items.idf**2)[np.maximum(ids, 0)].astype(np.float64)
    inside = np.where(ids >= 0, square, 0.0)
    a, b = (np.concatenate([[0.0], np.cumsum(x)]) for x in (inside, np.where(ids >= 0, square, items.other**2)))
    got, total = a[end] - a[start], b[end] - b[start]
    keep = (got > 1e-6) & (got >= share * total)
    return Windows(ids, start[keep], end[keep], doc[keep], first)


def groups_of(raws: list[bytes], limit: int = 400_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Coded documents in groups of about limit words, each with the number of its first document."""
    lo, size, group = 0, 0, []
    for i, raw in enumerate(raws):
        x = np.frombuffer(raw, "<i4")
        if group and size + len(x) > limit:
            yield lo, group
            lo, size, group = i, 0, []
        group.append(x)
        size += len(x)
    if group:
        yield lo, group


def latent_space(docs: DataFrame, items: Items, dims: int = DIMS, seed: int = 11) -> None:
    """Sets basis, passages and owner."""
    size = len(items.vocab)
    dims = min(dims, size)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(items)
    omega = np.random.default_rng(seed).standard_normal((size, dims)).astype(np.float32)
    tied = items.idf[:, None] * omega

    def back(w: Windows, out: np.ndarray, idf: np.ndarray) -> None:
        """Adds A'(A R) of these passages, each of unit length near enough, so that junk that repeats a word weighs as any other."""
        for lo in range(0, len(w.start), 1024):
            part = w.part(lo, lo + 1024)
            y = part.sums(tied) / np.maximum(part.sums((idf * idf)[:, None]), 1e-9)
            at = part.start[:, None] + np.arange(WIDTH)[None, :]
            ok = at < part.end[:, None]
            owner, x = np.nonzero(ok)[0], part.ids[at[ok]]
            owner, x = owner[x >= 0], x[x >= 0]
            order = np.argsort(x, kind="stable")
            x, owner = x[order], owner[order]
            edge = np.flatnonzero(np.diff(x, prepend=-1))
            out[x[edge]] += idf[x[edge], None] * np.add.reduceat(y[owner], edge, axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, out = shared.value, np.zeros((size, dims), np.float32)
        for pdf in batches:
            for _, docs in groups_of(pdf["ids"].tolist()):
                back(windows(docs, m, WIDTH), out, m.idf)
        rows = np.flatnonzero(out.any(1))
        yield pd.DataFrame({"word": rows, "y": [r.astype("<f4").tobytes() for r in out[rows]]})

    def fold_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds up rows of a word; words of a partition are whole here."""
        out: dict[int, np.ndarray] = {}
        for pdf in batches:
            for w, y in zip(pdf["word"], pdf["y"]):
                y = np.frombuffer(y, "<f4")
                out[w] = out[w] + y if w in out else y
        yield pd.DataFrame({"word": list(out), "y": [y.astype("<f4").tobytes() for y in out.values()]}).astype({"word": "int64"})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = docs.select("ids").mapInPandas(run, "word long, y binary").repartition(n, "word").mapInPandas(fold_rows, "word long, y binary").toPandas()
    total = np.zeros((size, dims), np.float32)
    for w, y in zip(got["word"], got["y"]):
        total[w] += np.frombuffer(y, "<f4")
    own = windows(items.words, items, WIDTH // 2, 0.0)
    back(own, total, items.idf)  # the items' own passages belong to the matrix too
    items.basis = np.linalg.qr(total.astype(np.float64))[0].astype(np.float32)
    vectors = own.sums(items.idf[:, None] * items.basis)
    items.passages = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    items.owner = own.doc


def least_lcs(n: int) -> float:
    return n if n < MIN_WORDS else LCS * n - 1e-9


@dataclass
class Target:
    """What verify() needs of an item, put together once a worker."""

    words: np.ndarray
    kinds: np.ndarray  #: its distinct words, sorted
    often: np.ndarray  #: how often the item has each
    where: list[int]  #: of each, the bits of its places

    @classmethod
    def of(cls, words: np.ndarray) -> Target:
        kinds, at, often = np.unique(words, return_inverse=True, return_counts=True)
        where = [0] * len(kinds)
        for i, k in enumerate(at.tolist()):
            where[k] |= 1 << i
        return cls(words, kinds, often, where)


def lcs(where: list[int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel, of an item of n words and a text as indices of where."""
    full = v = (1 << n) - 1
    for x in text:
        u = v & where[x]
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def overlaps(place: np.ndarray, kind: np.ndarray, often: np.ndarray, size: int, reach: int) -> np.ndarray:
    """For each stretch of reach words of a text of size words, how many words it shares with the item, repeats counted as often as the
    item has them: no less than any common subsequence. place, kind: the text's words that the item has."""
    order = np.argsort(kind, kind="stable")
    place, kind = place[order], kind[order]
    # an occurrence counts from the stretch on that no longer holds the one as many before it as the item has
    k = np.arange(len(kind))
    j = k - often[kind]
    same = (j >= 0) & (kind[np.maximum(j, 0)] == kind)
    begin = np.maximum(np.where(same, place[np.maximum(j, 0)], -1), place - reach) + 1
    change = np.bincount(np.maximum(begin, 0), minlength=size + 1) - np.bincount(place + 1, minlength=size + 1)
    return np.cumsum(change)[: size - reach + 1]


def verify(ids: np.ndarray, at: int, t: Target, answer: np.ndarray | None, idf: np.ndarray) -> tuple[float, float]:
    """(share of the item in its LCS with the text around the window, share of the answer found there). Stretches of 1.25 times the
    item's length are tried that share enough words with it, the one that shares most first; neighbours among them are tried as one
    stretch that holds them all, no more than an eighth of the item longer, so that none is passed over."""
    n = len(t.words)
    reach = n + n // 4 + 1
    apart = max(WIDTH, n // 2)  # windows of one mark in search() are less than this apart: one reaches the text of all
    near = ids[max(0, at - apart - reach) : at + apart + WIDTH + reach]
    need = least_lcs(n)
    kind = np.minimum(np.searchsorted(t.kinds, near), len(t.kinds) - 1)
    place = np.flatnonzero(t.kinds[kind] == near)
    if len(place) < need:
        return 0.0, 0.0
    kind, reach = kind[place], min(reach, len(near))
    shared = overlaps(place, kind, t.often, len(near), reach)
    enough = np.flatnonzero(shared >= need)
    if not len(enough):
        return 0.0, 0.0
    best, begin, end = 0, 0, 0
    if n < MIN_WORDS:  # in one run
        runs = [s for s in enough.tolist() if (near[s : s + n] == t.words).all()] if len(near) >= n else []
        best, begin, end = (n, runs[0], runs[0] + n) if runs else (0, 0, 0)
    else:
        step = max(1, n // 8)
        tries, last = [(int(shared.argmax()), 0)], -step - 1
        for s in enough.tolist():
            if s - last > step:
                tries.append((s, step))
                last = s
        for s, more in tries:
            lo, hi = np.searchsorted(place, (s, s + reach + more))
            got = lcs(t.where, n, kind[lo:hi].tolist())
            if got > best:
                best, begin, end = got, s, s + reach + more
            if best >= need:
                break
    if best < need:
        return best / n, 0.0
    if answer is None:
        rare = t.kinds
        answer = rare[np.argsort(-idf[rare], kind="stable")[: max(1, n // 4)]]
    return best / n, float(np.isin(answer, near[max(0, begin - n) : end + n]).mean())


def search(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, cosine) of coded documents: verified pairs, the best window of each."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        rows, targets = m.idf[:, None] * m.basis, Memo(lambda item: Target.of(m.words[item]))
        sought = np.zeros(len(m.vocab) + 1, bool)  # the last is for words that no item has
        sought[list(m.by_word)] = True

        def cosine(ids: np.ndarray, at: int, item: int) -> float:
            """The best of the window there with the item's passages."""
            v = (rows[(x := ids[at : at + WIDTH])[x >= 0]]).sum(0)
            return float((m.passages[m.owner == item] @ v).max(initial=0.0) / max(np.linalg.norm(v), 1e-9))

        for pdf in batches:
            found = []
            for first, docs in groups_of(pdf["ids"].tolist()):
                every = windows(docs, m, STRIDE)
                best: dict[tuple[int, int], tuple] = {}
                done = set()
                for lo in range(0, len(every.start), 1024):
                    w = every.part(lo, lo + 1024)
                    v = w.sums(rows)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    cos = v @ m.passages.T
                    at, p = np.nonzero(cos >= COSINE)
                    order = np.argsort(-cos[at, p], kind="stable")
                    for x, y in zip(at[order].tolist(), p[order].tolist()):
                        item, doc = int(m.owner[y]), int(w.doc[x])
                        where = int(w.start[x] - w.first[doc])
                        # a window near one that was tried reaches the same text
                        mark = (doc, item, where // max(WIDTH, len(m.words[item]) // 2))
                        if mark in done or (doc, item) in best:
                            continue
                        done.add(mark)
                        share, answer = verify(docs[doc], where, targets[item], m.answers[item], m.idf)
                        if share >= LCS - 1e-9 and (m.answers[item] is None or answer >= ANSWER):
                            best[doc, item] = (pdf["doc_id"].iloc[first + doc], str(m.ids[item]), share, answer, float(cos[x, y]))
                for doc, ids in enumerate(docs):
                    for where in np.flatnonzero(sought[ids]).tolist():
                        for item in m.by_word[int(ids[where])]:
                            mark = (doc, item, "word", where // WIDTH)
                            if mark in done or (doc, item) in best:
                                continue
                            done.add(mark)
                            share, answer = verify(ids, where, targets[item], m.answers[item], m.idf)
                            if share >= LCS - 1e-9 and (m.answers[item] is None or answer >= ANSWER):
                                best[doc, item] = (pdf["doc_id"].iloc[first + doc], str(m.ids[item]), share, answer, cosine(ids, where, item))
                found += best.values()
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])

    out = docs.mapInPandas(run, "doc_id string, item_id string, lcs_share double, answer_share double, cosine double")
    return out.withColumn("item_id", F.col("item_id").cast("long"))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Verified pairs of documents and items; the benchmark is taken in blocks of block_items rows by a hash of item_id."""
    docs = docs.select("doc_id", "text")
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    blocks = max(1, -(-benchmark.count() // block_items))
    out = None
    for i in range(blocks):
        rows = benchmark.select(*columns).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        items = load_items(rows)
        if items.ids:
            ids = coded(docs, items)
            document_frequencies(ids, items)
            latent_space(ids, items)
            found = search(ids, items)
            out = found if out is None else out.unionByName(found)
    kind = dict(docs.dtypes)["doc_id"]
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, lcs_share double, answer_share double, cosine double")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("lcs_share", "answer_share", "cosine")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = docs.select(*DOC_COLUMNS)
    bad = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")
