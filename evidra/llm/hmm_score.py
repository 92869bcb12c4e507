"""Language-model scores of whole texts by a hidden Markov model.

Texts are coded once: groups of about GROUP_CHARS characters become rows with the 64-bit hashes of their distinct words and the number
of each token's word, and every later pass reads these rows. Words are counted in Spark. Baum-Welch: each partition runs scaled forward
and backward recursions over all its training texts and sends expected counts, which Spark adds up. In all rounds but the last the
CLASSES most frequent words are observation classes of their own and every other word belongs to the class of its byte length, so that
the model is bounded, re-estimated on the driver and broadcast. The last round unties these classes: it gathers the expected counts of
every training word, as a table (word x state) in Spark, and each word has emissions of its own. A word that was never seen has the
weight of a count of zero, so that each text has a true probability. Scores come from one scaled forward recursion over each whole
text; the emissions of the HEAD most frequent words are broadcast, those of all others are joined by word, once for each group of
texts, so that nothing that grows with the corpus is broadcast. Recursions step through many texts side by side; a text of more than
LONG tokens is cut in stretches, which products of transfer matrices join exactly, so that one long text is no longer way than many short.

Tokens are lower-cased (A-Z) words and one end a text; words are told apart by a 64-bit hash. Null text is empty. Rows are scored one
by one: repeated rows get equal scores, null ids are kept (and count as training rows by the crc of an empty id). With no training rows
every probability is that of an untrained model. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, stored, table

STATES = 4
ROUNDS = 3
SHRINK = 10.0  #: tokens of a class at which its counts and independence weigh alike
CLASSES = 8192
HEAD = 131_072
LENGTHS = 24
BATCH_TOKENS = 400_000
LONG, STRETCH = 8_192, 1_024  #: tokens of a text that is cut in stretches, and of a stretch
GROUP_CHARS = 5_000_000
FOLD_ROWS = 1_500_000
UNKNOWN = 1  #: class of words that were never seen, once the classes are untied
CODED = "part long, held boolean, ids array<string>, lengths binary, words binary, sizes binary, codes binary"


@dataclass
class Hmm:
    start: np.ndarray  #: [state]
    move: np.ndarray  #: [state, state]
    emit: np.ndarray  #: [class, state]
    table: DataFrame | None = None  #: once untied: (word, c, s0, s1, ...) of all words without a class of their own, sums of all states but the last
    share: np.ndarray | None = None  #: once untied: emissions of a word follow from its row, by tail_emissions()
    norm: np.ndarray | None = None


@dataclass
class Words:
    """The head of the vocabulary and the totals of the tail classes. Class 0 is the end, 1..LENGTHS the tails, then single words."""

    hashes: np.ndarray  #: of the head, ascending
    rank: np.ndarray  #: of each of them by falling count
    counts: np.ndarray  #: by rank
    classes: int  #: of the head, how many have a class of their own
    total: int
    kinds: int
    n_docs: int
    class_n: np.ndarray

    @property
    def size(self) -> int:
        return len(self.class_n)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 beyond the head."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1)


# ------------------------------------------------------------------------------------------------ coding


class _Numbers(dict):
    """Numbers words from 1 on as they come; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


@dataclass
class Group:
    """Some texts: a number for each token, and hashes and byte lengths of the words that numbers from 1 on stand for."""

    ids: list
    lengths: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray

    def sequences(self) -> list[np.ndarray]:
        return np.split(self.codes, np.cumsum(self.lengths)[:-1])


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def code(ids: list, texts: list) -> Group:
    numbers, codes = _Numbers(), []
    for t in texts:
        raw = (t or "").encode("utf-8", "replace").lower().split()
        codes.append(np.fromiter(map(numbers.__getitem__, raw), np.int32, len(raw)))
        codes.append(np.zeros(1, np.int32))
    digest = xxhash.xxh64_intdigest
    words = np.fromiter(map(digest, numbers), np.uint64, len(numbers)).astype(np.int64)
    sizes = np.fromiter((min(len(w), LENGTHS) for w in numbers), np.uint8, len(numbers))
    lengths = np.array([len(x) + 1 for x in codes[::2]], np.int32)
    return Group(ids, lengths, words, sizes, np.concatenate(codes) if codes else np.empty(0, np.int32))


def coded(docs: DataFrame, held: str | None = None) -> DataFrame:
    """Rows of CODED, written once for all the passes that follow. held: a boolean column; texts of both kinds go to groups apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        wait: dict[bool, list] = {False: [[], [], 0], True: [[], [], 0]}

        def put(kind: bool) -> pd.DataFrame:
            nonlocal at
            g = code(wait[kind][0], wait[kind][1])
            wait[kind] = [[], [], 0]
            at += 1
            return pd.DataFrame({"part": [at], "held": [kind], "ids": [g.ids], "lengths": [g.lengths.tobytes()], "words": [g.words.tobytes()], "sizes": [g.sizes.tobytes()], "codes": [_squeeze(g.codes)]})

        for pdf in batches:
            for i, t, h in zip(pdf["doc_id"], pdf["text"], pdf["held"]):
                w = wait[bool(h)]
                w[0].append(i)
                w[1].append(t)
                w[2] += len(t or "")
                if w[2] > GROUP_CHARS or len(w[0]) >= 50_000:
                    yield put(bool(h))
        for kind in (False, True):
            if wait[kind][0]:
                yield put(kind)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col(held) if held else F.lit(False)).alias("held"))
    return stored(rows.mapInPandas(run, CODED), "coded")


def groups(batches: Iterator[pd.DataFrame]) -> Iterator[Group]:
    for pdf in batches:
        for words, sizes, lengths, codes in zip(*(pdf[c] for c in ("words", "sizes", "lengths", "codes"))):
            yield Group([], np.frombuffer(lengths, "<i4"), np.frombuffer(words, "<i8"), np.frombuffer(sizes, np.uint8), _unsqueeze(codes, "<i4"))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("lengths", "words", "sizes", "codes")


class _Sums:
    """Sums by word over the groups of a task; what does not fold to half of FOLD_ROWS is sent on."""

    def __init__(self, n_values: int) -> None:
        self.keys, self.values, self.n = [np.empty(0, np.int64)], [np.empty((0, n_values))], 0

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        old = np.concatenate(self.values)
        values = np.column_stack([np.bincount(at, v, len(keys)) for v in old.T])
        self.keys, self.values, self.n = [keys], [values], len(keys)
        return keys, values

    def add(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.keys.append(keys)
        self.values.append(values)
        self.n += len(keys)
        if self.n > FOLD_ROWS:
            full = self.fold()
            if self.n > FOLD_ROWS // 2:
                self.__init__(values.shape[1])
                return full
        return None


def count_words(rows: DataFrame) -> DataFrame:
    """(word, size, c) over coded texts; ends are not counted."""

    def frame(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        # the byte length comes with the count: all rows of a word have the same
        return pd.DataFrame({"word": keys, "size": (values[:, 1] / values[:, 2]).round().astype(np.int32), "c": values[:, 0].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(3)
        for g in groups(batches):
            n = np.bincount(g.codes, minlength=len(g.words) + 1)[1:]
            if full := sums.add(g.words, np.column_stack([n, g.sizes, np.ones(len(n))])):
                yield frame(*full)
        yield frame(*sums.fold())

    return _texts(rows).mapInPandas(run, "word long, size int, c long").groupBy("word").agg(F.first("size").alias("size"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, n_docs: int, classes: int = CLASSES, head: int = HEAD) -> Words:
    """counts must be stored: it is read three times.

    The head is cut at a count: of logarithmic bins of counts, as many of the highest as hold at most head words. So no task sends more
    than its share of the head to the driver, at any number of tasks.
    """
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, head
    for at, n in sizes:
        if n > room:
            break
        least, room = at, room - n
    top = counts.where(level >= least).toPandas() if least is not None else pd.DataFrame({"word": [], "size": [], "c": []})
    top = top.sort_values(["c", "word"], ascending=[False, True]).reset_index(drop=True)
    own = top.iloc[:classes]
    tail_n = np.zeros(LENGTHS + 1)
    total = kinds = 0
    for r in counts.groupBy("size").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[r["size"]] = r["n"]
        total, kinds = total + r["n"], kinds + r["v"]
    # classes of their own leave the tails
    tail_n -= np.bincount(own["size"].to_numpy(np.int64), own["c"].to_numpy(float), LENGTHS + 1)
    class_n = np.concatenate([[n_docs], tail_n[1:], own["c"].to_numpy(float)])
    order = np.argsort(top["word"].to_numpy(np.int64), kind="stable")
    return Words(top["word"].to_numpy(np.int64)[order], order, top["c"].to_numpy(np.int64), len(own), total + n_docs, kinds + (n_docs > 0), n_docs, class_n)


# ------------------------------------------------------------------------------------------------ recursions


def batches_of(seqs: list[np.ndarray], limit: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Indices of sequences in falling order of length, cut by tokens: each step then works on a prefix of a batch."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    group, size = [], 0
    for i in order:
        if group and size + len(seqs[i]) > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(seqs[i])
    if group:
        yield group


def _steps(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Observations in order of time, and the number of texts still active at each step."""
    length = np.array([len(s) for s in seqs])
    active = np.bincount(length, minlength=length[0] + 1)[::-1].cumsum()[::-1][1:]
    begin = np.concatenate([[0], np.cumsum(active)])
    rank = np.repeat(np.arange(len(seqs)), length)
    pos = np.arange(len(rank)) - np.repeat(np.cumsum(length) - length, length)
    obs = np.empty(len(rank), np.int32)
    obs[begin[pos] + rank] = np.concatenate(seqs)
    return obs, active


def _ahead(obs: np.ndarray, active: np.ndarray, hmm: Hmm, keep: bool, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Emissions [state, token], the scale of each token and, with keep, the scaled forward messages. first: the states' shares before
    the first token of each sequence, if they are not the start's."""
    b = np.ascontiguousarray(hmm.emit[obs].T)
    back, scale = np.ascontiguousarray(hmm.move.T), np.empty(len(obs))
    alpha = np.empty_like(b) if keep else None
    a, lo = None, 0
    for m in active.tolist():
        hi = lo + m
        a = (hmm.start[:, None] if first is None else first) * b[:, lo:hi] if a is None else back.dot(a[:, :m]) * b[:, lo:hi]
        s = scale[lo:hi]
        np.add.reduce(a, 0, out=s)
        a /= s
        if keep:
            alpha[:, lo:hi] = a
        lo = hi
    return b, scale, alpha


def _backwards(obs: np.ndarray, active: np.ndarray, b: np.ndarray, scale: np.ndarray, alpha: np.ndarray, hmm: Hmm, size: int, ends: np.ndarray | None = None) -> tuple:
    """Log likelihood, gamma of the first tokens, moves, emissions, and the messages that arrive at the first tokens. ends: what arrives at
    the last token of each sequence, if it is no end of a text."""
    b /= scale
    k = len(alpha)
    gamma, moves, last, hi = np.empty_like(alpha), np.zeros((k, k)), np.empty((k, 0)), len(obs)
    for m in active[::-1].tolist():
        lo, r = hi - m, last.shape[1]
        beta = gamma[:, lo:hi]
        beta[:, :r] = hmm.move.dot(last)
        beta[:, r:] = 1 if ends is None else ends[:, r:m]  # sequences that end here
        moves += alpha[:, lo : lo + r].dot(last.T)
        last = b[:, lo:hi] * beta
        hi = lo
    gamma *= alpha
    emit = np.column_stack([np.bincount(obs, g, size) for g in gamma])
    return float(np.log(scale).sum()), gamma[:, : active[0]], moves, emit, last


def stretches(seq: np.ndarray, hmm: Hmm) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A long sequence in stretches that need not wait for each other, and for each of them the states' shares before its first token, the
    forward message at the end of the one before, and the backward message at its end.

    A stretch is the product of its tokens' transfer matrices, a message for each state that it may start from, all stretches side by
    side. With these, states x states each, messages pass from stretch to stretch.
    """
    parts = [seq[i : i + STRETCH] for i in range(0, len(seq), STRETCH)]
    obs, active = _steps(parts)
    b, k, n = np.ascontiguousarray(hmm.emit[obs].T), len(hmm.start), len(parts)
    back, whole = np.ascontiguousarray(hmm.move.T), np.empty((k, n, k))
    a, lo = None, 0
    for m in active.tolist():
        hi = lo + m
        if a is None:
            a = np.repeat(back[:, None, :], n, 1)
            a[:, 0] = hmm.start[:, None]  # before the first stretch there is no state
        else:
            whole[:, m : a.shape[1]] = a[:, m:]  # stretches that have ended
            a = back.dot(a[:, :m].reshape(k, -1)).reshape(k, m, k)
        a = a * b[:, lo:hi, None]
        a /= a.sum((0, 2))[None, :, None]
        lo = hi
    whole[:, : a.shape[1]] = a
    before, ends = np.zeros((k, n)), np.ones((k, n))
    for i in range(1, n):
        x = whole[:, i - 1, 0] if i == 1 else whole[:, i - 1] @ before[:, i - 1]
        before[:, i] = x / x.sum()
    for i in range(n - 1, 0, -1):
        x = whole[:, i].T @ ends[:, i]
        ends[:, i - 1] = x / (x @ before[:, i])
    first = back @ before
    first[:, 0] = hmm.start
    return parts, first, before, ends


def _long(seqs: list[np.ndarray]) -> int:
    """How many of the sequences, in falling order of length, are cut in stretches."""
    return sum(len(s) > LONG for s in seqs)


def forward(seqs: list[np.ndarray], hmm: Hmm) -> np.ndarray:
    """Natural log likelihood of each sequence (in falling order of length)."""
    long = _long(seqs)
    score = np.zeros(len(seqs))
    for i, seq in enumerate(seqs[:long]):
        parts, first, _, _ = stretches(seq, hmm)
        score[i] = np.log(_ahead(*_steps(parts), hmm, False, first)[1]).sum()
    if long == len(seqs):
        return score
    obs, active = _steps(seqs[long:])
    logs, lo = np.log(_ahead(obs, active, hmm, False)[1]), 0
    for m in active.tolist():
        score[long : long + m] += logs[lo : lo + m]
        lo += m
    return score


def expectations(seqs: list[np.ndarray], hmm: Hmm, size: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood and expected counts: starts, moves, emissions [class, state]. seqs in falling order of length."""
    long, k = _long(seqs), len(hmm.start)
    like, start, moves, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    for seq in seqs[:long]:
        parts, first, before, ends = stretches(seq, hmm)
        obs, active = _steps(parts)
        x = _backwards(obs, active, *_ahead(obs, active, hmm, True, first), hmm, size, ends)
        # a stretch's first token follows the last one of the stretch before
        like, start, moves, emit = like + x[0], start + x[1][:, 0], moves + x[2] + before[:, 1:].dot(x[4][:, 1:].T), emit + x[3]
    if long < len(seqs):
        obs, active = _steps(seqs[long:])
        x = _backwards(obs, active, *_ahead(obs, active, hmm, True), hmm, size)
        like, start, moves, emit = like + x[0], start + x[1].sum(1), moves + x[2], emit + x[3]
    return like, start, moves * hmm.move, emit


# ------------------------------------------------------------------------------------------------ training


def initial(words: Words, states: int = STATES, seed: int = 7) -> Hmm:
    """The words' frequencies, tilted at random from state to state; states last, so that texts of a kind soon gather in one."""
    rng = np.random.default_rng(seed)
    emit = (words.class_n[:, None] + 1.0) * rng.uniform(0.3, 1.7, (words.size, states))
    move = np.full((states, states), 0.002) + np.eye(states) * (1 - 0.002 * states)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def tied(g: Group, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The class of each number of a group, and which of its words have no class of their own."""
    rank = words.ranks(g.words)
    open_ = (rank < 0) | (rank >= words.classes)
    return np.concatenate([[0], np.where(open_, g.sizes, LENGTHS + 1 + rank)]), open_


class _Expected:
    """Sums of expected counts over a task, as one vector of cells: likelihood, starts, moves, then emissions by class and state."""

    def __init__(self, size: int, states: int) -> None:
        self.like, self.start, self.moves, self.emit, self.seen = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), False

    def add(self, g: Group, hmm: Hmm) -> np.ndarray:
        """hmm: its emissions are by number of the group. Returns expected emissions by number."""
        seqs, emit = g.sequences(), np.zeros(hmm.emit.shape)
        for batch in batches_of(seqs):
            x = expectations([seqs[i] for i in batch], hmm, len(emit))
            self.like, self.start, self.moves, emit, self.seen = self.like + x[0], self.start + x[1], self.moves + x[2], emit + x[3], True
        return emit

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([[self.like], self.start, self.moves.reshape(-1), self.emit.reshape(-1)])
        at = np.flatnonzero(flat)
        return at, flat[at]

    @classmethod
    def of(cls, got: pd.DataFrame, size: int, states: int) -> _Expected:
        """From summed cells (cell, v)."""
        flat = np.zeros(1 + states + states**2 + size * states)
        flat[got["cell"].to_numpy(np.int64)] = got["v"].to_numpy(float)
        out = cls(size, states)
        parts = np.split(flat, np.cumsum([1, states, states**2]))
        out.like, out.start, out.moves, out.emit, out.seen = float(parts[0][0]), parts[1], parts[2].reshape(states, states), parts[3].reshape(size, states), len(got) > 0
        return out

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        start, move = self.start + 1.0, self.moves + 1.0
        return start / start.sum(), move / move.sum(1, keepdims=True)


def estep(rows: DataFrame, hmm: Hmm, words: Words) -> DataFrame:
    """(cell, v): partition sums added up in Spark."""
    sc, k = rows.sparkSession.sparkContext, len(hmm.start)
    model, vocab = sc.broadcast(hmm), sc.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hmm, words = model.value, vocab.value
        out = _Expected(words.size, k)
        for g in groups(batches):
            kind, _ = tied(g, words)
            emit = out.add(g, replace(hmm, emit=hmm.emit[kind]))
            out.emit += np.column_stack([np.bincount(kind, e, words.size) for e in emit.T])
        cell, v = out.cells()
        yield pd.DataFrame({"cell": cell, "v": v})

    return _texts(rows).mapInPandas(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))


def gather(rows: DataFrame, hmm: Hmm, words: Words) -> DataFrame:
    """Like estep(), and with cell -1 a row for every word without a class of its own: word, its count as v, and its expected counts
    in all states but the last (all states of a word sum to its count)."""
    sc, k = rows.sparkSession.sparkContext, len(hmm.start)
    model, vocab = sc.broadcast(hmm), sc.broadcast(words)
    names = [f"s{j}" for j in range(k - 1)]

    def frame(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"cell": -1, "word": keys, "v": values[:, 0]} | {s: values[:, j + 1].astype(np.float32) for j, s in enumerate(names)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hmm, words = model.value, vocab.value
        out, tail = _Expected(words.size, k), _Sums(k)
        for g in groups(batches):
            kind, open_ = tied(g, words)
            emit = out.add(g, replace(hmm, emit=hmm.emit[kind]))
            n = np.bincount(g.codes, minlength=len(kind))
            own = np.concatenate([[True], ~open_])
            out.emit += np.column_stack([np.bincount(kind[own], e, words.size) for e in emit[own].T])
            if full := tail.add(g.words[open_], np.column_stack([n[1:][open_], emit[1:, :-1][open_]])):
                yield frame(*full)
        yield frame(*tail.fold())
        cell, v = out.cells()
        yield pd.DataFrame({"cell": cell, "word": 0, "v": v} | {s: np.zeros(len(v), np.float32) for s in names})

    found = _texts(rows).mapInPandas(run, "cell long, word long, v double" + "".join(f", {s} float" for s in names))
    return found.groupBy("cell", "word").agg(F.sum("v").alias("v"), *[F.sum(s).cast("float").alias(s) for s in names])


def fit(rows: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Baum-Welch over all coded rows, the last round for every word; the log likelihood before each round."""
    hmm, course = initial(words, states), []
    for _ in range(rounds - 1):
        x = _Expected.of(estep(rows, hmm, words).toPandas(), words.size, states)
        if not x.seen:
            break
        course.append(x.like)
        # expected counts of rare classes are drawn towards independence of the state: their total stays the class's count
        share = x.emit.sum(0) / x.emit.sum()
        sure = (words.class_n / (words.class_n + SHRINK))[:, None]
        emit = x.emit * sure + np.outer(words.class_n + 1, share) * (1 - sure)
        hmm = Hmm(*x.chain(), emit / emit.sum(0))
    return untie(rows, hmm, words, course), course


def untie(rows: DataFrame, hmm: Hmm, words: Words, course: list[float]) -> Hmm:
    """The last round: emissions of every word, by the same rule as those of classes."""
    k = len(hmm.start)
    found = stored(gather(rows, hmm, words), "expected")
    x = _Expected.of(found.where("cell >= 0").select("cell", "v").toPandas(), words.size, k)
    tail = found.where("cell < 0").select("word", F.col("v").cast("long").alias("c"), *[f"s{j}" for j in range(k - 1)])
    c = F.col("c")
    last = c - sum((F.col(f"s{j}") for j in range(k - 1)), F.lit(0.0))
    each, sure = [*[F.col(f"s{j}") for j in range(k - 1)], last], c / (c + SHRINK)
    sums = tail.agg(*[F.sum(s) for s in each], *[F.sum(s * sure) for s in each], F.sum((c + 1) * (1 - sure))).first()
    raw, drawn, rest = np.array([v or 0.0 for v in sums[:k]]), np.array([v or 0.0 for v in sums[k : 2 * k]]), sums[2 * k] or 0.0
    total = x.emit.sum(0) + raw
    share = total / total.sum() if total.sum() > 0 else np.full(k, 1 / k)
    n = words.class_n.copy()
    n[1 : LENGTHS + 1] = 0  # all words of these have left, and one of them stands for what was never seen
    certain = (n / (n + SHRINK))[:, None]
    emit = x.emit * certain + np.outer(n + 1, share) * (1 - certain)
    emit[1 : LENGTHS + 1] = 0
    emit[UNKNOWN] = share
    norm = emit.sum(0) + drawn + share * rest
    start, move = x.chain() if x.seen else (hmm.start, hmm.move)
    if x.seen:
        course.append(x.like)
    return Hmm(start, move, emit / norm, tail, share, norm)


def tail_emissions(c: np.ndarray, sums: np.ndarray, hmm: Hmm) -> np.ndarray:
    """[word, state] of rows of hmm.table: counts, and sums [word, state but the last]."""
    every = np.column_stack([sums, np.maximum(c - sums.sum(1), 0)])
    sure = (c / (c + SHRINK))[:, None]
    return (every * sure + (c[:, None] + 1) * hmm.share * (1 - sure)) / hmm.norm


def score(rows: DataFrame, hmm: Hmm, words: Words) -> DataFrame:
    """doc_id as text, held, n_tokens, n_known, base_score, score of coded rows; logarithms to base 10. hmm as fit() gives it."""
    sc, k = rows.sparkSession.sparkContext, len(hmm.start)
    names = [f"s{j}" for j in range(k - 1)]
    # the rest of the head is all words from its least count on
    head = hmm.table.where(F.col("c") >= int(words.counts.min())).toPandas() if len(words.counts) else pd.DataFrame(columns=["word", "c", *names])
    emit, c = np.zeros((len(words.counts), k)), words.counts.astype(float)
    emit[: words.classes] = hmm.emit[LENGTHS + 1 :]
    emit[words.ranks(head["word"].to_numpy(np.int64))] = tail_emissions(head["c"].to_numpy(float), head[names].to_numpy(float).reshape(-1, k - 1), hmm)
    model, vocab = sc.broadcast((replace(hmm, table=None), emit, c, np.log10(words.total + words.kinds + 1))), sc.broadcast(words)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocab.value
        for pdf in batches:
            for part, raw in zip(pdf["part"], pdf["words"]):
                every = np.frombuffer(raw, "<i8")
                pos = np.flatnonzero(words.ranks(every) < 0)
                yield pd.DataFrame({"part": part, "pos": pos.astype(np.int32), "word": every[pos]})

    def judge(key: tuple, texts: pd.DataFrame, tail: pd.DataFrame) -> pd.DataFrame:
        (hmm, head, counts, denom), words = model.value, vocab.value
        g = next(groups(iter([texts])))
        rank = words.ranks(g.words)
        # first all words as never seen, then those of the head and the tail
        emit, c = np.tile(hmm.emit[UNKNOWN], (len(rank) + 1, 1)), np.zeros(len(rank) + 1)
        emit[0], c[0] = hmm.emit[0], words.n_docs
        top = np.flatnonzero(rank >= 0)
        emit[top + 1], c[top + 1] = head[rank[top]], counts[rank[top]]
        at = tail["pos"].to_numpy(np.int64) + 1
        c[at] = tail["c"].to_numpy(float)
        emit[at] = tail_emissions(c[at], tail[names].to_numpy(float).reshape(-1, k - 1), hmm)
        seqs, like = g.sequences(), np.empty(len(g.lengths))
        for batch in batches_of(seqs):
            like[batch] = forward([seqs[i] for i in batch], replace(hmm, emit=emit))
        begin = np.concatenate([[0], np.cumsum(g.lengths)[:-1]])
        known, base = np.add.reduceat((c > 0)[g.codes], begin, dtype=np.int64), np.add.reduceat(np.log10(c + 1)[g.codes], begin)
        return pd.DataFrame({"doc_id": list(texts["ids"].iloc[0]), "held": bool(texts["held"].iloc[0]), "n_tokens": g.lengths.astype(np.int64), "n_known": known, "base_score": base - g.lengths * denom, "score": like / np.log(10)})

    asked = rows.select("part", "words").mapInPandas(ask, "part long, pos int, word long")
    replies = asked.join(hmm.table, "word").select("part", "pos", "c", *names)
    both = rows.select("part", "held", "ids", "lengths", "words", "sizes", "codes").groupBy("part").cogroup(replies.groupBy("part"))
    return both.applyInPandas(judge, "doc_id string, held boolean, n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = coded(docs.withColumn("held", fold(F.col("doc_id"), 7) == 2), "held")
    train = rows.where(~F.col("held"))
    counts = stored(count_words(train), "words")
    words = vocabulary(counts, train.agg(F.sum(F.size("ids"))).first()[0] or 0)
    hmm, _ = fit(train, words)
    kind = dict(docs.dtypes)["doc_id"]
    return score(rows, hmm, words).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
