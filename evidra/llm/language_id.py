"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (orders 0 to 3, escape probabilities by method C) is counted on a bounded
sample of labelled texts; frozen, it gives the exact code length of every whole text, and the shortest code wins. Texts are
lower-cased first. Ties go to the language that sorts first. Null text, or a text without a letter, is ``und`` with score 0; if
nothing can be learned, every text is ``und``. Rows are judged one by one (repeated rows, null ids and other columns do no harm).

The driver counts languages, collects the grams of the sample (bounded by it) and builds the trees: a state for each context, which keeps
only the symbols seen after it, a code length each, and what it costs to escape to the shorter context. Trees of more than MODEL_BYTES
are built again with the rarer contexts of three bytes left to their suffixes, so that what is broadcast has that bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, drawn, fold, share, table

ORDER = 3
PAD = bytes(ORDER)
MIN_SCORE = 0.3  #: the pipeline's least share of likelihood; four equal languages have 0.25
BLOCK = 1 << 20
MODEL_BYTES = 128_000_000  #: of code lengths and escapes


@dataclass
class Trees:
    langs: list[str]
    lut: np.ndarray  #: byte to symbol, 0 for bytes that the sample lacks
    a: int  #: number of symbols
    state: np.ndarray  #: code of the last three symbols to state; at most 257 ** 3 of them
    lower: np.ndarray  #: state to that of the context without its first byte, -1 for the empty one
    escape: np.ndarray  #: [state, language]: bits of leaving for the shorter context
    words: np.ndarray  #: [state, 64 symbols each]: a bit for every symbol seen
    base: np.ndarray  #: [state, 64 symbols each]: symbols seen before these
    bits: np.ndarray  #: [symbol seen in a state, language]: code length in bits

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.state, self.lower, self.escape, self.words, self.base, self.bits))

    def cost(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """[position, language]: bits of each symbol in its state, by its own length or by escapes down to a state that has it."""
        out = np.zeros((len(state), len(self.langs)), np.float32)
        word, one = symbol >> 6, np.uint64(1) << (symbol & 63).astype(np.uint64)
        at = np.arange(len(state))
        while len(at):
            have = self.words[state, word]
            seen = have & one != 0
            i = self.base[state, word] + np.bitwise_count(have & (one - np.uint64(1)))
            out[at[seen]] += self.bits[i[seen]]
            miss = ~seen
            at, state, word, one = at[miss], state[miss], word[miss], one[miss]
            out[at] += self.escape[state]
            state = self.lower[state]
            out[at[state < 0]] += 8  # any byte
            left = state >= 0
            at, state, word, one = at[left], state[left], word[left], one[left]
        return out


def train_rows(docs: DataFrame, per_lang: int) -> DataFrame:
    """About per_lang labelled texts a language at most, chosen by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    rates = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(share(per_lang, n)))])
    return rows.where(drawn("lang-sample", "doc_id", rates[F.col("lang")]))


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            raw = np.frombuffer(PAD + PAD.join(t.lower().encode("utf-8", "replace") for t in part["text"]), np.uint8).astype(np.uint32)
            if len(raw) > ORDER:
                codes = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
                gram, n = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n.astype(np.int64)})


def fit(docs: DataFrame, per_lang: int = 1500, min_context: int = 3) -> Trees | None:
    """min_context: contexts of three bytes seen fewer times fall back to their shorter suffix."""
    rows = train_rows(docs, per_lang).mapInPandas(_grams, "lang string, gram long, n long")
    found = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build(found, min_context) if (found["gram"] & 255 != 0).any() else None


def build(found: pd.DataFrame, min_context: int, limit: int = MODEL_BYTES) -> Trees:
    found = found[(found["gram"].to_numpy(np.int64) & 255) != 0]  # padding is context, never predicted
    gram, n = found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    langs = sorted(found["lang"].unique())
    which = np.searchsorted(langs, found["lang"].to_numpy(str))
    used = np.unique(np.concatenate([gram >> s & 255 for s in (24, 16, 8, 0)]))
    used = used[used != 0]
    lut = np.zeros(256, np.int32)
    lut[used] = np.arange(1, len(used) + 1)
    a = len(used) + 1
    s3, s2, s1, s0 = (lut[gram >> s & 255].astype(np.int64) for s in (24, 16, 8, 0))
    contexts = [np.zeros(len(gram), np.int64), s1, s2 * a + s1, (s3 * a + s2) * a + s1]
    ctx3, of3 = np.unique(contexts[3], return_inverse=True)
    total3 = np.bincount(of3, n, len(ctx3))
    while True:
        # what is kept: all contexts of up to two bytes, and those of three that are frequent enough
        rows = [np.arange(len(gram))] * 3 + [np.flatnonzero(total3[of3] >= min_context)]
        pairs = [np.unique(c[r] * a + s0[r]) for c, r in zip(contexts, rows)]
        states = [np.unique(k // a) for k in pairs]
        if 4 * len(langs) * sum(map(len, [*pairs, *states])) <= limit or not len(pairs[3]):
            break
        min_context *= 2
    first = np.concatenate([[0], np.cumsum([len(c) for c in states])])
    total = int(first[-1])
    lower = np.full(total, -1, np.int64)
    escape = np.zeros((total, len(langs)), np.float32)
    words = np.zeros((total, (a + 63) // 64), np.uint64)
    bits, below = [], None
    for order, (ctx, r, keys, own) in enumerate(zip(contexts, rows, pairs, states)):
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, (np.searchsorted(keys, ctx[r] * a + s0[r]), which[r]), n[r])
        state, symbol = np.searchsorted(own, keys // a), keys % a
        starts = np.flatnonzero(np.r_[True, state[1:] != state[:-1]]) if len(keys) else np.empty(0, np.int64)
        if len(keys):
            all_of, kinds = np.add.reduceat(counts, starts), np.add.reduceat((counts > 0).astype(float), starts)
            leave = np.where(all_of > 0, kinds / np.maximum(all_of + kinds, 1), 1.0)  # a context that a language lacks costs it nothing
            shorter = own % a ** max(order - 1, 0) if order else own
            p = 1 / 256 if not order else below[2][np.searchsorted(below[0], (keys // a % a ** (order - 1)) * a + symbol)]
            p = np.where(counts > 0, counts / np.maximum(all_of + kinds, 1)[state], leave[state] * p)
            escape[first[order] : first[order + 1]] = -np.log2(leave)
            if order:
                lower[first[order] : first[order + 1]] = first[order - 1] + np.searchsorted(below[1], shorter)
            np.bitwise_or.at(words, (first[order] + state, symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
            bits.append(-np.log2(p).astype(np.float32))
            below = (keys, own, p)
    ends = np.cumsum(np.bitwise_count(words).astype(np.int64).ravel())
    base = (ends - np.bitwise_count(words).ravel()).reshape(words.shape)
    # contexts that are not kept go to the longest suffix that is
    state = np.zeros(a**3, np.int32)
    state.reshape(a * a, a)[:, states[1]] = first[1] + np.arange(len(states[1]))
    state.reshape(a, a * a)[:, states[2]] = first[2] + np.arange(len(states[2]))
    state[states[3]] = first[3] + np.arange(len(states[3]))
    return Trees(langs, lut, a, state, lower, escape, words, base, np.concatenate(bits))


def code_lengths(model: Trees, texts: list[bytes]) -> np.ndarray:
    """[text, language]: bits of each whole text."""
    out = np.zeros((len(texts), len(model.langs)))
    starts, group, size = 0, [], 0

    def flush(first: int, group: list[bytes]) -> None:
        sym = model.lut[np.frombuffer(PAD + PAD.join(group) + b"\0", np.uint8)]
        code = (sym[:-3] * model.a + sym[1:-2]) * model.a + sym[2:-1]
        ends = np.cumsum([len(t) + ORDER for t in group])
        begin = ends - np.array([len(t) + ORDER for t in group])
        cost = model.cost(model.state[code].astype(np.int64), sym[3:])  # position p holds the byte p of the text, then three paddings
        cuts = np.column_stack([begin, begin + [len(t) for t in group]]).reshape(-1)
        sums = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]), np.float32)]), cuts, axis=0, dtype=np.float64)[::2]
        out[first : first + len(group)] = np.where((np.array([len(t) for t in group]) > 0)[:, None], sums, 0)

    for i, t in enumerate(texts):
        if group and size + len(t) > BLOCK:
            flush(starts, group)
            starts, group, size = i, [], 0
        group.append(t)
        size += len(t) + ORDER
    if group:
        flush(starts, group)
    return out


def identify_rows(docs: DataFrame, model: Trees | None) -> DataFrame:
    """docs with lang_pred, score (the winner's share of likelihood, at the rate of four bytes' code length) and bits_per_byte."""
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for texts in batches:
            ok = texts.notna().to_numpy()
            raw = [t.lower().encode("utf-8", "replace") if o else b"" for t, o in zip(texts, ok)]
            rate = code_lengths(trees, raw) / np.maximum([len(t) for t in raw], 1)[:, None]
            best = rate.argmin(1)
            share = 1 / np.exp2(4 * (rate.min(1, keepdims=True) - rate)).sum(1)
            lang = np.where(ok, np.array(trees.langs, object)[best], "und")
            yield pd.DataFrame({"lang_pred": lang, "score": np.where(ok, share, 0.0), "bits_per_byte": np.where(ok, rate.min(1), 0.0)})

    judge.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # not deterministic in name only: filters above must not make it run twice
    label = F.pandas_udf(judge, "lang_pred string, score double, bits_per_byte double").asNondeterministic()
    return docs.withColumn("_label", label(lettered)).select(*docs.columns, "_label.*")


def identify(docs: DataFrame, model: Trees | None) -> DataFrame:
    return identify_rows(docs.select("doc_id", "text"), model).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    return identify(docs, fit(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language and a clear winner; lang keeps the corpus's own mark."""
    docs = docs.select(*DOC_COLUMNS)
    found = identify_rows(docs, fit(docs.where(fold(F.col("doc_id"), 4) != 2)))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*DOC_COLUMNS)
