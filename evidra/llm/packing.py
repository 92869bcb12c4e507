"""Best-fit packing of tokenised documents under several capacities at once.

Documents are tokenised and cut in pieces inside tasks; only the pieces' sizes are shuffled. Pieces are dealt to shards of bounded
size by a hash. In a shard, in falling order of length, each piece goes to the open bin that the vector rule prefers among those that
fit every capacity (tokens, documents, attention cost = sum of squared lengths): the largest weighted dot product of the piece and
the residuals, or the smallest weighted norm of what would be left. Bins that are not nearly full after that are dealt anew into
fewer shards and packed once more, so that hardly any waste stays at the shards' edges.

Null text is an empty document (one end token). Repeated rows and null ids are packed like any other; ties go to the older bin;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, cut, table

CACHE_WORDS = 250_000
#: Byte-level vocabularies write printable Latin-1 bytes as themselves and number the others on from 256.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


WEIGHTS = (1.0, 1.0, 1.0)


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = WEIGHTS  #: of tokens, documents and attention in the rule
    rule: str = "norm"  #: "norm": least weighted residual norm; "dot": largest weighted dot product


class WordCoder(Memo):
    """Token ids of whole texts, by words: the tokenizer drops white space, so that words are encoded once and looked up after.
    Holds for each word its little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(self.word_ids, CACHE_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def encode(self, text: str) -> bytes:
        """Ids of a text, without special tokens."""
        raw = text.encode("utf-8", "replace")
        # the tokenizer lower-cases; texts that could name its special tokens are left as they are
        words = (raw.lower() if b"<|" not in raw else raw).split()
        return b"".join(map(self.__getitem__, words))

    def word_ids(self, word: bytes) -> bytes:
        letters = self.letters(word)
        if letters is None:
            # letters and the stops at their end: the tokenizer never joins the two
            core = word.rstrip(b".,;:!?")
            if core != word and (core[-1:].isalnum() or self.letters(core) is not None):
                return self[core] + self[word[len(core) :]]
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        else:
            ids = [x.id for x in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def letters(word: bytes) -> str | None:
        """A word of lower-case Latin letters as the byte symbols that the model takes: the tokenizer's normalisation and splitting
        leave such a word as it is, so that they can be skipped."""
        if word.isalpha():
            return word.decode()
        if word.isascii():
            return None
        text = word.decode("utf-8", "replace")
        plain = text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text)
        return word.decode("latin-1").translate(BYTE_SYMBOLS) if plain else None


@lru_cache(maxsize=1)
def word_coder(path: str) -> WordCoder:
    """One for all tasks of a worker: frequent words are encoded once."""
    return WordCoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, size: int, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and row_key, which tells equal rows of documents apart."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end = word_coder(path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                coder.trim()
                ids = coder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    rows.append((key, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


class OpenBins:
    """Open bins by token residual, then by document residual; of bins alike in both, by attention residual.

    The vector rule takes, of all bins that every capacity lets the item into, the one of least rank: the weighted squared norm of the
    residuals that would be left, each as a share of its capacity, or for "dot" the largest weighted dot product of the item and the
    residuals. Both grow (or fall) with each residual by itself, so that of bins alike in tokens and documents one alone can win, and
    token residuals are tried from the side that the rule prefers until their own term is beyond the best rank.
    """

    def __init__(self, cap: Capacity) -> None:
        self.cap, self.mask = cap, 0
        self.at: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(cap.tokens + 1)]
        self.scale = [w / full**2 for w, full in zip(cap.weights, (cap.tokens, cap.documents, cap.attention))]

    def put(self, tokens: int, documents: int, attention: int, number: int) -> None:
        insort(self.at[tokens].setdefault(documents, []), (attention, number))
        self.mask |= 1 << tokens

    def take(self, tokens: int, documents: int, attention: int) -> tuple[int, int, int, int] | None:
        """Removes the best bin for an item of this size: its residuals and number."""
        norm = self.cap.rule == "norm"
        a, b, c = self.scale
        best, found = math.inf, None
        mask = self.mask >> tokens
        while mask:
            bit = mask & -mask if norm else 1 << mask.bit_length() - 1
            mask ^= bit
            left = tokens + bit.bit_length() - 1
            # no bin of this or a later residual can rank below this
            least = a * (left - tokens) ** 2 if norm else -(a * left * tokens + b * self.cap.documents * documents + c * self.cap.attention * attention)
            if least >= best:
                break
            for docs, bins in self.at[left].items():
                if docs < documents:
                    continue
                # of equal rank the older bin
                k = bisect_left(bins, (attention, -1)) if norm else bisect_left(bins, (bins[-1][0], -1))
                if k == len(bins) or bins[k][0] < attention:
                    continue
                room, number = bins[k]
                rank = least + b * (docs - documents) ** 2 + c * (room - attention) ** 2 if norm else -(a * left * tokens + b * docs * documents + c * room * attention)
                if rank < best or rank == best and number < found[3]:
                    best, found = rank, (left, docs, room, number)
        if found is not None:
            left, docs, room, number = found
            bins = self.at[left][docs]
            del bins[bisect_left(bins, (room, number))]
            if not bins:
                del self.at[left][docs]
                if not self.at[left]:
                    self.mask &= ~(1 << left)
        return found


def best_fit(length: np.ndarray, count: np.ndarray, cost: np.ndarray, cap: Capacity) -> np.ndarray:
    """The bin of each item, items in the order given; bins without room for the smallest item are closed."""
    bins, n = np.empty(len(length), np.int64), 0
    least = int(length.min()) if len(length) else 0
    opened = OpenBins(cap)
    for i, (tokens, documents, attention) in enumerate(zip(length.tolist(), count.tolist(), cost.tolist())):
        found = opened.take(tokens, documents, attention)
        if found is None:
            found, n = (cap.tokens, cap.documents, cap.attention, n), n + 1
        left, docs, room, number = found
        bins[i] = number
        if left - tokens >= least and docs > documents:
            opened.put(left - tokens, docs - documents, room - attention, number)
    return bins


def _pack(cap: Capacity):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        length, count = pdf["length"].to_numpy(), pdf["n_docs"].to_numpy()
        pdf["bin"] = best_fit(length, count, pdf["cost"].to_numpy(), cap)
        return pdf[["item", "length", "n_docs", "cost", "shard", "bin"]]

    return run


_PACKED = "item long, length long, n_docs long, cost long, shard long, bin long"


def pack(items: DataFrame, cap: Capacity, shard_items: int = 40_000) -> DataFrame:
    """items: (item long unique, length, n_docs, cost). Returns (item, sequence_id, offset). Two rounds, see above."""
    n = items.count()
    shards = max(1, -(-n // shard_items))
    first = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    first = cut(first.groupBy("shard").applyInPandas(_pack(cap), _PACKED))
    if shards == 1:
        placed = first.select("item", "length", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("inner"))
        bins = None
    else:
        key = (F.col("shard") * (1 << 32) + F.col("bin")).alias("item")
        bins = first.groupBy("shard", "bin").agg(*[F.sum(c).alias(c) for c in ("length", "n_docs", "cost")]).select(key, "length", "n_docs", "cost")
        loose = bins.where(F.col("length") < cap.tokens - max(1, cap.tokens // 256))
        again = loose.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(max(1, shards // 8))))
        again = again.groupBy("shard").applyInPandas(_pack(cap), _PACKED)
        # a bin packed again takes a negative id of its new bin, others keep their own
        moved = again.select("item", (-(F.col("shard") * (1 << 32) + F.col("bin")) - 1).alias("to"))
        own = first.select(F.col("item").alias("piece_item"), "length", key)
        placed = own.join(moved, "item", "left").select(
            F.col("piece_item").alias("item"), "length", F.coalesce("to", F.col("item")).alias("sequence_id"), F.col("item").alias("inner")
        )
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id").orderBy("inner", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("item", "sequence_id", (F.sum("length").over(w) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, cap: Capacity, path: str, end_id: int = 0) -> DataFrame:
    found = pieces(docs, path, cap.tokens, end_id)
    # the table is written, so that item numbers stay what they are
    found = cut(found.withColumn("item", F.monotonically_increasing_id()))
    whole = F.col("length") == cap.tokens
    rest = found.where(~whole).select("item", "length", F.lit(1).cast("long").alias("n_docs"), (F.col("length") * F.col("length")).alias("cost"))
    packed = pack(rest, cap)
    ids = found.where(~whole).join(packed, "item")
    # full pieces need no search; their ids are odd, the others' even
    full = found.where(whole).select("*", (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = ids.withColumn("sequence_id", F.col("sequence_id") * 2).unionByName(full)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), Capacity(), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"), Capacity(), tokenizer_path())
