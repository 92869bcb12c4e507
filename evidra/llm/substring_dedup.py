"""Removal of passages that repeat, by Rabin-Karp hashes of every window of a fixed number of words.

Documents are dealt to chunks by a hash of their id, chunks of a size that fits in memory at any corpus size. Each chunk hashes all its
windows, counts its own repeats and sends each distinct window hash once, sorted and cut in buckets by hash range: a passage that a
third of all documents hold costs one hash for each chunk. A bucket gathers its hashes from all chunks, counts them and returns to
each chunk one bit for every hash it sent. Back in the chunk, windows found twice anywhere merge into maximal intervals, which go.

Window equality is judged by a 64-bit polynomial hash of 64-bit word hashes. Null text has no words. Repeated rows are documents of
their own, hence lose all their windows (rows alike in id and text are in one chunk). Documents with fewer words than a window keep all. Null ids are allowed. Other columns are
ignored by the query. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table, text_bytes

WINDOW = 35
CHUNK_BYTES = 6_000_000
BUCKET_CHUNK_BYTES = 12_000_000
PARTITIONS_EACH = 4  #: partitions of chunks at most, for each shuffle partition of the session
BASE = 0x9E3779B97F4A7C15  # odd


WORDS = Memo(xxhash.xxh64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every window of size consecutive values, modulo 2 to the 64, by doubling."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out, have, part, length, power = None, 0, h, 1, BASE
    n = len(h) - size + 1
    left = size
    while left:
        if left & 1:
            if out is None:
                out, have = part, length
            else:  # the windows so far, then length values more
                m = min(len(out), len(part) - have)
                out = out[:m] * np.uint64(power) + part[have : have + m]
                have += length
        left >>= 1
        if left:
            part = part[:-length] * np.uint64(power) + part[length:]
            length, power = 2 * length, power * power & 0xFFFFFFFFFFFFFFFF
    out = out[:n] ^ out[:n] >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def _words(texts) -> list[list[bytes]]:
    return [t.encode("utf-8", "replace").split() if isinstance(t, str) else [] for t in texts]


def chunk_hashes(docs: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all documents in order, and how many windows each has."""
    WORDS.trim()
    each = [window_hashes(word_hashes(w), size) for w in docs]
    return (np.concatenate(each) if each else np.empty(0, np.uint64)), np.array([len(x) for x in each], np.int64)


def removed(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words that windows with these starts cover: maximal intervals by running sums."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def by_bucket(values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted hashes by their highest bits: only buckets that hold any, so that a chunk takes as many steps as it
    has hashes at most, however many buckets there are."""
    if not len(values):
        return []
    bucket = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(values)]
    return [(int(bucket[i]), i, j) for i, j in zip(cuts, cuts[1:])]


def repeated_windows(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """(chunk, bucket, flags): for each chunk's sorted distinct hashes in a bucket one bit, set if it also occurs elsewhere."""

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, _ = chunk_hashes(_words(_ordered(pdf)["text"]), size)
        values, n = np.unique(hashes, return_counts=True)
        chunk = int(pdf["chunk"].iloc[0])
        rows = [(chunk, b, values[i:j].tobytes(), np.packbits(n[i:j] > 1).tobytes()) for b, i, j in by_bucket(values, bits)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "hashes", "own"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        sizes = [len(x) for x in parts]
        ranked = np.sort(np.concatenate(parts))
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        del ranked
        flags = []
        for x, own, n in zip(parts, pdf["own"], sizes):
            at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
            hit = twice[at] == x if len(twice) else np.zeros(n, bool)
            flags.append(np.packbits(hit | np.unpackbits(np.frombuffer(own, np.uint8), count=n).astype(bool)).tobytes())
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "n": sizes, "flags": flags})

    sent = docs.groupBy("chunk").applyInPandas(send, "chunk long, bucket long, hashes binary, own binary")
    return sent.groupBy("bucket").applyInPandas(count, "chunk long, bucket long, n long, flags binary")


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same order each time a chunk is read; rows alike in both columns may change places."""
    return pdf.sort_values(["doc_id", "text"], kind="stable", na_position="first").reset_index(drop=True)


def spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of [first word, last word] intervals) and kept_text (words joined by one space)."""
    kind = dict(docs.dtypes)["doc_id"]
    total = text_bytes(docs)
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    bits = (max(1, -(-total // BUCKET_CHUNK_BYTES)) - 1).bit_length()
    # rows of one id, or of none, are spread by the text; only rows that are alike in both stay together
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("long")
    rows = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    # a partition may hold several chunks, which are worked on one at a time
    rows = rows.repartition(min(n_chunks, PARTITIONS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chunk")
    flags = repeated_windows(rows, size, bits)

    def apply(key, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        words = _words(pdf["text"])
        hashes, n = chunk_hashes(words, size)
        values, inverse = np.unique(hashes, return_inverse=True)
        got = got.sort_values("bucket")
        hit = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=m) for f, m in zip(got["flags"], got["n"])]) if len(got) else np.empty(0, np.uint8)
        if len(hit) != len(values):
            raise RuntimeError("a chunk got back other windows than it sent")
        hit = hit.astype(bool)[inverse] if len(values) else np.empty(0, bool)
        first = np.concatenate([[0], np.cumsum(n)])
        out = []
        for i, w in enumerate(words):
            starts = np.flatnonzero(hit[first[i] : first[i + 1]])
            if not len(starts):
                out.append((pdf["doc_id"][i], len(w), 0, [], b" ".join(w).decode()))
                continue
            gone = removed(len(w), starts, size)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = [x for x, g in zip(w, gone.tolist()) if not g]
            out.append((pdf["doc_id"][i], len(w), int(gone.sum()), [[int(a), int(b) - 1] for a, b in edges.reshape(-1, 2)], b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    both = rows.groupBy("chunk").cogroup(flags.groupBy("chunk"))
    out = both.applyInPandas(apply, "doc_id string, n_words long, n_removed long, removed array<array<long>>, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
g AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM g),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.pos) AS kept, count(*) AS n FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos WHERE c.pos IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
