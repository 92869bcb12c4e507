"""SimHash near-duplicates by pivot distance tables.

Every document gets a fingerprint of its word shingles. Distinct fingerprints are compared, never documents. Each fingerprint has a row
of a pivot table: its Hamming distances to fixed reference fingerprints. By the triangle inequality two fingerprints within r bits
differ by at most r in each coordinate, so pairs with a larger coordinate difference are discarded and only survivors are verified.
Pairs meet in groups that equal bits define. Inside a group the links are reduced to a spanning forest at once, and components are
found by distributed min-label contraction.

Two settings: NARROW has 64 bits and links at 3 or fewer differing bits; two such fingerprints agree on one of four 16-bit blocks and
on one of four 12-bit blocks of the rest, so that sixteen keys of 28 bits lose no link. WIDE links where the Jaccard similarity of the
sets of distinct five-word shingles is 0.8 or more, computed from the sets. Its 384 bits only propose: pairs meet where one of 16 keys
of three least hashes is equal (at 0.8 one is with probability 0.99999) and stay within 96 bits (the mean at 0.8 is 58 with a deviation
of 7; at most 72 and 7.7 for sets of a few shingles). Then all pairs of each component that is proposed are verified, in pairs of blocks
of bounded size, so that a large component is many tasks.

Null or wordless texts have fingerprint zero and link like others. Equal rows and equal fingerprints share a component. Rows with a
null doc_id link only by an equal fingerprint of a row with an id, else their component_id is null. An empty table gives no rows.
Other columns are ignored by the query.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, cut, stored, table

TILE = 512
SPLIT = 4096  #: fingerprints of one key that one task compares; more are split in blocks, a task for each pair of blocks


@dataclass(frozen=True)
class Setting:
    shingle: int = 3
    words: int = 1  #: of 64 bits
    radius: int = 3
    pivots: int = 24
    keys: int = 0  #: keys of three least hashes; 0: the exact keys of 64-bit fingerprints
    distinct: bool = False  #: count equal shingles once

    def __post_init__(self) -> None:
        if self.keys == 0 and (self.radius > 3 or self.words != 1):
            raise ValueError("the exact keys lose no link up to a radius of 3 of 64 bits")


NARROW = Setting()
WIDE = Setting(shingle=5, words=6, radius=96, pivots=8, keys=16, distinct=True)
JACCARD = (4, 5)  #: least similarity of a link of WIDE
BLOCK = 256  #: sets of a block


def pivots(s: Setting) -> np.ndarray:
    """Reference fingerprints [pivot, word] from a fixed seed."""
    return np.random.default_rng(20240229).integers(0, (1 << 64) - 1, (s.pivots, s.words), dtype=np.uint64, endpoint=True)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def _more(h: np.ndarray, words: int) -> np.ndarray:
    """[shingle, word]: the hash itself, then further bits by mixing it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for j in range(1, words):
        x = h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out[:, j] = x ^ x >> np.uint64(31)
    return out


def shingles(text: str | None, s: Setting = NARROW) -> np.ndarray:
    """Hashes of the text's shingles, sorted if they are distinct."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= s.shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts, stops = np.concatenate([[0], ends[:-1]])[: len(words) - s.shingle + 1].tolist(), (ends[s.shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))
    return np.unique(hashes) if s.distinct else hashes


def fingerprint(text: str | None, s: Setting = NARROW) -> bytes:
    """Little-endian bits; a bit is set if it is in over half the shingles' hashes."""
    return majority(shingles(text, s), s)


def majority(hashes: np.ndarray, s: Setting) -> bytes:
    if not len(hashes):
        return bytes(8 * s.words)
    total = np.zeros(64 * s.words, np.int64)
    for lo in range(0, len(hashes), 4080):  # sums of 255 rows fit in a byte
        part = _more(hashes[lo : lo + 4080], s.words).astype("<u8").view(np.uint8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, s: Setting = NARROW) -> DataFrame:
    """(doc_id, fp)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [fingerprint(t, s) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, fp binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


_ODD = np.random.default_rng(20240301).integers(0, 1 << 63, 3 * WIDE.keys, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_keys(hashes: np.ndarray, s: Setting) -> bytes:
    """Keys of a set of shingles, each of its least hashes under three functions."""
    if not len(hashes):
        return bytes(8 * s.keys)
    least = np.full(3 * s.keys, ~np.uint64(0))
    for lo in range(0, len(hashes), 4096):
        x = hashes[None, lo : lo + 4096] * _ODD[:, None]
        np.minimum(least, (x ^ x >> np.uint64(32)).min(1), out=least)
    least = least.reshape(s.keys, 3)
    return b"".join(struct.pack("<Q", xxhash.xxh64_intdigest(k.tobytes(), i)) for i, k in enumerate(least))


def sketches(docs: DataFrame, s: Setting = WIDE) -> DataFrame:
    """(doc_id, fp, digest, keys): fingerprint, digest and keys of the set of shingles."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                x = shingles(text, s)
                rows.append((key, majority(x, s), xxhash.xxh128_digest(x.tobytes()), least_keys(x, s)))
            yield pd.DataFrame(rows, columns=["doc_id", "fp", "digest", "keys"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, fp binary, digest binary, keys binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def one(self, lo: int, hi: int) -> bool:
        """Whether all of lo..hi-1 hang together."""
        first = self.root(lo)
        return all(self.root(i) == first for i in range(lo + 1, hi))


def linked(fp: np.ndarray, near_table: np.ndarray, radius: int, left: int | None = None) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links within one group; with left, of the links of one of the first left fingerprints and one
    of the others. fp: [fingerprint, word]; near_table: [fingerprint, pivot] distances.

    Tiles bound the memory; two tiles that already hang together are skipped, so a dense group costs about its size times a tile.
    """
    n = len(fp)
    forest = _Forest(n)
    for j in range(0 if left is None else left, n, TILE):
        for i in [j, *range(0, j, TILE)] if left is None else range(0, left, TILE):
            lo, hi = slice(i, min(i + TILE, n if left is None else left)), slice(j, min(j + TILE, n))
            if n > TILE and forest.root(i) == forest.root(j) and forest.one(i, lo.stop) and forest.one(j, hi.stop):
                continue
            near = np.ones((lo.stop - i, hi.stop - j), bool)
            for p in range(near_table.shape[1]):
                near &= np.abs(near_table[lo, p][:, None] - near_table[hi, p][None, :]) <= radius
            a, b = np.nonzero(near)
            keep = a + i < b + j
            a, b = a[keep] + i, b[keep] + j
            for k in range(0, len(a), 65536):  # survivors are verified
                x, y = a[k : k + 65536], b[k : k + 65536]
                ok = distance(fp[x], fp[y]) <= radius
                for u, v in zip(x[ok].tolist(), y[ok].tolist()):
                    if forest.join(u, v):
                        yield u, v


def group_keys(fp: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of 64-bit fingerprints [fingerprint, 1]: two that link share at least one (see the module's text)."""
    fp = fp[:, 0]
    for i in range(4):
        block = fp >> np.uint64(16 * i) & np.uint64(0xFFFF)
        low = fp & np.uint64((1 << 16 * i) - 1)
        rest = low | fp >> np.uint64(16 * (i + 1)) << np.uint64(16 * i) if i < 3 else low
        for j in range(4):
            sub = rest >> np.uint64(12 * j) & np.uint64(0xFFF)
            yield (np.uint64(4 * i + j) << np.uint64(28) | block << np.uint64(12) | sub).astype(np.int64)


def links(heads: DataFrame, s: Setting = NARROW, split: int = SPLIT) -> DataFrame:
    """heads: distinct (fp, head), with keys if the setting has them. Returns (a, b), heads whose links span every component of the graph of linked fingerprints."""
    refs = pivots(s)

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), "<u8").reshape(-1, s.words)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for key in np.frombuffer(b"".join(pdf["keys"]), "<i8").reshape(-1, s.keys).T if s.keys else group_keys(matrix(pdf["fp"])):
                yield pd.DataFrame({"key": key, "head": pdf["head"], "fp": pdf["fp"]})

    def solve(key: np.ndarray, head: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = stops - starts
        found: list[tuple[int, int]] = []
        two = starts[size == 2]  # most groups are pairs: all at once
        if len(two):
            x, y = fp[two], fp[two + 1]
            ok = np.ones(len(two), bool)
            for r in refs:
                ok &= np.abs(distance(x, r) - distance(y, r)) <= s.radius
            ok[ok] = distance(x[ok], y[ok]) <= s.radius
            found += zip(head[two[ok]].tolist(), head[two[ok] + 1].tolist())
        more = size > 2
        for a, b in zip(starts[more].tolist(), stops[more].tolist()):
            part, left = fp[a:b], int((side[a:b] == 0).sum())
            near = np.column_stack([distance(part, r) for r in refs])
            found += [(int(head[a + x]), int(head[a + y])) for x, y in linked(part, near, s.radius, left if 0 < left < b - a else None)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows come in; a group may reach over several batches. side, if any: 1 for the second of two blocks."""
        wait: list[tuple[np.ndarray, ...]] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf["key"].to_numpy(np.int64)
            now = (key, pdf["head"].to_numpy(np.int64), matrix(pdf["fp"]), pdf["side"].to_numpy() if "side" in pdf else np.zeros(len(pdf), np.int8))
            at = int(np.searchsorted(key, key[-1]))
            if at or wait and wait[-1][0][-1] != key[-1]:
                yield solve(*map(np.concatenate, zip(*wait, tuple(x[:at] for x in now))))
                wait = []
            wait.append(tuple(x[at:] for x in now))
        if wait:
            yield solve(*map(np.concatenate, zip(*wait)))

    n = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = heads.where("head is not null").select(F.col("head").cast("long").alias("head"), "fp", *["keys"] * bool(s.keys)).mapInPandas(keys, "key long, head long, fp binary")
    # keys of many fingerprints: blocks of bounded size, and a group for each pair of blocks
    large = stored(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / split).cast("long").alias("blocks")).where("blocks > 1"), "large-keys")
    if large.isEmpty():
        return keyed.repartition(n, "key").sortWithinPartitions("key", "head").mapInPandas(group, "a long, b long").distinct()
    few = keyed.join(large, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key", "head").mapInPandas(group, "a long, b long")
    many = keyed.join(large, "key").withColumn("mine", F.pmod(F.xxhash64("head"), F.col("blocks")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    many = many.select(pair.alias("key"), (F.col("mine") > F.col("other")).cast("int").alias("side"), F.col("mine"), "other", "head", "fp")
    many = many.repartition(n, "key").sortWithinPartitions("key", "side", "head").select("key", "side", "head", "fp").mapInPandas(group, "a long, b long")
    return few.unionByName(many).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an edge reaches. Alternates large-star and small-star until nothing moves."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u hang on the least of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if size == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        size = now


def group(docs: DataFrame, s: Setting = NARROW) -> DataFrame:
    """(doc_id, fp, component_id)."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), s), "fingerprints")
    heads = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("head")))
    # a node is the least doc_id of its fingerprint, so the least node of a component is its least doc_id
    nodes = components(links(heads, s))
    named = heads.join(nodes, F.col("head") == F.col("node"), "left").select("fp", F.coalesce("label", "head").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def alike(sets: list[np.ndarray], left: int | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets whose Jaccard similarity is JACCARD or more; with left, of the pairs of one of
    the first left sets and one of the others."""
    num, den = JACCARD
    n = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(code.max()) + 1, bool)
    forest, out = _Forest(len(sets)), []
    for i in range(len(sets) - 1 if left is None else left):
        first = i + 1 if left is None else left
        mark[code[begin[i] : begin[i + 1]]] = True
        both = np.add.reduceat(mark[code[begin[first] :]], begin[first:-1] - begin[first], dtype=np.int64)
        mark[code[begin[i] : begin[i + 1]]] = False
        for j in np.flatnonzero((num + den) * both >= num * (n[i] + n[first:])).tolist():
            if forest.join(i, j + first):
                out.append((i, j + first))
        if len(out) == len(sets) - 1:
            break
    return out


def verified(docs: DataFrame, proposed: DataFrame, s: Setting = WIDE) -> DataFrame:
    """proposed: (node, label) of components(). Returns (a, b), links that span what hangs together within each proposed component."""
    every = proposed.unionByName(proposed.select(F.col("label").alias("node"), "label").distinct())
    large = every.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    every = every.join(F.broadcast(large), "label", "left").select("node", "label", F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["members"] = [shingles(t, s).astype("<u8").tobytes() for t in pdf.pop("text")]
            yield pdf

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(every, "node")
    rows = rows.select("node", "label", "blocks", "text").mapInPandas(cut_up, "node long, label long, blocks long, members binary")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.where(F.length("members") > 0).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "members")

    def solve(part: list[tuple]) -> list[tuple[int, int]]:
        lo, hi = part[0][1:3]
        nodes, sets = [r[4] for r in part], [np.frombuffer(r[5], "<u8") for r in part]
        left = None if lo == hi else sum(r[3] == lo for r in part)
        if len(part) < 2 or left in (0, len(part)):
            return []
        return [(nodes[x], nodes[y]) for x, y in alike(sets, left)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows come in; a pair of blocks may reach over several batches."""
        part: list[tuple] = []
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False, name=None):
                if part and part[0][:3] != r[:3]:
                    found += solve(part)
                    part = []
                part.append(r)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if part:
            yield pd.DataFrame(solve(part), columns=["a", "b"], dtype="int64")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi", "mine", "node")
    return rows.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def near_copies(docs: DataFrame, s: Setting = WIDE) -> DataFrame:
    """(doc_id, fp, component_id) by exact similarity of the sets of shingles."""
    docs = docs.select("doc_id", "text")
    prints = stored(sketches(docs, s), "sketches")
    heads = cut(prints.groupBy("fp", "digest").agg(F.min("doc_id").alias("head"), F.first("keys").alias("keys")))
    nodes = components(verified(docs, components(links(heads, s)), s))
    named = heads.join(nodes, F.col("head") == F.col("node"), "left").select("fp", "digest", F.coalesce("label", "head").alias("component_id"))
    return prints.select("doc_id", "fp", "digest").join(named, ["fp", "digest"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(table(spark, sf_dir, "documents"))
    # the bytes are little-endian, the text is not
    return found.select("doc_id", F.lower(F.hex(F.concat(*[F.substring("fp", i, 1) for i in range(8, 0, -1)]))).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least doc_id (all of its rows). Documents with a null id stay."""
    docs = docs.select(*DOC_COLUMNS)
    gone = near_copies(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id"))
    return docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
