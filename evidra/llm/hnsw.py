"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard, results merged.

Rows with equal vectors are a class; a class is indexed once, with its KEEP least ids, as no answer can hold more of them. Classes are
dealt by a hash of the vector to shards of about SHARD_ROWS, so that a third of all rows being copies of one vector is one class of one
shard. A shard's graph is built in one task and stored as flat arrays: one of fixed width for each level, -1 where a place is free, its
nodes numbered from the top level down, so that level l holds the first n_l nodes. Queries with equal vectors are searched once, in
blocks of about BLOCK_ROWS; each pair of a block and a shard is a task's work, of bounded size, and the shards' best are merged.

Inner products are not a metric: a graph links by angles after each vector gets one more component, which brings all of a shard to the
length of its longest; a query's is 0, so that the order by angle is that by inner product. Graphs work in single precision; what a
search has found is scored again from the original vectors in double precision, and ranked by that, ties by the smaller id.

Vectors null, zero, or holding null or non-finite components take no part, nor do null ids. Shorter vectors count as ended by zeros.
Rows alike in id and vector count once. Rows of the query's own id are never its answer; an id with several vectors is as many queries.
Other columns are ignored. An empty table gives no rows; where there are fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARD_ROWS = 8_192  # rows of one graph
BLOCK_ROWS = 4_096  # queries of one task
LINKS = 16  # of a new node on each level; a node holds twice as many
BUILD_BEAM = 96
SEARCH_BEAM = 128
BATCH = 256  # nodes that are linked side by side
INDEX = "shard int, dim int, vectors binary, links array<binary>, sizes binary, ids binary"


class Graph:
    """Vectors (one a class) and for each level an array of links, nodes numbered from the top level down."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, width: int = 2 * LINKS) -> None:
        unit = vectors / np.abs(vectors).max()  # squares stay finite
        unit /= np.sqrt((unit * unit).sum(1).max())
        rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
        self.x = np.concatenate([unit, rest[:, None]], 1).astype(np.float32)
        self.links, self.width = links or [], width

    def around(self, q: np.ndarray, at: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the best nodes found for each query (best first, -1 where there are fewer), from the nodes at."""
        links, n = self.links[level], len(q)
        seen = np.zeros((n, len(links)), bool)
        ids = np.full((n, beam), -1, np.int64)
        near = np.full((n, beam), -np.inf, np.float32)
        todo = np.zeros((n, beam), bool)
        m = at.shape[1]
        ids[:, :m] = at
        rows, places = np.nonzero(at >= 0)
        near[rows, places] = np.einsum("ij,ij->i", self.x[at[rows, places]], q[rows])
        todo[rows, places] = True
        seen[rows, at[rows, places]] = True
        live = np.flatnonzero(todo.any(1))
        while len(live):
            step = np.where(todo[live], near[live], -np.inf).argmax(1)
            todo[live, step] = False
            met = links[ids[live, step]]
            rows, places = np.nonzero((met >= 0) & ~seen[live[:, None], np.maximum(met, 0)])
            new, own = met[rows, places], live[rows]
            seen[own, new] = True
            gained = np.full(met.shape, -np.inf, np.float32)
            gained[rows, places] = np.einsum("ij,ij->i", self.x[new], q[own])
            better = np.flatnonzero(gained.max(1) > near[live].min(1))
            if len(better):
                mine = live[better]
                all_near = np.concatenate([near[mine], gained[better]], 1)
                keep = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
                near[mine] = np.take_along_axis(all_near, keep, 1)
                ids[mine] = np.take_along_axis(np.concatenate([ids[mine], met[better]], 1), keep, 1)
                todo[mine] = np.take_along_axis(np.concatenate([todo[mine], np.ones(met[better].shape, bool)], 1), keep, 1) & (near[mine] > -np.inf)
            live = live[todo[live].any(1)]
        order = np.argsort(-near, 1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        return np.where(near > -np.inf, np.take_along_axis(ids, order, 1), -1), near

    def spread(self, ids: np.ndarray, near: np.ndarray, want: int) -> np.ndarray:
        """Of each row's candidates (best first) up to want: those nearer to the node than to any taken before, then the nearest others."""
        vectors = self.x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        n, m = ids.shape
        taken = np.zeros((n, m), bool)
        closest = np.full((n, m), -np.inf, np.float32)  # of each candidate, to one that was taken
        for j in range(m):
            fits = (ids[:, j] >= 0) & (closest[:, j] < near[:, j]) & (taken.sum(1) < want)
            taken[:, j] = fits
            closest = np.where(fits[:, None], np.maximum(closest, between[:, :, j]), closest)
        rank = np.where(ids < 0, 2, np.where(taken, 0, 1))
        first = np.argsort(rank, 1, kind="stable")[:, :want]
        return np.take_along_axis(np.where(ids < 0, -1, ids), first, 1)

    def link_back(self, nodes: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Links from the chosen to the new nodes; a full list is spread again over what it held and what is new."""
        links = self.links[level]
        rows, places = np.nonzero(chosen >= 0)
        to, new = chosen[rows, places], nodes[rows]
        order = np.lexsort((new, to))
        to, new = to[order], new[order]
        while len(to):
            head = np.r_[True, to[1:] != to[:-1]]
            nth = np.arange(len(to)) - np.maximum.accumulate(np.where(head, np.arange(len(to)), 0))
            now = nth < self.width // 2
            targets, row = np.unique(to[now], return_inverse=True)
            for a in range(0, len(targets), 512):
                part = (row >= a) & (row < a + 512)
                t = targets[a : a + 512]
                more = np.full((len(t), self.width // 2), -1, np.int64)
                more[row[part] - a, nth[now][part]] = new[now][part]
                have = np.concatenate([links[t], more], 1)
                full = (have >= 0).sum(1) > self.width
                packed = np.take_along_axis(have, np.argsort(have < 0, 1, kind="stable")[:, : self.width], 1)
                links[t[~full]] = packed[~full]
                if full.any():
                    held, mid = have[full], t[full]
                    near = np.einsum("ijk,ik->ij", self.x[np.maximum(held, 0)], self.x[mid])
                    near[held < 0] = -np.inf
                    best = np.argsort(-near, 1, kind="stable")
                    links[mid] = self.spread(np.take_along_axis(held, best, 1), np.take_along_axis(near, best, 1), self.width)
            to, new = to[~now], new[~now]

    def build(self, levels: np.ndarray) -> Graph:
        """Links all nodes, whose levels fall; in batches whose nodes also see those before them in the batch."""
        n, top = len(self.x), int(levels[0])
        counts = [int((levels >= level).sum()) for level in range(top + 1)]
        self.links = [np.full((c, self.width), -1, np.int32) for c in counts]
        for own in range(top, -1, -1):
            a, stop = (counts[own + 1] if own < top else 0), counts[own]
            for a in range(a, stop, BATCH):
                nodes = np.arange(a, min(stop, a + BATCH))
                q = self.x[nodes]
                among = q @ q.T
                among[np.triu_indices(len(nodes))] = -np.inf  # only nodes before
                at = np.zeros((len(nodes), 1), np.int64)
                for level in range(top, -1, -1):
                    if a == 0:
                        ids, near = np.empty((len(nodes), 0), np.int64), np.empty((len(nodes), 0), np.float32)
                    else:
                        ids, near = self.around(q, at, level, 1 if level > own else BUILD_BEAM)
                        at = ids[:, : 1 if level > own else 8]
                    if level > own:
                        continue
                    ids = np.concatenate([ids, np.broadcast_to(nodes, among.shape)], 1)
                    near = np.concatenate([near, among], 1)
                    best = np.argsort(-near, 1, kind="stable")[:, :BUILD_BEAM]
                    near = np.take_along_axis(near, best, 1)
                    ids = np.where(near > -np.inf, np.take_along_axis(ids, best, 1), -1)
                    chosen = self.spread(ids, near, self.width // 2)
                    self.links[level][nodes, : chosen.shape[1]] = chosen
                    self.link_back(nodes, chosen, level)
        self.connect()
        return self

    def connect(self) -> None:
        """Gives every node a way from the first one on the lowest level: vectors that lie much closer to each other than to all others may
        have linked among themselves only. What no way leads to is linked from the nearest node that has a place free."""
        links, n = self.links[0], len(self.x)
        met, fresh = np.zeros(n, bool), np.array([0])
        while True:
            while len(fresh):
                met[fresh] = True
                ahead = np.unique(links[fresh])
                fresh = ahead[(ahead >= 0) & ~met[ahead]]
            if met.all():
                break
            lone = int(np.flatnonzero(~met)[0])
            free = np.flatnonzero(met & (links < 0).any(1))
            if not len(free):
                links = np.concatenate([links, np.full((n, 1), -1, links.dtype)], 1)
                free = np.flatnonzero(met)
            near = int(free[(self.x[free] @ self.x[lone]).argmax()])
            links[near, int((links[near] < 0).argmax())] = lone
            fresh = np.array([lone])
        self.links[0] = links

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Ids of the nodes found for each query of as many components as the vectors had, -1 where there are fewer than beam."""
        q = q / np.abs(q).max(1, keepdims=True)
        q = np.concatenate([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros((len(q), 1))], 1).astype(np.float32)
        out = []
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            at = np.zeros((len(part), 1), np.int64)
            for level in range(len(self.links) - 1, 0, -1):
                at = self.around(part, at, level, 1)[0]
            at = np.concatenate([at, np.where(at == 0, -1, 0)], 1) if beam > 1 else at  # from the first node there is a way to all
            out.append(self.around(part, at, 0, beam)[0])
        return np.concatenate(out)


def levels_of(n: int, links: int, seed: int) -> np.ndarray:
    """Falling levels of n nodes, geometric: one in links goes up; the same for the same shard in every attempt."""
    drawn = np.random.default_rng(seed).random(n)
    return np.sort((-np.log(1 - drawn) / np.log(links)).astype(np.int64))[::-1]


def part_taken(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def rows_of(points: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, key (of the class) and vector, one row for each id and vector that takes part."""
    v = points.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & part_taken(F.col("vector")))
    v = v.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("vector").cast("array<double>").cast("array<string>"), " "), 256)))
    return v.groupBy("id", "key").agg(F.first("vector").alias("vector"))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """key, vector and the keep least ids (ascending) of each class; tasks cut a class before it is shuffled."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = rows.withColumn("_n", nth).where(F.col("_n") <= keep)
    return few.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def _stack(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build_index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, links: int = LINKS) -> DataFrame:
    """The written index, a row a shard: vectors, a flat array of links for each level, and the ids of each node."""
    classes = stored(classes_of(rows, keep), "hnsw-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shards = max(1, -(-n // shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")  # the same graph in every attempt
        pdf = pdf.iloc[np.random.default_rng(0).permutation(len(pdf))]
        vectors = _stack(pdf["vector"], dim)
        graph = Graph(vectors, width=2 * links).build(levels_of(len(pdf), links, len(pdf)))
        sizes = np.array([len(i) for i in pdf["ids"]], np.int64)
        row = (int(pdf["shard"].iloc[0]), dim, vectors.tobytes(), [x.tobytes() for x in graph.links], sizes.tobytes(), np.concatenate(list(pdf["ids"])).astype(np.int64).tobytes())
        return pd.DataFrame([row], columns=["shard", "dim", "vectors", "links", "sizes", "ids"])

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, INDEX), "hnsw-index")


def _loaded(row, links: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    sizes = np.frombuffer(row["sizes"], np.int64)
    # the lowest level holds all nodes, and may be wider
    flat = [np.frombuffer(x, np.int32).reshape((len(sizes), -1) if not level else (-1, 2 * links)) for level, x in enumerate(row["links"])]
    return Graph(vectors, flat, 2 * links), vectors, np.r_[0, np.cumsum(sizes)], np.frombuffer(row["ids"], np.int64)


def search_index(index: DataFrame, queries: DataFrame, keep: int, beam: int = SEARCH_BEAM, block_rows: int = BLOCK_ROWS, links: int = LINKS) -> DataFrame:
    """key, found: the best keep (product, id) of all shards for each distinct query vector (key, vector), best first."""
    n, shards = queries.count(), index.count()
    blocks = max(1, -(-n // block_rows))
    spread = queries.select("key", "vector", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    each = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(pdf: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(row):
            return pd.DataFrame({"key": [], "product": [], "id": []})
        graph, vectors, ends, ids = _loaded(row.iloc[0], links)
        q = _stack(pdf["vector"], max(vectors.shape[1], max(map(len, pdf["vector"]))))[:, : vectors.shape[1]]
        found = graph.search(q, min(max(beam, keep), len(vectors)))
        out = []
        for key, mine, vector in zip(pdf["key"], found, q):
            mine = mine[mine >= 0]
            product = (vectors[mine] * vector).sum(1)
            best = np.argsort(-product, kind="stable")[:keep]
            edge = product >= product[best[-1]]  # all that tie with the last, as ids decide
            members = [(-p, i) for node, p in zip(mine[edge].tolist(), product[edge].tolist()) for i in ids[ends[node] : ends[node + 1]].tolist()]
            out += [(key, -p, i) for p, i in sorted(members)[:keep]]
        return pd.DataFrame(out, columns=["key", "product", "id"])

    pairs = each.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block"))
    found = pairs.applyInPandas(search, "key binary, product double, id long")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("product"), "id"))
    few = found.withColumn("_n", nth).where(F.col("_n") <= keep)
    best = F.array_sort(F.collect_list(F.struct("_n", "id", "product")))
    return few.groupBy("key").agg(best.alias("found"))


def neighbours(points: DataFrame, asked: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row with asked (a condition on ``id``) the k nearest others that the index finds."""
    rows = stored(rows_of(points, vec_id, vector), "hnsw-rows")
    keep = k + 1  # with the query's own row among them
    index = build_index(rows, keep)
    queries = rows.where(asked)
    found = search_index(index, queries.groupBy("key").agg(F.first("vector").alias("vector")), keep)
    each = queries.select(F.col("id").alias("query_id"), "key").join(found, "key")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    each = each.select("query_id", F.posexplode(others).alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.product").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, 20)
