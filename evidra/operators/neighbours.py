"""Exact nearest neighbours by squared Euclidean distance."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned

QUERY_BLOCK_BYTES = 8_000_000
GATHERED = 131_072  #: points of a task that are put in order together
LEAF, AT_ONCE = 256, 1024  #: queries or points of a box; points that a box of queries meets at a time
CELL, DRAWN = 65_536, 100_000  #: rows of a cell that are aimed at; rows that the bounds of cells are drawn from
NONE = np.iinfo(np.int64).max
NEAR = "array<struct<distance2: double, id: bigint, label: bigint>>"


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row, ties by the smaller id."""
    if d.shape[1] <= k:
        order = np.lexsort((ids, d), axis=1)
        return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
    row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])  # k or more of each row
    d, ids = d[row, column], ids[row, column]
    order = np.lexsort((ids, d, row))
    first = order[np.searchsorted(row, np.arange(row[-1] + 1))[:, None] + np.arange(k)]
    return d[first], ids[first]


def _leaves(x: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, cut in halves along the widest side until so few are left, and where each leaf begins (and the last ends)."""
    left, order, ends = [np.arange(len(x))], [], [0]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            order.append(rows)
            ends.append(ends[-1] + len(rows))
            continue
        part = x[rows]
        rows = rows[np.argpartition(part[:, np.ptp(part, 0).argmax()], len(rows) // 2)]
        left += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return np.concatenate(order), np.array(ends)


def _boxes(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(x, ends[:-1]), np.maximum.reduceat(x, ends[:-1])


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances; in few dimensions by differences, so that equal pairs are equal in the last bit."""
    if q.shape[1] <= 16:
        d = np.zeros((len(q), len(p)))
        for i in range(q.shape[1]):
            gap = q[:, i, None] - p[None, :, i]
            d += gap * gap
        return d
    d = np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * q @ p.T, 0.0)
    close = d < 1e-6  # cancellation: these are computed by differences
    if close.any():
        a, c = np.nonzero(close)
        d[a, c] = ((q[a] - p[c]) ** 2).sum(1)
    return d


def _outside(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes."""
    d = np.zeros((len(q), len(low)))
    for x, a, b in zip(q.T, low.T, high.T):
        gap = np.maximum(np.maximum(a - x[:, None], x[:, None] - b), 0)
        d += gap * gap
    return d


def _gathered(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, x) of so many points at a time."""
    ids, x, n = [], [], 0
    for pdf in batches:
        for lo in range(0, len(pdf), size):
            few = pdf.iloc[lo : lo + size]
            if n and n + len(few) > size:
                yield np.concatenate(ids), np.vstack(x)
                ids, x, n = [], [], 0
            ids.append(few["id"].to_numpy(np.int64))
            x.append(np.vstack(few["x"]).astype(np.float64))
            n += len(few)
    if n:
        yield np.concatenate(ids), np.vstack(x)


def nearest(
    qid: np.ndarray, q: np.ndarray, chunks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, exclude_self: bool, within: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, squared distances, ids) of the k nearest of chunks of points, inf where there are fewer. within: only points up to that
    squared distance of each query are of interest.

    Queries and points lie in boxes of LEAF. A box of queries meets the points' boxes nearest first, AT_ONCE points at a time, and no
    box that is further away than the worst of its k-th neighbours so far; a box as far as that is met, as a tie goes by the id. In few
    dimensions only those of its queries meet them whose own k-th neighbour is as far.
    """
    order, q_ends = _leaves(q)
    qid, q = qid[order], q[order]
    q_low, q_high = _boxes(q, q_ends)
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), NONE)
    if within is not None:
        best_d[:] = within[order, None]
    for ids, p in chunks:
        order, p_ends = _leaves(p)
        ids, p = ids[order], p[order]
        p_low, p_high = _boxes(p, p_ends)
        few = q.shape[1] <= 16
        slack = 0.0 if few else 1e-9 * (1 + (q * q).sum(1).max() + (p * p).sum(1).max())
        for g, (lo, hi) in enumerate(zip(q_ends[:-1], q_ends[1:])):
            far = (np.maximum(0, np.maximum(p_low - q_high[g], q_low[g] - p_high)) ** 2).sum(1) * (1 - 1e-12) - slack
            turn = np.argsort(far, kind="stable")
            for i in range(0, len(turn), AT_ONCE // LEAF):
                worst = best_d[lo:hi, -1]
                met = turn[i : i + AT_ONCE // LEAF]
                met = met[far[met] <= worst.max()]
                if not len(met):
                    break
                near = np.arange(lo, hi)
                if few and (i or within is not None):  # the queries of a box by themselves
                    hit = _outside(q[lo:hi], p_low[met], p_high[met]) * (1 - 1e-12) <= worst[:, None]
                    near, met = near[hit.any(1)], met[hit.any(0)]
                    if not len(near):
                        continue
                at = np.concatenate([np.arange(p_ends[j], p_ends[j + 1]) for j in met])
                d = _distances(q[near], p[at])
                if exclude_self:
                    d[qid[near, None] == ids[None, at]] = np.inf
                some = (d <= best_d[near, -1:]).any(1)
                if some.any():
                    near, d = near[some], d[some]
                    best_d[near], best_i[near] = _best(np.hstack([best_d[near], d]), np.hstack([best_i[near], np.broadcast_to(ids[at], d.shape)]), k)
    best_d[best_i == NONE] = np.inf
    return qid, best_d, best_i


def knn(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(id, neighbour, distance2, rank) for queries (id, x) against points (id, x), ids being longs.

    Queries are taken in blocks of bounded size; each block is broadcast and every partition of points keeps its own k best, which a
    window per query merges: partitions x k rows a query are shuffled, never a pair of all with all. A task holds GATHERED points, its block of
    queries and LEAF x AT_ONCE distances, whatever the tables.
    """
    spark = queries.sparkSession
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, distance2 double, rank int")
    blocks = max(1, -(-n * (dim or 1) * 8 // QUERY_BLOCK_BYTES))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "x").toPandas()
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), np.vstack(rows["x"]).astype(np.float64)))

        def local(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, best_d, best_i = nearest(*shared.value, _gathered(batches, GATHERED), k, exclude_self)
            ok = np.isfinite(best_d)
            if ok.any():
                r = np.repeat(qid, best_d.shape[1]).reshape(best_d.shape)
                yield pd.DataFrame({"id": r[ok], "neighbour": best_i[ok], "distance2": best_d[ok]})

        part = points.select("id", "x").mapInPandas(local, "id long, neighbour long, distance2 double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("id").orderBy("distance2", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Cells:
    """Space cut in cells at values of single columns. A row above the cut of a node goes to the right; children below 0 are ~cell."""

    columns: list[str]
    dims: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    n: int

    @classmethod
    def cut(cls, columns: list[str], x: np.ndarray, n: int) -> Cells:
        """n cells at most of about as many rows of x each; rows that are alike are not parted."""
        dims, cuts, children = [], [], []
        left, cells = [(-len(x), 0, x, None)], 0
        while left:
            size, _, part, parent = heapq.heappop(left)
            wide = np.ptp(part, 0) if len(part) else np.zeros(1)
            if cells + len(left) + 1 < n and wide.max() > 0:
                d = int(wide.argmax())
                values = np.sort(part[:, d])
                cut = values[(len(part) - 1) // 2]
                if cut == values[-1]:
                    cut = values[np.searchsorted(values, cut) - 1]
                node, right = len(dims), part[:, d] > cut
                dims.append(d), cuts.append(cut), children.append([0, 0])
                for side, rows in enumerate((part[~right], part[right])):
                    heapq.heappush(left, (-len(rows), 2 * node + side + 1, rows, (node, side)))
            else:
                node, cells = ~cells, cells + 1
            if parent:
                children[parent[0]][parent[1]] = node
        return cls(columns, np.array(dims, int), np.array(cuts, float), np.array(children, int).reshape(-1, 2), cells)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.dims) else -1)
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            node[live] = self.children[at, (x[live, self.dims[at]] > self.cuts[at]).astype(int)]
            live = live[node[live] >= 0]
        return ~node

    def located(self, df: DataFrame) -> DataFrame:
        """df with the cell of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(self.of(_table(b, self.columns)), pa.int32())], names=[*b.schema.names, "cell"])

        return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", cell int")

    def boxes(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest values of each cell's rows; a cell without rows is far from everything."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((self.n, len(columns)), np.inf), np.full((self.n, len(columns)), -np.inf)
            for b in batches:
                x = _table(b, columns)
                cell = self.of(x)
                np.minimum.at(low, cell, x)
                np.maximum.at(high, cell, x)
            met = np.flatnonzero(low[:, 0] <= high[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *map(pa.array, low[met].T), *map(pa.array, high[met].T)], names=names)

        names = ["cell", *[f"{c}_{e}" for e in ("low", "high") for c in columns]]
        found = df.select(*columns).mapInArrow(run, "cell int, " + ", ".join(f"{c} double" for c in names[1:]))
        low, high = np.full((self.n, len(columns)), np.inf), np.full((self.n, len(columns)), np.inf)
        for r in found.groupBy("cell").agg(*[(F.min if c.endswith("_low") else F.max)(c) for c in names[1:]]).collect():  # a row a cell
            low[r[0]], high[r[0]] = r[1 : 1 + len(columns)], r[1 + len(columns) :]
        return low, high


def _table(batch: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c)) for c in columns])


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def near_places(rows: DataFrame, asked: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(columns, near): of each distinct place of asked the k nearest rows of all, nearest first, ties by the smaller id. rows: (id long,
    label long, columns double), asked: (columns); no null, and ids are of one row each. near: array of (distance2, id, label). For few
    dimensions: each row takes part in its own cell and its query in those that its k-th neighbour's distance reaches.

    Of rows at one place the k least ids can be neighbours, no others. Space is cut in cells of about CELL of these, by values of some
    rows drawn by hash, which decide where cells end and nothing else. Each query meets its own cell first and then the cells that are
    no further than its k-th neighbour so far; a task holds one cell and the queries that meet it, and nothing travels through the
    driver but a cell's bounds.
    """
    w = Window.partitionBy(*columns).orderBy("id")
    points = pinned(rows.select("id", "label", *columns).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"), "points")
    n = points.count()
    drawn = points.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // DRAWN))) == 0).select(*columns).toArrow()
    cores = points.sparkSession.sparkContext.defaultParallelism
    cells = Cells.cut(columns, _table(drawn, columns), max(-(-n // CELL), min(cores, -(-n // (16 * LEAF)))))
    low, high = cells.boxes(points)
    slack = 1e-9 * (1 + 2 * (np.maximum(abs(low), abs(high))[np.isfinite(low[:, 0])] ** 2).sum(1).max(initial=0)) if len(columns) > 16 else 0.0

    def near(rows: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The queries in the order of their boxes, as numbers; their places, the worst distance, and what is near."""
        q, ids = _table(queries, columns), rows.column("id").to_numpy()
        within = queries.column("within").to_numpy() if "within" in queries.column_names else None
        order, d, i = nearest(np.arange(len(q)), q, iter([(ids, _table(rows, columns))] if len(ids) else []), k, False, within)
        ok, by = i != NONE, np.argsort(ids)
        label = rows.column("label").to_numpy()[by[np.searchsorted(ids, i[ok], sorter=by)]] if len(ids) else np.empty(0, np.int64)
        found = pa.StructArray.from_arrays([pa.array(d[ok]), pa.array(i[ok]), pa.array(label, pa.int64())], names=["distance2", "id", "label"])
        return q[order], d[:, -1], ok.sum(1), found

    def own(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(queries):
            return first_kind.empty_table()
        cell = queries.column("cell")[0].as_py()
        q, worst, sizes, found = near(rows, queries)
        others, met = [], []
        for a in range(0, len(q), AT_ONCE):
            part = q[a : a + AT_ONCE]
            with np.errstate(invalid="ignore"):
                far = _outside(part, low, high) * (1 - 1e-12) - slack
            hit = (far <= worst[a : a + AT_ONCE, None]) & np.isfinite(low[:, 0])
            hit[:, cell] = False
            others.append(np.nonzero(hit)[1])
            met.append(hit.sum(1))
        lists = [_listed(found, sizes), _listed(pa.array(np.concatenate(others), pa.int32()), np.concatenate(met))]
        return pa.Table.from_arrays([*map(pa.array, q.T), pa.array(worst), *lists], schema=first_kind)

    def other(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(queries):
            return second_kind.empty_table()
        q, _, sizes, found = near(rows, queries)
        some = np.flatnonzero(sizes)
        return pa.Table.from_arrays([*map(pa.array, q[some].T), _listed(found, sizes[some])], schema=second_kind)

    doubles, struct = [(c, pa.float64()) for c in columns], pa.struct([("distance2", pa.float64()), ("id", pa.int64()), ("label", pa.int64())])
    second_kind = pa.schema([*doubles, ("near", pa.list_(struct))])
    first_kind = pa.schema([*doubles, ("within", pa.float64()), ("near", pa.list_(struct)), ("others", pa.list_(pa.int32()))])
    places = ", ".join(f"{c} double" for c in columns)
    dealt = lambda df: df.repartition(cells.n, "cell").groupBy("cell")  # noqa: E731  (a number, or small cells would share a task)
    held = dealt(cells.located(points))
    queries = dealt(cells.located(asked.select(*columns).distinct()))
    first = pinned(held.cogroup(queries).applyInArrow(own, f"{places}, within double, near {NEAR}, others array<int>"), "near")
    crossing = first.where("size(others) > 0")
    far = dealt(crossing.select(*columns, "within", F.explode("others").alias("cell")))
    second = held.cogroup(far).applyInArrow(other, f"{places}, near {NEAR}")
    lists = crossing.select(*columns, "near").unionByName(second).groupBy(*columns).agg(F.flatten(F.collect_list("near")).alias("near"))
    return first.where("size(others) = 0").select(*columns, "near").unionByName(lists.withColumn("near", F.slice(F.array_sort("near"), 1, k)))
