"""Zero-dimensional persistence: the edge lengths of a minimum spanning tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned, previous, running
from .relational import quantiles

BLOCK = 1000  #: points of a block
TEAMS, TEAM = 12, 64  #: blocks go in so many teams, of so many blocks at most; a pair of teams is a task's work, so that a point is sent once a team
TASK_EDGES = 500_000  #: beyond so many edges a task drops those that close a cycle
PIVOTS = 1024  #: at most, whatever the points; the tables of all pairs of pivots are small
LAST_EDGES = 2_000_000  #: so many edges are left to one task; of more, components are joined by rounds first


def tree(d2: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree of a small matrix of squared distances (Prim)."""
    n = len(d2)
    best, near = d2[0].copy(), np.zeros(n, int)
    done = np.zeros(n, bool)
    done[0] = True
    out = []
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, best).argmin())
        out.append((int(near[j]), j, float(best[j])))
        done[j] = True
        closer = d2[j] < best
        best, near = np.where(closer, d2[j], best), np.where(closer, j, near)
    return out


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest (Kruskal); ties by the ends."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for i in np.lexsort((b, a, d)):
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            up[x] = y
            keep.append(i)
    return np.array(keep, int)


def persistence(points: DataFrame, block: int = BLOCK, pivots: int = PIVOTS, last: int = LAST_EDGES) -> DataFrame:
    """(length): the n - 1 edge lengths of a minimum spanning tree of points (id long, x array<double>).

    Equal points are one point and as many edges of length 0. The others lie in the cell of the nearest of some pivots (points
    themselves), cells in blocks. The tree of all lies in the union of the trees of every two blocks. Two cells need no such trees if
    their points are further apart than a path between them takes: by the triangle inequality the distance of the pivots less both
    radii is least, and the longest edge of such a path is known from the trees of each block with its pivot and the tree of the pivots.
    Blocks meet in pairs of teams, and what their trees leave is one forest a task. So points and edges travel as often as there are
    teams: that grows with the input as long as teams can grow, and work with the pairs of blocks.
    What is left of edges shrinks by rounds: every component takes its least edge, and components that meet become one.
    """
    p = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    p = pinned(p.groupBy("x").agg(F.min("id").alias("id"), (F.count(F.lit(1)) - 1).alias("copies")), "points")
    n = p.count()
    copies = p.select(F.explode(F.array_repeat(F.lit(0.0), F.col("copies").cast("int"))).alias("length"))
    if n < 2:
        return copies
    cells, partners = _cells(p, min(pivots, max(1, -(-n // block))), block)
    reach: dict[int, list[tuple[int, int, bool]]] = {}
    for r in partners.collect():  # as many as pairs of pivots at most
        reach.setdefault(r["cell"], []).append((r["begin"], r["end"], r["alone"]))
    size = min(TEAM, max(1, -(-max(end for of in reach.values() for _, end, _ in of) // TEAMS)))
    teams = [(c, sorted({t for begin, end, _ in of for t in range(begin // size, end // size + 1)})) for c, of in reach.items()]
    met = cells.join(F.broadcast(p.sparkSession.createDataFrame(teams, "cell int, teams array<int>")), "cell")
    spread = met.select("id", "x", "cell", "blk", (F.col("blk") / size).cast("int").alias("team"), F.explode("teams").alias("other"))
    spread = spread.select("id", "x", "cell", "blk", F.least("team", "other").alias("lo"), F.greatest("team", "other").alias("hi"))

    def trees(key, pdf):
        """What is left of the trees of the pairs of blocks that two teams have to try."""
        ids, x, blk = pdf["id"].to_numpy(), np.vstack(pdf["x"]).astype(np.float64), pdf["blk"].to_numpy()
        rows = {int(b): np.flatnonzero(blk == b) for b in np.unique(blk)}
        found, many = [], 0
        for i, at in rows.items():
            of = reach[int(pdf["cell"].iat[at[0]])]
            for j in rows:
                apart = {i // size, j // size} == set(key)
                if apart and any(begin <= j <= end and (i < j or (i == j and alone)) for begin, end, alone in of):
                    both = at if i == j else np.concatenate([at, rows[j]])
                    found.append(_pair_tree(ids[both], x[both]))
                    many += len(found[-1])
                    if many > TASK_EDGES + len(pdf):
                        found = [_forest(pd.concat(found))]
                        many = len(found[0])
        return _forest(pd.concat(found)) if found else pd.DataFrame({"a": [], "b": [], "d": []})

    edges = pinned(spread.groupBy("lo", "hi").applyInPandas(trees, "a long, b long, d double"), "edges")
    tree_edges = []
    while edges.count() > last:
        edges, taken = boruvka_round(edges)
        tree_edges.append(taken)
    last_ones = edges.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_forest, "a long, b long, d double")
    out = copies.unionByName(last_ones.select(F.sqrt("d").alias("length")))
    for taken in tree_edges:
        out = out.unionByName(taken.select(F.sqrt("d").alias("length")))
    return out


def _cells(p: DataFrame, n_pivots: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, x, cell, blk) and which cells need trees with which: (cell, begin, end, alone), begin to end being the other's blocks. A cell
    of one block that needs no other is alone: its own tree is needed. There are as many rows as pairs of pivots at most."""
    spark = p.sparkSession
    chosen = p.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("id", "x").collect()
    ids, at = np.array([r["id"] for r in chosen]), np.array([r["x"] for r in chosen])

    def nearest(batches):
        for pdf in batches:
            x = np.vstack(pdf["x"])
            cell = np.concatenate([((x[i : i + 256, None] - at[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(x), 256)])
            yield pd.DataFrame({"id": pdf["id"], "x": pdf["x"], "cell": cell, "far": np.sqrt(((x - at[cell]) ** 2).sum(1))})

    near = pinned(p.select("id", "x").mapInPandas(nearest, "id long, x array<double>, cell int, far double"), "cells")
    sizes = {r["cell"]: (r["n"], r["far"]) for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    blocks = {c: max(1, -(-n // block)) for c, (n, _) in sizes.items()}
    first, total = {}, 0
    for c in sorted(blocks):
        first[c], total = total, total + blocks[c]
    dealt = spark.createDataFrame([(c, first[c], blocks[c]) for c in sorted(blocks)], "cell int, start int, blocks int")
    dealt = near.join(F.broadcast(dealt), "cell").select("id", "x", "cell", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("blk"))

    def longest(key, pdf):
        """The longest edge of the tree of a block and its pivot."""
        x = np.vstack([*pdf["x"], at[int(pdf["cell"].iloc[0])]])
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "m": [max(e[2] for e in tree(_squares(x)))]})

    cells = sorted(blocks)
    if len(cells) > 1:
        inner = {r["cell"]: r["m"] for r in dealt.groupBy("blk").applyInPandas(longest, "cell int, m double").groupBy("cell").agg(F.max("m").alias("m")).collect()}
        pivot = np.array([at[c] for c in cells])
        apart = np.sqrt(_squares(pivot))
        path = _minimax(apart)
        reach = np.sqrt(np.array([inner[c] for c in cells]))
        radius = np.array([sizes[c][1] for c in cells])
        way = np.maximum(path, np.maximum(reach[:, None], reach[None, :]))
        needed = apart - radius[:, None] - radius[None, :] <= way * (1 + 1e-9) + 1e-6 * (1 + apart.max())
    else:
        needed = np.ones((1, 1), bool)
    last = {c: first[c] + blocks[c] - 1 for c in cells}
    rows = []
    for i, c in enumerate(cells):
        others = [cells[j] for j in np.flatnonzero(needed[i]) if j != i]
        rows += [(c, first[o], last[o], False) for o in others]
        rows.append((c, first[c], last[c], not others and blocks[c] == 1))
    return dealt, spark.createDataFrame(rows, "cell int, begin int, end int, alone boolean")


def _squares(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)
    return np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)


def _minimax(d: np.ndarray) -> np.ndarray:
    """Of every two nodes the least longest edge of a path between them, along the tree of all."""
    out = np.zeros_like(d)
    joined = [0]
    for a, b, length in tree(d):  # which reaches each node from one that it has reached before
        out[b, joined] = out[joined, b] = np.maximum(out[a, joined], length)
        joined.append(b)
    return out


def boruvka_round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between the components that are left, edges of the tree that were taken). edges: (a, b, d) with a and b components.

    Every component takes its least edge, ties by the ends, so that what is taken has no cycle but pairs that take the same edge.
    The components that meet find the least id among them by halving the way to it, round by round.
    """
    e = F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("x"), e.alias("e"))
    picks = pinned(both.select("x.c", "x.o", "e").groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", "m.o", "m.e"), "picks")
    # (c -> up): the other end of the edge that c took; of two that took the same edge, the smaller is the root
    back = picks.select(F.col("c").alias("o"), F.col("o").alias("c2"))
    up = picks.join(back, "o").select("c", F.when((F.col("c2") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("up"))
    up = pinned(up, "up")
    while True:
        step = pinned(up.join(up.select(F.col("c").alias("up"), F.col("up").alias("top")), "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
        up = step.select("c", "up")
        if not step.where("moved").limit(1).count():
            break
    taken = picks.select("e.*").distinct().select("lo", "hi", "d")
    name = lambda c: up.select(F.col("c").alias(c), F.col("up").alias(f"_{c}"))
    left = edges.join(name("a"), "a").join(name("b"), "b").where("_a <> _b")
    # of parallel edges the least is enough
    left = left.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("d").alias("d"))
    return pinned(left, "edges"), taken


def _pair_tree(ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    ends = np.array([e[:2] for e in tree(_squares(x))], int).reshape(-1, 2)
    swapped = ids[ends[:, 0]] > ids[ends[:, 1]]
    ends[swapped] = ends[swapped][:, ::-1]
    # edges are measured again by differences: the same pair has the same length in every task
    return pd.DataFrame({"a": ids[ends[:, 0]], "b": ids[ends[:, 1]], "d": ((x[ends[:, 0]] - x[ends[:, 1]]) ** 2).sum(1)})


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["a", "b"]).reset_index(drop=True)
    return pdf.iloc[forest(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["d"].to_numpy())][["a", "b", "d"]]


def summary(lengths: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row: n_edges, longest, groups (edges over Q3 + 3 IQR, plus one) and the Wasserstein distance from an earlier barcode."""
    q = quantiles(lengths, [], "length", [0.25, 0.75]).first()
    cut = q["q1"] + 3 * (q["q1"] - q["q0"]) if q else 0.0
    out = lengths.agg(F.count(F.lit(1)).alias("n_edges"), F.max("length").alias("longest"), (F.count_if(F.col("length") > cut) + 1).alias("groups"))
    return out.withColumn("wasserstein", F.lit(wasserstein(lengths, previous)) if previous is not None else F.lit(None).cast("double"))


def wasserstein(a: DataFrame, b: DataFrame) -> float:
    """Mean absolute difference of two barcodes sorted from the longest down, the shorter padded with zeros: between neighbouring
    lengths, by how many more bars of one reach that far, times the step. Counts run over ranges of the length."""
    both = a.select("length", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("length", F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = both.groupBy("length").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run, total = running(previous(per, "length", ["length"]), "length", {"up_x": "x", "up_y": "y"}, descending=True)
    step = F.col("length") - F.coalesce("_was_length", F.lit(0.0))
    area = run.agg(F.sum(F.abs(F.col("up_x") - F.col("up_y")) * step)).first()[0]
    return float(area or 0.0) / max(total["up_x"], total["up_y"], 1)


def betti(lengths: DataFrame, radii: list[float]) -> DataFrame:
    """(radius, components) at each radius."""
    row = lengths.agg(*[(F.count_if(F.col("length") > r) + 1).alias(str(i)) for i, r in enumerate(radii)]).first()
    return lengths.sparkSession.createDataFrame([(float(r), int(row[i])) for i, r in enumerate(radii)], "radius double, components long")
