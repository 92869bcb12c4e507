"""The filter audit, periodic runs and the neighbour graph against plain Python."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.llm import filter_audit, hnsw, periodic, queries
from evidra.llm.common import table

from .conftest import row

# ---------------------------------------------------------------- 11


def plain_runs(words, least=12):
    """All runs from their definition: for every period the maximal stretches of equal words, the smallest period of each."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 9), st.integers(0, 60))
def test_runs_of_any_sequence(base, p, n):
    words = [b"%d" % x for x in base]
    words += [words[i % min(p, len(words))] for i in range(n)] if words else []
    assert periodic.runs_of(words) == plain_runs(words)


def test_runs_of_long_periods_and_powers():
    rng = random.Random(3)
    for _ in range(60):
        unit = [b"%d" % rng.randrange(rng.choice((2, 5, 1000))) for _ in range(rng.randrange(1, 60))]
        words = [b"x"] * rng.randrange(3) + unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))] + [b"%d" % rng.randrange(50) for _ in range(rng.randrange(40))] + unit * 2
        assert periodic.runs_of(words) == plain_runs(words)
    assert periodic.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        plain = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert periodic.z_function(s) == plain[: len(s)]


def test_query_of_runs_equals_plain_python(spark, data):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, data).collect()}
    docs = table(spark, data, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == plain_digest(doc_id, text)
        planted += r["n_runs"] > 0
    assert planted > 5


def test_runs_on_odd_rows(odd, none):
    got = {}
    for r in periodic.runs(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert periodic.runs(none).count() == 0 and len(got[5]) == 2 and got[5][0] == got[5][1] and len(got[None]) == 1
    assert got[1][0]["n_words"] == 0 and got[1][0]["runs"] == [] and got[1][0]["collapsed_text"] == "" and got[3][0]["runs"] == []
    assert [tuple(x) for x in got[12][0]["runs"]] == [(0, 200, 1)] and got[12][0]["collapsed_text"] == "word"
    assert got[4][0]["n_words"] == 120_000 and got[4][0]["runs"] == []  # its period of 60,574 words does not come twice
    planted = periodic.with_planted_runs(odd).collect()
    assert len(planted) == 14 and {r["doc_id"]: r["text"] for r in planted}[1] is None


# ---------------------------------------------------------------- 12


def test_audit_on_odd_rows_equals_plain_python(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (None, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int")
    some = odd.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s").when(F.col("doc_id") % 3 == 1, ""))
    good, toxic = {1, 2, 12}, {2, 5}
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in some.collect()]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    cells = Counter()
    for i, t, part in rows:
        w = t.encode().split()
        fails = "".join(
            c for c, no in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= x <= "Z" for x in t) > 5 * len(t), any(x in "#$%&*|" for x in t), i is not None and i > first[t])) if no
        )
        for kind, n in (("n", 1), ("good", i in good), ("toxic", i in toxic)):
            cells[part, fails, kind] += n
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(some, labels).collect()}
    parts = {p for _, _, p in rows}
    assert len(got) == 600 * len(parts) and len(parts) == 2
    shapley = Counter()
    for part in parts:
        of = lambda test, kind="n", part=part: sum(n for (p, f, k), n in cells.items() if p == part and k == kind and test(f))
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                own, before = order[step - 1], set(order[: step - 1])
                lost = lambda f, own=own, before=before: own in f and not before & set(f)
                r = got[part, order, step]
                assert r["removed"] == of(lost) and r["good_lost"] == of(lost, "good") and r["toxic_lost"] == of(lost, "toxic")
                assert r["kept"] == of(lambda f, all=before | {own}: not all & set(f)) and r["unique_fails"] == of(lambda f, own=own: f == own)
                assert r["redundant"] == of(lambda f, own=own, before=before: own in f and bool(before & set(f)))
                shapley[part, own] += r["removed"]
    assert all(r["shapley"] == shapley[p, order[step - 1]] for (p, order, step), r in got.items())
    assert filter_audit.audit(none, labels).count() == 0 and filter_audit.audit(some, labels.limit(0)).count() == 1200


def test_a_null_id_repeats_no_text_and_is_no_first(spark):
    docs = spark.createDataFrame([row(None, "same"), row(3, "same"), row(3, "same"), row(4, "same"), row(4, "other")], "doc_id long, text string, lang string, source string, n_chars long, words int, `key` string, chunk long, fp string, item long, _id string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["mask"] >> 4) for r in filter_audit.masks(docs, labels).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (4, 0), (4, 1)]


# ---------------------------------------------------------------- 13


def plain_neighbours(points, k):
    x = {i: v for i, v in points}
    for i in x:
        if i % 20 == 0:
            yield i, sorted((-float(np.dot(x[i], x[j])), j) for j in x if j != i)[:k]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_against_all_rows(spark, folder):
    """The larger tables are also searched in several shards and blocks."""
    points = [(r["vec_id"], np.array(r["embedding"], float)) for r in table(spark, f"/root/testdata/{folder}", "embeddings").collect()]
    exact = dict(plain_neighbours(points, 20))
    got = {}
    for r in queries.QUERIES["op13_hnsw"](spark, f"/root/testdata/{folder}").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(exact) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    x = dict(points)
    for i, g in got.items():
        assert all(s == pytest.approx(float(np.dot(x[i], x[j])), rel=1e-12) for j, s in g.values()) and i not in {j for j, _ in g.values()}
        assert [g[r] for r in range(1, 21)] == sorted(g.values(), key=lambda v: (-v[1], v[0]))
    hit = sum(len({j for _, j in exact[i]} & {j for j, _ in got[i].values()}) for i in got)
    assert hit >= 0.97 * 20 * len(got)
    if folder == "sf0.1":
        rows = hnsw.rows_of(table(spark, f"/root/testdata/{folder}", "embeddings"), "vec_id", "embedding")
        index = hnsw.build_index(rows, 21, shard_rows=400)
        asked = rows.where("id % 20 = 0")
        found = hnsw.search_index(index, asked, 21, block_rows=30).join(asked, "key").collect()
        assert index.count() == -(-len(points) // 400) > 1 and len(found) == len(exact)
        assert sum(len({j for _, j in exact[r["id"]]} & {f["id"] for f in r["found"]}) for r in found) >= 0.97 * 20 * len(exact)


def test_copies_ties_lengths_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1 + i % 7)]) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 160)] + [(40, rows[40][1])]  # copies; a repeated row
    rows += [(200, None), (220, [0.0, 0.0, 0.0, 0.0]), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0, 9.0]), (300, [5.0, 5.0]), (320, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, `key` int, shard string")
    used = {i: np.array([*np.float32(v), *[0] * (4 - len(v))], float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in hnsw.neighbours(df, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in used if i % 20 == 0}
    for i, found in got.items():
        want = sorted((-float((used[i] * used[j]).sum()), j) for j in used if j != i)[:20]
        assert [(r, j) for r, j, _ in sorted(found)] == [(r + 1, j) for r, (_, j) in enumerate(want)]
        assert [s for _, _, s in sorted(found)] == pytest.approx([-p for p, _ in want], rel=1e-12)
    few = hnsw.neighbours(df.where("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0, 20).collect()
    assert sorted((r["rank"], r["query_id"]) for r in few) == [(1, 0), (2, 0)]
    assert hnsw.neighbours(df.limit(0), F.col("id") % 20 == 0, 20).count() == 0 and hnsw.neighbours(df.where("vec_id = 0"), F.col("id") % 20 == 0, 20).count() == 0


def test_very_long_and_very_short_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.choice([-200, 0, 150])]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.array(v) for i, v in rows}
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in hnsw.neighbours(df, F.col("id") % 20 == 0, 5).collect()}
    for i in (0, 20, 40, 60):
        assert [got[i, r] for r in range(1, 6)] == [j for _, j in sorted((-float((x[i] * x[j]).sum()), j) for j in x if j != i)[:5]]


def test_a_third_of_all_rows_being_one_vector_is_one_node(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (np.ones(8) if i % 3 == 0 else rng.normal(size=8))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = hnsw.build_index(hnsw.rows_of(df, "vec_id", "embedding"), 21)
    assert sum(len(np.frombuffer(r["sizes"], np.int64)) for r in index.collect()) == 2001
    got = [r["vec_id"] for r in hnsw.neighbours(df, F.col("id") == 300, 20).orderBy("rank").collect()]
    x = {i: np.array(v) for i, v in rows}
    want = sorted((-float(x[300] @ x[j]), j) for j in x if j != 300)[:20]
    assert len(set(got) & {j for _, j in want}) >= 19
