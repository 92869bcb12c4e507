import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from evidra.llm import decontam, hmm_score, knn_quality, language_id, line_dedup, packing, quality_rules, queries, simhash, substring_dedup, warc
from evidra.llm.common import GRAIN, drawn, share, table

from ..same import assert_same
from .conftest import SENTENCE, row


def words(text):
    return (text or "").encode().split()


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, duck, data, name):
    assert_same(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLES[name]).df())


# ---------------------------------------------------------------- 1


def test_rules_on_odd_rows(odd, none):
    got = {}
    for r in quality_rules.ledger(odd).collect():
        got.setdefault(r["doc_id"], r)
    assert got[1]["n_words"] == 0 and got[1]["fail_bits"] & 1 and got[3]["n_words"] == 0
    assert got[12]["n_repeat_words"] == 200 and got[4]["n_words"] == 120_000
    assert quality_rules.ledger(odd).count() == 14 and quality_rules.ledger(none).count() == 0


def test_ablation_counts_rules_that_decide_alone(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, SENTENCE * 2), (3, "x " * 30), (4, "A!! B## " * 3)], "doc_id long, text string")
    led = quality_rules.ledger(docs).persist()
    out = {r["rule"]: r for r in quality_rules.ablation(led, quality_rules.STANDARD).collect()}
    bits = [r["fail_bits"] for r in led.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert out[rule.name]["n_failed"] == sum(b >> i & 1 for b in bits)
        assert out[rule.name]["n_failed_alone"] == sum(b == 1 << i for b in bits)
    assert quality_rules.apply_policy(led, quality_rules.BASE).where("kept").count() >= quality_rules.apply_policy(led, quality_rules.STANDARD).where("kept").count()


# ---------------------------------------------------------------- 2


def test_base_scores_equal_brute_force_and_the_model_is_proper(spark, data):
    docs = texts(table(spark, data, "documents"))
    got = queries.QUERIES["op2_hmm_score"](spark, data).toPandas().set_index("doc_id")
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words((t or "").encode().lower().decode()))
            counts["<end> "] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        seq = [*words((t or "").encode().lower().decode()), "<end> "]
        assert got.loc[i, "base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in seq), rel=1e-9)
        assert got.loc[i, "n_tokens"] == len(seq) and got.loc[i, "n_known"] == sum(w in counts for w in seq)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_forward_recursion_equals_the_sum_over_paths():
    rng = np.random.default_rng(0)
    hmm = hmm_score.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [np.array([1, 2, 0, 4], np.int32), np.array([3, 3], np.int32), np.array([0], np.int32)]

    def brute(s):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = hmm.start[path[0]] * hmm.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= hmm.move[path[t - 1], path[t]] * hmm.emit[s[t], path[t]]
            total += p
        return math.log(total)

    assert hmm_score.forward(seqs, hmm) == pytest.approx([brute(s) for s in seqs])
    like, start, moves, emit = hmm_score.expectations(seqs, hmm, 5)
    assert like == pytest.approx(sum(map(brute, seqs))) and start.sum() == pytest.approx(3) and moves.sum() == pytest.approx(4) and emit.sum() == pytest.approx(7)


def test_stretches_of_long_texts_give_what_one_recursion_gives(monkeypatch):
    rng = np.random.default_rng(1)
    hmm = hmm_score.Hmm(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4) / 3, 4), rng.dirichlet(np.ones(30) / 3, 4).T + 1e-9)
    seqs = [rng.integers(0, 30, n).astype(np.int32) for n in (5000, 1291, 1290, 700, 64, 33, 2, 1)]
    plain, counts = hmm_score.forward(seqs, hmm), hmm_score.expectations(seqs, hmm, 30)
    monkeypatch.setattr(hmm_score, "LONG", 60)
    for size in (64, 43, 2):
        monkeypatch.setattr(hmm_score, "STRETCH", size)
        assert hmm_score.forward(seqs, hmm) == pytest.approx(plain, rel=1e-11)
        for a, b in zip(hmm_score.expectations(seqs, hmm, 30), counts):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert counts[3].sum() == pytest.approx(sum(map(len, seqs))) and counts[2].sum() == pytest.approx(sum(len(s) - 1 for s in seqs))


def test_one_long_text_takes_about_as_long_as_many_short_ones():
    rng = np.random.default_rng(1)
    hmm = hmm_score.Hmm(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(500), 4).T)
    tokens = rng.integers(0, 500, 300_000).astype(np.int32)
    took = []
    for seqs in ([tokens], np.split(tokens, 300)):
        began = time.process_time()
        hmm_score.expectations(seqs, hmm, 500)
        took.append(time.process_time() - began)
    assert took[0] < 4 * took[1]


def test_hmm_training_raises_the_likelihood_and_odd_rows_are_scored(spark, odd, none):
    rows = hmm_score.coded(odd)
    counts = hmm_score.count_words(rows).persist()
    vocab = hmm_score.vocabulary(counts, odd.count(), classes=20, head=40)
    hmm, course = hmm_score.fit(rows, vocab, rounds=5)
    # rounds maximise a likelihood with priors: the last of the tied rounds is well above the first
    assert len(course) == 5 and course[3] > course[0]
    out = hmm_score.score(rows, hmm, vocab)
    assert out.count() == 14 and out.where("score is null or isnan(score)").count() == 0 and out.where("doc_id = '1'").first()["n_tokens"] == 1
    same = [r["score"] for r in out.where("doc_id = '5'").collect()]
    assert len(same) == 2 and same[0] == same[1] and out.where("doc_id is null").count() == 1
    assert out.where("doc_id = '4'").first()["n_tokens"] == 120_001
    # no training rows at all
    nothing = hmm_score.coded(none)
    empty = hmm_score.count_words(nothing).persist()
    v = hmm_score.vocabulary(empty, 0)
    h, _ = hmm_score.fit(nothing, v)
    assert hmm_score.score(nothing, h, v).count() == 0
    assert hmm_score.score(rows, h, v).count() == 14


def test_every_training_word_has_emissions_of_its_own(spark):
    """Two kinds of texts; words beyond the classes, of one length and one count, tell them apart."""
    rng = np.random.default_rng(4)
    say = lambda kind: " ".join(f"{kind}{i:03}" for i in rng.integers(0, 300, 200))
    rows = hmm_score.coded(spark.createDataFrame([(i, say("ab"[i % 2])) for i in range(120)], "doc_id long, text string"))
    counts = hmm_score.count_words(rows).persist()
    vocab = hmm_score.vocabulary(counts, 120, classes=60, head=90)
    hmm, _ = hmm_score.fit(rows, vocab)
    tail = hmm.table.toPandas()
    assert len(tail) == counts.count() - 60 and tail["c"].sum() + vocab.counts[:60].sum() == 24_000
    found = hmm_score.tail_emissions(tail["c"].to_numpy(float), tail.drop(columns=["word", "c"]).to_numpy(float), hmm)
    name = {np.uint64(xxhash.xxh64_intdigest(f"{kind}{i:03}")).astype(np.int64): f"{kind}{i:03}" for kind in "ab" for i in range(300)}
    e = {name[w]: v for w, v in zip(tail["word"], found)}
    assert hmm.emit.sum(0) + sum(e.values()) == pytest.approx(np.ones(hmm_score.STATES))
    ratio = {kind: np.mean([v / v.sum() for w, v in e.items() if w[0] == kind], 0) for kind in "ab"}
    assert np.abs(ratio["a"] - ratio["b"]).max() > 0.3
    # texts of tail words alone: those of one kind are likelier than those that alternate
    tail = {kind: sorted(w for w in e if w[0] == kind)[:60] for kind in "ab"}
    texts = [(0, " ".join(tail["a"])), (1, " ".join(x for p in zip(tail["a"][:30], tail["b"][:30]) for x in p))]
    asked = hmm_score.score(hmm_score.coded(spark.createDataFrame(texts, "doc_id long, text string")), hmm, vocab)
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in asked.collect()}
    assert got["0"] > got["1"] + 3


def test_hmm_query_scores_equal_a_plain_forward_recursion(spark, data):
    """The whole path of the query: emissions of every word put together on the driver, and a recursion in plain Python."""
    docs = texts(table(spark, data, "documents"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held", F.pmod(F.col("doc_id"), F.lit(7)) == 2)
    rows = hmm_score.coded(frame, "held")
    train = rows.where(~F.col("held"))
    counts = hmm_score.count_words(train).persist()
    vocab = hmm_score.vocabulary(counts, frame.where("not held").count(), classes=300, head=900)
    hmm, _ = hmm_score.fit(train, vocab)
    tail = hmm.table.toPandas()
    emit = dict(zip(tail["word"], hmm_score.tail_emissions(tail["c"].to_numpy(float), tail[["s0", "s1", "s2"]].to_numpy(float), hmm)))
    for w, r in zip(vocab.hashes, vocab.rank):
        if r < 300:
            emit[w] = hmm.emit[hmm_score.LENGTHS + 1 + r]
    got = {r["doc_id"]: r["score"] for r in hmm_score.score(rows, hmm, vocab).collect()}
    for i, t in docs[:60]:
        obs = [emit.get(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64), hmm.emit[hmm_score.UNKNOWN]) for w in words((t or "").encode().lower().decode())] + [hmm.emit[0]]
        a, total = hmm.start * obs[0], 0.0
        for n, o in enumerate(obs):
            a = a if n == 0 else a @ hmm.move * o
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[str(i)] == pytest.approx(total, rel=1e-6)


# ---------------------------------------------------------------- 3


def test_quality_on_held_out_rows(spark, data):
    got = queries.QUERIES["op3_knn_quality"](spark, "/root/testdata/sf0.01").toPandas().merge(table(spark, "/root/testdata/sf0.01", "labels").toPandas())
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and held[held["quality"] == 0]["predicted"].mean() < 0.2


def test_quality_query_equals_votes_over_all_labelled_texts(spark, data):
    """Every score again, one text at a time; equal texts score equal whatever their ids."""
    docs = table(spark, data, "documents").select("doc_id", "text")
    labels = table(spark, data, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model, features = knn_quality.fit(docs, labels), knn_quality.Features()
    got, by_text = {r["doc_id"]: r["score"] for r in queries.QUERIES["op3_knn_quality"](spark, data).collect()}, defaultdict(set)
    for i, t in texts(docs):
        x = np.log1p(features.matrix([t or ""])[0]) * model.idf
        x = x / max(np.linalg.norm(x), 1e-12) @ model.basis
        sims = model.vectors @ (x / max(np.linalg.norm(x), 1e-12))
        near = np.argsort(-sims)[: knn_quality.K]
        w = np.maximum(sims[near], 0) ** 2 + 1e-9
        want = (w * (model.labels[near] == 1)).sum() / w.sum() if words(t) else 0.0
        assert got[i] == pytest.approx(want, abs=0.03)  # neighbours of rank K may tie
        by_text[t].add(round(got[i], 4))
    assert all(len(v) == 1 for v in by_text.values())
    copy = spark.createDataFrame([(int(labels.first()["doc_id"]), SENTENCE), (999_999, SENTENCE)], "doc_id long, text string")
    assert len({r["score"] for r in knn_quality.classify(copy, model).collect()}) == 1


def test_samples_keep_their_size_at_any_number_of_rows(spark):
    for n in (100, 10_000, 10**11, 10**14):
        assert share(1500, n) / GRAIN * n == pytest.approx(min(1500, n), rel=1e-6)
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert ids.where(drawn("s", "doc_id", share(1500, 200_000))).count() == pytest.approx(1500, rel=0.15)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    sims, labels = rng.normal(size=(5, 40)), rng.integers(0, 2, 40)
    for row_, got in zip(sims, knn_quality.vote(sims, labels, 7)):
        near = np.argsort(-row_)[:7]
        w = np.maximum(row_[near], 0) ** 2 + 1e-9
        assert got == pytest.approx((w * labels[near]).sum() / w.sum())


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (7, 1), (8, 1), (12, 0), (10, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = knn_quality.fit(odd, labels, per_class=10, dims=3)
    out = knn_quality.classify(odd, model, k=2)
    assert out.count() == 14 and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r["score"] for r in out.where("doc_id in (1, 2, 3)").collect()} == {0.0}
    assert knn_quality.classify(none, model).count() == 0


@pytest.mark.parametrize(("kind", "score"), [("quality = 1", 1.0), ("quality = 0", 0.0), ("quality is null", 0.5)])
def test_labels_of_one_kind_or_none(spark, odd, kind, score):
    """Texts with words score the share of label 1, texts without words (null, empty, white space) 0."""
    labels = spark.createDataFrame([(5, 1), (7, 1), (12, 0), (10, 0), (None, 1), (4, None)], "doc_id long, quality int").where(kind)
    got = knn_quality.classify(odd, knn_quality.fit(odd, labels)).collect()
    assert len(got) == 14 and all(r["score"] == (0.0 if r["doc_id"] in (1, 2, 3) else score) for r in got)


def test_ties_of_the_last_vote_go_by_index():
    rng = np.random.default_rng(3)
    sims, labels = rng.integers(0, 6, (40, 3000)) / 5, rng.integers(0, 2, 3000)
    for s, got in zip(sims, knn_quality.vote(sims, labels, 25)):
        near = np.lexsort((np.arange(3000), -s))[:25]
        w = s[near] ** 2 + 1e-9
        assert got == pytest.approx((w * labels[near]).sum() / w.sum())


# ---------------------------------------------------------------- 4


def removal(docs, size):
    seen = Counter()
    for t in docs:
        w = words(t)
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] += 1
    out = []
    for t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_repeated_windows_equal_brute_force(odd, none, monkeypatch):
    docs = texts(odd)
    expected = sorted(zip([str(i) for i, _ in docs], removal([t for _, t in docs], 6)))
    for chunk in (10_000_000, 300):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk * 20 if chunk == 300 else chunk)
        monkeypatch.setattr(substring_dedup, "BUCKET_CHUNK_BYTES", 100_000)
        got = substring_dedup.spans(odd, 6).collect()
        assert sorted((str(r["doc_id"]), r["kept_text"]) for r in got) == expected
        assert all(r["n_removed"] == sum(b - a + 1 for a, b in r["removed"]) for r in got)
    assert substring_dedup.spans(none).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 35])
def test_window_hash_is_the_polynomial(size):
    h = np.random.default_rng(0).integers(0, 1 << 63, 80).astype(np.uint64)
    a, b = substring_dedup.window_hashes(h, size), substring_dedup.window_hashes(np.concatenate([h[5:], h[:5]]), size)
    assert len(a) == 81 - size and (a[5:] == b[: 76 - size]).all() and len(set(a.tolist())) == len(a)


def test_a_chunk_takes_no_more_steps_than_it_has_hashes():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False))
    for bits in (0, 1, 7, 40, 63):
        got = substring_dedup.by_bucket(values, bits)
        assert len(got) <= min(len(values), 1 << bits) and got[0][1] == 0 and got[-1][2] == len(values)
        assert all(a[2] == b[1] and a[0] < b[0] for a, b in zip(got, got[1:]))
        assert all({int(v) >> 64 - bits for v in values[i:j]} == {b} for b, i, j in got)
    assert substring_dedup.by_bucket(values[:0], 5) == []


# ---------------------------------------------------------------- 5


def bit_print(text, shingle=3):
    w = words((text or "").encode().lower().decode())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(prints, ids, radius=3):
    label = dict(zip(range(len(ids)), ids))
    moved = True
    while moved:
        moved = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] > label[j]:
                    label[i], moved = label[j], True
    return label


def test_components_equal_brute_force(spark, data):
    docs = texts(table(spark, data, "documents"))
    prints = [bit_print(t) for _, t in docs]
    label = classes(prints, [i for i, _ in docs])
    got = queries.QUERIES["op5_simhash"](spark, data).toPandas().set_index("doc_id")
    for k, (i, _) in enumerate(docs):
        assert got.loc[i, "fingerprint"] == f"{prints[k]:016x}" and got.loc[i, "component_id"] == label[k]


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64, endpoint=False)
    prints = [int(b) for b in base]
    for b in base[:10]:
        x = int(b)
        for _ in range(6):  # chains
            for k in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(k)
            prints.append(x)
    prints = list(dict.fromkeys(prints))
    heads = spark.createDataFrame([(i, p.to_bytes(8, "little")) for i, p in enumerate(prints)], "head long, fp binary")
    expected = classes(prints, list(range(len(prints))))
    for split in (simhash.SPLIT, 3):  # 3: nearly every shared key is split in pairs of blocks
        got = {r["node"]: r["label"] for r in simhash.components(simhash.links(heads, split=split)).collect()}
        assert {i: got.get(i, i) for i in expected} == expected


def test_simhash_on_odd_rows_and_dense_groups(odd, none):
    out = simhash.group(odd).collect()
    assert len(out) == 14 and {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] in (5, 6)} == {5}
    assert simhash.group(none).count() == 0
    rng = np.random.default_rng(0)
    fp = np.unique(np.array([sum(1 << int(k) for k in rng.choice(20, 2, replace=False)) for _ in range(3000)], np.uint64))[:, None]
    near = np.zeros((len(fp), 1), np.int8)
    assert len(list(simhash.linked(fp, near, 3))) == len(fp) - 1
    # of two blocks only links across
    across = list(simhash.linked(fp, near, 3, 40))
    bits = [int(x) for x in fp[:, 0]]
    pairs = {(x, y) for x in range(40) for y in range(40, len(fp)) if (bits[x] ^ bits[y]).bit_count() <= 3}
    forest = simhash._Forest(len(fp))
    assert set(across) <= pairs and len(across) == sum(forest.join(x, y) for x, y in sorted(pairs))


def test_stage_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    near = list(base)
    near[150] = "changed"
    other = [f"v{i}" for i in rng.integers(0, 5000, 300)]
    docs = spark.createDataFrame([row(1, " ".join(base)), row(2, " ".join(near)), row(3, " ".join(base)), row(4, " ".join(other))], "doc_id long, text string, lang string, source string, n_chars long, a int, b string, c long, d string, e long, f string")
    assert sorted(r["doc_id"] for r in simhash.stage(spark, docs, "").collect()) == [1, 4]


def test_stage_decides_by_the_similarity_of_five_word_shingles(spark):
    """Pairs at 0.8 and a little above go, pairs a little below stay."""
    rng = np.random.default_rng(1)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs, like = [], set()
    for k in range(400):
        n = int(rng.integers(8, 250))
        base = [f"k{k}w{i}" for i in range(n)]
        grown = base + [f"k{k}v{i}" for i in range(int(rng.uniform(0.1, 0.45) * n))]  # one contains the other
        a, b = len(base) - 4, len(grown) - 4
        if k % 2:  # of equal size
            m = int(rng.uniform(0.05, 0.2) * n)
            grown = base[: n - m] + [f"k{k}v{i}" for i in range(m)]
            a, b = n - m - 4, n - 4 + m
        if a / b >= 0.8:
            like.add(2 * k + 1)
        docs += [row(2 * k, " ".join(base))[:5], row(2 * k + 1, " ".join(grown))[:5]]
    kept = {r["doc_id"] for r in simhash.stage(spark, spark.createDataFrame(docs, schema), "").collect()}
    assert set(range(800)) - kept == like and 100 < len(like) < 300


def test_blocks_of_a_large_component_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts_ = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            w[k] = f"x{i}y{k}"
        texts_.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts_)]
    label = {i: i for i in range(60)}
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    proposed = spark.createDataFrame([(i, 0) for i in range(1, 60)], "node long, label long")
    got = {r["node"]: r["label"] for r in simhash.components(simhash.verified(docs, proposed)).collect()}
    assert {i: got.get(i, i) for i in label} == label and len(set(label.values())) > 5


# ---------------------------------------------------------------- 6


def test_packing_loses_nothing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack_documents(odd, packing.Capacity(), packing.tokenizer_path()).toPandas()
    expected = Counter()
    for _, t in texts(odd):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected[k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(zip(out["piece"], out["start"], out["length"], out["ids_crc32"])) == expected
    check_bins(out, packing.Capacity())
    assert packing.pack_documents(none, packing.Capacity(), packing.tokenizer_path()).count() == 0


def plain_best_fit(length, count, cost, cap):
    """The vector rule over all open bins, one by one."""
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights, left, out = np.array(cap.weights) / full**2, np.empty((0, 3)), []
    for item in np.column_stack([length, count, cost]).astype(float):
        at = np.flatnonzero((left >= item).all(1))
        if len(at):
            rest = left[at] - item
            rank = (rest * rest * weights).sum(1) if cap.rule == "norm" else -(left[at] * item * weights).sum(1)
            j = at[rank.argmin()]
        else:
            left, j = np.vstack([left, full]), len(left)
        left[j] -= item
        out.append(j)
    return np.array(out)


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(rule="dot"), packing.Capacity(documents=4, attention=2_000_000), packing.Capacity(1000, 5, 600_000, (1.0, 0.3, 0.7), "dot")])
def test_the_vector_rule_decides(cap):
    rng = np.random.default_rng(8)
    length = np.sort(np.minimum(rng.lognormal(5.4, 1.1, 700).astype(int) + 1, cap.tokens))[::-1]
    count = np.ones(len(length), int)
    got = packing.best_fit(length, count, length**2, cap)
    assert (got == plain_best_fit(length, count, length**2, cap)).all()
    # documents and attention weigh: tokens alone would choose other bins
    alone = packing.Capacity(cap.tokens, cap.documents, cap.attention, (1.0, 0.0, 0.0), cap.rule)
    assert (got != packing.best_fit(length, count, length**2, alone)).any()


def test_packing_needs_hardly_more_sequences_than_tokens_fill(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op6_vector_best_fit"](spark, sf).toPandas()
    assert out["sequence_id"].nunique() <= math.ceil(out["length"].sum() / 2048) + 1


def check_bins(out, cap):
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= cap.tokens and (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all()
        assert len(g) <= cap.documents and ((g["length"] ** 2).sum() <= cap.attention or len(g) == 1)


@pytest.mark.parametrize("cap", [packing.Capacity(100), packing.Capacity(100, 3, 6000, (1.0, 0.5, 0.5)), packing.Capacity(100, 4, 10_000, (1.0, 1.0, 1.0), "dot")])
def test_every_capacity_holds_over_shards(spark, cap):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, int(n), 1, int(n * n)) for i, n in enumerate(rng.integers(1, 80, 900))], "item long, length long, n_docs long, cost long")
    out = packing.pack(items, cap, shard_items=200).toPandas().merge(items.toPandas(), on="item")
    assert len(out) == 900
    check_bins(out, cap)
    if cap.documents >= 100:
        assert out["sequence_id"].nunique() <= math.ceil(out["length"].sum() / 100 * 1.06)


# ---------------------------------------------------------------- 7


def test_line_runs_compact_and_take_only_what_is_new(spark):
    line = lambda i: f"this is a rather long line number {i}"
    store = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda k: spark.createDataFrame([(10 * k + j, "\n".join(line(i) for i in range(j, j + 3 + k))) for j in range(4)], "doc_id long, text string")
    seen, shape = defaultdict(set), []
    for k in range(5):
        held = {r["line_hash"] for r in store.runs().collect()}
        assert len(held) == store.runs().count() == len(seen)  # a key is in one run: the anti-join let only new ones in
        for r in batch(k).collect():
            for x in r["text"].split("\n"):
                seen[x].add(r["doc_id"])
        store.add(line_dedup.line_hashes(batch(k), 20))
        shape.append([len(x) for x in store.levels])
        for path in (p for level in store.levels for p in level):
            for part in {r["f"] for r in store._read([path]).select(F.input_file_name().alias("f")).distinct().collect()}:
                hashes = [r["line_hash"] for r in spark.read.parquet(part).collect()]
                assert hashes == sorted(hashes)
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]  # compacted
    found = {r["line_hash"]: r["n_docs"] for r in store._counted(store.runs()).collect()}
    assert sorted(found.values()) == sorted(map(len, seen.values()))
    got = sorted(r["last_doc"] for r in store.repeated(3).collect())
    assert got == sorted(max(v) for v in seen.values() if len(v) >= 3)


def test_line_dedup_compacts_in_the_query_and_any_number_of_batches_agrees(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    assert line_dedup.BATCHES >= line_dedup.FANOUT
    want = sorted(map(tuple, line_dedup.dedup(docs, batches=1).collect()))
    for batches, fanout in ((line_dedup.BATCHES, line_dedup.FANOUT), (5, 3)):
        assert sorted(map(tuple, line_dedup.dedup(docs, batches=batches, fanout=fanout).collect())) == want


def test_lines_whose_first_hash_is_the_same_stay_apart(spark, odd, monkeypatch):
    want = sorted(map(str, line_dedup.dedup(odd).select("doc_id", "kept_text", "n_dropped").collect()))
    plain = line_dedup.hashes_of
    monkeypatch.setattr(line_dedup, "hashes_of", lambda key: [F.lit(7).cast("long").alias("line_hash"), plain(key)[1]])
    assert sorted(map(str, line_dedup.dedup(odd, batches=3).select("doc_id", "kept_text", "n_dropped").collect())) == want


def test_line_dedup_on_odd_rows(spark, odd, none):
    out = {r["doc_id"]: r for r in line_dedup.dedup(odd).collect()}
    assert out[1]["n_lines"] == 1 and out[1]["kept_text"] == "" and out[9]["n_dropped"] == 0
    # SENTENCE alone is a line of document None, whose key stays in 9; three times over it is no line of 7 to 9
    assert out[7]["kept_text"] == "one" and out[7]["n_dropped"] == 2 and out[None]["n_dropped"] == 1 and out[None]["kept_text"] == ""
    assert out[5]["n_dropped"] == 0 and out[4]["n_lines"] == 1
    assert line_dedup.dedup(none).count() == 0
    kept = line_dedup.stage(spark, odd, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [tuple(r) for r in kept.where("doc_id = 7").select("text", "n_chars").collect()] == [("one", 3)]
    assert kept.where("doc_id is null").count() == 0 and kept.where("doc_id = 5").count() == 2


def test_lines_of_rows_that_share_an_id(spark):
    a, b = "a line that is long enough to count", "another line that is long enough"
    rows = [(1, f"{a}\nx"), (1, f"y\n{a}\n{a}"), (1, f"y\n{a}\n{a}"), (2, f"{a}\n{b}"), (3, f" {a.upper()} "), (4, b)]
    got = [tuple(r) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()]
    assert sorted(got) == [(1, "x", 2, 1), (1, "y", 3, 2), (1, "y", 3, 2), (2, b, 2, 1), (3, f" {a.upper()} ", 1, 0), (4, b, 1, 0)]


# ---------------------------------------------------------------- 8


def test_languages_of_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_language_id"](spark, d).toPandas().merge(table(spark, d, "documents").select("doc_id", "lang").toPandas()).dropna()
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_query_equals_plain_trees(spark, data):
    """The query's own rows against context trees in dictionaries, byte by byte."""
    rows = table(spark, data, "documents").select("doc_id", "text", "lang").collect()
    train = [(r["lang"], r["text"].lower().encode()) for r in rows if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    used, langs = {b for _, t in train for b in t}, sorted({x for x, _ in train})
    seen, every = defaultdict(Counter), Counter()
    for lang, t in train:
        raw = b"\0\0\0" + t
        for i in range(3, len(raw)):
            for k in range(4):
                seen[lang, raw[i - k : i]][raw[i]] += 1
                every[raw[i - k : i]] += 1
    size = {key: (sum(c.values()), len(c)) for key, c in seen.items()}

    def bits(lang, data_):
        raw = bytes(3) + bytes(b if b in used else 0 for b in data_)
        total = 0.0
        for i in range(3, len(raw)):
            p = 1 / 256
            for k in range(4):
                ctx = raw[i - k : i]
                if k == 3 and every[ctx] < 3 or (lang, ctx) not in size:
                    continue
                n, kinds = size[lang, ctx]
                c = seen[lang, ctx].get(raw[i], 0) if raw[i] else 0
                p = c / (n + kinds) if c else p * kinds / (n + kinds)
            total -= math.log2(p)
        return total

    got = {r["doc_id"]: r for r in queries.QUERIES["op8_language_id"](spark, data).collect()}
    some = [r for r in rows if r["text"] and any(x.isalpha() for x in r["text"])][:25]
    for r in some:
        raw = r["text"].lower().encode()[:50_000]
        rate = {x: bits(x, raw) / len(raw) for x in langs}
        best = min(langs, key=lambda x: (rate[x], x))
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(2 ** (4 * (rate[best] - rate[x])) for x in langs), rel=1e-3)


def test_code_lengths_equal_a_plain_tree():
    texts_ = {"a": ["abracadabra abra", "cadabra"], "b": ["zzzyx zyx", "xyzzy"]}
    found = pd.concat(language_id._grams([pd.DataFrame({"lang": k, "text": v}) for k, v in texts_.items()]))
    model = language_id.build(found, 1)

    def bits(lang, data):
        counts = defaultdict(Counter)
        for t in texts_[lang]:
            raw = b"\0\0\0" + t.encode()
            for i in range(3, len(raw)):
                for k in range(4):
                    counts[raw[i - k : i]][raw[i]] += 1
        total = 0.0
        raw = b"\0\0\0" + data
        for i in range(3, len(raw)):
            p = 1 / 256
            for k in range(4):
                c = counts[raw[i - k : i]]
                n, d = sum(c.values()), len(c)
                if n:
                    p = c[raw[i]] / (n + d) if c[raw[i]] else p * d / (n + d)
            total -= math.log2(p)
        return total

    for data in (b"abra", b"zyx abc", b"zz"):
        assert language_id.code_lengths(model, [b"", data])[1] == pytest.approx([bits("a", data), bits("b", data)], rel=1e-5)


def test_sixty_languages_in_several_scripts_and_a_bound_on_the_trees():
    rng = np.random.default_rng(7)
    starts = [0x61, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0x3042, 0xAC00, 0x4E00, 0x10D0]
    texts_ = {}
    for k in range(60):
        letters = [chr(starts[k % 10] + x) for x in rng.permutation(22)[:14]]
        p = rng.dirichlet(np.ones(14) / 2)
        texts_[f"l{k:02}"] = [" ".join("".join(rng.choice(letters, rng.integers(2, 8), p=p)) for _ in range(60)) for _ in range(3)]
    found = pd.concat(language_id._grams([pd.DataFrame({"lang": x, "text": v[:2]}) for x, v in texts_.items()]))
    found = found.groupby(["lang", "gram"], as_index=False).sum()
    model, small = language_id.build(found, 1), language_id.build(found, 1, 1_500_000)
    assert len(model.langs) == 60 and small.bits.nbytes + small.escape.nbytes <= 1_500_000 < model.bits.nbytes
    assert model.bits.nbytes < 0.2 * len(model.lower) * model.a * 60 * 4  # of a table of all states and symbols
    counts = defaultdict(Counter)
    for x, v in texts_.items():
        for t in v[:2]:
            raw = b"\0\0\0" + t.encode()
            for i in range(3, len(raw)):
                for k in range(4):
                    counts[x, raw[i - k : i]][raw[i]] += 1

    def bits(x, data):
        total, raw = 0.0, b"\0\0\0" + data
        for i in range(3, len(raw)):
            p = 1 / 256
            for k in range(4):
                c = counts[x, raw[i - k : i]]
                n, d = sum(c.values()), len(c)
                if n:
                    p = c[raw[i]] / (n + d) if c[raw[i]] else p * d / (n + d)
            total -= math.log2(p)
        return total

    held = [v[2].encode() for v in texts_.values()]
    for m, least in ((model, 58), (small, 55)):
        got = language_id.code_lengths(m, held)
        assert (got.argmin(1) == np.arange(60)).sum() >= least
        if m is model:
            for i in (0, 11, 37):
                assert got[i] == pytest.approx([bits(x, held[i]) for x in model.langs], rel=1e-4)


def test_language_of_odd_rows(spark, odd, none):
    out = {r["doc_id"]: r for r in language_id.identify(odd, language_id.fit(odd)).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[4]["lang_pred"] == "en"
    assert language_id.identify(odd, None).where("lang_pred <> 'und'").count() == 0 and language_id.fit(none) is None
    assert language_id.stage(spark, odd, "").where("doc_id in (1, 2, 3)").count() == 0


# ---------------------------------------------------------------- 9


def test_archive_round_trip_and_index(spark):
    big = "<p>" + "x" * 1200 + "é</p>"
    rows = [(1, "http://www.b.example.com:80/x?q=1", big), (2, "https://a.example.org/", big), (3, None, None), (4, "http://b.example.com/x?q=1", "small"), (5, "::bad", "small"), (6, "http://u/ é", big)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int")
    archive = warc.write(pages)
    got = {r["page_id"]: r for r in warc.read(archive, warc.lookup(archive, warc.url_keys(pages))).collect()}
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert got[1]["payload_digest"] == digest and got[1]["payload_bytes"] == len(big.encode()) and got[3]["payload_bytes"] == 0
    assert sorted(x[0] for x in warc.find(archive, "http://b.example.com/x?q=1")) == ["1", "4"] and warc.find(archive, "http://none/") == []
    assert warc.surt("http://www.B.example.com:8080/p?x") == "com,example,b:8080)/p?x"
    nothing = warc.write(pages.limit(0))
    assert warc.read(nothing, warc.lookup(nothing, warc.url_keys(pages))).count() == 0 and warc.find(nothing, "http://u/") == []


def test_lookups_of_keys_that_reach_over_blocks_and_files(spark):
    """A third of all captures have one key; repeated and null page_ids and a very long page are kept."""
    url = lambda i: "http://hot.example/" if i % 3 == 0 else f"http://h{i % 40}.example/p{i // 80}"
    rows = [(i, url(i), f"<p>{i % 50}</p>") for i in range(9_000)] + [(None, "http://n/", "x" * 1500), (7, "http://n/", "x" * 1500), (7, "http://n/", "x" * 1500), (8, "http://long/", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    archive = warc.write(pages)
    assert archive.directory.count() > 9 and archive.files == sorted(archive.files) and len(warc.holders(archive.files, warc.surt(url(0)))) > 1
    got = Counter(tuple(r) for r in warc.read(archive, warc.lookup(archive, warc.url_keys(pages))).select("page_id", "payload_bytes", "record_type").collect())
    want = Counter((i, len(h), "response") for i, _, h in rows)  # a null id is always a response, and 7 is the head of its payload
    assert got == want
    some = spark.createDataFrame([(u,) for u in ("http://h1.example/p0", "http://none/", "http://hot.example/")], "url string")
    found = Counter(r["page_id"] for r in warc.read(archive, warc.lookup(archive, warc.url_keys(some))).collect())
    assert found == Counter(i for i, u, _ in rows if u in ("http://h1.example/p0", "http://hot.example/"))
    assert Counter(int(x[0]) for x in warc.find(archive, "http://hot.example/")) == Counter(range(0, 9_000, 3))


# ---------------------------------------------------------------- 10


def test_planted_items_are_found_and_clean_documents_are_not(spark):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}{c}" for a in "bdgkmprst" for b in "aeiou" for c in ("n", "ra", "lo", "st", "mi")]
    say = lambda n: [str(w) for w in rng.choice(vocab, n)]
    items = [say(n) for n in (12, 20, 40, 60)]
    docs, planted = [], set()
    for i in range(40):
        body = say(int(rng.integers(50, 400)))
        if i % 4 == 0:
            k = (i // 4) % 4
            item = list(items[k])
            if i % 8 == 0:  # a paraphrase: a tenth of the words changed, none of them rare ones only
                item[len(item) // 2] = "changedword"
            at = int(rng.integers(0, len(body)))
            body[at:at] = item
            planted.add((i, k))
        docs.append(row(i, " ".join(body)))
    docs += [row(100, None), row(101, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, a int, b string, c long, d string, e long, f string"
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, schema)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    assert got <= planted and len(got) >= 0.8 * len(planted)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench, block_items=2).collect()} <= planted
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_exact_copies_of_benchmark_passages_equal_brute_force(spark, data):
    d = "/root/testdata/sf0.01"
    docs, bench = texts(table(spark, d, "documents")), table(spark, d, "benchmark").collect()
    flat = {i: " " + " ".join(decontam.item_words(t)) + " " for i, t in docs}
    expected = {(i, b["item_id"]) for b in bench for i, t in flat.items() if f" {' '.join(decontam.item_words(b['text']))} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op10_decontamination"](spark, d).collect()}
    assert expected <= got and len(got - expected) <= 0.1 * len(got) + 1


def test_short_items_in_foreign_text_and_paraphrases_at_the_stated_cosine(spark):
    say = lambda p, n: [f"{p}{i}" for i in range(n)]
    items = [say("a", 6), say("b", 8), say("c", 12), say("d", 4)]
    docs, want = [], set()
    for i in range(60):
        k = i % 4
        docs.append((i, " ".join([*say(f"x{i}y", 30), *items[k], *say(f"z{i}y", 30)])))
        want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want
    # a window of a true cosine of 0.6 to 0.74 is not dropped before its cosine is computed
    ids = np.array([0, 1, 2, 3, 4, 5, 6, *[-1] * 9], np.int32)
    m = decontam.Items([0], [ids[:7]], [None], {}, np.ones(7, np.float32), 1.0)
    assert 0.6**2 <= 7 / 16 < 0.55 and len(decontam.windows([ids], m, 4).start) == 1


@pytest.mark.parametrize("size", [16, 38])
def test_without_an_answer_the_subsequence_decides(spark, size):
    """Paraphrases that replace random words, rare ones included, at an LCS of 0.8 to 0.95."""
    rng = np.random.default_rng(size)
    vocab = [f"{a}{b}{c}" for a in "bdgkmprst" for b in "aeiou" for c in ("n", "ra", "lo", "st", "mi")]
    say = lambda n: [str(w) for w in rng.choice(vocab, n)]
    items = [say(size) for _ in range(5)]
    docs, want = [], set()
    for i in range(100):
        item = list(items[i % 5])
        for at in rng.choice(size, int(rng.integers(1, int(0.2 * size) + 1)), replace=False):
            item[at] = f"new{i}at{at}"
        docs.append((i, " ".join([*say(60), *item, *say(60)])))
        want.add((i, i % 5))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    print("recall", size, len(got & want) / len(want))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_an_item_of_very_frequent_words_is_found(spark):
    item = [f"w{i}" for i in range(16)]
    long = [f"v{i}" for i in range(40)]
    docs = [(i, " ".join(item)) for i in range(30)] + [(100 + i, " ".join(f"x{i}y{k}" for k in range(16))) for i in range(10)] + [(200, " ".join(long))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(i, 0) for i in range(30)} | {(200, 1)}


def plain_lcs(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
        before = now
    return before[-1]


def test_lcs_and_its_bound():
    rng = np.random.default_rng(6)
    for _ in range(200):
        item, text = rng.integers(0, 9, rng.integers(1, 15)).astype(np.int32), rng.integers(-1, 12, rng.integers(1, 40)).astype(np.int32)
        t, reach = decontam.Target.of(item), int(min(rng.integers(1, 20), len(text)))
        kind = np.minimum(np.searchsorted(t.kinds, text), len(t.kinds) - 1)
        place = np.flatnonzero(t.kinds[kind] == text)
        bound = decontam.overlaps(place, kind[place], t.often, len(text), reach)
        assert bound.tolist() == [sum((Counter(item.tolist()) & Counter(text[s : s + reach].tolist())).values()) for s in range(len(text) - reach + 1)]
        assert decontam.lcs(t.where, len(item), kind[place].tolist()) == plain_lcs(item.tolist(), text.tolist())


def test_verbatim_items_of_every_length_are_found(spark):
    """Items of 1 to 60 words in long documents, in words that all documents use; recall of exact occurrences is 1."""
    rng = np.random.default_rng(12)
    vocab = [f"{a}{b}{c}" for a in "bdgkmprstv" for b in "aeiou" for c in ("n", "ra", "lo", "st", "mi", "ku")]
    say = lambda n: [str(w) for w in rng.choice(vocab, n)]
    items = {n: say(n) for n in range(1, 61)}
    docs = []
    for i in range(180):
        body, n = say(int(rng.integers(150, 900))), i % 60 + 1
        at = int(rng.integers(0, len(body)))
        docs.append((i, " ".join([*body[:at], *items[n], *body[at:]])))
    flat = {i: f" {t} " for i, t in docs}
    want = {(i, n) for i, t in flat.items() for n, item in items.items() if f" {' '.join(item)} " in t}
    frame = spark.createDataFrame([*docs, (None, docs[59][1]), (5, docs[5][1]), (500, None), (501, " ".join(say(30_000)) + " " + " ".join(items[33]))], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()]
    assert want <= set(got) and len(got) == len(set(got)) and {(None, 60), (501, 33)} <= set(got)
    extra = {(i, n) for i, n in got if i is not None and i < 500} - want
    assert all(n >= decontam.MIN_WORDS and plain_lcs(items[n], flat[i].split()) >= 0.8 * n - 1e-9 for i, n in extra)


