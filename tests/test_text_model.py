"""Words, folds, similarities and the relevance gate against plain Python, in several scripts."""

import math
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import canon, text
from evidra.operators import relevance
from evidra.plans import queries

TEXTS = [
    "Привет мир урожай поле зерно хлеб ёж Йод", "今日は良い天気です 收穫２０２４年 ｶﾀｶﾅ テスト", "straße über naïve Ế ở ﬁne Ｆｕｌｌ Å² ĝ ŵ ǒ ½ Ⅻ", "हिन्दी में पाठ ०१२ العربية ٣٤ עברית שָׁלוֹם",
    "ΟΔΥΣΣΕΥΣ ΣΑΣ İstanbul DŽ ﷺ", "plain  ASCII\ttext\x1f9.4 t/ha 12%\x0b_x_", "", "    ", "한국어 텍스트", "é ́ a‍b", "Zeile zwei\x85drei",
]


def plain_fold(t):
    out = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", out.lower()).strip()


def plain_grams(t):
    out = Counter()
    for token in re.findall(r"\w+|[/%]", re.sub(r"\d", "0", plain_fold(t))):
        p = f" {token} "
        out.update(p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1))
    return out


def test_folds_words_and_grams_in_many_scripts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string")
    rows = df.select("i", "t", canon.fold(F.col("t")).alias("f"), text.words(F.col("t")).alias("w"), text.char_ngrams(F.col("t")).alias("g")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["f"] is None
            continue
        assert r["f"] == plain_fold(r["t"]) and r["w"] == re.findall(r"\w+", r["t"]) and Counter(r["g"]) == plain_grams(r["t"])
    assert len(rows[0]["w"]) == 8 and len(rows[1]["g"]) > 20


def test_every_letter_of_the_basic_plane(spark):
    """Folds equal unicodedata's, word letters those of Python's re, for every character that both sides know."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    rows = df.select("c", canon.fold(F.concat(F.lit("a"), "c", F.lit("b"))).alias("f"), F.size(text.words(F.col("c"))).alias("w"), F.expr("regexp_like(c, '\\\\A\\\\p{Cn}\\\\z')").alias("unknown")).collect()
    assert len(rows) == len(chars) > 50_000
    assert [r["c"] for r in rows if r["f"] != plain_fold(f"a{r['c']}b")] == []
    assert [r["c"] for r in rows if not r["unknown"] and r["w"] != len(re.findall(r"\w", r["c"]))] == []


LEXICON = {"урожай": 2.0, "yield trial": 3.0, "yield": 1.0, "ﬁeld": 1.5, "Größe": 1.0}
EXAMPLES = [
    (1, "yield trial of maize in the field, урожай", 1), (2, "the yield of the field was 9.4 t/ha", 1), (3, "plant breeding trial with yield and Größe", 1), (4, "урожай зерно поле", 1),
    (5, "the football match ended two to one", 0), (6, "invoice for the holiday hotel, total 120", 0), (7, "футбол матч счет", 0), (8, "la factura del hotel y el partido", 0), (9, "", 0),
]


def plain_features(rows, pool, i):
    """Lexicon feature and contrast of example i against the pool (counted anew)."""
    grams = [plain_grams(t) for _, t, _ in rows]
    df = Counter(g for j in pool for g in grams[j])
    idf = {g: math.log((1 + len(pool)) / (1 + n)) + 1 for g, n in df.items()}
    vec = lambda j: {g: (1 + math.log(n)) * idf[g] for g, n in grams[j].items() if g in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(i)

    def cosine(j):
        v = vec(j)
        return sum(x * v.get(g, 0) for g, x in q.items()) / (norm(q) * norm(v)) if q and v else 0.0

    top = lambda label: sorted((cosine(j) for j in pool if rows[j][2] == label), reverse=True)[:3]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return [plain_lexicon(rows[i][1]), mean(top(1)) - mean(top(0))]


def plain_lexicon(t):
    f = plain_fold(t)
    weights = {plain_fold(k): v for k, v in LEXICON.items()}
    hits = re.findall(r"(?<!\w)(" + "|".join(sorted(map(re.escape, weights), key=len, reverse=True)) + r")(?!\w)", f)
    return math.log1p(100 * sum(weights[h] for h in hits) / max(20, len(re.findall(r"\w+", f))))


def plain_model(rows, pool):
    x = np.array([plain_features(rows, [j for j in pool if j != i], i) for i in pool])
    y = np.array([rows[i][2] for i in pool], float)
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z, w = np.column_stack([np.ones(len(x)), (x - mean) / sd]), np.zeros(3)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1.0]), z.T @ (p - y) + np.array([0, 1, 1]) * w)
    return lambda f: 1 / (1 + math.exp(-(w[0] + float(w[1:] @ ((np.array(f) - mean) / sd)))))


def test_nested_leave_one_out_equals_counting_again(spark):
    df = spark.createDataFrame(EXAMPLES, "example int, text string, label int")
    got = {r["example"]: r for r in relevance.leave_one_out(df, LEXICON).collect()}
    everyone = list(range(len(EXAMPLES)))
    for i, (name, _, label) in enumerate(EXAMPLES):
        pool = [j for j in everyone if j != i]
        p = plain_model(EXAMPLES, pool)(plain_features(EXAMPLES, pool, i))
        assert got[name]["probability"] == pytest.approx(p, abs=1e-7) and got[name]["label"] == label
    report = relevance.leave_one_out_report(spark.createDataFrame(list(got.values()))).first()
    assert report["n"] == 9 and report["decided"] + report["uncertain"] == 9
    assert report["accuracy"] == pytest.approx(sum((r["probability"] >= 0.5) == (r["label"] == 1) for r in got.values()) / 9)


def test_the_gate_equals_plain_python_and_facts_decide_alone(spark):
    df = spark.createDataFrame(EXAMPLES, "example int, text string, label int")
    docs = [(i, t, False) for i, t in enumerate([*TEXTS, None, "see syn-mz-00042 now", "GUID ABC-1234", "one two", "the yield trial in the field урожай поле зерно", "match of football and a hotel invoice total"])] + [(90, "x", True)]
    known = spark.createDataFrame([("SYN-MZ-00042",), ("OTHER1",)], "id string")
    rows = relevance.assess(spark.createDataFrame(docs, "i int, t string, has_table boolean"), "i", "t", df, LEXICON, known, [r"\b[A-Z]{3}-\d{4}\b"], "has_table").collect()
    got = {r["i"]: r for r in rows}
    everyone = list(range(len(EXAMPLES)))
    model = plain_model(EXAMPLES, everyone)
    assert len(rows) == len(docs)
    for i, t, tabled in docs:
        r, t = got[i], t or ""
        f = plain_features([*EXAMPLES, (0, t, 2)], everyone, len(EXAMPLES))
        assert r["n_words"] == len(re.findall(r"\w+", plain_fold(t))) and (r["feature"], r["delta"]) == pytest.approx(tuple(f), abs=1e-9)
        if tabled or "syn-mz-00042" in t or "ABC-1234" in t:
            assert (r["decision"], r["probability"]) == ("RELEVANT", 1.0) and r["reasons"]
        elif r["n_words"] < 5:
            assert (r["decision"], r["probability"], len(r["reasons"])) == ("UNCERTAIN", 0.5, 1)
        else:
            p = model(f)
            assert r["probability"] == pytest.approx(p, abs=1e-7) and r["decision"] == ("RELEVANT" if p >= 0.7 else "IRRELEVANT" if p <= 0.3 else "UNCERTAIN")
    assert got[0]["n_words"] == 8 and got[0]["decision"] != "UNCERTAIN" or got[0]["probability"] != 0.5


def test_examples_of_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "some words of the yield trial")], "i int, t string")
    schema = "example int, text string, label int"
    assert relevance.assess(docs, "i", "t", spark.createDataFrame([(1, "a yield", 1), (2, "b", 1)], schema), LEXICON).first()["decision"] == "RELEVANT"
    assert relevance.assess(docs, "i", "t", spark.createDataFrame([], schema), LEXICON).first()["probability"] == 0.5
    assert relevance.leave_one_out(spark.createDataFrame([], schema), LEXICON).count() == 0


def test_broadcast_and_joined_similarities_agree(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, "the yield of maize")], "q long, t string")
    ref = spark.createDataFrame([(i, t) for i, t, _ in EXAMPLES] + [(20, "今日は雨です"), (21, "!!")], "r int, t string")
    sides = [{(r["q"], r["r"]): r["cosine"] for r in relevance.similarity(docs, "q", "t", ref, "r", "t", limit).collect()} for limit in (10**9, 0)]
    assert sides[0].keys() == sides[1].keys() and len(sides[0]) > 10
    assert all(sides[1][k] == pytest.approx(v, rel=1e-9) for k, v in sides[0].items())
    assert relevance.similarity(docs, "q", "t", ref.limit(0), "r", "t").count() == 0


def test_the_gate_query_equals_plain_python(spark, data):
    rows = {r["doc_id"]: r for r in queries.QUERIES["text_relevance_gate"](spark, data).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"], r["item_id"] % 2) for r in spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").collect()]
    assert rows.keys() == docs.keys()
    everyone = list(range(len(items)))
    for i in sorted(docs)[:40]:
        module = sys.modules[__name__]
        weights, module.LEXICON = module.LEXICON, queries.LEXICON
        f = plain_features([*items, (0, docs[i] or "", 2)], everyone, len(items))
        module.LEXICON = weights
        assert (rows[i]["feature"], rows[i]["delta"]) == pytest.approx(tuple(f), abs=2e-6)


def test_examples_in_blocks_equal_examples_at_once(spark, monkeypatch):
    df = spark.createDataFrame([*EXAMPLES, (10, None, 0), (11, "the hotel", 2)], "example int, text string, label int")
    docs = [(i, t, i == 3) for i, t in enumerate([*TEXTS, None, "see syn-mz-00042 now", "GUID ABC-1234", "one two", "the yield trial in the field урожай поле зерно", "match of football and a hotel invoice total"])] + [(None, "a yield", True)]
    docs = spark.createDataFrame(docs, "i int, t string, has_table boolean")
    known = spark.createDataFrame([("SYN-MZ-00042",)], "id string")
    rows = lambda: sorted((tuple(r) for r in relevance.assess(docs, "i", "t", df, LEXICON, known, [r"\b[A-Z]{3}-\d{4}\b"], "has_table").collect()), key=str)
    whole, alone = rows(), [tuple(r) for r in relevance.leave_one_out(df, LEXICON).collect()]
    monkeypatch.setattr(relevance, "EXAMPLES", 3)
    monkeypatch.setattr(relevance, "PAIRS", 20)
    blocks = relevance.Blocks.dealt(df, LEXICON)
    assert blocks.texts == 10 and blocks.n == 4 and len({r["block"] for r in blocks.examples.select("block").collect()}) > 1
    got = rows()
    assert len(got) == len(whole) == docs.count() and len({r[3] for r in whole}) > 3
    for a, b in zip(got, whole):
        assert a[:2] + a[5:] == b[:2] + b[5:] and a[2:5] == pytest.approx(b[2:5], abs=1e-9)
    for a, b in zip([tuple(r) for r in relevance.leave_one_out(df, LEXICON).collect()], alone):
        assert (a[:2], a[3]) == (b[:2], b[3]) and a[2] == pytest.approx(b[2], abs=1e-9)


def test_no_labelled_example_is_left_out_of_the_model(spark):
    """The only examples of the domain are 2 of 1,502, and both count."""
    rows = [(i, f"invoice {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} hotel", 0) for i in range(1500)] + [(1500, "maize breeding yield", 1), (1501, "zerno урожай поле", 1)]
    df = spark.createDataFrame(rows, "example int, text string, label int")
    docs = spark.createDataFrame([(1, "зерно урожай поле поле урожай"), (2, "the maize breeding yield was good"), (3, "the hotel sent an invoice to us")], "i int, t string")
    got = {r["i"]: r for r in relevance.assess(docs, "i", "t", df, {"yield": 1.0}).collect()}
    everyone = range(len(rows))
    for i, t in [(r["i"], r["t"]) for r in docs.collect()]:
        assert got[i]["delta"] == pytest.approx(plain_features([*rows, (0, t, 2)], everyone, len(rows))[1], abs=1e-9)
    assert got[1]["delta"] > 0 and got[2]["delta"] > 0 and got[3]["delta"] < 0


def test_one_model_of_many_rows_equals_models_side_by_side(spark):
    from evidra.operators import calibration

    x = np.random.default_rng(2).normal(size=(200, 2)) * [1, 30] + [0, 7]
    for y in ((x[:, 0] + np.sin(x[:, 1]) > 0).astype(int), np.ones(200, int), np.zeros(200, int)):
        df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int").repartition(5)
        want = calibration.logistics(x, y, np.ones((1, 200), bool))
        for got, one in zip(calibration.logistic(df, ["a", "b"], "y"), want):
            assert got == pytest.approx(one[0], abs=1e-7)
    assert [v.tolist() for v in calibration.logistic(df.limit(0), ["a", "b"], "y")] == [[0, 0, 0], [0, 0], [1, 1]]
