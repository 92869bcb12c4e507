"""The text index against looking into every text."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from evidra.operators import search

ROWS = [
    ("material", 1, "name", "Supplier#000000001"), ("material", 2, "name", "Größe ŷ Naïve"), ("trial", 1, "reason", "Yield is BELOW  the limit"), ("trial", 2, "reason", "yield\nis fine"),
    ("trial", 3, "reason", None), ("trial", 4, "reason", "ab"), ("trial", 5, "reason", ""), ("sentence", 7, "0", "Привет мир, SYN-MZ-00042."), ("sentence", 7, "1", "aaaa bbbb aaaa"),
]


def plain(rows, needle):
    def folded(t):
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().split())

    return sorted((k, str(i), f) for k, i, f, t in rows if t is not None and folded(needle) in folded(t))


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "kind string, id long, field string, text string")


def test_needles_of_all_kinds(spark, frame, tmp_path):
    index = search.TextIndex(spark, f"file://{tmp_path}/i")
    assert index.search("yield").count() == 0
    index.add(frame(ROWS))
    for needle in ("yield is", "YIELD IS BELOW THE", "naive", "größe", "мир, syn", "00042", "ab", "", "x", "aaaa", "aaaaa", "supplier#0000", "is fine", "zzz"):
        assert sorted((r["kind"], r["id"], r["field"]) for r in index.search(needle).collect()) == plain(ROWS, needle), needle


def test_updates_and_merged_runs(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    index = search.TextIndex(spark, f"file://{tmp_path}/i", fanout=2)
    rows = {}
    for step in range(5):
        part = [(k, i + step, f, t if t is None else f"{t} v{step}") for k, i, f, t in ROWS[: 9 - step]]
        index.add(frame(part))
        for k, i, f, t in part:
            if t is not None:
                rows[k, i, f] = t
        now = [(*k, t) for k, t in rows.items()]
        for needle in ("yield is", "v0", f"v{step}", "aaaa v", "000001 v2"):
            assert sorted((r["kind"], r["id"], r["field"]) for r in index.search(needle).collect()) == plain(now, needle), (step, needle)
        assert len(index.state()["lists"]) <= 2 and len(index.state()["texts"]) == step + 1
    lists = spark.read.schema(search.LISTS).parquet(*index.state()["lists"])
    assert lists.agg(F.max(F.size("numbers"))).first()[0] <= 3


def test_a_search_reads_the_lists_of_its_trigrams_only(spark, data, tmp_path):
    index = search.TextIndex(spark, f"file://{tmp_path}/i")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    index.add(search.sentence_texts(docs, "doc_id"))
    plan = index.candidates("yield")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    some = search.sentence_texts(docs, "doc_id").where("text like '%ing the%'").limit(1).first()
    needle = some["text"][:20]
    want = {(r["id"], r["field"]) for r in search.sentence_texts(docs, "doc_id").collect() if plain([("", 0, "", r["text"])], needle)}
    assert {(r["id"], r["field"]) for r in index.search(needle).collect()} == want
