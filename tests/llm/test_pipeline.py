import corpus_pipeline
from evidra.llm import decontam
from evidra.llm.common import DOC_COLUMNS, table

from .test_operators import texts


def test_stages_act_in_turn(spark, data):
    """Each stage against its own operator on the rows that the stage before kept, by plain Python over collected rows."""
    docs = table(spark, data, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data).persist()
        assert after.columns == list(DOC_COLUMNS)
        kept[name] = (dict(texts(docs)), dict(texts(after)))
        docs = after
    before, after = kept["language_id"]
    assert {i for i in before if i not in after} == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
    before, after = kept["line_dedup"]
    holders = {}
    for i, t in before.items():
        for key in {x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in (t or "").split("\n")}:
            if len(key) >= 20:
                holders.setdefault(key, []).append(i)
    for i, t in before.items():
        lines = [x for x in (t or "").split("\n") if not (len(h := holders.get(x.strip(" \t\n\x0b\x0c\r").encode().lower().decode(), [])) >= 3 and max(h) != i)]
        if i in after:
            assert after[i] == "\n".join(lines)
        else:
            assert not "".join(lines).strip()
    before, after = kept["simhash_near_dedup"]
    assert set(after) <= set(before) and len(set(after.values())) == len(after)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() for w in [t.lower().split()]}
    for i in set(before) - set(after):  # what went is like something that is left, or like something that went
        assert any(len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j]) for j in before if j != i)
    before, after = kept["benchmark_decontamination"]
    bench = [" ".join(decontam.item_words(r["text"])) for r in table(spark, data, "benchmark").collect()]
    flat = {i: f" {' '.join(decontam.item_words(t))} " for i, t in before.items()}
    leaks = {i for i, t in flat.items() if any(f" {b} " in t for b in bench)}
    assert not leaks & set(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    assert set(packed["doc_id"]) == set(after) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_empty_and_odd_documents_pass_through(spark, odd, none, data):
    counts = []
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data).persist()
            counts.append(docs.count())
    # texts without a letter go; lines that three documents share go, and so does the null id whose only line they share; one of each text stays
    assert counts[0] == 10 and counts[1] == 9 and counts[2] >= 6 and counts[4] > 0 and counts[5:] == [0] * 5
