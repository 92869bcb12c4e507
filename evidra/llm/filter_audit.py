"""Filter interaction audit: what each of five filters removes in every order of applying them.

Every document is judged by all filters once, which gives a mask of five bits. Whether an earlier document has the same text is decided
by grouping texts: the smallest doc_id of each is kept, and a document that is not it fails. Documents are then counted by part and
mask, at most 32 cells a part, and every order of the filters is worked out from the cells alone: what a filter removes after the set S
of earlier filters is what passes S less what passes S and the filter.

Only DataFrame functions run here. Texts are grouped by their SHA-256, so that they are read once and no copy of them is shuffled; a
text that many documents share is one row a task before the shuffle, and the smallest doc_ids are joined by doc_id, which spreads them.

Null text counts as empty text (too short, equal to other empty texts); a null source is the part ``""``. A null doc_id is no smaller
than any other and has no labels, hence never repeats a text. Rows alike in doc_id and text don't repeat each other. A doc_id with
several label rows has a label if any of them says so. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words_col

#: What fails a document, by letter; bit i belongs to the i-th. The last is decided between documents.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "has_symbol",
    "E": "repeats",
}
CELLS = 1 << len(FILTERS)
COUNTS = ("n", "good", "toxic")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, the digest of the text and what the filters ask of a text by itself."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"), words_col(F.col("text")).alias("words"))
    return w.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length("text").alias("n_chars"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
        F.col("text").rlike(r"[#$%&*|]").alias("has_symbol"),
    )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit i set if the i-th filter fails the document), good and toxic (0 or 1)."""
    alone = [c for c in FILTERS if c != "E"]
    bits = sum((F.expr(FILTERS[c]).cast("long") * (1 << "ABCDE".index(c)) for c in alone), F.lit(0).cast("long"))
    rows = stored(measured(docs).select("doc_id", "part", "digest", bits.alias("mask")), "masks")
    named = rows.where("doc_id is not null")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    known = named.join(marks, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("first").isNull(), 1 << "ABCDE".index("E")).otherwise(0))
    known = known.select("doc_id", "part", "mask", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])
    zero = F.lit(0).cast("long")
    return known.unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask", zero.alias("good"), zero.alias("toxic")))


def histogram(marked: DataFrame) -> DataFrame:
    """part, mask and how many documents have it (n), of them good and toxic ones."""
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _at(values: str, i: Column) -> Column:
    return F.get(F.col(values), i.cast("int"))


def orders(cells: DataFrame) -> DataFrame:
    """Of each part every order of the filters and every step: what is kept after it, what it removes, and how it meets the others."""
    n = len(FILTERS)
    passing = lambda s, c: F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0))
    parts = cells.groupBy("part").agg(
        *[F.array(*[passing(s, c) for s in range(CELLS)]).alias(c) for c in COUNTS],
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]).alias("alone"),
    )
    # of the orders of all filters, |S|! (n - 1 - |S|)! have just the set S before the filter
    before = [[(s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(CELLS) if not s >> i & 1] for i in range(n)]
    removed_in_all = [sum(((F.col("n")[s] - F.col("n")[s | 1 << i]) * times for s, times in before[i]), F.lit(0)) for i in range(n)]
    parts = parts.select("part", *COUNTS, "alone", F.array(*removed_in_all).alias("in_all"))
    every = ",".join("".join(p) for p in permutations(FILTERS))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(every), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = {c: F.instr("filter_order", c) for c in FILTERS}
    earlier = sum((F.when(place[c] < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    own, bit = (sum((F.when(place[c] == F.col("step"), x).otherwise(0) for c, x in zip(FILTERS, values)), F.lit(0)) for values in (range(n), [1 << i for i in range(n)]))
    steps = steps.withColumns({"earlier": earlier, "own": own, "bit": bit})
    after = F.col("earlier") + F.col("bit")
    lost = {c: _at(c, F.col("earlier")) - _at(c, after) for c in COUNTS}
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        _at("n", after).alias("kept"),
        lost["n"].alias("removed"),
        (F.col("n")[0] - _at("n", F.col("bit")) - lost["n"]).alias("redundant"),
        _at("alone", F.col("own")).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        _at("in_all", F.col("own")).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(histogram(masks(docs, labels)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS lo FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) AS c,
    regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > f.lo, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM d JOIN f ON d.text = f.text LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
    || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM c GROUP BY ALL),
o(filter_order, n) AS (SELECT '', 0 UNION ALL SELECT filter_order || x, n + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
p AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE n = 5),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT hit AND NOT contains(fails, own) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT hit AND contains(fails, own) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND contains(fails, own) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT hit AND contains(fails, own) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT hit AND contains(fails, own) THEN toxic ELSE 0 END) AS toxic_lost
    FROM (SELECT *, length(translate(fails, earlier, '')) < length(fails) AS hit FROM g, p) GROUP BY ALL),
s AS (SELECT part, own, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT r.part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley FROM r JOIN s ON r.part = s.part AND r.own = s.own
"""
