"""Rule bitmask ledger: every rule is evaluated once into a bit and its measurements are kept; policies and ablations are bit arithmetic.

Only DataFrame functions run here. Null text counts as empty text; null doc_ids stay null; each row is judged by itself, so
repeated rows give repeated ledger rows; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, stored, table, words_col

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column | str  #: SQL predicate over the measurements; true sets the bit


#: The position is the bit. Bits are never reused: a rule that is retired keeps its place.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("upper_case", "10 * n_upper > 3 * word_chars"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named version of a decision: a document goes if any of these rules failed."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", ("few_words", "repeated_windows", "symbols", "upper_case", "duplicate_lines", "word_length"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and one column for each measurement. Steps are separate projections so that shared arrays are built once."""
    full = F.coalesce(F.col("text"), F.lit(""))
    w = docs.select("doc_id", full.alias("text"), words_col(F.col("text")).alias("words"))
    w = w.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(WS)) != ""))
    w = w.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("hashes"),
    )
    # windows that occur twice or more in the text, found as equal neighbours of the sorted hashes; most texts have none
    w = w.withColumn(
        "runs",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")),
    )
    at = lambda i: F.get("runs", i)["h"]
    same = lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False))
    starts = F.sort_array(F.transform(F.filter("runs", same), lambda x: x["p"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return w.select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits: bit i is set if rules[i] failed."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        failed = F.expr(rule.fails) if isinstance(rule.fails, str) else rule.fails
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds kept and policy, from the stored bits alone: no text is read again."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(policy.mask(rules)) == 0).withColumn("policy", F.lit(policy.version))


def ablation(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents it fails, documents it alone fails (kept without it) and documents that the policy keeps.

    The ledger is first counted by bit pattern, of which there are at most 2 to the number of rules.
    """
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(policy.mask(rules)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    marks = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules])
    each = patterns.select("bits", "n", F.explode(marks).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once: the ledger is written, and policies work on what it holds
    led = apply_policy(stored(ledger(table(spark, sf_dir, "documents")), "ledger"), STANDARD)
    base = F.col("fail_bits").bitwiseAND(BASE.mask()) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM
    (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM k WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '\P{Lu}', '', 'g'))::BIGINT AS n_upper,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN ll ON d.doc_id = ll.doc_id LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_upper > 3 * word_chars)::INT + 16 * (2 * n_dup_lines > n_lines)::INT + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
