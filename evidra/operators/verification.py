"""Do the numbers and ids of an answer occur in the evidence it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, numbers
from . import facts

# fixed values: number words that must occur in the evidence as words
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "dozen", "hundred", "thousand", "half", "double", "twice")
ID = r"\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b"


def ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(f"({ID})"), 1))


def without_ids(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){ID}", " ")


def number_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(NUMBER_WORDS)})\b"), 1))


def check(rows: DataFrame, answer: str, evidence: str, colour: str | None = None) -> DataFrame:
    """Adds unknown_ids, unknown_numbers, unknown_words and status: the first of unknown_id, unknown_number, number_word, wrong_colour
    that applies, else verified. Numbers inside ids do not count. colour: the column of the decided colour."""
    a, e = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(evidence), F.lit(""))
    out = rows.withColumns(
        {
            "unknown_ids": F.array_except(ids(a), ids(e)),
            "unknown_numbers": F.array_except(numbers(without_ids(a)), numbers(without_ids(e))),
            "unknown_words": F.array_except(number_words(a), number_words(e)),
        }
    )
    wrong = F.lit(False)
    if colour:
        named = F.array_distinct(F.regexp_extract_all(F.upper(a), F.lit(r"\b(RED|AMBER|GREEN)\b"), 1))
        wrong = F.exists(named, lambda c: c != F.upper(F.col(colour)))
    status = (
        F.when(F.size("unknown_ids") > 0, "unknown_id")
        .when(F.size("unknown_numbers") > 0, "unknown_number")
        .when(F.size("unknown_words") > 0, "number_word")
        .when(F.coalesce(wrong, F.lit(False)), "wrong_colour")
        .otherwise("verified")
    )
    return out.withColumn("status", status)


def cited_values(answers: DataFrame, key: str, text: str, evidence: DataFrame) -> DataFrame:
    """(key, sentence_no, field, value, unit, stored, status) of every value that an answer states. evidence: (key, field, value_num),
    which may hold several values of a field.

    A value is supported if a stored one is what it rounds to at the decimals that were printed (percent signs and units aside),
    contradicted if the field has other values only, and unknown if the key has no value of the field.
    """
    said = facts.extract(answers, key, text).where(F.col("value").isNotNull())
    digits = F.length(F.regexp_extract("printed", r"[.,](\d+)$", 1))
    said = said.withColumn("_half", 0.5 * F.pow(F.lit(10.0), -digits) + 1e-9)
    held = evidence.select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.col("value_num").cast("double").alias("_v")).where("_v is not null")
    # of the stored values of a field the nearest: one row a value that was said
    lists = held.groupBy("_k", "_f").agg(F.collect_set("_v").alias("_all"))
    j = said.join(lists, (F.col(key) == F.col("_k")) & (F.col("field") == F.col("_f")), "left")
    near = F.array_min(F.transform("_all", lambda v: F.struct(F.abs(v - F.col("value")).alias("gap"), v.alias("v"))))
    j = j.withColumn("_near", near)
    status = F.when(F.col("_near").isNull(), "unknown").when(F.col("_near.gap") <= F.col("_half"), "supported").otherwise("contradicted")
    return j.select(key, "sentence_no", "field", "value", "unit", F.col("_near.v").alias("stored"), status.alias("status"))


def fallback(record: Column, colour: Column, reason: Column) -> Column:
    """A sentence that only says what was decided."""
    return F.concat(record, F.lit(" is "), colour, F.lit(": "), reason, F.lit("."))


def distinct_warnings(rows: DataFrame, key: list[str], seq: str, message: str, least: float = 0.5) -> DataFrame:
    """The warnings that no earlier one of the same key repeats: alike words (Jaccard) and equal numbers.

    Pairs are only formed inside a key between warnings with the same numbers; which rows stay is decided in order by a fold over the
    group's distinct word sets.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(message), F.lit(r"([^\W\d_]+)"), 1)))
    x = rows.withColumns({"_words": words, "_numbers": F.array_sort(numbers(F.col(message)))})
    first = x.groupBy(*key, "_numbers", "_words").agg(F.min(F.struct(F.col(seq), F.col(message))).alias("_first"))
    lists = first.groupBy(*key, "_numbers").agg(F.array_sort(F.collect_list(F.struct(F.col(f"_first.{seq}").alias("s"), F.col("_words").alias("w"), F.col(f"_first.{message}").alias("m")))).alias("l"))
    fresh = lambda acc, y: F.when(F.exists(acc, lambda k: jaccard(k["w"], y["w"]) >= least), acc).otherwise(F.concat(acc, F.array(y)))
    start = F.slice("l", 1, 0)
    kept = lists.withColumn("k", F.aggregate("l", start, fresh))
    return kept.select(*key, F.explode("k").alias("y")).select(*key, F.col("y.s").alias(seq), F.col("y.m").alias(message))
