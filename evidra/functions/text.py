"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canon import fold

#: What a word is made of, in any script: letters, numbers and the underscore.
WORD = r"[\p{L}\p{N}_]"


def shape(c: Column) -> Column:
    """Each character's class: A, a, 9, or itself."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "A"), "[a-z]", "a"), r"\d", "9")


def runs(shaped: Column) -> Column:
    """Run-length form of a shape: AAA-99 gives A{3}-9{2}."""
    chars = F.split(shaped, "")
    step = lambda acc, ch: F.when(
        acc["last"] == ch, F.struct(ch.alias("last"), (acc["n"] + 1).alias("n"), acc["out"].alias("out"))
    ).otherwise(F.struct(ch.alias("last"), F.lit(1).alias("n"), _put(acc).alias("out")))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit("").alias("out"))
    return F.aggregate(chars, start, step, _put)


def _put(acc: Column) -> Column:
    many = F.concat(acc["out"], acc["last"], F.lit("{"), acc["n"].cast("string"), F.lit("}"))
    return F.when(acc["n"] > 1, many).otherwise(F.concat(acc["out"], acc["last"]))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD}+)"), 1)


def char_ngrams(c: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """All n-grams of folded tokens padded with one space at both ends; digits count as 0."""
    tokens = F.regexp_extract_all(F.regexp_replace(fold(c), r"\p{Nd}", "0"), F.lit(f"({WORD}+|[/%])"), 1)
    padded = F.transform(tokens, lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    return F.flatten(F.flatten(F.array(*[F.transform(padded, _grams(n)) for n in sizes])))


def _grams(n: int):
    def of(p: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(p) - (n - 1))
        return F.when(F.length(p) >= n, F.transform(at, lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return of


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def numbers(c: Column) -> Column:
    """The distinct numbers of a text, decimal commas as points, without trailing zeros."""
    raw = F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)
    plain = F.transform(raw, lambda x: F.regexp_replace(x, ",", "."))
    return F.array_distinct(F.transform(plain, lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")))


def strip_tags(html: Column) -> Column:
    """Text of a page: script, style and noscript content and all tags removed, white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, halves to even. format_string() rounds the shortest decimal
    text instead, so that 94.85 (which is a little less) would be 94.9.

    Twice the scaled value is taken as the sum of a double and its error, after splitting the number in two halves whose products with a
    small integer are exact.
    """
    x, twice = c.cast("double"), 2.0 * 10**digits
    big = x * 134217729.0
    high = big - (big - x)
    product = x * twice
    error = (high * twice - product) + (x - high) * twice
    whole = F.floor(product / 2)
    rest = product - 2.0 * whole
    up = (rest > 1) | ((rest == 1) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    exact = F.format_string(f"%.{digits}f", (whole + up.cast("long")) / 10**digits)
    return F.when(F.abs(x) < 1e11, exact).otherwise(F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)))
