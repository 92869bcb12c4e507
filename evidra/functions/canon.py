"""Values in one form, so that exports typed in different ways compare equal."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: texts that mean "missing", and the relative and absolute tolerance of equal numbers
MISSING = ("", "nan", "none", "null", "nat")
RTOL, ATOL = 1e-5, 1e-8
_ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def number(c: Column) -> Column:
    """A finite-or-infinite double; text that is no number, and NaN, give null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every float column: Spark orders NaN above all numbers, the data model treats it as missing."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def canon(c: Column, kind: str = "string") -> Column:
    """``num:``, ``bool:`` or ``ts:`` with the value, else the trimmed text; null if missing. kind: the column's type, if it is known;
    only text has to be parsed, and gives the same as a typed value."""
    if kind in _NUMBERS:
        x = c.cast("double")
        return F.when(~F.isnan(x), F.concat(F.lit("num:"), (x + F.lit(0.0)).cast("string")))
    if kind == "boolean":
        return F.concat(F.lit("bool:"), c.cast("string"))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.concat(F.lit("ts:"), F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    s = F.trim(c.cast("string"))
    low = F.lower(s)
    num = s.try_cast("double")
    # a cell that begins with no digit is no date: the pattern and the parser are not tried
    dated = F.substring(s, 5, 1) == "-"
    return (
        F.when(s.isNull() | low.isin(*MISSING), F.lit(None).cast("string"))
        .when(low.isin("true", "false"), F.concat(F.lit("bool:"), low))
        .when(num.isNotNull(), F.concat(F.lit("num:"), (num + F.lit(0.0)).cast("string")))
        .when(dated & s.rlike(_ISO) & F.try_to_timestamp(s).isNotNull(), F.concat(F.lit("ts:"), F.date_format(F.try_to_timestamp(s), "yyyy-MM-dd HH:mm:ss")))
        .otherwise(s)
    )


def same(a: Column, b: Column) -> Column:
    """Equal as canonical values; numbers within the tolerance, relative to b. Null on either side: equal only if both are null.
    Cells that are the same text are equal without being parsed."""
    x, y = number(F.trim(a.cast("string"))), number(F.trim(b.cast("string")))
    near = F.abs(x - y) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(y)
    parsed = F.when(x.isNotNull() & y.isNotNull(), near).otherwise(canon(a).eqNullSafe(canon(b)))
    return F.when(a.cast("string") == b.cast("string"), F.lit(True)).otherwise(parsed)


def signature(columns: list[Column]) -> Column:
    """One hash for a row's canonical values."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(canon(c), F.lit("\x00")) for c in columns]), 256)


def signature_keys(columns: dict[str, str]) -> list[Column]:
    """A row's canonical values as two independent 64-bit hashes, to join and group by. columns: name -> type."""
    text = F.concat_ws("\x1f", *[F.coalesce(canon(F.col(c), kind), F.lit("\x00")) for c, kind in columns.items()])
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


@lru_cache(100_000)
def _fold_word(t: str) -> str:
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
    return " ".join(plain.lower().split())


def fold_text(t: str) -> str:
    """Compatibility decomposition (NFKD) without combining marks, lower case, white space collapsed. Nothing in this reaches over white
    space, so that words are folded one by one, frequent ones once."""
    if t.isascii():
        return " ".join(t.lower().split())
    return " ".join(filter(None, [w.lower() if w.isascii() else _fold_word(w) for w in t.split()]))


FOLDED_AT_ONCE = 256  #: texts of a batch that are Python strings at a time


@F.arrow_udf(StringType())
def _decomposed(texts: pa.Array) -> pa.Array:
    parts = [texts.slice(i, FOLDED_AT_ONCE) for i in range(0, len(texts), FOLDED_AT_ONCE)]
    done = [pa.array([None if t is None else fold_text(t) for t in part.to_pylist()], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def fold(c: Column) -> Column:
    """fold_text() of a column. Texts of ASCII letters alone stay in the JVM; only the others go through Arrow batches."""
    ascii_only = F.octet_length(c) == F.length(c)
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\t-\r\x1c-\x1f ]+", " "))
    return F.when(ascii_only, plain).otherwise(_decomposed(F.when(~ascii_only, c)))
