"""Column profiles by information content; all columns of a table in one pass over long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import previous

# fixed values: columns that are labels, names that mark free text, and the shape of a GUID
LABELS = ("MATERIAL_ID", "TRIAL_ID", "SAMPLE_ID", "OBSERVATION_ID", "LINE")
TEXT_NAME = "RATIONALE|REMARK|DESCRIPTION|COMMENT|NOTE"
KEYS = ("MATERIAL_GUID", "GID", "TRIAL_GUID", "ATTACHED_TO_FIELD_ENTITY_ID", "LOCATION_GUID", "FIELD_ID")
GUID = r"(?i)^[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}$"
SAMPLE = 50


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value as text), a row for each cell."""
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def entropy_of(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log2(n / total))


def entropy(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, bits), with null as a symbol: two aggregates, the second over value counts. H = log2 N - sum(n log2 n) / N."""
    counts = value_counts(df, columns)
    return counts.groupBy("column").agg(
        F.greatest(F.lit(0.0), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy")
    )


def profile(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """column, rows, non_null, distinct, entropy, kind and role. order_by: the row index by which a row counter must rise."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    counts = value_counts(df, columns)
    text = F.col("value")
    known = text.isNotNull()
    number = text.try_cast("double").isNotNull()
    when = F.try_to_timestamp(text).isNotNull() & text.rlike(r"^\d{4}-\d{2}-\d{2}")
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count(text).alias("distinct"),
        F.greatest(F.lit(0.0), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"),
        F.coalesce(F.bool_and(F.when(known, number)), F.lit(False)).alias("all_numbers"),
        F.coalesce(F.bool_and(F.when(known, when)), F.lit(False)).alias("all_times"),
        F.coalesce(F.bool_and(F.when(known, text.rlike(GUID))), F.lit(False)).alias("all_guids"),
        F.coalesce(F.bool_and(F.when(known, number & (text.try_cast("double") == F.floor(text.try_cast("double"))))), F.lit(False)).alias("all_whole"),
        F.coalesce(F.avg(F.when(known, F.length(text))), F.lit(0.0)).alias("mean_length"),
    )
    typed = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])[F.col("column")]
    numeric = typed.rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$") | ((typed == "string") & F.col("all_numbers"))
    stats = stats.withColumn(
        "kind",
        F.when(F.col("non_null") == 0, "empty")
        .when((F.col("distinct") == 1) & (F.col("non_null") == F.col("rows")), "constant")
        .when(F.col("all_guids"), "id")
        .when(numeric, "numeric")
        .when(typed.rlike("^(date|timestamp.*)$") | F.col("all_times"), "datetime")
        .when(F.col("distinct") <= F.greatest(F.lit(20), F.col("non_null") * 0.05), "categorical")
        .otherwise("text"),
    )
    unique = (F.col("distinct") == F.col("rows")) & (F.col("rows") > 1)
    if order_by:
        rising = counters(df, columns, order_by)
        stats = stats.join(rising, "column", "left").withColumn("rises", F.coalesce("rises", F.lit(False)))
    else:
        stats = stats.withColumn("rises", F.col("all_whole"))
    role = (
        F.when(F.col("entropy") == 0, "drop")
        .when(F.col("column").isin(*KEYS), "key")
        .when(F.col("column").isin(*LABELS), "label")
        .when(F.col("column").rlike(TEXT_NAME), "text")
        .when((F.col("kind") == "id") | (unique & (F.col("kind") == "text")) | (unique & (F.col("kind") == "numeric") & F.col("rises") & F.col("all_whole")), "identifier")
        .when(F.col("kind") == "text", "text")
        .otherwise("feature")
    )
    return stats.select("column", "rows", "non_null", "distinct", "entropy", "kind", role.alias("role"))


def counters(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """(column, rises): whether numbers never fall in the order of a row index. Rows are compared inside ranges of the index, and then
    at the edges of ranges, so that no single task sees all rows."""
    x = df.select(F.col(order_by).alias("_i"), *[F.col(c).try_cast("double").alias(c) for c in columns])
    steps = previous(x, "_i", columns)
    falls = steps.agg(*[F.coalesce(F.bool_or(F.col(f"_was_{c}") > F.col(c)), F.lit(False)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (~F.col(c)).alias("rises")) for c in columns])
    return falls.select(F.explode(cells).alias("x")).select("x.*")


def summary(profiled: DataFrame) -> DataFrame:
    """Columns and bits by role."""
    return profiled.groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("entropy").alias("bits"))


def renormalise(df: DataFrame, profiled: DataFrame) -> DataFrame:
    """Keeps the columns that carry information; the profile has one row a column."""
    kept = {r["column"] for r in profiled.where("entropy > 0").select("column").collect()}
    return df.select(*[c for c in df.columns if c in kept])


def token_estimate(df: DataFrame) -> DataFrame:
    """(tokens): a quarter of the characters of the table as comma separated lines with a header, rounded up."""
    header = len(",".join(df.columns)) + 1
    line = F.length(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])) + 1
    return df.agg(F.ceil((F.coalesce(F.sum(line), F.lit(0)) + header) / 4).alias("tokens"))


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): the same for any order of the rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).select(
        "rows", F.sha2(F.concat_ws(":", "rows", "x", "s"), 256).alias("hash")
    )


def identifiers(df: DataFrame) -> DataFrame:
    """(id): distinct upper-case values of id columns, at least six characters with a letter and a digit."""
    columns = [c for c in df.columns if c.upper().endswith(("_ID", "_GUID", "_UUID"))]
    if not columns:
        return df.sparkSession.createDataFrame([], "id string")
    ids = long_form(df, columns).select(F.upper(F.trim("value")).alias("id"))
    return ids.where((F.length("id") >= 6) & F.col("id").rlike("[A-Z]") & F.col("id").rlike(r"\d")).distinct()


def ingestion(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, informative_columns, tokens_raw, tokens_renormalised) of each table, and all together as table null with
    the share of tokens that leaving out empty and constant columns saves."""
    out = None
    for name, df in tables.items():
        informative = [r["column"] for r in entropy(df, df.columns).where("entropy > 0").select("column").collect()]  # a row a column
        slim = df.select(*[c for c in df.columns if c in informative])
        one = token_estimate(df).select(F.col("tokens").alias("tokens_raw")).join(token_estimate(slim).select(F.col("tokens").alias("tokens_renormalised")))
        one = one.join(df.agg(F.count(F.lit(1)).alias("rows"))).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(len(informative)).cast("long").alias("informative_columns"), "tokens_raw", "tokens_renormalised"
        )
        out = one if out is None else out.unionByName(one)
    sums = [F.sum(c).alias(c) for c in ("rows", "columns", "informative_columns", "tokens_raw", "tokens_renormalised")]
    total = out.agg(*sums).withColumn("table", F.lit(None).cast("string"))
    every = out.unionByName(total)
    return every.withColumn("token_reduction", F.when(F.col("table").isNull(), 1 - F.try_divide(F.col("tokens_renormalised"), F.col("tokens_raw"))))
