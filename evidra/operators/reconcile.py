"""Uploads against a system of record: duplicates are ignored, conflicts recorded, new rows added; nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import same, signature_keys

# fixed values: the key of each source, and natural ids that must stay unique beside it
SOURCE_KEYS = {
    "trial": "TRIAL_GUID", "trial_recommendations": "TRIAL_GUID", "operations": "OPERATION_GUID", "observations": "OBSERVATION_UUID",
    "germplasm": "MATERIAL_GUID", "genomics": "MATERIAL_GUID", "candidate_recommendations": "MATERIAL_GUID",
    "trial_germplasm_bridge": "TRIAL_ENTRY_GUID", "trait_dictionary": "TRAIT_GUID",
}
NATURAL_KEYS = {"germplasm": "MATERIAL_ID", "trial": "TRIAL_ID", "candidate_recommendations": "MATERIAL_ID", "trait_dictionary": "TRAIT_CODE"}


_CONFLICTS = "array<struct<field:string,export:string,upload:string>>"


def _key(key: str):
    return F.trim(F.col(key).cast("string"))


def _order(columns: list[str]):
    """A row's place among rows of one key: by all its values as text, which any plan and any partitioning give alike."""
    return F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_o{i}") for i, c in enumerate(sorted(columns))])


def _differences(columns: list[str], held: str):
    cells = [
        F.when(
            F.col(c).isNotNull() & ~same(F.col(f"{held}.{c}"), F.col(c)),
            F.struct(F.lit(c).alias("field"), F.col(f"{held}.{c}").cast("string").alias("export"), F.col(c).cast("string").alias("upload")),
        )
        for c in columns
    ]
    return F.array_compact(F.array(*cells)) if cells else F.array().cast(_CONFLICTS)


def classify(base: DataFrame, upload: DataFrame, key: str, natural: str | None = None) -> DataFrame:
    """The uploaded rows with outcome (duplicate, conflict, new, natural_clash) and conflicts (list of field, export, upload).

    Only non-null uploaded cells in common columns are compared. Keys are compared as trimmed text; rows without a key are new. If the
    base repeats a key, its least row by text is the one of record. Of uploaded rows that share a key the base lacks, the least is new
    and the others are duplicates of it or conflicts with it, so that a key comes in once; a natural id likewise: the least key owns it.
    """
    common = [c for c in upload.columns if c in base.columns and c != key]
    held = base.where(_key(key).isNotNull()).groupBy(_key(key).alias("_key")).agg(F.min_by(F.struct(*[F.col(c) for c in base.columns]), _order(base.columns)).alias("_b"))
    rows = upload.withColumn("_at", _key(key))
    # of rows that share a key, the first and each one's place: in the same order and partitions that the join wants
    w = Window.partitionBy("_at").orderBy(_order(upload.columns))
    keyed = rows.where(F.col("_at").isNotNull()).withColumn("_nth", F.row_number().over(w)).withColumn("_f", F.first(F.struct(*[F.col(c) for c in upload.columns])).over(w))
    j = keyed.join(held, F.col("_at") == F.col("_key"), "left")
    j = j.unionByName(rows.where(F.col("_at").isNull()).withColumn("_nth", F.lit(1)), allowMissingColumns=True)  # without a key: by themselves
    known = F.col("_key").isNotNull()
    j = j.withColumn("_nth", F.when(~known, F.col("_nth")).otherwise(1))
    others = [c for c in upload.columns if c != key]
    found = F.when(known, _differences(common, "_b")).when(F.col("_nth") > 1, _differences(others, "_f")).otherwise(F.array().cast(_CONFLICTS))
    out = j.withColumn("conflicts", found)
    clash = F.lit(False)
    if natural and natural in base.columns and natural in upload.columns:
        name = F.col(natural).cast("string")
        owners = base.where(F.col(natural).isNotNull()).groupBy(name.alias("_natural")).agg(F.min(F.col(key).cast("string")).alias("_owner"))
        out = out.join(owners, name == F.col("_natural"), "left")
        # of new keys in this upload that claim one natural id, the least gets it
        claims = out.where(~known & F.col(natural).isNotNull()).groupBy(name.alias("_claimed")).agg(F.min("_at").alias("_claimant"))
        out = out.join(claims, name == F.col("_claimed"), "left")
        clash = F.col("_owner").isNotNull() | (F.col("_claimant").isNotNull() & (F.coalesce("_at", F.lit("")) != F.col("_claimant")))
    twice = F.col("_nth") > 1
    outcome = F.when((known | twice) & (F.size("conflicts") > 0), "conflict").when(known | twice, "duplicate").when(clash, "natural_clash").otherwise("new")
    return out.withColumn("outcome", outcome).select(*upload.columns, "outcome", "conflicts")


def merge(base: DataFrame, uploads: list[DataFrame], key: str | None, natural: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged rows, log of outcomes by upload), uploads in the order they arrived. Without a key, whole rows are compared."""
    log = None
    merged = base
    for i, up in enumerate(uploads):
        if key is None or key not in up.columns or key not in merged.columns:
            added, part = add_rows(merged, up)
        else:
            marked = classify(merged, up, key, natural)
            added = marked.where("outcome = 'new'").select(*up.columns)
            part = marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
        part = part.withColumn("upload", F.lit(i))
        log = part if log is None else log.unionByName(part)
        merged = merged.unionByName(added.select(*[F.col(c).cast(dict(merged.dtypes).get(c, t)).alias(c) for c, t in added.dtypes]), allowMissingColumns=True)
    return merged, log


def add_rows(base: DataFrame, upload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose signature over the shared columns the base lacks, once each, and the counts of both outcomes."""
    shared = sorted(c for c in upload.columns if c in base.columns)

    def hashed(df: DataFrame) -> DataFrame:
        a, b = signature_keys({c: dict(df.dtypes)[c] for c in shared})
        return df.withColumns({"_s": a, "_t": b})

    known = hashed(base.select(*shared)).select("_s", "_t").distinct().withColumn("_known", F.lit(True))
    once = hashed(upload).groupBy("_s", "_t").agg(F.count(F.lit(1)).alias("_copies"), F.min_by(F.struct(*upload.columns), _order(upload.columns)).alias("_r")).join(known, ["_s", "_t"], "left")
    new = once.where("_known is null")
    counts = once.agg(F.count_if(F.col("_known").isNull()).alias("new"), (F.sum("_copies") - F.count_if(F.col("_known").isNull())).alias("duplicate"))
    cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.coalesce(F.col(o), F.lit(0)).alias("n")) for o in ("new", "duplicate")])
    return new.select("_r.*"), counts.select(F.explode(cells).alias("c")).select("c.*")


def provenance_issues(log: DataFrame, source: str) -> DataFrame:
    """Issues for conflicts and ignored duplicates of a merge."""
    kind = F.when(F.col("outcome").isin("conflict", "natural_clash"), "provenance.conflict").when(F.col("outcome") == "duplicate", "provenance.duplicate")
    rows = log.withColumn("id", kind).where("id is not null and n > 0")
    return rows.groupBy("id").agg(F.sum("n").alias("count")).select(
        "id", F.lit("provenance").alias("category"), F.when(F.col("id") == "provenance.conflict", "warning").otherwise("info").alias("severity"),
        "count", F.lit(source).alias("source"), F.when(F.col("id") == "provenance.conflict", "proposed").otherwise("applied").alias("fix_status"),
    )
