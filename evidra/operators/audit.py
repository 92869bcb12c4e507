"""Append-only log of human decisions and the state it implies."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relational

# fixed values: colours and reason codes
COLOURS = ("RED", "AMBER", "GREEN")
REASONS = ("FIELD_OBSERVATION", "DATA_ERROR", "MARKET_FIT", "PEDIGREE_KNOWLEDGE", "ENVIRONMENT_CONTEXT", "STRATEGIC_KEEP", "OTHER")
SCHEMA = "seq long, at timestamp, user string, level string, record string, engine_colour string, new_colour string, reason string, comment string, rule_version string"


def validate(new_colour: str, reason: str, comment: str | None) -> None:
    if new_colour not in COLOURS:
        raise ValueError(f"unknown colour {new_colour}")
    if reason not in REASONS:
        raise ValueError(f"unknown reason {reason}")
    if reason == "OTHER" and not (comment or "").strip():
        raise ValueError("OTHER needs a comment")


class OverrideLog:
    """JSON lines that are only ever appended; there is no way to update or delete."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def record(self, user: str, level: str, record: str, engine_colour: str, new_colour: str, reason: str, comment: str | None = None, rule_version: str = "") -> None:
        validate(new_colour, reason, comment)
        # time first, then chance: two writers at once get different numbers, and no writer reads the log
        now = datetime.now(timezone.utc)
        seq = int(now.timestamp() * 1_000_000) << 10 | uuid.uuid4().int & 1023
        row = (seq, now, user, level, record, engine_colour, new_colour, reason, comment, rule_version)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def latest(self) -> DataFrame:
        return relational.latest(self.read(), ["level", "record"], "seq")


def effective(decisions: DataFrame, overrides: DataFrame, record: str, level: str) -> DataFrame:
    """decisions with effective_colour and overridden; the engine's colour stays as it is. overrides: latest row of each record."""
    o = overrides.where(F.col("level") == level).select(F.col("record").alias("_r"), F.col("new_colour").alias("_c"))
    out = decisions.join(o, F.col(record).cast("string") == F.col("_r"), "left")
    return out.withColumns({"effective_colour": F.coalesce("_c", "colour"), "overridden": F.col("_c").isNotNull()}).drop("_r", "_c")


def colour_counts(decided: DataFrame) -> DataFrame:
    """One row: counts by colour as decided and as effective, and how many were overridden."""
    cols = [F.count_if(F.col("colour") == c).alias(f"engine_{c.lower()}") for c in COLOURS]
    cols += [F.count_if(F.col("effective_colour") == c).alias(f"effective_{c.lower()}") for c in COLOURS]
    return decided.agg(*cols, F.count_if("overridden").alias("n_overridden"))


def reusable(cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """cards with the latest verified justification of the same candidate, rule version and evidence hash."""
    keys = ["candidate_id", "rule_version", "evidence_hash"]
    done = reviews.where("verified").groupBy(*keys).agg(F.max_by("justification", "seq").alias("justification"))
    return cards.join(done, keys, "left")


def evidence_hash(evidence) -> object:
    """SHA-256 of evidence as canonical JSON: fields in the struct's order."""
    return F.sha2(F.to_json(evidence), 256)
