"""Which logical source a table is, from its headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

MIN_SCORE = 0.6

# fixed values: header signatures of the logical sources, variants in order, and the aliases of the canonical keys
SIGNATURES: dict[str, list[list[str]]] = {
    "trial": ["TRIAL_GUID TRIAL_ID TRIAL_DESCRIPTION PROTOCOL_GUID TRIAL_TYPE_LID NO_OF_REPLICATIONS START_YEAR LOCATION_GUID BREEDING_GROUP_GUID".split()],
    "trial_recommendations": ["TRIAL_GUID YIELD_T_HA MOISTURE_PCT DISEASE_SCORE PLANT_HEIGHT_CM FLOWERING_DAYS TRIAL_RECOMMENDATION RECOMMENDATION_RATIONALE RULE_VERSION".split()],
    "operations": ["OPERATION_GUID OPERATION_TYPE_LID OPERATION_STATUS_LID OPERATION_DATE PLOT_NO TRIAL_GUID MATERIAL_GUID".split()],
    "lab_observations": ["TRAIT_GUID NUMBER_VALUE ALPHA_VALUE OBSERVATION_DATE MATERIAL_GUID CALCULATED INHERITED".split()],
    "observations": [
        "OBSERVATION_UUID OBSERVATION_ID ATTACHED_TO_FIELD_ENTITY_ID FIELD_ID GID REPLICATION_NO PLANTS_IN_PLOT SUBPLOT_ID BARCODE".split(),
        "OBSERVATION_GUID TRIAL_GUID MATERIAL_GUID TRAIT_CODE TRAIT_NAME OBSERVATION_VALUE OBSERVATION_UOM REPLICATION_NO".split(),
    ],
    "germplasm": ["MATERIAL_GUID MATERIAL_ID LINE_GUID PEDIGREE GENERATION_CODE FEMALE_PARENT_MATERIAL_GUID MALE_PARENT_MATERIAL_GUID ADVANCEMENT_DECISION".split()],
    "genomics": ["GENOMIC_SAMPLE_GUID MATERIAL_GUID MARKER_DROUGHT_TOLERANCE MARKER_DISEASE_RESISTANCE MARKER_YIELD_POTENTIAL MARKER_MATURITY GENOMIC_BREEDING_VALUE QC_CALL_RATE_PCT".split()],
    "candidate_recommendations": [
        "MATERIAL_GUID MATERIAL_ID N_TRIALS N_TRIALS_USED YIELD_VS_CHECK_PCT DISEASE_SCORE_MEAN MOISTURE_PCT_MEAN GERMINATION_PCT FUMONISIN_PPM SYSTEM_RAG SYSTEM_REASON BREEDER_DECISION".split()
    ],
    "trial_germplasm_bridge": ["TRIAL_ENTRY_GUID TRIAL_GUID TRIAL_ID MATERIAL_GUID MATERIAL_ID FIELD_ENTITY_ID PLOT_NO REPLICATION_NO ENTRY_ROLE_LID".split()],
    "trait_dictionary": ["TRAIT_GUID TRAIT_CODE TRAIT_NAME SOURCE_TABLE UNIT SCALE BETTER_DIRECTION".split()],
    "field_operations": ["ATTACHED_TO_FIELD_ENTITY_ID OPERATION_TYPE_LID PLANNED_DATE ACTUAL_DATE STATUS_LID DELAY_DAYS RECORDED_VIA".split()],
}
KEY_ALIASES = {
    "MATERIAL_GUID": ["MATERIAL_GUID", "GID"],
    "TRIAL_GUID": ["TRIAL_GUID", "ATTACHED_TO_FIELD_ENTITY_ID"],
    "LOCATION_GUID": ["LOCATION_GUID", "FIELD_ID"],
}


@dataclass(frozen=True)
class Detection:
    source: str
    score: float
    runner_up: str | None
    runner_up_score: float

    @property
    def confident(self) -> bool:
        return self.source != "UNKNOWN"


def detect(columns: list[str], signatures: dict[str, list[list[str]]] = SIGNATURES, min_score: float = MIN_SCORE) -> Detection:
    """The source whose signature the headers cover best; ties keep the order of the signatures."""
    have = {c.upper() for c in columns}
    score = {name: max(len(have & set(v)) / len(v) for v in variants) for name, variants in signatures.items()}
    ranked = sorted(score, key=lambda name: -score[name])
    best, second = ranked[0], ranked[1] if len(ranked) > 1 else None
    if score[best] < min_score:
        return Detection("UNKNOWN", score[best], best, score[best])
    return Detection(best, score[best], second, score[second] if second else 0.0)


def detect_frame(df: DataFrame) -> Detection:
    return detect(df.columns)


def canonical_key(column: str) -> str | None:
    return next((key for key, names in KEY_ALIASES.items() if column.upper() in names), None)


def rename_keys(df: DataFrame) -> DataFrame:
    """Aliases take the canonical name, unless the table already has it."""
    renames = {c: k for c in df.columns if (k := canonical_key(c)) and k != c and k not in df.columns}
    seen: set[str] = set()
    return df.withColumnsRenamed({c: k for c, k in renames.items() if not (k in seen or seen.add(k))})
