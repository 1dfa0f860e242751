"""Record investigation for whole cohorts.

The source scripts look at one hard-coded patient or visit at a time and chain ids by
hand (visit history -> encounters in a visit -> visit bounds). Here each step takes a
cohort DataFrame of ids, so the chain is a sequence of semi joins over the whole table.
Without a cohort every row is returned, also those whose patient or visit is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.dates import FORMAT_RAW
from carelens.operators.ordered import ordered_within


def _in_cohort(df: DataFrame, cohort: DataFrame | None, key: str) -> DataFrame:
    if cohort is None:
        return df
    return df.join(cohort.select(key).distinct(), key, "left_semi")


def raw_text(c: str) -> F.Column:
    """The stored datetime as text, beside the typed value (spots odd years and times)."""
    return F.date_format(F.col(c), FORMAT_RAW)


def patient_visits(visit: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Visit history of each cohort patient, numbered in start order (visits of no patient form one group)."""
    v = ordered_within(_in_cohort(visit, cohort, "patient_id"), "patient_id", ["date_started", "visit_id"], "visit_seq")
    return v.select(
        "patient_id", "visit_id", "visit_type_id", "date_started", raw_text("date_started").alias("raw_date_started"),
        "date_stopped", raw_text("date_stopped").alias("raw_date_stopped"), "location_id", "voided",
        F.col("visit_seq").cast("int").alias("visit_seq"),
    )


def encounter_chronology(encounter: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """Encounters of each visit in time order, with the gap to the previous encounter
    (the stated use of the source script: check chronology against the visit).
    Encounters without a visit form one group when no visits are given."""
    e = ordered_within(_in_cohort(encounter, visits, "visit_id"), "visit_id", ["encounter_datetime", "encounter_id"],
                       "encounter_seq", {"encounter_datetime": "_prev_at"})
    return e.select(
        "visit_id", "encounter_id", "encounter_type", "encounter_datetime",
        raw_text("encounter_datetime").alias("raw_encounter_datetime"), "form_id", "provider_id", "location_id",
        "voided", F.col("encounter_seq").cast("int").alias("encounter_seq"),
        F.timestamp_diff("MICROSECOND", F.col("_prev_at"), F.col("encounter_datetime")).alias("gap_micros"),
    )


def visit_details(visit: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """Bounds of the requested visits, typed and as stored text."""
    v = _in_cohort(visit, visits, "visit_id")
    return v.select(
        "visit_id", "visit_type_id", "date_started", raw_text("date_started").alias("raw_date_started"),
        "date_stopped", raw_text("date_stopped").alias("raw_date_stopped"), "voided",
    )


def start_encounters(encounter: DataFrame, cohort: DataFrame | None = None, encounter_type: int = 25) -> DataFrame:
    """ART commencement encounters of the cohort, voided ones included."""
    e = _in_cohort(encounter.filter(F.col("encounter_type") == encounter_type), cohort, "patient_id")
    return e.select("patient_id", "encounter_id", "encounter_datetime",
                    raw_text("encounter_datetime").alias("raw_datetime_string"), "date_created", "visit_id", "voided")


def biometric_records(biometricinfo: DataFrame, biometricverificationinfo: DataFrame,
                      cohort: DataFrame | None = None) -> DataFrame:
    """Whole enrollment and verification rows of the cohort, tagged with their table; columns
    that only one of the tables has are NULL in rows of the other."""
    cap = _in_cohort(biometricinfo, cohort, "patient_id").withColumn("source", F.lit("biometricinfo"))
    ver = _in_cohort(biometricverificationinfo, cohort, "patient_id").withColumn("source", F.lit("biometricverificationinfo"))
    return cap.unionByName(ver, allowMissingColumns=True)
