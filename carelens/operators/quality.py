"""Detection of the defects the correction scripts repair, over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.dates import as_column


def encounters_outside_visit(encounter: DataFrame, visit: DataFrame) -> DataFrame:
    """Non-voided encounters whose time falls before their visit's start or after its stop."""
    e = encounter.filter((F.col("voided") == 0) & F.col("visit_id").isNotNull()).select(
        "encounter_id", "patient_id", "visit_id", "encounter_datetime")
    v = visit.filter(F.col("voided") == 0).select("visit_id", "date_started", "date_stopped")
    j = e.join(v, "visit_id")
    side = (F.when(F.col("encounter_datetime") < F.col("date_started"), "before_start")
            .when(F.col("encounter_datetime") > F.col("date_stopped"), "after_stop"))
    return j.withColumn("problem", side).filter(F.col("problem").isNotNull())


def implausible_datetimes(encounter: DataFrame, visit: DataFrame, obs: DataFrame,
                          earliest: dt.date, latest: dt.date) -> DataFrame:
    """Datetimes outside [earliest, latest] (e.g. a year typed as 1019) in the three tables."""
    lo, hi = as_column(earliest).cast("timestamp_ntz"), F.to_timestamp_ntz(F.date_add(as_column(latest), 1).cast("string"))

    def check(df, table, id_col, person_col, cols):
        values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cols])
        x = df.select(F.lit(table).alias("table_name"), F.col(id_col).cast("long").alias("row_id"),
                      F.col(person_col).cast("long").alias("patient_id"), F.explode(values).alias("v"))
        return x.select("table_name", "row_id", "patient_id", "v.column_name", "v.value").filter(
            (F.col("value") < lo) | (F.col("value") >= hi))

    return (
        check(encounter, "encounter", "encounter_id", "patient_id", ["encounter_datetime"])
        .unionByName(check(visit, "visit", "visit_id", "patient_id", ["date_started", "date_stopped"]))
        .unionByName(check(obs, "obs", "obs_id", "person_id", ["obs_datetime"]))
    )


def duplicate_biometrics(biometricinfo: DataFrame, same_day: bool = False) -> DataFrame:
    """Patients with more than one enrollment row (``same_day``: more than one on one calendar day)."""
    if same_day:
        per_day = (biometricinfo.groupBy("patient_id", F.col("date_created").cast("date").alias("day"))
                   .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
        biometricinfo = biometricinfo.join(per_day.select("patient_id").distinct(), "patient_id", "left_semi")
    return (
        biometricinfo.groupBy("patient_id")
        .agg(F.count(F.lit(1)).alias("n_records"), F.min("date_created").alias("first_at"),
             F.max("date_created").alias("last_at"))
        .filter(F.col("n_records") > 1)
    )


def invalid_visit_bounds(visit: DataFrame) -> DataFrame:
    """Visits with a missing start, a missing stop, or a stop before the start."""
    problem = (F.when(F.col("date_started").isNull(), "missing_start")
               .when(F.col("date_stopped").isNull(), "missing_stop")
               .when(F.col("date_stopped") < F.col("date_started"), "stop_before_start"))
    return visit.select("visit_id", "patient_id", "date_started", "date_stopped", "voided",
                        problem.alias("problem")).filter(F.col("problem").isNotNull())
