"""Properties of the line list on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from carelens.plans.line_list import TB_COLUMNS, LineListParams, line_list, population
from carelens.sources.driver import REPORT_DAY, TODAY, build_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
PARAMS = LineListParams(end=REPORT_DAY, today=TODAY)

PATIENT_KEYS = {"patient": "patient_id", "person": "person_id", "person_name": "person_id",
                "person_address": "person_id", "person_attribute": "person_id",
                "patient_identifier": "patient_id", "encounter": "patient_id", "visit": "patient_id",
                "obs": "person_id", "patient_program": "patient_id", "biometricinfo": "patient_id",
                "biometricverificationinfo": "patient_id"}


def restrict(t, ids):
    return t.with_tables(**{n: getattr(t, n).join(ids.withColumnRenamed("id", k), k, "left_semi")
                            for n, k in PATIENT_KEYS.items()})


def as_set(df):
    return {tuple(str(v) for v in r) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    return build_tables(spark, SF)


def test_cohort_independence(spark, tables):
    ids = tables.patient.select(F.col("patient_id").alias("id"))
    a, b = ids.filter("id % 2 = 0"), ids.filter("id % 2 = 1")
    full = as_set(line_list(spark, tables, PARAMS))
    parts = as_set(line_list(spark, restrict(tables, a), PARAMS)) | as_set(line_list(spark, restrict(tables, b), PARAMS))
    assert full == parts and len(full) > 0


def test_rows_after_the_report_day_change_no_as_of_column(spark, tables):
    end_next = F.lit(REPORT_DAY).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    enc = tables.encounter.select("encounter_id", F.col("encounter_datetime").alias("_edt"))
    later = (tables.obs.join(enc, "encounter_id", "left")
             .filter((F.col("obs_datetime") >= end_next) & (F.coalesce(F.col("value_datetime"), end_next) >= end_next)
                     & (F.coalesce(F.col("_edt"), end_next) >= end_next))
             .select("obs_id"))
    trimmed = tables.with_tables(obs=tables.obs.join(later, "obs_id", "left_anti"))
    # columns whose lookups have no cutoff in the report may change
    no_cutoff = {"CareEntryPoint", "Outcomes_Date", "VA_Cause_of_Death", "Date_Transfered_In", "CurrentCD4",
                 "CurrentCD4Date", *TB_COLUMNS}
    cols = [c for c in line_list(spark, tables, PARAMS).columns if c not in no_cutoff or c == "IPT_Screening_Date"]
    sel = [F.col(f"`{c}`") for c in cols]
    assert as_set(line_list(spark, tables, PARAMS).select(*sel)) == as_set(line_list(spark, trimmed, PARAMS).select(*sel))


def test_no_fan_out(spark, tables):
    ll = line_list(spark, tables, PARAMS)
    ids = (tables.patient_identifier.filter("identifier_type = 4").select("patient_id", "identifier").distinct()
           .groupBy("patient_id").count())
    expected = (population(tables, PARAMS).join(ids, "patient_id", "left")
                .select(F.coalesce("count", F.lit(1)).alias("n")).agg(F.sum("n")).first()[0])
    assert ll.count() == expected
    assert ll.select("patient_id", "PEPID").distinct().count() == expected
