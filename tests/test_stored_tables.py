"""Versions rewritten by file, tables read by cohort, and texts that the server holds equal."""

import os

from pyspark.sql import functions as F

from carelens.operators import corrections as C
from carelens.operators import patients as P
from carelens.operators.dictionary import english_names
from carelens.sources.layout import BUCKET, bucket_of, cohort_rows, write_by_patient
from carelens.sources.versions import files_with_hits, folder_version, read_version, rewrite_hits
from tests.clinical import T


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_only_files_with_a_hit_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "a b%20c+d")  # names that are encoded in a path
    df = spark.range(0, 1000).select("id", (F.col("id") % 7).alias("_metadata"), F.concat(F.lit("v"), "id").alias("x"))
    df.repartitionByRange(10, "id").write.parquet(root)
    version = folder_version(spark, root)
    keys = spark.createDataFrame([(5,), (6,), (903,), (5000,)], "id long")
    assert version.count() == 10 and files_with_hits(spark, version, df.schema, keys, "id").count() == 2

    def change(rows):
        return rows.withColumn("x", F.expr("IF(id IN (5, 6, 903), 'new', x)"))

    after = rewrite_hits(spark, version, df.schema, keys, "id", change, str(tmp_path / "next"))
    assert after.filter("NOT rewritten").count() == 8 and rows_of(read_version(spark, after, df.schema)) == rows_of(change(df))
    written = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "next") for f in fs if f.endswith(".parquet"))
    whole = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))
    assert written < 0.4 * whole  # bytes in proportion to the files hit
    # A version can be changed again, and a change without a hit writes nothing.
    third = rewrite_hits(spark, after, df.schema, keys.filter("id = 903"), "id", lambda r: r.filter("id <> 903"), str(tmp_path / "third"))
    assert read_version(spark, third, df.schema).count() == 999
    same = rewrite_hits(spark, third, df.schema, keys.filter("id = 5000"), "id", lambda r: r, str(tmp_path / "none"))
    assert rows_of(same.select("path")) == rows_of(third.select("path")) and not (tmp_path / "none").exists()
    assert rewrite_hits(spark, folder_version(spark, root).filter("false"), df.schema, keys, "id", change, str(tmp_path / "e")).count() == 0


def test_correction_by_file_equals_the_full_one(spark, tmp_path):
    from tests.test_corrections_quality import requests, tables
    t = tables(spark)
    enc, vis = requests(spark)
    stored = {}
    for name, df in (("encounter", t.encounter), ("visit", t.visit)):
        df.repartitionByRange(3, "visit_id").write.parquet(str(tmp_path / name))
        stored[name] = folder_version(spark, str(tmp_path / name)), df.schema
    after = C.correct_stored(spark, stored, enc, vis, str(tmp_path / "out"), "r1")
    assert rows_of(read_version(spark, after["encounter"], t.encounter.schema)) == rows_of(C.correct_encounters(t.encounter, enc, None))
    assert rows_of(read_version(spark, after["visit"], t.visit.schema)) == rows_of(C.correct_visits(t.visit, vis, None))
    again = C.correct_stored(spark, stored, enc, vis, str(tmp_path / "out"), "r1")
    assert rows_of(again["encounter"]) == rows_of(after["encounter"])


def test_a_cohort_reads_its_buckets_only(spark, tmp_path):
    visits = spark.range(0, 4000).select("id", (F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500)).alias("patient_id"),
                                         F.lit(T(2020, 1, 1)).alias("at")).unionByName(
        spark.createDataFrame([(9999, None, T(2020, 1, 1))], "id long, patient_id long, at timestamp_ntz"))
    path = str(tmp_path / "visits")
    write_by_patient(visits, path, buckets=16, rows_per_file=500)
    stored = spark.read.parquet(path)
    assert stored.drop(BUCKET).count() == 4001 and stored.select(BUCKET).distinct().count() <= 16
    cohort = spark.createDataFrame([(7,), (11,), (None,)], "patient_id long")
    out = cohort_rows(stored, cohort, buckets=16)
    assert rows_of(out) == rows_of(visits.filter("patient_id IN (7, 11)"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and BUCKET in plan.split("PartitionFilters: [")[1].split("\n")[0]
    # Rows of a patient lie in the one folder that the pruned read names.
    for r in stored.withColumn("file", F.input_file_name()).select("patient_id", "file", bucket_of("patient_id", 16).alias("b")).distinct().collect():
        assert f"{BUCKET}={r['b']}/" in r["file"]


def test_texts_that_the_server_holds_equal(spark):
    ids = spark.createDataFrame([(1, "PEP1", 4, "u2"), (1, "pep1 ", 4, "u1"), (1, "Pep1", 4, "u3"), (1, "PEP2", 4, "u4"), (1, None, 4, "u5"), (2, "pep1", 4, "u6"),
                                 (1, " PEP1", 4, "u7")], "patient_id long, identifier string, identifier_type int, uuid string")
    got = {(r["patient_id"], r["identifier"], r["uuid"]) for r in P.identifier_rows(ids, 4).collect()}
    assert got == {(1, "PEP1", "u1"), (1, "PEP2", "u4"), (1, None, "u5"), (2, "pep1", "u6"), (1, " PEP1", "u7")}
    names = spark.createDataFrame([(1, "a", "EN", 1), (2, "b", "en ", 1), (3, "c", "fr", 1), (4, "d", None, 1)],
                                  "concept_id long, name string, locale string, locale_preferred int")
    assert {r["concept_id"] for r in english_names(names).collect()} == {1, 2}
    gp = spark.createDataFrame([("PARTNER_reporting_lga_code ", "L1"), ("facility_datim_code", "D"), ("Facility_Name  ", "F")], "property string, property_value string")
    loc = spark.createDataFrame([(8, "S")], "location_id int, state_province string")
    entry = spark.createDataFrame([("l1 ", "Ikeja"), ("L2", "Other")], "user_generated_id string, name string")
    assert tuple(P.site_config(gp, loc, entry).first()) == ("S", "Ikeja", "D", "F")
