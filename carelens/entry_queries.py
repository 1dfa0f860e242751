"""Registered queries over the driver tables and their oracle SQL (used by ``__spark_entry__``)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions.dates import end_of_day, parse_report_date, quarter_end
from carelens.operators import corrections as C
from carelens.operators import investigate as I
from carelens.operators import latest as LT
from carelens.operators import quality as Q
from carelens.operators.dictionary import coded_value_names
from carelens.plans import specs as S
from carelens.plans.as_of import advanced, report_state
from carelens.plans.line_list import DISPLAY_FORMATS, SECTIONS, LineListParams, line_list, population, render
from carelens.session import ensure_checkpoint_dir, stored
from carelens.sources.driver import REPORT_DAY, TODAY, build_tables
from carelens.sources.layout import cohort_rows, write_by_patient
from carelens.sources.versions import folder_version, read_version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def register(key: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def _tables(spark: SparkSession, sf_dir: str):
    """Clinical tables adapted from the driver tables, read anew by each query."""
    return build_tables(spark, sf_dir)


PARAMS = LineListParams(end=REPORT_DAY, today=TODAY)


def _ll_sql():
    from sqloracle.line_list import line_list_sql
    return line_list_sql(REPORT_DAY, TODAY)


@register("line_list", _ll_sql)
def q_line_list(spark, sf_dir):
    return line_list(spark, _tables(spark, sf_dir), PARAMS)


@register("line_list_advanced", _ll_sql)
def q_line_list_advanced(spark, sf_dir):
    """The line list from a state kept 45 days before, when a tenth of the observations were not loaded yet and some
    patients had other voided flags."""
    t = _tables(spark, sf_dir)
    loaded, changed = F.col("obs_id") % 10 == 3, F.col("person_id") % 17 == 0
    earlier = t.obs.filter(~loaded).withColumn("voided", F.when(changed, 1 - F.col("voided")).otherwise(F.col("voided")))
    before = replace(PARAMS, end=REPORT_DAY - dt.timedelta(days=45))
    kept = stored(report_state(spark, t.with_tables(obs=earlier), before), f"{_shared_root(spark)}/state")
    state = advanced(spark, kept, t, before, PARAMS, t.obs.filter(loaded).select("obs_id"),
                     t.obs.filter(changed).select("person_id"))
    return line_list(spark, t, PARAMS, state=state)


def _section(key: str, cols: list[str]):
    def q(spark, sf_dir):
        return line_list(spark, _tables(spark, sf_dir), PARAMS, section=key)

    def sql():
        from sqloracle.line_list import line_list_sql
        quoted = ", ".join(f'"{c}"' for c in cols)
        return f"SELECT {quoted} FROM ({line_list_sql(REPORT_DAY, TODAY)}) ll"

    register(key, sql)(q)


for _k, _cols in SECTIONS.items():
    _section(_k, _cols)


DATE_COLUMNS = ["patient_id", "PEPID", *DISPLAY_FORMATS]


def _sql(name: str):
    def f():
        from sqloracle import queries as SQ
        return getattr(SQ, name)()
    return f


@register("date_format_edges", _sql("date_format_edges"))
def q_date_format_edges(spark, sf_dir):
    df = line_list(spark, _tables(spark, sf_dir), PARAMS).select(*[F.col(f"`{c}`") for c in DATE_COLUMNS])
    return render(df)


@register("parsed_report_dates", _sql("parsed_report_dates"))
def q_parsed_report_dates(spark, sf_dir):
    """The rendered date columns read back from their text."""
    text = q_date_format_edges(spark, sf_dir)
    return text.select("patient_id", "PEPID", *[parse_report_date(F.col(f"`{c}`"), fmt).alias(c) for c, fmt in DISPLAY_FORMATS.items()])


@register("population_gate", _sql("population_gate"))
def q_population_gate(spark, sf_dir):
    return population(_tables(spark, sf_dir), PARAMS)


END_AT = end_of_day(REPORT_DAY)


@register("latest_obs_per_concept", _sql("latest_obs_per_concept"))
def q_latest_obs_per_concept(spark, sf_dir):
    return LT.rows_at_extreme(_tables(spark, sf_dir).obs, END_AT).select(
        "person_id", "concept_id", "obs_id", "obs_datetime", "value_coded", "value_numeric")


@register("first_obs_per_concept", _sql("first_obs_per_concept"))
def q_first_obs_per_concept(spark, sf_dir):
    return LT.rows_at_extreme(_tables(spark, sf_dir).obs, END_AT, first=True).select(
        "person_id", "concept_id", "obs_id", "obs_datetime", "value_coded", "value_numeric")


@register("latest_obs_id", _sql("latest_obs_id"))
def q_latest_obs_id(spark, sf_dir):
    return LT.latest_obs_id(_tables(spark, sf_dir).obs, END_AT)


@register("first_last_dates", _sql("first_last_dates"))
def q_first_last_dates(spark, sf_dir):
    return LT.first_last_dates(_tables(spark, sf_dir).obs, END_AT)


@register("obs_value_lookup", _sql("obs_value_lookup"))
def q_obs_value_lookup(spark, sf_dir):
    obs = _tables(spark, sf_dir).obs
    return LT.value_by_obs_id(LT.latest_obs_id(obs, END_AT), obs)


@register("coded_value_names", _sql("coded_value_names"))
def q_coded_value_names(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return coded_value_names(t.obs.filter(F.col("voided") == 0).select("obs_id", "concept_id", "value_coded"),
                             t.concept_name)


@register("latest_value_spec", _sql("latest_value_spec"))
def q_latest_value_spec(spark, sf_dir):
    t = _tables(spark, sf_dir)
    from carelens.operators.picks import pick
    plan = S.line_list_plan()
    tall = pick(spark, t.obs, t.encounter, t.concept_name, plan, PARAMS.cutoffs(), extra_forms=[S.FORM_CARE_CARD])
    keys = F.create_map(*[x for i, s in enumerate(plan.specs) for x in (F.lit(i), F.lit(s.key))])
    return tall.select("person_id", keys[F.col("spec_idx")].alias("spec"), "obs_id", "obs_datetime", "value_coded",
                       "value_numeric", "value_datetime", "encounter_datetime", "name")


@register("quarter_end", _sql("quarter_end"))
def q_quarter_end(spark, sf_dir):
    e = _tables(spark, sf_dir).encounter
    d = F.col("encounter_datetime").cast("date")
    return e.select("encounter_id", d.alias("encounter_date"), quarter_end(d).alias("quarter_end"),
                    quarter_end(F.add_months(d, -3)).alias("prev_quarter_end"))


def _corrections(spark, sf_dir, t=None):
    """Correction requests derived from the data: one per encounter found outside its visit, each
    such visit, each visit without a stop, and each whose bounds already are those of one day
    (a request that changes nothing)."""
    t = t or _tables(spark, sf_dir)
    enc, vis = C.requests_from_findings(Q.encounters_outside_visit(t.encounter, t.visit))
    day = F.col("date_started").cast("date").cast("timestamp_ntz")
    stop = F.timestamp_add("SECOND", F.lit(86399), day)
    more = t.visit.filter(F.col("date_started").isNotNull() & (
        F.col("date_stopped").isNull() | ((F.col("date_started") == day) & (F.col("date_stopped") == stop))))
    return enc, vis.unionByName(more.select("visit_id", day.alias("new_start"), stop.alias("new_stop"))).distinct()


@register("correct_encounters", _sql("correct_encounters"))
def q_correct_encounters(spark, sf_dir):
    return C.correct_encounters(_tables(spark, sf_dir).encounter, _corrections(spark, sf_dir)[0])


@register("correct_visits", _sql("correct_visits"))
def q_correct_visits(spark, sf_dir):
    return C.correct_visits(_tables(spark, sf_dir).visit, _corrections(spark, sf_dir)[1])


@register("correction_backup", _sql("correction_backup"))
def q_correction_backup(spark, sf_dir):
    return C.backup(_tables(spark, sf_dir).encounter, _corrections(spark, sf_dir)[0], "visit_id", "before")


def _shared_root(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/carelens-{uuid.uuid4().hex}"


def _visits_stored(spark, t, root: str):
    """``t`` with the visits written once: they are grouped from all observations, and the workflows read them many times."""
    t.visit.write.parquet(f"{root}/tables/visit")
    return t.with_tables(visit=spark.read.schema(t.visit.schema).parquet(f"{root}/tables/visit"))


@register("correction_verify", _sql("correction_verify"))
def q_correction_verify(spark, sf_dir):
    """Applies the requests as written tables in the shared folder and compares what is stored."""
    root = _shared_root(spark)
    t = _visits_stored(spark, _tables(spark, sf_dir), root)
    return spark.read.parquet(C.apply_corrections(t.encounter, t.visit, *_corrections(spark, sf_dir, t), root, "check")["report"])


@register("correct_stored_files", _sql("correct_stored_files"))
def q_correct_stored_files(spark, sf_dir):
    """Encounters after a correction that rewrites only the stored files with a requested visit."""
    t = _tables(spark, sf_dir)
    root = _shared_root(spark)
    tables = {}
    for name, df in (("encounter", t.encounter), ("visit", t.visit)):
        df.repartitionByRange(32, "visit_id").write.parquet(f"{root}/{name}")
        tables[name] = folder_version(spark, f"{root}/{name}"), df.schema
    after = C.correct_stored(spark, tables, *_corrections(spark, sf_dir), root, "check")
    return read_version(spark, after["encounter"], t.encounter.schema)


@register("outside_changes", _sql("outside_changes"))
def q_outside_changes(spark, sf_dir):
    """A faulty snapshot: beyond the requested visits some rows are lost, some changed, some new."""
    root = _shared_root(spark)
    t = _visits_stored(spark, _tables(spark, sf_dir), root)
    requests = {}
    for name, df in zip(("encounter", "visit"), _corrections(spark, sf_dir, t)):
        df.write.parquet(f"{root}/requests/{name}")
        requests[name] = spark.read.schema(df.schema).parquet(f"{root}/requests/{name}")
    targets = C.requested_visits(requests["encounter"], requests["visit"])
    after = C.correct_encounters(t.encounter, requests["encounter"], None).filter("NOT (form_id = 30 AND voided = 1)")
    after = after.withColumn("provider_id", F.expr("IF(encounter_type = 25 AND form_id = 13, NULL, provider_id)"))
    after = after.unionByName(t.encounter.filter("form_id = 14 AND voided = 1").withColumn("encounter_id", -F.col("encounter_id")))
    return C.outside_report({"encounter": (t.encounter, after, "encounter_id"), "visit": (t.visit, t.visit, "visit_id")}, targets, "visit_id")


def _same_day_duplicates(t):
    return Q.duplicate_biometrics(t.biometricinfo, same_day=True)


@register("biometric_purge", _sql("biometric_purge"))
def q_biometric_purge(spark, sf_dir):
    t = _tables(spark, sf_dir)
    cap, ver = C.purge_biometrics(t.biometricinfo, t.biometricverificationinfo, _same_day_duplicates(t))
    return I.biometric_records(cap, ver)


@register("purge_verify", _sql("purge_verify"))
def q_purge_verify(spark, sf_dir):
    """Purges into written tables in the shared folder and counts what is stored before and after."""
    t = _tables(spark, sf_dir)
    return spark.read.parquet(C.apply_purge(t.biometricinfo, t.biometricverificationinfo, _same_day_duplicates(t),
                                            _shared_root(spark), "check")["report"])


PURGED_AT = dt.datetime(2024, 1, 15, 12)


@register("purge_log_reload", _sql("purge_log_reload"))
def q_purge_log_reload(spark, sf_dir):
    """After a logged purge the old table is loaded again: who has been captured since the purge."""
    t = _tables(spark, sf_dir)
    root = _shared_root(spark)
    C.apply_purge(t.biometricinfo, t.biometricverificationinfo, _same_day_duplicates(t), root, "check", PURGED_AT)
    log = C.purge_log(spark, root)
    return C.reenrolment_check(log, C.without_purged(t.biometricinfo, log))


@register("reenrolment_check", _sql("reenrolment_check"))
def q_reenrolment_check(spark, sf_dir):
    """Patients with duplicates count as purged right after their first capture; later rows are new ones."""
    t = _tables(spark, sf_dir)
    purged = Q.duplicate_biometrics(t.biometricinfo).select("patient_id", F.col("first_at").alias("purged_at"))
    return C.reenrolment_check(purged, t.biometricinfo)


@register("encounter_outside_visit", _sql("encounter_outside_visit"))
def q_encounter_outside_visit(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return Q.encounters_outside_visit(t.encounter, t.visit)


IMPLAUSIBLE_BEFORE = dt.date(1990, 1, 1)


@register("implausible_datetime", _sql("implausible_datetime"))
def q_implausible_datetime(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return Q.implausible_datetimes(t.encounter, t.visit, t.obs, IMPLAUSIBLE_BEFORE, TODAY)


@register("duplicate_biometrics", _sql("duplicate_biometrics"))
def q_duplicate_biometrics(spark, sf_dir):
    return Q.duplicate_biometrics(_tables(spark, sf_dir).biometricinfo)


@register("invalid_visit_bounds", _sql("invalid_visit_bounds"))
def q_invalid_visit_bounds(spark, sf_dir):
    return Q.invalid_visit_bounds(_tables(spark, sf_dir).visit)


def _outside(t):
    return Q.encounters_outside_visit(t.encounter, t.visit)


@register("patient_visits", _sql("patient_visits"))
def q_patient_visits(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return I.patient_visits(t.visit, _outside(t).select("patient_id"))


@register("bucketed_patient_visits", _sql("patient_visits"))
def q_bucketed_patient_visits(spark, sf_dir):
    """Visit histories of the cohort from a table stored by patient bucket."""
    t = _tables(spark, sf_dir)
    cohort = _outside(t).select("patient_id").distinct()
    path = f"{_shared_root(spark)}/visit"
    write_by_patient(t.visit, path)
    return I.patient_visits(cohort_rows(spark.read.parquet(path), cohort), cohort)


@register("encounter_chronology", _sql("encounter_chronology"))
def q_encounter_chronology(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return I.encounter_chronology(t.encounter, _outside(t).select("visit_id"))


@register("visit_details", _sql("visit_details"))
def q_visit_details(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return I.visit_details(t.visit, _outside(t).select("visit_id"))


@register("start_encounters", _sql("start_encounters"))
def q_start_encounters(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return I.start_encounters(t.encounter, t.patient.filter(F.col("voided") == 0).select("patient_id"))


@register("biometric_records", _sql("biometric_records"))
def q_biometric_records(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return I.biometric_records(t.biometricinfo, t.biometricverificationinfo,
                               Q.duplicate_biometrics(t.biometricinfo).select("patient_id"))
