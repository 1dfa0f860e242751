"""Oracle SQL for the operator keys (everything except the line-list sections)."""

from __future__ import annotations

import datetime as dt

from carelens.sources.driver import REPORT_DAY, TODAY
from sqloracle import codes as S
from sqloracle.adapters import with_tables
from sqloracle.line_list import line_list_sql, ts

END = ts(dt.datetime.combine(REPORT_DAY, dt.time(23, 59, 59, 999999)))
RAW = "'%Y-%m-%d %H:%M:%S'"


def _w(*names: str) -> str:
    return with_tables(*names)


def _date_formats() -> dict[str, list[str]]:
    return {
        "%d/%m/%Y": ["DateConfirmedHIV+", "ARTStartDate", "Pharmacy_LastPickupdate", "Pharmacy_LastPickupdate_PreviousQuarter",
                     "DateofCurrentViralLoad", "DateResultReceivedFacility", "Outcomes_Date", "DOB", "Date_Transfered_In",
                     "DateofFirstTLD_Pickup", "IPT_Screening_Date", "Date_Enrolled_Into_OTZ", "OTZ_Outcome_Date", "PBS_Capture_Date"],
        "%d-%b-%Y": ["LastDateOfSampleCollection", "Next_Ap_by_careCard", "First_TPT_Pickupdate", "Last_TPT_Pickupdate",
                     "Date_of_TPT_Outcome", "DateofCurrent_TBStatus", "TB_Treatment_Start_Date", "TB_Treatment_Stop_Date",
                     "Date_Enrolled_Into_OTZ_Plus"],
        "%Y-%m-%d": ["IIT_Date", "CurrentCD4Date", "EstimatedNextAppointmentPharmacy", "PBS_Recapture_Date"],
    }


def date_format_edges() -> str:
    cols = ", ".join(f"strftime(\"{c}\", '{fmt}') AS \"{c}\"" for fmt, names in _date_formats().items() for c in names)
    return f"SELECT patient_id, PEPID, {cols} FROM ({line_list_sql(REPORT_DAY, TODAY)}) ll"


def parsed_report_dates() -> str:
    cols = ", ".join(f"CAST(try_strptime(\"{c}\", '{fmt}') AS DATE) AS \"{c}\"" for fmt, names in _date_formats().items() for c in names)
    return f"SELECT patient_id, PEPID, {cols} FROM ({date_format_edges()}) t"


def population_gate() -> str:
    latest = ", ".join(map(str, S.LATEST_SET))
    return f"""{_w('patient', 'person', 'encounter', 'obs')}
SELECT p.patient_id FROM patient p
WHERE p.voided = 0 AND EXISTS (SELECT 1 FROM person pe WHERE pe.person_id = p.patient_id)
  AND EXISTS (SELECT 1 FROM obs o WHERE o.person_id = p.patient_id AND o.voided = 0 AND o.concept_id IN ({latest})
              AND o.obs_datetime <= {END})
  AND EXISTS (SELECT 1 FROM encounter e WHERE e.patient_id = p.patient_id AND e.voided = 0 AND e.form_id = 23)"""


def _extreme(agg: str) -> str:
    return f"""{_w('encounter', 'obs')},
x AS (SELECT * FROM obs WHERE voided = 0 AND obs_datetime <= {END}),
m AS (SELECT person_id, concept_id, {agg}(obs_datetime) AS t FROM x GROUP BY person_id, concept_id)
SELECT x.person_id, x.concept_id, x.obs_id, x.obs_datetime, x.value_coded, x.value_numeric
FROM x JOIN m ON m.person_id = x.person_id AND m.concept_id = x.concept_id AND m.t = x.obs_datetime"""


def latest_obs_per_concept() -> str:
    return _extreme("max")


def first_obs_per_concept() -> str:
    return _extreme("min")


def latest_obs_id() -> str:
    return f"""{_w('encounter', 'obs')}
SELECT person_id, concept_id, max(obs_id) AS obs_id FROM obs o
WHERE voided = 0 AND obs_datetime <= {END}
  AND obs_datetime = (SELECT max(obs_datetime) FROM obs o2 WHERE o2.person_id = o.person_id
                      AND o2.concept_id = o.concept_id AND o2.voided = 0 AND o2.obs_datetime <= {END})
GROUP BY person_id, concept_id"""


def first_last_dates() -> str:
    return f"""{_w('encounter', 'obs')}
SELECT person_id, concept_id, min(obs_datetime) AS first_at, max(obs_datetime) AS last_at, count(*) AS n_obs
FROM obs WHERE voided = 0 AND obs_datetime <= {END} GROUP BY person_id, concept_id"""


def obs_value_lookup() -> str:
    return f"""{_w('encounter', 'obs')},
ids AS (SELECT person_id, concept_id, max(obs_id) AS obs_id FROM obs o
        WHERE voided = 0 AND obs_datetime <= {END}
          AND obs_datetime = (SELECT max(obs_datetime) FROM obs o2 WHERE o2.person_id = o.person_id
                              AND o2.concept_id = o.concept_id AND o2.voided = 0 AND o2.obs_datetime <= {END})
        GROUP BY person_id, concept_id)
SELECT ids.obs_id, ids.person_id, ids.concept_id, CAST(v.value_datetime AS DATE) AS value_date, CAST(v.obs_datetime AS DATE) AS obs_date
FROM ids LEFT JOIN obs v ON v.obs_id = ids.obs_id"""


def coded_value_names() -> str:
    return f"""{_w('encounter', 'obs', 'concept_name')}
SELECT o.value_coded, o.obs_id, o.concept_id,
       (SELECT min(name) FROM concept_name cn WHERE cn.concept_id = o.value_coded AND lower(rtrim(cn.locale)) = 'en'
        AND cn.locale_preferred = 1) AS name
FROM obs o WHERE o.voided = 0"""


def latest_value_spec() -> str:
    """Every looked-up value as its own windowed query, unioned; the latest and first sets keep ties."""
    end = f"obs_datetime <= TIMESTAMP '{S.CUTOFFS['end']}'"
    asked = [(f"L{c}", f"concept_id = {c} AND {end}", "obs_datetime DESC NULLS LAST") for c in S.LATEST_SET]
    asked += [(f"F{c}", f"concept_id = {c} AND {end}", "obs_datetime ASC NULLS LAST") for c in (S.REGIMEN_LINE, *S.REGIMEN_CONCEPTS)]
    asked += [(f"V{c}", f"concept_id = {c} AND {end}", "obs_datetime DESC NULLS LAST, obs_id DESC") for c in S.VITALS]
    asked += [(f"O{c}", f"concept_id = {c} AND {end}", "obs_datetime ASC NULLS LAST, obs_id ASC") for c in S.OTZ]
    for key, concepts, condition, cut_on, cut, order, way in S.LOOKUPS:
        where = f"concept_id IN ({', '.join(map(str, concepts))}) AND {condition}"
        if cut_on:
            where += f" AND {cut_on} <= TIMESTAMP '{S.CUTOFFS[cut]}'"
        asked.append((key, where, "obs_id ASC" if order == "obs_id" else f"{order} {way} NULLS LAST, obs_id {way}"))
    parts = [f"""SELECT person_id, '{key}' AS spec, obs_id, obs_datetime, value_coded, value_numeric,
  value_datetime, encounter_datetime, name FROM ox WHERE {where}
  QUALIFY rank() OVER (PARTITION BY person_id ORDER BY {order}) = 1""" for key, where, order in asked]
    union = "\nUNION ALL\n".join(f"({p})" for p in parts)
    return f"""{_w('encounter', 'obs', 'concept_name')},
en AS (SELECT concept_id, min(name) AS name FROM concept_name
       WHERE lower(rtrim(locale)) = 'en' AND locale_preferred = 1 AND name IS NOT NULL GROUP BY concept_id),
ox AS (SELECT o.*, e.encounter_type, e.form_id, e.encounter_datetime, en.name
       FROM obs o LEFT JOIN (SELECT * FROM encounter WHERE voided = 0) e ON e.encounter_id = o.encounter_id
       LEFT JOIN en ON en.concept_id = o.value_coded WHERE o.voided = 0)
{union}"""


def quarter_end() -> str:
    return f"""{_w('encounter')}
SELECT encounter_id, CAST(encounter_datetime AS DATE) AS encounter_date,
  CAST(last_day(date_trunc('quarter', CAST(encounter_datetime AS DATE)) + INTERVAL 2 MONTH) AS DATE) AS quarter_end,
  CAST(last_day(date_trunc('quarter', CAST(CAST(encounter_datetime AS DATE) - INTERVAL 3 MONTH AS DATE)) + INTERVAL 2 MONTH) AS DATE)
    AS prev_quarter_end
FROM encounter"""


def correct_encounters() -> str:
    return f"""{_w('encounter', 'visit', 'encounter_corrections')}
SELECT e.encounter_id, e.patient_id, e.visit_id, e.encounter_type, e.form_id, e.provider_id, e.location_id,
  coalesce((SELECT min(c.new_datetime) FROM encounter_corrections c WHERE c.visit_id = e.visit_id
            AND c.bad_datetime = e.encounter_datetime), e.encounter_datetime) AS encounter_datetime,
  e.date_created, e.voided, e.uuid, e.creator,
  EXISTS (SELECT 1 FROM encounter_corrections c WHERE c.visit_id = e.visit_id AND c.bad_datetime = e.encounter_datetime)
    AS corrected
FROM encounter e"""


def correct_visits() -> str:
    return f"""{_w('encounter', 'visit', 'visit_corrections')},
req AS (SELECT visit_id, arg_min(new_start, (new_start, new_stop)) AS new_start,
               arg_min(new_stop, (new_start, new_stop)) AS new_stop FROM visit_corrections GROUP BY visit_id)
SELECT v.visit_id, v.patient_id, v.visit_type_id,
  CASE WHEN r.visit_id IS NOT NULL THEN r.new_start ELSE v.date_started END AS date_started,
  CASE WHEN r.visit_id IS NOT NULL THEN r.new_stop ELSE v.date_stopped END AS date_stopped,
  v.location_id, v.voided, v.uuid, r.visit_id IS NOT NULL AS corrected
FROM visit v LEFT JOIN req r ON r.visit_id = v.visit_id"""


def correction_backup() -> str:
    return f"""{_w('encounter', 'visit', 'encounter_corrections')}
SELECT e.*, 'before' AS backup_run FROM encounter e
WHERE e.visit_id IN (SELECT visit_id FROM encounter_corrections)"""


def correction_verify() -> str:
    return f"""{_w('encounter', 'visit', 'encounter_corrections', 'visit_corrections')},
targets AS (SELECT visit_id FROM encounter_corrections UNION SELECT visit_id FROM visit_corrections),
per_visit AS (
  SELECT e.visit_id, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM encounter_corrections c
         WHERE c.visit_id = e.visit_id AND c.bad_datetime = e.encounter_datetime
         AND c.new_datetime IS DISTINCT FROM e.encounter_datetime) THEN 1 ELSE 0 END) AS changed
  FROM encounter e WHERE e.visit_id IN (SELECT visit_id FROM targets) GROUP BY e.visit_id),
vis AS (
  SELECT v.visit_id, EXISTS (SELECT 1 FROM visit_corrections c WHERE c.visit_id = v.visit_id
         AND (c.new_start IS DISTINCT FROM v.date_started OR c.new_stop IS DISTINCT FROM v.date_stopped)) AS changed
  FROM visit v WHERE v.visit_id IN (SELECT visit_id FROM targets))
SELECT t.visit_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_encounters,
  CAST(coalesce(p.changed, 0) AS BIGINT) AS n_encounters_changed, coalesce(vis.changed, false) AS visit_changed,
  CASE WHEN coalesce(p.changed, 0) > 0 OR coalesce(vis.changed, false) THEN 'applied' ELSE 'no_change' END AS status
FROM targets t LEFT JOIN per_visit p ON p.visit_id = t.visit_id LEFT JOIN vis ON vis.visit_id = t.visit_id"""


def correct_stored_files() -> str:
    return f"""{_w('encounter', 'visit', 'encounter_corrections')},
best AS (SELECT visit_id, bad_datetime, min(new_datetime) AS new_datetime FROM encounter_corrections GROUP BY ALL)
SELECT e.* REPLACE (CASE WHEN b.visit_id IS NOT NULL THEN b.new_datetime ELSE e.encounter_datetime END AS encounter_datetime)
FROM encounter e LEFT JOIN best b ON b.visit_id = e.visit_id AND b.bad_datetime = e.encounter_datetime"""


def outside_changes() -> str:
    return f"""{_w('encounter', 'visit', 'encounter_corrections', 'visit_corrections')},
targets AS (SELECT visit_id FROM encounter_corrections UNION SELECT visit_id FROM visit_corrections),
beyond AS (SELECT * FROM encounter WHERE visit_id IS NULL OR visit_id NOT IN (SELECT visit_id FROM targets))
SELECT 'encounter' AS table_name, encounter_id AS row_id, 'removed' AS status FROM beyond WHERE form_id = 30 AND voided = 1
UNION ALL SELECT 'encounter', encounter_id, 'changed' FROM beyond WHERE encounter_type = 25 AND form_id = 13
UNION ALL SELECT 'encounter', -encounter_id, 'added' FROM beyond WHERE form_id = 14 AND voided = 1"""


def purge_log_reload() -> str:
    at = "TIMESTAMP '2024-01-15 12:00:00'"
    return f"""{_w('biometricinfo')}
SELECT d.patient_id, {at} AS purged_at, count(b.patient_id) AS n_new, min(b.date_created) AS first_new_at,
  CASE WHEN count(b.patient_id) > 0 THEN 're_enrolled' ELSE 'missing' END AS status
FROM ({SAME_DAY}) d LEFT JOIN biometricinfo b ON b.patient_id = d.patient_id AND b.date_created > {at}
GROUP BY d.patient_id"""


def _dupes() -> str:
    return "SELECT patient_id FROM biometricinfo GROUP BY patient_id HAVING count(*) > 1"


SAME_DAY = ("SELECT DISTINCT patient_id FROM biometricinfo WHERE patient_id IN (SELECT patient_id FROM biometricinfo "
            "GROUP BY patient_id, CAST(date_created AS DATE) HAVING count(*) > 1)")


def _biometric_rows(where: str) -> str:
    return f"""{_w('biometricinfo', 'biometricverificationinfo')}
SELECT 'biometricinfo' AS source, patient_id, date_created, template, quality, CAST(NULL AS INTEGER) AS recapture_count
FROM biometricinfo WHERE patient_id {where}
UNION ALL
SELECT 'biometricverificationinfo', patient_id, date_created, template, NULL, recapture_count
FROM biometricverificationinfo WHERE patient_id {where}"""


def biometric_purge() -> str:
    return _biometric_rows(f"NOT IN ({SAME_DAY})")


def biometric_records() -> str:
    return _biometric_rows(f"IN ({_dupes()})")


def purge_verify() -> str:
    return f"""{_w('biometricinfo', 'biometricverificationinfo')}
SELECT d.patient_id, (SELECT count(*) FROM biometricinfo b WHERE b.patient_id = d.patient_id) AS n_enrolled,
  CAST(0 AS BIGINT) AS n_enrolled_left,
  (SELECT count(*) FROM biometricverificationinfo b WHERE b.patient_id = d.patient_id) AS n_verified,
  CAST(0 AS BIGINT) AS n_verified_left, 'purged' AS status
FROM ({SAME_DAY}) d"""


def reenrolment_check() -> str:
    return f"""{_w('biometricinfo')},
p AS (SELECT patient_id, min(date_created) AS purged_at FROM biometricinfo GROUP BY patient_id HAVING count(*) > 1)
SELECT p.patient_id, p.purged_at, count(b.patient_id) AS n_new, min(b.date_created) AS first_new_at,
  CASE WHEN count(b.patient_id) > 0 THEN 're_enrolled' ELSE 'missing' END AS status
FROM p LEFT JOIN biometricinfo b ON b.patient_id = p.patient_id AND b.date_created > p.purged_at
GROUP BY p.patient_id, p.purged_at"""


def duplicate_biometrics() -> str:
    return f"""{_w('biometricinfo')}
SELECT patient_id, count(*) AS n_records, min(date_created) AS first_at, max(date_created) AS last_at
FROM biometricinfo GROUP BY patient_id HAVING count(*) > 1"""


OUTSIDE = """SELECT e.visit_id, e.encounter_id, e.patient_id, e.encounter_datetime, v.date_started, v.date_stopped,
  CASE WHEN e.encounter_datetime < v.date_started THEN 'before_start' ELSE 'after_stop' END AS problem
FROM encounter e JOIN visit v ON v.visit_id = e.visit_id
WHERE e.voided = 0 AND v.voided = 0
  AND (e.encounter_datetime < v.date_started OR e.encounter_datetime > v.date_stopped)"""


def encounter_outside_visit() -> str:
    return f"{_w('encounter', 'visit')}\n{OUTSIDE}"


def implausible_datetime() -> str:
    lo = "TIMESTAMP '1990-01-01 00:00:00'"
    hi = f"TIMESTAMP '{TODAY + dt.timedelta(days=1):%Y-%m-%d} 00:00:00'"

    def chk(table, id_col, pid, col):
        return (f"SELECT '{table}' AS table_name, CAST({id_col} AS BIGINT) AS row_id, CAST({pid} AS BIGINT) AS patient_id, "
                f"'{col}' AS column_name, {col} AS value FROM {table} WHERE {col} < {lo} OR {col} >= {hi}")
    return f"""{_w('encounter', 'visit', 'obs')}
{chk('encounter', 'encounter_id', 'patient_id', 'encounter_datetime')}
UNION ALL {chk('visit', 'visit_id', 'patient_id', 'date_started')}
UNION ALL {chk('visit', 'visit_id', 'patient_id', 'date_stopped')}
UNION ALL {chk('obs', 'obs_id', 'person_id', 'obs_datetime')}"""


def invalid_visit_bounds() -> str:
    return f"""{_w('visit')}
SELECT visit_id, patient_id, date_started, date_stopped, voided,
  CASE WHEN date_started IS NULL THEN 'missing_start' WHEN date_stopped IS NULL THEN 'missing_stop'
       ELSE 'stop_before_start' END AS problem
FROM visit WHERE date_started IS NULL OR date_stopped IS NULL OR date_stopped < date_started"""


def patient_visits() -> str:
    return f"""{_w('encounter', 'visit')}
SELECT patient_id, visit_id, visit_type_id, date_started, strftime(date_started, {RAW}) AS raw_date_started,
  date_stopped, strftime(date_stopped, {RAW}) AS raw_date_stopped, location_id, voided,
  CAST(row_number() OVER (PARTITION BY patient_id ORDER BY date_started NULLS FIRST, visit_id) AS INTEGER) AS visit_seq
FROM visit WHERE patient_id IN (SELECT patient_id FROM ({OUTSIDE}))"""


def encounter_chronology() -> str:
    return f"""{_w('encounter', 'visit')}
SELECT visit_id, encounter_id, encounter_type, encounter_datetime,
  strftime(encounter_datetime, {RAW}) AS raw_encounter_datetime, form_id, provider_id, location_id, voided,
  CAST(row_number() OVER w AS INTEGER) AS encounter_seq,
  epoch_us(encounter_datetime) - epoch_us(lag(encounter_datetime) OVER w) AS gap_micros
FROM encounter WHERE visit_id IN (SELECT visit_id FROM ({OUTSIDE}))
WINDOW w AS (PARTITION BY visit_id ORDER BY encounter_datetime NULLS FIRST, encounter_id)"""


def visit_details() -> str:
    return f"""{_w('encounter', 'visit')}
SELECT visit_id, visit_type_id, date_started, strftime(date_started, {RAW}) AS raw_date_started,
  date_stopped, strftime(date_stopped, {RAW}) AS raw_date_stopped, voided
FROM visit WHERE visit_id IN (SELECT visit_id FROM ({OUTSIDE}))"""


def start_encounters() -> str:
    return f"""{_w('patient', 'encounter')}
SELECT patient_id, encounter_id, encounter_datetime, strftime(encounter_datetime, {RAW}) AS raw_datetime_string,
  date_created, visit_id, voided
FROM encounter WHERE encounter_type = 25
  AND patient_id IN (SELECT patient_id FROM patient WHERE voided = 0)"""
