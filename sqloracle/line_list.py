"""The line list in plain SQL: one correlated subquery per looked-up value, as the report does."""

from __future__ import annotations

import datetime as dt

from sqloracle import codes as S
from sqloracle.adapters import ALL, with_tables


def ts(v: dt.datetime | dt.date) -> str:
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'"
    return f"DATE '{v:%Y-%m-%d}'"


def whole_units(a: str, b: str, unit: str) -> str:
    """Completed years or months from a to b (truncated toward zero), by calendar fields."""
    a, b = f"CAST({a} AS TIMESTAMP)", f"CAST({b} AS TIMESTAMP)"
    if unit == "year":
        def diff(x, y):
            return (f"((year({y}) - year({x})) - CASE WHEN strftime({y}, '%m%d%H%M%S%f') < "
                    f"strftime({x}, '%m%d%H%M%S%f') THEN 1 ELSE 0 END)")
    else:
        def diff(x, y):
            return (f"((year({y}) * 12 + month({y}) - year({x}) * 12 - month({x})) - CASE WHEN "
                    f"strftime({y}, '%d%H%M%S%f') < strftime({x}, '%d%H%M%S%f') THEN 1 ELSE 0 END)")
    return f"CAST(CASE WHEN {b} >= {a} THEN {diff(a, b)} ELSE -{diff(b, a)} END AS INTEGER)"


def non_empty(x: str) -> str:
    return f"coalesce(rtrim({x}) <> '', false)"


def text_is(x: str, lit: str) -> str:
    return f"coalesce(lower(rtrim({x})) = '{lit.rstrip().lower()}', false)"


def number_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def add_days(d: str, n: str) -> str:
    return f"(CAST({d} AS DATE) + CAST(round({n}) AS INTEGER))"


def lookup(value: str, concepts, enc_type=None, form=None, cutoff_col=None, cutoff=None, order="obs_datetime",
           desc=True, coded=None, named=False, any_row=False) -> str:
    """The report's correlated subquery: best row of ``ox`` for the current patient ``g``."""
    cond = [f"o.person_id = g.patient_id", f"o.concept_id IN ({', '.join(map(str, concepts))})"]
    if enc_type is not None:
        cond.append(f"o.encounter_type = {enc_type}")
    if form is not None:
        cond.append(f"o.form_id = {form}")
    if cutoff_col:
        cond.append(f"o.{cutoff_col} <= {ts(cutoff)}")
    if coded:
        cond.append(f"o.value_coded IN ({', '.join(map(str, coded))})")
    if named:
        cond.append("o.name IS NOT NULL")
    if any_row:
        order_by = "o.obs_id ASC"
    elif desc:
        order_by = f"o.{order} DESC NULLS LAST, o.obs_id DESC"
    else:
        order_by = f"o.{order} ASC NULLS LAST, o.obs_id ASC"
    return f"(SELECT {value} FROM ox o WHERE {' AND '.join(cond)} ORDER BY {order_by} LIMIT 1)"


def line_list_sql(end: dt.date, today: dt.date, partner: str | None = None, version_tag: str = "_v1.2") -> str:
    end_ts = dt.datetime.combine(end, dt.time(23, 59, 59, 999999))
    if f"{end}" != S.CUTOFFS["end"][:10]:
        raise ValueError("the oracle's cutoffs are written out for one report day")
    pq_day_ts = dt.datetime.fromisoformat(S.CUTOFFS["prev_quarter_day"])
    pq_end_ts = dt.datetime.fromisoformat(S.CUTOFFS["prev_quarter_end"])
    pq_end = pq_end_ts.date()
    E = ts(end_ts)
    latest = ", ".join(map(str, S.LATEST_SET))
    first = ", ".join(map(str, (S.REGIMEN_LINE, *S.REGIMEN_CONCEPTS)))
    L = lookup  # noqa: N806

    def lmax(concept, col, extra=""):
        return f"max(CASE WHEN concept_id = {concept}{extra} THEN {col} END)"

    per_person = {
        "kp_type": L("o.name", [166369], 14, cutoff_col="obs_datetime", cutoff=end_ts, coded=S.KP_TYPES, named=True),
        "art_start_at": L("o.value_datetime", [159599], 25, cutoff_col="value_datetime", cutoff=end_ts, any_row=True),
        "hiv_confirmed_at": L("o.value_datetime", [160554], 14, cutoff_col="value_datetime", cutoff=end_ts, any_row=True),
        "current_regimen": L("o.name", S.REGIMEN_CONCEPTS, 13, cutoff_col="obs_datetime", cutoff=end_ts, named=True),
        "dsd_model": L("o.name", [166148], 13, cutoff_col="obs_datetime", cutoff=end_ts, coded=S.DSD_MODELS, named=True),
        "dsd_model_type": L("o.name", S.DSD_MODELS, 13, cutoff_col="obs_datetime", cutoff=end_ts, named=True),
        "viral_load": L("o.value_numeric", [856], 11, cutoff_col="encounter_datetime", cutoff=end_ts),
        # aggregates over all qualifying rows, as the report writes them
        "viral_load_date": f"""(SELECT max(o.encounter_datetime) FROM ox o WHERE o.person_id = g.patient_id
            AND o.concept_id = 856 AND o.encounter_type = 11 AND o.encounter_datetime <= {E})""",
        "vl_received": f"""(SELECT max(o.value_datetime) FROM ox o WHERE o.person_id = g.patient_id
            AND o.concept_id = 165987 AND o.encounter_type = 11 AND o.encounter_datetime <= {E})""",
        "vl_alnum": L("o.name", [166422], 11, cutoff_col="encounter_datetime", cutoff=end_ts, order="encounter_datetime",
                      named=True),
        "sample_at": f"""(SELECT o.value_datetime FROM obs o WHERE o.person_id = g.patient_id AND o.voided = 0
            AND o.concept_id = 159951 AND o.obs_datetime <= {E} ORDER BY o.obs_datetime DESC, o.obs_id DESC LIMIT 1)""",
        "outcome_date_value": L("o.value_datetime", [165469], 15, any_row=True),
        "cause_of_death": L("o.name", [165889], 15, cutoff_col="encounter_datetime", cutoff=end_ts,
                            order="encounter_datetime", named=True),
        "va_166349": L("o.name", [166349], 15, order="encounter_datetime", named=True),
        "va_166348": L("o.name", [166348], 15, order="encounter_datetime", named=True),
        "va_166347": L("o.name", [166347], 15, order="encounter_datetime", named=True),
        "transfer_in_at": L("o.value_datetime", [160534], 14, any_row=True),
        "weight": L("o.value_numeric", [5089], 12, cutoff_col="obs_datetime", cutoff=end_ts),
        "height": L("o.value_numeric", [5090], 12, cutoff_col="obs_datetime", cutoff=end_ts),
        "bmi": L("o.value_numeric", [1342], 12, cutoff_col="obs_datetime", cutoff=end_ts),
        "first_tld_at": f"""(SELECT min(o.obs_datetime) FROM ox o WHERE o.person_id = g.patient_id
            AND o.concept_id IN (164506, 164507) AND o.encounter_type = 13 AND o.obs_datetime <= {E}
            AND o.value_coded IN ({', '.join(map(str, S.TLD_REGIMENS))}))""",
        "cd4": L("o.value_numeric", [5497], 11, order="encounter_datetime"),
        "cd4_at": L("o.encounter_datetime", [5497], 11, order="encounter_datetime"),
        "care_entry_code": f"""(SELECT o.value_coded FROM obs o WHERE o.person_id = g.patient_id AND o.voided = 0
            AND o.concept_id = 165839 ORDER BY o.obs_id LIMIT 1)""",
        "care_entry_encounter": f"""(SELECT o.encounter_id FROM obs o WHERE o.person_id = g.patient_id AND o.voided = 0
            AND o.concept_id = 165839 ORDER BY o.obs_id LIMIT 1)""",
        "prevq_pickup_at": L("o.obs_datetime", [162240], form=27, cutoff_col="obs_datetime", cutoff=pq_end_ts),
        "prevq_pickup_encounter": L("o.encounter_id", [162240], form=27, cutoff_col="obs_datetime", cutoff=pq_end_ts),
        "prevq_outcome_obs": L("o.obs_id", [165470], form=13, cutoff_col="obs_datetime", cutoff=pq_day_ts),
        "tb_screen_at": f"""(SELECT max(e.encounter_datetime) FROM encounter e WHERE e.patient_id = g.patient_id
            AND e.encounter_type = 23 AND e.voided = 0 AND e.encounter_datetime <= {E})""",
        "pickup_at": f"""(SELECT max(e.encounter_datetime) FROM encounter e WHERE e.patient_id = g.patient_id
            AND e.form_id = 27 AND e.encounter_type = 13 AND e.voided = 0 AND CAST(e.encounter_datetime AS DATE) <= {ts(end)})""",
        "tracking_at": f"""(SELECT max(e.encounter_datetime) FROM encounter e WHERE e.patient_id = g.patient_id
            AND e.form_id = 30 AND e.voided = 0)""",
    }
    for name, c in S.AHD_COLUMNS:
        per_person[f"ahd_{c}"] = L("o.name", [c], 11, cutoff_col="encounter_datetime", cutoff=end_ts,
                                   order="encounter_datetime", named=True)
    for name, c in S.TB_NAMED:
        per_person[f"tb_{c}"] = L("o.name", [c], 23, named=True)
    for name, c in S.TB_YES_NO:
        per_person[f"tb_{c}"] = L("CASE WHEN o.value_coded = 2 THEN 'No' WHEN o.value_coded = 1 THEN 'Yes' ELSE '' END",
                                  [c], 23)
    for name, c in S.TB_YES:
        per_person[f"tb_{c}"] = L("CASE WHEN o.value_coded = 1 THEN 'Yes' ELSE '' END", [c], 23)

    lateral = ",\n    ".join(f"{expr} AS {name}" for name, expr in per_person.items())
    vit = {c: f"v{c}" for c in S.VITALS}
    otz = {c: f"z{c}" for c in S.OTZ}
    vit_cols = ", ".join(f"max(CASE WHEN concept_id = {c} THEN name END) AS {a}_name, "
                         f"max(CASE WHEN concept_id = {c} THEN value_numeric END) AS {a}_num" for c, a in vit.items())
    otz_cols = ", ".join(f"max(CASE WHEN concept_id = {c} THEN name END) AS {a}_name, "
                         f"max(CASE WHEN concept_id = {c} THEN value_datetime END) AS {a}_vdt" for c, a in otz.items())
    pq_end_lit = ts(pq_end)
    tb_cols = ["IPT_Screening_Date"] + [n for n, _ in S.TB_NAMED + S.TB_YES_NO + S.TB_YES]
    tb_src = {"IPT_Screening_Date": "CAST(w.tb_screen_at AS DATE)"}
    for name, c in S.TB_NAMED + S.TB_YES_NO + S.TB_YES:
        tb_src[name] = f"w.tb_{c}"
    care_whens = " ".join(f"WHEN w.care_entry_code = {a} THEN '{label}'" for a, label in S.CARE_ENTRY_LABELS)
    art_years = whole_units("w.birthdate", "w.art_start_at", "year")
    age_years = whole_units("w.birthdate", ts(today), "year")
    pickup = "CASE WHEN w.has_pickup_line = 1 THEN CAST(w.pickup_at AS DATE) END"
    iit = add_days(pickup, "w.refill + 29")
    outcomes = (f"CASE WHEN {non_empty('w.outcome_name')} THEN w.outcome_name "
                f"WHEN w.transferred_out = 1 THEN 'Transferred Out' END")
    sql = f"""{with_tables(*ALL)},
en AS (SELECT concept_id, min(name) AS name FROM concept_name
       WHERE lower(rtrim(locale)) = 'en' AND locale_preferred = 1 AND name IS NOT NULL GROUP BY concept_id),
ox AS (SELECT o.*, e.encounter_type, e.form_id, e.encounter_datetime, en.name
       FROM obs o LEFT JOIN (SELECT * FROM encounter WHERE voided = 0) e ON e.encounter_id = o.encounter_id
       LEFT JOIN en ON en.concept_id = o.value_coded WHERE o.voided = 0),
ls AS (SELECT * FROM ox WHERE concept_id IN ({latest}) AND obs_datetime <= {E}
       QUALIFY obs_datetime = max(obs_datetime) OVER (PARTITION BY person_id, concept_id)),
fs AS (SELECT * FROM ox WHERE concept_id IN ({first}) AND obs_datetime <= {E}
       QUALIFY obs_datetime = min(obs_datetime) OVER (PARTITION BY person_id, concept_id)),
vt AS (SELECT * FROM ox WHERE concept_id IN ({', '.join(map(str, S.VITALS))}) AND obs_datetime <= {E}
       QUALIFY row_number() OVER (PARTITION BY person_id, concept_id ORDER BY obs_datetime DESC, obs_id DESC) = 1),
oz AS (SELECT * FROM ox WHERE concept_id IN ({', '.join(map(str, S.OTZ))}) AND obs_datetime <= {E}
       QUALIFY row_number() OVER (PARTITION BY person_id, concept_id ORDER BY obs_datetime ASC, obs_id ASC) = 1),
lsa AS (SELECT person_id,
       max(CASE WHEN value_coded = {S.TRANSFERRED_OUT_ANSWER} THEN 1 END) AS transferred_out,
       {lmax(165708, '1')} AS has_pickup_line, {lmax(165708, 'obs_datetime')} AS last_regimen_line_at,
       {lmax(159368, 'value_numeric')} AS refill, {lmax(165708, 'name')} AS current_regimen_line,
       {lmax(165050, 'name')} AS pregnancy, {lmax(164980, 'name')} AS vl_indication, {lmax(165470, 'name')} AS outcome_name,
       {lmax(160540, 'name')} AS t160540, {lmax(165242, 'name')} AS t165242,
       {lmax(164852, 'value_datetime')} AS first_tpt, {lmax(166096, 'value_datetime')} AS last_tpt,
       {lmax(165727, 'name', ' AND value_coded = 1679')} AS tpt_received,
       {lmax(1659, 'name')} AS tb_status, {lmax(1659, 'obs_datetime')} AS tb_status_at,
       {lmax(1113, 'obs_datetime')} AS tb_start, {lmax(159431, 'obs_datetime')} AS tb_stop,
       {lmax(5096, 'value_datetime', ' AND form_id = 14')} AS next_ap
       FROM ls GROUP BY person_id),
fsa AS (SELECT person_id, {lmax(S.REGIMEN_LINE, 'name')} AS regimen_line_start,
       max(CASE WHEN concept_id IN ({', '.join(map(str, S.REGIMEN_CONCEPTS))}) THEN name END) AS regimen_start
       FROM fs GROUP BY person_id),
vta AS (SELECT person_id, {vit_cols} FROM vt GROUP BY person_id),
oza AS (SELECT person_id, {otz_cols} FROM oz GROUP BY person_id),
g AS (SELECT p.patient_id, pe.gender, pe.birthdate FROM patient p JOIN person pe ON pe.person_id = p.patient_id
      WHERE p.voided = 0
        AND EXISTS (SELECT 1 FROM ls WHERE ls.person_id = p.patient_id)
        AND EXISTS (SELECT 1 FROM encounter e WHERE e.patient_id = p.patient_id AND e.form_id = 23 AND e.voided = 0)),
gl AS (SELECT g.*, {lateral} FROM g),
w AS (SELECT gl.*, lsa.*, fsa.*, vta.*, oza.*,
        (SELECT min(identifier) FROM patient_identifier i WHERE i.patient_id = gl.patient_id AND i.identifier_type = 5) AS hospital_no,
        (SELECT family_name FROM person_name n WHERE n.person_id = gl.patient_id AND n.preferred = 1
            ORDER BY family_name NULLS FIRST, given_name NULLS FIRST LIMIT 1) AS family_name,
        (SELECT given_name FROM person_name n WHERE n.person_id = gl.patient_id AND n.preferred = 1
            ORDER BY family_name NULLS FIRST, given_name NULLS FIRST LIMIT 1) AS given_name,
        (SELECT CASE WHEN {non_empty('a.address2')} THEN a.address2 ELSE a.address1 END FROM person_address a
            WHERE a.person_id = gl.patient_id AND a.preferred = 1
            ORDER BY address1 NULLS FIRST, address2 NULLS FIRST, state_province NULLS FIRST, city_village NULLS FIRST LIMIT 1) AS address,
        (SELECT state_province FROM person_address a WHERE a.person_id = gl.patient_id AND a.preferred = 1
            ORDER BY address1 NULLS FIRST, address2 NULLS FIRST, state_province NULLS FIRST, city_village NULLS FIRST LIMIT 1) AS res_state,
        (SELECT city_village FROM person_address a WHERE a.person_id = gl.patient_id AND a.preferred = 1
            ORDER BY address1 NULLS FIRST, address2 NULLS FIRST, state_province NULLS FIRST, city_village NULLS FIRST LIMIT 1) AS res_lga,
        (SELECT min(value) FROM person_attribute pa WHERE pa.person_id = gl.patient_id AND pa.person_attribute_type_id = 8
            AND pa.voided = 0) AS phone,
        (SELECT min(date_enrolled) FROM patient_program pp WHERE pp.patient_id = gl.patient_id AND pp.program_id = 5
            AND pp.voided = 0) AS otz_enrolled_at,
        EXISTS (SELECT 1 FROM biometricinfo b WHERE b.patient_id = gl.patient_id) AS captured,
        (SELECT min(date_created) FROM biometricinfo b WHERE b.patient_id = gl.patient_id) AS capture_at,
        (SELECT max(date_created) FROM biometricverificationinfo b WHERE b.patient_id = gl.patient_id) AS recapture_at,
        (SELECT recapture_count FROM biometricverificationinfo b WHERE b.patient_id = gl.patient_id
            ORDER BY date_created DESC NULLS LAST, recapture_count DESC NULLS LAST LIMIT 1) AS recapture_count,
        (SELECT max(value_numeric) FROM obs r WHERE r.encounter_id = gl.prevq_pickup_encounter AND r.voided = 0
            AND r.concept_id = {S.REFILL_DAYS}) AS encounter_refill,
        (SELECT en.name FROM obs r JOIN en ON en.concept_id = r.value_coded WHERE r.obs_id = gl.prevq_outcome_obs) AS prevq_outcome_name,
        (SELECT t.value_text FROM obs t WHERE t.encounter_id = gl.care_entry_encounter AND t.concept_id = {S.CARE_ENTRY_OTHER_TEXT}
            ORDER BY t.obs_id LIMIT 1) AS care_entry_text
      FROM gl LEFT JOIN lsa ON lsa.person_id = gl.patient_id LEFT JOIN fsa ON fsa.person_id = gl.patient_id
      LEFT JOIN vta ON vta.person_id = gl.patient_id LEFT JOIN oza ON oza.person_id = gl.patient_id),
site AS (SELECT
        (SELECT min(state_province) FROM location WHERE location_id = 8) AS State,
        (SELECT min(name) FROM address_hierarchy_entry WHERE lower(rtrim(user_generated_id)) =
            (SELECT lower(rtrim(min(property_value))) FROM global_property WHERE lower(rtrim(property)) = 'partner_reporting_lga_code')) AS LGA,
        (SELECT min(property_value) FROM global_property WHERE lower(rtrim(property)) = 'facility_datim_code') AS Datim_Code,
        (SELECT min(property_value) FROM global_property WHERE lower(rtrim(property)) = 'facility_name') AS FacilityName),
pid AS (SELECT patient_id, min(identifier) AS PEPID, min(uuid) AS uuid FROM patient_identifier WHERE identifier_type = 4
        GROUP BY patient_id, lower(rtrim(identifier))),
rws AS (SELECT w.*, pid.PEPID, pid.uuid AS pid_uuid FROM w LEFT JOIN pid ON pid.patient_id = w.patient_id)
SELECT
  {"CAST(NULL AS VARCHAR)" if partner is None else "'" + partner.replace("'", "''") + "'"} AS IP, site.State, site.LGA, site.Datim_Code, site.FacilityName,
  w.patient_id, w.PEPID, w.hospital_no AS PatientHospitalNo, w.pid_uuid AS uuid, w.gender AS Sex,
  CASE {care_whens} WHEN w.care_entry_code = {S.CARE_ENTRY_OTHER} THEN w.care_entry_text END AS CareEntryPoint,
  w.kp_type AS KPType,
  CASE WHEN w.art_start_at IS NULL THEN NULL WHEN {art_years} >= 5 THEN {art_years} ELSE 0 END AS AgeAtStartofART,
  CASE WHEN w.art_start_at IS NOT NULL AND {art_years} < 5 THEN {whole_units('w.birthdate', 'w.art_start_at', 'month')} END AS AgeinMonths,
  CAST(w.hiv_confirmed_at AS DATE) AS "DateConfirmedHIV+",
  CAST(w.art_start_at AS DATE) AS ARTStartDate,
  CAST(date_diff('day', CAST(w.art_start_at AS DATE), {ts(end)}) AS INTEGER) AS DaysOnART,
  {pickup} AS Pharmacy_LastPickupdate,
  CAST(w.prevq_pickup_at AS DATE) AS Pharmacy_LastPickupdate_PreviousQuarter,
  w.refill AS DaysOfARVRefill,
  w.regimen_line_start AS RegimenLineAtARTStart, w.regimen_start AS RegimenAtARTStart,
  w.current_regimen_line AS CurrentRegimenLine, w.current_regimen AS CurrentARTRegimen,
  w.dsd_model AS DSD_Model, w.dsd_model_type AS DSD_Model_Type, w.pregnancy AS CurrentPregnancyStatus,
  w.viral_load AS CurrentViralLoad, CAST(w.viral_load_date AS DATE) AS DateofCurrentViralLoad,
  CAST(w.vl_received AS DATE) AS DateResultReceivedFacility, w.vl_alnum AS Alphanumeric_Viral_Load_Result,
  CAST(w.sample_at AS DATE) AS LastDateOfSampleCollection, w.vl_indication AS ViralLoadIndication,
  {outcomes} AS Outcomes,
  coalesce(CAST(w.outcome_date_value AS DATE), CASE WHEN w.transferred_out = 1 THEN CAST(w.tracking_at AS DATE) END) AS Outcomes_Date,
  CASE WHEN {text_is('w.outcome_name', 'Death')} THEN w.cause_of_death END AS Cause_of_Death,
  CASE WHEN {non_empty('w.va_166349')} AND {non_empty('w.va_166348')} THEN w.va_166348 ELSE w.va_166347 END AS VA_Cause_of_Death,
  {iit} AS IIT_Date,
  CASE WHEN {iit} > {ts(end)} THEN 'Active' ELSE 'LTFU' END AS CurrentARTStatus_Pharmacy,
  coalesce({outcomes}, CASE WHEN {iit} > {ts(end)} THEN 'Active' ELSE 'LTFU' END) AS CurrentARTStatus,
  coalesce(w.prevq_outcome_name,
           CASE WHEN {add_days('w.prevq_pickup_at', 'w.encounter_refill + 29')} >= {pq_end_lit} THEN 'Active' ELSE 'LTFU' END)
    AS ARTStatus_PreviousQuarter,
  w.birthdate AS DOB,
  CASE WHEN {age_years} >= 5 THEN {age_years} END AS Current_Age,
  CASE WHEN {age_years} < 5 THEN {whole_units('w.birthdate', ts(today), 'month')} END AS CurrentAge_Months,
  CASE WHEN {text_is('w.t160540', 'Transferred in')} OR {text_is('w.t165242', 'Transfer in with records')} THEN 'Yes' ELSE 'No' END AS TransferredIn,
  CASE WHEN {text_is('w.t160540', 'Transfer in')} OR {text_is('w.t165242', 'Transfer in with records')}
       THEN CAST(w.transfer_in_at AS DATE) END AS Date_Transfered_In,
  w.family_name AS Surname, w.given_name AS Firstname,
  w.v1712_name AS Educationallevel, w.v1054_name AS MaritalStatus, w.v1542_name AS JobStatus, w.phone AS PhoneNo,
  w.address AS Address, w.res_state AS State_of_Residence, w.res_lga AS LGA_of_Residence,
  w.weight AS Weight, w.height AS Height, w.bmi AS BMI,
  {number_text('w.v5085_num')} || '/' || {number_text('w.v5086_num')} AS BP,
  w.v5356_name AS Whostage,
  CAST(w.first_tld_at AS DATE) AS DateofFirstTLD_Pickup,
  w.cd4 AS CurrentCD4, CAST(w.cd4_at AS DATE) AS CurrentCD4Date,
  {', '.join(f'w.ahd_{c} AS "{n}"' for n, c in S.AHD_COLUMNS)},
  {add_days(pickup, 'w.refill')} AS EstimatedNextAppointmentPharmacy,
  CAST(w.next_ap AS DATE) AS Next_Ap_by_careCard,
  CAST(date_diff('day', {ts(today)}, {add_days('w.last_regimen_line_at', 'w.refill')}) AS INTEGER) AS Days_To_Schedule,
  {', '.join(f'CASE WHEN w.PEPID IS NOT NULL THEN {tb_src[n]} END AS {n}' for n in tb_cols)},
  CAST(w.first_tpt AS DATE) AS First_TPT_Pickupdate, CAST(w.last_tpt AS DATE) AS Last_TPT_Pickupdate,
  w.tpt_received AS Current_TPT_Received, CAST(NULL AS VARCHAR) AS TPT_Outcomes, CAST(NULL AS DATE) AS Date_of_TPT_Outcome,
  w.tb_status AS Current_TB_Status, CAST(w.tb_status_at AS DATE) AS DateofCurrent_TBStatus,
  CAST(w.tb_start AS DATE) AS TB_Treatment_Start_Date, CAST(w.tb_stop AS DATE) AS TB_Treatment_Stop_Date,
  CAST(w.otz_enrolled_at AS DATE) AS Date_Enrolled_Into_OTZ, CAST(NULL AS DATE) AS Date_Enrolled_Into_OTZ_Plus,
  {', '.join(f'w.z{c}_name AS {n}' for n, c in S.OTZ_COLUMNS)},
  CAST(w.z166275_vdt AS DATE) AS OTZ_Outcome_Date,
  CASE WHEN w.captured THEN 'Yes' ELSE 'No' END AS PBS_Capturee,
  CAST(w.capture_at AS DATE) AS PBS_Capture_Date,
  '{end:%Y-%m-%d}{version_tag}' AS Date_Generated,
  site.Datim_Code || '_' || w.PEPID AS Unique_Id,
  CASE WHEN w.recapture_at IS NOT NULL THEN 'Yes' ELSE '' END AS PBS_Recapture,
  CAST(w.recapture_at AS DATE) AS PBS_Recapture_Date,
  w.recapture_count AS PBS_Recapture_Count
FROM rws w CROSS JOIN site"""
    return sql
