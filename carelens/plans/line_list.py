"""The comprehensive one-row-per-patient line list, as of a report day.

Plan (see README): one filtered scan of ``obs`` joined once to ``encounter`` answers every
observation question of the report through the spec table (``carelens.plans.specs``);
one grouped pass over ``encounter`` gives the encounter dates; identity, programme and
biometric tables are reduced to one row per patient; everything is joined on the
patient id, which all per-patient frames are already hash-partitioned by.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions.dates import (
    FORMAT_DMONY, FORMAT_DMY, FORMAT_ISO, add_whole_days, day_after, end_of_day, midnight, minus_months_py,
    outcome_status, quarter_end_py, whole_months, whole_years,
)
from carelens.functions.text import non_empty, number_text, text_is
from carelens.operators import patients as P
from carelens.operators.dictionary import ranked_names
from carelens.operators.picks import PickPlan, best_values, from_micros, micros, pivot, plan_candidates, spread_left_join
from carelens.plans import specs as S
from carelens.sources.tables import ClinicalTables


@dataclass(frozen=True)
class LineListParams:
    """Run parameters. ``end`` is the report day (whole day included); ``today`` replaces the clock."""

    end: dt.date
    today: dt.date | None = None
    # the implementing partner printed in the first column (a site setting; NULL when not given)
    implementing_partner: str | None = None
    extended_concepts: bool = False
    version_tag: str = "_v1.2"
    state_location_id: int = 8
    # Cut the lineage after the per-patient answers (a reliable checkpoint in the cluster's
    # spark.checkpoint.dir): the expensive obs pipeline is then never recomputed when an
    # executor is lost later in the job. Eager, so it runs when the plan is built.
    checkpoint_answers: bool = False

    @property
    def as_of(self) -> dt.date:
        return self.today or dt.date.today()

    @property
    def prev_quarter_day(self) -> dt.date:
        return minus_months_py(self.end, 3)

    @property
    def prev_quarter_end(self) -> dt.date:
        return quarter_end_py(self.prev_quarter_day)

    def cutoffs(self) -> dict[str, dt.datetime]:
        # report cutoffs include the whole report day; the previous-quarter lookups compare
        # with a DATE, i.e. midnight at the start of the day
        return {
            "end": end_of_day(self.end),
            "prev_quarter_day": midnight(self.prev_quarter_day),
            "prev_quarter_end": midnight(self.prev_quarter_end),
        }


# Output columns in report order (110 from the main table, then 4 added at the end).
COLUMNS = [
    "IP", "State", "LGA", "Datim_Code", "FacilityName", "patient_id", "PEPID", "PatientHospitalNo", "uuid", "Sex",
    "CareEntryPoint", "KPType", "AgeAtStartofART", "AgeinMonths", "DateConfirmedHIV+", "ARTStartDate", "DaysOnART",
    "Pharmacy_LastPickupdate", "Pharmacy_LastPickupdate_PreviousQuarter", "DaysOfARVRefill", "RegimenLineAtARTStart",
    "RegimenAtARTStart", "CurrentRegimenLine", "CurrentARTRegimen", "DSD_Model", "DSD_Model_Type",
    "CurrentPregnancyStatus", "CurrentViralLoad", "DateofCurrentViralLoad", "DateResultReceivedFacility",
    "Alphanumeric_Viral_Load_Result", "LastDateOfSampleCollection", "ViralLoadIndication", "Outcomes", "Outcomes_Date",
    "Cause_of_Death", "VA_Cause_of_Death", "IIT_Date", "CurrentARTStatus_Pharmacy", "CurrentARTStatus",
    "ARTStatus_PreviousQuarter", "DOB", "Current_Age", "CurrentAge_Months", "TransferredIn", "Date_Transfered_In",
    "Surname", "Firstname", "Educationallevel", "MaritalStatus", "JobStatus", "PhoneNo", "Address",
    "State_of_Residence", "LGA_of_Residence", "Weight", "Height", "BMI", "BP", "Whostage", "DateofFirstTLD_Pickup",
    "CurrentCD4", "CurrentCD4Date", "AHD_Indication", "Current_CD4_LFA_Result", "Other_Test_(TB-LAM_LF-LAM_etc)",
    "Serology_for_CrAg_Result", "CSF_for_CrAg_Result", "EstimatedNextAppointmentPharmacy", "Next_Ap_by_careCard",
    "Days_To_Schedule", "IPT_Screening_Date", "Are_you_coughing_currently", "Do_you_have_fever",
    "Are_you_losing_weight", "Are_you_having_night_sweats", "History_of_contacts_with_TB_patients", "Sputum_AFB",
    "Sputum_AFB_Result", "GeneXpert", "GeneXpert_Result", "Chest_Xray", "Chest_Xray_Result", "Culture",
    "Culture_Result", "Is_Patient_Eligible_For_IPT", "First_TPT_Pickupdate", "Last_TPT_Pickupdate",
    "Current_TPT_Received", "TPT_Outcomes", "Date_of_TPT_Outcome", "Current_TB_Status", "DateofCurrent_TBStatus",
    "TB_Treatment_Start_Date", "TB_Treatment_Stop_Date", "Date_Enrolled_Into_OTZ", "Date_Enrolled_Into_OTZ_Plus",
    "Positive_living", "Treatment_Literacy", "Adolescents_participation", "Leadership_training",
    "Peer_To_Peer_Mentoship", "Role_of_OTZ", "OTZ_Champion_Oreintation", "Transitioned_Adult_Clinic", "OTZ_Outcome",
    "OTZ_Outcome_Date", "PBS_Capturee", "PBS_Capture_Date", "Date_Generated",
    "Unique_Id", "PBS_Recapture", "PBS_Recapture_Date", "PBS_Recapture_Count",
]

PICKUP_COLUMNS = ["Pharmacy_LastPickupdate", "IIT_Date", "CurrentARTStatus_Pharmacy", "EstimatedNextAppointmentPharmacy"]
TB_COLUMNS = ["IPT_Screening_Date"] + [n for n, _ in S.TB_NAMED + S.TB_YES_NO + S.TB_YES]

# Text formats of the date columns when rendered for display (typed output keeps DATE).
DISPLAY_FORMATS = {
    **{c: FORMAT_DMY for c in (
        "DateConfirmedHIV+", "ARTStartDate", "Pharmacy_LastPickupdate", "Pharmacy_LastPickupdate_PreviousQuarter",
        "DateofCurrentViralLoad", "DateResultReceivedFacility", "Outcomes_Date", "DOB", "Date_Transfered_In",
        "DateofFirstTLD_Pickup", "IPT_Screening_Date", "Date_Enrolled_Into_OTZ", "OTZ_Outcome_Date",
        "PBS_Capture_Date")},
    **{c: FORMAT_DMONY for c in (
        "LastDateOfSampleCollection", "Next_Ap_by_careCard", "First_TPT_Pickupdate", "Last_TPT_Pickupdate",
        "Date_of_TPT_Outcome", "DateofCurrent_TBStatus", "TB_Treatment_Start_Date", "TB_Treatment_Stop_Date",
        "Date_Enrolled_Into_OTZ_Plus")},
    **{c: FORMAT_ISO for c in ("IIT_Date", "CurrentCD4Date", "EstimatedNextAppointmentPharmacy", "PBS_Recapture_Date")},
}


def _d(c: str | Column) -> Column:
    return F.expr(f"CAST(`{c}` AS DATE)") if isinstance(c, str) else c.cast("date")


def _c(name: str) -> Column:
    """A column reference built from SQL text (far fewer JVM calls than ``F.col``)."""
    return F.expr(f"`{name}`")


# Columns whose report value is the MAX of formatted text over tied rows (legacy mode).
LEGACY_TEXT_TIES = {"First_TPT_Pickupdate": "L164852", "Last_TPT_Pickupdate": "L166096",
                    "Date_of_TPT_Outcome": "L166008", "Next_Ap_by_careCard": "L5096"}
# Months in the alphabetical order of their English short names.
MONTHS_BY_NAME = (4, 8, 12, 2, 1, 7, 6, 3, 5, 11, 10, 9)


def text_order(date: str, by_name: bool) -> str:
    """SQL for a long that orders as the text of a date does: dd-MMM-yyyy (``by_name``) or dd/MM/yyyy."""
    month = f"array_position(array({', '.join(map(str, MONTHS_BY_NAME))}), month({date}))" if by_name else f"month({date})"
    return f"(day({date}) * 1000000L + {month} * 10000 + year({date}))"


def from_text_order(value: str, by_name: bool) -> str:
    """SQL for the date of a ``text_order`` number."""
    month = f"CAST({value} DIV 10000 % 100 AS int)"
    if by_name:
        month = f"element_at(array({', '.join(map(str, MONTHS_BY_NAME))}), {month})"
    return f"make_date(CAST({value} % 10000 AS int), {month}, CAST({value} DIV 1000000 AS int))"


# What a read column is, as a number of its own order (see ``best_values``); times are microseconds.
TIMES = ("obs_datetime", "value_datetime", "encounter_datetime", "care_card_next_at")
_CARE_CARD = f"CASE WHEN form_id = {S.FORM_CARE_CARD} THEN value_datetime END"
LONG_READS = {
    "one": "1", "value_coded": "value_coded", "encounter_id": "encounter_id", "name": "name",
    "tpt_received_name": f"CASE WHEN value_coded = {S.TPT_RECEIVED_ANSWER} THEN name END",
    "transferred_out": f"IF(value_coded <=> {S.TRANSFERRED_OUT_ANSWER}, 1, 0)",
    **{c: micros(c) for c in TIMES[:3]}, "care_card_next_at": micros(_CARE_CARD),
    "value_text_order": text_order("value_datetime", True), "care_card_text_order": text_order(f"({_CARE_CARD})", True),
}
DOUBLE_READS = {"value_numeric": "value_numeric", "encounter_refill": "encounter_refill"}
NAME_READS = ("name", "tpt_received_name")


def qualifying_rows(spark: SparkSession, t: ClinicalTables, params: LineListParams, plan: PickPlan, facts: DataFrame | None = None) -> DataFrame:
    """The observations that qualify for each question of ``plan``; coded values carry the numbers of their names.

    ``facts``: the observations from which refill counts are taken, if not those of ``t``.
    """
    return plan_candidates(spark, t.obs, t.encounter, t.concept_name, plan, params.cutoffs(), extra_forms=[S.FORM_CARE_CARD],
                           encounter_facts=encounter_refills(t.obs if facts is None else facts) if "prevq_pickup" in plan.index else None,
                           names=ranked_names(t.concept_name).selectExpr("concept_id AS value_coded", "name_rank AS name"))


def answer_reads(plan: PickPlan, legacy_text_max: bool = False) -> tuple[list[tuple[str, str]], dict[str, str], dict[str, str]]:
    """What the report's answers read: the (question, column) pairs, the pivot aggregate and the column of each answer."""
    has = plan.index.__contains__
    reads: list[tuple[str, str]] = []
    aggs: dict[str, str] = {}
    kinds: dict[str, str] = {}

    def add(name: str, keys: list[str], column: str, value: str | None = None) -> None:
        """An answer that reads ``column`` of the questions ``keys`` (the largest); left out where the plan does not ask them."""
        if not all(map(has, keys)):
            return
        for k in keys:
            if (k, column) not in reads:
                reads.append((k, column))
        listed = ", ".join(str(reads.index((k, column))) for k in keys)
        value = value or ("name" if column in NAME_READS else "d" if column in DOUBLE_READS else "v")
        aggs[name], kinds[name] = f"max(CASE WHEN read_idx IN ({listed}) THEN {value} END)", column

    latest_keys = list(S.LATEST_KEYS)
    # any row at the latest time of any latest-set concept carries the "transferred out" answer
    add("has_latest", latest_keys, "transferred_out", "1")
    add("transferred_out", latest_keys, "transferred_out", "NULLIF(v, 0)")
    add("RegimenAtARTStart", [f"F{c}" for c in S.REGIMEN_CONCEPTS], "name")
    for name, key, column in (
        ("has_pickup_line", "L165708", "one"), ("last_regimen_line_at", "L165708", "obs_datetime"),
        ("refill", "L159368", "value_numeric"), ("CurrentRegimenLine", "L165708", "name"),
        ("CurrentPregnancyStatus", "L165050", "name"), ("ViralLoadIndication", "L164980", "name"),
        ("outcome_name", "L165470", "name"), ("t160540", "L160540", "name"), ("t165242", "L165242", "name"),
        ("First_TPT_Pickupdate", "L164852", "value_datetime"), ("Last_TPT_Pickupdate", "L166096", "value_datetime"),
        ("Current_TPT_Received", "L165727", "tpt_received_name"), ("Current_TB_Status", "L1659", "name"),
        ("DateofCurrent_TBStatus", "L1659", "obs_datetime"), ("TB_Treatment_Start_Date", "L1113", "obs_datetime"),
        ("TB_Treatment_Stop_Date", "L159431", "obs_datetime"), ("Next_Ap_by_careCard", "L5096", "care_card_next_at"),
        ("RegimenLineAtARTStart", f"F{S.REGIMEN_LINE}", "name"), ("bp_systolic", "V5085", "value_numeric"),
        ("bp_diastolic", "V5086", "value_numeric"), ("KPType", "kp_type", "name"),
        ("art_start_at", "art_start", "value_datetime"), ("hiv_confirmed_at", "hiv_confirmed", "value_datetime"),
        ("CurrentARTRegimen", "current_regimen", "name"), ("DSD_Model", "dsd_model", "name"),
        ("DSD_Model_Type", "dsd_model_type", "name"), ("CurrentViralLoad", "viral_load", "value_numeric"),
        ("DateofCurrentViralLoad", "viral_load_date", "encounter_datetime"),
        ("DateResultReceivedFacility", "vl_result_received", "value_datetime"),
        ("Alphanumeric_Viral_Load_Result", "vl_alphanumeric", "name"),
        ("LastDateOfSampleCollection", "sample_collection", "value_datetime"),
        ("outcome_date_value", "outcome_date", "value_datetime"), ("cause_of_death", "cause_of_death", "name"),
        ("va_166349", "va_166349", "name"), ("va_166348", "va_166348", "name"), ("va_166347", "va_166347", "name"),
        ("transfer_in_at", "transfer_in_date", "value_datetime"), ("Weight", "weight", "value_numeric"),
        ("Height", "height", "value_numeric"), ("BMI", "bmi", "value_numeric"), ("first_tld_at", "first_tld", "obs_datetime"),
        ("CurrentCD4", "cd4", "value_numeric"), ("cd4_encounter_at", "cd4", "encounter_datetime"),
        ("care_entry_code", "care_entry", "value_coded"), ("care_entry_encounter", "care_entry", "encounter_id"),
        ("prevq_pickup_at", "prevq_pickup", "obs_datetime"), ("encounter_refill", "prevq_pickup", "encounter_refill"),
        ("prevq_outcome_name", "prevq_outcome", "name"), ("OTZ_Outcome_Date", "O166275", "value_datetime"),
        ("TPT_Outcomes", "L166007", "name"), ("Date_of_TPT_Outcome", "L166008", "value_datetime"),
        ("Date_Enrolled_Into_OTZ_Plus", "L166350", "value_datetime"),
        *((n, f"V{c}", "name") for n, c in S.VITALS_NAMES), *((n, f"O{c}", "name") for n, c in S.OTZ_COLUMNS),
        *((n, f"ahd_{c}", "name") for n, c in S.AHD_COLUMNS), *((n, f"tb_{c}", "name") for n, c in S.TB_NAMED),
    ):
        add(name, [key], column)
    for name, c in S.TB_YES_NO:
        add(name, [f"tb_{c}"], "value_coded", "CASE v WHEN 2 THEN 'No' WHEN 1 THEN 'Yes' ELSE '' END")
    for name, c in S.TB_YES:
        add(name, [f"tb_{c}"], "value_coded", "CASE v WHEN 1 THEN 'Yes' ELSE '' END")
    if legacy_text_max:
        for out, key in LEGACY_TEXT_TIES.items():
            add(f"{out}__text", [key], "care_card_text_order" if key == "L5096" else "value_text_order")
    return reads, aggs, kinds


def observation_answers(spark: SparkSession, t: ClinicalTables, params: LineListParams,
                        plan: PickPlan | None = None, legacy_text_max: bool = False,
                        keep: frozenset[str] | None = None, state: DataFrame | None = None) -> DataFrame:
    """Every observation-derived value of the report, one row per person (``person_id``).

    Names are fetched for the chosen values only. ``state``: the best values as kept by ``plans.as_of``
    (of the whole plan) instead of a pass over ``obs``.
    """
    plan = plan or S.line_list_plan(params.extended_concepts, keep)
    names = ranked_names(t.concept_name)
    reads, aggs, kinds = answer_reads(plan, legacy_text_max)
    if state is None:
        best = best_values(qualifying_rows(spark, t, params, plan), plan, reads, LONG_READS, DOUBLE_READS)
    else:
        best = state.select("person_id", "read_idx", "v", "d")
    named = [i for i, (_, c) in enumerate(reads) if c in NAME_READS]
    if named:
        # most rows read no name
        best = spread_left_join(best.withColumn("name_rank", F.expr(f"CASE WHEN read_idx IN ({', '.join(map(str, named))}) THEN v END")),
                                names.select("name_rank", "name"), "name_rank", "person_id")
    # The narrow rows are dealt out by patient and sorted; the wide ones come out of that in order, one a patient.
    answers = pivot(best.repartition("person_id"), aggs)
    decoded = {"care_card_text_order": True, "value_text_order": True}
    answers = answers.selectExpr("person_id", *[
        f"{from_micros(f'`{n}`')} AS `{n}`" if kinds[n] in TIMES
        else f"{from_text_order(f'`{n}`', True)} AS `{n}`" if kinds[n] in decoded else f"`{n}`" for n in aggs])
    if "care_entry_code" in aggs:
        care = answers if len(plan.specs) == 1 else _care_entries(spark, t, params, plan, state)
        answers = answers.join(_care_entry_texts(care, t.obs), "person_id", "left")
    if not params.extended_concepts:
        answers = (answers.withColumn("TPT_Outcomes", F.lit(None).cast("string"))
                   .withColumn("Date_of_TPT_Outcome", F.lit(None).cast("timestamp_ntz"))
                   .withColumn("Date_Enrolled_Into_OTZ_Plus", F.lit(None).cast("timestamp_ntz")))
    return answers


def encounter_refills(obs: DataFrame) -> DataFrame:
    """Per encounter the refill days recorded in it (largest non-voided value)."""
    return obs.filter((F.col("concept_id") == S.REFILL_DAYS) & (F.col("voided") == 0) & F.col("encounter_id").isNotNull()).groupBy(
        "encounter_id").agg(F.max("value_numeric").alias("encounter_refill"))


def encounter_texts(obs: DataFrame) -> DataFrame:
    """Per encounter the free text of the "other" care entry point (lowest obs id; voided rows count, as in the report).

    The lowest id is a hash aggregate; its text is fetched by the id.
    """
    rows = obs.filter((F.col("concept_id") == S.CARE_ENTRY_OTHER_TEXT) & F.col("encounter_id").isNotNull())
    first = rows.groupBy("encounter_id").agg(F.min("obs_id").alias("obs_id"))
    return rows.select("encounter_id", "obs_id", F.col("value_text").alias("care_entry_text")).join(
        first, ["encounter_id", "obs_id"], "left_semi").select("encounter_id", "care_entry_text")


def encounter_dates(encounter: DataFrame, params: LineListParams) -> DataFrame:
    """Per patient: form-23 gate, last pharmacy pickup, last tracking form and last TB screening."""
    e = encounter.filter((F.col("voided") == 0) & (
        F.col("form_id").isin(S.FORM_CARE_CARD_GATE, S.FORM_PHARMACY, S.FORM_TRACKING)
        | (F.col("encounter_type") == S.ENC_TB_SCREEN)))
    on_or_before_end = F.col("encounter_datetime") < day_after(params.end)
    return e.groupBy("patient_id").agg(
        F.max(F.when(F.col("form_id") == S.FORM_CARE_CARD_GATE, F.lit(1))).alias("has_gate_form"),
        F.max(F.when((F.col("form_id") == S.FORM_PHARMACY) & (F.col("encounter_type") == S.ENC_PHARMACY)
                     & on_or_before_end, F.col("encounter_datetime"))).alias("pickup_at"),
        F.max(F.when(F.col("form_id") == S.FORM_TRACKING, F.col("encounter_datetime"))).alias("tracking_at"),
        # the time whose text is largest (legacy mode; dropped from the plan where nothing reads it)
        F.max(F.when(F.col("form_id") == S.FORM_TRACKING, F.expr(text_order("encounter_datetime", False)))).alias("tracking_text_max"),
        F.max(F.when((F.col("encounter_type") == S.ENC_TB_SCREEN) & on_or_before_end, F.col("encounter_datetime")))
        .alias("tb_screen_at"),
    )


def _care_entries(spark: SparkSession, t: ClinicalTables, params: LineListParams, plan: PickPlan, state: DataFrame | None) -> DataFrame:
    """person_id, care_entry_code, care_entry_encounter: that one question's answers, without the wide rows of all others."""
    if state is None:
        plan = S.line_list_plan(params.extended_concepts, frozenset({"care_entry"}))
        cands = plan_candidates(spark, t.obs, t.encounter, t.concept_name, plan, params.cutoffs(),
                                names=ranked_names(t.concept_name).selectExpr("concept_id AS value_coded", "name_rank AS name"))
        reads, aggs, _ = answer_reads(plan)
        return pivot(best_values(cands, plan, reads, LONG_READS, DOUBLE_READS), aggs)
    reads, aggs, _ = answer_reads(plan)
    own = ", ".join(str(i) for i, (k, _) in enumerate(reads) if k == "care_entry")
    return pivot(state.filter(f"read_idx IN ({own})"), {n: aggs[n] for n in ("care_entry_code", "care_entry_encounter")})


def _care_entry_texts(care: DataFrame, obs: DataFrame) -> DataFrame:
    """person_id, care_entry_text of the patients with the "other" care entry point."""
    other = care.filter(f"care_entry_code = {S.CARE_ENTRY_OTHER}").selectExpr("person_id", "care_entry_encounter AS encounter_id")
    return other.join(encounter_texts(obs), "encounter_id").select("person_id", "care_entry_text")


def _care_entry_point(code: str, text: str) -> Column:
    """Label of the care entry answer; the "other" answer reads the free text instead."""
    whens = " ".join(f"WHEN `{code}` = {answer} THEN '{label}'" for answer, label in S.CARE_ENTRY_LABELS)
    return F.expr(f"CASE {whens} WHEN `{code}` = {S.CARE_ENTRY_OTHER} THEN `{text}` END")


def line_list(spark: SparkSession, t: ClinicalTables, params: LineListParams, display: bool = False,
              legacy_text_max: bool = False, section: str | None = None, state: DataFrame | None = None) -> DataFrame:
    """The 114-column line list: one row per listed patient and type-4 identifier.

    ``display=True`` renders dates as the report's text formats; ``legacy_text_max``
    reproduces the report's text maximum for the outcome date (``31/01/2020`` beats
    ``01/12/2024``). ``section`` (a key of ``SECTIONS``) computes only the observation
    questions that section reads and returns its columns. ``state``: kept best values (``plans.as_of``;
    not with a section or the legacy mode).
    """
    if state is not None and (section or legacy_text_max):
        raise ValueError("a kept state answers the whole report")
    wanted = set(SECTIONS[section]) if section else set(COLUMNS)
    if section:
        keep = S.SECTION_SPECS[section] | (S.EXTENDED_SECTION_SPECS.get(section, frozenset()) if params.extended_concepts else frozenset())
    else:
        keep = None
    answers = None
    if keep is None or keep:
        answers = observation_answers(spark, t, params, legacy_text_max=legacy_text_max, keep=keep, state=state)
        if params.checkpoint_answers:
            from carelens.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(spark)
            answers = answers.checkpoint(eager=True)
        answers = answers.withColumnRenamed("person_id", "patient_id")
    base = P.active_patients(t.patient, t.person)
    if section:
        wide = base.join(population(t, params), "patient_id", "left_semi")
        wide = wide.join(answers, "patient_id", "left") if answers is not None else wide
        if wanted & {*PICKUP_COLUMNS, "Outcomes_Date", "CurrentARTStatus", "IPT_Screening_Date"}:
            wide = wide.join(encounter_dates(t.encounter, params), "patient_id", "left")
    else:
        enc = encounter_dates(t.encounter, params).filter(_c("has_gate_form") == 1)
        wide = base.join(answers.filter(_c("has_latest") == 1), "patient_id").join(enc, "patient_id")
    # one row per patient each; joined where a wanted column reads it
    for reads, frame in (
        ({"PatientHospitalNo"}, lambda: P.first_identifier(t.patient_identifier, 5, "PatientHospitalNo")),
        ({"Surname", "Firstname"}, lambda: P.preferred_name(t.person_name)),
        ({"Address", "State_of_Residence", "LGA_of_Residence"}, lambda: P.preferred_address(t.person_address)),
        ({"PhoneNo"}, lambda: P.attribute_value(t.person_attribute, 8, "PhoneNo")),
        ({"Date_Enrolled_Into_OTZ"}, lambda: P.program_enrolment(t.patient_program, 5, "otz_enrolled_at")),
        ({"PBS_Capturee", "PBS_Capture_Date"}, lambda: P.biometric_capture(t.biometricinfo)),
        ({"PBS_Recapture", "PBS_Recapture_Date", "PBS_Recapture_Count"}, lambda: P.biometric_recapture(t.biometricverificationinfo)),
    ):
        if reads & wanted:
            wide = wide.join(frame(), "patient_id", "left")
    end = F.lit(params.end)
    today = F.lit(params.as_of)
    pq_end = F.lit(params.prev_quarter_end)
    pickup = F.when(_c("has_pickup_line") == 1, _d("pickup_at"))
    iit = add_whole_days(pickup, _c("refill") + S.LTFU_GRACE_DAYS)
    outcome_text = _c("outcome_name")
    outcomes = F.when(non_empty(outcome_text), outcome_text).otherwise(
        F.when(_c("transferred_out") == 1, F.lit("Transferred Out")))
    art_years = whole_years(_c("birthdate"), _c("art_start_at"))
    age_years = whole_years(_c("birthdate"), today)
    transfer_flag = text_is(_c("t160540"), "Transferred in") | text_is(_c("t165242"), "Transfer in with records")
    transfer_date_flag = text_is(_c("t160540"), "Transfer in") | text_is(_c("t165242"), "Transfer in with records")
    if legacy_text_max:
        outcome_else = F.when(_c("transferred_out") == 1, F.expr(from_text_order("tracking_text_max", False)))
    else:
        outcome_else = F.when(_c("transferred_out") == 1, _d("tracking_at"))
    cols: dict[str, Column] = {
        "patient_id": _c("patient_id"),
        "PatientHospitalNo": _c("PatientHospitalNo"),
        "Sex": _c("gender"),
        "CareEntryPoint": _care_entry_point("care_entry_code", "care_entry_text"),
        "KPType": _c("KPType"),
        "AgeAtStartofART": F.when(_c("art_start_at").isNotNull(),
                                  F.when(art_years >= 5, art_years).otherwise(F.lit(0))),
        "AgeinMonths": F.when(_c("art_start_at").isNotNull() & (art_years < 5),
                              whole_months(_c("birthdate"), _c("art_start_at"))),
        "DateConfirmedHIV+": _d("hiv_confirmed_at"),
        "ARTStartDate": _d("art_start_at"),
        "DaysOnART": F.datediff(end, _d("art_start_at")),
        "Pharmacy_LastPickupdate": pickup,
        "Pharmacy_LastPickupdate_PreviousQuarter": _d("prevq_pickup_at"),
        "DaysOfARVRefill": _c("refill"),
        "RegimenLineAtARTStart": _c("RegimenLineAtARTStart"),
        "RegimenAtARTStart": _c("RegimenAtARTStart"),
        "CurrentRegimenLine": _c("CurrentRegimenLine"),
        "CurrentARTRegimen": _c("CurrentARTRegimen"),
        "DSD_Model": _c("DSD_Model"),
        "DSD_Model_Type": _c("DSD_Model_Type"),
        "CurrentPregnancyStatus": _c("CurrentPregnancyStatus"),
        "CurrentViralLoad": _c("CurrentViralLoad"),
        "DateofCurrentViralLoad": _d("DateofCurrentViralLoad"),
        "DateResultReceivedFacility": _d("DateResultReceivedFacility"),
        "Alphanumeric_Viral_Load_Result": _c("Alphanumeric_Viral_Load_Result"),
        "LastDateOfSampleCollection": _d("LastDateOfSampleCollection"),
        "ViralLoadIndication": _c("ViralLoadIndication"),
        "Outcomes": outcomes,
        "Outcomes_Date": F.coalesce(_d("outcome_date_value"), outcome_else),
        "Cause_of_Death": F.when(text_is(outcome_text, "Death"), _c("cause_of_death")),
        "VA_Cause_of_Death": F.when(non_empty(_c("va_166349")) & non_empty(_c("va_166348")), _c("va_166348"))
        .otherwise(_c("va_166347")),
        "IIT_Date": iit,
        "CurrentARTStatus_Pharmacy": F.when(iit > end, F.lit("Active")).otherwise(F.lit("LTFU")),
        "ARTStatus_PreviousQuarter": F.coalesce(
            _c("prevq_outcome_name"),
            outcome_status(_d("prevq_pickup_at"), _c("encounter_refill"), S.LTFU_GRACE_DAYS, pq_end)),
        "DOB": _c("birthdate"),
        "Current_Age": F.when(age_years >= 5, age_years),
        "CurrentAge_Months": F.when(age_years < 5, whole_months(_c("birthdate"), today)),
        "TransferredIn": F.when(transfer_flag, F.lit("Yes")).otherwise(F.lit("No")),
        "Date_Transfered_In": F.when(transfer_date_flag, _d("transfer_in_at")),
        "Surname": _c("family_name"),
        "Firstname": _c("given_name"),
        "Educationallevel": _c("Educationallevel"),
        "MaritalStatus": _c("MaritalStatus"),
        "JobStatus": _c("JobStatus"),
        "PhoneNo": _c("PhoneNo"),
        "Address": F.when(non_empty(_c("address2")), _c("address2")).otherwise(_c("address1")),
        "State_of_Residence": _c("state_province"),
        "LGA_of_Residence": _c("city_village"),
        "Weight": _c("Weight"),
        "Height": _c("Height"),
        "BMI": _c("BMI"),
        "BP": F.concat(number_text(_c("bp_systolic")), F.lit("/"), number_text(_c("bp_diastolic"))),
        "Whostage": _c("Whostage"),
        "DateofFirstTLD_Pickup": _d("first_tld_at"),
        "CurrentCD4": _c("CurrentCD4"),
        "CurrentCD4Date": _d("cd4_encounter_at"),
        **{name: _c(name) for name, _ in S.AHD_COLUMNS},
        "EstimatedNextAppointmentPharmacy": add_whole_days(pickup, _c("refill")),
        "Next_Ap_by_careCard": _d("Next_Ap_by_careCard"),
        "Days_To_Schedule": F.datediff(add_whole_days(_d("last_regimen_line_at"), _c("refill")), today),
        "IPT_Screening_Date": _d("tb_screen_at"),
        **{name: _c(name) for name, _ in S.TB_NAMED + S.TB_YES_NO + S.TB_YES},
        "First_TPT_Pickupdate": _d("First_TPT_Pickupdate"),
        "Last_TPT_Pickupdate": _d("Last_TPT_Pickupdate"),
        "Current_TPT_Received": _c("Current_TPT_Received"),
        "TPT_Outcomes": _c("TPT_Outcomes"),
        "Date_of_TPT_Outcome": _d("Date_of_TPT_Outcome"),
        "Current_TB_Status": _c("Current_TB_Status"),
        "DateofCurrent_TBStatus": _d("DateofCurrent_TBStatus"),
        "TB_Treatment_Start_Date": _d("TB_Treatment_Start_Date"),
        "TB_Treatment_Stop_Date": _d("TB_Treatment_Stop_Date"),
        "Date_Enrolled_Into_OTZ": _d("otz_enrolled_at"),
        "Date_Enrolled_Into_OTZ_Plus": _d("Date_Enrolled_Into_OTZ_Plus"),
        **{name: _c(name) for name, _ in S.OTZ_COLUMNS},
        "OTZ_Outcome_Date": _d("OTZ_Outcome_Date"),
        # the patient has a row, with or without a time
        "PBS_Capturee": F.when(_c("captured") == 1, F.lit("Yes")).otherwise(F.lit("No")),
        "PBS_Capture_Date": _d("capture_at"),
        "PBS_Recapture": F.when(_c("recapture_at").isNotNull(), F.lit("Yes")).otherwise(F.lit("")),
        "PBS_Recapture_Date": _d("recapture_at"),
        "PBS_Recapture_Count": _c("recapture_count"),
    }
    if legacy_text_max and answers is not None:
        # the report keeps the largest *text* among tied rows; typed output parses it back
        for out in LEGACY_TEXT_TIES:
            if f"{out}__text" in answers.columns:
                cols[out] = _c(f"{out}__text")
    # the current status reads two other columns
    read = wanted | ({"Outcomes", "IIT_Date"} if "CurrentARTStatus" in wanted else set()) | {"patient_id"}
    per_patient = wide.select(*[c.alias(n) for n, c in cols.items() if n in read])
    pepid = P.identifier_rows(t.patient_identifier, 4).withColumnRenamed("identifier", "PEPID")
    rows = per_patient.join(pepid, "patient_id", "left")
    # the TB screening block exists only for patients with a type-4 identifier
    rows = rows.selectExpr(*[f"CASE WHEN PEPID IS NOT NULL THEN `{c}` END AS `{c}`" if c in TB_COLUMNS else f"`{c}`"
                             for c in rows.columns])
    if wanted & {"State", "LGA", "Datim_Code", "FacilityName", "Unique_Id"}:
        # exactly one row
        rows = rows.crossJoin(F.broadcast(P.site_config(t.global_property, t.location, t.address_hierarchy_entry,
                                                        params.state_location_id)))
    added = {
        "IP": F.lit(params.implementing_partner).cast("string"),
        "CurrentARTStatus": F.coalesce(_c("Outcomes"), F.when(_c("IIT_Date") > end, F.lit("Active")).otherwise(F.lit("LTFU"))),
        "Date_Generated": F.lit(f"{params.end:%Y-%m-%d}{params.version_tag}"),
        "Unique_Id": F.concat(_c("Datim_Code"), F.lit("_"), _c("PEPID")),
    }
    order = SECTIONS[section] if section else COLUMNS
    final = rows.select(*[(added[c] if c in added else _c(c)).alias(c) for c in order])
    return render(final, legacy_text_max) if display else final


def render(df: DataFrame, legacy_text_max: bool = False) -> DataFrame:
    """Dates as the report's text (done last, on typed values)."""
    out = []
    for c in df.columns:
        fmt = DISPLAY_FORMATS.get(c)
        out.append(F.date_format(F.col(f"`{c}`"), fmt).alias(c) if fmt else F.col(f"`{c}`"))
    return df.select(*out)


def population(t: ClinicalTables, params: LineListParams) -> DataFrame:
    """Patients the report lists: non-voided, with a person row, a non-voided gate-form
    encounter (any date) and a non-voided latest-set observation on or before the report day."""
    obs_ok = t.obs.filter((F.col("voided") == 0) & F.col("concept_id").isin(list(S.LATEST_SET))
                          & (F.col("obs_datetime") < day_after(params.end))).select(F.col("person_id").alias("patient_id"))
    gate = t.encounter.filter((F.col("voided") == 0) & (F.col("form_id") == S.FORM_CARE_CARD_GATE)).select("patient_id")
    return (P.active_patients(t.patient, t.person).select("patient_id")
            .join(obs_ok, "patient_id", "left_semi").join(gate, "patient_id", "left_semi"))


# Columns of each report section (registered as their own queries).
SECTIONS = {
    "site_config_attach": ["patient_id", "PEPID", "IP", "State", "LGA", "Datim_Code", "FacilityName", "Unique_Id"],
    "patient_demographics": ["patient_id", "PEPID", "PatientHospitalNo", "uuid", "Sex", "Surname", "Firstname",
                             "PhoneNo", "State_of_Residence", "LGA_of_Residence", "DOB"],
    "address_fallback": ["patient_id", "PEPID", "Address"],
    "care_entry_point": ["patient_id", "PEPID", "CareEntryPoint"],
    "age_bands": ["patient_id", "PEPID", "AgeAtStartofART", "AgeinMonths", "Current_Age", "CurrentAge_Months"],
    "first_event_date": ["patient_id", "PEPID", "DateConfirmedHIV+", "ARTStartDate", "DaysOnART"],
    "last_pickup": ["patient_id", "PEPID", "Pharmacy_LastPickupdate", "DaysOfARVRefill"],
    "prev_quarter_pickup": ["patient_id", "PEPID", "Pharmacy_LastPickupdate_PreviousQuarter"],
    "regimen_at_start": ["patient_id", "PEPID", "RegimenLineAtARTStart", "RegimenAtARTStart", "CurrentRegimenLine",
                         "CurrentARTRegimen", "DSD_Model", "DSD_Model_Type", "CurrentPregnancyStatus"],
    "latest_viral_load": ["patient_id", "PEPID", "CurrentViralLoad", "DateofCurrentViralLoad",
                          "DateResultReceivedFacility", "Alphanumeric_Viral_Load_Result", "LastDateOfSampleCollection",
                          "ViralLoadIndication", "CurrentCD4", "CurrentCD4Date", "AHD_Indication",
                          "Current_CD4_LFA_Result", "Other_Test_(TB-LAM_LF-LAM_etc)", "Serology_for_CrAg_Result",
                          "CSF_for_CrAg_Result"],
    "treatment_outcome": ["patient_id", "PEPID", "Outcomes", "Outcomes_Date", "Cause_of_Death", "VA_Cause_of_Death",
                          "CurrentARTStatus"],
    "refill_due_dates": ["patient_id", "PEPID", "IIT_Date", "CurrentARTStatus_Pharmacy"],
    "prev_quarter_status": ["patient_id", "PEPID", "ARTStatus_PreviousQuarter"],
    "transfer_in_flag": ["patient_id", "PEPID", "TransferredIn", "Date_Transfered_In"],
    "latest_vitals": ["patient_id", "PEPID", "Educationallevel", "MaritalStatus", "JobStatus", "Weight", "Height",
                      "BMI", "BP", "Whostage", "DateofFirstTLD_Pickup"],
    "next_appointment": ["patient_id", "PEPID", "EstimatedNextAppointmentPharmacy", "Next_Ap_by_careCard",
                         "Days_To_Schedule"],
    "tb_screening": ["patient_id", "PEPID", *TB_COLUMNS],
    "obs_pivot": ["patient_id", "PEPID", "First_TPT_Pickupdate", "Last_TPT_Pickupdate", "Current_TPT_Received",
                  "TPT_Outcomes", "Date_of_TPT_Outcome", "Current_TB_Status", "DateofCurrent_TBStatus",
                  "TB_Treatment_Start_Date", "TB_Treatment_Stop_Date", "Date_Enrolled_Into_OTZ",
                  "Date_Enrolled_Into_OTZ_Plus", "Positive_living", "Treatment_Literacy", "Adolescents_participation",
                  "Leadership_training", "Peer_To_Peer_Mentoship", "Role_of_OTZ", "OTZ_Champion_Oreintation",
                  "Transitioned_Adult_Clinic", "OTZ_Outcome", "OTZ_Outcome_Date"],
    "biometric_status": ["patient_id", "PEPID", "PBS_Capturee", "PBS_Capture_Date", "PBS_Recapture",
                         "PBS_Recapture_Date", "PBS_Recapture_Count", "Date_Generated"],
}


def line_list_sections(spark: SparkSession, t: ClinicalTables, params: LineListParams,
                       sections: list[str]) -> dict[str, DataFrame]:
    """Several report sections from one observation pass: the per-patient answers are
    computed once and checkpointed (reliably, in ``spark.checkpoint.dir``); every section
    then reads them and only redoes the small per-patient joins."""
    from dataclasses import replace
    unknown = [s for s in sections if s not in SECTIONS]
    if unknown:
        raise ValueError(f"unknown sections: {unknown}")
    full = line_list(spark, t, replace(params, checkpoint_answers=True))
    return {s: full.select(*[_c(c) for c in SECTIONS[s]]) for s in sections}
