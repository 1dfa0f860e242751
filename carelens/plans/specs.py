"""The questions the comprehensive line list asks of ``obs``, as data.

Adding or changing a report column that reads one observation is an edit to this table,
not new join code.
"""

from __future__ import annotations

from carelens.operators.picks import PickPlan, PickSpec

# ---------------------------------------------------------------------------
# Fixed values (concept, encounter-type, form and answer codes of the report).
# ---------------------------------------------------------------------------
# Concepts whose latest rows (all ties kept) form the report's "latest set"; a patient
# needs at least one of them on or before the report day to be listed.
LATEST_SET = (159599, 165708, 159368, 164506, 164513, 164507, 164514, 165702, 165703, 165050,
              856, 164980, 165470, 160540, 165242, 164852, 166096, 165727, 1659, 1113, 159431, 5096)
# Concepts that are read from the latest set but are outside it, so they stay empty
# unless extended concepts are requested (TPT outcome, its date, OTZ plus enrolment).
EXTENDED_LATEST = (166007, 166008, 166350)
# Concepts whose first rows (ties kept) give the regimen at ART start.
REGIMEN_LINE = 165708
REGIMEN_CONCEPTS = (164506, 164513, 164507, 164514, 165702, 165703)
# Social and clinical "one row per concept" block: latest row per concept.
VITALS = (5356, 5089, 5085, 5086, 1542, 1054, 1712)
# Adolescent programme block: first row per concept.
OTZ = (166256, 166257, 166258, 166259, 166260, 166255, 166267, 166272, 166275, 166008)

ENC_LAB, ENC_VITALS, ENC_PHARMACY, ENC_CARE_CARD, ENC_CLIENT_TRACKING, ENC_TB_SCREEN, ENC_ART_START = 11, 12, 13, 14, 15, 23, 25
FORM_CARE_CARD_GATE, FORM_PHARMACY, FORM_TRACKING, FORM_PHARMACY_OUTCOME, FORM_CARE_CARD = 23, 27, 30, 13, 14

KP_TYPES = (160578, 166285, 166286, 166287, 162277)
DSD_MODELS = (166276, 166363)
TLD_REGIMENS = (165681, 165682, 165691, 165692)
TPT_RECEIVED_ANSWER = 1679
TRANSFERRED_OUT_ANSWER = 159492
PREV_QUARTER_PICKUP = 162240
OUTCOME = 165470
REFILL_DAYS = 159368
CARE_ENTRY_POINT = 165839
CARE_ENTRY_OTHER_TEXT = 165966
LTFU_GRACE_DAYS = 29

# Care entry point answers and their labels (answer 5622 reads free text instead).
CARE_ENTRY_LABELS = (
    (160529, "TB"), (160546, "STI"), (5271, "FP"), (160542, "OPD"), (161629, "Ward"),
    (165788, "Blood Bank"), (160545, "Outreach"), (165838, "Standalone HTS"), (160539, "VCT"), (165512, "PMTCT"),
)
CARE_ENTRY_OTHER = 5622

# Vitals and social columns (concept -> output) and OTZ columns.
VITALS_NAMES = (("Educationallevel", 1712), ("MaritalStatus", 1054), ("JobStatus", 1542), ("Whostage", 5356))
OTZ_COLUMNS = (
    ("Positive_living", 166256), ("Treatment_Literacy", 166257), ("Adolescents_participation", 166258),
    ("Leadership_training", 166259), ("Peer_To_Peer_Mentoship", 166260), ("Role_of_OTZ", 166255),
    ("OTZ_Champion_Oreintation", 166267), ("Transitioned_Adult_Clinic", 166272), ("OTZ_Outcome", 166275),
)
# TB screening answers read as names.
TB_NAMED = (
    ("Are_you_coughing_currently", 143264), ("Do_you_have_fever", 140238),
    ("History_of_contacts_with_TB_patients", 165967), ("Sputum_AFB_Result", 165968),
    ("GeneXpert_Result", 165975), ("Chest_Xray_Result", 165972), ("Culture_Result", 165969),
    ("Is_Patient_Eligible_For_IPT", 165986),
)
# TB screening answers read as 1 -> Yes, 2 -> No, otherwise ''.
TB_YES_NO = (("Are_you_losing_weight", 832), ("Are_you_having_night_sweats", 133027))
# TB screening answers read as 1 -> Yes, otherwise ''.
TB_YES = (("Sputum_AFB", 166141), ("GeneXpert", 166142), ("Chest_Xray", 166143), ("Culture", 166144))
# Advanced disease answers (lab encounter, latest by encounter time, names).
AHD_COLUMNS = (
    ("AHD_Indication", 167079), ("Current_CD4_LFA_Result", 167088), ("Other_Test_(TB-LAM_LF-LAM_etc)", 166697),
    ("Serology_for_CrAg_Result", 167090), ("CSF_for_CrAg_Result", 167082),
)


def line_list_plan(extended_concepts: bool = False, keep: frozenset[str] | None = None) -> PickPlan:
    """All questions of the line list, or only those whose keys are in ``keep``."""
    specs = _all_specs(extended_concepts)
    if keep is None:
        return PickPlan(specs)
    unknown = keep - {s.key for s in specs}
    if unknown:
        raise KeyError(f"no such questions: {sorted(unknown)}")
    return PickPlan([s for s in specs if s.key in keep])


LATEST_KEYS = tuple(f"L{c}" for c in LATEST_SET)
PICKUP_KEYS = ("L165708", "L159368")
# The questions each report section reads.
SECTION_SPECS: dict[str, frozenset[str]] = {k: frozenset(v) for k, v in {
    "site_config_attach": (), "patient_demographics": (), "address_fallback": (), "biometric_status": (),
    "refill_due_dates": PICKUP_KEYS, "last_pickup": PICKUP_KEYS, "next_appointment": (*PICKUP_KEYS, "L5096"),
    "care_entry_point": ("care_entry",), "age_bands": ("art_start",),
    "first_event_date": ("art_start", "hiv_confirmed"), "prev_quarter_pickup": ("prevq_pickup",),
    "regimen_at_start": (f"F{REGIMEN_LINE}", *(f"F{c}" for c in REGIMEN_CONCEPTS), "L165708", "L165050",
                         "current_regimen", "dsd_model", "dsd_model_type"),
    "latest_viral_load": ("viral_load", "viral_load_date", "vl_result_received", "vl_alphanumeric", "sample_collection",
                          "L164980", "cd4", *(f"ahd_{c}" for _, c in AHD_COLUMNS)),
    "treatment_outcome": (*LATEST_KEYS, "outcome_date", "cause_of_death", "va_166349", "va_166348", "va_166347"),
    "prev_quarter_status": ("prevq_pickup", "prevq_outcome"),
    "transfer_in_flag": ("L160540", "L165242", "transfer_in_date"),
    "latest_vitals": (*(f"V{c}" for _, c in VITALS_NAMES), "V5085", "V5086", "weight", "height", "bmi", "first_tld"),
    "tb_screening": tuple(f"tb_{c}" for _, c in TB_NAMED + TB_YES_NO + TB_YES),
    "obs_pivot": ("L164852", "L166096", "L165727", "L1659", "L1113", "L159431", *(f"O{c}" for c in OTZ)),
}.items()}
# Asked in addition where extended concepts are requested.
EXTENDED_SECTION_SPECS = {"obs_pivot": frozenset(f"L{c}" for c in EXTENDED_LATEST)}


def _all_specs(extended_concepts: bool) -> list[PickSpec]:
    S = PickSpec
    specs: list[PickSpec] = []
    latest = LATEST_SET + (EXTENDED_LATEST if extended_concepts else ())
    for c in latest:
        specs.append(S(f"L{c}", (c,), keep_ties=True))
    for c in (REGIMEN_LINE, *REGIMEN_CONCEPTS):
        specs.append(S(f"F{c}", (c,), descending=False, keep_ties=True))
    for c in VITALS:
        specs.append(S(f"V{c}", (c,)))
    for c in OTZ:
        specs.append(S(f"O{c}", (c,), descending=False))
    # name / value lookups against encounters (the correlated subqueries of the report)
    specs += [
        S("kp_type", (166369,), ENC_CARE_CARD, coded_in=KP_TYPES, named_only=True),
        S("art_start", (159599,), ENC_ART_START, cutoff_on="value_datetime", order_on="obs_id", descending=False),
        S("hiv_confirmed", (160554,), ENC_CARE_CARD, cutoff_on="value_datetime", order_on="obs_id", descending=False),
        S("current_regimen", REGIMEN_CONCEPTS, ENC_PHARMACY, named_only=True),
        S("dsd_model", (166148,), ENC_PHARMACY, coded_in=DSD_MODELS, named_only=True),
        S("dsd_model_type", DSD_MODELS, ENC_PHARMACY, named_only=True),
        S("viral_load", (856,), ENC_LAB, cutoff_on="encounter_datetime"),
        S("viral_load_date", (856,), ENC_LAB, cutoff_on="encounter_datetime", order_on="encounter_datetime"),
        S("vl_result_received", (165987,), ENC_LAB, cutoff_on="encounter_datetime", order_on="value_datetime"),
        S("vl_alphanumeric", (166422,), ENC_LAB, cutoff_on="encounter_datetime", order_on="encounter_datetime",
          named_only=True),
        S("sample_collection", (159951,)),
        S("outcome_date", (165469,), ENC_CLIENT_TRACKING, cutoff_on=None, order_on="obs_id", descending=False),
        S("cause_of_death", (165889,), ENC_CLIENT_TRACKING, cutoff_on="encounter_datetime",
          order_on="encounter_datetime", named_only=True),
        S("va_166349", (166349,), ENC_CLIENT_TRACKING, cutoff_on=None, order_on="encounter_datetime", named_only=True),
        S("va_166348", (166348,), ENC_CLIENT_TRACKING, cutoff_on=None, order_on="encounter_datetime", named_only=True),
        S("va_166347", (166347,), ENC_CLIENT_TRACKING, cutoff_on=None, order_on="encounter_datetime", named_only=True),
        S("transfer_in_date", (160534,), ENC_CARE_CARD, cutoff_on=None, order_on="obs_id", descending=False),
        S("weight", (5089,), ENC_VITALS),
        S("height", (5090,), ENC_VITALS),
        S("bmi", (1342,), ENC_VITALS),
        S("first_tld", (164506, 164507), ENC_PHARMACY, coded_in=TLD_REGIMENS, descending=False),
        S("cd4", (5497,), ENC_LAB, cutoff_on=None, order_on="encounter_datetime"),
        S("care_entry", (CARE_ENTRY_POINT,), cutoff_on=None, order_on="obs_id", descending=False),
        S("prevq_pickup", (PREV_QUARTER_PICKUP,), form_id=FORM_PHARMACY, cutoff="prev_quarter_end"),
        S("prevq_outcome", (OUTCOME,), form_id=FORM_PHARMACY_OUTCOME, cutoff="prev_quarter_day"),
    ]
    for name, c in AHD_COLUMNS:
        specs.append(S(f"ahd_{c}", (c,), ENC_LAB, cutoff_on="encounter_datetime", order_on="encounter_datetime",
                       named_only=True))
    for name, c in TB_NAMED:
        specs.append(S(f"tb_{c}", (c,), ENC_TB_SCREEN, cutoff_on=None, named_only=True))
    for name, c in TB_YES_NO + TB_YES:
        specs.append(S(f"tb_{c}", (c,), ENC_TB_SCREEN, cutoff_on=None))
    return specs
