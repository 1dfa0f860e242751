"""Fixed values of the report (concepts, encounter types, forms, answers, cutoffs), written out here
for the oracle and not taken from the library, so that a wrong code there shows."""

LATEST_SET = (159599, 165708, 159368, 164506, 164513, 164507, 164514, 165702, 165703, 165050, 856, 164980, 165470,
              160540, 165242, 164852, 166096, 165727, 1659, 1113, 159431, 5096)
REGIMEN_LINE = 165708
REGIMEN_CONCEPTS = (164506, 164513, 164507, 164514, 165702, 165703)
VITALS = (5356, 5089, 5085, 5086, 1542, 1054, 1712)
OTZ = (166256, 166257, 166258, 166259, 166260, 166255, 166267, 166272, 166275, 166008)
KP_TYPES = (160578, 166285, 166286, 166287, 162277)
DSD_MODELS = (166276, 166363)
TLD_REGIMENS = (165681, 165682, 165691, 165692)
TRANSFERRED_OUT_ANSWER = 159492
REFILL_DAYS = 159368
CARE_ENTRY_OTHER_TEXT = 165966
CARE_ENTRY_OTHER = 5622
CARE_ENTRY_LABELS = (
    (160529, "TB"), (160546, "STI"), (5271, "FP"), (160542, "OPD"), (161629, "Ward"), (165788, "Blood Bank"),
    (160545, "Outreach"), (165838, "Standalone HTS"), (160539, "VCT"), (165512, "PMTCT"),
)
OTZ_COLUMNS = (
    ("Positive_living", 166256), ("Treatment_Literacy", 166257), ("Adolescents_participation", 166258),
    ("Leadership_training", 166259), ("Peer_To_Peer_Mentoship", 166260), ("Role_of_OTZ", 166255),
    ("OTZ_Champion_Oreintation", 166267), ("Transitioned_Adult_Clinic", 166272), ("OTZ_Outcome", 166275),
)
TB_NAMED = (
    ("Are_you_coughing_currently", 143264), ("Do_you_have_fever", 140238), ("History_of_contacts_with_TB_patients", 165967),
    ("Sputum_AFB_Result", 165968), ("GeneXpert_Result", 165975), ("Chest_Xray_Result", 165972), ("Culture_Result", 165969),
    ("Is_Patient_Eligible_For_IPT", 165986),
)
TB_YES_NO = (("Are_you_losing_weight", 832), ("Are_you_having_night_sweats", 133027))
TB_YES = (("Sputum_AFB", 166141), ("GeneXpert", 166142), ("Chest_Xray", 166143), ("Culture", 166144))
AHD_COLUMNS = (
    ("AHD_Indication", 167079), ("Current_CD4_LFA_Result", 167088), ("Other_Test_(TB-LAM_LF-LAM_etc)", 166697),
    ("Serology_for_CrAg_Result", 167090), ("CSF_for_CrAg_Result", 167082),
)

# The report day of the registered queries with its previous quarter (end of day, then two midnights).
CUTOFFS = {"end": "1999-06-30 23:59:59.999999", "prev_quarter_day": "1999-03-30 00:00:00", "prev_quarter_end": "1999-03-31 00:00:00"}

OBS, ENC, VAL = "obs_datetime", "encounter_datetime", "value_datetime"
# Looked-up values as (key, concepts, condition, cutoff column, cutoff, order column, latest or first);
# an order by obs_id is "any row": the lowest id.
LOOKUPS = (
    ("kp_type", (166369,), "encounter_type = 14 AND value_coded IN (160578, 166285, 166286, 166287, 162277) AND name IS NOT NULL",
     OBS, "end", OBS, "DESC"),
    ("art_start", (159599,), "encounter_type = 25", VAL, "end", "obs_id", "ASC"),
    ("hiv_confirmed", (160554,), "encounter_type = 14", VAL, "end", "obs_id", "ASC"),
    ("current_regimen", REGIMEN_CONCEPTS, "encounter_type = 13 AND name IS NOT NULL", OBS, "end", OBS, "DESC"),
    ("dsd_model", (166148,), "encounter_type = 13 AND value_coded IN (166276, 166363) AND name IS NOT NULL", OBS, "end", OBS, "DESC"),
    ("dsd_model_type", (166276, 166363), "encounter_type = 13 AND name IS NOT NULL", OBS, "end", OBS, "DESC"),
    ("viral_load", (856,), "encounter_type = 11", ENC, "end", OBS, "DESC"),
    ("viral_load_date", (856,), "encounter_type = 11", ENC, "end", ENC, "DESC"),
    ("vl_result_received", (165987,), "encounter_type = 11", ENC, "end", VAL, "DESC"),
    ("vl_alphanumeric", (166422,), "encounter_type = 11 AND name IS NOT NULL", ENC, "end", ENC, "DESC"),
    ("sample_collection", (159951,), "true", OBS, "end", OBS, "DESC"),
    ("outcome_date", (165469,), "encounter_type = 15", None, None, "obs_id", "ASC"),
    ("cause_of_death", (165889,), "encounter_type = 15 AND name IS NOT NULL", ENC, "end", ENC, "DESC"),
    ("va_166349", (166349,), "encounter_type = 15 AND name IS NOT NULL", None, None, ENC, "DESC"),
    ("va_166348", (166348,), "encounter_type = 15 AND name IS NOT NULL", None, None, ENC, "DESC"),
    ("va_166347", (166347,), "encounter_type = 15 AND name IS NOT NULL", None, None, ENC, "DESC"),
    ("transfer_in_date", (160534,), "encounter_type = 14", None, None, "obs_id", "ASC"),
    ("weight", (5089,), "encounter_type = 12", OBS, "end", OBS, "DESC"),
    ("height", (5090,), "encounter_type = 12", OBS, "end", OBS, "DESC"),
    ("bmi", (1342,), "encounter_type = 12", OBS, "end", OBS, "DESC"),
    ("first_tld", (164506, 164507), "encounter_type = 13 AND value_coded IN (165681, 165682, 165691, 165692)", OBS, "end", OBS, "ASC"),
    ("cd4", (5497,), "encounter_type = 11", None, None, ENC, "DESC"),
    ("care_entry", (165839,), "true", None, None, "obs_id", "ASC"),
    ("prevq_pickup", (162240,), "form_id = 27", OBS, "prev_quarter_end", OBS, "DESC"),
    ("prevq_outcome", (165470,), "form_id = 13", OBS, "prev_quarter_day", OBS, "DESC"),
    *((f"ahd_{c}", (c,), "encounter_type = 11 AND name IS NOT NULL", ENC, "end", ENC, "DESC") for _, c in AHD_COLUMNS),
    *((f"tb_{c}", (c,), "encounter_type = 23 AND name IS NOT NULL", None, None, OBS, "DESC") for _, c in TB_NAMED),
    *((f"tb_{c}", (c,), "encounter_type = 23", None, None, OBS, "DESC") for _, c in TB_YES_NO + TB_YES),
)
