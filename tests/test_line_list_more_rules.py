"""More report rules on hand rows: orderings, missing cutoffs, coded filters, precedence."""

import pytest

from carelens.plans.line_list import LineListParams, line_list
from tests.clinical import D, T, Rows

END = D(2024, 12, 25)
TODAY = D(2025, 1, 1)


def build():
    r = Rows()
    for code, name in ((160578, "FSW"), (170099, "Not a KP"), (166276, "Community"), (166363, "Facility"),
                       (170050, "Routine"), (170060, "High"), (170070, "Low"), (170080, "Positive"),
                       (170090, "Outcome X")):
        r.name(code, name)

    def listed(pid):
        r.patient(pid)
        e = r.encounter(pid, 13, 13, T(2024, 1, 5))
        r.obs(pid, 165050, T(2024, 1, 5), e, coded=1)

    # Q15: value ordered by obs time, date is the latest encounter time
    listed(1)
    e_old_obs = r.encounter(1, 11, 13, T(2024, 6, 1))          # later encounter, older obs time
    r.obs(1, 856, T(2024, 3, 1), e_old_obs, num=1000.0)
    e_new_obs = r.encounter(1, 11, 13, T(2024, 5, 1))          # earlier encounter, newer obs time
    r.obs(1, 856, T(2024, 4, 1), e_new_obs, num=20.0)
    # Q13: CD4 and TB answers have no cutoff; viral load does
    e_after = r.encounter(1, 11, 13, T(2025, 2, 1))
    r.obs(1, 5497, T(2025, 2, 1), e_after, num=350.0)
    r.obs(1, 856, T(2025, 2, 1), e_after, num=5.0)
    e_tb = r.encounter(1, 23, 13, T(2025, 3, 1))
    r.obs(1, 832, T(2025, 3, 1), e_tb, coded=1)
    # sample collection: no encounter needed, value date shown
    r.obs(1, 159951, T(2024, 2, 2), None, vdt=T(2024, 2, 1))
    # KP type: only listed answers count; DSD model and type
    listed(2)
    ek = r.encounter(2, 14, 14, T(2024, 2, 1))
    r.obs(2, 166369, T(2024, 2, 1), ek, coded=160578)
    r.obs(2, 166369, T(2024, 3, 1), ek, coded=170099)           # newer, but not a KP answer
    ed = r.encounter(2, 13, 13, T(2024, 2, 1))
    r.obs(2, 166148, T(2024, 2, 1), ed, coded=166276)
    r.obs(2, 166363, T(2024, 2, 1), ed, coded=170070)
    # Q14: free text of the care entry point counts even when that row is voided
    listed(3)
    ec = r.encounter(3, 14, 14, T(2024, 1, 1))
    r.obs(3, 165839, T(2024, 1, 1), ec, coded=5622)
    r.obs(3, 165966, T(2024, 1, 1), ec, text="Mosque", voided=1)
    # outcome name wins over the transferred-out answer; both in the latest set
    listed(4)
    eo = r.encounter(4, 15, 30, T(2024, 7, 1))
    r.obs(4, 165470, T(2024, 7, 1), eo, coded=170090)
    r.obs(4, 160540, T(2024, 7, 1), eo, coded=159492)
    # transferred-out answer on a latest-set row that is NOT at the latest time does not count
    listed(5)
    eo = r.encounter(5, 15, 30, T(2024, 7, 1))
    r.obs(5, 160540, T(2024, 6, 1), eo, coded=159492)
    r.obs(5, 160540, T(2024, 7, 1), eo, coded=170080)
    # pharmacy pickup needs form 27 and type 13, not voided, on or before the report day (whole day)
    listed(6)
    e = r.encounter(6, 13, 27, T(2024, 12, 25, 23, 0))
    r.obs(6, 165708, T(2024, 12, 25, 23, 0), e, coded=170050)
    r.encounter(6, 13, 27, T(2024, 12, 26, 1, 0))               # after the report day
    r.encounter(6, 13, 13, T(2024, 12, 20))                     # wrong form
    r.encounter(6, 13, 27, T(2024, 12, 24), voided=1)           # voided
    return r


@pytest.fixture(scope="module")
def ll(spark):
    t = build().tables(spark)
    return {row["patient_id"]: row.asDict() for row in
            line_list(spark, t, LineListParams(end=END, today=TODAY)).collect()}


def test_q15_value_by_obs_time_date_by_encounter_time(ll):
    assert ll[1]["CurrentViralLoad"] == 20.0
    assert ll[1]["DateofCurrentViralLoad"] == D(2024, 6, 1)


def test_q13_no_cutoff_columns(ll):
    assert ll[1]["CurrentCD4"] == 350.0 and ll[1]["CurrentCD4Date"] == D(2025, 2, 1)
    assert ll[1]["Are_you_losing_weight"] == "Yes"
    assert ll[1]["LastDateOfSampleCollection"] == D(2024, 2, 1)


def test_kp_type_and_dsd(ll):
    assert ll[2]["KPType"] == "FSW"
    assert ll[2]["DSD_Model"] == "Community" and ll[2]["DSD_Model_Type"] == "Low"


def test_q14_voided_free_text_counts(ll):
    assert ll[3]["CareEntryPoint"] == "Mosque"


def test_outcome_precedence(ll):
    assert ll[4]["Outcomes"] == "Outcome X"
    # without an outcome-date observation the report falls back to the last tracking form
    # whenever a latest-set row carries the "transferred out" answer, whatever the outcome name
    assert ll[4]["Outcomes_Date"] == D(2024, 7, 1)
    # an older "transferred out" row (not at the latest time) does not count
    assert ll[5]["Outcomes"] is None and ll[5]["Outcomes_Date"] is None


def test_pickup_rules(ll):
    r = ll[6]
    assert r["Pharmacy_LastPickupdate"] == D(2024, 12, 25)
    assert r["CurrentRegimenLine"] == "Routine"
