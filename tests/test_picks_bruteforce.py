"""The spec engine against a brute-force evaluation of the same rules on random small tables."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from carelens.operators.picks import PickPlan, PickSpec, best_per_spec, best_values, double_order, pivot, plan_candidates
from carelens.sources.tables import tables_from_rows

BASE = dt.datetime(2024, 1, 1)
CUT = BASE + dt.timedelta(days=6)
SPECS = [
    PickSpec("latest_ties", (100,), keep_ties=True),
    PickSpec("latest_t11", (100,), encounter_type=11),
    PickSpec("first_named", (200,), descending=False, named_only=True),
    PickSpec("any_200", (200,), cutoff_on=None, order_on="obs_id", descending=False),
    PickSpec("enc_form27", (100, 200), form_id=27, cutoff_on="encounter_datetime", order_on="encounter_datetime",
             coded_in=(1, 3)),
]
NAMES = {1: "one", 2: "two"}

enc_st = st.lists(st.tuples(st.sampled_from([11, 13]), st.sampled_from([27, 13]), st.integers(0, 9),
                            st.sampled_from([0, 0, 1])), min_size=1, max_size=6)
obs_st = st.lists(st.tuples(st.integers(1, 3), st.integers(-1, 5), st.sampled_from([100, 200]), st.integers(0, 9),
                            st.sampled_from([1, 2, 3]), st.integers(0, 50), st.sampled_from([0, 0, 0, 1])),
                  min_size=1, max_size=40)


def brute(encs, obs):
    enc = {i: e for i, e in enumerate(encs) if e[3] == 0}  # non-voided encounters only
    out = {}
    for p in {o[0] for o in obs}:
        rows = []
        for i, (pid, eid, concept, day, coded, num, voided) in enumerate(obs):
            if pid != p or voided:
                continue
            e = enc.get(eid)
            rows.append(dict(obs_id=i, concept=concept, t=BASE + dt.timedelta(days=day), coded=coded, num=float(num),
                             etype=e[0] if e else None, form=e[1] if e else None,
                             et=BASE + dt.timedelta(days=e[2], hours=1) if e else None))
        res = {}
        for s in SPECS:
            c = [r for r in rows if r["concept"] in s.concepts]
            if s.encounter_type is not None:
                c = [r for r in c if r["etype"] == s.encounter_type]
            if s.form_id is not None:
                c = [r for r in c if r["form"] == s.form_id]
            if s.cutoff_on == "obs_datetime":
                c = [r for r in c if r["t"] <= CUT]
            elif s.cutoff_on == "encounter_datetime":
                c = [r for r in c if r["et"] is not None and r["et"] <= CUT]
            if s.coded_in:
                c = [r for r in c if r["coded"] in s.coded_in]
            if s.named_only:
                c = [r for r in c if r["coded"] in NAMES]
            if not c:
                res[s.key] = None
                continue
            if s.order_on == "obs_id":
                res[s.key] = min(c, key=lambda r: r["obs_id"])["num"]
                continue
            col = {"obs_datetime": "t", "encounter_datetime": "et"}[s.order_on]
            best_t = max(r[col] for r in c) if s.descending else min(r[col] for r in c)
            tied = [r for r in c if r[col] == best_t]
            if s.keep_ties:
                res[s.key] = max(r["num"] for r in tied)
            else:
                pick = max(tied, key=lambda r: r["obs_id"]) if s.descending else min(tied, key=lambda r: r["obs_id"])
                res[s.key] = pick["num"]
        if any(v is not None for v in res.values()):
            out[p] = res
    return out


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(enc_st, obs_st)
def test_engine_matches_brute_force(spark, encs, obs):
    t = tables_from_rows(
        spark,
        encounter=[(i, 1, None, e[0], e[1], 1, 8, BASE + dt.timedelta(days=e[2], hours=1), BASE, e[3])
                   for i, e in enumerate(encs)],
        obs=[(i, o[0], (o[1] if o[1] >= 0 else None), o[2], BASE + dt.timedelta(days=o[3]), o[4], float(o[5]), None,
              None, o[6]) for i, o in enumerate(obs)],
        concept_name=[(k, v, "en", 1) for k, v in NAMES.items()] + [(3, "trois", "fr", 1)],
    )
    plan = PickPlan(SPECS)
    cands = plan_candidates(spark, t.obs, t.encounter, t.concept_name, plan, {"end": CUT})
    best = best_per_spec(cands, ["value_numeric"], tie_columns=["value_numeric"])
    got = {r["person_id"]: {s.key: r[s.key] for s in SPECS}
           for r in pivot(best, {s.key: plan.value(s.key, "value_numeric") for s in SPECS}).collect()}
    assert got == brute(encs, obs)
    # the packed form gives the same values
    reads = [(s.key, "value_numeric") for s in SPECS] + [(s.key, "value_coded") for s in SPECS if not s.keep_ties]
    tall = best_values(cands, plan, reads, {"value_coded": "value_coded"}, {"value_numeric": "value_numeric"}).collect()
    packed = {}
    for r in tall:
        if r["read_idx"] < len(SPECS):
            packed.setdefault(r["person_id"], {s.key: None for s in SPECS})[reads[r["read_idx"]][0]] = r["d"]
        else:
            assert r["v"] in (1, 2, 3) and r["d"] is None
    assert packed == got


def test_numbers_order_like_doubles(spark):
    import math
    import random
    draw = random.Random(1)
    values = [0.0, 5e-324, 2.2250738585072014e-308, 1.0, 1.5, 2.0, math.nextafter(2, 3), math.nextafter(2, 1), 0.1, 1e300, 1.7976931348623157e308,
              math.inf, 3.0, 1e-300, 2.0 ** 52, 2.0 ** 53 + 2] + [draw.uniform(0, 1) * 10.0 ** draw.randint(-300, 300) for _ in range(300)]
    values = sorted({v for x in values for v in (x, -x)})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").selectExpr("i", f"{double_order('x')} AS o").orderBy("i").collect()
    orders = [r["o"] for r in rows]
    assert all(a < b for a, b in zip(orders, orders[1:]))
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").selectExpr(f"{double_order('x')} AS o").collect()
    assert odd[0]["o"] > max(orders) and odd[1]["o"] is None


def test_names_are_numbered_in_order(spark):
    from carelens.operators.dictionary import ranked_names
    names = ["", "a", "aa", "ab", "b", "Ab", "é", "Zz", "ab c", "\U0001F642", "a"]
    cn = spark.createDataFrame([(i, n, "en", 1) for i, n in enumerate(names)] + [(99, None, "en", 1)],
                               "concept_id long, name string, locale string, locale_preferred int")
    rows = sorted(ranked_names(cn).collect(), key=lambda r: r["name_rank"])
    assert [r["name"] for r in rows] == sorted(names, key=str.encode) and len({r["name_rank"] for r in rows}) == len(names)


def test_tall_answers_are_made_in_one_pass(spark):
    """Tied and repeated rows stay, rows without a person or after the cutoff do not count; observations are read once."""
    from carelens.operators.picks import pick
    at = lambda day, hour=0: dt.datetime(2020, 1, day, hour)
    cols = "obs_id long, person_id long, encounter_id long, concept_id long, obs_datetime timestamp_ntz, value_coded long, " \
           "value_numeric double, value_text string, value_datetime timestamp_ntz, voided int"
    rows = [(1, 1, None, 7, at(1), None, 1.0, "a", None, 0), (2, 1, None, 7, at(2), None, 2.0, "b", None, 0),
            (3, 1, None, 7, at(2), None, 3.0, "c", None, 0), (3, 1, None, 7, at(2), None, 3.0, "c", None, 0),
            (4, 1, None, 7, at(9), None, 4.0, "late", None, 0), (5, None, None, 7, at(2), None, 5.0, "nobody", None, 0),
            (6, 2, None, 7, None, None, 6.0, "no time", None, 0), (7, 3, None, 8, at(9), None, 7.0, "any time", None, 0)]
    obs = spark.createDataFrame(rows, cols)
    encounter = spark.createDataFrame([], "encounter_id long, encounter_type int, form_id int, encounter_datetime timestamp_ntz, voided int")
    names = spark.createDataFrame([], "concept_id long, name string, locale string, locale_preferred int")
    plan = PickPlan([PickSpec("ties", (7,), keep_ties=True), PickSpec("one", (7,)), PickSpec("first", (7,), descending=False),
                     PickSpec("open", (8,), cutoff_on=None), PickSpec("open_too", (7,), cutoff_on=None)])
    assert plan.last_times({"end": at(5)}) == {}
    tall = pick(spark, obs, encounter, names, plan, {"end": at(5)}, carried=["obs_id", "value_text"])
    want = [(1, 0, 2, "b"), (1, 0, 3, "c"), (1, 0, 3, "c"), (1, 1, 3, "c"), (1, 1, 3, "c"), (1, 2, 1, "a"), (1, 4, 4, "late"),
            (2, 4, 6, "no time"), (3, 3, 7, "any time")]
    assert tall._jdf.queryExecution().executedPlan().toString().count("ExistingRDD[obs_id") == 1
    assert sorted(map(tuple, tall.collect())) == want
    closed = PickPlan([PickSpec("ties", (7,), keep_ties=True), PickSpec("open", (8,), cutoff_on=None)])
    assert closed.last_times({"end": at(5)}) == {7: at(5)}
    tall = pick(spark, obs, encounter, names, closed, {"end": at(5)}, carried=["obs_id", "value_text"])
    assert sorted(map(tuple, tall.collect())) == [*want[:3], (3, 1, 7, "any time")]
