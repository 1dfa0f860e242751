"""A kept state brought forward equals the report made anew."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from carelens.plans import specs as S
from carelens.plans.as_of import STATE, advanced, report_state
from carelens.plans.line_list import LineListParams, line_list
from carelens.session import SHUFFLE_CLEANUP, stored
from carelens.sources.tables import ClinicalTables
from tests.clinical import D
from tests.test_line_list_rules import build


def test_an_advanced_state_gives_the_same_report(spark, tmp_path):
    t = build().tables(spark)
    loaded, changed = F.col("obs_id") % 3 == 1, F.col("person_id") % 4 == 0
    earlier = t.with_tables(obs=t.obs.filter(~loaded).withColumn("voided", F.when(changed, 1 - F.col("voided")).otherwise(F.col("voided"))))
    after = LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1))
    want = sorted(map(str, line_list(spark, t, after).collect()))
    for i, day in enumerate((D(2024, 12, 25), D(2024, 11, 1), D(2024, 9, 30))):  # the last one lies in the quarter before
        before = replace(after, end=day)
        path = str(tmp_path / str(i))
        report_state(spark, earlier, before).write.parquet(path)
        state = advanced(spark, spark.read.schema(STATE).parquet(path), t, before, after, t.obs.filter(loaded), t.obs.filter(changed))
        assert sorted(map(str, line_list(spark, t, after, state=state).collect())) == want, day
    with pytest.raises(ValueError):
        advanced(spark, state, t, after, before, t.obs, t.obs)


def _random_tables(seed):
    """Patients with rows of every concept, with late and missing times, repeated rows, voided ones and refills of other days."""
    import random
    from tests.clinical import Rows, T
    rnd = random.Random(seed)
    r = Rows()
    plan = S.line_list_plan()
    codes = [1, 2, 159492, 160578, 166285, 166276, 165681, 5622, 170001]
    for c in codes[:-1]:
        r.name(c, f"name {c % 7}")
    for pid in range(1, 25):
        r.patient(pid)

    def at():
        return rnd.choice([None] + [T(2024, m, d, rnd.randrange(24)) for m in range(6, 13) for d in (1, 15, 30)] + [T(2025, 2, 1)])

    for pid in range(1, 25):
        for _ in range(6):
            e = r.encounter(pid, rnd.choice([11, 12, 13, 14, 15, 23, 25]), rnd.choice([23, 27, 30, 13, 14]), at(), voided=int(rnd.random() < .1))
            for _ in range(8):
                c = rnd.choice(plan.concepts + [S.REFILL_DAYS, S.PREV_QUARTER_PICKUP] * 12)
                r.obs(rnd.choice([pid] * 9 + [1]), c, at(), rnd.choice([e, e, e, None]), coded=rnd.choice(codes), num=float(rnd.randrange(90)),
                      vdt=at(), voided=int(rnd.random() < .1))
                if rnd.random() < .05:
                    r.t["obs"].append(r.t["obs"][-1])
    return r


def test_an_advanced_state_is_the_state_made_anew(spark, tmp_path):
    """Every person, read column, value and key."""
    for seed, day in ((1, D(2024, 11, 20)), (2, D(2024, 8, 14))):
        t = _random_tables(seed).tables(spark)
        loaded, changed = F.col("obs_id") % 5 == 1, F.col("person_id") % 6 == 0
        earlier = t.with_tables(obs=t.obs.filter(~loaded).withColumn("voided", F.when(changed, 1 - F.col("voided")).otherwise(F.col("voided"))))
        after = LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1))
        before = replace(after, end=day)
        state = stored(report_state(spark, earlier, before), str(tmp_path / f"{seed}"))
        got = advanced(spark, state, t, before, after, t.obs.filter(loaded).select("obs_id"), t.obs.filter(changed).select("person_id"))
        want = report_state(spark, t, after)
        assert want.count() > 300
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), seed


def test_only_concerned_rows_are_read_for_an_advanced_state(spark, tmp_path):
    """Rows known before, and rows after the new report day, stay out; what is taken is stored, so no use of the state reads obs again."""
    from tests.clinical import Rows, T
    r = Rows()
    r.name(1, "Yes")
    for pid in range(1, 9):
        r.patient(pid)
        e = r.encounter(pid, 12, 14, T(2024, 1, 5))
        r.obs(pid, 5089, T(2024, 1, 5), e, num=50.0)  # known
        r.obs(pid, 5089, T(2025, 3, 1), e, num=51.0)  # after both days
        r.obs(pid, S.TB_NAMED[0][1], T(2025, 3, 1), r.encounter(pid, 23, 14, T(2025, 3, 1)), coded=1)  # asked without a cutoff, so known
    r.obs(2, 5089, T(2024, 12, 1), r.encounter(2, 12, 14, T(2024, 12, 1)), num=60.0)  # newly under the cutoff
    r.obs(3, 5089, T(2024, 2, 1), r.encounter(3, 12, 14, T(2024, 2, 1)), num=70.0, oid=7)  # loaded
    r.tables(spark).write_parquet(str(tmp_path / "tables"))
    t = ClinicalTables.read_parquet(spark, str(tmp_path / "tables"))
    before, after = (LineListParams(end=d, today=D(2025, 4, 1)) for d in (D(2024, 11, 20), D(2024, 12, 25)))
    state = stored(report_state(spark, t.with_tables(obs=t.obs.filter("obs_id != 7")), before), str(tmp_path / "state"))
    none = t.obs.filter("false")
    got = advanced(spark, state, t, before, after, t.obs.filter("obs_id = 7").select("obs_id"), none.select("person_id"))
    read = got.inputFiles()
    assert read and not any("/tables/" in f for f in read), read
    new = {f.rsplit("/", 1)[0] for f in read if "/new/" in f}
    assert len(new) == 1
    assert {x.person_id for x in spark.read.parquet(new.pop()).collect()} == {2, 3}
    weight = {x.person_id: x.d for x in got.collect() if x.d is not None}
    assert weight == {p: {2: 60.0, 3: 70.0}.get(p, 50.0) for p in range(1, 9)}


def test_a_stored_frame_leaves_no_shuffle_files(spark, tmp_path):
    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "shuffle_" in f}

    frame = spark.range(1000).selectExpr("id % 7 AS k", "id").join(spark.range(7).withColumnRenamed("id", "k"), "k").groupBy("k").count()
    was, old = spark.conf.get(SHUFFLE_CLEANUP), blocks()
    kept = stored(frame, str(tmp_path / "a"))
    for _ in range(50):
        if not blocks() - old:
            break
        time.sleep(0.2)
    assert not blocks() - old
    assert spark.conf.get(SHUFFLE_CLEANUP) == was
    assert sorted(kept.collect()) == sorted(frame.collect())
