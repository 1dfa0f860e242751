"""The distributed ordered scan equals a window, also when one group spans many partitions."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from carelens.operators.ordered import ordered_within


def test_matches_window_with_hot_group(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = 1 if i % 3 else rnd.randint(2, 40)          # group 1 holds two thirds of all rows
        t = dt.datetime(2020, 1, 1) + dt.timedelta(hours=rnd.randint(0, 500))
        t += dt.timedelta(microseconds=rnd.randrange(1_000_000))
        if i % 97 == 0:
            t = None
        if i % 101 == 0:
            t = dt.datetime(1019, 10, 30)                 # corrupt year must survive
        rows.append((i, g, t, rnd.choice([None, 5, 7]), dt.date(2021, 1, 1) + dt.timedelta(days=i % 30)))
    rows += [(99999 + i, None, dt.datetime(2020, 1, 1 + i), 1, None) for i in range(9)]  # NULL is a group of its own
    df = spark.createDataFrame(rows, "id long, g long, t timestamp_ntz, v int, d date")
    got = ordered_within(df, "g", ["t", "id"], "seq", {"t": "prev_t", "v": "prev_v", "d": "prev_d"}, partitions=7)
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "id")
    want = df.select("*", F.row_number().over(w).cast("long").alias("seq"),
                     F.lag("t").over(w).alias("prev_t"), F.lag("v").over(w).alias("prev_v"),
                     F.lag("d").over(w).alias("prev_d"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 50))), min_size=1, max_size=120),
       st.integers(1, 9))
def test_property_matches_window(spark, rows, parts):
    data = [(i, g, None if t is None else dt.datetime(2020, 1, 1) + dt.timedelta(days=t)) for i, (g, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g long, t timestamp_ntz")
    got = ordered_within(df, "g", ["t", "id"], "seq", {"t": "prev_t"}, partitions=parts)
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "id")
    want = df.select("*", F.row_number().over(w).cast("long").alias("seq"), F.lag("t").over(w).alias("prev_t"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_microsecond_gaps_and_missing_visits(spark):
    from carelens.operators.investigate import encounter_chronology
    rows = [(1, 7, dt.datetime(2020, 1, 1, 9, 0, 0, 123456)), (2, 7, dt.datetime(2020, 1, 1, 9, 0, 0, 123999)),
            (3, 7, dt.datetime(2020, 1, 1, 9, 0, 0, 124001)), (4, None, dt.datetime(2020, 1, 1)), (5, None, dt.datetime(2020, 1, 2))]
    e = spark.createDataFrame(rows, "encounter_id long, visit_id long, encounter_datetime timestamp_ntz").selectExpr(
        "*", "1 AS encounter_type", "1 AS form_id", "1 AS provider_id", "8 AS location_id", "0 AS voided")
    got = {r["encounter_id"]: (r["encounter_seq"], r["gap_micros"], r["encounter_datetime"]) for r in encounter_chronology(e).collect()}
    assert got == {1: (1, None, rows[0][2]), 2: (2, 543, rows[1][2]), 3: (3, 2, rows[2][2]), 4: (1, None, rows[3][2]),
                   5: (2, 86_400_000_000, rows[4][2])}
