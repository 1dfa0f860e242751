import datetime as dt

from pyspark.sql import functions as F

from carelens.functions.dates import (
    add_whole_days, minus_months_py, outcome_status, quarter_end, quarter_end_py, whole_months, whole_years,
)
from carelens.functions.text import non_empty, number_text, text_is


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_quarter_end_e6(spark):
    for day, want in [(dt.date(2024, 1, 15), dt.date(2024, 3, 31)), (dt.date(2024, 5, 31), dt.date(2024, 6, 30)),
                      (dt.date(2024, 8, 11), dt.date(2024, 9, 30)), (dt.date(2024, 12, 25), dt.date(2024, 12, 31))]:
        assert one(spark, quarter_end(F.lit(day))) == want
        assert quarter_end_py(day) == want


def test_quarter_end_matches_python_for_two_years(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(731)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", quarter_end(F.col("d")).alias("q"))
    got = {r["d"]: r["q"] for r in df.collect()}
    assert all(got[d] == quarter_end_py(d) for d in days)


def test_minus_months_clamps_month_end():
    assert minus_months_py(dt.date(2024, 5, 31), 3) == dt.date(2024, 2, 29)
    assert minus_months_py(dt.date(2024, 12, 25), 3) == dt.date(2024, 9, 25)
    assert minus_months_py(dt.date(2024, 1, 31), 3) == dt.date(2023, 10, 31)


def test_whole_years_e10(spark):
    born = F.lit(dt.date(2020, 2, 29))
    assert one(spark, whole_years(born, F.lit(dt.datetime(2021, 2, 28)))) == 0
    assert one(spark, whole_years(born, F.lit(dt.datetime(2024, 2, 29)))) == 4
    assert one(spark, whole_months(born, F.lit(dt.datetime(2020, 3, 28)))) == 0
    assert one(spark, whole_months(born, F.lit(dt.datetime(2020, 3, 29)))) == 1


def test_outcome_status_inclusive_e8_and_null_q6(spark):
    end = dt.date(2024, 9, 30)
    # pickup + 30 + 29 = end -> Active (inclusive)
    pickup = end - dt.timedelta(days=59)
    assert one(spark, outcome_status(F.lit(pickup), F.lit(30.0), 29, F.lit(end))) == "Active"
    assert one(spark, outcome_status(F.lit(pickup - dt.timedelta(days=1)), F.lit(30.0), 29, F.lit(end))) == "LTFU"
    assert one(spark, outcome_status(F.lit(None).cast("date"), F.lit(30.0), 29, F.lit(end))) == "LTFU"
    assert one(spark, outcome_status(F.lit(pickup), F.lit(None).cast("double"), 29, F.lit(end))) == "LTFU"


def test_add_whole_days_rounds(spark):
    assert one(spark, add_whole_days(F.lit(dt.date(2024, 1, 1)), F.lit(30.5))) == dt.date(2024, 2, 1)
    assert one(spark, add_whole_days(F.lit(dt.date(2024, 1, 1)), F.lit(None).cast("double"))) is None


def test_text_rules_q17_f7(spark):
    assert one(spark, text_is(F.lit("TRANSFER IN "), "Transfer in")) is True
    assert one(spark, text_is(F.lit(None).cast("string"), "Transfer in")) is False
    assert one(spark, non_empty(F.lit(""))) is False
    assert one(spark, non_empty(F.lit("  "))) is False
    assert one(spark, non_empty(F.lit(None).cast("string"))) is False
    assert one(spark, non_empty(F.lit("x"))) is True


def test_number_text_e17(spark):
    assert one(spark, number_text(F.lit(120.0))) == "120"
    assert one(spark, number_text(F.lit(120.5))) == "120.5"


def test_parse_report_date_x3(spark):
    from carelens.functions.dates import parse_report_date
    assert one(spark, parse_report_date(F.lit("31/01/2020"))) == dt.date(2020, 1, 31)
    assert one(spark, parse_report_date(F.lit("01-Dec-2024"), "dd-MMM-yyyy")) == dt.date(2024, 12, 1)
    assert one(spark, parse_report_date(F.lit("not a date"))) is None
