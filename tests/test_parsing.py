import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.functions import bands, display
from cohortry.functions import parsing as P
from cohortry.operators.profiles import percent_rank_average
from cohortry.operators.reporting import iso3


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("c"))).collect()]


def test_currency(spark):
    texts = ["$300,385.62", "(300)", "1-2", "1.2.3", "", "-5", "300.385,62", None]
    assert apply(spark, texts, P.currency) == [300385.62, 300.0, None, None, None, -5.0, 300.38562, None]


def test_mixed_dates(spark):
    texts = ["5/23/1990", "05-03-1990", "23-05-1990", "1990-05-23", "bad", None, "2/30/1990", "13/13/1990"]
    day = dt.date(1990, 5, 23)
    assert apply(spark, texts, P.mixed_date) == [day, dt.date(1990, 5, 3), day, day, None, None, None, None]


def test_day_first_reading(spark):
    texts = ["5/23/1990", "05-03-1990", "1990-05-23"]
    got = apply(spark, texts, lambda c: P.mixed_date(c, day_first=True))
    assert got == [dt.date(1990, 5, 23), dt.date(1990, 3, 5), dt.date(1990, 5, 23)]


def test_fixed_dates(spark):
    got = apply(spark, ["5-1-2024", "05-01-2024", "05/01/2024", "13-01-2024"], P.month_first_date)
    assert got == [dt.date(2024, 5, 1)] * 2 + [None, None]


def test_ambiguous_dates(spark):
    got = apply(spark, ["05-03-1990", "5/3/1990", "23-05-1990", "a-b-c", None], P.ambiguous_date)
    assert got == [True, False, False, False, False]


@pytest.mark.parametrize("born, age", [("2000-06-15", 24), ("2000-06-16", 23), ("2000-02-29", 24)])
def test_age_counts_birthdays(spark, born, age):
    got = apply(spark, [born], lambda c: P.age_on(c.cast("date"), dt.date(2024, 6, 15)))
    assert got == [age]


def test_numbers(spark):
    assert apply(spark, ["3", " 4 ", "3.0", "3.5", "x", "1d", "nan", None], P.to_whole) == [
        3, 4, 3, None, None, None, None, None]


def test_labels(spark):
    texts = ["  New   York ", "Oslo", "a\t b", None]
    assert apply(spark, texts, P.tidy_label) == ["New York", "Oslo", "a b", None]
    assert apply(spark, texts, P.label_changed) == [True, False, True, False]


def test_flags_and_keys(spark):
    assert apply(spark, ["YES", "yes", "No", None], lambda c: P.label_flag(c, "yes")) == [1, 1, 0, 0]
    assert apply(spark, ["", " ", "nan", "None", " C1 ", None], P.key_or_null) == [None] * 4 + ["C1", None]
    assert apply(spark, ["NA", "n/a", "", "Nada"], P.null_tokens) == [None, None, None, "Nada"]


def test_masks_and_components(spark):
    assert apply(spark, ["5/23/1990"], P.format_mask) == ["9/99/9999"]
    assert apply(spark, ["05-03-1990", "x"], lambda c: P.date_component(c, 1)) == [3, None]


def test_age_bands(spark):
    assert apply(spark, [0, 34, 35, 200, 201], bands.age_band, "int") == [None, "<35", "35-44", "65+", None]
    assert apply(spark, [0, 34, 35, 200, 201], bands.age_band_order, "int") == [None, 0, 1, 4, None]


def test_money_texts(spark):
    values = [2520750960.84, 1260375.48, 347089.9, 12.4, -1500.0, 0.0]
    assert apply(spark, values, display.money_short, "double") == ["$2.5B", "$1.3M", "$347K", "$12", "$-2K", "$0"]
    assert apply(spark, values[:2], lambda c: display.money_short(c, 2, True), "double") == ["$2.52B", "$1.26M"]
    assert apply(spark, [0.2537], display.percent_text, "double") == ["25.4%"]
    assert apply(spark, [2.0403], display.times_text, "double") == ["2.04x"]


def test_percent_rank(spark):
    rows = spark.createDataFrame([(10,), (20,), (20,), (30,)], "x int")
    got = sorted(r[0] for r in rows.select(percent_rank_average("x")).collect())
    assert got == [0.25, 0.625, 0.625, 1.0]


def test_country_codes(spark):
    assert apply(spark, ["UK", "USA", "Atlantis", None], iso3) == ["GBR", "USA", None, None]


def test_large_ids_and_tabbed_names(spark):
    df = spark.createDataFrame([("9007199254740993", "\tAnn ", "Lee\t"), (" 12.0", "B", "C"), ("1.5", "", "")], "a string, f string, l string")
    got = df.select(P.to_whole(F.col("a")).alias("w"), P.full_name(F.col("f"), F.col("l")).alias("n")).collect()
    assert [(r.w, r.n) for r in got] == [(9007199254740993, "Ann Lee"), (12, "B C"), (None, " ")]


def test_dates_with_the_year_first_or_a_month_name(spark):
    texts = ["1990/05/03", "1990-05-03 10:20:30", "1990-05-03T10:20:30.5Z", "3 May 1990", "03-may-1990", "May 3, 1990",
             "3 March 1990", "SEPT 30 1990", "3 Mayor 1990", "1990-05/03", "31 June 1990", "1990-13-01"]
    third, march = dt.date(1990, 5, 3), dt.date(1990, 3, 3)
    assert apply(spark, texts, P.mixed_date) == [third] * 6 + [march, dt.date(1990, 9, 30), None, None, None, None]
