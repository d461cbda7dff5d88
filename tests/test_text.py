"""Hand examples of the schedule texts."""

import datetime as dt

from pyspark.sql import functions as F

from crowdtide.functions import text


def frame(spark, values, column="v"):
    return spark.createDataFrame([(i, v, 2026) for i, v in enumerate(values)], f"i INT, {column} STRING, year INT")


def test_weekday_sets(spark):
    labels = ["Mon-Fri", "Fri - Mon", "Saturday & Sunday", "Daily", "Weekends", "Holiday", "Tues/Thurs"]
    df = frame(spark, labels).withColumn("t", text.schedule_text(F.col("v")))
    wide = [r.d for r in df.select("i", text.parse_weekday_set(F.col("t")).alias("d")).orderBy("i").collect()]
    assert wide == [[0, 1, 2, 3, 4], [0, 4, 5, 6], [5, 6], list(range(7)), [5, 6], None, [1, 3]]
    strict = [r.d for r in df.select("i", text.parse_weekday_set(F.col("t"), "strict").alias("d")).orderBy("i").collect()]
    assert strict[:3] == [None, None, [5, 6]] and strict[6] is None


def test_date_ranges(spark):
    d = dt.date
    labels = ["Dec 20 - Jan 5", "Mar 3 - 9", "2026-01-02", "12/24", "Monday", "Feb 30", "Jan 20 – Jan 22, 2027", "Closed Mar 3", "1/2/27 - 1/4/27"]
    df = text.with_date_range(frame(spark, labels), "v", "year", "r").orderBy("i").collect()
    got = [None if r.r is None else (r.r.start, r.r.end, r.r.span) for r in df]
    assert got[:6] == [(d(2026, 12, 20), d(2027, 1, 5), 17), (d(2026, 3, 3), d(2026, 3, 9), 7), (d(2026, 1, 2), d(2026, 1, 2), 1), (d(2026, 12, 24), d(2026, 12, 24), 1), None, None]
    assert got[6] == (d(2026, 1, 20), d(2027, 1, 22), 368)
    assert got[7] is None and got[8] == (d(2027, 1, 2), d(2027, 1, 4), 3)
    strict = text.with_date_range(frame(spark, labels), "v", "year", "r", "strict").orderBy("i").collect()
    assert strict[3].r is None and strict[1].r.span == 7


def test_hours_windows(spark):
    hours = ["6am - 11pm", "10:30 a.m. - noon", "5pm - midnight", "8pm - 2am", "CLOSED", "24 hours", "TBD", "8am to 8pm", "25pm - 3am", "12am - 12pm"]
    df = text.with_hours_window(frame(spark, hours), "v", "w").orderBy("i").collect()
    got = [None if r.w is None else tuple(r.w) for r in df]
    assert got == [
        (360, 1380, False), (630, 720, False), (1020, 1440, False), (1200, 1560, False), (0, 0, True), (0, 1440, False), None,
        (480, 1200, False), None, (0, 720, False),
    ]
    strict = text.with_hours_window(frame(spark, hours), "v", "w", "strict").orderBy("i").collect()
    assert strict[7].w is None and strict[0].w is not None


def test_keys_and_titles(spark):
    row = frame(spark, ["🏀 Basketball_Courts "]).select(
        text.title_key(F.col("v")).alias("a"), text.canonical_section(F.lit(" Whole  GYM")).alias("b"), text.underscored_key(F.lit(" Fitness  Floors")).alias("c"),
        text.is_facility_wide(F.lit("Pool Hours")).alias("d"), text.is_facility_wide(F.lit("Pool maintenance closures")).alias("e"), text.is_facility_wide(F.lit("Seasonal Notice")).alias("f"),
    ).first()
    assert tuple(row) == ("basketball courts", "overall", "fitness_floors", False, True, False)


def test_references_equal_the_standard_library(spark):
    import html

    from crowdtide.functions.markup import unescaped

    texts = ["a &amp; b", "&nbsp;x", "&#8209;&#xA0;&#x1F600;", "&notit; &notin; &copy2 &ampx &unknown; &", "&#0; &#55555; &#99999999999; &#128; &#x80;&#150", "&NotEqualTilde; &fjlig;", "&&amp;&amp", "&#x;&#;"]
    rows = frame(spark, texts).select("i", unescaped(F.col("v")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: html.unescape(t) for i, t in enumerate(texts)}
