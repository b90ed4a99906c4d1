from datetime import date

from pyspark.sql import functions as F

from cellframe.functions import scalar as S


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_msisdn(spark):
    got = one(spark, ["9161234567", "8 (916) 123-45-67", "+7 916 123 45 67", "123456", "", None, "8123456789", "12345678901234567"], S.msisdn)
    assert got == ["79161234567", "79161234567", "79161234567", None, None, None, "78123456789", None]


def test_other_identifiers(spark):
    assert one(spark, ["25001123456789", "250-01-1234567890", "123", None], S.imsi) == ["25001123456789", "250011234567890", None, None]
    assert one(spark, ["25002123456789", "20801123456789", "2"], S.operator_of_imsi) == [2, None, None]
    assert one(spark, ["3512345", "35123456-1"], S.tac_of_imei) == [None, "35123456"]
    assert one(spark, ["7", "0123456789", "x", None], lambda c: S.last_digits(c, 8)) == ["00000007", "23456789", None, None]
    assert one(spark, ["99999999999999999999", "1234567890"], lambda c: S.digits_to_long(c, 10)) == [None, 1234567890]
    assert one(spark, [" ах ", "ru"], S.latin_code) == ["AX", "RU"]


def test_dates(spark):
    assert one(spark, ["05.03.2021", "7/9/2020", "2019-01-02", "soon", None], S.flexible_date) == ["2021-03-05", "2020-09-07", "2019-01-02", None, None]
    assert one(spark, ["20240101000459", "2024010100045", "20241301000000", None], lambda c: S.event_time(c).cast("string")) == ["2024-01-01 00:04:59", None, None, None]
    assert one(spark, ["2024-01-01 00:04:59.999999", "2024-01-01 00:05:00"], lambda c: S.floor_to(c.cast("timestamp_ntz")).cast("string")) == ["2024-01-01 00:00:00", "2024-01-01 00:05:00"]
    assert one(spark, [date(2000, 1, 1), date(2030, 1, 1), date(1880, 1, 1), None], lambda c: S.age_at(c, F.lit(date(2024, 1, 1))), "date") == ["24", "U", "U", "U"]
    assert one(spark, ["x+03:00", "xZ", "x-0530"], S.iso_offset_minutes) == [180, 0, -330]


def test_radio_and_geography(spark):
    assert one(spark, [190.0, -190.0, 10.0, None], S.wrap_longitude, "double") == [-170.0, 170.0, 10.0, None]
    assert one(spark, [-1.0, 400.0, None], S.azimuth, "double") == [359.0, 40.0, 0.0]
    assert one(spark, [None, 0.5, -90.0, 400.0], S.sector_angle, "double") == [120.0, 120.0, 90.0, 359.0]
    assert one(spark, ["metro hall", "Indoor out/ind", "out/ind.", "pico", None], lambda c: S.site_type(c, F.lit(None), F.lit(None))) == ["m", "i", "x", "f", "o"]
    row = spark.range(1).select(S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), S.geohash(F.lit(57.64911), F.lit(10.40744), 9).alias("g"), S.median_tilt(F.lit("-4"), F.lit(None), F.lit("10")).alias("t"), S.median_tilt(F.lit("x"), F.lit("500")).alias("u")).first()
    assert abs(row.d - 111194.93) < 0.1 and row.g == "u4pruydqq" and row.t == 7.0 and row.u == 8.0
    r = spark.range(1).select(S.reach_m(F.lit(5.0), F.lit(42.0), F.lit(35.0), F.lit(8.0), F.lit("o"), F.lit(1.0)).alias("o"), S.reach_m(F.lit(0.1), F.lit(6.0), F.lit(7.0), F.lit(8.0), F.lit("i"), F.lit(1.0)).alias("i")).first()
    assert 4250 < r.o < 6500 and 80 <= r.i <= 900


def test_classifiers(spark):
    people = [("Иванова", "Анна", "Ивановна", "ОВД", ""), ("Smith", "John", None, "", "German passport"), ("Каримов", "Олег", "Оглы", None, None), (None, None, None, None, None), ("X", "Y", "", "embassy of China", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "i int, last string, first string, second string, office string, paper string")
    c = S.citizenship("office", "paper", "first", "second", "last", {"RU": "643", "DE": "276"}, [("germany", "276")])
    got = df.select("i", S.gender("first", "second").alias("g"), c.alias("c"), S.bio_key("last", "first", "second", F.lit(date(2000, 1, 1)), F.lit("40 1")).alias("b")).orderBy("i").collect()
    assert [r.g for r in got] == ["F", "M", "M", "U", "M"]
    assert [r.c for r in got] == ["643", "276", "643", "U", "U"]
    assert got[0].b == "bio:иванова|анна|ивановна|2000-01-01|401" and got[3].b is None
    assert one(spark, ["", "k"], S.person_id)[0] == "prs_unknown" and one(spark, ["k"], S.person_id)[0].startswith("prs_")
    assert one(spark, [0.0, 1.0, 5.0, 6.0, 21.0, None], S.count_bucket, "double") == [None, *"1 2-5 6-20 >20".split(), None]
    assert one(spark, ["yes", "0", "maybe", " ", None], S.boolean_text) == ["true", "false", "<other>", None, None]
