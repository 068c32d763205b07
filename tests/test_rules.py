"""Rules of a single row, from tables of cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.functions import score as X
from newsloom.functions import text as T
from newsloom.functions import time as D

VL, L, M, H, VH = vocab.LEVELS


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "axes,expected",
    [((H, H, M), vocab.NOTIFY), ((H, H, VL), vocab.NO_NOTIFY), ((H, M, M), vocab.NO_NOTIFY), ((H, None, H), vocab.NOTIFY), ((H, None, None), vocab.INSUFFICIENT), (("?", H, VH), vocab.NOTIFY), ((None, None, None), vocab.INSUFFICIENT)],
)
def test_decide(spark, axes, expected):
    assert one(spark, X.decide(*[F.lit(a).cast("string") for a in axes])).c0 == expected


def test_decide_equals_the_count_form_on_all_combinations(spark):
    levels = [None, *vocab.LEVELS]
    rows = [(a, b, c) for a in levels for b in levels for c in levels]
    for r in spark.createDataFrame(rows, "a string, b string, c string").withColumn("d", X.decide(F.col("a"), F.col("b"), F.col("c"))).collect():
        s = [vocab.LEVELS.index(x) + 1 for x in (r.a, r.b, r.c) if x]
        assert r.d == (vocab.INSUFFICIENT if len(s) < 2 else vocab.NO_NOTIFY if min(s) < 2 else vocab.NOTIFY if sum(x >= 4 for x in s) >= 2 else vocab.NO_NOTIFY)


@pytest.mark.parametrize("text,expected", [("ك", "ک"), ("١٢٣", "123"), ("۱۲۳", "123"), ("ة", "ه"), ("آ", "ا"), ("می‌رود", "میرود"), ("  A \n b ", "a b"), (None, "")])
def test_fold(spark, text, expected):
    assert one(spark, T.fold(F.lit(text).cast("string"))).c0 == expected


def test_fold_composes_when_asked(spark):
    assert one(spark, T.fold(F.lit("é"), compose=True)).c0 == "é"


def test_clean(spark):
    assert one(spark, T.clean(F.lit("&laquo;a&nbsp;b &amp; é\n‌"))).c0 == "«a b & é ‌"


def test_trigrams_and_jaccard(spark):
    r = one(spark, T.trigrams(F.lit("ab cd!")), T.trigrams(F.lit("ab")), T.trigrams(F.lit("")), T.jaccard(T.trigrams(F.lit("abcd")), T.trigrams(F.lit("bcde"))), T.jaccard(T.trigrams(F.lit("")), T.trigrams(F.lit("abc"))))
    assert sorted(r.c0) == ["abc", "bcd"] and r.c1 == ["ab"] and r.c2 == [] and r.c3 == pytest.approx(1 / 3) and r.c4 == 0


@pytest.mark.parametrize("day,expected", [(date(2024, 3, 20), "1403-01-01"), (date(2025, 3, 20), "1403-12-30"), (date(2025, 3, 21), "1404-01-01"), (date(2023, 3, 21), "1402-01-01"), (date(2017, 3, 21), "1396-01-01"), (date(1979, 2, 11), "1357-11-22"), (date(2000, 1, 1), "1378-10-11")])
def test_jalali(spark, day, expected):
    assert one(spark, D.jalali(F.lit(day))).c0 == expected


def test_jalali_words(spark):
    r = one(spark, D.jalali_words(F.lit("1403-01-05")), D.jalali_words(F.lit("soon")))
    assert (r.c0, r.c1) == ("5 فروردین 1403", "soon")


@pytest.mark.parametrize("minute,start,end,expected", [(60, 30, 90, True), (90, 30, 90, False), (10, 1380, 60, True), (1400, 1380, 60, True), (600, 1380, 60, False), (5, 5, 5, False)])
def test_quiet_hours(spark, minute, start, end, expected):
    assert one(spark, D.in_quiet_hours(F.lit(minute), F.lit(start), F.lit(end))).c0 is expected


@pytest.mark.parametrize("text,expected", [("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02 03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("soon", None), ("", None)])
def test_parse_iso(spark, text, expected):
    assert one(spark, D.parse_iso(F.lit(text)).cast("timestamp_ntz")).c0 == expected


@pytest.mark.parametrize(
    "title,text,url,expected",
    [("", "x" * 50, "https://a.b/c", "missing_title"), ("short", "x" * 50, "https://a.b/c", "title_too_short"), ("long enough title", "x", "https://a.b/c", "insufficient_text"), ("long enough title", "x" * 50, "javascript:x", "invalid_url"), ("long enough title", "x" * 50, "", "invalid_url"), ("long enough title", "x" * 50, "https://a.b/c", "")],
)
def test_quality(spark, title, text, url, expected):
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    r = one(spark, X.quality_flag(F.lit(title), F.lit(""), F.lit(text), F.lit(url), now, now), X.quality_flag(F.lit("long enough title"), F.lit("x" * 50), F.lit(None).cast("string"), F.lit("https://a.b"), now + F.make_dt_interval(days=F.lit(2)), now))
    assert r.c0 == expected and r.c1 == "published_in_future"


def test_bands_and_impact(spark):
    scores = [0, 19, 20, 39.9, 40, 60, 80, 100, None]
    got = [r.b for r in spark.createDataFrame([(None if s is None else float(s),) for s in scores], "s double").select(X.band(F.col("s")).alias("b")).collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5, 5, None]
    r = one(spark, X.impact(F.lit(50.0), F.lit(100.0)), X.impact(F.lit(None).cast("double"), F.lit(10.0)), X.impact(F.lit(10.0), F.lit(None).cast("double")), X.rank_score(F.lit(None).cast("double"), F.lit(100.0), F.lit(12.0)))
    assert tuple(r) == (70.0, 10.0, 10.0, 20.0)


@pytest.mark.parametrize("text,expected", [("timeout", "network"), ("HTTP 429", "rate_limit"), ("HTTP 503", "network"), ("HTTP 404", "gone"), ("HTTP 403", "blocked"), ("ValueError: x", "parse"), ("odd", "parse"), ("", ""), ("HTTP 451", "blocked"), ("RobotsBlocked: no", "blocked"), ("Fatal: key", "provider"), ("Gone: HTTP 404", "gone"), ("SSLError: x", "network"), ("the connection page", "parse")])
def test_error_class(spark, text, expected):
    assert one(spark, X.error_class(F.lit(text))).c0 == expected


def test_money_and_answers(spark):
    r = one(spark, X.price(F.lit("۱,۲۳۴.۵")), X.price(F.lit("n/a")), X.token_cost(F.lit(10), F.lit(10), F.lit(-1.0), F.lit(1.0)), X.stored_score(F.lit(5)), X.stored_score(F.lit(2.5)), X.toman(F.lit(123456.0)), X.direction_correct(F.lit("↑"), F.lit(0.2)), X.direction_correct(F.lit("خنثی"), F.lit(9.0)), X.matched(F.lit("a"), F.array(F.lit("a")), F.lit(1.1)))
    assert (float(r.c0), r.c1, r.c2, r.c3, r.c4, r.c5, r.c6, r.c7, r.c8) == (1234.5, None, None, None, 62, 12346.0, False, None, False)


def test_phones(spark):
    typed = ["09123456789", "9123456789", "+98 912 345 6789", "0098-912-3456789", "989123456789", "(0912) 345 67 89", "۰۹۱۲۳۴۵۶۷۸۹", "٠٩١٢٣٤٥٦٧٨٩", "0912345678", "08123456789", "", None, "+989123456789x", "+19123456789"]
    df = spark.createDataFrame(list(enumerate(typed)), "k int, raw string").select("k", T.phone(F.col("raw")).alias("p"))
    assert [r.p for r in df.orderBy("k").collect()] == ["+989123456789"] * 8 + [None] * 6
