import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizlens.functions import bands, dates, metrics, textual
from tests.conftest import rows


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_rate_is_null_on_zero_denominator(spark):
    assert one(spark, metrics.rate(F.lit(1), F.lit(0)), metrics.rate(F.lit(1), F.lit(8)), metrics.ratio(F.lit(None).cast("int"), F.lit(2))) == (None, 12.5, None)


def test_conditional_aggregates(make):
    df = make([("a", 1, 10.0), ("a", 0, 4.0), ("b", 0, 2.0)], "k string, f int, v double")
    got = df.groupBy("k").agg(metrics.sum_if("v", F.col("f") == 1).alias("s"), metrics.avg_if("v", F.col("f") == 0).alias("a"),
                              metrics.any_flag(F.col("f") == 1).alias("any"), metrics.count_if(F.col("f") == 1).alias("n"))
    assert rows(got) == [("a", 10.0, 4.0, 1, 1), ("b", None, 2.0, 0, 0)]


def test_percentile_interpolates_and_filters(make):
    df = make([("a", 1, 1), ("a", 2, 1), ("a", 3, 0), ("b", 7, 1), ("c", 5, 0), ("d", None, 1)], "k string, v int, w int")
    got = df.groupBy("k").agg(metrics.pctl("v", 0.5, F.col("w") == 1).alias("p"))
    assert rows(got) == [("a", 1.5), ("b", 7.0), ("c", None), ("d", None)]


def test_money_sum_does_not_depend_on_order(make):
    df = make([(0.1,)] * 10, "v double")
    assert df.agg(metrics.money_sum("v").alias("s")).first()[0] == 1.0


def test_bands_and_edges(make):
    df = make([(100,), (60,), (59,), (12,), (11,), (None,)], "v int")
    got = df.select("v", bands.band_when("v", [60, 12], ["hi", "mid", "lo"]).alias("b"))
    assert rows(got) == sorted([(100, "hi"), (60, "hi"), (59, "mid"), (12, "mid"), (11, "lo"), (None, None)], key=repr)
    with pytest.raises(ValueError):
        bands.band_when("v", [1], ["x"])


def test_rag_classify_and_notes(spark):
    assert one(spark, bands.rag(F.lit(9.9), 10, 20), bands.rag(F.lit(10.0), 10, 20), bands.rag(F.lit(20.0), 10, 20)) == ("red", "amber", "green")
    assert one(spark, bands.classify(F.lit(0.5)), bands.classify(F.lit(0.5), inclusive=False)) == (1, 0)
    assert one(spark, bands.small_n_note(F.lit(49)), bands.small_n_note(F.lit(50))) == ("small n - directional", "")


def test_domain_order_is_not_lexical(make):
    df = make([("51-200",), ("6-20",), ("1-5",), ("?",)], "b string")
    got = [r[0] for r in df.orderBy(bands.domain_rank("b", ["1-5", "6-20", "21-50", "51-200"])).collect()]
    assert got == ["1-5", "6-20", "51-200", "?"]


def test_unset_active_counts_as_active(make):
    assert rows(make([(True,), (False,), (None,)], "a boolean").filter(bands.active_or_unknown("a"))) == [(None,), (True,)]


def test_date_keys(spark):
    lo, hi = dt.date(2024, 1, 1), dt.date(2024, 12, 31)
    assert one(spark, dates.key_to_date(F.lit(0)), dates.key_to_date(F.lit(20240229)), dates.key_to_date(F.lit(20241399))) == (None, dt.date(2024, 2, 29), None)
    assert one(spark, dates.shift_key(F.lit(20240228), 2, lo, hi), dates.shift_key(F.lit(20241230), 9, lo, hi), dates.shift_key(F.lit(20240102), -9, lo, hi)) == (20240301, 20241231, 20240101)
    assert one(spark, dates.age_days(F.lit("2024-01-01").cast("date"), dt.date(2024, 1, 31)), dates.date_key(F.lit("2024-03-05").cast("date"))) == (30, 20240305)


def test_text_expressions(spark):
    assert one(spark, textual.is_junk_title(F.lit(" Home ")), textual.is_junk_title(F.lit("Home prices rise")), textual.is_junk_title(F.lit(""))) == (True, False, True)
    assert one(spark, textual.repair_mojibake(F.lit("cafÃ©")), textual.normalise_name(F.lit("Acme-Seeds B.V."))) == ("café", "acme seeds")
    assert one(spark, textual.relabel_language(F.lit("Новини"), F.lit("en")), textual.relabel_language(F.lit("News"), F.lit("en"))) == ("uk", "en")
    assert one(spark, textual.name_similarity(F.lit("abcd"), F.lit("abce")), textual.token_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == (0.75, 1 / 3)
    assert one(spark, textual.content_hash(F.lit(None).cast("string"))) != one(spark, textual.content_hash(F.lit("")))


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, textual.cosine(a, b), textual.cosine(a, zero))
    assert got[0] == pytest.approx(0.70710678) and got[1] is None


def test_keyword_search_takes_wildcards_literally(make):
    df = make([("100% pure",), ("1000 pure",)], "t string")
    assert rows(df.filter(textual.mentions_any(["t"], ["100%"]))) == [("100% pure",)]
