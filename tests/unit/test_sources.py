import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from bizlens.sources import calendar, readers, revenue, schemas, sinks
from tests.conftest import rows


def put(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_keeps_literal_tokens_and_codes(spark, tmp_path):
    put(tmp_path, "companies.csv", "cvr,company_name,company_form,industry_nace,region,founded_year,employee_band,vat_frequency,has_subsidiaries,uses_target_software\n"
        "1,NA,ApS,01130,North,1999,1-4,Monthly,true,false\n")
    got = readers.read_table(spark, str(tmp_path / "companies.csv"), schemas.COMPANIES_LABELLED).first()
    assert (got["company_name"], got["industry_nace"], got["has_subsidiaries"]) == ("NA", "01130", True)


def test_csv_coercion_and_unset_keys(spark, tmp_path):
    put(tmp_path, "fact_meetings.csv", "meeting_key,deal_key,company_key,rep_key,meeting_date_key,meeting_status,no_show_flag,days_from_create,days_to_close\n"
        "M1,D1,C1,R1,20240105,Held,0,,12\nM2,D2,C2,R2,0,Cancelled,1,x,\n")
    got = readers.read_table(spark, str(tmp_path / "fact_meetings.csv"), schemas.FACT_MEETINGS, coerce=["days_from_create", "days_to_close"], date_keys=["meeting_date_key"])
    assert rows(got, "meeting_key", "meeting_date_key", "days_from_create", "days_to_close") == [("M1", 20240105, None, 12), ("M2", None, None, None)]
    assert [f.dataType for f in got.schema] == [f.dataType for f in schemas.FACT_MEETINGS]


def test_strict_read_fails_on_a_bad_row(spark, tmp_path):
    put(tmp_path, "stock.csv", "product_key,as_of_date,qty_1000,source\nA,2024-01-01,not-a-number,sheet\n")
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "stock.csv"), schemas.STOCK_ON_HAND, strict=True).collect()


def test_load_star_registers_views(spark, tmp_path):
    put(tmp_path, "dim_source.csv", "source_key,source_name,channel\nS1,Cold,Out\n")
    put(tmp_path, "dim_stage.csv", "stage_key,stage_name,stage_order,funnel_step\nST1,Lead,1,top\n")
    star = readers.load_star(spark, str(tmp_path), {k: schemas.OUTBOUND_STAR[k] for k in ("dim_source", "dim_stage")}, views=True)
    assert set(star) == {"dim_source", "dim_stage"} and spark.table("dim_stage").first()["stage_order"] == 1


def test_header_aliases(make):
    df = make([(1, 2, 3)], "`Artikel Nr` int, other int, Bestand int")
    assert rows(readers.rename_by_header(df, {"product_key": ["artikel nr"], "qty": ["stock", "bestand"]})) == [(1, 3)]
    with pytest.raises(ValueError):
        readers.rename_by_header(df, {"price": ["preis"]})


def test_inline_table(spark):
    assert rows(readers.inline_table(spark, [("a", 1), ("b", None)], "k string, v int")) == [("a", 1), ("b", None)]


def test_calendar(spark):
    d = calendar.dim_date(spark, "2024-01-01", "2024-12-31")
    assert d.count() == 366
    r = d.filter("date_key = 20240106").first()
    assert (r["day_of_week"], r["is_business_day"], r["month_name"], r["quarter"], r["week_of_year"]) == ("Saturday", False, "January", 1, 1)


def test_upsert_replaces_and_adds(make):
    base, delta = make([("a", 1), ("b", 2)], "k string, v int"), make([("b", 9), ("c", 3)], "k string, v int")
    assert rows(sinks.upsert(base, delta, ["k"])) == [("a", 1), ("b", 9), ("c", 3)]


def test_ingest_is_idempotent(make):
    df = make([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, t string")
    first = sinks.ingest_unique(df, ["t"], "id")
    assert rows(first, "id") == [(1,), (3,), (4,)]
    assert sinks.ingest_unique(df, ["t"], "id", first).count() == 0


def test_snapshots_accumulate(spark, make, tmp_path):
    path = str(tmp_path / "plan")
    plan = make([("A", "24/25", 5.0, 1.0, 0.0, 4.0, -4.0, "red")], "product_key string, sales_year string, expected_sales double, stock_on_hand double, incoming double, production_need double, ending_stock double, status string")
    sinks.commit_snapshot(plan, path, "ann", dt.date(2024, 1, 1))
    sinks.commit_snapshot(plan.withColumn("production_need", F.lit(0.0)), path, as_of=dt.date(2024, 2, 1))
    got = sinks.read_snapshots(spark, path)
    assert rows(got, "snapshot_date", "action", "committed_by") == [(dt.date(2024, 1, 1), "produce now", "ann"), (dt.date(2024, 2, 1), "watch", "system")]
    assert got.select("snapshot_id").distinct().count() == 2


def test_refresh_twice_changes_nothing(spark, make, tmp_path):
    path = str(tmp_path / "t")
    df = make([("2024", 1), ("2025", 2)], "y string, v int")
    sinks.refresh(df, path, ["y"])
    sinks.refresh(df.filter("y = '2025'"), path, ["y"])
    assert spark.read.parquet(path).count() == 2
    sinks.refresh(df.filter("y = '2025'"), str(tmp_path / "whole"))
    sinks.write_table(df, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_metrics_sink(make, tmp_path):
    sinks.write_metrics(make([("auc", 0.75)], "metric string, value double"), str(tmp_path / "m"))
    name = next(f for f in os.listdir(tmp_path / "m") if f.endswith(".json"))
    assert json.loads(open(tmp_path / "m" / name).read()) == {"metric": "auc", "value": 0.75}


def test_revenue_fact_rules(make):
    staging = make([("seed", "Paid", 100.0, 40.0), ("license", "open", 50.0, 9.0), ("odd", "paid", 10.0, 1.0)], "kind string, payment_state string, amount_expected double, cost double")
    rules = revenue.RevenueRules({"Product": ["seed"], "Licence": ["license"]}, columns={"kind": "line_class"})
    got = revenue.build_revenue_fact(staging, rules)
    assert rows(got, "bucket_key", "is_core", F.col("amount_confirmed").cast("double"), F.col("cost").cast("double")) == [
        ("Licence", False, 0.0, 0.0), ("Other", False, 10.0, 0.0), ("Product", True, 100.0, 40.0)]


def test_ingest_keeps_one_of_repeated_rows(make):
    from bizlens.sources.sinks import ingest_unique

    df = make([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "c"), (None, "d")], "id int, text string")
    assert sorted(((r["id"], r["text"]) for r in ingest_unique(df, ["text"], "id").collect()), key=repr) == sorted([(1, "a"), (3, "b"), (3, "c"), (None, "d")], key=repr)
