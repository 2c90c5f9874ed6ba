"""Sources, gates and small options: each component that no other query runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.bands import domain_rank
from bizlens.functions.textual import name_similarity
from bizlens.operators import quality
from bizlens.plans import measures, ml, scorecard
from bizlens.registry.base_sql import sql
from bizlens.registry.common import q
from bizlens.registry.scoring import LEAD_SQL, REGISTRY, _leads
from bizlens.session import scratch_path
from bizlens.sources import readers, sinks
from bizlens.sources.readers import inline_table
from bizlens.sources.warehouse import Warehouse

DEALS = T.StructType().add("deal_key", "long").add("company_key", "long").add("created_date", "date").add("is_won", "integer")
REGION = T.StructType().add("r_regionkey", "integer").add("r_name", "string")


def _written_star(w: Warehouse) -> str:
    folder = scratch_path(w.spark, "star")
    sinks.write_table(w.deals().select(*DEALS.names), f"{folder}/deals.csv", fmt="csv")
    sinks.write_table(w.table("region").select(*REGION.names), f"{folder}/regions.csv", fmt="csv")
    return folder


def _strict(w: Warehouse) -> DataFrame:
    deals = readers.read_table(w.spark, f"{_written_star(w)}/deals.csv", DEALS, strict=True)
    return deals.groupBy("is_won").agg(F.count(F.lit(1)).alias("deals"), F.min("created_date").alias("first_day"))


def _star_load(w: Warehouse) -> DataFrame:
    """Every table of a folder by its contract, also as named views; row counts by table."""
    star = readers.load_star(w.spark, _written_star(w), {"deals": DEALS, "regions": REGION}, views=True)
    counts = [w.spark.table(name).agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name)) for name in star]
    return reduce(DataFrame.unionByName, counts).select("table_name", "n")


def _contract(w: Warehouse) -> DataFrame:
    """A contract that the customer table breaks in three ways: a missing, an extra and a mistyped column."""
    kept = [f for f in w.table("customer").schema if f.name != "c_name"]
    wanted = T.StructType([T.StructField(f.name, T.StringType() if f.name == "c_mktsegment" else f.dataType) for f in kept]).add("c_since", "date")
    typed = T.StructType([T.StructField(f.name, T.DateType() if f.name == "c_mktsegment" else f.dataType) for f in wanted])
    found = quality.check_schema(w.table("customer"), typed)
    rows = w.table("customer").agg(F.count(F.lit(1)).alias("rows_checked"))
    return found.select("column_name", "problem").withColumn("rows_checked", rows.scalar())


def _metrics_sink(w: Warehouse) -> DataFrame:
    path = scratch_path(w.spark, "metrics")
    deals = w.deals()
    sinks.write_metrics(quality.metric_rows({"deals": (deals, F.count(F.lit(1))), "won": (deals, F.sum("is_won"))}), path)
    return w.spark.read.schema("metric string, value double").json(path)


def _by_header(w: Warehouse) -> DataFrame:
    odd = w.deals().select(F.col("is_won").alias(" Won? "), F.col("company_key").alias("Company ID"), F.col("deal_key").alias("Deal"))
    named = readers.rename_by_header(odd, {"deal_key": ["Deal"], "company_key": ["company id"], "is_won": ["won?"]})
    return named.groupBy("company_key").agg(F.count("deal_key").alias("deals"), F.sum("is_won").alias("won"))


def _scores_to_master(w: Warehouse) -> DataFrame:
    """Every company with its score; the share of companies that has none keeps NULL."""
    scores = w.deals().groupBy("company_key").agg(F.round(F.avg(F.col("is_won").cast("double")), 6).alias("prob"))
    return ml.attach_scores(w.company().select("company_key", "industry"), scores.filter("company_key % 3 <> 0"), key="company_key")


def _domain_order(w: Warehouse) -> DataFrame:
    bands = ["1-5", "6-20", "21-50", "51-200", "201-500"]
    return w.company().groupBy("employee_band").agg(F.count(F.lit(1)).alias("companies")).withColumn("position", domain_rank("employee_band", bands))


def _name_distance(w: Warehouse) -> DataFrame:
    nations = w.table("nation").select("n_nationkey", "n_name")
    return w.company().select("company_key", "company_name", "country").join(nations, F.col("country") == F.col("n_name")).select(
        "company_key", F.round(name_similarity(F.lower("n_name"), F.lower("company_name")), 6).alias("similarity"))


def _routed(w: Warehouse) -> DataFrame:
    path = scratch_path(w.spark, "routes")
    scorecard.route(_leads(w), path)
    return w.spark.read.parquet(path).groupBy(F.col("action").cast("string").alias("action"), "band").agg(F.count(F.lit(1)).alias("companies"))


def _anchors(w: Warehouse) -> DataFrame:
    """Known values per industry, one of which does not hold."""
    got = w.company().groupBy("industry").agg(F.countDistinct("region").cast("double").alias("regions"))
    known = inline_table(w.spark, [("BUILDING", 5.0), ("FURNITURE", 99.0)], "industry string, regions double")
    return quality.assert_anchors(got, known, "industry").select("industry", "field")


def _guard(w: Warehouse) -> DataFrame:
    """Required measures that the registry lacks, with the number of deals they were asked for."""
    missing = measures.guard(REGISTRY, ["deals", "win_rate", "made_up_measure"])
    return w.deals().agg(F.count(F.lit(1)).alias("deals")).withColumn("missing", F.lit(",".join(missing)))


QUERIES = {
    "csv_strict": (q(_strict), sql("deals", "SELECT is_won, count(*) AS deals, min(created_date) AS first_day FROM deals GROUP BY 1")),
    "star_load_views": (q(_star_load), sql("deals", "SELECT 'deals' AS table_name, count(*) AS n FROM deals UNION ALL SELECT 'regions', count(*) FROM region")),
    "schema_contract": (q(_contract), """
        SELECT column_name, problem, (SELECT count(*) FROM customer) AS rows_checked FROM (VALUES ('c_since', 'missing'), ('c_name', 'extra'), ('c_mktsegment', 'type')) AS v(column_name, problem)"""),
    "metrics_sink": (q(_metrics_sink), sql("deals", "SELECT 'deals' AS metric, CAST(count(*) AS DOUBLE) AS value FROM deals UNION ALL SELECT 'won', CAST(sum(is_won) AS DOUBLE) FROM deals")),
    "columns_by_header": (q(_by_header), sql("deals", "SELECT company_key, count(*) AS deals, sum(is_won)::BIGINT AS won FROM deals GROUP BY 1")),
    "scores_to_master": (q(_scores_to_master), sql("deals company", """
        , s AS (SELECT company_key, round(avg(CAST(is_won AS DOUBLE)), 6) AS prob FROM deals WHERE company_key % 3 <> 0 GROUP BY 1)
        SELECT c.company_key, industry, prob FROM company c LEFT JOIN s ON s.company_key = c.company_key""".strip())),
    "domain_order": (q(_domain_order), sql("company", """
        SELECT employee_band, count(*) AS companies, CAST(CASE employee_band WHEN '1-5' THEN 0 WHEN '6-20' THEN 1 WHEN '21-50' THEN 2 WHEN '51-200' THEN 3 WHEN '201-500' THEN 4 ELSE 5 END AS INTEGER) AS position
        FROM company GROUP BY ALL""")),
    "name_distance": (q(_name_distance), sql("company", """
        SELECT company_key, round(1.0::DOUBLE - CAST(levenshtein(lower(country), lower(company_name)) AS DOUBLE) / greatest(length(country), length(company_name)), 6) AS similarity FROM company""")),
    "routed_leads": (q(_routed), sql("meetings company", LEAD_SQL.lstrip() + """
        SELECT CASE band {actions} END AS action, band, count(*) AS companies FROM banded GROUP BY ALL""".format(
            actions=" ".join(f"WHEN '{b}' THEN '{a}'" for b, a in scorecard.ACTIONS.items())))),
    "anchor_gate": (q(_anchors), sql("company", """
        , g AS (SELECT industry, CAST(count(DISTINCT region) AS DOUBLE) AS regions FROM company GROUP BY 1)
        SELECT a.industry, 'regions' AS field FROM (VALUES ('BUILDING', 5.0), ('FURNITURE', 99.0)) AS a(industry, regions) LEFT JOIN g USING (industry)
        WHERE g.regions IS NULL OR abs(g.regions - a.regions) >= 0.01""".strip())),
    "measure_guard": (q(_guard), sql("deals", "SELECT count(*) AS deals, 'made_up_measure' AS missing FROM deals")),
}
