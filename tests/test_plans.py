"""What the physical plans must show: partial work before shuffles, pruned scans, no all-pairs joins."""
import pytest
from pyspark.sql import functions as F

from cohortry.operators import cleaning as C
from cohortry.operators import eda
from cohortry.operators import features as FE
from cohortry.operators import profiles as PR
from cohortry.operators import reporting as R
from cohortry.plans.registry import clustered
from cohortry.sources import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clients(spark):
    return clustered(spark, SF)


def test_keep_first_limits_before_the_shuffle(spark):
    text = plan(C.keep_first(V.ledger_text(spark, SF), "listing_id", ["line_order"]))
    shuffle = text.index("Exchange hashpartitioning")
    assert text.index("row_number(), 1, Final") < shuffle < text.index("row_number(), 1, Partial")


def test_purchases_reduce_before_the_shuffle(spark):
    text = plan(FE.aggregate_purchases(V.ledger(spark, SF)))
    assert "partial_stddev_samp" in text and "partial_sum" in text


def test_reports_read_only_their_columns(clients):
    text = plan(clients.groupBy("region").agg(F.sum("total_investment")))
    assert "ReadSchema: struct<region:string,total_investment:double>" in text


def test_filters_reach_the_scan(clients):
    text = plan(R.filtered(clients, {"country": ["NATION_1"], "loan_applied": ["No"]}).select("client_id"))
    assert "EqualTo(country,NATION_1)" in text and "EqualTo(loan_applied,No)" in text


def test_no_all_pairs_joins(clients):
    segmented, described = PR.attach_segments(clients)
    for df in (segmented, described, R.capital_shares(segmented), eda.box_statistics(segmented, "age", "segment"),
               PR.relative_profile(PR.build_profile(clients), clients), FE.label_encode(clients)):
        assert "CartesianProduct" not in plan(df) and "NestedLoopJoin" not in plan(df)


def test_one_client_with_a_third_of_the_rows(spark):
    rows = spark.range(30_000).selectExpr(
        "id listing_id", "if(id % 3 = 0, 0, 1 + id % 500) client_ref", "'Sold' listing_status",
        "date_add(date '2024-01-01', cast(id % 200 as int)) transaction_date", "'Office' unit_category",
        "id % 5000 tower_number", "cast(id % 7 as double) floor_area_sqft", "cast(id as double) sale_price",
        "1.0D price_per_sqft")
    hot = FE.aggregate_purchases(rows).filter("client_id = 0").first()
    assert (hot["total_properties"], hot["unique_towers"], hot["active_months"]) == (10_000, 5_000, 200)
