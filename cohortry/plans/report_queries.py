"""The report queries over segmented clients."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.config import BOOK_COMPARISON, EXPLORER, SEGMENT_ORDER
from cohortry.operators import eda
from cohortry.operators import reporting as R
from cohortry.plans.registry import SEGMENTED, query, rnd, rounded, segmented

_ALL_BUT = [f"NATION_{i}" for i in range(25) if i not in (3, 7)]
CHOICES = {
    "country": _ALL_BUT,
    "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE"],
    "acquisition_purpose": ["Home", "Investment"],
    "client_type": ["Individual", "Company"],
    "segment": list(SEGMENT_ORDER[:3]),
    "loan_applied": ["No"],
    "referral_channel": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"],
}


def _list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_WHERE = " AND ".join(f"{c} IN {_list(v)}" for c, v in CHOICES.items())
_S = "WITH " + SEGMENTED
_VIEW = _S + f", view AS (SELECT * FROM segmented WHERE {_WHERE})"
_ORDERED = "ORDER BY CASE segment " + " ".join(
    f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENT_ORDER)) + " END"
_FOCUS = SEGMENT_ORDER[1]


def _view(spark, sf_dir):
    return R.filtered(segmented(spark, sf_dir), CHOICES)


@query("filtered_clients", _VIEW + " SELECT client_id, segment, country, region FROM view")
def filtered_clients(spark, sf_dir):
    return _view(spark, sf_dir).select("client_id", "segment", "country", "region")


@query("nothing_chosen", _S + """
SELECT true AS is_empty, 0 AS clients UNION ALL SELECT count(*) = 0, count(*) FROM segmented""")
def nothing_chosen(spark, sf_dir):
    """An empty list of regions selects no client; the whole view selects all."""
    view = segmented(spark, sf_dir)
    none = R.filtered(view, {"region": []})
    count = lambda df: df.agg((F.count("*") == 0).alias("is_empty"), F.count("*").alias("clients"))
    return count(none).unionByName(count(view))


@query("region_options", _S + f"""
SELECT DISTINCT region FROM segmented WHERE country IN ('NATION_0', 'NATION_1', 'NATION_8') AND region IS NOT NULL""")
def region_options(spark, sf_dir):
    return R.region_options(segmented(spark, sf_dir), ["NATION_0", "NATION_1", "NATION_8"])


@query("filter_options", _S + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS attribute, {c} AS level FROM segmented WHERE {c} IS NOT NULL" for c in R.FILTERS))
def filter_options(spark, sf_dir):
    return R.filter_options(segmented(spark, sf_dir))


@query("present_segments", _VIEW + " SELECT DISTINCT segment FROM view")
def present_segments(spark, sf_dir):
    return R.present_segments(_view(spark, sf_dir))


@query("key_figures", _VIEW + """
SELECT count(*) AS buyers, round(count(*) / CAST((SELECT count(*) FROM segmented) AS DOUBLE), 8) AS share_of_book,
  round(sum(total_investment), 2) AS capital,
  round(sum(total_investment) / (SELECT sum(total_investment) FROM segmented), 8) AS share_of_capital,
  round(avg(total_investment), 4) AS avg_per_buyer, CAST(sum(total_properties) AS BIGINT) AS units,
  round(avg(avg_property_price), 4) AS avg_ticket FROM view""")
def key_figures(spark, sf_dir):
    return rounded(R.key_figures(segmented(spark, sf_dir), CHOICES), {
        "share_of_book": 8, "capital": 2, "share_of_capital": 8, "avg_per_buyer": 4, "avg_ticket": 4})


_MONEY_TEXT = """CASE WHEN abs({x}) >= 1e9 THEN format('${{:,.2f}}B', {x} / 1e9)
  WHEN abs({x}) >= 1e6 THEN format('${{:,.2f}}M', {x} / 1e6) WHEN abs({x}) >= 1e3 THEN format('${{:,.0f}}K', {x} / 1e3)
  ELSE format('${{:,.0f}}', {x}) END"""


@query("segment_totals", _VIEW + ", t AS (SELECT segment, count(*) AS clients, sum(total_investment) AS capital FROM view GROUP BY 1) "
       + "SELECT segment, clients, round(capital, 2) AS capital, " + _MONEY_TEXT.format(x="capital") + f" AS label FROM t {_ORDERED}")
def segment_totals(spark, sf_dir):
    return rounded(R.segment_totals(_view(spark, sf_dir)), 2)


_SHARES = _VIEW + """, t AS (SELECT segment, count(*) AS clients, sum(total_investment) AS capital FROM view GROUP BY 1),
u AS (SELECT *, clients / CAST(sum(clients) OVER () AS DOUBLE) AS client_share, capital / sum(capital) OVER () AS capital_share FROM t)
"""


@query("capital_shares", _SHARES + """SELECT segment, clients, round(capital, 2) AS capital, round(client_share, 8) AS client_share,
  round(capital_share, 8) AS capital_share, round(capital_share / client_share, 8) AS over_index FROM u """ + _ORDERED)
def capital_shares(spark, sf_dir):
    return rounded(R.capital_shares(_view(spark, sf_dir)), {
        "capital": 2, "client_share": 8, "capital_share": 8, "over_index": 8})


@query("capital_share_texts", _SHARES + "SELECT segment, format('{:,d}', clients) AS clients, "
       + _MONEY_TEXT.format(x="capital") + """ AS capital, format('{:.1f}%', client_share * 100) AS client_share,
  format('{:.1f}%', capital_share * 100) AS capital_share, format('{:.2f}x', capital_share / client_share) AS over_index FROM u """ + _ORDERED)
def capital_share_texts(spark, sf_dir):
    return R.capital_share_texts(_view(spark, sf_dir))


@query("mean_units", _VIEW + f" SELECT segment, round(avg(total_properties), 6) AS mean_units FROM view GROUP BY 1 {_ORDERED}")
def mean_units(spark, sf_dir):
    return rounded(R.mean_units(_view(spark, sf_dir)), 6)


@query("asset_mix", _VIEW + """
SELECT segment, 'Apartment' AS asset, round(avg(apartment_share), 8) AS share FROM view GROUP BY 1
UNION ALL SELECT segment, 'Office', round(avg(office_share), 8) FROM view GROUP BY 1""")
def asset_mix(spark, sf_dir):
    return rounded(R.asset_mix(_view(spark, sf_dir)), 8)


@query("declared_rates", _VIEW + f"""
SELECT segment, round(avg(loan_flag), 8) AS loan_rate, round(avg(is_investment), 8) AS investment_rate,
  round(avg(is_company), 8) AS company_rate FROM view GROUP BY 1 {_ORDERED}""")
def declared_rates(spark, sf_dir):
    return rounded(R.declared_rates(_view(spark, sf_dir)), 8)


@query("capital_boxes", _VIEW + """
, q AS (SELECT segment AS g, quantile_cont(total_investment, 0.25) AS q1, quantile_cont(total_investment, 0.5) AS median,
    quantile_cont(total_investment, 0.75) AS q3 FROM view GROUP BY 1),
m AS (SELECT *, total_investment BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM view JOIN q ON segment = g)
SELECT segment, count(*) AS n, round(q1, 4) + 0.0 AS q1, round(median, 4) + 0.0 AS median, round(q3, 4) + 0.0 AS q3,
  round(min(total_investment) FILTER (inside), 4) + 0.0 AS whisker_low, round(max(total_investment) FILTER (inside), 4) + 0.0 AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers FROM m GROUP BY segment, q1, median, q3""")
def capital_boxes(spark, sf_dir):
    return rounded(eda.box_statistics(_view(spark, sf_dir), "total_investment", "segment"))


# Some nations take the name of a country that has a map code; the others stay unmapped.
_NAMED = {"NATION_0": "USA", "NATION_1": "UK", "NATION_2": "Canada", "NATION_4": "Germany", "NATION_5": "France"}
_CODES = {"USA": "USA", "UK": "GBR", "Canada": "CAN", "Germany": "DEU", "France": "FRA"}
_NAMED_SQL = "CASE country " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMED.items()) + " ELSE country END"
_CODED_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " END"
_COUNTRIES = _VIEW + f""", t AS (SELECT {_NAMED_SQL} AS c, count(*) AS clients, sum(total_investment) AS capital,
  avg(total_investment) AS avg_investment FROM view GROUP BY 1)
SELECT c AS country, clients, round(capital, 2) AS capital, round(avg_investment, 6) AS avg_investment, {_CODED_SQL} AS iso3 FROM t"""


def _named_view(spark, sf_dir):
    named = F.col("country")
    for k, v in _NAMED.items():
        named = F.when(F.col("country") == k, v).otherwise(named)
    return _view(spark, sf_dir).withColumn("country", named)


@query("country_totals", _COUNTRIES)
def country_totals(spark, sf_dir):
    return rounded(R.country_totals(_named_view(spark, sf_dir)), {"capital": 2, "avg_investment": 6})


@query("mapped_countries", _COUNTRIES + f" WHERE {_CODED_SQL} IS NOT NULL")
def mapped_countries(spark, sf_dir):
    return rounded(R.mapped_countries(_named_view(spark, sf_dir)), {"capital": 2, "avg_investment": 6})


@query("country_total_texts", _VIEW + ", t AS (SELECT country, count(*) AS n, sum(total_investment) AS s, avg(total_investment) AS a FROM view GROUP BY 1) "
       + "SELECT country, format('{:,d}', n) AS clients, " + _MONEY_TEXT.format(x="s") + " AS capital, " + _MONEY_TEXT.format(x="a") + " AS avg_investment FROM t")
def country_total_texts(spark, sf_dir):
    return R.country_total_texts(_view(spark, sf_dir))


_TOP_COUNTRIES = _S + ", top AS (SELECT country, count(*) AS n FROM segmented GROUP BY 1 ORDER BY n DESC, country LIMIT 10)"


@query("top_regions", _VIEW + " SELECT region AS level, count(*) AS n FROM view GROUP BY 1 ORDER BY n DESC, level LIMIT 3")
def top_regions(spark, sf_dir):
    return R.top_regions(_view(spark, sf_dir), 3)


@query("clients_in_top_regions", _S + """
SELECT client_id, region FROM segmented WHERE region IN (
  SELECT region FROM (SELECT region, count(*) AS n FROM segmented GROUP BY 1 ORDER BY n DESC, region LIMIT 2))""")
def clients_in_top_regions(spark, sf_dir):
    return R.in_top_regions(segmented(spark, sf_dir), 2).select("client_id", "region")


def _mix_sql(row, source):
    """Every cell of the cross table, also those without a client."""
    return f"""
, cells AS (SELECT {row} AS r, segment AS c, count(*) AS n FROM {source} GROUP BY 1, 2),
levels AS (SELECT DISTINCT c FROM cells)
SELECT r AS {row}, levels.c AS segment, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(n) OVER (PARTITION BY r) AS DOUBLE), 8) AS share
FROM (SELECT DISTINCT r FROM cells) picked CROSS JOIN levels LEFT JOIN cells USING (r, c)"""


@query("country_segment_mix", _TOP_COUNTRIES + _mix_sql("country", "segmented JOIN top USING (country)"))
def country_segment_mix(spark, sf_dir):
    return rounded(eda.row_shares(segmented(spark, sf_dir), "country", "segment", 10), 8)


@query("region_segment_mix", _VIEW + _mix_sql("region", "view"))
def region_segment_mix(spark, sf_dir):
    return rounded(R.region_mix(_view(spark, sf_dir), 12), 8)


_SLICE = ("avg_capital avg_ticket avg_units avg_area loan_rate investment_rate avg_span_days")


@query("segment_statistics", _VIEW + f"""
SELECT clients, {rnd(_SLICE, 5)} FROM (SELECT count(*) AS clients, avg(total_investment) AS avg_capital, avg(avg_property_price) AS avg_ticket,
  avg(total_properties) AS avg_units, avg(avg_floor_area) AS avg_area, avg(loan_flag) AS loan_rate, avg(is_investment) AS investment_rate,
  avg(purchase_span_days) AS avg_span_days FROM view WHERE segment = '{_FOCUS}')""")
def segment_statistics(spark, sf_dir):
    return rounded(R.slice_statistics(_view(spark, sf_dir), _FOCUS), 5)


@query("book_comparison", _VIEW + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM view WHERE segment = '{_FOCUS}') AS s, (SELECT avg({c}) FROM segmented) AS b"
    for c in BOOK_COMPARISON) + """)
SELECT feature, round(s, 5) AS segment_mean, round(b, 5) AS book_mean, round(s / nullif(b, 0), 8) AS index_vs_book FROM c""")
def book_comparison(spark, sf_dir):
    return rounded(R.book_comparison(segmented(spark, sf_dir), CHOICES, _FOCUS), {
        "segment_mean": 5, "book_mean": 5, "index_vs_book": 8})


@query("book_comparison_texts", _VIEW + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM view WHERE segment = '{_FOCUS}') AS s, (SELECT avg({c}) FROM segmented) AS b"
    for c in BOOK_COMPARISON) + """)
SELECT feature, format('{:,.2f}', s) AS segment_mean, format('{:,.2f}', b) AS book_mean, format('{:.2f}x', s / b) AS index_vs_book FROM c""")
def book_comparison_texts(spark, sf_dir):
    return R.book_comparison_texts(segmented(spark, sf_dir), CHOICES, _FOCUS)


_EXPLORER_DOUBLES = ("total_investment", "avg_property_price", "avg_floor_area", "office_share")


@query("client_explorer", _VIEW + " SELECT " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" if c in _EXPLORER_DOUBLES else c for c in EXPLORER)
    + " FROM view ORDER BY view.total_investment DESC, client_id")
def client_explorer(spark, sf_dir):
    return rounded(R.client_explorer(_view(spark, sf_dir)), 6)
