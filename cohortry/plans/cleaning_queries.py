"""Cleaning and audit over the text form of the register and the ledger."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.config import REFERENCE_DATE, REGISTER_LABELS
from cohortry.functions import parsing as P
from cohortry.operators import cleaning as C
from cohortry.operators import eda
from cohortry.operators import features as FE
from cohortry.plans.registry import BEHAVIOUR, LEDGER, LINES, REGISTER, query, rnd, rounded
from cohortry.sources import views as V

_ORDER = ["line_order"]

_BIRTH = """
births AS (
  SELECT c_custkey AS k, c_custkey % 97 = 5 AS unknown, c_custkey % 89 = 3 AS dayfirst,
    c_custkey % 101 = 7 AS iso, 1931 + c_custkey % 70 AS y, 1 + c_custkey % 12 AS m,
    1 + c_custkey % 28 AS d, 13 + c_custkey % 15 AS late
  FROM customer
),
birthdays AS (
  SELECT k, CASE WHEN unknown THEN NULL WHEN dayfirst THEN try_cast(y || '-' || m || '-' || late AS DATE)
    ELSE make_date(y, m, d) END AS born,
    NOT unknown AND NOT dayfirst AND NOT iso AND d <= 12 AS both_small,
    CASE WHEN unknown THEN NULL WHEN dayfirst THEN 'D' WHEN iso THEN 'I' WHEN d > 12 THEN 'S' ELSE 'M' END AS form
  FROM births
)"""


@query("currency_prices", """
SELECT l_orderkey * 10 + l_linenumber AS listing_id, count(*) AS listings, count(price) AS priced,
  round(sum(price), 2) AS price_sum
FROM (SELECT *, CASE WHEN l_partkey % 50 <> 7 THEN l_extendedprice END AS price
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
GROUP BY 1""")
def currency_prices(spark, sf_dir):
    price = P.currency(F.col("sale_price"))
    return rounded(V.ledger_text(spark, sf_dir).groupBy(
        P.to_whole(F.col("listing_id")).alias("listing_id")
    ).agg(F.count("*").alias("listings"), F.count(price).alias("priced"),
          F.sum(price).alias("price_sum")), 2)


@query("tidied_labels", """
SELECT CAST(c_custkey AS VARCHAR) AS client_id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Company' ELSE 'Individual' END AS client_type,
  n_name AS country, CASE WHEN c_custkey % 79 <> 2 THEN 'via ' || c_mktsegment END AS referral_channel,
  c_custkey % 11 = 0 AS country_changed
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tidied_labels(spark, sf_dir):
    raw = V.register_text(spark, sf_dir)
    marked = raw.withColumn("country_changed", P.label_changed(F.col("country")))
    return C.tidy_labels(marked, REGISTER_LABELS).select(
        "client_id", "client_type", "country", "referral_channel", "country_changed"
    )


@query("mixed_birth_dates", "WITH " + _BIRTH + """
SELECT CAST(k AS VARCHAR) AS client_id, born, both_small AS ambiguous FROM birthdays""")
def mixed_birth_dates(spark, sf_dir):
    birth = F.col("date_of_birth")
    return V.register_text(spark, sf_dir).select(
        "client_id", P.mixed_date(birth).alias("born"), P.ambiguous_date(birth).alias("ambiguous")
    )


@query("ledger_dates", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS transaction_date, count(*) AS listings
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def ledger_dates(spark, sf_dir):
    return V.ledger_text(spark, sf_dir).groupBy(
        P.month_first_date(F.col("transaction_date")).alias("transaction_date")
    ).agg(F.count("*").alias("listings"))


@query("client_ages", "WITH " + _BIRTH + """
SELECT CAST(k AS VARCHAR) AS client_id, CAST(2025 - year(born) AS INTEGER) AS age,
  CAST(1999 - year(born) - CASE WHEN (month(born), day(born)) > (6, 15) THEN 1 ELSE 0 END AS INTEGER)
    AS age_mid_1999
FROM birthdays""")
def client_ages(spark, sf_dir):
    born = P.mixed_date(F.col("date_of_birth"))
    mid = REFERENCE_DATE.replace(year=1999, month=6, day=15)
    return V.register_text(spark, sf_dir).select("client_id", born.alias("born")).select(
        "client_id", P.age_on(F.col("born"), REFERENCE_DATE).alias("age"),
        P.age_on(F.col("born"), mid).alias("age_mid_1999"),
    )


@query("coerced_numbers", """
SELECT CASE WHEN c_custkey % 83 <> 1 THEN 1 + c_custkey % 5 END AS score, count(*) AS n
FROM customer GROUP BY 1""")
def coerced_numbers(spark, sf_dir):
    return V.register_text(spark, sf_dir).groupBy(
        P.to_whole(F.col("satisfaction_score")).alias("score")
    ).agg(F.count("*").alias("n"))


@query("client_flags", """
SELECT CAST(c_custkey AS VARCHAR) AS client_id, replace(c_name, '#', ' ') AS full_name,
  CAST(c_acctbal < 0 AS INTEGER) AS loan_flag,
  CAST(c_mktsegment IN ('BUILDING', 'FURNITURE') AS INTEGER) AS is_investment,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_company
FROM customer""")
def client_flags(spark, sf_dir):
    return C.tidy_labels(V.register_text(spark, sf_dir), REGISTER_LABELS).select(
        "client_id", P.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        P.label_flag(F.col("loan_applied"), "yes").alias("loan_flag"),
        P.label_flag(F.col("acquisition_purpose"), "investment").alias("is_investment"),
        P.label_flag(F.col("client_type"), "company").alias("is_company"),
    )


@query("client_keys", """
SELECT CASE WHEN l_linestatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS client_ref, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def client_keys(spark, sf_dir):
    return V.ledger_text(spark, sf_dir).groupBy(
        P.key_or_null(F.col("client_ref")).alias("client_ref")
    ).agg(F.count("*").alias("n"))


@query("cleaned_register", "WITH " + REGISTER + "," + _BIRTH + """
SELECT CAST(client_id AS VARCHAR) AS client_id, 'Customer' AS first_name,
  split_part(full_name, '#', 2) AS last_name, client_type, gender, country, region,
  born AS date_of_birth,
  CASE WHEN is_investment = 1 THEN 'INVESTMENT' ELSE 'Home' END AS acquisition_purpose,
  CASE WHEN client_id % 83 <> 1 THEN satisfaction_score END AS satisfaction_score,
  CASE WHEN loan_flag = 1 THEN 'yes' ELSE 'No' END AS loan_applied,
  CASE WHEN client_id % 79 <> 2 THEN 'via ' || referral_channel END AS referral_channel,
  CAST(2025 - year(born) AS INTEGER) AS age, loan_flag, is_investment, is_company,
  replace(full_name, '#', ' ') AS full_name
FROM register JOIN birthdays ON client_id = k""")
def cleaned_register(spark, sf_dir):
    clean = C.clean_register(V.register_text(spark, sf_dir))
    return clean.withColumns({"first_name": F.trim("first_name"), "last_name": F.trim("last_name")})


_TEXT_LEDGER = LEDGER.replace(
    "l_extendedprice AS sale_price", "CASE WHEN l_partkey % 50 <> 7 THEN l_extendedprice END AS sale_price"
).replace(
    "l_extendedprice / nullif(l_quantity, 0)",
    "CASE WHEN l_partkey % 50 <> 7 THEN l_extendedprice END / nullif(l_quantity, 0)",
)


@query("cleaned_ledger", "WITH " + _TEXT_LEDGER + """
SELECT listing_id, transaction_date, unit_category, tower_number, unit_number, floor_area_sqft,
  sale_price, listing_status, CAST(client_ref AS VARCHAR) AS client_ref, price_per_sqft FROM ledger""")
def cleaned_ledger(spark, sf_dir):
    return C.clean_ledger(V.ledger_text(spark, sf_dir), _ORDER)


@query("distinct_rows", """
SELECT DISTINCT * FROM lineitem""")
def distinct_rows(spark, sf_dir):
    return C.drop_repeated_rows(V.table(spark, sf_dir, "lineitem"))


@query("first_listings", "WITH " + LINES + """
SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS listing_id,
  CAST(l_suppkey AS VARCHAR) AS tower_number, CAST(l_partkey AS VARCHAR) AS unit_number FROM lines""")
def first_listings(spark, sf_dir):
    return C.keep_first(V.ledger_text(spark, sf_dir), "listing_id", _ORDER).select(
        "listing_id", "tower_number", "unit_number"
    )


@query("missing_key_rule", "WITH " + LEDGER + """
SELECT coalesce(bool_and(CASE WHEN client_ref IS NULL THEN listing_status = 'Available'
                              ELSE listing_status = 'Sold' END), true) AS holds,
       false AS holds_for_offices
FROM ledger""")
def missing_key_rule(spark, sf_dir):
    book = V.ledger(spark, sf_dir)
    swapped = F.when(F.col("unit_category") == "Office", F.lit("Available")).otherwise(F.col("listing_status"))
    holds = book.agg(C.missing_key_rule(book).alias("v")).scalar()
    broken = book.withColumn("listing_status", swapped)
    return broken.agg(C.missing_key_rule(broken).alias("holds_for_offices")).select(
        holds.alias("holds"), "holds_for_offices"
    )


@query("orphan_keys", "WITH " + REGISTER + "," + LEDGER + """
SELECT count(*) AS orphan_client_refs FROM ledger
WHERE client_ref IS NOT NULL AND client_ref NOT IN (
  SELECT CASE WHEN client_id % 7 = 0 THEN -client_id ELSE client_id END FROM register)""")
def orphan_keys(spark, sf_dir):
    """Every seventh key of the register is spoiled, so that its references are orphans."""
    key = F.col("client_id")
    spoiled = V.register(spark, sf_dir).withColumn("client_id", F.when(key % 7 == 0, -key).otherwise(key))
    return C.orphan_rows(spoiled, V.ledger(spark, sf_dir))


@query("clients_with_purchase", "WITH " + REGISTER + "," + LEDGER + """
SELECT count(DISTINCT client_id) AS clients_with_purchase FROM register
WHERE client_id IN (SELECT client_ref FROM ledger WHERE client_ref IS NOT NULL)""")
def clients_with_purchase(spark, sf_dir):
    return C.clients_with_rows(V.register(spark, sf_dir), V.ledger(spark, sf_dir))


@query("shared_keys", "WITH " + REGISTER + "," + LEDGER + """
SELECT client_id FROM register INTERSECT SELECT client_ref FROM ledger WHERE client_ref IS NOT NULL""")
def shared_keys(spark, sf_dir):
    return C.shared_keys(V.register(spark, sf_dir), V.ledger(spark, sf_dir))


_REPORT = "WITH " + REGISTER + "," + _TEXT_LEDGER + "," + _BIRTH + """,
raw AS (SELECT l_orderkey * 10 + l_linenumber AS id, to_json(row(
          l_orderkey * 10 + l_linenumber, date_trunc('month', o_orderdate), l_returnflag = 'R', l_suppkey,
          l_partkey, l_quantity, CASE WHEN l_partkey % 50 <> 7 THEN l_extendedprice END, l_linestatus,
          CASE WHEN l_linestatus = 'F' THEN o_custkey END)) AS whole
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
report AS (
  SELECT * FROM (VALUES
    (1, 'clients_rows_in', (SELECT CAST(count(*) AS VARCHAR) FROM register)),
    (2, 'clients_rows_out', (SELECT CAST(count(*) AS VARCHAR) FROM register)),
    (3, 'clients_missing_cells', (SELECT CAST(count(*) AS VARCHAR) FROM register WHERE client_id % 79 = 2)),
    (4, 'clients_duplicate_rows', '0'),
    (5, 'clients_duplicate_ids', '0'),
    (6, 'properties_rows_in', (SELECT CAST(count(*) AS VARCHAR) FROM raw)),
    (7, 'properties_rows_out', (SELECT CAST(count(*) AS VARCHAR) FROM ledger)),
    (8, 'properties_duplicate_rows', (SELECT CAST(count(*) - count(DISTINCT whole) AS VARCHAR) FROM raw)),
    (9, 'properties_duplicate_ids', (SELECT CAST(count(*) - count(DISTINCT id) AS VARCHAR) FROM raw)),
    (10, 'properties_missing_client_ref', (SELECT CAST(count(*) AS VARCHAR) FROM ledger WHERE client_ref IS NULL)),
    (11, 'missing_ref_all_available', 'true'),
    (12, 'orphan_client_refs', (SELECT CAST(count(*) AS VARCHAR) FROM ledger
        WHERE client_ref IS NOT NULL AND client_ref NOT IN (SELECT client_id FROM register))),
    (13, 'clients_with_purchase', (SELECT CAST(count(DISTINCT client_ref) AS VARCHAR) FROM ledger
        WHERE client_ref IN (SELECT client_id FROM register))),
    (14, 'labels_normalised', (SELECT CAST(
        (SELECT count(*) FROM register WHERE client_type = 'Company')
        + (SELECT count(*) FROM register WHERE client_id % 11 = 0)
        + (SELECT count(*) FROM register WHERE client_id % 79 <> 2)
        + (SELECT count(*) FROM ledger WHERE unit_category = 'Office') AS VARCHAR))),
    (15, 'dob_unparsed', (SELECT CAST(count(*) AS VARCHAR) FROM birthdays WHERE born IS NULL)),
    (16, 'dob_ambiguous_rows', (SELECT CAST(count(*) AS VARCHAR) FROM birthdays WHERE both_small)),
    (17, 'price_unparsed', (SELECT CAST(count(*) AS VARCHAR) FROM ledger WHERE sale_price IS NULL)),
    (18, 'transaction_min', (SELECT CAST(min(transaction_date) AS VARCHAR) FROM ledger)),
    (19, 'transaction_max', (SELECT CAST(max(transaction_date) AS VARCHAR) FROM ledger))
  ) t(position, "check", value)
)"""


def _report(spark, sf_dir):
    return C.cleaning_report(
        V.register_text(spark, sf_dir), V.ledger_text(spark, sf_dir), ledger_order=_ORDER
    )


@query("cleaning_report", _REPORT + """ SELECT position, "check", value FROM report""")
def cleaning_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query("audit_notes", _REPORT + """
, v AS (SELECT max(value) FILTER ("check" = 'orphan_client_refs') AS orphans,
          max(value) FILTER ("check" = 'clients_with_purchase') AS buyers,
          max(value) FILTER ("check" = 'clients_rows_out') AS clients,
          max(value) FILTER ("check" = 'dob_ambiguous_rows') AS amb FROM report)
SELECT 'Every client key of the ledger is in the register.' AS note FROM v WHERE orphans = '0'
UNION ALL SELECT 'Every client has a purchase.' FROM v WHERE buyers = clients
UNION ALL SELECT 'A missing client key always marks available stock; it is left out, not filled.' FROM v
UNION ALL SELECT amb || ' birth dates can be read day or month first; age at the end of a year does not depend on it.'
  FROM v WHERE amb <> '0'""")
def audit_notes(spark, sf_dir):
    return C.audit_notes(_report(spark, sf_dir))


@query("status_by_missing_key", "WITH " + LEDGER + """
SELECT listing_status, key_missing, count(*) FILTER ((client_ref IS NULL) = key_missing) AS n
FROM ledger, (VALUES (true), (false)) t(key_missing) GROUP BY 1, 2""")
def status_by_missing_key(spark, sf_dir):
    return eda.null_key_table(V.ledger(spark, sf_dir))


@query("date_masks", """
WITH t AS (SELECT c_custkey AS k, 1 + c_custkey % 12 AS m, 1 + c_custkey % 28 AS d FROM customer)
SELECT CASE WHEN k % 97 = 5 THEN 'not known'
  WHEN k % 89 = 3 THEN '99-' || repeat('9', length(CAST(m AS VARCHAR))) || '-9999'
  WHEN k % 101 = 7 THEN '9999-99-99'
  WHEN d > 12 THEN repeat('9', length(CAST(m AS VARCHAR))) || '/99/9999' ELSE '99-99-9999' END AS mask,
  count(*) AS n FROM t GROUP BY 1""")
def date_masks(spark, sf_dir):
    return eda.mask_frequency(V.register_text(spark, sf_dir), "date_of_birth")


@query("date_component_ranges", """
WITH t AS (SELECT c_custkey AS k, 1 + c_custkey % 12 AS m, 1 + c_custkey % 28 AS d, 13 + c_custkey % 15 AS late,
           1931 + c_custkey % 70 AS y FROM customer WHERE c_custkey % 97 <> 5),
p AS (SELECT CASE WHEN k % 89 = 3 OR k % 101 = 7 OR d <= 12 THEN 'dash' ELSE 'slash' END AS kind,
  CASE WHEN k % 89 = 3 THEN late WHEN k % 101 = 7 THEN y ELSE m END AS a,
  CASE WHEN k % 89 = 3 THEN m WHEN k % 101 = 7 THEN m ELSE d END AS b FROM t)
SELECT kind, count(*) AS n, CAST(min(a) AS INTEGER) AS first_min, CAST(max(a) AS INTEGER) AS first_max,
  CAST(min(b) AS INTEGER) AS second_min, CAST(max(b) AS INTEGER) AS second_max FROM p GROUP BY kind""")
def date_component_ranges(spark, sf_dir):
    return eda.component_ranges(V.register_text(spark, sf_dir), "date_of_birth")


@query("reading_order_sensitivity", "WITH " + _BIRTH + """
SELECT count(*) FILTER (both_small AND month(born) <> day(born)) AS dates_differ,
  CAST(0 AS BIGINT) AS years_differ FROM birthdays""")
def reading_order_sensitivity(spark, sf_dir):
    return eda.reading_order_sensitivity(V.register_text(spark, sf_dir), "date_of_birth")


_MONEY = "total_investment avg_property_price max_property_price min_property_price price_dispersion"


@query("purchases_from_text", "WITH " + BEHAVIOUR.replace(LEDGER, _TEXT_LEDGER).replace(
    "sum(sale_price) AS total_investment", "coalesce(sum(sale_price), 0) AS total_investment") + f"""
SELECT CAST(client_id AS VARCHAR) AS client_id, total_properties, {rnd(_MONEY, 6)}, unique_towers,
  active_months, apartment_count, office_count FROM behaviour""")
def purchases_from_text(spark, sf_dir):
    """Text ledger to profiles: the cleaning and the aggregation in one plan."""
    ledger = C.clean_ledger(V.ledger_text(spark, sf_dir), _ORDER)
    return rounded(FE.aggregate_purchases(ledger).select(
        "client_id", "total_properties", *_MONEY.split(), "unique_towers", "active_months",
        "apartment_count", "office_count",
    ), 6)


