"""Cleaning of the two text tables, and the audit of what it found."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.config import (
    LEDGER_COLUMNS, LEDGER_LABELS, REFERENCE_DATE, REGISTER_COLUMNS, REGISTER_LABELS,
)
from cohortry.functions import parsing as P
from cohortry.operators.scalars import one_row
from cohortry.session import stage_table


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates out."""
    return df.dropDuplicates()


def keep_first(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``; NULL keys count as one key.

    Spark limits each key to one row per map task before the shuffle, so a
    key with very many rows stays cheap.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def tidy_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: P.tidy_label(F.col(c)) for c in present})


def labels_changed(df: DataFrame, columns: Sequence[str]) -> Column:
    """Aggregate: number of cells that tidying alters."""
    present = [c for c in columns if c in df.columns]
    per_row = sum((P.label_changed(F.col(c)).cast("long") for c in present), F.lit(0).cast("long"))
    return F.coalesce(F.sum(per_row), F.lit(0))


def clean_register(raw: DataFrame, order: Sequence[str | Column] = REGISTER_COLUMNS,
                   reference: dt.date = REFERENCE_DATE) -> DataFrame:
    """Typed register with age, flags and full name; one row per client."""
    rows = tidy_labels(keep_first(raw, "client_id", order), REGISTER_LABELS)
    typed = rows.withColumns({
        "date_of_birth": P.mixed_date(F.col("date_of_birth")),
        "satisfaction_score": P.to_whole(F.col("satisfaction_score")).cast("int"),
        "loan_flag": P.label_flag(F.col("loan_applied"), "yes"),
        "is_investment": P.label_flag(F.col("acquisition_purpose"), "investment"),
        "is_company": P.label_flag(F.col("client_type"), "company"),
        "full_name": P.full_name(F.col("first_name"), F.col("last_name")),
    })
    return typed.select(
        *REGISTER_COLUMNS, P.age_on(F.col("date_of_birth"), reference).alias("age"),
        "loan_flag", "is_investment", "is_company", "full_name",
    )


def clean_ledger(raw: DataFrame, order: Sequence[str | Column] = LEDGER_COLUMNS) -> DataFrame:
    """Typed ledger with price per area; one row per listing.

    A missing client key is kept: it marks stock that is not sold.
    """
    typed = _typed_listings(keep_first(raw, "listing_id", order))
    return typed.withColumn("price_per_sqft", F.try_divide("sale_price", "floor_area_sqft"))


def _typed_listings(rows: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    return rows.select(
        P.to_whole(F.col("listing_id")).alias("listing_id"),
        P.month_first_date(F.col("transaction_date")).alias("transaction_date"),
        P.tidy_label(F.col("unit_category")).alias("unit_category"),
        P.to_whole(F.col("tower_number")).alias("tower_number"),
        P.to_whole(F.col("unit_number")).alias("unit_number"),
        P.to_double(F.col("floor_area_sqft")).alias("floor_area_sqft"),
        P.currency(F.col("sale_price")).alias("sale_price"),
        P.tidy_label(F.col("listing_status")).alias("listing_status"),
        P.key_or_null(F.col("client_ref")).alias("client_ref"),
        *more,
    )


def missing_key_rule(ledger: DataFrame) -> Column:
    """Aggregate: key missing exactly where the listing is available; true for no rows."""
    status = F.col("listing_status")
    holds = F.when(F.col("client_ref").isNull(), status.eqNullSafe("Available")).otherwise(
        status.eqNullSafe("Sold")
    )
    return F.coalesce(F.bool_and(holds), F.lit(True))


def row_audit(raw: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """``rows_in, missing_cells, distinct_rows`` and aggregates over the distinct rows, in one shuffle of the rows.

    Equal rows meet after a map-side merge, so copies of one row cost little.
    """
    missing = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    distinct = raw.groupBy(*columns).agg(F.count("*").alias("_n"))
    return distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("_n") * missing), F.lit(0)).alias("missing_cells"),
        F.count("*").alias("distinct_rows"),
        *more,
    )


def raw_audit(raw: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``rows_in, missing_cells, duplicate_rows, duplicate_ids`` in two shuffles."""
    sums = row_audit(
        raw, columns,
        F.count_distinct(key).alias("ids"),
        F.coalesce(F.max(F.col(key).isNull().cast("long")), F.lit(0)).alias("null_id"),
    )
    return sums.select(
        "rows_in", "missing_cells",
        (F.col("rows_in") - F.col("distinct_rows")).alias("duplicate_rows"),
        (F.col("rows_in") - F.col("ids") - F.col("null_id")).alias("duplicate_ids"),
    )


def reference_counts(ledger: DataFrame) -> DataFrame:
    """Ledger rows per client key; the small side of every key check."""
    return ledger.filter(F.col("client_ref").isNotNull()).groupBy("client_ref").agg(
        F.count("*").alias("rows")
    )


def orphan_rows(register: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: ledger rows whose key is not in the register."""
    known = register.select(F.col("client_id").alias("client_ref"))
    return reference_counts(ledger).join(known, "client_ref", "left_anti").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_client_refs")
    )


def clients_with_rows(register: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: clients that occur in the ledger."""
    keys = reference_counts(ledger).select(F.col("client_ref").alias("client_id"))
    return register.select("client_id").distinct().join(keys, "client_id", "left_semi").agg(
        F.count("*").alias("clients_with_purchase")
    )


def linkage(register: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row with both key checks, from one join of the counts per key."""
    return _linked(register, reference_counts(ledger))


def _linked(register: DataFrame, counts: DataFrame) -> DataFrame:
    known = register.select(F.col("client_id").alias("client_ref"), F.lit(True).alias("known")).distinct()
    found = F.coalesce(F.col("known"), F.lit(False))
    return counts.join(known, "client_ref", "left").agg(
        F.coalesce(F.sum(F.when(~found, F.col("rows"))), F.lit(0)).alias("orphan_client_refs"),
        F.count_if(found).alias("clients_with_purchase"),
    )


def shared_keys(register: DataFrame, ledger: DataFrame) -> DataFrame:
    """The keys themselves, as a set intersection."""
    refs = ledger.select(F.col("client_ref").alias("client_id")).filter("client_id is not null")
    return register.select("client_id").intersect(refs)


def cleaning_report(
    raw_register: DataFrame,
    raw_ledger: DataFrame,
    register_order: Sequence[str | Column] = REGISTER_COLUMNS,
    ledger_order: Sequence[str | Column] = LEDGER_COLUMNS,
) -> DataFrame:
    """The audit as ``(position, check, value)``, value as text.

    The first client rows are staged, as several checks read them; the first listings only as their sums per
    client key. There is one row of each key, so their number also gives the repeated keys, without counting
    keys apart.
    """
    first_clients = stage_table(
        keep_first(raw_register, "client_id", register_order).select(*REGISTER_COLUMNS), "first_clients")
    c_in = one_row(row_audit(raw_register, REGISTER_COLUMNS))
    l_in = one_row(row_audit(raw_ledger, LEDGER_COLUMNS))
    c_first = one_row(first_clients.agg(
        F.count("*").alias("rows_out"),
        labels_changed(first_clients, REGISTER_LABELS).alias("changed"),
        F.count_if(P.ambiguous_date(F.col("date_of_birth"))).alias("ambiguous"),
        F.count_if(P.mixed_date(F.col("date_of_birth")).isNull()).alias("unparsed"),
    ))
    # The first listings are chosen once: labels as they came, the rest as cleaned.
    tidied = [F.col(c).alias(f"raw_{c}") for c in LEDGER_LABELS]
    listings = _typed_listings(keep_first(raw_ledger, "listing_id", ledger_order), tidied)
    altered = sum((P.label_changed(F.col(f"raw_{c}")).cast("long") for c in LEDGER_LABELS), F.lit(0).cast("long"))
    by_ref = stage_table(listings.groupBy("client_ref").agg(
        F.count("*").alias("rows"),
        F.sum(altered).alias("changed"),
        missing_key_rule(listings).alias("rule"),
        F.count_if(F.col("sale_price").isNull()).alias("unpriced"),
        F.min("transaction_date").alias("first"),
        F.max("transaction_date").alias("last"),
    ), "listings_by_ref")
    l_out = one_row(by_ref.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_out"),
        F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"),
        F.coalesce(F.sum(F.when(F.col("client_ref").isNull(), F.col("rows"))), F.lit(0)).alias("missing_ref"),
        F.coalesce(F.bool_and("rule"), F.lit(True)).alias("rule"),
        F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    ))
    links = one_row(_linked(first_clients, by_ref.filter(F.col("client_ref").isNotNull()).select("client_ref", "rows")))
    parts = raw_register.sparkSession.range(1).select(
        c_in.alias("ci"), l_in.alias("li"), c_first.alias("cf"),
        l_out.alias("lo"), links.alias("link"),
    )
    checks = (
        ("clients_rows_in", F.col("ci.rows_in")),
        ("clients_rows_out", F.col("cf.rows_out")),
        ("clients_missing_cells", F.col("ci.missing_cells")),
        ("clients_duplicate_rows", F.col("ci.rows_in") - F.col("ci.distinct_rows")),
        ("clients_duplicate_ids", F.col("ci.rows_in") - F.col("cf.rows_out")),
        ("properties_rows_in", F.col("li.rows_in")),
        ("properties_rows_out", F.col("lo.rows_out")),
        ("properties_duplicate_rows", F.col("li.rows_in") - F.col("li.distinct_rows")),
        ("properties_duplicate_ids", F.col("li.rows_in") - F.col("lo.rows_out")),
        ("properties_missing_client_ref", F.col("lo.missing_ref")),
        ("missing_ref_all_available", F.col("lo.rule")),
        ("orphan_client_refs", F.col("link.orphan_client_refs")),
        ("clients_with_purchase", F.col("link.clients_with_purchase")),
        ("labels_normalised", F.col("cf.changed") + F.col("lo.changed")),
        ("dob_unparsed", F.col("cf.unparsed")),
        ("dob_ambiguous_rows", F.col("cf.ambiguous")),
        ("price_unparsed", F.col("lo.unpriced")),
        ("transaction_min", F.col("lo.first")),
        ("transaction_max", F.col("lo.last")),
    )
    return parts.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("check"),
                 value.cast("string").alias("value"))
        for i, (name, value) in enumerate(checks)
    ])))


def audit_notes(report: DataFrame) -> DataFrame:
    """Notes that hold for a report: ``(note)``."""
    def value(name: str) -> Column:
        return F.max(F.when(F.col("check") == name, F.col("value")))

    facts = report.agg(
        value("orphan_client_refs").cast("bigint").alias("orphans"),
        value("clients_with_purchase").cast("bigint").alias("buyers"),
        value("clients_rows_out").cast("bigint").alias("clients"),
        value("missing_ref_all_available").cast("boolean").alias("rule"),
        value("dob_ambiguous_rows").cast("bigint").alias("ambiguous"),
    )
    notes = F.array(
        F.when(F.col("orphans") == 0, "Every client key of the ledger is in the register."),
        F.when(F.col("buyers") == F.col("clients"), "Every client has a purchase."),
        F.when(F.col("rule"), "A missing client key always marks available stock; it is left out, not filled."),
        F.when(F.col("ambiguous") > 0, F.concat(
            F.col("ambiguous"),
            F.lit(" birth dates can be read day or month first; age at the end of a year does not depend on it."),
        )),
    )
    return facts.select(F.explode(F.array_compact(notes)).alias("note"))
