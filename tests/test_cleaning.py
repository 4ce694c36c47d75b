import datetime as dt

import pytest

from cohortry.config import LEDGER_COLUMNS, REGISTER_COLUMNS
from cohortry.operators import cleaning as C
from cohortry.operators import features as FE
from cohortry.session import stage_table
from cohortry.sources import readers


def text(spark, columns, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows],
                                 ", ".join(f"{c} string" for c in columns))


def client(i, **more):
    return {"client_id": i, "first_name": " Ann ", "last_name": "Lee", "client_type": "Company", "gender": "F",
            "country": "USA", "region": "R", "date_of_birth": "05-03-1990", "acquisition_purpose": "Investment",
            "satisfaction_score": "4", "loan_applied": "Yes", "referral_channel": "web", **more}


def listing(i, **more):
    return {"listing_id": i, "transaction_date": "05-01-2024", "unit_category": "Office", "tower_number": "1",
            "unit_number": "2", "floor_area_sqft": "10", "sale_price": "$1,000.50", "listing_status": "Sold",
            "client_ref": "a", **more}


def test_clean_register_keeps_the_first(spark):
    raw = text(spark, REGISTER_COLUMNS, [client("a", gender="M"), client("a", gender="F"), client("b", country="  New   York ")])
    rows = {r["client_id"]: r for r in C.clean_register(raw, ["gender"]).collect()}
    assert rows["a"]["gender"] == "F" and rows["b"]["country"] == "New York"
    assert (rows["a"]["full_name"], rows["a"]["age"], rows["a"]["loan_flag"]) == ("Ann Lee", 35, 1)
    assert rows["a"]["date_of_birth"] == dt.date(1990, 5, 3)


def test_clean_ledger(spark):
    raw = text(spark, LEDGER_COLUMNS, [
        listing("1"), listing("2", client_ref="nan", listing_status="Available"),
        listing("3", floor_area_sqft="0"), listing("4", sale_price="ask")])
    rows = {r["listing_id"]: r for r in C.clean_ledger(raw).collect()}
    assert rows[1]["price_per_sqft"] == pytest.approx(100.05)
    assert rows[2]["client_ref"] is None and rows[3]["price_per_sqft"] is None and rows[4]["sale_price"] is None


def test_null_ids_repeat_each_other(spark):
    raw = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "client_id string, x int")
    audit = C.raw_audit(raw, ["client_id", "x"], "client_id").first()
    assert audit["duplicate_ids"] == 2 and audit["duplicate_rows"] == 0 and audit["missing_cells"] == 2
    assert C.keep_first(raw, "client_id", ["x"]).count() == 3


def test_audit_of_nothing(spark):
    raw = spark.createDataFrame([], "client_id string, x int")
    assert C.raw_audit(raw, ["client_id", "x"], "client_id").first()[:] == (0, 0, 0, 0)
    empty = spark.createDataFrame([], "client_ref string, listing_status string")
    assert empty.agg(C.missing_key_rule(empty).alias("v")).first()["v"] is True


def test_report_and_notes(spark):
    register = text(spark, REGISTER_COLUMNS, [client("a"), client("b"), client("b"), client("c", region=None, gender=" F")])
    ledger = text(spark, LEDGER_COLUMNS, [
        listing("1"), listing("2", client_ref="zz"), listing("3", client_ref="zz"),
        listing("4", client_ref="", listing_status="Available")])
    report = C.cleaning_report(register, ledger)
    got = {r["check"]: r["value"] for r in report.collect()}
    assert got["clients_rows_in"] == "4" and got["clients_rows_out"] == "3"
    assert got["clients_duplicate_rows"] == got["clients_duplicate_ids"] == "1"
    assert got["clients_missing_cells"] == "1" and got["labels_normalised"] == "1"
    assert got["orphan_client_refs"] == "2" and got["clients_with_purchase"] == "1"
    assert got["missing_ref_all_available"] == "true" and got["dob_ambiguous_rows"] == "3"
    assert got["transaction_min"] == "2024-05-01" and len(got) == 19
    notes = [r["note"] for r in C.audit_notes(report).collect()]
    assert len(notes) == 2


def test_one_purchase_and_no_purchase(spark):
    register = C.clean_register(text(spark, REGISTER_COLUMNS, [client("a"), client("b", country="UK")]))
    ledger = C.clean_ledger(text(spark, LEDGER_COLUMNS, [listing("1")]))
    rows = {r["client_id"]: r for r in FE.client_features(register, ledger).collect()}
    assert rows["a"]["price_dispersion"] == 0.0 and rows["a"]["purchase_span_days"] == 0
    assert rows["b"]["has_purchase"] == 0 and rows["b"]["total_investment"] == 0.0
    assert rows["b"]["first_purchase"] is None and rows["b"]["is_domestic"] == 0


def test_label_codes_with_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "country string")
    assert [r[1] for r in FE.label_encode(df).orderBy("country").collect()] == [2, 0, 1]


def test_csv_order_null_tokens_and_header(spark, tmp_path):
    path = tmp_path / "r.csv"
    lines = [",".join(REGISTER_COLUMNS)] + [
        f'{i % 50},"A, ""x""",L{i},Company,N/A,USA,R,1/2/1990,Home,3,No,' for i in range(200)]
    path.write_text("\n".join(lines) + "\n")
    raw = readers.read_register(spark, str(path))
    row = raw.first()
    assert row["first_name"] == 'A, "x"' and row["gender"] is None and row["referral_channel"] is None
    first = C.keep_first(raw, "client_id", ["file_order"]).collect()
    assert {r["last_name"] for r in first} == {f"L{i}" for i in range(50)}
    swapped = tmp_path / "s.csv"
    swapped.write_text(",".join(reversed(REGISTER_COLUMNS)) + "\n" + ",".join("abcdefghijkl") + "\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_register(spark, str(swapped)).collect()


def test_no_field_of_a_text_table_is_lost(spark, tmp_path):
    def read(text, **how):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.csv"
        path.write_text(text)
        return readers.read_text_table(spark, str(path), ["a", "b"], **how)

    short = read("a,b\n1,2\n3\n4,\n")
    assert short.count() == 3
    assert [(r.a, r.b) for r in short.collect()] == [("1", "2"), ("3", None), ("4", None)]
    with pytest.raises(Exception, match="more fields than columns"):
        read("a,b\n1,2\n3,4,5\n").collect()
    broken = 'a,b\n"x\ny",7\n1,"q ""z"" r"\n'
    with pytest.raises(Exception, match="multi_line"):
        read(broken).collect()
    assert [(r.a, r.b) for r in read(broken, multi_line=True).collect()] == [("x\ny", "7"), ("1", 'q "z" r')]


def test_the_report_stages_no_listings(spark, monkeypatch):
    staged = []

    def stage(df, name):
        staged.append((name, df.count()))
        return stage_table(df, name)

    monkeypatch.setattr(C, "stage_table", stage)
    register = text(spark, REGISTER_COLUMNS, [client("a"), client("b")])
    ledger = text(spark, LEDGER_COLUMNS, [listing(str(i), client_ref="ab"[i % 2], sale_price="?" if i < 3 else "$10.00") for i in range(50)]
                  + [listing("x", client_ref="", listing_status="Sold"), listing("x", client_ref="a")])
    got = {r["check"]: r["value"] for r in C.cleaning_report(register, ledger).collect()}
    assert got["properties_rows_out"] == "51" and got["price_unparsed"] == "3" and got["clients_with_purchase"] == "2"
    assert got["properties_missing_client_ref"] == "1" and got["missing_ref_all_available"] == "false"
    assert sum(n for name, n in staged if name != "first_clients") == 3
