from __future__ import annotations

import json
from decimal import Decimal

import pytest

from tillwright.operators import cleaning
from tillwright.operators.profile import clean_invariants, duplicate_rows
from tillwright.sources.transactions import (
    check_format,
    intake_report,
    load_audit,
    load_clean,
    read_transactions,
    read_with_quarantine,
    require_columns,
    union_sources,
    unparseable_values,
    write_clean,
)


def test_text_is_coerced_and_damage_becomes_null(spark):
    rows = [
        ("1", "12", "2.50", "2011-01-01 10:00:00", "13085.0"),
        ("2", "twelve", "", "someday", "x"),
        ("3", " 7 ", "3", "2011-01-02", None),
        ("4", "1.5", "1e2", "2011-01-02 08:00:00", "5"),
    ]
    raw = spark.createDataFrame(rows, "invoice string, quantity string, price string, invoice_ts string, customer_id string")
    got = {r["invoice"]: r for r in cleaning.coerce_types(raw).collect()}
    assert (got["1"]["quantity"], got["1"]["price"], got["1"]["customer_id"]) == (12, Decimal("2.50"), 13085)
    assert [got["2"][c] for c in ("quantity", "price", "invoice_ts", "customer_id")] == [None] * 4
    assert got["3"]["quantity"] == 7 and got["3"]["invoice_ts"].day == 2
    # A fractional quantity is kept; only the whole type asked for makes it unparseable.
    assert got["4"]["quantity"] == Decimal("1.5") and got["4"]["price"] == Decimal("100.00")
    whole = {r["invoice"]: r for r in cleaning.coerce_types(raw, quantity_type="bigint").collect()}
    assert whole["4"]["quantity"] is None and whole["1"]["quantity"] == 12
    fine = cleaning.coerce_types(raw, quantity_type="double", price_type="double").filter("invoice = '4'").first()
    assert (fine["quantity"], fine["price"]) == (1.5, 100.0)


def test_rules(make_raw):
    rows = [
        ("C1", "A", "x", -1, "2011-01-01 10:00", 2.0, 1, "UK"),
        ("c2", "A", "x", -1, "2011-01-01 10:00", 2.0, 1, "UK"),
        (None, "A", None, 3, "2011-01-01 10:00", 0.0, None, None),
        ("4", "B", "\t Adjust Bad Debt\n", 1, "2011-01-01 10:00", 5.0, 1, "UK"),
        ("5", "B", "y", 2, "2011-01-01 10:00", 1.5, 1, "UK"),
        ("5", "B", "y", 2, "2011-01-01 10:00", 1.5, 1, "UK"),
        ("6", "B", "y", None, None, None, 1, "UK"),
    ]
    clean = {r["invoice"]: r for r in cleaning.clean_transactions(make_raw(rows)).collect()}
    assert set(clean) == {"c2", None, "5", "6"}
    assert clean["c2"]["is_return"] and not clean["c2"]["is_cancelled"]
    assert clean[None]["is_zero_price"] and clean[None]["revenue"] == 0
    assert clean["5"]["revenue"] == Decimal("3.00")
    assert clean["6"]["revenue"] is None and not clean["6"]["is_return"] and not clean["6"]["is_zero_price"]
    report = {r["metric"]: r["value"] for r in cleaning.cleaning_report(make_raw(rows)).collect()}
    assert report["raw_duplicate_rows"] == 1 and report["raw_cancelled_rows"] == 1 and report["raw_bad_debt_rows"] == 1
    assert report["clean_rows"] == 4 and report["missing_customers"] == 1


def test_duplicates_are_found_after_coercion(spark):
    raw = spark.createDataFrame(
        [("1", "A", "d", "2", "2011-01-01", "1.0", "5", "UK"), ("1", "A", "d", "2.0", "2011-01-01 00:00:00", "1.00", "5.0", "UK")],
        "invoice string, stock_code string, description string, quantity string, invoice_ts string, price string, "
        "customer_id string, country string",
    )
    assert cleaning.clean_transactions(raw).count() == 1


def test_duplicate_rows_restores_every_copy(make_raw):
    row = ("1", "A", "d", 1, "2011-01-01 00:00", 1.0, 1, "UK")
    many = make_raw([row]).crossJoin(make_raw([row]).sparkSession.range(25_003)).drop("id")
    assert duplicate_rows(many.unionByName(make_raw([("2", "B", "d", 1, "2011-01-01 00:00", 1.0, 1, "UK")]))).count() == 25_003


def test_empty_input(make_raw):
    clean = cleaning.clean_transactions(make_raw([]))
    assert clean.count() == 0
    assert clean_invariants(clean).first()["duplicates_remaining"] == 0


def test_format_and_column_guards(spark, tmp_path):
    assert check_format("/data/upload.CSV") == "csv"
    for bad in ("/data/upload.txt", "/data/upload"):
        with pytest.raises(ValueError):
            check_format(bad)
    with pytest.raises(ValueError, match=r"\['country', 'price'\]"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["price", "country", "a"])
    with pytest.raises(FileNotFoundError):
        read_transactions(spark, str(tmp_path / "absent.csv"))


def test_csv_upload_round_trip(spark, tmp_path):
    upload = tmp_path / "upload.csv"
    upload.write_text(
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        '489434,85048,"GLASS BALL, ""20CM""",12,2009-12-01 07:45:00,6.95,13085,United Kingdom\n'
        "C489449,22087,,-12,2009-12-01 10:33:00,2.95,16321.0,Australia\n"
    )
    rows = {r["invoice"]: r for r in read_transactions(spark, str(upload)).collect()}
    assert rows["489434"]["description"] == 'GLASS BALL, "20CM"'
    assert rows["C489449"]["customer_id"] == 16321 and rows["C489449"]["description"] is None
    (tmp_path / "short.csv").write_text("Invoice,Price\n1,2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        read_transactions(spark, str(tmp_path / "short.csv"))


def test_union_and_partitioned_write(spark, four_lines, tmp_path):
    both = union_sources({"a": four_lines, "b": four_lines.drop("country")})
    assert both.groupBy("source").count().count() == 2
    assert both.filter("source = 'b' and country is null").count() == 4
    write_clean(four_lines, str(tmp_path / "clean"))
    back = spark.read.parquet(str(tmp_path / "clean"))
    assert back.count() == 4 and back.select("month").distinct().count() == 1
    assert (tmp_path / "clean" / "month=2011-12").exists()


HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country"


def test_text_is_read_without_loss(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n1,A,x,2,2011-12-09 09:00:00,0.001,13085,UK\n2,B,y,1.5,12/09/2011 09:00,2.555,13086.0,UK\n")
    (tmp_path / "b.csv").write_text("Price,Customer ID,Invoice,StockCode,Description,Quantity,InvoiceDate,Country\n"
                                    "3.00,13085,3,C,z,n/a,31-Dec-2011,UK\n")
    (tmp_path / "c.json").write_text('{"Invoice":"4","StockCode":"D","Quantity":2,"InvoiceDate":"2011-12-09","Price":1.25,"Customer ID":7,"Country":"UK"}\n')
    paths = [str(tmp_path / name) for name in ("a.csv", "b.csv", "c.json")]
    got = {r["invoice"]: r for r in read_transactions(spark, paths).collect()}
    assert [got[i]["price"] for i in "1234"] == [Decimal("0.001"), Decimal("2.555"), Decimal("3"), Decimal("1.25")]
    assert [got[i]["quantity"] for i in "1234"] == [2, Decimal("1.5"), None, 2]
    assert [got[i]["customer_id"] for i in "1234"] == [13085, 13086, 13085, 7]
    assert (got["2"]["invoice_ts"].month, got["3"]["invoice_ts"].day, got["4"]["description"]) == (12, 31, None)
    rounded = read_transactions(spark, paths[0], price_type="decimal(12,2)").filter("invoice = '2'").first()
    assert rounded["price"] is None


def test_files_of_one_path_must_agree_in_their_header(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "1.csv").write_text(f"{HEADER}\n1,A,x,2,2011-12-09,1,13085,UK\n")
    (folder / "2.csv").write_text("Price,Customer ID,Invoice,StockCode,Description,Quantity,InvoiceDate,Country\n3,1,3,C,z,1,2011-12-09,UK\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_transactions(spark, str(folder)).collect()


def test_unparseable_values_are_counted(spark):
    text = spark.createDataFrame([("1", "x", ""), ("n/a", "2", "someday"), ("3", None, "2011-12-09")],
                                 "quantity string, price string, invoice_ts string")
    found = unparseable_values(text, cleaning.coerce_types(text)).collect()
    assert {r["column"]: r["values"] for r in found} == {"quantity": 1, "price": 1, "invoice_ts": 1}


def test_lines_that_do_not_fit_are_set_aside(spark, tmp_path):
    folder = tmp_path / "upload.csv"
    folder.mkdir()
    (folder / "1.csv").write_text(f"{HEADER}\n1,A,x,2,2011-12-09,1,7,UK,more\n2,A,x,2\n\n3,A,\"x,2,2011-12-09,1,7,UK\n4,A,\"x, y\",2,2011-12-09,1,7,UK\n")
    (folder / "2.csv").write_text(f"{HEADER}\n5,A,x,2,2011-12-09,1,7,UK\n")
    ours = "invoice,stock_code,description,quantity,invoice_ts,price,customer_id,country"
    (tmp_path / "own.csv").write_text(f"{ours}\n6,A,x,2,2011-12-09,1,7,UK\n7\n")
    line = {"Invoice": "8", "StockCode": "A", "Description": "x", "Quantity": 2, "InvoiceDate": "2011-12-09", "Price": 1.5, "Country": "UK"}
    named = {"invoice": "9", "stock_code": "A", "quantity": 3, "invoice_ts": "2011-12-09", "price": 2, "customer_id": 7, "more": {"a": [1]}}
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(line), json.dumps(named), '{"Invoice": "10", "Sto', "[1]", "{}", "", "null"]))
    paths = [str(folder), str(tmp_path / "own.csv"), str(tmp_path / "lines.json")]
    found = read_with_quarantine(spark, paths)
    assert sorted(r["invoice"] for r in found.rows.collect()) == ["4", "5", "6", "8", "9"]
    aside = {(r["line"], r["fields"]) for r in found.quarantined.collect()}
    assert aside == {("1,A,x,2,2011-12-09,1,7,UK,more", 8), ("2,A,x,2", 4), ('3,A,"x,2,2011-12-09,1,7,UK', 3), ("7", 1),
                     ('{"Invoice": "10", "Sto', 0), ("[1]", 0), ("{}", 0), ("null", 0)}
    report = {r["path"].rsplit("/", 1)[1]: (r["rows"], r["quarantined"]) for r in intake_report(spark, paths).collect()}
    assert report == {"1.csv": (1, 3), "2.csv": (1, 0), "own.csv": (1, 1), "lines.json": (2, 4)}
    # What a caller counts or projects does not decide which lines fit.
    assert found.rows.count() == 5 and found.quarantined.count() == 8
    assert read_with_quarantine(spark, paths, columns=["price"]).rows.count() == 5
    with pytest.raises(Exception, match="2,A,x,2|7,UK,more"):
        read_transactions(spark, paths[0], columns=["price"]).collect()
    with pytest.raises(ValueError, match=r"\['country'\]"):
        (tmp_path / "few.json").write_text(json.dumps({k: v for k, v in line.items() if k != "Country"}))
        read_transactions(spark, str(tmp_path / "few.json"))


def test_load_counts_while_it_writes(spark, make_raw, tmp_path):
    row = ("1", "A", "a", 1, "2011-01-01 09:00", 2.0, 1, "UK")
    lines = make_raw([row, row, ("C2", *row[1:]), ("3", "B", " Adjust bad debt ", *row[3:]), ("4", *row[1:4], "2011-02-01 09:00", *row[5:])])
    audit = load_clean(lines, str(tmp_path / "clean"))
    assert audit.collect() == load_audit(lines).collect()
    assert tuple(audit.first()) == (5, 4, 2, 4.0)
    kept = spark.read.parquet(str(tmp_path / "clean"))
    assert sorted(kept.columns) == sorted([*cleaning.clean_transactions(lines).columns, "month"])
    assert kept.drop("month").exceptAll(cleaning.clean_transactions(lines).select(kept.drop("month").columns)).count() == 0 and kept.count() == 2
    assert tuple(load_clean(lines.limit(0), str(tmp_path / "none")).first()) == (0, 0, 0, 0.0)
