"""Queries against their SQL on inputs that the given tables don't have, and scalars on them."""

import random

import duckdb
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import municipal
from ledgerloom.operators.layout import layout_documents
from ledgerloom.plans import queries, render
from ledgerloom.sources.readers import ITEMS_SCHEMA

from .test_text import values


def same_as_sql(spark, name, folder, **views):
    con = duckdb.connect()
    for table, path in views.items():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    wanted = con.sql(queries.SQL[name])
    columns = sorted(wanted.columns)
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.columns) == columns
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted.select(*columns).fetchall()))


def test_amounts_of_any_size(spark, tmp_path):
    texts = ["total 92233720368547760123.00 due", "1" * 400 + ".25", "a (12345678901234567890.10) 1.20", "3 ,.15 and 4.00", "none 1.2", None, "", "x\n-7 000.50\n99 999 999 999 999 999 999.99 0.01"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, "document_amounts", str(tmp_path), documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert values(spark, ["10000000000000000.00", "(1e40)", "9999999999999.99"], lambda x: S.parse_money(x).cast("string"), S.money_error) == [(None, "Invalid money amount: 10000000000000000.00"), (None, "Invalid money amount: (1e40)"), ("9999999999999.99", None)]


def test_trim_takes_all_white_space(spark):
    wide = "\t\n\x0b\f\r          　﻿"
    kept = "​\u0085᠎\x1f"
    texts = [wide + "a" + wide + "b" + wide, wide, kept + "a" + kept, "", None]
    assert values(spark, texts, S.trim, S.collapse) == [("a" + wide + "b", "a b"), ("", ""), (kept + "a" + kept,) * 2, ("", ""), (None, None)]
    assert values(spark, [c for c in wide + kept], lambda x: F.regexp_replace(x, S.WS, "")) == [""] * len(wide) + list(kept)


def test_nested_results_are_written_as_json_once(spark):
    for name in ("bank_envelopes", "municipal_envelopes"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("StructsToJsonEvaluator") == 1


def test_variants_are_parsed_once(spark):
    plan = queries.QUERIES["municipal_invoice_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def plain_layout(items):
    """Lines of a page's (text, x, y, width, height), one item after the other."""
    rows = []
    for text, x, y, width, height in sorted(items, key=lambda i: (-i[2], i[1], i[0])):
        row = next((r for r in rows if abs(r[0][2] - y) <= max(2, height / 2)), None)
        if row is None:
            rows.append(row := [])
        row.append((text, x, y, width, height))
    lines = []
    for row in rows:
        line, right = "", None
        for text, x, y, width, _ in sorted(row, key=lambda i: (i[1], -i[2], i[0])):
            gap = 0 if right is None else x - right
            line, right = line + ("  " if gap > 18 else " " if gap > 2 else "") + text, max(right or x + width, x + width)
        lines.append(line.strip())
    return "\n".join(lines)


def test_layout_of_crowded_and_tall_items(spark):
    """Rows closer than the items are high, and titles that reach over several rows."""
    rng = random.Random(3)
    pages = {f"d{d}": [(f"t{i}", float(rng.randrange(300)), rng.randrange(400) / 4, float(rng.randrange(1, 30)), rng.choice([1.0, 8.0, 8.0, 30.0])) for i in range(rng.choice([1, 3, 40]))] for d in range(40)}
    rows = [(d, 1, *i) for d, items in pages.items() for i in items]
    found = layout_documents(spark.createDataFrame(rows, ITEMS_SCHEMA)).collect()
    assert {r["doc_id"]: (r["text"], r["item_count"]) for r in found} == {d: (plain_layout(items), len(items)) for d, items in pages.items()}


def test_bands_of_one_row_are_not_laid_out_item_by_item(spark, capsys):
    """Items are cut without a function of arrays, and rows of their own aren't folded."""
    items = render.layout_items(spark.createDataFrame([("1", ["Total Due 12.00", "Amount"])], "doc_id string, lines array<string>"))
    assert sorted((r["text"], r["y"]) for r in items.collect()) == [("12.00", 801.0), ("Amount", 790.0), ("Total Due", 800.0)]
    items.explain("formatted")
    assert "lambda" not in capsys.readouterr().out
    layout_documents(items).explain("formatted")
    assert "band" in capsys.readouterr().out


def test_sections_in_any_order_and_amounts_without_digits_before_the_point(spark):
    """Payments run from their first heading to the end, whatever stands there; what a document has once is carried once."""
    head = "Account Number: 1\nBilling Period: 2026-01-01 to 2026-01-31\n"
    turned = head + "Payments:\n2026-01-02 | Paid | -5.00 | A\nCHARGES\n2026-01-03 Water 7.00 B"
    invoice = "TAX INVOICE Statement for January 2026\nAccount Number: 1\nPrevious Account Balance 0.00\nTotal Due 1.50\nInterest on Arrears .50\nWater\nAmount\nUsage 1.00"
    found = municipal.standard_text(spark.createDataFrame([("turned", turned), ("invoice", invoice)], "doc_id string, text string"))
    rows = {r["doc_id"]: r for r in found.collect()}
    items = lambda d: [(x["kind"], x["description"], str(x["amount"])) for x in rows[d]["items"]]
    assert items("turned") == [("charge", "Water", "7.00"), ("payment", "Paid", "-5.00"), ("payment", "Water", "7.00")]
    assert [w["message"] for w in rows["turned"]["warnings"]] == ["Skipped unrecognized line: CHARGES"]
    assert items("invoice") == [("charge", "Water: Usage", "1.00"), ("charge", "Interest on Arrears", "0.50")]
    assert "first(account_number" not in found._jdf.queryExecution().optimizedPlan().toString()
