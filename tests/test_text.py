"""Scalars and text preparation."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions.text import line_array, normalize_text, text_or_fallback
from ledgerloom.operators.bank import amount_variants, money_tokens


def values(spark, texts, *makes):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows = df.select("i", *[make(F.col("x")).alias(f"v{k}") for k, make in enumerate(makes)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(makes) > 1 else r[1] for r in rows]


def test_money(spark):
    texts = ["R1,250.00", "ZAR 3 000.5", "(12.30)", "", "R", "1e2", "x", None, "12.345", "-0.005"]
    assert values(spark, texts, S.parse_money) == [Decimal("1250.00"), Decimal("3000.50"), Decimal("-12.30"), Decimal("0.00"), Decimal("0.00"), Decimal("100.00"), None, None, Decimal("12.35"), Decimal("0.00")]
    assert values(spark, ["5.00 Dr", "5.00cr", "-5.00 Cr", "5.00"], S.parse_signed_money, S.parse_transaction_amount) == [(Decimal("-5.00"), Decimal("-5.00")), (Decimal("5.00"), Decimal("5.00")), (Decimal("5.00"), Decimal("5.00")), (Decimal("5.00"), Decimal("-5.00"))]
    assert values(spark, ["a ( 1,2.00 ) b", "x - 1 300.11", "2026/05/02 1,000.00", "none"], S.first_money, S.trailing_money) == [(Decimal("-12.00"), None), (Decimal("-1300.11"), Decimal("300.11")), (Decimal("21000.00"), Decimal("1000.00")), (None, None)]


def test_equality_keeps_the_binary_quirk(spark):
    rows = spark.createDataFrame([(Decimal("1000.01"), Decimal("1000.00")), (Decimal("0.02"), Decimal("0.01")), (Decimal("5.00"), Decimal("5.02"))], "a decimal(18,2), b decimal(18,2)")
    assert [r[0] for r in rows.select(S.amounts_equal(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_dates(spark):
    assert values(spark, ["2026-13-45", "05/01/2026", "5 Marchy 2026", "x", None], S.parse_bank_date) == ["2026-13-45", "2026-01-05", "2026-03-05", None, None]
    assert values(spark, ["2026/02", "2026/02/09", "February 2024", "Feb 2024", "2026/13"], lambda x: S.last_day(S.parse_month(x)), S.month_error) == [("2026-02-28", None), ("2026-02-28", None), ("2024-02-29", None), (None, "Invalid month: Feb"), (None, "Invalid statement month: 2026/13")]
    assert values(spark, ["20 Dec", "05 Jan", "07 Jul"], lambda x: S.date_in_period(x, F.lit("2025-12-15"), F.lit("2026-01-14"))) == ["2025-12-20", "2026-01-05", "2026-07-07"]


def test_text(spark):
    assert values(spark, [" a \r\n\r\n﻿ b\rc ", "", None], normalize_text) == ["a\nb\nc", "", None]
    assert values(spark, ["a\n \n b"], line_array) == [["a", "b"]]
    docs = spark.createDataFrame([("a", "x ", None), ("b", "", b"(one \\(1\\)) Tj\n(\\n) Tj (two)  Tj (no)"), ("c", None, b"none")], "doc_id string, text string, content binary")
    assert [(r.text, r.error_code) for r in text_or_fallback(docs).orderBy("doc_id").collect()] == [("x", None), ("one (1)\ntwo", None), (None, "PDF_TEXT_EXTRACTION_FAILED")]


def test_long_literals(spark):
    long = b"x" * 1_000_000
    docs = spark.createDataFrame([("a", None, b"(" + long + b") Tj"), ("b", None, b"(" + long), ("c", None, b"(" + b"\\(" * 200_000 + b") Tj")], "doc_id string, text string, content binary")
    assert [(len(r.text or ""), r.error_code) for r in text_or_fallback(docs).orderBy("doc_id").collect()] == [(1_000_000, None), (0, "PDF_TEXT_EXTRACTION_FAILED"), (200_000, None)]


def test_tokens(spark):
    assert values(spark, ["Ref123451,500.003,419.57Cr"], money_tokens) == [["Ref", "123451,500.00\x02", "3,419.57\x02Cr"]]
    one = spark.range(1).select(amount_variants(F.lit(Decimal("1500.00")))).collect()[0][0]
    assert one == ["1,500.00", "1 500.00", "1500.00"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=2), min_size=1, max_size=20))
def test_money_round_trip(spark, amounts):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, a decimal(18,2)")
    shown = F.concat(F.format_number(F.abs("a"), 2), F.when(F.col("a") < 0, "Dr").otherwise("Cr"))
    assert df.where(S.parse_signed_money(shown) != F.col("a")).isEmpty()
