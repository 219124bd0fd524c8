"""Statement documents rendered from the star-schema tables, to run the jobs on text of any amount.

The rules by which documents differ (layout, missing labels, wrong totals) follow from their keys, so what a job has to find
can be worked out from the tables alone.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, MONTHS

CATEGORIES = {"A": "Electricity", "N": "Water", "R": "Refuse"}


def money(x: Column) -> Column:
    return F.format_number(x.cast(MONEY), 2)


def spaced_money(x: Column) -> Column:
    return F.replace(money(x), F.lit(","), F.lit(" "))


def signed(x: Column, shown=money) -> Column:
    return F.concat(shown(F.abs(x)), F.when(x < 0, "Dr").otherwise("Cr"))


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m.capitalize()) for m in MONTHS]), F.month(day))


def day_month(day: Column) -> Column:
    return F.concat(F.lpad(F.day(day).cast("string"), 2, "0"), F.lit(" "), F.left(month_name(day), F.lit(3)))


def joined(*lines: Column) -> Column:
    """Lines with nulls left out."""
    return F.array_join(F.filter(F.flatten(F.array(*[x if isinstance(x, Column) else F.array(F.lit(x)) for x in lines])), lambda x: x.isNotNull()), "\n")


def one(x: Column) -> Column:
    return F.array(x)


def bank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a statement for each customer and year of orders. The layout is o_custkey % 4: pipe, spaced, compact,
    home loan. Every 7th customer's closing balance is 1.00 too high, every 11th's opening balance is absent (not in home
    loans), every 5th has a line that isn't a transaction, every 13th with the pipe layout an amount that isn't a number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    key, year = F.col("o_custkey"), F.year("o_orderdate").alias("year")
    amount = F.when(F.col("o_orderstatus") == "O", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast(MONEY)
    opening = (F.lit(1000) + key % 100 * 10).cast(MONEY)
    rows = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), year, amount.alias("amount"), opening.alias("opening"))
    running = Window.partitionBy("o_custkey", "year").orderBy("day", "o_orderkey")
    rows = rows.withColumns({"balance": (F.col("opening") + F.sum("amount").over(running.rowsBetween(Window.unboundedPreceding, 0))).cast(MONEY), "seq": F.row_number().over(running)})
    missing = (key % 11 == 0) & (key % 4 != 3)
    day, amount, balance, order = F.col("day"), F.col("amount"), F.col("balance"), F.col("o_orderkey").cast("string")
    printed = F.when((key % 13 == 0) & (F.col("seq") == 1), F.lit("n/a")).otherwise(money(amount))
    pipe = F.concat_ws(" | ", day.cast("string"), F.concat(F.lit("Order "), order), printed, money(balance), F.concat(F.lit("REF"), order))
    spaced = F.concat_ws(" ", F.date_format(day, "dd/MM/yyyy"), F.lit("Order payment"), money(amount), money(balance), F.concat(F.lit("REF"), order))
    compact = F.concat(day_month(day), F.when(missing, F.lit("Order payment")).otherwise(F.concat(F.lit("Ref"), order)), money(F.abs(amount)), F.when(amount > 0, "Cr").otherwise(""), signed(balance))
    loan = F.concat(day_month(day), F.lit(" "), F.year(day).cast("string"), F.lit("Instalment"), spaced_money(F.abs(amount)), signed(balance, spaced_money))
    line = F.when(key % 4 == 0, pipe).when(key % 4 == 1, spaced).when(key % 4 == 2, compact).otherwise(loan)
    docs = rows.groupBy("o_custkey", "year").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"),
        F.first("opening").alias("opening"),
        (F.first("opening") + F.sum("amount")).cast(MONEY).alias("closing"),
    )
    closing = (F.col("closing") + F.when(key % 7 == 0, 1).otherwise(0)).cast(MONEY)
    start, end = F.concat(F.col("year"), F.lit("-01-01")), F.concat(F.col("year"), F.lit("-12-31"))
    named = F.concat(F.lit("01 January "), "year", F.lit(" to 31 December "), "year")
    period = F.when(key % 4 == 3, F.concat(F.lit("Home Loan Transaction History from "), named)).when(key % 4 == 2, F.concat(F.lit("Statement Period : "), named)).otherwise(F.concat(F.lit("Period: "), start, F.lit(" - "), end))
    opens = F.when(missing, F.array().cast("array<string>")).when(key % 4 == 2, F.array(F.lit("Opening Balance"), signed(F.col("opening")))).otherwise(F.array(F.concat(F.lit("Opening Balance: "), signed(F.col("opening")))))
    heading = F.when(key % 4 != 3, F.lit("Transactions in RAND (ZAR)"))
    account = F.concat(F.lit("Account Number: "), F.lpad(key.cast("string"), 11, "0"))
    closes, junk = F.concat(F.lit("Closing Balance: "), signed(closing)), F.when(key % 5 == 0, F.lit("see overleaf for terms"))
    # a home loan's period line also opens the section, so its balances stand before
    loan_head = [one(account), opens, one(closes), one(period)]
    head = F.when(key % 4 == 3, joined(*loan_head)).otherwise(joined(one(account), one(period), opens, one(closes), one(heading)))
    text = F.concat_ws("\n", head, joined(F.col("lines"), one(junk)), F.lit("Turnover for Statement Period"))
    return docs.select(F.concat_ws("-", key.cast("string"), F.col("year").cast("string")).alias("doc_id"), text.alias("text"))


def municipal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: k (its key), month, opening, charges (category, amount) by line, net, vat, paid, interest and
    closing. A payment of 500.00 every 3rd order, interest of 15.00 every 5th."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.trunc("o_orderdate", "month").alias("month"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("amount"))
    category = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in CATEGORIES.items()], F.lit("Sewerage"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "amount", category.alias("category"))))
    bills = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(lines, lambda x: F.struct(x["category"].alias("category"), x["amount"].alias("amount"))).alias("charges"), F.sum("amount").cast(MONEY).alias("net"))
    out = orders.join(bills, "k")
    k = F.col("k")
    out = out.withColumns({"vat": F.round(F.col("net") * F.lit("0.15").cast("decimal(4,2)"), 2).cast(MONEY), "opening": (F.lit(1000) + k % 100).cast(MONEY), "paid": F.when(k % 3 == 0, 500).otherwise(0).cast(MONEY), "interest": F.when(k % 5 == 0, 15).otherwise(0).cast(MONEY)})
    return out.withColumn("closing", (F.col("opening") + F.col("net") + F.col("vat") + F.col("interest") - F.col("paid")).cast(MONEY))


def section_documents(base: DataFrame) -> DataFrame:
    """(doc_id, text) in sections; pipe lines for even keys, spaced ones for odd. Every 7th closes 1.00 too high."""
    k, day = F.col("k"), F.date_format("month", "yyyy-MM-dd")
    line = lambda what, amount, ref: F.when(k % 2 == 0, F.concat_ws(" | ", day, what, money(amount), ref)).otherwise(F.concat_ws(" ", day, what, money(amount), ref))
    charges = F.concat(F.transform("charges", lambda c: line(c["category"], c["amount"], F.lit("METER"))), F.array(line(F.lit("VAT"), F.col("vat"), F.lit("TAX"))), F.array(F.when(F.col("interest") > 0, line(F.lit("Interest on Arrears"), F.col("interest"), F.lit("ARREARS")))))
    paid = F.when(F.col("paid") > 0, line(F.lit("Payment received"), -F.col("paid"), F.lit("EFT")))
    closing = F.col("closing") + F.when(k % 7 == 0, 1).otherwise(0)
    period = F.concat(F.lit("Billing Period: "), day, F.lit(" to "), F.date_format(F.last_day("month"), "yyyy-MM-dd"))
    text = joined(one(F.concat(F.lit("Account Number: "), k.cast("string"))), one(period), one(F.concat(F.lit("Opening Balance: R"), money(F.col("opening")))), one(F.concat(F.lit("Closing Balance: R"), money(closing))), one(F.lit("Charges:")), one(F.lit("Date Description Amount Reference")), charges, one(F.lit("Payments:")), one(paid))
    return base.select(k.cast("string").alias("doc_id"), text.alias("text"))


def invoice_lines(total_off: Column, vat_off: Column, opening_shown: Column, closing: Column | None = None, opening: Column | None = None) -> Column:
    """The lines of an order's tax invoice; summary amounts inline for even keys, as a block for odd ones."""
    k = F.col("k")
    opening, closing = F.col("opening") if opening is None else opening, F.col("closing") if closing is None else closing
    labels = ["Previous Account Balance", "Current Charges (Excl. VAT)", "VAT @ 15%", "Total Due"]
    amounts = [money(opening), money(F.col("net")), money(F.col("vat") + vat_off), money(closing + total_off)]
    shown = [opening_shown, F.lit(True), F.lit(True), F.lit(True)]
    inline = F.array(*[F.when(s, F.concat(F.lit(f"{label} "), a)) for label, a, s in zip(labels, amounts, shown, strict=True)])
    block = F.array(*[F.when(s, F.lit(label)) for label, s in zip(labels, shown, strict=True)], *[F.when(s, a) for a, s in zip(amounts, shown, strict=True)])
    charge = lambda c: F.array(F.concat(c["category"], F.lit("VAT 4760117194Sub - TotalTotal")), F.lit("Amount"), F.concat(F.lit("Usage charge "), money(c["amount"])))
    extras = F.array(F.when(F.col("paid") > 0, F.concat(F.lit("Less: Incoming Payment "), money(F.col("paid")))), F.when(F.col("interest") > 0, F.concat(F.lit("Interest on Arrears "), money(F.col("interest")))))
    head = F.array(F.concat(F.lit("TAX INVOICE  Statement for "), month_name(F.col("month")), F.lit(" "), F.year("month").cast("string")), F.concat(F.lit("Account Number: "), k.cast("string")))
    vat = F.array(F.concat(F.lit("VAT: 15.00% "), money(F.col("vat")), F.lit(" "), money(F.col("net") + F.col("vat"))))
    return F.filter(F.flatten(F.array(head, F.when((k % 2 == 0) | ~opening_shown, inline).otherwise(block), extras, F.flatten(F.transform("charges", charge)), vat)), lambda x: x.isNotNull())


def invoice_documents(base: DataFrame) -> DataFrame:
    """(doc_id, lines, text): every 7th has 1.00 too much VAT in its summary, every 11th a total 5.00 too high, every 13th no
    previous balance."""
    k = F.col("k")
    lines = invoice_lines(F.when(k % 11 == 0, 5).otherwise(0), F.when(k % 7 == 0, 1).otherwise(0), k % 13 != 0)
    return base.select(k.cast("string").alias("doc_id"), lines.alias("lines")).withColumn("text", F.array_join("lines", "\n"))


def xfa_documents(base: DataFrame, shift: Column | None = None, account: Column | None = None) -> DataFrame:
    """(doc_id, xml): shift moves both balances, account false leaves the number out. For odd keys VAT is an item, for even
    ones only in the summary."""
    k, shift = F.col("k"), F.lit(0) if shift is None else shift
    tag = lambda name, x: F.concat(F.lit(f"<b:{name}>"), x, F.lit(f"</b:{name}>"))
    entry = lambda label, amount: tag("SummaryBreakdown", F.concat(tag("Description", F.lit(label)), tag("Amount", money(amount))))
    row = lambda text, amount: tag("CategoryLineItem", F.concat(tag("ItemDescription", text), tag("ItemAmount", money(amount))))
    group = lambda name, rows: tag("CategoryType", F.concat(tag("CategoryName", name), tag("CategoryTable", rows)))
    entries = F.concat(entry("Previous Account Balance", F.col("opening") + shift), entry("Current Charges (Excl. VAT)", F.col("net")), entry("VAT @ 15%", F.col("vat")), F.when(F.col("paid") > 0, entry("Less: Incoming Payment", F.col("paid"))).otherwise(""), F.when(F.col("interest") > 0, entry("Interest on Arrears", F.col("interest"))).otherwise(""))
    last = F.element_at("charges", -1)["category"]
    charges = F.concat(F.array_join(F.transform("charges", lambda c: group(c["category"], row(F.lit("Usage charge"), c["amount"]))), ""), F.when(k % 2 == 1, group(last, row(F.lit("VAT 15.00%"), F.col("vat")))).otherwise(""))
    number = tag("AccountNumber", k.cast("string"))
    number = number if account is None else F.when(account, number).otherwise("")
    header = tag("BillHeader", F.concat(tag("PersonalDetails", tag("Period", F.date_format("month", "yyyy-MM"))), tag("InvoiceDetails", F.concat(tag("InvoiceNumber", F.lit("R&amp;D 1")), number))))
    summary = tag("Summary", tag("BillSummaryDetails", F.concat(tag("TotalDue", money(F.col("closing") + shift)), entries)))
    xml = F.concat(F.lit("<xfa:datasets><xfa:data>\n "), tag("Bill", F.concat(header, F.lit("\n  "), summary, tag("Body", charges))), F.lit("</xfa:data></xfa:datasets>"))
    return base.select(k.cast("string").alias("doc_id"), xml.alias("xml"))


def faulty_forms(base: DataFrame) -> DataFrame:
    """(doc_id, xml), by k % 8: 1 an unreadable item outside every category, 2 an item's month misspelt, 3 the bill's, 4 arrears
    that aren't an amount and no previous balance, 5 such arrears beside a previous balance, 6 an unreadable summary amount
    and an unreadable item, 7 a misspelt month on an item of zero."""
    k = F.col("k") % 8
    forms = xfa_documents(base).join(base.select(F.col("k").cast("string").alias("doc_id"), "k"), "doc_id")
    put = lambda xml, after, text: F.replace(xml, F.lit(after), F.lit(after + text))
    item = lambda amount, more="": f"<b:CategoryLineItem><b:ItemDescription>Extra</b:ItemDescription><b:ItemAmount>{amount}</b:ItemAmount>{more}</b:CategoryLineItem>"
    within = lambda inner: f"<b:CategoryType><b:CategoryName>Extra</b:CategoryName>{inner}</b:CategoryType>"
    body, details = "<b:Body>", "<b:BillSummaryDetails>"
    arrears = "<b:Arrears><b:TotalOutstanding>n/a</b:TotalOutstanding></b:Arrears>"
    month = "<b:ItemDate>Smarch 2024</b:ItemDate>"
    xml = F.col("xml")
    xml = F.when(k == 1, put(xml, body, item("n/a"))).when(k == 2, put(xml, body, within(item("1.00", month)))).when(k == 3, put(xml, "<b:PersonalDetails>", "<b:Date>Smarch 2024</b:Date>")).when(
        k == 4, F.replace(put(xml, details, arrears), F.lit("Previous Account Balance"), F.lit("Earlier balance"))
    ).when(k == 5, put(xml, details, arrears)).when(k == 6, put(put(xml, body, within(item("n/a"))), details, "<b:SummaryBreakdown><b:Description>Other</b:Description><b:Amount>x/y</b:Amount></b:SummaryBreakdown>")).when(
        k == 7, put(xml, body, within(item("0.00", month)))
    ).otherwise(xml)
    return forms.select("doc_id", xml.alias("xml"))


def invoice_variants(base: DataFrame) -> DataFrame:
    """(doc_id, text) of tax invoices with labels elsewhere, by k % 4: 0 the total due two lines below its label, 1 the month
    as a billing period, and each charge with that of another year, 2 the month by a date alone and the account number by the
    short label, 3 the amount outstanding in place of the total due."""
    k, month = F.col("k"), F.col("month")
    label = lambda text, amount: F.array(F.concat(F.lit(f"{text} "), money(amount)))
    title = F.array(F.when(k % 4 == 1, F.concat(F.lit("( Billing Period "), F.date_format(month, "yyyy/MM"), F.lit(" )"))), F.lit("TAX INVOICE"), F.when(k % 4 == 2, F.lit("Statement for")).otherwise(F.concat(F.lit("Statement for "), month_name(month), F.lit(" "), F.year(month).cast("string"))))
    account = F.when(k % 4 == 2, F.array(F.lit("Account Number: see below"), F.concat(F.lit("Acc. No.: "), k.cast("string")), F.concat(F.lit("Date "), F.date_format(month, "yyyy/MM/dd")))).otherwise(F.array(F.concat(F.lit("Account Number: "), k.cast("string"))))
    due = F.when(k % 4 == 0, F.array(F.lit("Total Due"), F.lit("by the last day"), F.lit("of next month"), money(F.col("closing")))).when(k % 4 == 3, label("TOTAL AMOUNT OUTSTANDING", F.col("closing"))).otherwise(label("Total Due", F.col("closing")))
    summary = F.concat(label("Previous Account Balance", F.col("opening")), label("Current Charges (Excl. VAT)", F.col("net")), label("VAT @ 15%", F.col("vat")), due)
    extras = F.array(F.when(F.col("paid") > 0, F.concat(F.lit("Less: Incoming Payment "), money(F.col("paid")))), F.when(F.col("interest") > 0, F.concat(F.lit("Interest on Arrears "), money(F.col("interest")))))
    charge = lambda c: F.array(F.concat(c["category"], F.lit("VAT 4760117194Sub - TotalTotal")), F.concat(F.lit("Usage charge "), F.when(k % 4 == 1, F.lit("( Billing Period 2001/02 ) ")).otherwise(""), money(c["amount"])))
    vat = F.array(F.concat(F.lit("VAT: 15.00% "), money(F.col("vat"))))
    return base.select(k.cast("string").alias("doc_id"), joined(title, account, summary, extras, F.flatten(F.transform("charges", charge)), vat).alias("text"))


def layout_items(lines: DataFrame) -> DataFrame:
    """Positioned items of (doc_id, lines): each line is a row; its last word, where it is an amount, is an item of its own one
    unit higher; items are in no order."""
    rows = lines.select("doc_id", F.posexplode("lines").alias("n", "line")).withColumn("right", F.regexp_extract("line", r"^.*\D (-?[\d,]+\.\d{2})$", 1))
    split, right = F.col("right") != "", F.col("right")
    rows = rows.withColumn("left", F.when(split, F.left("line", F.length("line") - F.length("right") - 1)).otherwise(F.col("line")))
    part = lambda text, x, dy: F.struct(text.alias("text"), x.cast("double").alias("x"), (F.lit(800) - F.col("n") * 10 + dy).cast("double").alias("y"), (F.length(text) * 5).cast("double").alias("width"), F.lit(8.0).alias("height"))
    left = part(F.col("left"), F.lit(10), F.lit(0))
    parts = F.when(split, F.array(left, part(right, F.length("left") * 5 + 20, F.lit(1)))).otherwise(F.array(left))
    flat = rows.select("doc_id", F.lit(1).alias("page"), F.explode(parts).alias("p"))
    return flat.select("doc_id", "page", "p.*")


def pdf_files(docs: DataFrame, xml: DataFrame) -> DataFrame:
    """(doc_id, content) with text lines as literals and the dataset as an uncompressed stream; every 9th key isn't a PDF."""
    safe = F.regexp_replace("text", r"([()\\])", r"\\$1")
    literals = F.array_join(F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit("("), x, F.lit(") Tj"))), "\n")
    start = F.when(F.col("doc_id").cast("long") % 9 == 0, "%XXX").otherwise("%PDF-1.7")
    content = F.concat(start, F.lit("\n"), literals, F.lit("\n1 0 obj\nstream\n"), "xml", F.lit("\nendstream\nendobj\n"))
    return docs.join(xml, "doc_id").select("doc_id", F.encode(content, "UTF-8").alias("content"))


def packed_files(xml: DataFrame) -> DataFrame:
    """(doc_id, content) with the dataset in a stream after one of other things, by key: 0 as it is, 1 zlib, 2 gzip, 3 raw deflate,
    4 zlib without its last bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = lambda x: (c := zlib.compressobj(wbits=-zlib.MAX_WBITS)).compress(x) + c.flush()
        ways = [lambda x: x, zlib.compress, gzip.compress, raw, lambda x: zlib.compress(x)[:-6]]
        wrap = lambda x: b"1 0 obj\nstream\r\n" + x + b"\nendstream\nendobj\n"
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            files = [b"%PDF-1.7\n" + wrap(b"<a>other</a>") + wrap(ways[int(doc) % 5](x.encode())) for doc, x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    return xml.select("doc_id", "xml").mapInArrow(pack, "doc_id string, content binary")
