"""The registered queries of the statement jobs and their DuckDB SQL.

Each renders documents from the tables, parses the text, and returns what it found. The SQL works the same results out from
the tables, without any text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_money_text, parse_number
from ..functions.text import explode_lines, normalize_text, text_or_fallback
from ..operators import municipal, xfa
from ..operators.bank import money_tokens
from ..operators.layout import layout_documents
from ..sources.readers import read_extracted_text, read_layout_items, read_pdf_files
from ..sources.shared import new_table
from ..sources.streams import NO_DATASET, xfa_datasets
from ..sources.writers import bank_csv_rows, csv_line, municipal_csv_rows, write_text_files
from . import render
from .jobs import bank_envelope, bank_job, corpus_report, envelope, municipal_job, stored_bank_job, strategy_report

_ADOBE = "This form requires Adobe Reader 8 or higher\nsee go/pdf_forms_configure"


def cents(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)").cast("decimal(20,2)").__mul__(100).cast("long")


def _digest(x: str | Column) -> Column:
    """SHA-256 of a text, so that texts that are held against each other needn't be shuffled."""
    return F.sha2((F.col(x) if isinstance(x, str) else x).cast("binary"), 256)


def _bank(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return bank_job(render.bank_documents(spark, sf_dir))


def bank_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _bank(spark, sf_dir)["results"]
    status = lambda name: F.try_element_at(F.transform(F.filter("checks", lambda c: c["name"] == name), lambda c: c["status"]), F.lit(1))
    shown = lambda x: F.when(F.col("ok"), x)
    header = [shown(F.col(c)).alias(c) for c in ("account_number", "period_from", "period_to")]
    return done.select("doc_id", *header, shown(cents("opening_balance")).alias("opening_cents"), shown(cents("closing_balance")).alias("closing_cents"), "ok", "confidence", F.coalesce(shown(F.col("n_lines")), F.lit(0)).alias("n_lines"), shown(cents("total")).alias("total_cents"), status("statement-balance-reconciliation").alias("status"), status("running-balance-reconciliation").alias("running"))


_BANK = """
WITH r AS (
  SELECT o_custkey AS k, year(o_orderdate) AS y, o_orderdate::DATE AS d, o_orderkey AS o,
    CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CAST(1000 + o_custkey % 100 * 10 AS DECIMAL(18,2)) AS opening FROM orders),
l AS (
  SELECT *, k || '-' || y AS doc_id, row_number() OVER w - 1 AS seq, opening + sum(amount) OVER w AS balance,
    k % 11 = 0 AND k % 4 <> 3 AS missing, k % 13 = 0 AND k % 4 = 0 AS bad
  FROM r WINDOW w AS (PARTITION BY k, y ORDER BY d, o ROWS UNBOUNDED PRECEDING)),
s AS (
  SELECT k, y, doc_id, any_value(missing) AS missing, any_value(bad) AS bad, any_value(opening) AS opening, count(*) AS n, sum(amount) AS total,
    any_value(opening) + sum(amount) + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS closing
  FROM l GROUP BY k, y, doc_id)
"""
BANK_RECONCILIATION = (
    _BANK
    + """
SELECT doc_id, CASE WHEN NOT bad THEN lpad(k::VARCHAR, 11, '0') END AS account_number, CASE WHEN NOT bad THEN y || '-01-01' END AS period_from,
  CASE WHEN NOT bad THEN y || '-12-31' END AS period_to, CASE WHEN NOT bad AND NOT missing THEN (opening * 100)::BIGINT END AS opening_cents,
  CASE WHEN NOT bad THEN (closing * 100)::BIGINT END AS closing_cents, NOT bad AS ok,
  CASE WHEN bad THEN 'low' WHEN NOT missing AND k % 7 = 0 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN bad THEN 0 ELSE n END AS n_lines, CASE WHEN NOT bad THEN (total * 100)::BIGINT END AS total_cents,
  CASE WHEN bad THEN NULL WHEN missing THEN 'skipped' WHEN k % 7 = 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN NOT bad THEN 'passed' END AS running
FROM s
"""
)


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bank(spark, sf_dir)["lines"].select("doc_id", "kind", "seq", "date", "description", cents("amount").alias("amount_cents"), "currency", cents("balance").alias("balance_cents"), "reference")


_DESCRIBED = """CASE k % 4 WHEN 0 THEN 'Order ' || o WHEN 1 THEN 'Order payment' WHEN 2 THEN CASE WHEN missing THEN 'Order payment' ELSE 'Ref' || o END
  ELSE 'Instalment' END AS description"""
BANK_LINES = (
    _BANK
    + f"""
SELECT doc_id, 'transaction' AS kind, seq, d::VARCHAR AS date, {_DESCRIBED},
  (amount * 100)::BIGINT AS amount_cents, 'ZAR' AS currency, (balance * 100)::BIGINT AS balance_cents, CASE WHEN k % 4 < 2 THEN 'REF' || o END AS reference
FROM l WHERE NOT bad
"""
)


def bank_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested results as JSON, and what stands in a few of their places."""
    docs = render.bank_documents(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("in/bank/"), "doc_id", F.lit(".pdf")))
    nested = bank_envelope(bank_job(docs)["results"], "bank")
    nested = nested.withColumn("json", F.to_json(F.struct(*[c for c in nested.columns if c != "doc_id"])))  # written once
    at = lambda path: F.get_json_object("json", path)
    return nested.select("doc_id", at("$.metadata.sourceFileName").alias("source_file_name"), at("$.ok").alias("ok"), at("$.data.institution").alias("institution"), at("$.data.accountNumberMasked").alias("account"), at("$.data.period.to").alias("period_to"), at("$.data.transactions[0].date").alias("first_date"), at("$.errors[0].code").alias("code"), at("$.metadata.confidence").alias("confidence"), at("$.metadata.checks[0].status").alias("status"), F.size("data.transactions").cast("long").alias("n_transactions"))


BANK_ENVELOPES = (
    _BANK
    + """
SELECT 'in/bank/' || doc_id || '.pdf' AS doc_id, doc_id || '.pdf' AS source_file_name,
  CASE WHEN bad THEN 'false' ELSE 'true' END AS ok, CASE WHEN NOT bad THEN 'FNB' END AS institution,
  CASE WHEN NOT bad THEN lpad(k::VARCHAR, 11, '0') END AS account, CASE WHEN NOT bad THEN y || '-12-31' END AS period_to,
  CASE WHEN NOT bad THEN (SELECT min(d) FROM l WHERE l.doc_id = s.doc_id)::VARCHAR END AS first_date,
  CASE WHEN bad THEN 'PARSE_FAILED' END AS code, CASE WHEN bad THEN 'low' WHEN NOT missing AND k % 7 = 0 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN bad THEN NULL WHEN missing THEN 'skipped' WHEN k % 7 = 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE WHEN NOT bad THEN n END AS n_transactions
FROM s
"""
)


def bank_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bank(spark, sf_dir)["issues"]


BANK_ISSUES = (
    _BANK
    + r"""
, plain AS (SELECT *, regexp_replace(regexp_replace((opening + total)::DECIMAL(18,2)::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', '') AS expected,
    regexp_replace(regexp_replace(closing::DECIMAL(18,2)::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', '') AS parsed FROM s)
SELECT doc_id, 'error' AS level, 0 AS seq, 'PARSE_FAILED' AS code, 'Invalid money amount: n/a' AS message FROM s WHERE bad
UNION ALL SELECT doc_id, 'warning', 0, 'FNB_TRANSACTION_SKIPPED', 'Skipped unrecognized transaction line: see overleaf for terms' FROM s WHERE NOT bad AND k % 5 = 0
UNION ALL SELECT doc_id, 'warning', CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, 'FNB_RECONCILIATION_FAILED', 'Expected closing balance ' || expected || '; parsed ' || parsed || '.'
FROM plain WHERE NOT bad AND NOT missing AND k % 7 = 0
"""
)


def bank_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_csv_rows(_bank(spark, sf_dir)["lines"])
    return rows.select("doc_id", "seq", csv_line("date", "description", "amount", "currency", "balance", "reference").alias("csv"))


BANK_CSV = (
    _BANK
    + rf"""
, t AS (SELECT *, {_DESCRIBED} FROM l WHERE NOT bad)
SELECT doc_id, seq, concat_ws(',', d::VARCHAR, description, regexp_replace(regexp_replace(amount::DECIMAL(18,2)::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', ''), 'ZAR',
  regexp_replace(regexp_replace(balance::DECIMAL(18,2)::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', ''), CASE WHEN k % 4 < 2 THEN 'REF' || o ELSE '' END) AS csv FROM t
"""
)


def bank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_report(_bank(spark, sf_dir)["results"])


BANK_REPORT = (
    _BANK
    + """
SELECT NOT bad AS ok, CASE WHEN bad THEN 'low' WHEN NOT missing AND k % 7 = 0 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN bad THEN 'PARSE_FAILED' ELSE '' END AS error_code, count(*) AS documents, count(DISTINCT CASE WHEN NOT bad THEN k END) AS accounts,
  sum(CASE WHEN bad THEN 0 ELSE n END)::BIGINT AS n_lines
FROM s GROUP BY ALL
"""
)


def _municipal_rows(results: DataFrame, *more: Column) -> DataFrame:
    count = lambda kind: F.size(F.filter("items", lambda x: x["kind"] == kind)).cast("long")
    total = F.aggregate("items", F.lit(0).cast("decimal(18,2)"), lambda s, x: (s + x["amount"]).cast("decimal(18,2)"))
    shown = lambda c: F.when(F.col("ok"), c)
    code = F.coalesce("code", F.lit("")) if "code" in results.columns else F.lit("")
    return results.select("doc_id", "ok", F.when(F.col("ok"), "").otherwise(code).alias("code"), shown(F.col("account_number")).alias("account_number"), shown(F.col("period_from")).alias("period_from"), shown(F.col("period_to")).alias("period_to"), shown(cents("opening_balance")).alias("opening_cents"), shown(cents("closing_balance")).alias("closing_cents"), shown(count("charge")).alias("n_charges"), shown(count("payment")).alias("n_payments"), shown(cents(total)).alias("total_cents"), *more)


_MUNICIPAL = """
WITH i AS (SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem),
b AS (
  SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS month, n, net, round(net * 0.15, 2)::DECIMAL(18,2) AS vat,
    (1000 + o_orderkey % 100)::DECIMAL(18,2) AS opening, CASE WHEN o_orderkey % 3 = 0 THEN 500 ELSE 0 END::DECIMAL(18,2) AS paid,
    CASE WHEN o_orderkey % 5 = 0 THEN 15 ELSE 0 END::DECIMAL(18,2) AS interest
  FROM orders JOIN (SELECT k, count(*) AS n, sum(amount) AS net FROM i GROUP BY k) x ON x.k = o_orderkey),
c AS (SELECT *, net + vat + interest - paid AS total, k::VARCHAR AS doc_id FROM b)
"""
_HEAD = "month::VARCHAR AS period_from, last_day(month)::VARCHAR AS period_to"


def _rows_sql(ok: str, code: str, closing: str = "opening + total", opening: str = "opening", account: str = "doc_id") -> str:
    when = lambda x, name: f"CASE WHEN {ok} THEN {x} END AS {name}"
    return f"""
SELECT doc_id, {ok} AS ok, {code} AS code, {when(account, "account_number")}, {when("month::VARCHAR", "period_from")},
  {when("last_day(month)::VARCHAR", "period_to")}, {when(f"(({opening}) * 100)::BIGINT", "opening_cents")}, {when(f"(({closing}) * 100)::BIGINT", "closing_cents")},
  {when("n + 1 + (interest > 0)::BIGINT", "n_charges")}, {when("(paid > 0)::BIGINT", "n_payments")}, {when("(total * 100)::BIGINT", "total_cents")}
FROM c
"""


def municipal_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.section_documents(render.municipal_base(spark, sf_dir))
    return _municipal_rows(municipal.standard_text(docs))


MUNICIPAL_SECTIONS = _MUNICIPAL + _rows_sql("true", "''", "opening + total + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END")


def municipal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = municipal_job(text=render.section_documents(render.municipal_base(spark, sf_dir)))["results"]
    warned = F.size(F.filter("warnings", lambda w: w["code"] == "EJOBURG_RECONCILIATION_FAILED")).cast("long")
    return done.select("doc_id", "status", "confidence", "review_required", F.size("warnings").cast("long").alias("n_warnings"), warned.alias("n_reconciliation"), F.element_at("checks", 1)["status"].alias("closes"))


MUNICIPAL_CHECKS = (
    _MUNICIPAL
    + """
SELECT doc_id, 'single-success' AS status, CASE WHEN k % 7 = 0 THEN 'medium' ELSE 'high' END AS confidence, true AS review_required,
  CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS n_warnings, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS n_reconciliation,
  CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'passed' END AS closes FROM c
"""
)


def municipal_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = municipal_job(text=render.section_documents(render.municipal_base(spark, sf_dir)))["lines"]
    return municipal_csv_rows(lines).select("doc_id", "seq", csv_line("type", "date", "description", "amount", "currency", "reference").alias("csv"))


MUNICIPAL_CSV = (
    _MUNICIPAL
    + r"""
, x AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, amount) - 1 AS seq, 'charge' AS kind, amount, 'METER' AS ref,
    CASE l_returnflag WHEN 'A' THEN 'Electricity' WHEN 'N' THEN 'Water' WHEN 'R' THEN 'Refuse' ELSE 'Sewerage' END AS what FROM i
  UNION ALL SELECT k, n, 'charge', vat, 'TAX', 'VAT' FROM c
  UNION ALL SELECT k, n + 1, 'charge', interest, 'ARREARS', 'Interest on Arrears' FROM c WHERE interest > 0
  UNION ALL SELECT k, n + 1 + (interest > 0)::BIGINT, 'payment', -paid, 'EFT', 'Payment received' FROM c WHERE paid > 0)
SELECT c.doc_id, x.seq, concat_ws(',', kind, month::VARCHAR, what, regexp_replace(regexp_replace(amount::DECIMAL(18,2)::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', ''), 'ZAR', ref) AS csv
FROM x JOIN c USING (k)
"""
)
_GATED = "NOT (k % 13 = 0 OR k % 7 = 0 OR k % 11 = 0)"
_GATE_CODE = """CASE WHEN k % 13 = 0 THEN 'EJOBURG_STRATEGY_MISSING_BALANCES' WHEN k % 7 = 0 THEN 'EJOBURG_STRATEGY_CHARGE_RECONCILIATION_FAILED'
  WHEN k % 11 = 0 THEN 'EJOBURG_STRATEGY_BALANCE_RECONCILIATION_FAILED' ELSE '' END"""


def municipal_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _municipal_rows(municipal.standard_text(render.invoice_documents(render.municipal_base(spark, sf_dir))))


MUNICIPAL_INVOICES = _MUNICIPAL + _rows_sql(_GATED, _GATE_CODE)


def municipal_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = render.layout_items(render.invoice_documents(render.municipal_base(spark, sf_dir)))
    return _municipal_rows(municipal.layout_text(layout_documents(items)))


def municipal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = render.xfa_documents(render.municipal_base(spark, sf_dir), account=F.col("k") % 6 != 1)
    none = F.lit(None).cast("string")
    return _municipal_rows(xfa.xfa_dataset(xml.withColumns({"error_code": none, "error_message": none})))


MUNICIPAL_FORMS = _MUNICIPAL + _rows_sql("true", "''", account="CASE WHEN k % 6 <> 1 THEN doc_id END")


def _three_strategies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Text is a viewer's placeholder for every 4th order, the dataset absent for every 5th and its balances 100.00 higher for
    every 17th, positioned items absent for every 3rd."""
    base, k = render.municipal_base(spark, sf_dir), F.col("doc_id").cast("long")
    invoices = render.invoice_documents(base)
    xml = render.xfa_documents(base, shift=F.when(F.col("k") % 17 == 0, 100).otherwise(0), account=F.col("k") % 6 != 1)
    xml = xml.withColumns({"xml": F.when(k % 5 != 4, F.col("xml")), "error_code": F.when(k % 5 == 4, NO_DATASET[0]), "error_message": F.when(k % 5 == 4, NO_DATASET[1])})
    return municipal_job(text=invoices.withColumn("text", F.when(k % 4 == 0, _ADOBE).otherwise(F.col("text"))), xml=xml, items=render.layout_items(invoices.where(k % 3 != 2)))


def municipal_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _three_strategies(spark, sf_dir)["results"]
    return done.select("doc_id", "status", "ok", "selected_strategy", "review_required", "confidence", F.coalesce("code", F.lit("")).alias("code"), F.array_join("successful_strategies", ",").alias("successful"), cents("closing_balance").alias("closing_cents"))


_STRATEGIES = (
    _MUNICIPAL
    + f"""
, o AS (SELECT *, {_GATED} AND k % 4 <> 0 AS text_ok, k % 5 <> 4 AS xml_ok, {_GATED} AND k % 3 <> 2 AS layout_ok, k % 2 = 1 AND k % 17 <> 0 AS same FROM c),
v AS (SELECT *, text_ok::INT + xml_ok::INT + layout_ok::INT AS n_ok, xml_ok AND (text_ok OR layout_ok) AND NOT same AS differs FROM o),
d AS (SELECT *, CASE WHEN n_ok = 0 THEN 'all-failed' WHEN differs THEN 'review-required' WHEN n_ok = 1 THEN 'single-success' ELSE 'agreed' END AS status, n_ok > 0 AND NOT differs AS ok FROM v)
"""
)
MUNICIPAL_CONSOLIDATION = (
    _STRATEGIES
    + """
SELECT doc_id, status, ok, CASE WHEN NOT ok THEN NULL WHEN text_ok THEN 'standard-text' WHEN xml_ok THEN 'xfa-dataset' ELSE 'layout-aware' END AS selected_strategy,
  NOT ok AS review_required, CASE WHEN ok THEN 'high' ELSE 'low' END AS confidence,
  CASE status WHEN 'all-failed' THEN 'EJOBURG_ALL_STRATEGIES_FAILED' WHEN 'review-required' THEN 'EJOBURG_STRATEGY_DISAGREEMENT' ELSE '' END AS code,
  concat_ws(',', CASE WHEN text_ok THEN 'standard-text' END, CASE WHEN xml_ok THEN 'xfa-dataset' END, CASE WHEN layout_ok THEN 'layout-aware' END) AS successful,
  CASE WHEN ok THEN ((opening + total + CASE WHEN k % 17 = 0 AND NOT text_ok AND xml_ok THEN 100 ELSE 0 END) * 100)::BIGINT END AS closing_cents
FROM d
"""
)


def municipal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_report(_three_strategies(spark, sf_dir)["results"])


MUNICIPAL_REPORT = (
    _STRATEGIES
    + """
SELECT ok, CASE WHEN ok THEN 'high' ELSE 'low' END AS confidence,
  CASE status WHEN 'all-failed' THEN 'EJOBURG_ALL_STRATEGIES_FAILED' WHEN 'review-required' THEN 'EJOBURG_STRATEGY_DISAGREEMENT' ELSE '' END AS error_code, count(*) AS documents,
  count(DISTINCT CASE WHEN ok AND (text_ok OR NOT xml_ok OR k % 6 <> 1) THEN k END) AS accounts,
  sum(CASE WHEN ok THEN n + 1 + (interest > 0)::BIGINT + (paid > 0)::BIGINT ELSE 0 END)::BIGINT AS n_lines
FROM d GROUP BY ALL
"""
)


def municipal_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested results as JSON, and what stands in a few of their places."""
    nested = envelope(_three_strategies(spark, sf_dir)["results"], "municipal")
    nested = nested.withColumn("json", F.to_json(F.struct(*[c for c in nested.columns if c != "doc_id"])))  # written once
    at = lambda path: F.get_json_object("json", path)
    return nested.select("doc_id", at("$.ok").alias("ok"), at("$.metadata.consolidation.status").alias("status"), at("$.data.municipality").alias("municipality"), at("$.errors[0].code").alias("code"), F.size("data.charges").cast("long").alias("n_charges"))


MUNICIPAL_ENVELOPES = (
    _STRATEGIES
    + """
SELECT doc_id, ok::VARCHAR AS ok, status, CASE WHEN ok THEN 'City of Johannesburg' END AS municipality,
  CASE status WHEN 'all-failed' THEN 'EJOBURG_ALL_STRATEGIES_FAILED' WHEN 'review-required' THEN 'EJOBURG_STRATEGY_DISAGREEMENT' END AS code,
  CASE WHEN ok THEN n + 1 + (interest > 0)::BIGINT END AS n_charges FROM d
"""
)


def pdf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text literals and form datasets out of file bytes, held against what was put in."""
    base = render.municipal_base(spark, sf_dir)
    docs, xml = render.section_documents(base), render.xfa_documents(base)
    files = render.pdf_files(docs, xml).withColumn("good", F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    files = files.select("doc_id", F.when(F.col("good"), F.col("content")).alias("content"), F.when(~F.col("good"), "INVALID_PDF").alias("error_code"), F.lit(None).cast("string").alias("error_message"))
    text = text_or_fallback(files.select("doc_id", F.lit(None).cast("string").alias("text"), "content")).select("doc_id", F.col("text").alias("found"), F.col("error_code").alias("text_error"))
    forms = xfa_datasets(files).select("doc_id", F.col("xml").alias("form"), "error_code")
    put = docs.select("doc_id", _digest(normalize_text(F.col("text"))).alias("text")).join(xml.select("doc_id", _digest("xml").alias("xml")), "doc_id")
    found = text.select("doc_id", _digest("found").alias("found"), "text_error").join(forms.select("doc_id", _digest("form").alias("form"), "error_code"), "doc_id")
    out = put.join(found, "doc_id")
    return out.select("doc_id", "error_code", "text_error", (F.col("found") == F.col("text")).alias("same_text"), (F.col("form") == F.col("xml")).alias("same_form"))


PDF_EXTRACTION = """
SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 9 = 0 THEN 'INVALID_PDF' END AS error_code,
  CASE WHEN o_orderkey % 9 = 0 THEN 'PDF_TEXT_EXTRACTION_FAILED' END AS text_error,
  CASE WHEN o_orderkey % 9 <> 0 THEN true END AS same_text, CASE WHEN o_orderkey % 9 <> 0 THEN true END AS same_form
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
"""


def bank_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes which way when the documents are parsed once and all tables read off the stored results."""
    done, _ = stored_bank_job(render.bank_documents(spark, sf_dir), new_table(spark, "bank-results"))
    route = done["statements"].select("doc_id", F.when(F.col("ok"), "ok").otherwise("failed").alias("route"))
    parts = [done[t].select("doc_id", *[F.lit(int(t == x)).alias(x) for x in _ROUTED]) for t in _ROUTED]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    each = rows.groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in _ROUTED])
    counted = route.join(each, "doc_id", "left").groupBy("route").agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in _ROUTED])
    return counted.select("route", "documents", *_ROUTED)


_ROUTED = ["lines", "checks", "issues"]
BANK_ROUTES = (
    _BANK
    + """
SELECT CASE WHEN bad THEN 'failed' ELSE 'ok' END AS route, count(*) AS documents, sum(CASE WHEN bad THEN 0 ELSE n END)::BIGINT AS lines,
  sum(CASE WHEN bad THEN 0 ELSE 2 END)::BIGINT AS checks, sum(CASE WHEN bad THEN 1 ELSE (k % 5 = 0)::INT + (NOT missing AND k % 7 = 0)::INT END)::BIGINT AS issues
FROM s GROUP BY ALL
"""
)


def pdf_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form datasets out of raw, compressed and truncated streams, held against what was put in."""
    xml = render.xfa_documents(render.municipal_base(spark, sf_dir))
    none = F.lit(None).cast("string")
    forms = xfa_datasets(render.packed_files(xml).withColumns({"error_code": none, "error_message": none}))
    found = forms.select("doc_id", _digest("xml").alias("form"), "error_code").join(xml.select("doc_id", _digest("xml").alias("xml")), "doc_id")
    return found.select("doc_id", "error_code", (F.col("form") == F.col("xml")).alias("same_form"))


PDF_STREAMS = """
SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 5 = 4 THEN 'PDF_XFA_DATASET_NOT_FOUND' END AS error_code,
  CASE WHEN o_orderkey % 5 <> 4 THEN true END AS same_form
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
"""


def municipal_form_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that can't be read in one place or another: the first error fails them, in the order in which a form is read."""
    none = F.lit(None).cast("string")
    done = xfa.xfa_dataset(render.faulty_forms(render.municipal_base(spark, sf_dir)).withColumns({"error_code": none, "error_message": none}))
    return done.select("doc_id", "ok", "code", "error", F.when(F.col("ok"), cents("opening_balance")).alias("opening_cents"), F.when(F.col("ok"), F.size("items")).cast("long").alias("n_items"))


MUNICIPAL_FORM_ERRORS = (
    _MUNICIPAL
    + """
, e AS (SELECT *, CASE k % 8 WHEN 2 THEN 'Invalid month: Smarch' WHEN 3 THEN 'Invalid month: Smarch' WHEN 4 THEN 'Invalid money amount: n/a'
  WHEN 6 THEN 'Invalid money amount: x/y' END AS error FROM c)
SELECT doc_id, error IS NULL AS ok, CASE WHEN error IS NOT NULL THEN 'PARSE_FAILED' END AS code, error,
  CASE WHEN error IS NULL THEN (opening * 100)::BIGINT END AS opening_cents,
  CASE WHEN error IS NULL THEN n + 1 + (interest > 0)::BIGINT + (paid > 0)::BIGINT END AS n_items
FROM e
"""
)


def municipal_invoice_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax invoices with their labels in the other places where they are looked for."""
    done = municipal.standard_text(render.invoice_variants(render.municipal_base(spark, sf_dir)))
    dates = F.array_join(F.array_sort(F.array_distinct(F.transform("items", lambda x: x["date"]))), ",")
    return _municipal_rows(done, dates.alias("dates"))


MUNICIPAL_INVOICE_VARIANTS = (
    _MUNICIPAL
    + f"""
, r AS ({_rows_sql("true", "''")})
SELECT r.*, CASE WHEN k % 4 <> 1 OR month = '2001-02-01' THEN month::VARCHAR WHEN month < '2001-02-01' THEN month::VARCHAR || ',2001-02-01' ELSE '2001-02-01,' || month::VARCHAR END AS dates
FROM r JOIN c USING (doc_id)
"""
)


def municipal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each strategy fared with each document: its warning codes once each, its error, and where its text came from.
    Texts of every 4th order are in sections."""
    base, k = render.municipal_base(spark, sf_dir), F.col("doc_id").cast("long")
    invoices, sections = render.invoice_documents(base), render.section_documents(base).withColumnRenamed("text", "sections")
    text = invoices.join(sections, "doc_id").select("doc_id", F.when(k % 4 == 0, F.col("sections")).otherwise(F.col("text")).alias("text"), (k % 3 + 1).alias("pages"))
    xml = render.xfa_documents(base).withColumns({"xml": F.when(k % 5 != 4, F.col("xml")), "error_code": F.when(k % 5 == 4, NO_DATASET[0]), "error_message": F.when(k % 5 == 4, NO_DATASET[1])})
    items = render.layout_items(invoices).withColumn("page", F.when(F.col("y") < 750, 2).otherwise(1))
    done = municipal_job(text=text, xml=xml, items=items)["results"]
    one = done.select("doc_id", F.explode("diagnostics").alias("d"))
    return one.select("doc_id", "d.strategy", "d.ok", F.array_join("d.warning_codes", ",").alias("warning_codes"), F.try_element_at("d.errors", F.lit(1))["code"].alias("error_code"), "d.provenance.extraction", "d.provenance.pages", "d.provenance.item_count")


MUNICIPAL_DIAGNOSTICS = (
    _MUNICIPAL
    + f"""
, o AS (SELECT *, {_GATED} AS gated, {_GATE_CODE} AS gate_code,
    3 + CASE WHEN k % 13 = 0 THEN 6 ELSE 8 END + 2 * (paid > 0)::INT + 2 * (interest > 0)::INT + 4 * n AS n_items FROM c)
SELECT doc_id, 'standard-text' AS strategy, k % 4 = 0 OR gated AS ok, CASE WHEN k % 4 = 0 THEN 'EJOBURG_CHARGE_SKIPPED' ELSE '' END AS warning_codes,
  CASE WHEN k % 4 <> 0 THEN nullif(gate_code, '') END AS error_code, 'pdf-text' AS extraction,
  CASE WHEN k % 4 = 0 OR gated THEN k % 3 + 1 END::BIGINT AS pages, NULL::BIGINT AS item_count FROM o
UNION ALL SELECT doc_id, 'xfa-dataset', k % 5 <> 4, '', CASE WHEN k % 5 = 4 THEN 'PDF_XFA_DATASET_NOT_FOUND' END, 'xfa-dataset', NULL, NULL FROM o
UNION ALL SELECT doc_id, 'layout-aware', gated, '', nullif(gate_code, ''), 'layout-text', CASE WHEN gated THEN 2 END, CASE WHEN gated THEN n_items END FROM o
"""
)


def municipal_strategy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy_report(_three_strategies(spark, sf_dir)["results"])


MUNICIPAL_STRATEGY_REPORT = (
    _STRATEGIES
    + """
, p AS (SELECT *, concat_ws('+', CASE WHEN text_ok THEN 'standard-text' END, CASE WHEN xml_ok THEN 'xfa-dataset' END, CASE WHEN layout_ok THEN 'layout-aware' END) AS pattern,
  NOT ok AS review_required, CASE WHEN ok AND (text_ok OR NOT xml_ok OR k % 6 <> 1) THEN k END AS account FROM d)
SELECT CASE WHEN grouping(pattern) = 0 THEN 'pattern' WHEN grouping(review_required) = 0 THEN 'review' ELSE 'all' END AS grouping, pattern, review_required,
  count(*) AS documents, sum(ok::INT)::BIGINT AS succeeded, sum(ok::INT)::BIGINT AS reconciled, count(DISTINCT account) AS accounts
FROM p GROUP BY GROUPING SETS ((pattern), (review_required), ())
"""
)


def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned items stored and read again: blank ones left out, coordinates to two places, and the texts that they make."""
    items = render.layout_items(render.invoice_documents(render.municipal_base(spark, sf_dir)))
    off = [(F.col(c) + F.lit(0.004)).alias(c) for c in ("x", "y", "width", "height")]
    both = F.array(F.struct("text", *off), F.struct(F.lit(" \u00a0").alias("text"), "x", (F.col("y") - 3).alias("y"), "width", "height"))
    path = new_table(spark, "items")
    items.select("doc_id", "page", F.explode(both).alias("i")).select("doc_id", "page", "i.*").write.option("compression", "zstd").parquet(path)
    read = layout_documents(read_layout_items(spark, path))
    return read.select("doc_id", "pages", "item_count", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


LAYOUT_FILES = (
    _MUNICIPAL
    + """
SELECT doc_id, 1 AS pages, 3 + CASE WHEN k % 13 = 0 THEN 6 ELSE 8 END + 2 * (paid > 0)::INT + 2 * (interest > 0)::INT + 4 * n AS item_count,
  3 + CASE WHEN k % 13 = 0 THEN 3 WHEN k % 2 = 0 THEN 4 ELSE 8 END + (paid > 0)::INT + (interest > 0)::INT + 3 * n AS n_lines
FROM c
"""
)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its own, read again as bytes and as text; each second one starts as a PDF does."""
    start = F.when(F.col("page_id") % 2 == 0, "%PDF-1.7\n").otherwise("")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.concat(start, F.coalesce("html", F.lit(""))).alias("text"))
    path = new_table(spark, "page-files")
    write_text_files(pages, path)
    page = lambda: F.regexp_extract("doc_id", r"doc_id=(\d+)[./]", 1).cast("long").alias("page_id")
    files = read_pdf_files(spark, path).select(page(), "error_code", F.octet_length("content").cast("long").alias("n_bytes"), F.col("source_file_name").alias("name"))
    texts = read_extracted_text(spark, path).select(page(), _digest(F.regexp_replace("text", r"\n\z", "")).alias("text_sha256"), "source_file_name")
    both = files.join(texts, "page_id")
    return both.select("page_id", "error_code", "n_bytes", "text_sha256", (F.col("name") == F.col("source_file_name")).alias("same_name"))


PAGE_FILES = """
SELECT page_id, CASE WHEN page_id % 2 <> 0 THEN 'INVALID_PDF' END AS error_code, CASE WHEN page_id % 2 = 0 THEN strlen(coalesce(html, '')) + 10 END AS n_bytes,
  sha256(CASE WHEN page_id % 2 = 0 THEN '%PDF-1.7' || chr(10) ELSE '' END || coalesce(html, '')) AS text_sha256, true AS same_name
FROM pages
"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line split and normal form of every text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = explode_lines(docs).groupBy("doc_id").agg(F.count("line").alias("n_lines"), F.max(F.length("line")).alias("longest"))
    norm = docs.select("doc_id", F.sha2(normalize_text(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("normal_sha256"))
    return lines.join(norm, "doc_id")


_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
DOCUMENT_LINES = rf"""
WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: s <> '') AS a,
  list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: s <> '') AS b FROM documents)
SELECT doc_id, len(a) AS n_lines, list_max(list_transform(a, lambda s: length(s))) AS longest, sha256(coalesce(array_to_string(b, chr(10)), '')) AS normal_sha256 FROM x
"""


def document_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in every line of every text that has one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = explode_lines(docs).where(F.col("line").rlike(r"\d[\d, ]*\.\d{2}"))
    tokens = F.size(money_tokens(F.col("line"))) - 1
    return lines.groupBy("doc_id").agg(F.sum(tokens).alias("n_tokens"), F.count(parse_number(first_money_text(F.col("line")))).alias("n_lines")).where("n_tokens > 0")


DOCUMENT_AMOUNTS = r"""
WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
y AS (SELECT doc_id, len(regexp_extract_all(line, '\d[\d, ]*\.\d{2}')) AS n FROM x)
SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*) AS n_lines FROM y WHERE n > 0 GROUP BY doc_id
"""


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged text of every page: its title, and its paragraphs with entities decoded."""
    html = F.col("html")
    paragraphs = F.transform(xfa.blocks(html, "p"), lambda x: xfa.decode_entities(F.regexp_replace(x, "<[^>]+>", "")))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", xfa.path_text(html, "title").alias("title"), F.size(paragraphs).cast("long").alias("n_paragraphs"), F.sha2(F.array_join(paragraphs, "\n").cast("binary"), 256).alias("text_sha256"))


_DECODED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&apos;', '''')"
_STRIPPED = "regexp_replace({0}, '<[^>]+>', '', 'g')"
PAGE_BLOCKS = rf"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS p, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS t FROM pages)
SELECT page_id, nullif({_DECODED.format("regexp_replace(" + _STRIPPED.format("t") + f", '^{_WS}+|{_WS}+$', '', 'g')")}, '') AS title, coalesce(len(p), 0) AS n_paragraphs,
  sha256(coalesce(array_to_string(list_transform(p, lambda s: {_DECODED.format(_STRIPPED.format("s"))}), chr(10)), '')) AS text_sha256 FROM x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (bank_reconciliation, bank_lines, bank_issues, bank_csv, bank_report, bank_envelopes, municipal_sections, municipal_checks, municipal_csv, municipal_invoices, municipal_layout, municipal_forms, municipal_consolidation, municipal_report, municipal_envelopes, bank_routes, municipal_form_errors, municipal_invoice_variants, municipal_diagnostics, municipal_strategy_report, layout_files, page_files, pdf_extraction, pdf_streams, document_lines, document_amounts, page_blocks)
}
SQL: dict[str, str] = {
    "bank_reconciliation": BANK_RECONCILIATION,
    "bank_lines": BANK_LINES,
    "bank_issues": BANK_ISSUES,
    "bank_csv": BANK_CSV,
    "bank_report": BANK_REPORT,
    "bank_envelopes": BANK_ENVELOPES,
    "municipal_sections": MUNICIPAL_SECTIONS,
    "municipal_checks": MUNICIPAL_CHECKS,
    "municipal_csv": MUNICIPAL_CSV,
    "municipal_invoices": MUNICIPAL_INVOICES,
    "municipal_layout": MUNICIPAL_INVOICES,
    "municipal_forms": MUNICIPAL_FORMS,
    "municipal_consolidation": MUNICIPAL_CONSOLIDATION,
    "municipal_report": MUNICIPAL_REPORT,
    "municipal_envelopes": MUNICIPAL_ENVELOPES,
    "bank_routes": BANK_ROUTES,
    "municipal_form_errors": MUNICIPAL_FORM_ERRORS,
    "municipal_invoice_variants": MUNICIPAL_INVOICE_VARIANTS,
    "municipal_diagnostics": MUNICIPAL_DIAGNOSTICS,
    "municipal_strategy_report": MUNICIPAL_STRATEGY_REPORT,
    "layout_files": LAYOUT_FILES,
    "page_files": PAGE_FILES,
    "pdf_extraction": PDF_EXTRACTION,
    "pdf_streams": PDF_STREAMS,
    "document_lines": DOCUMENT_LINES,
    "document_amounts": DOCUMENT_AMOUNTS,
    "page_blocks": PAGE_BLOCKS,
}
