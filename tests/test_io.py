"""Readers, writers, streaming and the registered queries."""

import gzip
import json
import random
import re
import tracemalloc
import zlib

import duckdb

import __spark_entry__
from ledgerloom.operators.layout import clean_items, layout_documents
from ledgerloom.plans import queries
from ledgerloom.plans.jobs import bank_envelope, bank_job, stored_bank_job
from ledgerloom.sources import readers, streams, writers
from ledgerloom.streaming.ingest import bank_stream

TEXT = "Period: 2026-01-01 to 2026-01-31\nTransactions\n2026-01-05 | A, \"b\" | 5.00 | 15.00\n"


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    files = readers.read_pdf_files(spark, str(tmp_path))
    assert sorted((r.source_file_name, r.error_code, r.content is None) for r in files.collect()) == [("a.pdf", None, False), ("b.pdf", "INVALID_PDF", True)]
    wanted = files.select("doc_id").union(spark.createDataFrame([("gone",)], "doc_id string"))
    assert [r.code for r in readers.missing_files(wanted, files).collect()] == ["FILE_NOT_READABLE"]
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "c.txt").write_text("one\ntwo")
    assert [(r.source_file_name, r.text) for r in readers.read_extracted_text(spark, str(texts)).collect()] == [("c.txt", "one\ntwo")]


def test_csv_and_json(spark, tmp_path):
    done = bank_job(spark.createDataFrame([("d", TEXT)], "doc_id string, text string"))
    writers.write_csv(writers.bank_csv_rows(done["lines"]), str(tmp_path / "csv"))
    lines = [x for p in sorted((tmp_path / "csv").glob("*.csv")) for x in p.read_text().splitlines()]
    assert [x for x in lines if not x.startswith("date")] == ['2026-01-05,"A, ""b""",5,ZAR,15,']
    ok, failed = writers.route(done["statements"])
    writers.write_results(ok, str(tmp_path / "json"))
    assert "opening_balance" not in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert failed.isEmpty()


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("d", TEXT)], "doc_id string, text string").write.parquet(source)
    query = bank_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 1


def test_routes_from_one_parse(spark, tmp_path):
    docs = spark.createDataFrame([("in/d.pdf", TEXT), ("in/e.pdf", "nothing")], "doc_id string, text string")
    done, counts = stored_bank_job(docs, str(tmp_path / "results"))
    assert counts == {"ok": 1, "failed": 1} and sorted(p.name for p in (tmp_path / "results").glob("ok=*")) == ["ok=false", "ok=true"]
    assert [(r.source_file_name, r.ok) for r in done["statements"].orderBy("doc_id").collect()] == [("d.pdf", True), ("e.pdf", False)]
    plain = bank_job(docs)
    for name in ("statements", "lines", "checks", "issues"):
        assert sorted(map(repr, done[name].collect())) == sorted(map(repr, plain[name].collect()))
    assert all("Window" not in t._jdf.queryExecution().executedPlan().toString() for t in done.values())  # nothing is parsed again
    ok, failed = writers.route(done["results"])
    assert [r.doc_id for r in ok.collect()] == ["in/d.pdf"] and [(r.doc_id, r.error is None) for r in failed.collect()] == [("in/e.pdf", False)]
    none, counts = stored_bank_job(docs.where("false"), str(tmp_path / "none"))
    assert counts == {"ok": 0, "failed": 0} and none["lines"].count() == 0
    envelope = bank_envelope(done["results"], "bank")
    writers.write_results(envelope, str(tmp_path / "json"))
    written = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["metadata"]["sourceFileName"], "data" in x) for x in written) == [("d.pdf", True), ("e.pdf", False)]


def test_items_and_texts(spark, tmp_path):
    rows = [("d", 1, " a ", 1.006, 2.0, 3.0, 4.0), ("d", 1, " \u00a0", 5.0, 2.0, 3.0, 4.0), ("d", 3, "b", 1.0, 2.0, 3.0, 4.0)]
    spark.createDataFrame(rows, readers.ITEMS_SCHEMA).write.json(str(tmp_path / "items"))
    items = readers.read_layout_items(spark, str(tmp_path / "items"), "json")
    assert sorted((r.text, r.x) for r in clean_items(items).collect()) == [("a", 1.01), ("b", 1.0)]
    found = layout_documents(items).collect()
    assert [(r.text, r.pages, r.item_count) for r in found] == [("a\nb", 3, 2)]
    writers.write_text(layout_documents(items), str(tmp_path / "texts"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "texts")).collect()] == [("d", "a\nb")]


def test_streams_of_all_kinds(monkeypatch):
    """Against whole streams inflated at once; small pieces put every mark across a border somewhere."""
    draw = random.Random(2)
    raw = lambda x: (c := zlib.compressobj(wbits=-zlib.MAX_WBITS)).compress(x) + c.flush()
    packs = [lambda x: x, zlib.compress, gzip.compress, raw, lambda x: gzip.compress(x[:5]) + gzip.compress(x[5:]), lambda x: zlib.compress(x) + b"more"]
    bits = ["<xfa:datasets>", "</xfa:datasets>", "<DataSets a='1'>", "</datasets>", "<datasetsx>", "<datasets", "x é", "<b>", "stream\n", " " * 9]
    monkeypatch.setattr(streams, "PIECE", 7)
    monkeypatch.setattr(streams, "TAG", 40)
    hits = 0
    for _ in range(1500):
        parts = []
        for _ in range(draw.randint(0, 3)):
            packed = draw.choice(packs)("".join(draw.choices(bits, k=draw.randint(0, 6))).encode())
            packed = packed[: draw.randint(0, len(packed))] if draw.random() < 0.15 else packed
            parts.append(b"stream" + draw.choice([b"\n", b"\r\n"]) + packed + draw.choice([b"\nendstream", b"\r\nendstream", b"endstream"]))
        content = b"%PDF\n" + b"\nendobj ".join(parts)
        wanted = plain_dataset(content)
        hits += wanted is not None
        assert streams.dataset_of(content) == wanted
    assert hits > 100


def plain_dataset(content):
    for stream in re.findall(rb"stream\r?\n(.*?)\nendstream", content, re.S):
        for window in (None, 15, 47, -15):
            whole, rest = b"", stream
            try:
                while window:
                    decoder = zlib.decompressobj(window)
                    whole += decoder.decompress(rest)
                    if not decoder.eof:
                        raise zlib.error
                    rest = decoder.unused_data
                    if window < 16 or not rest.startswith(b"\x1f\x8b"):
                        break
            except zlib.error:
                continue
            text = (whole if window else stream).decode("utf-8", "replace")
            if (start := re.search(r"<(?:[A-Za-z_][\w.-]*:)?datasets\b", text, re.I | re.A)) and (end := re.search(r"</(?:[A-Za-z_][\w.-]*:)?datasets>", text[start.start() :], re.I | re.A)):
                return text[start.start() : start.start() + end.end()]
    return None


def test_streams_in_bounded_memory():
    """A stream that inflates to 400 MB beside its dataset takes a few MB; one dataset that is too long isn't kept."""
    bomb = zlib.compressobj()
    packed = bomb.compress(b"<datasets>a</datasets>") + b"".join(bomb.compress(b"\0" * (1 << 20)) for _ in range(400)) + bomb.flush()
    wrapped = b"stream\n" + packed + b"\nendstream"
    tracemalloc.start()
    assert streams.dataset_of(wrapped) == "<datasets>a</datasets>"
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
    assert streams.dataset_of(wrapped[:-14] + b"\nendstream") is None  # cut off: not sound, whatever came before
    assert streams.dataset_of(b"stream\n<datasets>" + b"a" * 5000 + b"</datasets>\nendstream", longest=1000) is None


def test_queries_have_sql():
    assert set(queries.SQL) == set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_query_against_sql(spark):
    path = "/root/testdata/sf0.001"
    found = queries.bank_reconciliation(spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet'")
    columns = sorted(found.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.BANK_RECONCILIATION})").fetchall())


def test_texts_that_are_compared_stay_where_they_are(spark):
    """Joins of the PDF queries move digests of texts and datasets, not these."""
    from ledgerloom.plans.queries import pdf_extraction, pdf_streams

    for query, digests in ((pdf_streams, 2), (pdf_extraction, 4)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha2(") == digests


def test_text_files(spark, tmp_path, monkeypatch):
    """Folders hold many files each; files hold the bytes of their texts, whatever ids and texts are."""
    rows = [(f"in/{k}: 100%.gz", f"text {k}\r\n\u00e9") for k in range(40)] + [("_a", None), (".b", ""), ("c", "1"), ("c", "1"), (None, "2")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    path = tmp_path / "texts"
    writers.write_text_files(docs, f"file://{path}")
    assert len(list(path.iterdir())) <= 4
    found = {p.name.removeprefix("doc_id=").removesuffix(".txt"): p.read_bytes().decode() for p in path.rglob("*") if p.is_file()}
    wanted = {f"in%2F{k}%3A 100%25.gz": f"text {k}\r\n\u00e9\n" for k in range(40)}
    assert found == wanted | {"_a": "\n", ".b": "\n", "c": "1\n1\n", "__HIVE_DEFAULT_PARTITION__": "2\n"}
    assert sorted(r.text for r in readers.read_extracted_text(spark, str(path)).collect()) == sorted(found.values())
    monkeypatch.setattr(writers, "FOLDER", 3)
    writers.write_text_files(docs, str(tmp_path / "small"))
    assert sorted(p.name for p in (tmp_path / "small").glob("*/*")) == sorted(p.name for p in path.glob("*/*"))
    assert max(len(list(p.iterdir())) for p in (tmp_path / "small").iterdir()) == 3
    none = str(tmp_path / "none")
    writers.write_text_files(docs.where("false"), none)
    assert readers.read_extracted_text(spark, none).count() == 0


def test_text_files_in_a_store_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "store").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./in", f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    writers.write_text_files(docs, "viewfs://texts/in/files")
    found = readers.read_extracted_text(spark, "viewfs://texts/in/files")
    assert sorted((r.doc_id.split("/")[-2], r.text) for r in found.collect()) == [("doc_id=1", "a\nb\n"), ("doc_id=2", "\n")]


def test_page_files_against_sql(spark):
    """Pages are joined by their digests, as the SQL has them."""
    path = "/root/testdata/sf0.001"
    found = queries.page_files(spark, path)
    assert "sha2(" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    columns = sorted(found.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.PAGE_FILES})").fetchall())
