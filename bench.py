"""Times the headline queries and prints one JSON line.

Statement documents are rendered and written before the clock starts; the corpus operators read their tables as they are.
The statement jobs write their results by route, as they do in use; the report reads what the bank job wrote.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import jobs, render

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="spark-")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.repartition(int(CPUS)).write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    base = stored(render.municipal_base(spark, SF_DIR), "base")
    bank = stored(render.bank_documents(spark, SF_DIR), "bank")
    invoices, forms = stored(render.invoice_documents(base), "invoices"), stored(render.xfa_documents(base), "forms")
    items = stored(render.layout_items(invoices), "items")
    done = {}

    def bank_pipeline() -> DataFrame:
        done["bank"] = jobs.stored_bank_job(bank, f"{work}/bank-results")[0]
        return done["bank"]["statements"]

    runs = {
        "bank_pipeline": bank_pipeline,
        "municipal_pipeline": lambda: jobs.stored_municipal_job(f"{work}/municipal-results", text=invoices, xml=forms, items=items)[0]["statements"],
        "corpus_report": lambda: jobs.corpus_report(done["bank"]["results"]),
    }
    try:
        from ledgerloom.llm import queries as corpus
    except ImportError:
        corpus = None
    if corpus is not None:
        runs |= {name: lambda f=f: f(spark, SF_DIR) for name, f in corpus.QUERIES.items()}
    took = {}
    for name, run in runs.items():
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
