"""The operators' queries against their SQL, on hard cases that the given tables don't have."""

import random

import duckdb
import pytest

from ledgerloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["É", "Mixed", "x y"]
    texts = [None, "", " \t", "one", "ONE", "one two", "One\x0btwo", "one  two", "two one", " ", "one two " * 3]
    for _ in range(25):
        base = draw.choices(words, k=draw.randint(2, 30))
        for _ in range(draw.randint(1, 4)):
            own = list(base)
            own[draw.randrange(len(own))] = draw.choice(words)
            texts += [" ".join(own), draw.choice([" ".join(base), "\n".join(base), " ".join(base).upper()])]
    token = ["A1b2C3d4E5f6G7h8I9j0K", "abcdefghijklmnopqrst1", "a1" * 12, "0f" * 15, "AKIA" + "Q7" * 8, "AKIA123", "short1"]
    forms = ["{}", "passWord = '{}'", "api_key:{}", "APIKEY=\"{}\"", "ſecret: {}", "é token={}&token={}", "https://h.example/{}/z", "x{}y", "secret = a secret: {}"]
    for _ in range(150):
        texts.append("é " + " ".join(draw.choice(forms).replace("{}", draw.choice(token)) for _ in range(draw.randint(1, 4))))
    docs = [(3 * k - 5, draw.choice(["a", "b", "ü", None]), draw.choice(["en", "de", None]), None if t is None else len(t), t) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op5_minhash_near_dedup", "op7_mix_sources", "op8_secret_owners", "op10_exact_dedup", "op12_merkle_manifest"])
def test_hard_cases(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    wanted = con.sql(queries.SQL[name])
    columns = sorted(wanted.columns)
    found = queries.QUERIES[name](spark, str(folder))
    assert sorted(found.columns) == columns
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted.select(*columns).fetchall()))
