"""Registered queries on small tables: op3 against its SQL, the columns that the queries of op6 and op10 add."""

import zlib

import duckdb
import numpy as np
import pytest

from astrolane.llm import queries, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    big = "<p>" + "x" * 200
    pages = [(5, "u", big), (3, None, big), (9, "u", "small"), (8, "u", "small"), (7, "u", None), (6, "u", "ü" * 60), (2, "u", "ü" * 60), (4, "u", "ü" * 49), (1, "u", "ü" * 49), (None, "u", big), (3, "v", big), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "y" * 99), (13, "u", "y" * 99)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    texts = [" ".join([*rng.choice(words, 40), *(["vilelout"] if i % 4 == 0 else [])]) for i in range(300)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def part_of(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_op3_equals_its_sql(spark, sf_dir):
    got = queries.queries()["op3_warc"](spark, sf_dir)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet/*.parquet'")
        found = db.execute(queries.oracle_sql()["op3_warc"])
        names, want = [c[0] for c in found.description], found.fetchall()
    key = lambda row: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[3] == "revisit" for r in want) == 3


def test_op6_says_what_is_held_out(spark, sf_dir):
    rows = queries.queries()["op6_toxicity"](spark, sf_dir).collect()
    assert len(rows) == 300 and all(r["held_out"] == (part_of(r["doc_id"], 3) == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= toxicity.THRESHOLD) == int(r["doc_id"] % 4 == 0) for r in rows)


def test_op10_says_what_is_held_out(spark, sf_dir):
    rows = queries.queries()["op10_katz_scoring"](spark, sf_dir).collect()
    assert len(rows) == 300 and all(r["held_out"] == (part_of(r["doc_id"], 5) == 1) for r in rows)
    assert all(np.isfinite(r["score"]) for r in rows)
