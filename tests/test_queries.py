"""Every query that has SQL against that SQL in DuckDB, on the smallest test data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: None if x is None or (isinstance(x, float) and pd.isna(x)) else round(x, 6) if isinstance(x, float) else str(x)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    done = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(done.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Queries without SQL: the columns that name a row, and what every row must be.
WITHOUT_SQL = {
    "answers_grounded": (("answer_id", "claim_id"), lambda r: r["unit_ok"] in (None, "true", "false", "unknown") and r["numbers"] >= 0),
    "answers_checked": (("answer_id", "claim_id"), lambda r: r["status"] in (None, "not_checked", "no_fact", "verified", "restatement", "rounded", "contradiction") and r["contradiction"] == (r["status"] == "contradiction")),
    "answer_verdicts": (("answer_id",), lambda r: r["verdict"] in ("PASS", "PARTIAL", "ABSTAIN") and 0 <= r["kept"] <= r["claims"] and (r["verdict"] != "PASS" or r["confidence"] >= 0.9)),
    "claims_failed": (("answer_id", "claim_id"), lambda r: len(r["failed"]) > 0),
    "answers_scored": (("item_id",), lambda r: r["outcome"] in ("excluded", "abstained", "correct", "wrong") and (r["outcome"] != "correct" or r["figures"] > 0)),
    "numeric_report": (("source",), lambda r: r["accuracy"] is None or 0 <= r["accuracy"] <= r["tolerant"] <= 1 or r["strict"] <= r["accuracy"]),
    "page_blocks": (("key", "kind"), lambda r: 0 <= r["data_rows"] <= r["blocks"]),
    "page_sections": (("key", "item_code", "first_block"), lambda r: r["first_block"] <= r["last_block"]),
    "tables_extracted": (("key", "block_no"), lambda r: r["rows"] >= 1 and r["unit_scale"] in (None, "thousands", "millions", "billions")),
    "documents_chunked": (("key", "section", "chunk_no"), lambda r: r["first_unit"] <= r["last_unit"] and (r["size"] <= 60 or r["first_unit"] == r["last_unit"])),
    "fact_items": (("item_id",), lambda r: (r["problem"] is None) == (r["reference_answer"] is not None and r["question"] is not None)),
    "fulltext_topk": (("query_id", "doc"), lambda r: 0 < r["score"] <= 1 and r["rank"] <= 10),
    "printed_intervals": (("span_id", "lo", "hi"), lambda r: r["lo"] is None or r["lo"] < r["hi"]),
    "p6_unit_sources": (("source",), lambda r: r["found_by"] in ("links", "base", "words") and r["facts"] > 0),
}


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_of_queries_without_sql(spark, name):
    keys, holds = WITHOUT_SQL[name]
    rows = entry.queries()[name](spark, FOLDER).collect()
    assert rows or name in ("page_sections",)
    assert len({tuple(map(str, (r[k] for k in keys))) for r in rows}) == len(rows)
    assert all(holds(r) for r in rows)


def test_corpus_key_is_that_of_the_content(spark):
    assert entry.queries()["corpus_key"](spark, FOLDER).collect() == entry.queries()["corpus_key"](spark, FOLDER).collect()
