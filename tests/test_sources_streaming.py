import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarryline.sources import filings
from quarryline.streaming import ingest


def test_company_facts_keep_decimals(spark, tmp_path):
    body = {"cik": 123, "facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [{"end": "2020-12-31", "val": 12345678901234567890.5, "accn": "a", "fy": 2020, "fp": "FY", "form": "10-K"}, {"start": "2020-01-01", "end": "2020-12-31", "val": None, "accn": "b"}]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(body).replace("1.2345678901234567e+19", "12345678901234567890.5"))
    got = filings.company_facts(spark, str(tmp_path / "f.json")).orderBy("accession").collect()
    assert (got[0]["cik"], got[0]["concept"], got[0]["value"]) == ("0000000123", "us-gaap:Assets", Decimal("12345678901234567890.5")) and got[1]["value"] is None


def test_submissions_and_selection(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"filings": {"recent": {"accessionNumber": ["1", "2"], "form": ["10-K", "8-K"], "filingDate": ["2020-05-01", "bad"], "reportDate": ["2020-03-31", ""]}}}))
    got = filings.submissions(spark, str(tmp_path))
    assert [r["document"] for r in got.collect()] == [None, None]
    assert [r["accession"] for r in filings.selected(got, ["10-K"], "2020-01-01").collect()] == ["1"]
    assert filings.exactly(got, spark.createDataFrame([("1",)], "accession string")).count() == 1
    with pytest.raises(Exception, match="not listed"):
        filings.exactly(got, spark.createDataFrame([("9",)], "accession string")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(b"<p>x</p>")
    row = filings.pages(spark, str(tmp_path / "p.html")).first()
    assert row["html"] == "<p>x</p>" and len(row["content_hash"]) == 64
    filings.append_json(spark.range(3), str(tmp_path / "j"))
    filings.append_json(spark.range(2), str(tmp_path / "j"))
    assert filings.json_lines(spark, str(tmp_path / "j"), "id long").count() == 5
    filings.save_snapshot({"t": spark.range(5), "u": spark.range(0)}, str(tmp_path / "s"))
    assert {r["table"]: r["same"] for r in filings.verified_snapshot(spark, str(tmp_path / "s")).collect()} == {"t": True, "u": True}
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "s/t"))
    assert {r["table"]: r["same"] for r in filings.verified_snapshot(spark, str(tmp_path / "s")).collect()} == {"t": False, "u": True}


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, None)], "k int, p string").write.parquet(src)
    for _ in range(2):
        ingest.ingest(spark, src, "k int, p string", out, ["k", "p"], check).awaitTermination()
    spark.createDataFrame([(2, None), (3, "c")], "k int, p string").write.mode("append").parquet(src)
    ingest.ingest(spark, src, "k int, p string", out, ["k", "p"], check).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windows_in_a_stream_equal_the_batch(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id AS int) * 7) AS ts, id % 3 AS user_id, concat('t', id % 2) AS event_type, cast(id AS double) AS value FROM range(100)")
    e.write.parquet(str(tmp_path / "e"))
    stream = ingest.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "1 hour")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("w").collect()) == sorted(ingest.windowed(e, "1 hour").collect())
    assert ingest.sessions(e, "30 minutes").agg(F.sum("events")).first()[0] == 100


def test_selection_is_counted_and_forms_are_checked(spark):
    listed = spark.createDataFrame([("1", "10-K", "2020-05-01", "2020-03-31"), ("2", "8-K", "2020-05-01", None), ("3", "10-K", "2019-01-01", "2018-12-31"), ("4", "10-K", "2020-06-01", None)], "accession string, form_type string, f string, p string")
    listed = listed.select("accession", "form_type", F.col("f").cast("date").alias("filing_date"), F.col("p").cast("date").alias("period_end"))
    assert tuple(filings.selection_counts(listed, ["10-K"], "2020-01-01").first()) == (4, 1, 1, 1, 1)
    assert filings.exactly(listed, spark.createDataFrame([("1", "10-K")], "accession string, form_type string")).count() == 1
    with pytest.raises(Exception, match="another form"):
        filings.exactly(listed, spark.createDataFrame([("1", "10-Q")], "accession string, form_type string")).collect()


def test_settings_csv_nested_lines_and_texts(spark, tmp_path):
    assert filings.settings("a: 1\nb:\n  c: [1, 2]\n  d:\n    - x\n    - 2.5\n# note\ne: 'q: r'\nf: true\ng:\n") == {"a": 1, "b": {"c": [1, 2], "d": ["x", 2.5]}, "e": "q: r", "f": True, "g": None}
    with pytest.raises(ValueError):
        filings.settings("just words")
    (tmp_path / "c.csv").write_text("k,v\n1,2.50\n2,\n")
    assert [tuple(r) for r in filings.csv_rows(spark, str(tmp_path / "c.csv"), "k int, v decimal(38,6)").collect()] == [(1, Decimal("2.5")), (2, None)]
    (tmp_path / "n.json").write_text('{"a": {"b": 1, "c": "x"}, "d": 1.25}\n\n{"d": 2}\n')
    got = filings.json_lines(spark, str(tmp_path / "n.json"), "a struct<b: int, c: string>, d decimal(38, 6)").collect()
    assert [(r["a"] and r["a"]["b"], r["d"]) for r in got] == [(1, Decimal("1.25")), (None, 2)]
    h = filings.save_texts(spark.createDataFrame([("k", "abc")], "key string, text string"), str(tmp_path / "t")).first()["text_hash"]
    assert h == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_snapshots_are_restored_only_whole(spark, tmp_path):
    import shutil

    path = str(tmp_path / "s")
    filings.save_snapshot({"t": spark.range(5), "u": spark.range(3)}, path)
    assert {n: d.count() for n, d in filings.restored(spark, path).items()} == {"t": 5, "u": 3}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,)], "x int")
    assert filings.content_key(a).first() != filings.content_key(b).first() and filings.content_key(b.repartition(2)).first() == filings.content_key(b).first()
    shutil.rmtree(f"{path}/u")
    assert {r["table"]: r["state"] for r in filings.verified_snapshot(spark, path).collect()} == {"t": "same", "u": "missing"}
    with pytest.raises(ValueError, match="u"):
        filings.restored(spark, path)


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    todo = spark.createDataFrame([(i,) for i in range(4)], "k int")
    path, seen = str(tmp_path / "run"), []

    def run(df):
        seen.append(df.count())
        return df.withColumn("error", F.when((F.col("k") == 3) & F.lit(len(seen) == 1), "late")).withColumn("y", F.col("k") * 2)

    assert ingest.resumable(spark, todo, path, "k", run, {"v": "1"}).count() == 3
    assert ingest.resumable(spark, todo, path, "k", run, {"v": "1"}).count() == 4 and seen == [4, 1]
    with pytest.raises(ValueError):
        ingest.resumable(spark, todo, path, "k", run, {"v": "2"})
