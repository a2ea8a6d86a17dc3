from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from quarryline.operators import pools, relational, reports, retrieval


def _facts(spark):
    rows = []

    def fact(i, year, value, acc, comparative=False, quarter=None, unit="USD", concept="Sales"):
        start = date(year, 1, 1)
        end = date(year, 12, 31) if quarter is None else date(year, 3, 31)
        rows.append((i, "7", acc, concept, "Sales", Decimal(value), unit, start, end, year, "FY" if quarter is None else f"Q{quarter}", "10-K" if quarter is None else "10-Q", comparative))

    fact(1, 2019, 5_000_000, "A19")
    fact(2, 2020, 7_000_000, "A20")
    fact(3, 2019, 5_000_000, "A20", comparative=True)
    fact(4, 2020, 3, "B20", quarter=1)
    fact(5, 2021, 9_000_000, "A21")
    fact(6, 2021, 9_500_000, "C21")
    df = spark.createDataFrame(rows, "fact_id long, cik string, accession string, concept string, label string, value decimal(38,6), unit string, period_start date, period_end date, fiscal_year int, fiscal_period string, form_type string, is_comparative boolean")
    spans = [("A19", 5_000_000, "c19", 6), ("A20", 7_000_000, "c20", 6), ("A20", 7_000_000, "c20b", 6), ("A20", 5_000_000, "c20p", 6), ("A21", 9_000_000, "c21", 6), ("B20", 3, "cq", 0)]
    s = spark.createDataFrame([(a, "Sales", Decimal(v), c, p) for a, v, c, p in spans], "accession string, concept string, value decimal(38,6), chunk_id string, scale int")
    return df, s


def test_pool_pairs_and_items(spark):
    p = pools.pool(pools.gold_facts(*_facts(spark)))
    got = {r["fact_id"]: r for r in p.collect()}
    assert set(got) == {1, 2, 4} and not any(r["ambiguous"] for r in got.values())  # 2021 has two values
    assert [(e["accession"], e["chunks"]) for e in got[1]["evidence"]] == [("A19", ["c19"]), ("A20", ["c20p"])]
    pair = pools.pairs(p, [1, 2]).collect()
    assert [(r["kind"], r["gap"], r["earlier"]["fact_id"], r["later"]["fact_id"]) for r in pair] == [("annual", 1, 1, 2)]
    c = pools.comparison_items(pools.pairs(p, [1])).first()
    assert c["reference_answer"] == "$7 million for fiscal 2020, compared with $5 million for fiscal 2019: an increase of $2 million." and c["problem"] is None
    assert c["sets"] == [["c19", "c20"], ["c19", "c20b"], ["c20", "c20p"], ["c20b", "c20p"]]
    i = {r["item_id"]: r for r in pools.items(pools.slots(p).withColumn("company", F.lit("Acme")), [("t", "filing", "{label} of {company} for {period} ({dates})?")], "s", "v").collect()}
    assert i["fact-1"]["question"] == "Sales of Acme for fiscal 2019 (the fiscal year ended December 31, 2019)?" and i["fact-1"]["gold_evidence_sets"] == [["c19"]] and i["fact-1"]["reference_answer"] == "$5 million for the fiscal year ended December 31, 2019."
    assert i["fact-4"]["question"].startswith("Sales of Acme for the first quarter of fiscal 2020 (the three months ended March 31, 2020)") and pools.pool(pools.gold_facts(*[x.limit(0) for x in _facts(spark)])).count() == 0


def test_printed_values_and_bands(spark):
    df = spark.createDataFrame([(Decimal("-1234.5"), "USD/shares", []), (Decimal("1234567000"), "USD", [3]), (Decimal("1500000"), "USD", [6]), (Decimal("5"), "USD", [3, 6]), (Decimal("5"), "shares", [0]), (Decimal("1234"), "USD", [0])], "v decimal(38,6), u string, s array<int>")
    assert [r[0] for r in df.select(pools.value_text(F.col("v"), F.col("u"), F.col("s"))).collect()] == ["-$1,234.50", "$1,234,567 thousand", "$1.5 million", None, None, "$1,234"]
    n = spark.createDataFrame([(1,), (10,), (99,), (None,)], "n int")
    assert [r[0] for r in n.select(pools.band(F.col("n"), [10, 50])).collect()] == ["< 10", "10 to 50", ">= 50", None]


def test_draws_and_records(spark):
    df = spark.createDataFrame([(f"k{i}", "g", "ab"[i % 2] if i < 6 else "a") for i in range(9)] + [("z", "h", "a")], "k string, g string, s string")
    d = pools.round_robin(df.unionByName(df.limit(1)), "g", ["s"], ["k"], spark.createDataFrame([("g", 4), ("h", 3)], "g string, places int"), "x").collect()
    g = sorted((r["position"], r["s"]) for r in d if r["g"] == "g")
    assert len(g) == 4 and {s for _, s in g[:2]} == {"a", "b"} and {s for _, s in g[2:]} == {"a", "b"} and [r["short"] for r in d if r["g"] == "h"] == [True]
    assert {r[0]: r[2] for r in pools.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, size int"), "k", 2).collect()} == {"a": 1, "b": 1, "c": 0}
    u = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "i int, m array<string>")
    assert [r["i"] for r in pools.unused(u, "m", spark.createDataFrame([("y",)], "member string")).collect()] == [2]
    sides = spark.createDataFrame([(1, "7", s, t) for s, t in ((0, ["5"]), (1, ["1,200"]))], "pair_id int, cik string, side int, tokens array<string>")
    texts = spark.createDataFrame([("7", "c1", "5 and 1,200,"), ("7", "c2", "only 5"), ("8", "c3", "5 1,200")], "cik string, chunk_id string, text string")
    assert [r["chunk_id"] for r in pools.printed_together(sides, texts).collect()] == ["c1"]


def test_numeric_scores_by_kind_of_reference(spark):
    rows = [
        ("a", "xbrl_numeric", "$1.2 million for fiscal 2020.", [], "It was $1,200 thousand in 2020.", False, []), ("b", "xbrl_numeric", "$(5) million", [], "5 million", False, []),
        ("c", "comparison", "$7 million, then $5 million: $2 million", [], "7 million and 5 million", False, []), ("d", "table", "12.5", ["kind:factual", "unit_scale_millions"], None, False, [(Decimal("12.5"), "millions")]),
        ("e", "table", "3", ["kind:factual", "unit_scale_unknown"], "3", False, []), ("f", "prose", "words", [], "words", False, []), ("g", "xbrl_numeric", "$0", [], "There was none.", False, []), ("h", "xbrl_numeric", "$4", [], None, True, []), ("i", "xbrl_numeric", "no figure", [], "4", False, []),
    ]
    df = spark.createDataFrame(rows, "item_id string, question_type string, reference_answer string, tags array<string>, answer string, abstained boolean, figures array<struct<value: decimal(38,6), unit: string>>").withColumn("source", F.lit("s"))
    got = {r["item_id"]: r for r in reports.item_scores(reports.references(df)).collect()}
    assert [got[k]["excluded"] for k in "abcdefghi"] == [None, None, None, None, "unit_scale_unknown", "not numeric", None, None, "broken"]
    assert [got[k]["correct"] for k in "abcdgh"] == [True, True, False, True, True, False] and got["c"]["values_only"] and got["b"]["sign_agrees"] is None and got["d"]["sign_agrees"] and not got["d"]["fallback"]
    r = {x["source"]: x for x in reports.numeric_report(reports.item_scores(reports.references(df))).collect()}["all"]
    assert (r["n"], r["excluded"], r["abstained"]) == (6, 3, 1) and abs(r["accuracy"] - 4 / 6) < 1e-5


def test_constraints_loads_and_reports(spark):
    kids = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, p string")
    up = spark.createDataFrame([("a",)], "p string")
    assert {r["i"] for r in relational.cascaded(kids, up, "p").collect()} == {1, 3} and {(r["i"], r["p"]) for r in relational.cascaded(kids, up, "p", "null").collect()} == {(1, "a"), (2, None), (3, None)}
    v = {r["check"]: r["rows"] for r in relational.violations(kids, {"small": F.col("i") < 3}, ["p"], (up, "p")).collect()}
    assert v == {"small": 1, "unique": 0, "foreign key": 1}
    new = spark.createDataFrame([("r1", True, "PASS"), ("r2", False, "ABSTAIN")], "item_id string, x boolean, verdict string")
    old = spark.createDataFrame([("r1", False, "PASS"), ("r2", False, "PASS")], "item_id string, x boolean, verdict string")
    s = reports.spread(old, new, "item_id", "x").first()
    assert (s["items"], s["equal"], s["won"], s["lost"]) == (2, 1, 1, 0)
    assert {(r["was"], r["now"]): r["items"] for r in reports.verdict_change(old, new, []).collect()} == {("PASS", "PASS"): 1, ("PASS", "ABSTAIN"): 1}
    p = reports.pending_rates(new.withColumn("g", F.lit(1)), ["g"], {"n": F.count("*")}, F.col("verdict") == "PENDING").first()
    assert p["n"] == 2 and not p["pending"]
    k = spark.createDataFrame([("x/1.retrieval.json", True), ("x/1.json", True), ("x/1.json", None)], "p string, d boolean")
    assert [r[0] for r in k.select(reports.run_kind(F.col("p"), F.col("d"))).collect()] == ["retrieval", "development", "gated"]


def test_search_methods_timeouts_and_embedding(spark, tmp_path):
    import numpy as np
    import pytest

    run = lambda docs: spark.createDataFrame([(q, n + 1, d) for q, ds in docs.items() for n, d in enumerate(ds)], "query_id int, rank int, doc string")
    fused, better = run({1: "ab", 2: "ab", 3: "ab"}), run({1: "ba", 2: "ba"})
    times = spark.createDataFrame([(1, 0.5), (2, 9.0), (3, None)], "query_id int, seconds double")
    got = {r["query_id"]: (r["doc"], r["fell_back"]) for r in retrieval.after_rerank(fused, better, times, 3.0, 1).collect()}
    assert got == {1: ("b", False), 2: ("a", True), 3: ("a", True)}
    with pytest.raises(ValueError):
        retrieval.search("none", dense=lambda: fused)
    chunks = spark.createDataFrame([(1, "h1", "a b"), (2, "h2", "c"), (3, "h2", "c"), (4, "h3", "d")], "k int, h string, t string")
    cache = spark.createDataFrame([("h1", [1.0])], "h string, embedding array<float>")
    filled, rest = retrieval.to_embed(chunks, spark.createDataFrame([(4,)], "k int"), cache, "k", "h")
    assert [r["k"] for r in filled.collect()] == [1] and [r["h"] for r in rest.collect()] == ["h2"]
    e = retrieval.embedded(chunks, "h", "t", lambda ts: np.array([[3.0, 4.0]] * len(ts)), 2)
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in e.collect())
    docs = spark.createDataFrame([(f"d{i}", f"alpha w{i % 3} w{i}") for i in range(9)] + [("n", None)], "k string, t string")
    q = spark.createDataFrame([(1, "alpha w1 w4"), (2, "zzz"), (3, None)], "query_id int, question string")
    index = retrieval.load_or_build(str(tmp_path / "ix"), docs, "k", "t")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(retrieval.bm25(index, "k", "t", q, 4)) == rows(retrieval.bm25(docs, "k", "t", q, 4)) and index.stored
    again = retrieval.load_or_build(str(tmp_path / "ix"), docs.filter("k <> 'd4'"), "k", "t")
    assert "d4" not in {r["doc"] for r in retrieval.bm25(again, "k", "t", q, 9).collect()}
    with pytest.raises(ValueError):
        retrieval.stored_index(spark, str(tmp_path / "ix"), "other")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "k string, v array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, query_vector array<double>")
    near = retrieval.dense_allowed(v, "k", "v", ask, spark.createDataFrame([(1, "b"), (1, "c"), (1, "b")], "query_id int, doc string"))
    assert [(r["doc"], r["rank"]) for r in near.collect()] == [("b", 1)]


def test_written_items_and_schemas(spark):
    import pytest

    from quarryline.sources.tables import Registry

    i = [("a", "q?", "x", [["c1"]], False, "t"), ("b", " ", None, None, False, "t"), ("c", "q2?", None, [], True, "u"), ("d", "q3?", "x", [["zz"]], False, "u")]
    df = spark.createDataFrame(i, "item_id string, question string, reference_answer string, gold_evidence_sets array<array<string>>, expected_abstain boolean, question_type string")
    got = {r["item_id"]: r["problems"] for r in pools.written_problems(df, spark.createDataFrame([("c1",)], "chunk_id string"), spark.createDataFrame([("d",)], "item_id string"), spark.createDataFrame([("t", 2), ("v", 1)], "question_type string, least int")).collect()}
    assert got == {"b": ["no question", "no answer", "no evidence"], "d": ["unknown evidence", "near-duplicate"], None: ["too few v"]}
    r = Registry()
    r.add("t", 1, "a int")
    r.add("t", 2, "a bigint, b string")
    with pytest.raises(ValueError):
        r.add("t", 2, "a int")
    out = r.conformed(spark.createDataFrame([(1, "x")], "a int, z string"), "t")
    assert out.columns == ["a", "b"] and out.dtypes[0][1] == "bigint" and tuple(out.first()) == (1, None)
