"""Operators on hand cases: nulls, ties, repeated rows, empty tables."""

import random
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from quarryline.operators import chunking, datasets, documents, metrics, relational, retrieval, units, verification
from quarryline.plans import more


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upserts_treat_null_keys_as_equal(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, p string, v string")
    new = spark.createDataFrame([(1, None, "c"), (3, None, "d"), (3, None, "d")], "k int, p string, v string")
    assert rows(relational.inserted(old, new, ["k", "p"])) == [(3, None, "d")]
    assert rows(relational.upserted(old, new.distinct(), ["k", "p"])) == [(1, None, "c"), (2, "x", "b"), (3, None, "d")]
    assert rows(relational.drifted(old, new, ["k", "p"], "v")) == [(1, None, "a", "c")]
    assert rows(relational.inserted(old.limit(0), new, ["k", "p"])) == [(1, None, "c"), (3, None, "d")]
    assert [r[2] for r in rows(relational.replaced(old, new, "k"), "k", "v")] == ["c", "b", "d", "d"]


def test_interval_join(spark):
    spans = spark.createDataFrame([("a", 1, 5, 8), ("a", 2, 90, 95), ("a", 1, 5, 8)], "acc string, sid int, char_start int, char_end int")
    chunks = spark.createDataFrame([("a", "c2", 0, 10), ("a", "c1", 0, 20), ("a", "c3", 5, 8), ("b", "c4", 0, 99)], "acc string, cid string, char_start int, char_end int")
    assert rows(relational.contained(spans, chunks, "acc", "sid", "cid")) == [("a", 1, "c1", 3), ("a", 2, None, 0)]


def test_islands_and_ranks(spark):
    r = spark.createDataFrame([("a", 0, 5), ("a", 4, 9), ("a", 9, 12), ("b", 1, 2)], "p string, s int, e int")
    assert rows(relational.islands(r, ["p"], "s", "e")) == [("a", 0, 9, 2), ("a", 9, 12, 1), ("b", 1, 2, 1)]
    v = spark.createDataFrame([("a", float(x)) for x in (3, 1, 1, 2)] + [("a", None)], "p string, v double")
    got = relational.nearest_rank(v, ["p"], "v", {"p50": "n div 2", "most": "n - 1"}).first()
    assert (got["n"], got["p50"], got["most"]) == (4, 2.0, 3.0)
    c = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", None, "y"), ("j", 1, "x")], "k string, v int, s string")
    assert rows(relational.conflicts(c, ["k"], "v", "s")) == [("k", 2, 2, 1, 2)]


def test_bm25_prefers_rare_terms_and_breaks_ties_by_key(spark):
    docs = spark.createDataFrame([("b", "lease lease cost"), ("a", "lease cost"), ("c", "lease cost"), ("d", "patent"), ("e", None), ("f", "")], "k string, t string")
    q = spark.createDataFrame([(1, "Lease cost"), (2, "patent patent"), (3, "nothing"), (4, None)], "query_id int, question string")
    got = rows(retrieval.bm25(docs, "k", "t", q, 3).select("query_id", "rank", "doc"))
    assert got[:3] == [(1, 1, "b"), (1, 2, "a"), (1, 3, "c")] and got[3:] == [(2, 1, "d")]
    allowed = spark.createDataFrame([(1, "c")], "query_id int, doc string")
    assert [r[:2] for r in rows(retrieval.bm25(docs, "k", "t", q, 3, allowed).select("doc", "rank"))] == [("c", 1)]
    assert retrieval.bm25(docs.limit(0), "k", "t", q).count() == 0


def test_covering_equals_counting_by_hand(spark):
    draw = random.Random(1)
    texts = [(f"d{n:03}" if n else None, draw.choices("abcdefghij", k=draw.randint(0, 7)) if n % 9 else None) for n in range(120)] + [("e", []), ("f", [f"w{n}" for n in range(280)])]
    asked = [(n, draw.sample("abcdefghijkl", draw.randint(1, 6))) for n in range(11)] + [(11, ["z"]), (12, None), (13, []), (14, ["a", "a", None, "b"]), (15, [f"w{n}" for n in range(300)])]
    t = spark.createDataFrame(draw.sample(texts, len(texts)), "doc string, words array<string>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, words array<string>")
    wanted = []
    for n, words in asked:
        own = {w for w in words or [] if w}
        held = sorted((-len(own & set(x or [])), d is not None, d or "", d) for d, x in texts if own & set(x or []))
        wanted += [(n, r, h[3], round(-h[0] / len(own), 9)) for r, h in enumerate(held[:4], 1)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block in (99, 4):
            assert rows(retrieval.covering(t, q, 4, block).select("query_id", "rank", "doc", "score")) == wanted
        assert retrieval.covering(t.limit(0), q).count() == retrieval.covering(t, q.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fulltext_shuffles_no_words_of_texts(spark, tmp_path):
    """400 texts hold 12 words each, of which 10 questions ask 8: 32,000 pairs, of which 10 a question count."""
    words = ["amber", "birch", "cedar", "daisy", "elder", "fern", "gorse", "hazel", "iris", "jute", "kelp", "lime"]
    spark.createDataFrame([(f"c{n:03}", " ".join(words)) for n in range(400)], "chunk_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(f"q-{20 * n:08}-x", " ".join(words[:8])) for n in range(10)], "item_id string, question string").coalesce(1).write.parquet(f"{tmp_path}/eval_items.parquet")
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    df = more.fulltext_topk(spark, str(tmp_path))
    bus.waitUntilEmpty()
    first = store.executionsCount()
    found = rows(df.select("query_id", "rank", "doc", "score"))
    assert found == [(f"q-{20 * n:08}-x", r + 1, f"c{r:03}", 1.0) for n in range(10) for r in range(10)]
    bus.waitUntilEmpty()
    runs, moved = store.executionsList(), 0
    for run in [runs.apply(n) for n in range(first, runs.size())]:
        values = store.executionMetrics(run.executionId())
        ids = {m.accumulatorId() for m in (run.metrics().apply(n) for n in range(run.metrics().size())) if m.name() == "shuffle records written"}
        moved += sum(int(values.apply(x).replace(",", "")) for x in ids if values.contains(x))
    assert 0 < moved <= 400 + 2 * 4 * 10 * 10  # the texts once, and twice the first 10 of each question and task


def test_dense_equals_numpy(spark):
    x = np.random.RandomState(0).normal(size=(50, 8))
    v = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(50)] + [(90, [0.0] * 8), (91, None)], "k long, e array<float>").repartition(5)
    q = v.filter("k < 3").select(F.col("k").alias("query_id"), F.col("e").alias("query_vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = rows(retrieval.dense(v, "k", "e", q, 4).select("query_id", "rank", "doc"))
    assert got == [(i, r + 1, int(j)) for i in range(3) for r, j in enumerate(np.argsort(-(u[i] @ u.T))[:4])]


def test_fusion_fallback_interleave(spark):
    lists = spark.createDataFrame([(1, 1, 1.0, 1, "a"), (1, 1, 1.0, 2, "b"), (1, 1, 1.0, 3, "a"), (1, 2, 1.0, 1, "b")], "query_id int, list_no int, weight double, rank int, doc string")
    assert [r[1] for r in rows(retrieval.fuse(lists).select("rank", "doc"))] == ["b", "a"]
    assert [r[1] for r in rows(retrieval.interleave(lists, 5).select("place", "doc"))] == ["a", "b"]
    both = retrieval.with_fallback(lists.filter("query_id = 2"), lists)
    assert both.count() == 4 and both.filter("fell_back").count() == 4
    assert [r["doc"] for r in retrieval.rerank(lists.select("query_id", "doc", "rank").distinct(), F.lit(0.0), 0.5, 2).orderBy("rank").collect()] == ["a", "a"]


def test_earlier_twins_in_blocks(spark):
    r = np.random.RandomState(1)
    x = r.normal(size=(40, 6))
    x[20:] = x[:20] + 0.2 * r.normal(size=(20, 6))
    v = spark.createDataFrame([(i, [float(a) for a in x[i]], i % 2) for i in range(40)] + [(99, None, None)], "k long, e array<double>, p int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(40):
        s = [(round(float(u[i] @ u[j]), 9), -j) for j in range(i) if i % 2 == j % 2 and u[i] @ u[j] > 0.8]
        if s:
            want[i] = -max(s)[1]
    for block in (4, 2048):
        assert {r["k"]: r["twin"] for r in retrieval.earlier_twins(v, "k", "e", "p", 0.8, block).collect()} == want


def test_ranking_metrics(spark):
    items = spark.createDataFrame([(1, [["a", "b"], ["z"]]), (2, []), (3, None), (4, [["q"]])], "query_id int, sets array<array<string>>")
    lists = spark.createDataFrame([(1, n + 1, d) for n, d in enumerate("xazy")] + [(2, 1, "a")], "query_id int, rank int, doc string")
    got = {r["query_id"]: r for r in metrics.ranking(items, lists, 2).collect()}
    assert (got[1]["sufficient"], got[1]["recall"], got[1]["precision"], got[1]["mrr"]) == (False, 0.5, 0.5, 0.5)
    assert abs(got[1]["ndcg"] - (1 / np.log2(3)) / (1 + 1 / np.log2(3))) < 1e-5
    assert got[2]["recall"] is None and got[3]["mrr"] is None and got[4]["mrr"] == 0.0


def test_agreement_and_scores(spark):
    df = spark.createDataFrame([(0.1, False, "x", "x"), (0.4, True, "x", "y"), (0.4, False, "y", "y"), (0.9, True, None, "y"), (None, True, "y", "y")], "s double, y boolean, a string, b string")
    assert metrics.auc(df, "s", "y").first()["auc"] == 0.875
    assert tuple(metrics.youden(df, "s", "y").first()) == (0.4, 0.5)
    assert tuple(metrics.kappa(df, "a", "b").first()) == (4, 0.75, 0.5)
    assert metrics.auc(df.filter("y"), "s", "y").first()["auc"] is None
    t = metrics.two_by_two(spark.createDataFrame([(True, "ABSTAIN"), (False, "PARTIAL"), (True, "PASS"), (True, None)], "expected_abstain boolean, verdict string")).first()
    assert (t["right_abstain"], t["answered"], t["false_answer"], t["false_answer_rate"], t["over_abstain_rate"]) == (1, 1, 1, 0.5, 0.0)


def test_cost_consistency_gate(spark):
    calls = spark.createDataFrame([("q", "m", 10, 5), ("q", "m", 10, 5), ("r", "other", 1, 1), ("s", "m", None, 1)], "g string, model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 1e6, 2e6)], "model string, price_in double, price_out double")
    assert {r["g"]: r["cost"] for r in metrics.cost(calls, prices, "g").collect()} == {"q": 40.0, "r": None, "s": None}
    run = lambda *d: spark.createDataFrame([(q, n + 1, x) for q, xs in d for n, x in enumerate(xs)], "query_id int, rank int, doc string")
    got = {r["query_id"]: (r["kind"], r["first_difference"]) for r in metrics.consistency(run((1, "ab"), (2, "ab"), (3, "ab"), (4, "a")), run((1, "ab"), (2, "ba"), (3, "abc"))).collect()}
    assert got == {1: ("identical", None), 2: ("reordered", 1), 3: ("different", 3), 4: ("missing", None)}
    values = spark.createDataFrame([("all", "m", 0.5, 0.6)], "scope string, metric string, value double, baseline double")
    rules = spark.createDataFrame([("all", "m", "min", 0.5), ("all", "m", "max", 0.4), ("all", "m", "delta", -0.2), ("all", "m", "delta", -0.05), ("x", "m", "min", 0.0)], "scope string, metric string, rule string, tolerance double")
    assert [r["status"] for r in metrics.gate(values, rules).orderBy("scope", "rule", "tolerance").collect()] == ["pass", "fail", "fail", "pass", "pending"]


def test_verdicts(spark):
    checks = "answer_id string, citation_valid boolean, entity_ok boolean, has_figure boolean, numbers_grounded boolean, unit_ok string, period_stated boolean, contradiction boolean, entail double"
    good, bad, prose, against = (True, True, True, True, "unknown", True, False, None), (True, True, True, False, "true", True, False, None), (True, True, False, True, None, True, False, 0.9), (True, True, True, True, "true", True, True, None)
    df = spark.createDataFrame([("p", *good), ("q", *good), ("q", *good), ("q", *bad), ("r", *bad), ("s", *good), ("s", *against), ("t", *prose)], checks)
    assert {r["answer_id"]: r["verdict"] for r in verification.verdicts(df, 0.5).collect()} == {"p": "PASS", "q": "PARTIAL", "r": "ABSTAIN", "s": "ABSTAIN", "t": "PASS"}
    assert {r["answer_id"]: r["verdict"] for r in verification.verdicts(df, None).collect()}["t"] == "PENDING"


def test_fact_classification(spark):
    facts = spark.sql("SELECT * FROM VALUES ('f1','c','x',date'2020-12-31',100D), ('f2','c','x',date'2020-12-31',120D), ('f1','c','x',date'2019-12-31',80D) AS t(accession,cik,concept,period_end,value)").withColumn("value", F.col("value").cast("decimal(38,6)"))
    cases = [(1, "f1", 100, None, None), (2, "f3", 100, None, None), (3, "f1", 120, None, None), (4, "f1", 90, 85, 105), (5, "f1", 80, None, None)]
    claims = spark.createDataFrame([(c, a, "c", "x", Decimal(v), None if lo is None else Decimal(lo), None if hi is None else Decimal(hi)) for c, a, v, lo, hi in cases], "claim_id int, accession string, cik string, concept string, value decimal(38,6), lo decimal(38,6), hi decimal(38,6)").withColumn("period_end", F.lit("2020-12-31").cast("date"))
    got = {r["claim_id"]: (r["status"], r["elsewhere"]) for r in verification.classified(claims, facts).collect()}
    assert got == {1: ("verified", False), 2: ("no_fact", False), 3: ("restatement", False), 4: ("rounded", False), 5: ("contradiction", True)}


def test_apportioning_and_draws(spark):
    c = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", 0)], "k string, count long")
    assert {r["k"]: r["places"] for r in datasets.apportioned(c, "k", 4).collect()} == {"a": 2, "b": 1, "c": 1, "d": 0}
    assert sum(r["places"] for r in datasets.apportioned(c, "k", 99).collect()) == 10
    x = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 50)], "k string, id long")
    got = datasets.drawn(x, ["k"], spark.createDataFrame([("a", 2), ("b", 3)], "k string, places long"), "id", "s", 2)
    assert got.count() == 5 and got.filter("reserve").count() == 2


def test_chunks_carry_whole_units(spark):
    r = random.Random(0)
    for _ in range(60):
        sizes = [r.randint(0, 30) for _ in range(r.randint(0, 25))]
        out = chunking.packed_units(sizes, 40, 12)
        assert [u for n, (a, b) in enumerate(out) for u in range(a if n == 0 else out[n - 1][1] + 1, b + 1)] == list(range(len(sizes)))
        for n, (a, b) in enumerate(out):
            assert sum(sizes[a : b + 1]) <= 40 or a == b
            assert n == 0 or sum(sizes[a : out[n - 1][1] + 1]) <= 12
    u = spark.createDataFrame([(1, "s", n, t) for n, t in enumerate(["a b c", None, "d e", "f g h i"])], "key int, section string, unit_no int, text string")
    assert [r["text"] for r in chunking.chunks(u, 5, 2).orderBy("chunk_no").collect()] == ["a b c\n\nd e", "f g h i"]
    t = spark.createDataFrame([("k", 0, [["h", "x"], ["a", "1"], ["b", "2"], ["c", "3"]])], "key string, table_no int, grid array<array<string>>")
    assert [r["rows"] for r in chunking.table_parts(t, 6).orderBy("part_no").collect()] == [2, 1]


PAGE = """<html><head><title>no</title><style>x</style></head><body><ix:header><ix:hidden><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:hidden></ix:header><div style="display: none">hidden</div><p id="top">Part I</p><h2>Item 1A. Risk   Factors</h2><p>We <b>lost</b> $<ix:nonFraction name="us-gaap:Revenues" contextRef="c1" scale="6" sign="-">1,2<span>34</span></ix:nonFraction>&nbsp;million. <a href="#top">Back</a></p>
<table><tr><th>Year</th><th>2020</th><th>2019</th></tr><tr><td>Assets</td><td>5</td><td colspan="2">6</td></tr></table><p>Part II</p><p>Item 7 &ndash; Discussion</p><p>unclosed <i>text</body></html>"""


def test_pages(spark):
    docs = documents.parsed(spark.createDataFrame([("d", PAGE), ("e", ""), ("f", None), ("g", "<p>a<table><td>1")], "k string, h string"), "k", "h").cache()
    got = {r["key"]: r for r in docs.collect()}
    assert set(got) == {"d", "e", "g"} and got["e"]["text"] == "" and "hidden" not in got["d"]["text"]
    d = got["d"]
    assert [b["kind"] for b in d["blocks"]] == ["paragraph", "heading", "paragraph", "table", "paragraph", "paragraph", "paragraph"]
    assert [d["text"][b["char_start"] : b["char_end"]] for b in d["blocks"]][:3] == ["Part I", "Item 1A. Risk Factors", "We lost $1,234 million. Back"]
    s = d["spans"][0]
    assert (s["concept"], s["context_ref"], s["scale"], s["sign"], s["raw_text"]) == ("us-gaap:Revenues", "c1", 6, "-", "1,234") and documents.broken_spans(docs).count() == 0
    assert d["contexts"]["c1"][:2] == ("2020-01-01", "2020-12-31") and d["units"] == {"usd": "iso4217:USD"} and d["anchors"] == {"top": 0} and d["links"][0]["target"] == "top"
    assert d["blocks"][3]["rows"] == [["Year", "2020", "2019"], ["Assets", "5", "6", ""]]
    sec = documents.sections(documents.blocks(docs))
    assert rows(sec.select("item_code", "title", "first_block", "last_block")) == [("I.1A", "Risk Factors", 1, 4), ("II.7", "Discussion", 5, 6)]
    assert rows(documents.missing_items(sec, ["I.1A", "I.1"])) == [("d", ["I.1"])]


def test_amounts_in_common_units(spark):
    facts, spans, chunks = [], [], []
    for n in range(40):
        facts += [(3 * n, f"{n}", "us-gaap:Assets", Decimal(5000 + n), "US$ '000", None), (3 * n + 1, f"000{n}", "Assets", Decimal(1000 * (5000 + n)), "USD", "x"), (3 * n + 2, f"{n}", "us-gaap:DiscountRate", Decimal("5.5"), None, "Rate, %")]
        spans += [(n, f"{n}", "us-gaap:Assets", f"5,0{n:02}", 3, None), (100 + n, f"{n}", "us-gaap:DiscountRate", "5.50%", None, "c"), (200 + n, f"{n}", "us-gaap:Assets", "(5.0 bn)", None, "c"), (300 + n, f"{n}", "us-gaap:Assets", f"$5,0{n:02}", None, "c")]
    chunks = [("c", None, "junk\n[Table: a | Item 1 | (In thousands, except per share data)]\n| x |"), (None, "millions", None)]
    f = spark.createDataFrame([(i, a, c, v, u, lab) for i, a, c, v, u, lab in facts] + [(900, None, None, None, None, None)], "fact_id long, accession string, concept string, value decimal(38,6), unit string, label string").withColumns({"period_start": F.lit(None).cast("date"), "period_end": F.lit("2020-01-01").cast("date"), "source": F.lit("clash"), "power": F.lit(3)})
    s = spark.createDataFrame(spans + spans[:3] + [(999, None, None, None, None, None)], "span_id long, accession string, concept string, raw_text string, scale int, chunk_id string")
    c = spark.createDataFrame(chunks, "chunk_id string, unit_scale string, raw_text string")
    want = {x for n in range(40) for x in ((3 * n, n), (3 * n + 1, n), (3 * n, 300 + n), (3 * n + 1, 300 + n), (3 * n + 2, 100 + n))}
    assert {tuple(r) for r in units.same_amounts(f, s, c).collect()} == want
    found = {r["source"]: (r["power"], r["found_by"]) for r in units.unit_sources(units.facts_of(f), units.spans_of(s, c)).collect()}
    assert found["money|us$ '000|"] == (3, "links") and found["money|usd|"] == (0, "base")
    assert units.same_amounts(f.limit(0), s, c).count() == 0 and units.same_amounts(f, s.limit(0), c.limit(0)).count() == 0


def test_a_source_whose_words_name_no_scale_but_whose_values_do(spark):
    e = [("money|odd|", "money|usd|", 50, 0.9, 3.0, 0.0, 1.0, 5, 0), ("money|far|", "money|odd|", 50, 0.9, 3.0, 0.0, 1.0, 5, 5), ("money|few|", "money|usd|", 2, 1.0, 3.0, 0.0, 1.0, 5, 0), ("money|moved|", "money|usd|", 50, 0.9, 3.0, 0.5, 1.0, 5, 0)]
    df = spark.createDataFrame(e, "source string, other string, links long, agreement double, ratio double, offset double, level double, named int, other_named int")
    assert {r["source"]: r["power"] for r in units.propagated(df).collect()} == {"money|odd|": 3, "money|far|": 6}


def test_amounts_of_any_power_and_long_source_names(spark):
    from decimal import Decimal

    from quarryline.operators import units

    powers = {1: "15", -1: "0.15", 4: "15000", 5: "150000", 0: "1.5", 10: "15000000000", 12: "1500000000000", -7: "0.0000002", 13: "15000000000000", -30: "0", 31: None, 500: None}
    for sign in (1, -1):
        df = spark.createDataFrame([(p, sign * Decimal("1.5")) for p in powers], "p int, v decimal(38,6)")
        got = {r["p"]: r["x"] for r in df.select("p", units.shifted(F.col("v"), F.col("p")).alias("x")).collect()}
        assert got == {p: None if x is None else sign * Decimal(x) for p, x in powers.items()}
    long = [("money|usd|" + "x" * 60 + w, w) for w in ("thousands", "millions")]
    facts = spark.createDataFrame([(n, "1", "Assets", 1, u, None) for n, (u, _) in enumerate(long)], "fact_id long, accession string, concept string, value int, unit string, label string")
    f = units.facts_of(facts.withColumns({"period_start": F.lit(None).cast("date"), "period_end": F.lit("2020-01-01").cast("date")}))
    assert len({r["source"] for r in f.collect()}) == 2
