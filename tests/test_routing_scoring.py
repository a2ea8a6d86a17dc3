import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from quarryline.operators import routing, scoring


def _route(**x):
    return json.dumps({"intent": "lookup", "entities": [], "fiscal_periods": [], "form_types": [], "sub_queries": [], "confidence": 0.9} | x)


def test_routes(spark):
    rows = [
        (1, "q1", _route(entities=[{"ticker": "ab", "company_name": "A"}, {"ticker": "zz", "company_name": "Z"}], form_types=["10-K", "8-K"], fiscal_periods=["FY2020", "December 31, 2019", "soon"])),
        (2, "q2", _route(intent="comparison", sub_queries=["x", " "])), (3, "q3", "no json"), (4, "q4", _route(intent="unsupported")), (5, "q5", _route(confidence=0.1, form_types=["10-K"])), (6, "q6", None), (7, "q7", _route(extra=1)),
    ]
    q = spark.createDataFrame(rows, "query_id int, question string, raw string").withColumn("route", routing.route(F.col("raw")))
    p = routing.planned(q)
    got = {r["query_id"]: r for r in p.collect()}
    assert [got[n]["intent"] for n in range(1, 8)] == ["lookup", "comparison", "unrouted", "unsupported", "lookup", "unrouted", "unrouted"]
    assert got[2]["asked"] == ["x", "q2"] and got[1]["k"] == 20 and got[4]["declined"] and got[4]["k"] is None
    f = {r["query_id"]: r for r in routing.filters(p, spark.createDataFrame([("AB",), ("CD",)], "ticker string")).collect()}
    assert f[1]["tickers"] == ["AB"] and f[1]["form_types"] == ["10-K"] and 5 not in f and f[2]["tickers"] == []
    filings = spark.createDataFrame([("AB", date(2019, 12, 31), 2019, None), ("CD", date(2019, 12, 31), 2018, 4)], "ticker string, period_end date, fiscal_year int, fiscal_quarter int")
    r = {x["query_id"]: x for x in routing.period_filters(p, filings).collect()}[1]
    assert [tuple(x) for x in r["periods"]] == [(2019, None), (2020, None)] and r["unresolved"] == ["soon"]


def test_numeric_scores(spark):
    rows = [(1, "$1.2 million", "about 1,204,000"), (2, "$1.2 million", "3"), (3, "none", "3"), (4, "5%", None), (5, "(3) thousand", "it was 3 thousand, 7"), (6, "5%", "5"), (7, "100", "100.4")]
    got = {r["item_id"]: r for r in scoring.numeric_scores(spark.createDataFrame(rows, "item_id int, reference_answer string, answer string")).collect()}
    assert [got[n]["outcome"] for n in range(1, 8)] == ["correct", "wrong", "excluded", "abstained", "correct", "wrong", "correct"]
    assert got[5]["sign_agrees"] is False and got[5]["first"] and got[7]["tolerant"] and got[4]["figures"] is None


def test_claims_signs_and_texts(spark):
    c = spark.createDataFrame([(True, True, True, False), (False, True, False, True), (True, False, True, False)], "supported boolean, kept boolean, cited boolean, contradiction boolean")
    r = scoring.claim_rates(c, []).first()
    assert (r["claims"], r["faithful_before"], r["faithful_after"], r["retention"]) == (3, 0.666667, 0.5, 0.666667)
    s = spark.createDataFrame([("lost ($12) now", 7, 9), ("was -12", 5, 7), ("12", 0, 2), ("(see 12 x)", 5, 7)], "t string, a int, b int")
    assert [x[0] for x in s.select(scoring.printed_sign(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["brackets", "minus", "plain", "plain"]
    v = spark.createDataFrame([(Decimal(-1234000), 3), (Decimal(1234500), 6), (Decimal(5), 0)], "v decimal(38,6), p int")
    assert [x[0] for x in v.select(scoring.currency_text(F.col("v"), F.col("p"))).collect()] == ["-$1,234 thousand", None, "$5"]
    a = spark.createDataFrame([(1, "around 100", Decimal(100)), (2, "103", Decimal(100)), (3, "100%", Decimal(100)), (4, None, Decimal(1))], "item_id int, answer string, value decimal(38,6)")
    assert [(x["dropped"], x["near"]) for x in scoring.without_context(a).orderBy("item_id").collect()] == [(True, False), (False, True), (False, False), (False, False)]
