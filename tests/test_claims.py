from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from quarryline.functions import numbers, text
from quarryline.operators import claims, verification


def cell(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_masks_leave_figures_only(spark):
    t = "On May 5, 2020 (2020-05-05) Form 10-K, Item 7A, Note 12 and Q3 of FY2021 gave $1,200 million in 2019 and rose 12.5% over 3 months; loss of (7) and 2,019 units."
    got = cell(spark, t, numbers.masked_figures)
    assert [(x["number"], x["percent"], x["power"], x["negative"]) for x in got] == [(1200, False, 6, False), (Decimal("12.5"), True, None, False), (7, False, None, True), (2019, False, None, False)]
    assert cell(spark, None, numbers.masked_figures) is None and cell(spark, "", numbers.masked_figures) == []


def test_intervals_of_figure_objects(spark):
    f = lambda v, p: cell(spark, Decimal(v), lambda c: numbers.object_interval(c, F.lit(p)), "decimal(38,6)")
    assert tuple(f("58", 9)) == (57_500_000_000, 58_500_000_000) and f("60", 9) is None and tuple(f("1.25", 6)) == (1_245_000, 1_255_000) and tuple(f("1200", 0)) == (1150, 1250)


def test_scales_of_tags_and_captions(spark):
    df = spark.createDataFrame([([6, 6, 0], [True, True, False]), ([6, 0], [True, True]), ([3, 6], [False, False]), ([0], [True])], "s array<int>, m array<boolean>")
    assert [r[0] for r in df.select(numbers.tag_scale(F.col("s"), F.col("m"))).collect()] == [6, None, None, None]
    c = spark.createDataFrame([("(in millions) (in thousands, except per share)",), ("In Billions",), ("nothing",), ("(thousands and millions)",)], "c string")
    assert [r[0] for r in c.select(numbers.caption_phrase_scale(F.col("c"))).collect()] == [3, 9, None, None]


def test_texts(spark):
    q = spark.createDataFrame([("Did it grow at Acme?",), ("Did Acme grow its sales?",), ("What does this table say of Acme?",), ("What was Acme's revenue?",), (None,)], "q string")
    assert [r[0] for r in q.select(text.unanchored(F.col("q"), F.array(F.lit("Acme")))).collect()] == [True, False, True, False, False]
    s = cell(spark, "The companies reported earnings and reports", text.stems)
    assert s == ["compan", "report", "earn", "report"]
    assert cell(spark, "a |  b", lambda c: text.quoted(F.lit("a b"), c)) and not cell(spark, "x", lambda c: text.quoted(F.lit(""), c))
    assert cell(spark, "Größe 12", text.letters_share) == 5 / 8


CLAIMS = f"answer_id string, claim_id int, text string, citations array<string>, figure {claims.FIGURE}"


def _gate(spark):
    fig = lambda v, unit=None, cur="USD", period="FY2020", concept="Revenue": (Decimal(v), unit, cur, period, concept)
    rows = [
        ("a", 1, "Revenue was $1,200 million in 2020", ["X1:1"], fig("1200", "millions")),
        ("a", 2, "Cost was $1,000 million in 2020", ["X1:1"], None),
        ("a", 3, "So 200 million was left, 20.0% more than in 2019", ["X1:1"], None),
        ("a", 4, "Sales reached 77 in 2020", ["X1:1", "X9:9"], None),
        ("b", 1, "Revenue was $5 thousand in fiscal 2020", ["X1:2"], fig("5", "thousands")),
        ("b", 2, "Revenue was 1,230 million.", ["X1:1"], fig("1230", "millions")),
        ("b", 3, "No figure at all.", [], None),
        ("c", 1, "Nothing was 0 in 2020", ["X1:2"], fig("0", "ones")),
        ("d", 1, "Margin rose.", None, None),
    ]
    c = spark.createDataFrame(rows, CLAIMS)
    texts = spark.createDataFrame([("X1:1", "[Table: Income | Item 8 | in millions, except per share data]\n| Revenue | 1,200 |\n| Cost | 1,000 |\n| EPS | 2.5 |"), ("X1:2", "We sold 5 units."), (None, "x")], "key string, t string")
    sets = claims.text_sets(texts, "key", "t", spark.createDataFrame([("X1:2",)], "key string"))
    return c, sets


def test_numbers_are_grounded(spark):
    c, sets = _gate(spark)
    got = {(r["answer_id"], r["claim_id"]): r for r in claims.with_unit(claims.grounded(c, sets), sets).collect()}
    how = {k: [(str(n["magnitude"]).split(".")[0], n["percent"], n["how"]) for n in r["numbers"]] for k, r in got.items()}
    assert how["a", 1] == [("1200000000", False, "printed")] and got["a", 1]["unit_ok"] == "true" and got["a", 1]["period_stated"]
    assert how["a", 3] == [("200000000", False, "derived"), ("20", True, "derived")] and got["a", 3]["numbers_derived"]
    assert how["a", 4] == [("77", False, None)] and not got["a", 4]["numbers_grounded"]
    assert how["b", 1] == [("5000", False, "printed_unscaled")] and got["b", 1]["unit_ok"] == "unknown"
    assert how["b", 2] == [("1230000000", False, None)] and got["b", 2]["unit_ok"] == "false" and not got["b", 2]["period_stated"]
    assert how["c", 1] == [("0", False, "printed")] and got["c", 1]["unit_ok"] == "true"
    assert how["d", 1] == [] and got["d", 1]["numbers_grounded"] and got["d", 1]["unit_ok"] is None
    assert len(got) == c.count() and claims.grounded(c.limit(0), sets).count() == 0


def test_gate_from_claims_to_verdicts(spark):
    c, sets = _gate(spark)
    phrases = claims.concept_tags(spark.createDataFrame([("rev", "Revenues", None, "Revenue")], "item string, tag string, variant string, phrase string"))
    filings = spark.createDataFrame([("X1", "7"), ("X2", "7"), ("X9", "8")], "accession string, cik string")
    end = date(2020, 12, 31)
    facts = spark.createDataFrame([("X1", "7", "Revenues", "USD", end, Decimal(1200000000)), ("X2", "7", "Revenues", "USD", end, Decimal(5000)), ("X1", "7", "Revenues", "shares", end, Decimal(5000)), ("X1", "7", "Revenues", "USD", None, None)], "accession string, cik string, concept string, unit string, period_end date, value decimal(38,6)")
    ends = spark.createDataFrame([("a", 1, end), ("b", 1, end), ("b", 2, end)], "answer_id string, claim_id int, period_end date")
    checks = claims.fact_checks(c, phrases, filings, facts, ends, 0.5)
    status = {(r["answer_id"], r["claim_id"]): (r["kind"], r["status"], r["why"], r["period_ok"]) for r in checks.collect()}
    assert status == {("a", 1): ("monetary", "verified", None, True), ("b", 1): ("monetary", "restatement", None, True), ("b", 2): ("monetary", "contradiction", None, None), ("c", 1): ("monetary", "no_fact", "period unresolved", None)}
    questions = spark.createDataFrame([("a", "What did Acme earn?"), ("b", "And Other Corp?"), ("c", "?"), ("d", None)], "answer_id string, question string")
    names = spark.createDataFrame([("7", "Acme"), ("8", "Other Corp"), ("9", None)], "cik string, name string")
    given = spark.createDataFrame([("a", "X1:1"), ("b", "X1:1"), ("b", "X1:2"), ("c", "X1:2")], "answer_id string, key string")
    entail = spark.createDataFrame([("a", 2, "X1:1", 0.9), ("a", 2, "X1:1", 0.2)], "answer_id string, claim_id int, key string, entail double")
    done = claims.checked(c, questions, given, sets, checks, entail, filings, names)
    got = {(r["answer_id"], r["claim_id"]): r for r in done.collect()}
    assert len(got) == 9 and got["a", 1]["citation_valid"] and got["a", 1]["entity_ok"] and not got["a", 4]["citation_valid"] and not got["b", 1]["entity_ok"]
    assert got["b", 1]["unit_ok"] == "true" and got["b", 2]["contradiction"] and got["a", 2]["entail"] == 0.9 and got["d", 1]["entail"] == 0 and not got["d", 1]["citation_valid"]
    v = {r["answer_id"]: r["verdict"] for r in verification.verdicts(done, 0.5).collect()}
    assert v == {"a": "ABSTAIN", "b": "ABSTAIN", "c": "PASS", "d": "ABSTAIN"}
    failed = {(r["answer_id"], r["claim_id"]): r["failed"] for r in claims.failed_checks(done, verification.supported(0.5)).collect()}
    assert failed["b", 2] == ["entity_ok", "numbers_grounded", "unit_ok", "period_stated", "contradiction"] and failed["d", 1] == ["citation_valid", "entail"]
    again = claims.rechecked(done, done).select(*done.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect()))
    s = {(r["answer_id"], r["claim_id"]): r["citations_supporting"] for r in claims.rescored(done, entail, 0.5).collect()}
    assert s["a", 2] == ["X1:1"] and s["a", 3] == []
    a = spark.createDataFrame([("a", True, "PASS", False), ("b", False, "ABSTAIN", True), ("c", None, None, False)], "answer_id string, model_abstained boolean, verdict string, contradicted boolean")
    assert [tuple(r)[1:] for r in claims.item_verdicts(a).orderBy("answer_id").collect()] == [("ABSTAIN", "insufficient_evidence"), ("ABSTAIN", "contradiction"), ("PENDING", None)]
