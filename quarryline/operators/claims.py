"""The claim gate: numbers of claims grounded in the cited texts and checked against facts, claim by claim.

Claims come as rows of answer_id, claim_id, text, citations (text keys) and figure (value, unit, currency,
period, concept; null for prose). All steps join by answer, claim and text key; what one answer holds
is compared inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.numbers import MONEY, apply_scale, masked_figures, object_interval, within
from quarryline.functions.text import has_word, phrase_key

FIGURE = "struct<value: decimal(38,6), unit: string, currency: string, period: string, concept: string>"
#: Units of figure objects as powers of ten, and scales at which a bare number may agree.
UNITS = {"thousands": 3, "millions": 6, "billions": 9, "trillions": 12}
UNSTATED = (3, 6, 9, 12)
#: The caption line that states a scale, the exception for amounts per share, and how a period is stated.
CAPTION = r"(?im)^\[Table:[^\n]*\|\s*in\s+(thousands|millions|billions)\b"
EXCEPT_PER_SHARE = r"(?i)except\s+(?:for\s+)?per[\s-]share"
PERIOD = (
    r"(?i)\b(?:Q[1-4]|FY\s?'?\d{2,4}|fiscal\s+(?:year\s+)?\d{4}|(?:19|20)\d{2}|(?:year|quarter|months|weeks)\s+ended)\b"
    r"|\b(?:first|second|third|fourth)\s+quarter\b"
)


def unit_power(unit: Column) -> Column:
    """Power of ten of a figure object's unit, 0 for any other."""
    out = F.lit(0)
    for name, power in UNITS.items():
        out = F.when(F.lower(unit) == name, F.lit(power)).otherwise(out)
    return out


def figure_value(figure: Column) -> Column:
    """magnitude in base units and whether it is a percentage; null without a value."""
    percent = F.lower(F.coalesce(figure["unit"], F.lit(""))) == "percent"
    scaled = F.when(percent, F.abs(figure["value"])).otherwise(apply_scale(F.abs(figure["value"]), unit_power(F.coalesce(figure["unit"], F.lit("")))))
    return F.when(figure["value"].isNotNull(), F.struct(scaled.cast(MONEY).alias("magnitude"), percent.alias("percent")))


def period_stated(text: Column) -> Column:
    """Whether a claim states a period."""
    return F.coalesce(text.rlike(PERIOD), F.lit(False))


def text_sets(texts: DataFrame, key: str, text: str, zero_spans: DataFrame | None = None) -> DataFrame:
    """Per text its sets of magnitudes: scaled, raw, percent and unscaled, and the flags except_per_share and zero_span.

    A figure is scaled by its own word, else by the caption, else it is unscaled; raw holds it as printed.
    zero_spans, rows of key, names texts with a tagged value of zero.
    """
    word = F.regexp_extract(F.col("t"), CAPTION, 1)
    caption = F.when(F.lower(word) == "thousands", 3).when(F.lower(word) == "millions", 6).when(F.lower(word) == "billions", 9)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("t")).filter("key is not null").withColumn("f", masked_figures(F.col("t"))).withColumn("power", caption)
    pick = lambda keep, value: F.array_distinct(F.transform(F.filter("f", keep), value))
    plain = lambda x: ~x["percent"]
    out = rows.select(
        "key",
        pick(lambda x: plain(x) & (x["power"].isNotNull() | F.col("power").isNotNull()), lambda x: apply_scale(x["number"], F.coalesce(x["power"], F.col("power")))).alias("scaled"),
        pick(plain, lambda x: x["number"]).alias("raw"),
        pick(lambda x: x["percent"], lambda x: x["number"]).alias("percent"),
        pick(lambda x: plain(x) & x["power"].isNull() & F.col("power").isNull(), lambda x: x["number"]).alias("unscaled"),
        F.coalesce(F.col("t").rlike(EXCEPT_PER_SHARE), F.lit(False)).alias("except_per_share"),
    )
    if zero_spans is None:
        return out.withColumn("zero_span", F.lit(False))
    return out.join(zero_spans.select("key").distinct().withColumn("zero_span", F.lit(True)), "key", "left").withColumn("zero_span", F.coalesce("zero_span", F.lit(False)))


def claim_numbers(text: Column, figure: Column) -> Column:
    """Array of the numbers of a claim, those of its text before its figure object, each magnitude and kind once: magnitude, percent, places."""
    places = lambda printed: F.length(F.regexp_extract(printed, r"\d+(?:,\d{3})*\.(\d+)", 1))
    said = F.transform(
        masked_figures(F.coalesce(text, F.lit(""))),
        lambda x: F.struct(F.when(x["percent"] | x["power"].isNull(), x["number"]).otherwise(apply_scale(x["number"], x["power"])).cast(MONEY).alias("magnitude"), x["percent"].alias("percent"), places(x["printed"]).alias("places")),
    )
    value = figure_value(figure)
    own = F.when(value.isNull(), F.array().cast("array<struct<magnitude: decimal(38,6), percent: boolean, places: int>>")).otherwise(
        F.array(F.struct(value["magnitude"].alias("magnitude"), value["percent"].alias("percent"), F.length(F.regexp_extract(F.regexp_replace(figure["value"].cast("string"), r"\.?0+$", ""), r"\.(\d+)$", 1)).alias("places")))
    )
    every = F.concat(said, own)
    first = lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: (y["magnitude"] == x["magnitude"]) & (y["percent"] == x["percent"]))
    return F.filter(every, lambda x, i: x["magnitude"].isNotNull() & F.when(i == 0, F.lit(True)).otherwise(first(x, i)))


def grounded(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Claims with numbers, array of magnitude, percent, places, grounded_in and how: printed, printed_unscaled, derived or null.

    Only cited texts that are in texts (text_sets) count. A number is printed if a cited text prints it,
    scaled or as it is, or holds a zero span for zero; printed_unscaled if a number without a stated scale
    agrees at thousands, millions, billions or trillions; derived if it is the difference of two grounded
    numbers of the answer, or their change in percent at its printed places.
    """
    numbered = claims.withColumn("n", claim_numbers(F.col("text"), F.col("figure")))
    cited = numbered.select("answer_id", "claim_id", F.explode(F.array_distinct(F.coalesce("citations", F.array().cast("array<string>")))).alias("key"), "n").join(texts, "key")
    has = lambda values, x: F.array_contains(values, x["magnitude"])
    zero = lambda x: (x["magnitude"] == 0) & F.col("zero_span")
    printed = lambda x: F.when(x["percent"], has(F.col("percent"), x)).otherwise(has(F.col("scaled"), x) | has(F.col("raw"), x) | zero(x))
    bare = lambda x: ~x["percent"] & F.exists("unscaled", lambda v: F.exists(F.array(*[F.lit(p) for p in UNSTATED]), lambda p: apply_scale(v, p) == x["magnitude"]))
    per_text = cited.select("answer_id", "claim_id", "key", F.posexplode("n").alias("no", "x"), "percent", "scaled", "raw", "unscaled", "zero_span")
    marked = per_text.select("answer_id", "claim_id", "no", "key", printed(F.col("x")).alias("printed"), bare(F.col("x")).alias("bare"))
    found = marked.groupBy("answer_id", "claim_id", "no").agg(
        F.array_sort(F.collect_set(F.when(F.col("printed"), F.col("key")))).alias("printed_in"), F.array_sort(F.collect_set(F.when(F.col("bare"), F.col("key")))).alias("bare_in")
    )
    each = numbered.select("answer_id", "claim_id", F.posexplode("n").alias("no", "x")).join(found, ["answer_id", "claim_id", "no"], "left")
    none = F.array().cast("array<string>")
    each = each.select(
        "answer_id", "claim_id", "no", "x",
        F.when(F.size(F.coalesce("printed_in", none)) > 0, F.col("printed_in")).otherwise(F.coalesce("bare_in", none)).alias("grounded_in"),
        F.when(F.size(F.coalesce("printed_in", none)) > 0, "printed").when(F.size(F.coalesce("bare_in", none)) > 0, "printed_unscaled").alias("how"),
    )
    # an answer's own grounded amounts; a list per answer, which is as long as the answer
    pool = each.filter("how is not null and not x.percent").groupBy("answer_id").agg(F.array_sort(F.collect_list("x.magnitude")).alias("pool"))
    half = lambda x: F.lit(0.5).cast("decimal(13,7)") / F.element_at(F.array(*[F.lit(10**p).cast("decimal(7,0)") for p in range(7)]), F.least(x["places"], F.lit(6)) + 1)
    amount = "decimal(24,6)"

    def change(a: Column, b: Column, x: Column) -> Column:
        moved = F.abs(b.try_cast(amount) - a.try_cast(amount)) * 100
        low, high = (x["magnitude"].try_cast("decimal(12,6)") + sign * half(x) for sign in (-1, 1))
        return (a != 0) & (moved >= F.try_multiply(low.try_cast("decimal(13,7)"), a.try_cast(amount))) & (moved < F.try_multiply(high.try_cast("decimal(13,7)"), a.try_cast(amount)))

    def from_pool(x: Column) -> Column:
        pairs = lambda test: F.exists("pool", lambda a: F.exists("pool", lambda b: test(a, b)))
        twice = F.size(F.filter("pool", lambda a: F.size(F.filter("pool", lambda b: b == a)) > 1)) > 0
        difference = F.when(x["magnitude"] == 0, twice).otherwise(pairs(lambda a, b: a - b == x["magnitude"]))
        return F.when(x["percent"], pairs(lambda a, b: F.coalesce(change(a, b, x), F.lit(False))) | ((x["magnitude"] == 0) & twice)).otherwise(difference)

    derived = each.join(pool, "answer_id", "left").withColumn("how", F.coalesce("how", F.when(F.coalesce(from_pool(F.col("x")), F.lit(False)), F.lit("derived"))))
    lists = derived.groupBy("answer_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "x", "grounded_in", "how"))), lambda r: F.struct(r["x"]["magnitude"].alias("magnitude"), r["x"]["percent"].alias("percent"), r["x"]["places"].alias("places"), r["grounded_in"].alias("grounded_in"), r["how"].alias("how"))).alias("numbers"))
    out = claims.join(lists, ["answer_id", "claim_id"], "left")
    return out.withColumn("numbers", F.coalesce("numbers", F.array().cast("array<struct<magnitude: decimal(38,6), percent: boolean, places: int, grounded_in: array<string>, how: string>>")))


def with_unit(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found with numbers_grounded, numbers_derived, period_stated, citations_supporting and unit_ok (true, false, unknown; null without a figure).

    A unit is right if a cited text prints the figure at its scale, holds a zero span for zero, or prints it
    as it is where that is allowed: amounts per share are excepted from the caption, or the text has no
    scaled number and the unit is ones. A derived figure is right, one of unstated scale unknown.
    """
    value = figure_value(F.col("figure"))
    f = found.withColumn("v", value)
    cited = f.filter("v is not null").select("answer_id", "claim_id", "v", F.coalesce("figure.unit", F.lit("")).alias("unit"), F.explode("citations").alias("key")).join(texts, "key")
    m = F.col("v.magnitude")
    as_is = F.array_contains("raw", m) & (F.col("except_per_share") | ((F.size("scaled") == 0) & (F.col("unit") == "ones")))
    right = F.when(F.col("v.percent"), F.array_contains("percent", m)).otherwise(F.array_contains("scaled", m) | ((m == 0) & F.col("zero_span")) | as_is)
    per = cited.groupBy("answer_id", "claim_id").agg(F.bool_or(right).alias("right"))
    own = F.transform(F.filter("numbers", lambda n: (n["magnitude"] == m) & (n["percent"] == F.col("v.percent"))), lambda n: n["how"])
    unit = F.when(F.coalesce("right", F.lit(False)) | F.array_contains(own, "derived"), "true").when(F.array_contains(own, "printed_unscaled"), "unknown").otherwise("false")
    return f.join(per, ["answer_id", "claim_id"], "left").withColumns(
        {
            "unit_ok": F.when(F.col("v").isNotNull(), unit),
            "numbers_grounded": F.forall("numbers", lambda n: n["how"].isNotNull()),
            "numbers_derived": F.exists("numbers", lambda n: F.coalesce(n["how"] == "derived", F.lit(False))),
            "period_stated": period_stated(F.col("text")),
            "citations_supporting": F.array_sort(F.array_distinct(F.flatten(F.transform("numbers", lambda n: n["grounded_in"])))),
        }
    ).drop("v", "right")


def claim_kind(figure: Column, text: Column) -> Column:
    """per_share by its words, else monetary with a currency, else shares; null for a percentage or no figure."""
    words = F.lower(F.concat_ws(" ", text, F.coalesce(figure["concept"], F.lit(""))))
    per_share = words.contains("per share") | words.rlike(r"\beps\b")
    return F.when(figure["value"].isNull() | (F.coalesce(figure["unit"], F.lit("")) == "percent"), None).when(per_share, "per_share").when(F.coalesce(figure["currency"], F.lit("")) != "", "monetary").otherwise("shares")


def fact_kind(unit: Column) -> Column:
    """Kind of a fact by its unit, null for any other."""
    return F.when(unit == "USD", "monetary").when(unit == "USD/shares", "per_share").when(unit == "shares", "shares")


def concept_tags(phrases: DataFrame) -> DataFrame:
    """phrase and tags of a table of item, tag, variant and phrase: labels and synonyms in canonical form, exact matches only."""
    return phrases.filter("phrase is not null").groupBy(phrase_key(F.col("phrase")).alias("phrase")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array("tag", "variant"), lambda x: x.isNotNull()))))).alias("tags"))


def fact_checks(claims: DataFrame, phrases: DataFrame, filings: DataFrame, facts: DataFrame, period_ends: DataFrame, percent: float) -> DataFrame:
    """answer_id, claim_id, kind, status and why of figure claims: not_checked, no_fact, verified, restatement, rounded or contradiction.

    A claim needs a value and a kind, citations of one company, a known concept and a period that resolves;
    period_ends has answer_id, claim_id and period_end. filings has accession and cik; facts accession,
    cik, concept, unit, period_end and value. period_ok is true for a match at the period, false where a
    contradicted number is that of another period of a cited filing.
    """
    f = claims.filter("figure.value is not null").withColumns({"kind": claim_kind(F.col("figure"), F.col("text")), "magnitude": figure_value(F.col("figure"))["magnitude"]})
    cited = f.select("answer_id", "claim_id", F.explode("citations").alias("key")).select("answer_id", "claim_id", F.substring_index("key", ":", 1).alias("accession")).distinct()
    company = cited.join(filings.select("accession", "cik").distinct(), "accession").groupBy("answer_id", "claim_id").agg(F.array_sort(F.collect_set("cik")).alias("ciks"))
    named = f.withColumn("phrase", phrase_key(F.coalesce("figure.concept", F.lit("")))).join(phrases, "phrase", "left").join(company, ["answer_id", "claim_id"], "left")
    ends = period_ends.groupBy("answer_id", "claim_id").agg(F.array_sort(F.collect_set("period_end")).alias("ends"))
    named = named.join(ends, ["answer_id", "claim_id"], "left")
    why = (
        F.when(F.col("kind").isNull(), "not_checked")
        .when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0, "no concept")
        .when(F.coalesce(F.size("ciks"), F.lit(0)) != 1, "citations span companies")
        .when(F.coalesce(F.size("ends"), F.lit(0)) <= 0, "period unresolved")
    )
    named = named.withColumn("why", why)
    x = facts.filter("value is not null").select(F.col("cik").alias("f_cik"), F.col("concept").alias("f_concept"), F.col("period_end").alias("f_end"), F.col("accession").alias("f_acc"), F.col("value").alias("f_value"), fact_kind(F.col("unit")).alias("f_kind"))
    said = F.col("figure.value").alias("said"), unit_power(F.coalesce("figure.unit", F.lit(""))).alias("power")
    open_ = named.filter("why is null").select("answer_id", "claim_id", "kind", "magnitude", F.col("ciks")[0].alias("cik"), "ends", "tags", *said)
    open_ = open_.select(*[c for c in open_.columns if c != "tags"], F.explode("tags").alias("concept"))
    joined = open_.join(x, (F.col("cik") == F.col("f_cik")) & (F.col("concept") == F.col("f_concept")) & (F.col("kind") == F.col("f_kind")), "left")
    mine = cited.select(F.col("answer_id").alias("c_answer"), F.col("claim_id").alias("c_claim"), F.col("accession").alias("c_acc"))
    joined = joined.join(mine, (F.col("answer_id") == F.col("c_answer")) & (F.col("claim_id") == F.col("c_claim")) & (F.col("f_acc") == F.col("c_acc")), "left")
    at, own, close = F.array_contains("ends", F.col("f_end")), F.col("c_acc").isNotNull(), within(F.col("magnitude"), F.col("f_value"), percent)
    span = object_interval(F.col("said"), F.col("power"))
    inside = (F.abs("f_value") >= span["lo"]) & (F.abs("f_value") < span["hi"])
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = joined.groupBy("answer_id", "claim_id").agg(
        any_(at & own & close).alias("v"), any_(at & own).alias("c"), any_(at & ~own & close).alias("r"), any_(at & own & inside).alias("i"), any_(~at & own & close).alias("e"),
        F.array_sort(F.collect_set(F.when(at & own, F.col("f_value")))).alias("cited_values"),
    )
    status = F.when(F.col("v"), "verified").when(~F.col("c"), "no_fact").when(F.col("r"), "restatement").when(F.col("i"), "rounded").otherwise("contradiction")
    done = flags.select("answer_id", "claim_id", status.alias("s"), F.when(status.isin("verified", "restatement", "rounded"), True).when((status == "contradiction") & F.col("e"), False).alias("period_ok"), "cited_values")
    out = named.join(done, ["answer_id", "claim_id"], "left")
    return out.select("answer_id", "claim_id", "kind", F.when(F.col("why") == "not_checked", "not_checked").when(F.col("why").isNotNull(), "no_fact").otherwise(F.col("s")).alias("status"), F.when(F.col("why") != "not_checked", F.col("why")).alias("why"), "period_ok", "cited_values")


def targets_in(questions: DataFrame, names: DataFrame) -> DataFrame:
    """answer_id and cik of the companies that a question names as a whole word, by ticker or name; names has cik and name.

    Question words are joined with the first words of names, so nothing is crossed; then the whole name is sought.
    """
    first = lambda c: F.regexp_extract(F.lower(c), r"[a-z0-9]+", 0)
    n = names.filter("name is not null").select("cik", "name", first(F.col("name")).alias("w")).filter("w <> ''").distinct()
    q = questions.select("answer_id", "question", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z]+|[0-9]+|[a-z0-9]+"), 0))).alias("w"))
    return q.join(n, "w").filter(has_word(F.col("question"), F.col("name"))).select("answer_id", "cik").distinct()


def checked(claims: DataFrame, questions: DataFrame, given: DataFrame, texts: DataFrame, facts: DataFrame, entail: DataFrame, filings: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with all checks of the gate.

    questions has answer_id and question; given answer_id and key, the texts that the answerer saw; facts is
    the result of fact_checks; entail has answer_id, claim_id, key and entail, stored scores of a model.
    A citation is valid if there is one and all were given; an entity is right if the question names no
    company or every cited filing is of a named one. A figure of unknown scale is right if a fact
    verifies or restates it. entail of a prose claim is the best of its cited texts, 0 without any.
    """
    seen = given.groupBy("answer_id").agg(F.collect_set("key").alias("given"))
    usable = texts.join(given.select("key").distinct(), "key", "left_semi")
    base = claims.withColumn("citations", F.coalesce("citations", F.array().cast("array<string>"))).join(seen, "answer_id", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    # texts that were not given to this answer do not count for it
    own = base.withColumn("citations", F.array_intersect("citations", "given"))
    found = with_unit(grounded(own.select("answer_id", "claim_id", "text", "citations", "figure"), usable), usable)
    named = targets_in(questions, names).groupBy("answer_id").agg(F.collect_set("cik").alias("targets"))
    cited = base.select("answer_id", "claim_id", F.explode("citations").alias("key")).select("answer_id", "claim_id", F.substring_index("key", ":", 1).alias("accession")).join(filings.select("accession", "cik").distinct(), "accession", "left")
    who = cited.groupBy("answer_id", "claim_id").agg(F.collect_set(F.coalesce("cik", F.lit("?"))).alias("who"))
    best = entail.groupBy("answer_id", "claim_id").agg(F.max("entail").alias("best"))
    rows = (
        base.select("answer_id", "claim_id", "text", F.col("citations"), "figure", "given")
        .join(found.drop("text", "citations", "figure"), ["answer_id", "claim_id"])
        .join(who, ["answer_id", "claim_id"], "left").join(named, "answer_id", "left").join(best, ["answer_id", "claim_id"], "left")
        .join(facts.select("answer_id", "claim_id", "status", "period_ok"), ["answer_id", "claim_id"], "left")
    )
    return rows.select(
        "answer_id", "claim_id", "text", "citations", "figure", "numbers", "numbers_grounded", "numbers_derived", "period_stated", "citations_supporting", "status", "period_ok",
        F.col("figure.value").isNotNull().alias("has_figure"),
        ((F.size("citations") > 0) & (F.size(F.array_except("citations", "given")) == 0)).alias("citation_valid"),
        (F.col("targets").isNull() | (F.size(F.array_except(F.coalesce("who", F.array().cast("array<string>")), "targets")) == 0)).alias("entity_ok"),
        F.when((F.col("unit_ok") == "unknown") & F.col("status").isin("verified", "restatement"), "true").otherwise(F.col("unit_ok")).alias("unit_ok"),
        F.coalesce(F.col("status") == "contradiction", F.lit(False)).alias("contradiction"),
        F.when(F.col("figure.value").isNull(), F.coalesce("best", F.lit(0.0))).alias("entail"),
    )


def rechecked(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored checked claims with the checks that need no model taken from fresh ones; citation, entity and entailment stay as stored."""
    again = ("numbers", "numbers_grounded", "numbers_derived", "unit_ok", "period_stated", "status", "period_ok", "contradiction")
    new = fresh.select("answer_id", "claim_id", *again, F.col("citations_supporting").alias("_supporting"))
    kept = stored.drop(*again).join(new, ["answer_id", "claim_id"])
    return kept.withColumn("citations_supporting", F.when(F.col("has_figure"), F.col("_supporting")).otherwise(F.col("citations_supporting"))).drop("_supporting")


def rescored(claims: DataFrame, entail: DataFrame, threshold: float) -> DataFrame:
    """Claims with the supporting citations of prose ones at a threshold: cited texts whose stored score reaches it."""
    good = entail.filter(F.col("entail") >= threshold).groupBy("answer_id", "claim_id").agg(F.array_sort(F.collect_set("key")).alias("_good"))
    out = claims.join(good, ["answer_id", "claim_id"], "left")
    return out.withColumn("citations_supporting", F.when(F.col("has_figure"), F.col("citations_supporting")).otherwise(F.coalesce("_good", F.array().cast("array<string>")))).drop("_good")


def failed_checks(claims: DataFrame, kept: Column) -> DataFrame:
    """Claims that are not kept, with the names of the checks that failed."""
    figure = F.col("has_figure")
    failed = F.array(
        F.when(~F.col("citation_valid"), F.lit("citation_valid")), F.when(~F.col("entity_ok"), F.lit("entity_ok")), F.when(figure & ~F.col("numbers_grounded"), F.lit("numbers_grounded")),
        F.when(figure & (F.col("unit_ok") == "false"), F.lit("unit_ok")), F.when(figure & ~F.col("period_stated"), F.lit("period_stated")), F.when(F.col("contradiction"), F.lit("contradiction")), F.when(~figure, F.lit("entail")),
    )
    return claims.filter(~kept).select("answer_id", "claim_id", F.filter(failed, lambda x: x.isNotNull()).alias("failed"))


def item_verdicts(answers: DataFrame) -> DataFrame:
    """answer_id, verdict and reason: the model's own abstention stands, else the gate's verdict; answers has model_abstained, verdict and contradicted."""
    v, own = F.col("verdict"), F.coalesce("model_abstained", F.lit(False))
    reason = F.when(own, "insufficient_evidence").when(v == "ABSTAIN", F.when(F.col("contradicted"), "contradiction").otherwise("verifier"))
    return answers.select("answer_id", F.when(own, "ABSTAIN").otherwise(F.coalesce(v, F.lit("PENDING"))).alias("verdict"), reason.alias("reason"))
