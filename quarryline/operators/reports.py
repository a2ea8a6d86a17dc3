"""Reports of runs: confusion by source, spreads between runs, numeric aggregates, thresholds with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.numbers import apply_scale, masked_figures, parse_number
from quarryline.operators.metrics import by_source, rate
from quarryline.operators.scoring import exact, quantum, tolerant

#: Tags that state the scale of a table's answer.
TAG_SCALES = {"unit_scale_thousands": 3, "unit_scale_millions": 6, "unit_scale_billions": 9}


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows for each combination; a null counts as none."""
    return rows.groupBy(*[F.coalesce(F.col(b).cast("string"), F.lit("none")).alias(b) for b in by]).agg(F.count("*").alias("rows"))


def matrix(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts with a column for each of the given values, 0 for none."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def fact_summary(claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by status, matches by concept phrase, and the contradictions, of claims with status and phrase."""
    matched = claims.filter(F.col("status").isin("verified", "restatement", "rounded") & F.col("phrase").isNotNull()).groupBy("phrase").agg(F.count("*").alias("matched"))
    return counts(claims.filter("status is not null"), "status"), matched, claims.filter("status = 'contradiction'")


def references(items: DataFrame) -> DataFrame:
    """Items with refs, the figures that an answer must give (value, unit of the last digit), or why they are excluded.

    xbrl_numeric has one, comparison three (later, earlier, difference), a factual table its answer at the
    scale of its tag; any other is not numeric. A reference with fewer figures than it needs is broken.
    """
    found = masked_figures(F.coalesce("reference_answer", F.lit("")))
    power = lambda x: F.when(x["percent"] | x["power"].isNull(), F.lit(0)).otherwise(x["power"])
    digits = lambda x: F.regexp_extract(x["printed"], r"\d[\d,]*(?:\.\d+)?", 0)
    signed = lambda x: F.when(x["negative"], -x["number"]).otherwise(x["number"])
    ref = lambda x: F.struct(apply_scale(signed(x), power(x)).alias("value"), quantum(digits(x), power(x)).alias("unit"))
    scale = F.lit(None).cast("int")
    for tag, p in TAG_SCALES.items():
        scale = F.when(F.array_contains("tags", tag), F.lit(p)).otherwise(scale)
    own = F.regexp_replace(F.trim("reference_answer"), r"^\$|\s*%$", "")
    factual = (F.col("question_type") == "table") & F.coalesce(F.array_contains("tags", "kind:factual"), F.lit(False))
    need = F.when(F.col("question_type") == "xbrl_numeric", 1).when(F.col("question_type") == "comparison", 3)
    rows = items.withColumns({"_all": F.transform(found, ref), "_need": need})
    table = F.array(F.struct(apply_scale(parse_number(own), scale).alias("value"), quantum(own, scale).alias("unit")))
    why = (
        F.when(F.col("_need").isNotNull(), F.when(F.size("_all") < F.col("_need"), "broken"))
        .when(factual, F.when(F.array_contains("tags", "unit_scale_unknown"), "unit_scale_unknown").when(scale.isNull() | parse_number(own).isNull(), "broken"))
        .otherwise("not numeric")
    )
    refs = F.when(F.col("_need").isNotNull(), F.slice("_all", 1, F.col("_need"))).otherwise(table)
    return rows.withColumn("excluded", why).withColumn("refs", F.when(F.col("excluded").isNull(), refs)).drop("_all", "_need")


def item_scores(items: DataFrame) -> DataFrame:
    """Per item the numeric scores of an answer: items has the columns of references, answer, abstained and figures, the figure objects (value, unit) of its claims.

    Figure objects count where there are any, else the figures of the text. correct needs every reference
    exactly, strict among the first figures, tolerant within half a percent; values_only the two values of a
    comparison; sign_agrees is judged where a matched figure shows its sign. Zero words answer a zero.
    """
    from quarryline.operators.claims import unit_power

    signed = lambda x: F.struct(apply_scale(F.when(x["negative"], -x["number"]).otherwise(x["number"]), F.when(x["percent"] | x["power"].isNull(), F.lit(0)).otherwise(x["power"])).alias("value"), x["negative"].alias("signed"))
    objects = F.transform(F.filter(F.coalesce("figures", F.array().cast("array<struct<value: decimal(38,6), unit: string>>")), lambda f: f["value"].isNotNull()), lambda f: F.struct(apply_scale(f["value"], unit_power(F.coalesce(f["unit"], F.lit("")))).alias("value"), F.lit(True).alias("signed")))
    said = F.transform(masked_figures(F.coalesce("answer", F.lit(""))), signed)
    rows = items.withColumns({"_fallback": F.size(objects) == 0, "_said": F.when(F.size(objects) > 0, objects).otherwise(said)})
    zero = (F.size("_said") == 0) & F.forall("refs", lambda r: r["value"] == 0) & F.coalesce(F.col("answer").rlike(r"(?i)\b(?:none|nil|zero)\b|^\s*[-–—]\s*$"), F.lit(False))
    rows = rows.withColumn("_said", F.when(zero, F.array(F.struct(F.lit(0).cast("decimal(38,6)").alias("value"), F.lit(False).alias("signed")))).otherwise(F.col("_said")))
    hit = lambda figs, test: F.forall("refs", lambda r: F.exists(figs, lambda f: F.coalesce(test(f["value"], r), F.lit(False))))
    same = lambda v, r: exact(v, r["value"], r["unit"])
    close = lambda v, r: tolerant(v, r["value"])
    scored = F.col("excluded").isNull() & ~F.coalesce("abstained", F.lit(False))
    said = F.col("_said")
    first = F.transform("refs", lambda r: F.struct(r.alias("r"), F.get(F.filter(said, lambda f: F.coalesce(exact(f["value"], r["value"], r["unit"]), F.lit(False))), F.lit(0)).alias("f")))
    judged = F.filter(first, lambda x: F.coalesce(x["f"]["signed"], F.lit(False)))
    two = F.forall(F.slice("refs", 1, 2), lambda r: F.exists(said, lambda f: F.coalesce(exact(f["value"], r["value"], r["unit"]), F.lit(False))))
    return rows.select(
        "item_id", "source", "excluded", F.coalesce("abstained", F.lit(False)).alias("abstained"),
        F.when(F.col("excluded").isNull(), scored & hit(said, same)).alias("correct"),
        F.when(F.col("excluded").isNull(), scored & (F.size("_said") >= F.size("refs")) & hit(F.slice("_said", F.lit(1), F.greatest(F.size("refs"), F.lit(1))), same)).alias("strict"),
        F.when(F.col("excluded").isNull(), scored & hit(said, close)).alias("tolerant"),
        F.when(scored & (F.size("refs") == 3), two).alias("values_only"),
        F.when(scored & (F.size(judged) > 0), F.forall(judged, lambda x: (x["f"]["value"] < 0) == (x["r"]["value"] < 0))).alias("sign_agrees"),
        F.when(scored, F.size("_said")).alias("figures"), F.when(scored, F.col("_fallback")).alias("fallback"),
    )


def numeric_report(scores: DataFrame) -> DataFrame:
    """Per source and over all: items scored and excluded, accuracy of each kind, abstentions, mean figures."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return by_source(scores, "source", {
        "n": F.count_if(F.col("excluded").isNull()), "excluded": F.count("excluded"), "accuracy": share("correct"), "strict": share("strict"), "tolerant": share("tolerant"),
        "values_only": share("values_only"), "sign_agreement": share("sign_agrees"), "signs": F.count("sign_agrees"),
        "abstained": F.count_if(F.col("abstained") & F.col("excluded").isNull()), "fallback": F.count_if("fallback"), "mean_figures": F.round(F.avg(F.when(F.col("excluded").isNull(), F.coalesce("figures", F.lit(0)))), 6),
    })


def claim_report(claims: DataFrame, by: list[str]) -> DataFrame:
    """Rates of checked claims: faithfulness before and after the gate with the lift, retention, coverage and precision of citations, unit and period rates.

    claims has supported, kept, answered, has_figure, citations, citations_supporting, unit_ok, period_ok and
    contradiction. Faithfulness counts answered items only; precision is supporting citations over all; a
    unit of unknown scale is not right; period_ok null cannot be checked.
    """
    answered = F.col("answered")
    pre = rate(F.count_if(answered & F.col("supported")), F.count_if(answered))
    post = rate(F.count_if(answered & F.col("kept") & F.col("supported")), F.count_if(answered & F.col("kept")))
    return claims.groupBy(*by).agg(
        F.count("*").alias("claims"), pre.alias("faithful_before"), post.alias("faithful_after"), F.round(post - pre, 6).alias("lift"), rate(F.count_if("kept"), F.count("*")).alias("retention"),
        rate(F.count_if(F.size("citations") > 0), F.count("*")).alias("citation_coverage"),
        rate(F.sum(F.size(F.array_intersect("citations", "citations_supporting"))), F.sum(F.size("citations"))).alias("citation_precision"),
        rate(F.count_if(F.col("has_figure") & (F.col("unit_ok") == "true")), F.count_if("has_figure")).alias("unit_accuracy"),
        rate(F.count_if("period_ok"), F.count("period_ok")).alias("period_accuracy"), F.count("period_ok").alias("period_checkable"),
        rate(F.count_if("contradiction"), F.count_if("has_figure")).alias("contradictions"),
    )


def spread(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """One row over items of both runs: items, equal, flips either way for booleans, and the mean difference."""
    b = one.select(key, F.col(value).cast("double").alias("a")).join(two.select(key, F.col(value).cast("double").alias("b")), key)
    return b.agg(F.count("*").alias("items"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal"), F.count_if(F.col("a") > F.col("b")).alias("lost"), F.count_if(F.col("a") < F.col("b")).alias("won"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_change"))


def right_without_evidence(scores: DataFrame, ranked: DataFrame) -> DataFrame:
    """item_id of items answered right though no evidence set was wholly retrieved; ranked has query_id and sufficient."""
    return scores.filter("correct").join(ranked.filter("not sufficient").select(F.col("query_id").alias("item_id")), "item_id", "left_semi").select("item_id")


def rerank_columns(runs: DataFrame, by: list[str], timeout: float) -> DataFrame:
    """Sufficiency before and after reranking, items the floor emptied, and those over the timeout; runs has before, after, kept and seconds."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return runs.groupBy(*by).agg(F.count("*").alias("items"), mean("before").alias("before"), mean("after").alias("after"), F.count_if(F.col("kept") == 0).alias("floor_empty"), F.count_if(F.col("seconds") > timeout).alias("over_timeout"))


def verdict_change(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Items by verdict before and after; verdicts have item_id and verdict."""
    b = before.select("item_id", *by, F.col("verdict").alias("was")).join(after.select("item_id", F.col("verdict").alias("now")), "item_id")
    return b.groupBy(*by, "was", "now").agg(F.count("*").alias("items"))


def pending_rates(rows: DataFrame, by: list[str], rates: dict[str, Column], pending: Column) -> DataFrame:
    """Rates per group, all of them null while any row of the group is pending."""
    waits = F.bool_or(F.coalesce(pending, F.lit(False)))
    return rows.groupBy(*by).agg(waits.alias("pending"), *[F.when(~waits, c).alias(n) for n, c in rates.items()])


def threshold_rows(thresholds: DataFrame, overrides: DataFrame, by_scope: DataFrame, deltas: DataFrame) -> DataFrame:
    """Rules of a gate: each minimum and maximum for all items and for the hand-written, there with its override; minimums of single sources; deltas for all.

    thresholds has metric, rule and tolerance; overrides metric and tolerance of the hand-written, of which
    those without a rule are minimums; by_scope scope, metric and tolerance; deltas metric and tolerance.
    """
    hand = thresholds.join(overrides.withColumnRenamed("tolerance", "_own"), "metric", "left").select(F.lit("handwritten").alias("scope"), "metric", "rule", F.coalesce("_own", "tolerance").alias("tolerance"))
    only = overrides.join(thresholds, "metric", "left_anti").select(F.lit("handwritten").alias("scope"), "metric", F.lit("min").alias("rule"), "tolerance")
    each = by_scope.filter("scope <> 'handwritten'").select("scope", "metric", F.lit("min").alias("rule"), "tolerance")
    moved = deltas.select(F.lit("all").alias("scope"), "metric", F.lit("delta").alias("rule"), "tolerance")
    out = thresholds.select(F.lit("all").alias("scope"), "metric", "rule", "tolerance")
    for part in (hand, only, each, moved):
        out = out.unionByName(part)
    return out


def passed(gate_rows: DataFrame, development: bool = False) -> DataFrame:
    """One row: rules, those passed, failed and pending, and whether the run passes: all rules do and it is no development run."""
    n = lambda s: F.count_if(F.col("status") == s)
    return gate_rows.agg(F.count("*").alias("rules"), n("pass").alias("passed"), n("fail").alias("failed"), n("pending").alias("pending"), ((n("pass") == F.count("*")) & (F.count("*") > 0) & F.lit(not development)).alias("passes"))


def run_kind(path: Column, development: Column) -> Column:
    """Kind of a run by its file: retrieval, else development or gated by its flag."""
    return F.when(path.rlike(r"\.retrieval\.json$"), "retrieval").when(F.coalesce(development, F.lit(False)), "development").otherwise("gated")


def payload(rows: DataFrame, key: str) -> DataFrame:
    """key and one JSON object of the other columns per row, nulls kept."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"}).alias("payload"))


def floor_emptied(verdict: Column, reason: Column, retrieved: Column, claims: Column) -> Column:
    """Whether a record was emptied by the score floor: its reason says so, or, in records without one, it abstained with texts retrieved and no claim made."""
    return F.coalesce(reason == "score_floor", F.lit(False)) | (reason.isNull() & F.coalesce((verdict == "ABSTAIN") & (F.size(retrieved) == 0) & (F.size(claims) == 0), F.lit(False)))


def text_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One column `line`: rows of a report as markdown."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |")).alias("line"))
