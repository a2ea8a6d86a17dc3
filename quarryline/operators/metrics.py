"""Measures of runs: ranking, abstention, claims, agreement, cost and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.relational import running


def rate(num: Column, den: Column) -> Column:
    """num / den, null for a zero denominator, to six places."""
    return F.round(F.try_divide(num, den), 6)


def ranking(items: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Per item sufficiency, recall, precision and nDCG at k, and MRR over the whole list.

    items has query_id and sets, an array of arrays of docs, each a full evidence; lists has query_id,
    rank and doc. Sufficient is a list with one set whole in its first k; recall is the best share of a
    set; precision divides by k; nDCG is the best over sets. Items without a set have nulls, those
    without a list zeros. Lists are joined by item, so a task holds one list.
    """
    whole = lists.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
    rows = items.join(whole, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    rows = rows.withColumn("sets", F.filter("sets", lambda s: F.size(s) > 0)).withColumn("first", F.slice("docs", 1, k))
    union = F.array_distinct(F.flatten("sets"))
    places = lambda s: F.filter(F.transform(F.array_distinct(s), lambda d: F.array_position("first", d)), lambda p: p > 0)
    gain = lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, p: a + 1 / F.log2(p.cast("double") + 1))
    ideal = lambda s: gain(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(s)), F.lit(k))))
    hit = F.array_min(F.filter(F.transform(union, lambda d: F.array_position("docs", d)), lambda p: p > 0))
    has = F.coalesce(F.size("sets") > 0, F.lit(False))
    return rows.select(
        "query_id",
        F.when(has, F.exists("sets", lambda s: F.size(F.array_except(s, "first")) == 0)).alias("sufficient"),
        F.when(has, F.round(F.array_max(F.transform("sets", lambda s: F.size(F.array_intersect(s, "first")) / F.size(F.array_distinct(s)))), 6)).alias("recall"),
        F.when(has, F.round(F.size(F.array_intersect(union, "first")) / k, 6)).alias("precision"),
        F.when(has, F.round(F.coalesce(1 / hit, F.lit(0.0)), 6)).alias("mrr"),
        F.when(has, F.round(F.array_max(F.transform("sets", lambda s: gain(places(s)) / ideal(s))), 6)).alias("ndcg"),
    )


def two_by_two(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of answered and abstained against answerable and not, and the rates that follow.

    rows has expected_abstain and verdict, where PARTIAL counts as answered and null verdicts are left out.
    """
    abstained, expected = F.col("verdict") == "ABSTAIN", F.col("expected_abstain")
    counts = rows.filter("verdict is not null and expected_abstain is not null").groupBy(*(by or [])).agg(
        F.count_if(expected & abstained).alias("right_abstain"),
        F.count_if(~expected & abstained).alias("over_abstain"),
        F.count_if(expected & ~abstained).alias("false_answer"),
        F.count_if(~expected & ~abstained).alias("answered"),
    )
    p, r = F.try_divide("right_abstain", F.col("right_abstain") + F.col("over_abstain")), F.try_divide("right_abstain", F.col("right_abstain") + F.col("false_answer"))
    return counts.withColumns(
        {
            "false_answer_rate": rate(F.col("false_answer"), F.col("false_answer") + F.col("right_abstain")),
            "over_abstain_rate": rate(F.col("over_abstain"), F.col("over_abstain") + F.col("answered")),
            "precision": F.round(p, 6),
            "recall": F.round(r, 6),
            "f1": F.round(F.try_divide(2 * p * r, p + r), 6),
        }
    )


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement of two labels and Cohen's kappa, null where chance agreement is 1. Rows with a null label do not count."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("n"))
    left = cells.groupBy(F.col("x").alias("label")).agg(F.sum("n").alias("l"))
    right = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("l").cast("double") * F.col("r")), F.lit(0.0)).alias("c"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n").cast("double") * F.col("n"))
    return seen.join(F.broadcast(chance)).select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives and the chance that a positive scores higher, ties counting half; null with one class.

    Scores are counted and dealt to ranges first, so no task sorts all of them.
    """
    counts = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    won = running(counts, score, ["q"]).withColumn("won", F.col("p") * (F.col("q_before") + F.col("q") / 2))
    return won.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.round(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q")), 6).alias("auc"))


def youden(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the lowest cut with the largest sensitivity + specificity - 1, and that value; score >= cut is positive."""
    counts = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("cut")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    counts = running(counts, "cut", ["p", "q"], descending=True)
    j = F.try_divide(F.col("p_before") + F.col("p"), "p_all") - F.try_divide(F.col("q_before") + F.col("q"), "q_all")
    return counts.withColumn("youden", F.round(j, 6)).orderBy(F.desc("youden"), "cut").limit(1).select("cut", "youden")


def cost(calls: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """Cost per group of calls; one call without a price or usage makes the whole group's cost null.

    calls has model, tokens_in and tokens_out, prices has model, price_in and price_out per million tokens.
    """
    priced = calls.join(prices, "model", "left")
    one = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return priced.withColumn("_cost", one).groupBy(by).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.when(F.count_if(F.col("_cost").isNull()) == 0, F.round(F.sum("_cost"), 6)).alias("cost"),
    )


def consistency(one: DataFrame, two: DataFrame) -> DataFrame:
    """Per query identical, reordered, different or missing between two runs, and the first rank that differs, null for a missing one.

    Runs have query_id, rank and doc.
    """
    listed = lambda df, name: df.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias(name))
    both = listed(one, "a").join(listed(two, "b"), "query_id", "full")
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), True)
    kind = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "missing")
        .when(F.col("a") == F.col("b"), "identical")
        .when(F.sort_array("a") == F.sort_array("b"), "reordered")
        .otherwise("different")
    )
    return both.select("query_id", kind.alias("kind"), F.when(differs > 0, differs).alias("first_difference"))


def by_source(rows: DataFrame, source: str, measures: dict[str, Column]) -> DataFrame:
    """Measures per source and over all rows, the latter under the source `all`; one pass over the rows."""
    out = rows.groupingSets([[source], []], source).agg(F.grouping(F.col(source)).alias("_all"), *[m.alias(n) for n, m in measures.items()])
    return out.withColumn(source, F.when(F.col("_all") == 1, "all").otherwise(F.coalesce(source, F.lit("none")))).drop("_all")


def gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per threshold the value, whether it passes, and why not. A missing value is pending and never passes.

    values has scope, metric, value and optionally baseline; thresholds has scope, metric, rule (min, max or
    delta) and tolerance. A negative delta bounds a fall, another a rise.
    """
    change = F.col("value") - F.col("baseline")
    ok = (
        F.when(F.col("rule") == "min", F.col("value") >= F.col("tolerance"))
        .when(F.col("rule") == "max", F.col("value") <= F.col("tolerance"))
        .when(F.col("tolerance") < 0, change >= F.col("tolerance"))
        .otherwise(change <= F.col("tolerance"))
    )
    return thresholds.join(values, ["scope", "metric"], "left").select("scope", "metric", "rule", "tolerance", "value", F.when(ok.isNull(), "pending").when(ok, "pass").otherwise("fail").alias("status"))
