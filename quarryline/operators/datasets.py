"""Samples and evaluation items built from facts, spans and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apportioned(counts: DataFrame, key: str, n: int) -> DataFrame:
    """Places for each key by largest remainders in whole numbers: key, count, places.

    counts has key and count. Ties go to the larger count, then the smaller key; no key gets more than
    its count. There is a row per stratum, so the single window holds strata, not rows.
    """
    total = counts.agg(F.sum("count").alias("total"))
    rows = counts.join(F.broadcast(total)).withColumns({"floor": F.floor(F.col("count") * F.least(F.lit(n), "total") / F.col("total")), "rest": (F.col("count") * F.least(F.lit(n).cast("long"), "total")) % F.col("total")})
    left = F.least(F.lit(n).cast("long"), F.col("total")) - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.desc("count"), key))
    return rows.select(key, "count", F.least(F.col("count"), F.col("floor") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("places"))


def draw_order(seed: str, *keys: str) -> Column:
    """Order of a shuffle that SQL engines share: md5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def drawn(rows: DataFrame, strata: list[str], places: DataFrame, key: str, seed: str, overdraw: int = 1) -> DataFrame:
    """First places * overdraw rows of each stratum in shuffled order, with their position; beyond places they are reserve."""
    w = Window.partitionBy(*strata).orderBy(draw_order(seed, key), key)
    out = rows.join(places, strata).withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= F.col("places") * overdraw)
    return out.withColumn("reserve", F.col("position") > F.col("places"))


def key_category(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One category for each key, the first that holds: value_differs, no_gold, many, mixed, comparative_only, eligible.

    facts has value, gold (number of texts that print it) and is_comparative.
    """
    agg = facts.groupBy(*keys).agg(
        F.count("*").alias("facts"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.bool_or(F.col("gold") == 0).alias("some_none"),
        F.bool_and(F.col("gold") == 0).alias("all_none"),
        F.bool_or(F.col("gold") > 3).alias("many"),
        F.bool_and(F.coalesce("is_comparative", F.lit(False))).alias("comparative"),
    )
    kind = (
        F.when(F.col("lo") != F.col("hi"), "value_differs")
        .when(F.col("all_none"), "no_gold")
        .when(F.col("many"), "many")
        .when(F.col("some_none"), "mixed")
        .when(F.col("comparative"), "comparative_only")
        .otherwise("eligible")
    )
    return agg.select(*keys, "facts", kind.alias("category"))


def gold(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per fact the texts whose span states its value, and the spans of its filing and concept; facts without a span stay.

    facts has fact_id, accession_key, concept_key and amount; spans has the latter three and chunk_id.
    """
    s = spans.select("accession_key", "concept_key", F.col("amount").alias("told"), "chunk_id")
    hit = facts.join(s, ["accession_key", "concept_key"], "left")
    return hit.groupBy("fact_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("told") == F.col("amount"), F.col("chunk_id")))), ",").alias("gold"),
        F.count("told").alias("spans"),
    )


def bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 3, "1-3").otherwise(">3")


def period_pairs(facts: DataFrame, gap: int) -> DataFrame:
    """Facts of one company and concept so many fiscal years apart; a year with more than one value pairs with nothing.

    facts has cik, concept, fiscal_year and value.
    """
    one = facts.filter("value is not null and fiscal_year is not null").groupBy("cik", "concept", "fiscal_year").agg(F.min("value").alias("value"), F.max("value").alias("_hi")).filter("value = _hi").drop("_hi")
    later = one.select("cik", "concept", (F.col("fiscal_year") - gap).alias("fiscal_year"), F.col("value").alias("later"))
    return one.join(later, ["cik", "concept", "fiscal_year"]).select("cik", "concept", "fiscal_year", F.col("value").alias("earlier"), "later")


def latest_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items under the latest decision on each: rejected ones go, edited ones take the new answer.

    decisions has item_id, seq, decision (accept, edit, reject) and answer.
    """
    last = decisions.groupBy("item_id").agg(F.max_by(F.struct("decision", "answer"), "seq").alias("d"))
    out = items.join(last, "item_id", "left").filter("d is null or d.decision <> 'reject'")
    return out.withColumn("reference_answer", F.when(F.col("d.decision") == "edit", F.col("d.answer")).otherwise(F.col("reference_answer"))).withColumn("reviewed", F.col("d").isNotNull()).drop("d")


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in order; a check that is null fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def first_failure(checks: dict[str, Column]) -> Column:
    """Name of the first check that fails, null if none does."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out
