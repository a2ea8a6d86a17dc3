"""Numeric answers against references, claim rates, and aids for reviewing items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.numbers import apply_scale, figures, power_of_ten
from quarryline.operators.metrics import rate


def quantum(printed: Column, power: Column) -> Column:
    """Unit of the last printed digit at a scale."""
    places = F.length(F.regexp_extract(F.regexp_replace(printed, "[^0-9.]", ""), r"\.(\d+)$", 1))
    return power_of_ten(power - places)


def exact(value: Column, reference: Column, unit: Column) -> Column:
    """Whether magnitudes agree when both are rounded half up to the reference's unit."""
    steps = lambda x: F.round(F.try_divide(F.abs(x).cast("decimal(38,12)"), unit), 0)
    return steps(value) == steps(reference)


def tolerant(value: Column, reference: Column, share: float = 0.005) -> Column:
    """Whether magnitudes differ by at most a share of the reference; a zero reference asks for zero."""
    return F.abs(F.abs(value) - F.abs(reference)) <= F.abs(reference) * F.lit(share).cast("decimal(6,4)")


def numeric_scores(items: DataFrame) -> DataFrame:
    """Per item whether a figure of the answer is that of the reference: exactly, with tolerance, with its sign, and as the first figure.

    items has item_id, reference_answer and answer; a null answer is an abstention, a reference without a
    figure excludes the item. Of the reference the first figure counts. All figures of one item are in its
    row, so nothing is shuffled.
    """
    ref = F.try_element_at(figures(F.col("reference_answer")), F.lit(1))
    power = F.when(F.lower("r.printed").contains("thousand"), 3).when(F.lower("r.printed").contains("million"), 6).when(F.lower("r.printed").contains("billion"), 9).when(F.lower("r.printed").contains("trillion"), 12).otherwise(0)
    rows = items.withColumn("r", ref).withColumn("said", figures(F.col("answer"))).withColumn("_unit", quantum(F.col("r.printed"), power))
    same = lambda x: (x["percent"] == F.col("r.percent")) & exact(x["value"], F.col("r.value"), F.col("_unit"))
    scored = F.col("r").isNotNull() & F.col("answer").isNotNull()
    return rows.select(
        "item_id",
        F.when(F.col("r").isNull(), "excluded").when(F.col("answer").isNull(), "abstained").when(F.exists("said", same), "correct").otherwise("wrong").alias("outcome"),
        F.when(scored, F.exists("said", lambda x: tolerant(x["value"], F.col("r.value")))).alias("tolerant"),
        F.when(scored, F.exists("said", lambda x: same(x) & (F.signum(x["value"]) == F.signum(F.col("r.value"))))).alias("sign_agrees"),
        F.when(scored, F.coalesce(same(F.try_element_at("said", F.lit(1))), F.lit(False))).alias("first"),
        F.when(scored, F.size("said")).alias("figures"),
    )


def claim_rates(claims: DataFrame, by: list[str]) -> DataFrame:
    """Faithfulness before and after the gate, retention, citation coverage and contradiction rate.

    claims has supported, kept, cited and contradiction; rates of no claim are null.
    """
    kept = F.col("kept")
    return claims.groupBy(*by).agg(
        F.count("*").alias("claims"),
        rate(F.count_if("supported"), F.count("*")).alias("faithful_before"),
        rate(F.count_if(kept & F.col("supported")), F.count_if(kept)).alias("faithful_after"),
        rate(F.count_if(kept), F.count("*")).alias("retention"),
        rate(F.count_if("cited"), F.count("*")).alias("citation_coverage"),
        rate(F.count_if("contradiction"), F.count("*")).alias("contradictions"),
    )


def printed_sign(text: Column, start: Column, end: Column) -> Column:
    """How a figure at start to end (from 0) of a text shows its sign: brackets, minus or plain."""
    before, after = F.rtrim(F.substring(text, F.greatest(F.lit(1), start - 2), F.least(start, F.lit(3)))), F.ltrim(F.substring(text, end + 1, F.lit(3)))
    opened = F.regexp_replace(before, r"[\s$]+$", "")
    return F.when(opened.rlike(r"\($") & after.startswith(")"), "brackets").when(opened.rlike("[-−–]$"), "minus").otherwise("plain")


def without_context(answers: DataFrame, drop: float = 0.005, near: float = 0.05) -> DataFrame:
    """Items that a model answered right without the text: dropped within half a percent, near within five.

    answers has item_id, answer and value; percentages of an answer do not count.
    """
    found = F.filter(figures(F.col("answer")), lambda x: ~x["percent"])
    hit = lambda share: F.coalesce(F.exists(found, lambda x: tolerant(x["value"], F.col("value"), share)), F.lit(False))
    return answers.select("item_id", hit(drop).alias("dropped"), (hit(near) & ~hit(drop)).alias("near"))


def rank_class(rank: Column) -> Column:
    """Class of a rank for diagnosis of misses."""
    return F.when(rank <= 10, "1-10").when(rank <= 20, "11-20").when(rank <= 50, "21-50").when(rank <= 100, "51-100").otherwise("none")


def currency_text(value: Column, power: Column) -> Column:
    """Dollar text at a printed scale, null where the value is not whole at it; without a scale (power 0) an amount with a fraction has two places or more."""
    shown = apply_scale(value, -power)
    word = F.when(power == 3, " thousand").when(power == 6, " million").when(power == 9, " billion").otherwise("")
    whole = shown == F.round(shown, 0)
    sign = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"))
    digits = F.regexp_extract(F.regexp_replace(F.abs(value).cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.(\d+)$", 1)
    fraction = F.concat(sign, F.format_number(F.floor(F.abs(value)).cast("decimal(38,0)"), 0), F.lit("."), F.rpad(digits, F.greatest(F.lit(2), F.length(digits)), "0"))
    return F.when(whole, F.concat(sign, F.format_number(F.abs(shown).cast("decimal(38,0)"), 0), word)).when(power == 0, fraction)
