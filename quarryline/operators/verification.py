"""Claims checked against cited texts and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.numbers import within


def classified(claims: DataFrame, facts: DataFrame, percent: float = 0.5) -> DataFrame:
    """Claims against facts: verified, no_fact, restatement, rounded or contradiction, the first that holds.

    claims has claim_id, accession, cik, concept, period_end, value, lo and hi (the printed interval, may be
    null); facts has accession, cik, concept, period_end and value. Facts of the same company, concept and
    period are compared, those of the cited filing first. elsewhere says that a contradicted number is that
    of another period in the cited filing; fact_value is the smallest matching or cited value.
    """
    f = facts.filter("value is not null").select(F.col("cik").alias("f_cik"), F.col("concept").alias("f_concept"), F.col("period_end").alias("f_end"), F.col("accession").alias("f_acc"), F.col("value").alias("f_value"))
    joined = claims.join(f, (F.col("cik") == F.col("f_cik")) & (F.col("concept") == F.col("f_concept")), "left")
    there, cited, close = F.col("f_end") == F.col("period_end"), F.col("f_acc") == F.col("accession"), within(F.col("value"), F.col("f_value"), percent)
    inside = (F.abs("f_value") >= F.col("lo")) & (F.abs("f_value") < F.col("hi"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = joined.groupBy("claim_id").agg(
        any_(there & cited & close).alias("v"),
        any_(there & cited).alias("c"),
        any_(there & ~cited & close).alias("r"),
        any_(there & cited & inside).alias("i"),
        any_(~there & cited & close).alias("e"),
        F.min(F.when(there & cited, F.col("f_value"))).alias("fact_value"),
    )
    kind = F.when(F.col("v"), "verified").when(~F.col("c"), "no_fact").when(F.col("r"), "restatement").when(F.col("i"), "rounded").otherwise("contradiction")
    return flags.select("claim_id", kind.alias("status"), (F.col("e") & (kind == "contradiction")).alias("elsewhere"), "fact_value")


def supported(entail: float) -> Column:
    """Whether a claim stands, from its checks: citation_valid, entity_ok, has_figure, numbers_grounded, unit_ok (true, false, unknown), period_stated, contradiction and entail."""
    figure = F.col("numbers_grounded") & F.col("unit_ok").isin("true", "unknown") & F.col("period_stated") & ~F.col("contradiction")
    prose = F.coalesce(F.col("entail") >= entail, F.lit(False))
    return F.coalesce(F.col("citation_valid") & F.col("entity_ok") & F.when(F.col("has_figure"), figure).otherwise(prose), F.lit(False))


def verdicts(claims: DataFrame, entail: float | None) -> DataFrame:
    """Per answer PASS, PARTIAL, ABSTAIN or PENDING, with claims kept and made.

    Without an entailment threshold an answer with a prose claim is pending. Any contradiction abstains,
    else nine tenths of the claims kept pass and six tenths are partial.
    """
    kept = supported(0.0 if entail is None else entail)
    out = claims.groupBy("answer_id").agg(
        F.count("*").alias("claims"),
        F.count_if(kept).alias("kept"),
        F.bool_or(F.coalesce("contradiction", F.lit(False))).alias("contradicted"),
        F.bool_or(~F.col("has_figure")).alias("prose"),
    )
    share = F.col("kept") / F.col("claims")
    pending = F.col("prose") if entail is None else F.lit(False)
    v = F.when(pending, "PENDING").when(F.col("contradicted"), "ABSTAIN").when(share >= 0.9, "PASS").when(share >= 0.6, "PARTIAL").otherwise("ABSTAIN")
    return out.select("answer_id", "claims", "kept", F.round(share, 6).alias("confidence"), v.alias("verdict"))
