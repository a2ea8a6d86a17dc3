"""Samples whose shares of categories match targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.keys import form_key, item_key, ticker_key

STRATUM = ["_ticker", "_form", "_item"]
#: A row of a stratum is accepted with the wanted rate, raised by so many standard deviations plus some rows.
DEVIATIONS, EXTRA_ROWS = 5, 10
#: Buckets of the accepted random numbers of a stratum; only the bucket in which the wanted count falls is ranked.
BUCKETS = 1024


def keyed(df: DataFrame) -> DataFrame:
    """df with the canonical stratum in columns that clash with none of its own."""
    return df.withColumns(dict(zip(STRATUM, (ticker_key("ticker"), form_key("form_type"), item_key("item_code")))))


def uniform(key: Column, seed: int) -> Column:
    """Number in [0, 1) that depends on key and seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)).cast("double") / float(1 << 40)


def needs(chunks: DataFrame, targets: DataFrame, fraction: int = 20) -> DataFrame:
    """Per target the sample size, the rows needed and the rows there are.

    The sample size is the number of chunks divided by fraction, rounded down. A target needs the larger
    of min_rows and its share of the sample size, rounded up; a null share or minimum counts as 0. Chunks
    with a null ticker, form or item belong to no target. With no chunks every need is min_rows.
    """
    counts = keyed(chunks.select("ticker", "form_type", "item_code")).groupBy(*STRATUM).agg(F.count("*").alias("rows_there"))
    size = counts.agg(F.floor(F.coalesce(F.sum("rows_there"), F.lit(0)) / fraction).alias("sample_size"))
    share = F.round(F.coalesce("target_share", F.lit(0.0)) * F.col("sample_size"), 6)
    return (
        keyed(targets.select("target_id", "ticker", "form_type", "item_code", "target_share", "min_rows"))
        .join(counts, STRATUM, "left")
        .join(F.broadcast(size))  # one row
        .withColumn("rows_there", F.coalesce("rows_there", F.lit(0)))
        .withColumn("rows_needed", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.ceil(share).cast("long")))
    )


def first_by_number(drawn: DataFrame, key: str, need: str) -> DataFrame:
    """Of the rows of each target those with the smallest numbers, as many as the column need says, or all.

    drawn has target_id, key, u, a bucket that rises with u, and need. Counts run over buckets, of which a
    target has at most BUCKETS; only rows of the bucket in which the count is reached are ranked. Ties go
    by key.
    """
    sizes = drawn.groupBy("target_id", "bucket").agg(F.count("*").alias("n"), F.first(need).alias("wanted"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("target_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = sizes.withColumn("before", before).filter("before < wanted")
    kept = drawn.select(key, "target_id", "bucket", "u").join(plan, ["target_id", "bucket"])
    whole = kept.filter("before + n <= wanted")
    edge = kept.filter("before + n > wanted").withColumn("rank", F.row_number().over(Window.partitionBy("target_id", "bucket").orderBy("u", key))).filter("before + rank <= wanted")
    return whole.select(key, "target_id").unionByName(edge.select(key, "target_id"))


def sample(chunks: DataFrame, targets: DataFrame, key: str = "chunk_id", fraction: int = 20, seed: int = 7, deviations: float = DEVIATIONS, extra: int = EXTRA_ROWS) -> DataFrame:
    """Keys of the sampled rows with their target.

    Acceptance: each row is accepted on its own with its stratum's probability, needed over there, slightly
    raised; the others are rejected before anything is counted or moved. Correction: of the accepted rows
    those with the smallest random numbers up to the need stay, so the count is exact. A stratum whose
    acceptance fell short, which the raise makes rare, draws what is missing from its rejected rows. Ties
    in the number go by key; strata with fewer rows than needed give all. Rows with a null key or stratum
    are never drawn.
    """
    wanted = needs(chunks, targets, fraction).filter("rows_there > 0 and rows_needed > 0").select(
        "target_id", *STRATUM, "rows_needed", "rows_there", F.least(F.lit(1.0), (F.col("rows_needed") + deviations * F.sqrt("rows_needed") + extra) / F.col("rows_there")).alias("rate")
    )
    rows = keyed(chunks.select(key, "ticker", "form_type", "item_code")).filter(F.col(key).isNotNull()).withColumn("u", uniform(F.col(key), seed))
    part = lambda low, width: F.least(F.lit(BUCKETS - 1), F.floor((F.col("u") - low) / width * BUCKETS)).alias("bucket")
    accepted = rows.join(wanted, STRATUM).filter("u < rate").select(key, "target_id", "u", "rows_needed", part(F.lit(0.0), F.col("rate")))
    got = accepted.groupBy("target_id").agg(F.count("*").alias("got"))
    short = wanted.join(got, "target_id", "left").withColumn("missing", F.least("rows_needed", "rows_there") - F.coalesce("got", F.lit(0))).filter("missing > 0 and rate < 1")
    again = rows.join(short, STRATUM).filter("u >= rate").select(key, "target_id", "u", "missing", part(F.col("rate"), 1 - F.col("rate")))
    return first_by_number(accepted, key, "rows_needed").unionByName(first_by_number(again, key, "missing"))


def report(chunks: DataFrame, targets: DataFrame, fraction: int = 20, seed: int = 7) -> DataFrame:
    """Per target what was asked, what is there, what the sample holds and what is missing."""
    got = sample(chunks, targets, fraction=fraction, seed=seed).groupBy("target_id").agg(F.count("*").alias("rows_sampled"))
    return needs(chunks, targets, fraction).join(got, "target_id", "left").select(
        "target_id",
        F.col("rows_needed"),
        F.col("rows_there"),
        F.coalesce("rows_sampled", F.lit(0)).alias("rows_sampled"),
        F.greatest(F.lit(0), F.col("rows_needed") - F.coalesce("rows_sampled", F.lit(0))).alias("rows_missing"),
    )
