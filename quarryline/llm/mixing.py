"""Sources mixed to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.keys import source_key
from quarryline.llm.tokens import TOKENIZERS, token_count
from quarryline.session import checkpointed

#: Buckets of the shuffle number of a source, and of the finish times of all; sums over buckets replace sums over rows.
BUCKETS = 4096


def sizes(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, canonical source and tokens of every document; a null text has 0 tokens, a null source stays null."""
    sized = documents.select("doc_id", source_key("source").alias("source_key"), F.coalesce(token_count(F.col("text"), tokenizers), F.lit(0)).alias("tokens"))
    return checkpointed(sized)


def supply(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target the tokens of its source, of all documents, those it may give with repeats, and those it should give."""
    by_source = sized.groupBy("source_key").agg(F.sum("tokens").alias("source_tokens"))
    total = by_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    return (
        targets.select("source", "target_weight", "max_repeats").withColumn("source_key", source_key("source"))
        .join(by_source, "source_key", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source",
            "source_key",
            "target_weight",
            "max_repeats",
            F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
            "all_tokens",
            (F.coalesce("source_tokens", F.lit(0)) * F.coalesce("max_repeats", F.lit(0))).alias("most_tokens"),
            (F.coalesce("target_weight", F.lit(0.0)) * F.col("all_tokens")).alias("wanted_tokens"),
        )
    )


def queue(sized: DataFrame, targets: DataFrame, seed: int = 11, buckets: int = BUCKETS) -> DataFrame:
    """Uses of documents with their virtual finish times, those of a source one behind the other.

    The documents of a source are shuffled by hash. A use finishes at the tokens of its source up to and
    including it, over all rounds so far, divided by the weight. Rounds go on until the source reaches its
    share or may not be repeated again. Sums run over buckets first and within one bucket then, so a
    source of any size is never summed in one task. Documents without a target, a key or a token are not
    used; of a source listed twice the first spelling holds.
    """
    want = supply(sized, targets).filter("target_weight > 0 and max_repeats > 0 and source_tokens > 0").groupBy("source_key").agg(F.min_by(F.struct(
        "source", "target_weight", "max_repeats", "source_tokens", "wanted_tokens", "all_tokens"), "source").alias("w")).select("source_key", "w.*")
    rows = (
        sized.filter("tokens > 0 and doc_id is not null")
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    )
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source_key", "bucket", before.alias("before"))
    within = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("cum", F.sum("tokens").over(within)).join(offsets, ["source_key", "bucket"]).join(want, "source_key")
    rounds = F.least(F.col("max_repeats").cast("long"), F.ceil(F.col("wanted_tokens") / F.col("source_tokens")).cast("long"))
    return queued.withColumn("use_no", F.explode(F.sequence(F.lit(0), rounds.cast("int") - 1))).select(
        "doc_id",
        "source_key",
        "source",
        "use_no",
        "tokens",
        ((F.col("use_no") * F.col("source_tokens") + F.col("before") + F.col("cum")) / F.col("target_weight")).alias("finish"),
        F.col("all_tokens").alias("budget"),
    )


def mix(sized: DataFrame, targets: DataFrame, seed: int = 11, buckets: int = BUCKETS) -> DataFrame:
    """Uses in the order of their finish times, as many as the total size of all documents holds.

    Uses are sorted by range over the whole table; starts_at is the tokens of all uses before, from sums
    over slots of finish times, so no task adds up more than a slot. What would end beyond the total is
    left out.
    """
    uses = queue(sized, targets, seed, buckets).filter("finish <= budget").withColumn("slot", F.floor(F.col("finish") / F.col("budget") * buckets))
    by_slot = uses.groupBy("slot").agg(F.sum("tokens").alias("n"))
    # at most buckets + 1 rows
    by_slot = by_slot.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("tokens").over(Window.partitionBy("slot").orderBy("finish", "doc_id", "use_no").rowsBetween(Window.unboundedPreceding, 0))
    placed = uses.withColumn("upto", upto).join(F.broadcast(by_slot), "slot").withColumn("ends_at", F.col("before") + F.col("upto")).filter("ends_at <= budget")
    return placed.select("doc_id", "source", "use_no", "tokens", "finish", (F.col("ends_at") - F.col("tokens")).alias("starts_at")).orderBy("finish", "doc_id", "use_no")


def report(sized: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """Per target the share asked for, the share reached of the total size and of the mix, and whether it falls short.

    A target falls short if the last of its queued uses, repeated as often as allowed, finishes before
    the total size, or if it has no use at all though it has a weight: its queue runs empty before it
    gives its share.
    """
    uses = queue(sized, targets, seed)
    last = uses.groupBy("source").agg(F.max("finish").alias("last_finish"))
    used = mix(sized, targets, seed).groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("use_no").alias("last_use"))
    out = supply(sized, targets).join(used, "source", "left").join(last, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    mixed = used.agg(F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("mixed_tokens"))
    return out.join(F.broadcast(mixed)).select(
        "source",
        "target_weight",
        "max_repeats",
        "source_tokens",
        "used_tokens",
        (F.coalesce("last_use", F.lit(-1)) + 1).alias("uses"),
        F.try_divide("used_tokens", "all_tokens").alias("share_of_total"),
        F.try_divide("used_tokens", "mixed_tokens").alias("share_of_mix"),
        ((F.col("wanted_tokens") > 0) & (F.coalesce("last_finish", F.lit(0.0)) < F.col("all_tokens"))).alias("short"),
    )


def short_sources(sized: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """Targets whose queue runs empty before it gives its share, without the figures of the report."""
    last = queue(sized, targets, seed).groupBy("source").agg(F.max("finish").alias("last_finish"))
    asked = supply(sized, targets).filter("wanted_tokens > 0").join(last, "source", "left")
    return asked.filter(F.coalesce("last_finish", F.lit(0.0)) < F.col("all_tokens")).select("source").distinct()
