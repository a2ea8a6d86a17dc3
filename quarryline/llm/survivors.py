"""One surviving record for each group of records of a fact."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.keys import accession_key, concept_key, form_key

GROUP = ["_accession", "_concept", "period_start", "period_end"]
#: Feeds from the most to the least trusted; any other comes last.
FEEDS = ("companyfacts", "inline", "vendor")
#: Fields that are chosen one by one; the unit always comes with the value.
FIELDS = ("label", "fiscal_year", "fiscal_period", "form_type", "is_comparative")


def records(facts: DataFrame) -> DataFrame:
    """Facts with group key, trust and state; rows with a null accession or concept belong to no group."""
    feed = F.regexp_replace(F.lower("feed"), "[^a-z]", "")
    trust = F.lit(len(FEEDS))
    for n, name in enumerate(FEEDS):
        trust = F.when(feed == name, F.lit(n)).otherwise(trust)
    used = ("fact_id", "accession", "concept", "period_start", "period_end", "value", "unit", "label", "fiscal_year", "fiscal_period", "form_type", "is_comparative", "feed", "ingested_at")
    return facts.select(*used).withColumns(
        {
            "_accession": accession_key("accession"),
            "_concept": concept_key("concept"),
            "_trust": trust,
            # what a record can turn into by later filing or restating
            "_state": F.concat_ws(" ", F.coalesce(form_key("form_type"), F.lit("?")), F.when(F.col("is_comparative"), "restated").otherwise("own")),
            "_at": F.unix_micros(F.col("ingested_at").cast("timestamp")),
        }
    ).filter("_accession is not null and _concept is not null")


def precedence(edges: pd.DataFrame) -> pd.DataFrame:
    """Pairs of states of which the first comes before the second: the transitive closure of the learned transitions.

    Transitions join the order from the surest to the least sure, unless they would close a cycle; states
    that no path connects stay without an order. edges has a row per pair of states, so its size follows
    the kinds of forms.
    """
    edges = edges[edges["first"] != edges["then"]]
    counts = {(a, b): n for a, b, n in zip(edges["first"], edges["then"], edges["n"])}
    won = sorted(((n - counts.get((b, a), 0), a, b) for (a, b), n in counts.items()), key=lambda x: (-x[0], x[1], x[2]))
    after: dict[str, set[str]] = {s: {s} for s in {*edges["first"], *edges["then"]}}
    for lead, a, b in won:
        if lead > 0 and a not in after[b]:
            for known in after.values():
                if a in known:
                    known |= after[b]
    return pd.DataFrame([(a, b) for a in sorted(after) for b in sorted(after[a]) if a != b], columns=["_first", "_then"])


def dated(r: DataFrame) -> DataFrame:
    """Records with the time by which they are compared, also where ingested_at is missing.

    Precedence of states is learned from records with a time: in a group one state comes before another
    if its last record is older than the other's first. A group with records without a time gets a
    partial order of its own: times order the states that have them, the learned precedence ties the
    others to them and to each other. A record without a time is placed right after the latest record
    that comes before it in that order, or else at the start; among records of one place the one further
    down the order is the later, then that with the larger or the smaller fact_id, whichever is the later
    one in most groups with times. Groups come to a task as states, not as records.
    """
    ends = r.filter("_at is not null").groupBy(*GROUP).agg(F.min_by("fact_id", F.struct("_at", "fact_id")).alias("old"), F.max_by("fact_id", F.struct("_at", "fact_id")).alias("new"), F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    rising = ends.filter("lo < hi").agg(F.signum(F.coalesce(F.sum(F.signum((F.col("new") - F.col("old")).cast("double"))), F.lit(0.0))).cast("long").alias("_rising"))
    states = r.groupBy(*GROUP, "_state").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count_if(F.col("_at").isNull()).alias("lost"))
    timed = states.filter("hi is not null")
    a, b = timed.alias("a"), timed.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in GROUP]
    edges = a.join(b, [*same, F.col("a.hi") < F.col("b.lo")]).groupBy(F.col("a._state").alias("first"), F.col("b._state").alias("then")).agg(F.count("*").alias("n"))
    order = edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(precedence, "_first string, _then string")
    lost = states.filter("lost > 0").select(*[F.col(k).alias(f"g_{k}") for k in GROUP], F.col("_state").alias("_then"))
    mine = [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in GROUP]
    # what comes before a lost state in its group: states of the learned order, and records of the state itself
    pairs = lost.join(states, mine, "left").select(*[F.col(f"g_{k}") for k in GROUP], "_then", F.col("_state").alias("_first"), "hi")
    before = pairs.join(order.withColumn("_known", F.lit(1)), ["_first", "_then"], "left").filter("_known = 1 or _first = _then")
    placed = before.groupBy(*[f"g_{k}" for k in GROUP], "_then").agg(F.max("hi").alias("_placed"), (F.count("*") - 1).alias("_level"))
    timed_rows = r.filter("_at is not null").withColumns({"_late": F.lit(0), "_level": F.lit(0).cast("long"), "_seq": F.lit(0).cast("long")})
    lost_rows = r.filter("_at is null").join(placed.withColumnRenamed("_then", "g_state"), [*mine, F.col("_state") == F.col("g_state")], "left")
    lost_rows = lost_rows.withColumns({"_at": F.col("_placed"), "_late": F.lit(1), "_level": F.coalesce("_level", F.lit(0))}).drop("_placed", "g_state", *[f"g_{k}" for k in GROUP])
    lost_rows = lost_rows.join(F.broadcast(rising)).withColumn("_seq", F.col("fact_id") * F.col("_rising")).drop("_rising")  # one row
    return timed_rows.unionByName(lost_rows)


def rank_key() -> Column:
    """Smaller is better: trusted feed, latest time, a record placed after that time first and the later of these, smallest fact_id."""
    return F.struct("_trust", (-F.coalesce("_at", F.lit(-(1 << 62)))).alias("t"), (-F.col("_late")).alias("p"), (-F.col("_level")).alias("l"), (-F.col("_seq")).alias("s"), "fact_id")


def survivors(facts: DataFrame, least: int = 2) -> DataFrame:
    """One row per group of at least `least` facts with each field from the best record that has it.

    A group shares accession, concept, period_start and period_end in any spelling, null equal to null.
    A field that no record has is null, and so is its fact_id. Aggregation is partial before the shuffle,
    so one group may hold any share of the rows. Repeated rows count as records of the group.
    """
    r = dated(records(facts)).withColumn("_rank", rank_key())
    best = lambda have, *fields: F.min_by(F.struct(*fields), F.when(F.col(have).isNotNull(), F.col("_rank")))
    picked = r.groupBy(*GROUP).agg(
        F.min("fact_id").alias("group_id"),
        F.count("*").alias("records"),
        best("value", "fact_id", "value", "unit").alias("v"),
        *[best(f, "fact_id", f).alias(f"f_{f}") for f in FIELDS],
    )
    return picked.filter(F.col("records") >= least).select(
        "group_id",
        F.col("_accession").alias("accession_key"),
        F.col("_concept").alias("concept_key"),
        "period_start",
        "period_end",
        "records",
        F.col("v.fact_id").alias("value_fact_id"),
        F.col("v.value").alias("value"),
        F.col("v.unit").alias("unit"),
        *[F.col(f"f_{f}.fact_id").alias(f"{f}_fact_id") for f in FIELDS],
        *[F.col(f"f_{f}.{f}").alias(f) for f in FIELDS],
    )


def found(facts: DataFrame) -> DataFrame:
    """group_id, value_fact_id and label_fact_id; only these fields are aggregated."""
    return survivors(facts).select("group_id", "value_fact_id", "label_fact_id")


def without_times(facts: DataFrame, feed: str = "vendor") -> DataFrame:
    """facts as if one feed gave no times, so that its records are compared by the learned order only."""
    hidden = F.regexp_replace(F.lower("feed"), "[^a-z]", "") == feed
    return facts.withColumn("ingested_at", F.when(hidden, F.lit(None)).otherwise(F.col("ingested_at")))


def order_learned(facts: DataFrame, feed: str = "vendor") -> DataFrame:
    """One row: groups of two or more records of the feed, and in how many the value record is the same with and without the feed's times."""
    own = facts.filter(F.regexp_replace(F.lower("feed"), "[^a-z]", "") == feed)
    others = facts.filter(F.regexp_replace(F.lower("feed"), "[^a-z]", "") != feed).withColumn("value", F.lit(None).cast("decimal(38,6)"))
    said = found(own).select("group_id", F.col("value_fact_id").alias("with_times"))
    # the other feeds teach the order but have no value to give
    guessed = survivors(without_times(own, feed).unionByName(others.select(*own.columns))).filter("value_fact_id is not null").select(F.col("value_fact_id").alias("without_times"), "accession_key", "concept_key", "period_start", "period_end")
    keys = survivors(own).select("group_id", "accession_key", "concept_key", "period_start", "period_end")
    same = [keys[k].eqNullSafe(guessed[k]) for k in ("accession_key", "concept_key", "period_start", "period_end")]
    both = keys.join(guessed, same).select("group_id", "without_times").join(said, "group_id")
    return both.agg(F.count("*").alias("groups"), F.count_if(F.col("with_times").eqNullSafe(F.col("without_times"))).alias("agreed"))
