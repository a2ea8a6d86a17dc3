"""Amounts recorded in different units, brought to dollars, shares, dollars per share and ratios.

Each way of naming a unit ("kUSD", "US$ mm", a phrase at the end of a label, the scale of a tagged
span) is a source. Sources that record the same entity are linked, a robust scale and offset is
estimated for each linked pair, the scale is snapped to a known conversion and the conversions are
propagated from the sources that name no scale. What a source names in words decides where the links
are too few or do not agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.keys import accession_key, concept_key
from quarryline.session import checkpointed

#: Conversions between units of one dimension, as powers of ten.
KNOWN_POWERS = (-4, -2, 0, 3, 6, 9)
#: A linked pair of sources counts from so many entities on, and if so large a share of them agrees; otherwise the words decide, which found_by reports.
MIN_LINKS, MIN_AGREEMENT = 8, 0.6
#: A known conversion keeps zero at zero: a link is used only if its median offset is at most this share of the median value.
MAX_OFFSET = 0.01
AMOUNT = "decimal(38,7)"
SPAN = "tagged span"

#: Words that name a scale, tried in this order.
WORDS = (
    (-4, r"\b(bps?|basis points?)\b"),
    (-2, r"%|\b(pct|per ?cent|cents?|usc|us¢)\b|¢"),
    (9, r"\b(bn|bln|billions?|usdb|usdbn|busd)\b"),
    (6, r"\b(mm|mn|mln|millions?|musd|usdm|usdmm|m)\b"),
    (3, r"\b(thousands?|k|kusd|usdk|000s?)\b"),
)
#: Words by which a phrase at the end of a label names a unit.
UNIT_WORDS = r"(%|\$|\b(usd|us|dollars?|cents?|percent|per cent|pct|bps?|basis|points?|ratio|shares?|thousands?|millions?|billions?|mm|mn|bn|000s?)\b)"


def named_power(c: Column) -> Column:
    """Power of ten that the words of c name, null where they name none; null for null."""
    low, out = F.lower(c), F.lit(None).cast("int")
    for power, words in reversed(WORDS):
        out = F.when(low.rlike(words), F.lit(power)).otherwise(out)
    return out


def dimension(concept: Column) -> Column:
    """per_share, ratio, shares or money, by the words of the canonical concept."""
    return (
        F.when(concept.rlike("pershare"), "per_share")
        .when(concept.rlike("(rate|ratio|percent|percentage)$"), "ratio")
        .when(concept.rlike("shares"), "shares")
        .otherwise("money")
    )


def label_phrase(label: Column) -> Column:
    """Phrase at the end of a label that names a unit, else the empty string."""
    low = F.lower(F.trim(label))
    found = F.regexp_extract(low, r"(?:\(([^()]*)\)|\[([^\[\]]*)\]|,\s*([^,()\[\]-]*)|\s-\s([^()\[\]]*))$", 0)
    return F.when(found.rlike(UNIT_WORDS), F.regexp_replace(found, r"^[,\s\-\(\[]+|[\s\)\]]+$", "")).otherwise("")


def shifted(value: Column, power: Column) -> Column:
    """value * 10 ** power for any power, rounded to the decimals of AMOUNT; null where the result overflows.

    The decimal point is moved in the printed digits, so no factor limits the power.
    """
    text = value.try_cast("decimal(38,8)").cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(text, "[^0-9]", "")
    # the digits have 8 decimals, after the shift 8 - power; no decimal has more than 38 digits
    places = F.greatest(F.lit(-40), F.least(F.lit(80), F.lit(8) - power))
    long = F.lpad(digits, F.greatest(F.length(digits), places + 1), "0")
    moved = F.when(places <= 0, F.concat(digits, F.repeat(F.lit("0"), -places))).otherwise(F.concat(F.substring(long, F.lit(1), F.length(long) - places), F.lit("."), F.right(long, places)))
    return F.when(power == 0, value.try_cast(AMOUNT)).otherwise(F.concat(sign, moved).try_cast(AMOUNT))


def facts_of(facts: DataFrame) -> DataFrame:
    """Facts with canonical keys and the source that their unit and label name."""
    unit = F.regexp_replace(F.lower(F.trim(F.coalesce("unit", F.lit("")))), r"\s+", " ")
    phrase = label_phrase(F.coalesce("label", F.lit("")))
    kind = dimension(concept_key("concept"))
    named = F.coalesce(named_power(unit), named_power(phrase), F.lit(0))
    return facts.select(
        "fact_id",
        accession_key("accession").alias("accession_key"),
        concept_key("concept").alias("concept_key"),
        "period_start",
        "period_end",
        F.col("value").cast("decimal(38,6)").alias("value"),
        kind.alias("dimension"),
        F.concat_ws("|", kind, unit, phrase).alias("source"),
        named.alias("named"),
    )


def printed(raw: Column) -> Column:
    """Figure as printed: brackets or a minus of any kind make it negative; null if there is no digit."""
    digits = F.regexp_extract(raw, r"([0-9][0-9,\s    ]*(?:\.[0-9]+)?|\.[0-9]+)", 1)
    number = F.regexp_replace(digits, "[^0-9.]", "").try_cast("decimal(28,8)")
    return F.when(raw.rlike(r"^[^0-9]*[(\-−–]"), -number).otherwise(number)


def spans_of(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans with canonical keys and their amount in common units.

    A span without a scale takes the unit named in raw_text, else by unit_scale of its chunk, else by
    the caption line of its chunk; the last two never apply to amounts per share and ratios. Repeated
    rows count once. raw_text without a digit gives a null amount.
    """
    s = spans.select("span_id", "accession", "concept", "raw_text", "scale", "chunk_id").distinct()
    caption = F.regexp_extract(F.col("raw_text"), r"(?m)^\[Table:([^\n]*)", 1)
    c = chunks.select(
        F.col("chunk_id").alias("_chunk"),
        F.coalesce(named_power(F.col("unit_scale")), named_power(F.element_at(F.split(caption, r"\|"), -1))).alias("_said"),
    ).filter("_said is not null and _chunk is not null")
    kind = dimension(concept_key("concept"))
    tagged = s.filter("scale is not null").withColumn("_said", F.lit(None).cast("int"))
    loose = s.filter("scale is null").join(c, F.col("chunk_id") == F.col("_chunk"), "left").drop("_chunk")
    of_chunk = F.when(kind.isin("per_share", "ratio"), None).otherwise(F.col("_said"))
    return tagged.unionByName(loose).select(
        "span_id",
        accession_key("accession").alias("accession_key"),
        concept_key("concept").alias("concept_key"),
        kind.alias("dimension"),
        F.col("scale").isNotNull().alias("tagged"),
        shifted(printed(F.col("raw_text")), F.coalesce("scale", named_power(F.col("raw_text")), of_chunk, F.lit(0))).alias("amount"),
    )


def linked(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of sources with the number of shared entities, the agreed log ratio and the median offset.

    An entity is one fact of one period, or, for the link to tagged spans, one concept of a filing. Of
    an entity each source gives one value, and every source is compared with the entity's reference
    only, so a group of any size gives at most one row per source.
    """
    values = facts.filter("value is not null and value <> 0").groupBy("accession_key", "concept_key", "period_start", "period_end", "source").agg(
        F.min_by(F.struct("value", "named"), "fact_id").alias("v")
    )
    # the reference names no scale; of several such sources the first by name
    entity = ["accession_key", "concept_key", "period_start", "period_end"]
    reference = values.groupBy(*entity).agg(F.min_by(F.struct("source", "v.value"), F.struct(F.abs("v.named"), "source")).alias("r"))
    same = [values[k].eqNullSafe(reference[k]) for k in entity]
    pairs = values.join(reference, same).select(
        values["source"].alias("source"), F.col("r.source").alias("other"), F.col("v.value").alias("a"), F.col("r.value").alias("b")
    ).filter("source <> other")
    told = spans.filter("tagged and amount <> 0").groupBy("accession_key", "concept_key").agg(F.min("amount").alias("b"), F.max("amount").alias("_top")).filter("b = _top")
    by_span = values.join(told, ["accession_key", "concept_key"]).select("source", F.lit(SPAN).alias("other"), F.col("v.value").alias("a"), "b")
    both = pairs.unionByName(by_span).select(
        "source", "other", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")
    ).filter("a * b > 0").withColumn("ratio", F.log10(F.col("b") / F.col("a")))
    bins = both.groupBy("source", "other", F.round("ratio", 1).alias("bin")).agg(
        F.count("*").alias("n"), F.percentile_approx("ratio", 0.5).alias("ratio"), F.percentile_approx(F.expr("b - a * pow(10, round(ratio))"), 0.5).alias("offset"),
        F.percentile_approx(F.abs("b"), 0.5).alias("level"),
    )
    return bins.groupBy("source", "other").agg(F.sum("n").alias("links"), F.max_by(F.struct("n", "ratio", "offset", "level"), F.struct("n", "bin")).alias("m")).select(
        "source", "other", "links", (F.col("m.n") / F.col("links")).alias("agreement"), F.col("m.ratio").alias("ratio"), F.col("m.offset").alias("offset"), F.col("m.level").alias("level")
    )


def snapped(ratio: Column) -> Column:
    """Known power nearest to a log ratio if it is within 0.05 of it, else null."""
    near = F.array_min(F.transform(F.array(*[F.lit(p) for p in KNOWN_POWERS]), lambda p: F.struct(F.abs(p - ratio).alias("off"), p.alias("p"))))
    return F.when(near["off"] <= 0.05, near["p"])


def propagated(edges: DataFrame) -> DataFrame:
    """source, power, offset and links of the sources that links reach from those that name no scale.

    edges has source, other, links, agreement, ratio, offset and level of the linked values, and the named
    power of both ends. The known sources grow round by round, each new one by its strongest link, until
    none is added; rounds follow the length of the longest path. The tables hold a row per pair of unit
    names and stay distributed.
    """
    good = checkpointed(edges.filter((F.col("links") >= MIN_LINKS) & (F.col("agreement") >= MIN_AGREEMENT) & (F.abs("offset") <= MAX_OFFSET * F.col("level"))))
    both = good.select("source", "other", "ratio", "offset", "links").unionByName(
        good.select(F.col("other").alias("source"), F.col("source").alias("other"), (-F.col("ratio")).alias("ratio"), "offset", "links")
    )
    base = edges.select(F.col("source").alias("s"), F.col("named").alias("p")).unionByName(edges.select(F.col("other").alias("s"), F.col("other_named").alias("p")))
    base = base.filter((F.col("p") == 0) | (F.col("s") == SPAN)).select(F.col("s").alias("known"), F.lit(0).alias("at")).distinct()
    known, found = checkpointed(base), None
    while True:
        power = snapped(F.col("at") + F.col("ratio"))
        reached = both.join(known, both["other"] == known["known"]).join(known.select(F.col("known").alias("source")), "source", "left_anti").withColumn("power", power).filter("power is not null")
        new = checkpointed(reached.groupBy("source").agg(F.max_by(F.struct("power", "offset", "links"), F.struct("links", "other")).alias("b")).select("source", "b.power", "b.offset", "b.links"))
        if new.isEmpty():
            return new if found is None else checkpointed(found)
        found = new if found is None else found.unionByName(new)
        known = checkpointed(known.unionByName(new.select(F.col("source").alias("known"), F.col("power").alias("at"))))


def unit_sources(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per source: the power of ten to common units, how it was found, and its links.

    found_by is links where linked sources gave the power, base where a source names no scale, and words
    where its own words decided, as its links are too few, do not agree or do not keep zero at zero.
    """
    names = facts.groupBy("source").agg(F.max("named").alias("named"), F.count("*").alias("facts"))
    far = names.select(F.col("source").alias("other"), F.col("named").alias("other_named"))
    edges = checkpointed(linked(facts, spans).join(names.select("source", "named"), "source").join(far, "other", "left"))
    learned = propagated(edges).withColumnRenamed("source", "reached")
    return names.join(learned, names["source"] == learned["reached"], "left").select(
        names["source"],
        F.coalesce("power", "named").alias("power"),
        F.when(F.col("power").isNotNull(), "links").when(F.col("named") == 0, "base").otherwise("words").alias("found_by"),
        "named",
        F.coalesce("links", F.lit(0)).alias("links"),
        "offset",
        "facts",
    )


def fact_amounts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their amount in common units; null for a null value.

    sources has one row per unit name; whether it is broadcast is left to the size that the planner
    measures.
    """
    return facts.join(sources.select("source", "power"), "source", "left").withColumn("amount", shifted(F.col("value"), F.coalesce("power", "named")))


def same_amounts(facts: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of a fact and a span of one filing and concept that state exactly the same amount.

    Nulls in key, value or raw_text match nothing; repeated rows give one pair; empty tables give none.
    """
    f, s = facts_of(facts), spans_of(spans, chunks)
    left = fact_amounts(f, unit_sources(f, s)).filter("amount is not null").select("fact_id", "accession_key", "concept_key", "amount")
    right = s.filter("amount is not null").select("span_id", "accession_key", "concept_key", "amount")
    return left.join(right, ["accession_key", "concept_key", "amount"]).select("fact_id", "span_id").distinct()
