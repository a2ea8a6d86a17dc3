"""Evaluation items from facts: the pool of eligible keys, seeded draws, pairs of periods, texts of items, review aids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.numbers import apply_scale, number_tokens
from quarryline.functions.periods import long_date, period_kind
from quarryline.operators.datasets import draw_order, key_category

KEY = ["cik", "concept", "period_start", "period_end"]


def gold_facts(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts with golds, the distinct texts whose span states exactly their value, gold (their number) and scales of these spans."""
    s = spans.filter("value is not null and chunk_id is not null").groupBy("accession", "concept", "value").agg(F.array_sort(F.collect_set("chunk_id")).alias("golds"), F.array_sort(F.collect_set(F.coalesce("scale", F.lit(0)))).alias("scales"))
    return facts.join(s, ["accession", "concept", "value"], "left").withColumns({"golds": F.coalesce("golds", F.array().cast("array<string>")), "scales": F.coalesce("scales", F.array().cast("array<int>"))}).withColumn("gold", F.size("golds"))


def pool(facts: DataFrame) -> DataFrame:
    """Eligible keys: the fact of the key's own period, the evidence of each filing, and whether the own period is stated by one filing only.

    facts is gold_facts with is_comparative. A key whose own period several filings state is marked
    ambiguous instead of being read one way.
    """
    ok = key_category(facts, KEY).filter("category = 'eligible'")
    same = [facts[k].eqNullSafe(ok[k]) for k in KEY]
    rows = facts.join(ok.select(*KEY), same, "left_semi")
    own = ~F.coalesce("is_comparative", F.lit(False))
    first = lambda c: F.min_by(c, F.when(own, F.struct("accession", "fact_id"))).alias(c)
    by_filing = rows.groupBy(*KEY, "accession").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("golds")))).alias("chunks"))
    evidence = by_filing.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("accession", "chunks"))).alias("evidence"))
    keys = rows.groupBy(*KEY).agg(
        first("fact_id"), first("value"), first("unit"), first("fiscal_year"), first("fiscal_period"), first("form_type"), first("label"), first("scales"),
        F.min(F.when(own, F.col("accession"))).alias("own_accession"), (F.count_distinct(F.when(own, F.col("accession"))) != 1).alias("ambiguous"),
    )
    return keys.join(evidence, [keys[k].eqNullSafe(evidence[k]) for k in KEY]).select(*[keys[k] for k in KEY], *[c for c in keys.columns if c not in KEY], "evidence")


def evidence_sets(evidence: Column, accession: Column | None = None) -> Column:
    """One set for each text that is evidence, in order; those of one filing only where it is given."""
    own = evidence if accession is None else F.filter(evidence, lambda e: e["accession"] == accession)
    return F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda e: e["chunks"])))), lambda c: F.array(c))


def all_chunks(evidence: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(evidence, lambda e: e["chunks"])))


def round_robin(rows: DataFrame, group: str, strata: list[str], key: list[str], places: DataFrame, seed: str) -> DataFrame:
    """Draw of places rows per group, one of each stratum in turn, strata and rows shuffled; position from 1, short tells a group with too few rows.

    places has the group and places. A key is drawn once: repeated rows of one key count once.
    """
    once = rows.dropDuplicates(key)
    shuffled = Window.partitionBy(group, *strata).orderBy(draw_order(seed, *key), *key)
    turn = once.withColumn("_turn", F.row_number().over(shuffled)).withColumn("_stratum", draw_order(seed + ":strata", group, *strata))
    order = Window.partitionBy(group).orderBy("_turn", "_stratum", *strata)
    sizes = once.groupBy(group).agg(F.count("*").alias("_there"))
    return turn.join(places, group).join(sizes, group).withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= F.col("places")).withColumn("short", F.col("_there") < F.col("places")).drop("_turn", "_stratum", "_there")


def unused(draw: DataFrame, members: str, used: DataFrame) -> DataFrame:
    """Rows of a draw of which no member, an array, was used before; used has member."""
    hit = draw.select("*", F.explode(members).alias("member")).join(used, "member", "left_semi")
    keys = [c for c in draw.columns if c != members]
    return draw.join(hit.select(*keys).distinct(), keys, "left_anti")


def largest_remainder(sizes: DataFrame, key: str, n: int) -> DataFrame:
    """key, size and places by largest remainders; ties go to the smaller key. One row per stratum."""
    total = sizes.agg(F.sum("size").alias("total"))
    quota = F.col("size").cast("double") * n / F.col("total")
    rows = sizes.join(F.broadcast(total)).withColumns({"_floor": F.floor(quota), "_rest": F.round(quota - F.floor(quota), 9)})
    left = n - F.sum("_floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), key))
    return rows.select(key, "size", (F.col("_floor") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("places"))


def quota_draw(items: DataFrame, stratum: str, key: str, n: int, seed: str, planned: int = 0) -> DataFrame:
    """n - planned items, strata in proportion to their size, shuffled within; planned places are kept for items still to be written."""
    places = largest_remainder(items.groupBy(stratum).agg(F.count("*").alias("size")), stratum, n - planned)
    w = Window.partitionBy(stratum).orderBy(draw_order(seed, key), key)
    return items.join(places.select(stratum, "places"), stratum).withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= F.col("places")).drop("places")


def slots(keys: DataFrame) -> DataFrame:
    """Keys of the pool with the kind of their period and the quarter, and only those that are alone in their slot."""
    kind = period_kind(F.col("period_start"), F.col("period_end"), F.col("form_type"), F.regexp_extract("fiscal_period", "^Q([1-3])$", 1).try_cast("int"))
    marked = keys.withColumns({"kind": kind, "quarter": F.regexp_extract("fiscal_period", "^Q([1-3])$", 1).try_cast("int")}).filter("kind <> 'other'")
    slot = ["cik", "concept", "kind", "quarter", "fiscal_year"]
    alone = marked.groupBy(*slot).agg(F.count("*").alias("_n")).filter("_n = 1")
    return marked.join(alone, [marked[c].eqNullSafe(alone[c]) for c in slot], "left_semi")


def pairs(keys: DataFrame, gaps: list[int]) -> DataFrame:
    """Earlier and later key of one company, concept, kind of period and quarter that are a gap of fiscal years apart, without a common text."""
    s = slots(keys).select("cik", "concept", "kind", F.coalesce("quarter", F.lit(0)).alias("quarter"), "fiscal_year", F.struct("fact_id", "period_start", "period_end", "value", "unit", "scales", "evidence", "own_accession", "fiscal_year", "quarter").alias("k"))
    later = s.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps]))).withColumn("fiscal_year", F.col("fiscal_year") - F.col("gap")).withColumnRenamed("k", "later")
    both = s.withColumnRenamed("k", "earlier").join(later, ["cik", "concept", "kind", "quarter", "fiscal_year"])
    return both.filter(~F.arrays_overlap(all_chunks(F.col("earlier.evidence")), all_chunks(F.col("later.evidence")))).select("cik", "concept", "kind", "gap", "earlier", "later")


def pair_evidence(found: DataFrame) -> DataFrame:
    """Pairs with evidence, every two texts of which one states each side, sorted within and among themselves."""
    a, b = all_chunks(F.col("earlier.evidence")), all_chunks(F.col("later.evidence"))
    sets = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array(x, y)))))
    return found.withColumn("sets", F.array_sort(sets))


def printed_together(sides: DataFrame, texts: DataFrame) -> DataFrame:
    """pair_id, side-complete texts: chunk_id of the company's texts that print a number of each side, an upper bound as tokens match.

    sides has pair_id, cik, side and tokens (as printed); texts cik, chunk_id and text. Tokens are joined
    by company and token; no text meets a pair it shares no token with.
    """
    t = texts.select("cik", "chunk_id", F.explode(number_tokens(F.col("text"))).alias("token"))
    hit = sides.select("pair_id", "cik", "side", F.explode("tokens").alias("token")).distinct().join(t, ["cik", "token"])
    return hit.groupBy("pair_id", "chunk_id").agg(F.count_distinct("side").alias("sides")).filter("sides = 2").select("pair_id", "chunk_id")


#: Words of ordinals, of spans of months, and of printed scales.
ORDINAL = {1: "first", 2: "second", 3: "third"}
MONTHS = ((85, 98, "three months"), (175, 189, "six months"), (262, 280, "nine months"))
SCALE_WORD = {0: "", 3: " thousand", 6: " million", 9: " billion"}


def period_phrase(kind: Column, start: Column, end: Column, year: Column, quarter: Column) -> Column:
    """How an item names a period, and its dates: phrase and dates."""
    nth = F.element_at(F.array(*[F.lit(w) for w in ORDINAL.values()]), F.coalesce(quarter, F.lit(1)))
    y = year.cast("string")
    phrase = (
        F.when(kind == "annual", F.concat(F.lit("fiscal "), y))
        .when(kind == "quarter", F.concat(F.lit("the "), nth, F.lit(" quarter of fiscal "), y))
        .when(kind == "ytd", F.concat(F.lit("the first "), F.when(quarter == 2, "two").otherwise("three"), F.lit(" quarters of fiscal "), y))
        .when(quarter.isNull(), F.concat(F.lit("the end of fiscal "), y))
        .otherwise(F.concat(F.lit("the end of the "), nth, F.lit(" quarter of fiscal "), y))
    )
    days = F.datediff(end, start) + 1
    span = F.concat((days / 7).cast("int").cast("string"), F.lit(" weeks"))
    for low, high, words in MONTHS:
        span = F.when(days.between(low, high), F.lit(words)).otherwise(span)
    dates = F.when(kind == "instant", long_date(end)).when(kind == "annual", F.concat(F.lit("the fiscal year ended "), long_date(end))).otherwise(F.concat(F.lit("the "), span, F.lit(" ended "), long_date(end)))
    return F.struct(phrase.alias("phrase"), dates.alias("dates"))


def value_text(value: Column, unit: Column, scales: Column) -> Column:
    """Amount as an item prints it: per share with two places or more, dollars at the one printed scale; null where it has none."""
    sign = F.when(value < 0, "-").otherwise("")
    plain = F.regexp_replace(F.regexp_replace(F.abs(value).cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    grouped = lambda t: F.regexp_replace(F.substring_index(t, ".", 1), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    places = F.rpad(F.regexp_extract(plain, r"\.(\d+)$", 1), F.greatest(F.lit(2), F.length(F.regexp_extract(plain, r"\.(\d+)$", 1))), "0")
    per_share = F.concat(sign, F.lit("$"), grouped(plain), F.lit("."), places)
    one = F.when(F.size(scales) == 1, scales[0])
    shown = apply_scale(F.abs(value), -one, "decimal(38,12)").cast("string")
    short = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    word = F.lit(None).cast("string")
    for power, name in SCALE_WORD.items():
        word = F.when(one == power, F.lit(name)).otherwise(word)
    rest = F.when(short.contains("."), F.concat(F.lit("."), F.substring_index(short, ".", -1))).otherwise("")
    money = F.concat(sign, F.lit("$"), grouped(short), rest, word)
    return F.when(F.upper(unit) == "USD/SHARES", per_share).when(F.upper(unit) == "USD", money)


def items(draw: DataFrame, templates: list[tuple[str, str, str]], seed: str, version: str) -> DataFrame:
    """Items of drawn keys: question by a template that the hash of the key picks, answer, evidence, tags; problem says why one has no text.

    templates are id, scope (filing or any) and text with {company}, {label}, {period}, {dates}. draw has the
    columns of the pool with company, kind and quarter.
    """
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("fact_id")), F.lit(len(templates))).cast("int")
    t = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("scope"), F.lit(x).alias("text")) for i, s, x in templates])
    p = period_phrase(F.col("kind"), F.col("period_start"), F.col("period_end"), F.col("fiscal_year"), F.col("quarter"))
    rows = draw.withColumns({"t": F.get(t, pick), "p": p, "a": value_text(F.col("value"), F.col("unit"), F.col("scales"))})
    text = F.col("t.text")
    for name, c in (("{company}", F.col("company")), ("{label}", F.col("label")), ("{period}", F.col("p.phrase")), ("{dates}", F.col("p.dates"))):
        text = F.replace(text, F.lit(name), c)
    when = F.concat(F.when(F.col("kind") == "instant", " as of ").otherwise(" for "), F.col("p.dates"), F.lit("."))
    own = F.when(F.col("t.scope") == "filing", F.col("own_accession"))
    sets = F.when(own.isNull(), evidence_sets(F.col("evidence"))).otherwise(evidence_sets(F.col("evidence"), own))
    return rows.select(
        F.concat(F.lit("fact-"), F.col("fact_id").cast("string")).alias("item_id"), text.alias("question"), F.concat("a", when).alias("reference_answer"), sets.alias("gold_evidence_sets"),
        F.array(F.concat(F.lit("FY"), F.col("fiscal_year").cast("string")), "form_type", "kind", F.concat(F.lit("template:"), F.col("t.id"))).alias("tags"),
        F.lit(version).alias("dataset_version"), F.when(F.col("a").isNull(), "no printed form").when(text.isNull(), "no text").alias("problem"),
    )


def comparison_items(found: DataFrame) -> DataFrame:
    """Answers of pairs: both values with their periods and the difference, later less earlier; problem where units or printed scales differ."""
    a, b = F.col("earlier"), F.col("later")
    unlike = F.when(~a["unit"].eqNullSafe(b["unit"]), "units").when((F.upper(a["unit"]) == "USD") & (a["scales"] != b["scales"]), "scales")
    moved = b["value"] - a["value"]
    phrase = lambda k: period_phrase(F.col("kind"), k["period_start"], k["period_end"], k["fiscal_year"], k["quarter"])["phrase"]
    text = lambda v: value_text(v, b["unit"], b["scales"])
    way = F.when(moved > 0, "an increase of").when(moved < 0, "a decrease of").otherwise("a difference of")
    at = F.when(F.col("kind") == "instant", " at ").otherwise(" for ")
    answer = F.concat(text(b["value"]), at, phrase(b), F.lit(", compared with "), text(a["value"]), at, phrase(a), F.lit(": "), way, F.lit(" "), text(F.abs(moved)), F.lit("."))
    return pair_evidence(found).select("cik", "concept", "kind", "gap", F.when(unlike.isNull(), answer).alias("reference_answer"), "sets", F.coalesce(unlike, F.when(answer.isNull(), "no printed form")).alias("problem"))


def record_problems(records: DataFrame, draw: DataFrame, key: str, stamp: str) -> DataFrame:
    """Records that do not belong: duplicate, foreign (not drawn) or of another draw (its hash differs from stamp); and drawn keys without a record."""
    twice = records.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("duplicate").alias("problem"))
    foreign = records.join(draw, key, "left_anti").select(key, F.lit("foreign").alias("problem"))
    stale = records.filter(~F.col("draw_hash").eqNullSafe(F.lit(stamp))).select(key, F.lit("other draw").alias("problem"))
    missing = draw.join(records, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return twice.unionByName(foreign).unionByName(stale).unionByName(missing).distinct()


def stage_counts(rows: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Rows per stratum and reason of being dropped, `kept` for none."""
    return rows.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("stage")).agg(F.count("*").alias("rows"))


def figure_elsewhere(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id and other texts of the same filing that print the item's figure; figures has item_id, accession, chunk_id and token."""
    t = texts.select("accession", F.col("chunk_id").alias("other"), F.explode(number_tokens(F.col("text"))).alias("token"))
    return figures.join(t, ["accession", "token"]).filter("other <> chunk_id").select("item_id", "other").distinct()


def band(value: Column, edges: list[float]) -> Column:
    """Band of a value between edges, as text; null for null."""
    out = F.lit(f">= {edges[-1]:g}")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when(value < high, F.lit(f"{low:g} to {high:g}")).otherwise(out)
    return F.when(value.isNotNull(), F.when(value < edges[0], F.lit(f"< {edges[0]:g}")).otherwise(out))


def written_problems(items: DataFrame, known_chunks: DataFrame, twins: DataFrame, quotas: DataFrame) -> DataFrame:
    """item_id and problems of hand-written items: no question, no answer though one is expected, evidence that is no text, no evidence though one
    is needed, a near-duplicate of an earlier question; and rows without item_id for types that miss their quota.

    known_chunks has chunk_id; twins item_id (rows of earlier near-duplicates); quotas question_type and least.
    """
    cited = items.select("item_id", F.explode(F.flatten("gold_evidence_sets")).alias("chunk_id")).join(known_chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("item_id").distinct().withColumn("_unknown", F.lit(True))
    close = twins.select("item_id").distinct().withColumn("_twin", F.lit(True))
    rows = items.join(cited, "item_id", "left").join(close, "item_id", "left")
    abstains = F.coalesce("expected_abstain", F.lit(False))
    said = F.array(
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", F.lit("no question")),
        F.when(~abstains & (F.coalesce(F.trim("reference_answer"), F.lit("")) == ""), F.lit("no answer")),
        F.when(F.col("_unknown"), F.lit("unknown evidence")),
        F.when(~abstains & (F.coalesce(F.size(F.flatten("gold_evidence_sets")), F.lit(0)) <= 0), F.lit("no evidence")),
        F.when(F.col("_twin"), F.lit("near-duplicate")),
    )
    found = rows.select("item_id", F.filter(said, lambda x: x.isNotNull()).alias("problems")).filter(F.size("problems") > 0)
    counts = items.groupBy("question_type").agg(F.count("*").alias("n"))
    short = quotas.join(counts, "question_type", "left").filter(F.coalesce("n", F.lit(0)) < F.col("least")).select(F.lit(None).cast("string").alias("item_id"), F.array(F.concat(F.lit("too few "), "question_type")).alias("problems"))
    return found.unionByName(short)
