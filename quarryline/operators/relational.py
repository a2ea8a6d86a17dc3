"""Relational operators that Spark does not have by name: interval and as-of joins, upserts, islands, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    """Join condition on keys by which null equals null; Catalyst still hashes them."""
    return [a[k].eqNullSafe(b[k]) for k in keys]


def inserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not there yet, one for each key (ON CONFLICT DO NOTHING)."""
    once = new.dropDuplicates(keys)
    return once.join(existing, same(once, existing, keys), "left_anti")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of new put in the place of those of the same key (ON CONFLICT DO UPDATE); keys of new are unique."""
    return existing.join(new, same(existing, new, keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replaced(existing: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """existing with all rows of those parts that new has put in their place."""
    parts = new.select(part).distinct()
    return existing.join(parts, part, "left_anti").unionByName(new)


def promoted(staged: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Staged rows whose parent exists, and those that go on waiting."""
    return staged.join(parents, key, "left_semi"), staged.join(parents, key, "left_anti")


def drifted(stored: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with the stored and the source value where these differ, null differing from any value."""
    s, t = stored.select(*keys, F.col(value).alias("stored")), source.select(*keys, F.col(value).alias("source"))
    return s.join(t, same(s, t, keys)).filter(~F.col("stored").eqNullSafe(F.col("source"))).select(*[s[k] for k in keys], "stored", "source")


#: Offsets of a stripe by which intervals of one part are joined.
STRIPE = 16_384


def contained(inner: DataFrame, outer: DataFrame, part: str, inner_id: str, outer_id: str) -> DataFrame:
    """For each interval of inner the first interval of outer that contains it, and how many do.

    Both have part, char_start and char_end. An interval of inner without a container has null and 0. The
    join is on part and stripes of offsets, so a long part does not meet itself.
    """
    i = inner.select(part, inner_id, F.col("char_start").alias("_from"), F.col("char_end").alias("_to")).distinct()
    # a container holds the begin of what it contains, so intervals meet in the stripe of offsets of that begin only
    stripes = F.sequence(F.floor(F.col("char_start") / STRIPE), F.floor(F.greatest("char_start", "char_end") / STRIPE))
    o = outer.select(part, F.col(outer_id).alias("_id"), "char_start", "char_end").withColumn("_stripe", F.explode(stripes))
    hit = i.withColumn("_stripe", F.floor(F.col("_from") / STRIPE)).join(o, [part, "_stripe"]).filter("char_start <= _from and _to <= char_end")
    first = hit.groupBy(part, inner_id, "_from", "_to").agg(F.min_by("_id", F.struct("char_start", "_id")).alias("_id"), F.count("*").alias("containers"))
    keys = [part, inner_id, "_from", "_to"]
    # keys of intervals hold no null here, as part and offsets joined
    return i.join(first, keys, "left").select(part, inner_id, F.col("_id").alias(outer_id), F.coalesce("containers", F.lit(0)).alias("containers"))


def last_before(rows: DataFrame, part: list[str], order: list[str], marker: Column, default: Column) -> Column:
    """Latest marker at or before each row, else the default."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(marker, ignorenulls=True).over(w), default)


def islands(rows: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
    """Overlapping ranges of each part merged; ranges that only touch stay apart."""
    before = Window.partitionBy(*part).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(*part).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col(start) < F.max(end).over(before), 0).otherwise(1)
    numbered = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(up_to))
    return numbered.groupBy(*part, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("ranges")).drop("_island")


#: Ranges that ordered values are dealt to, so that running sums go over ranges first and within one then.
RANGES = 256


def ranged(rows: DataFrame, value: str) -> DataFrame:
    """rows with _range, the number of the range of their value; equal values share one. The edges are one row of RANGES quantiles."""
    edges = rows.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 10_000).alias("_edges"))
    place = F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < F.col(value).cast("double")))
    return rows.join(F.broadcast(edges)).withColumn("_range", place).drop("_edges")


def running(counts: DataFrame, value: str, names: list[str], part: list[str] | None = None, descending: bool = False) -> DataFrame:
    """counts, a row per value, with name_before: the sum of each named column over smaller values (larger ones if descending), and name_all."""
    part = part or []
    r = ranged(counts, value)
    sums = r.groupBy(*part, "_range").agg(*[F.sum(n).alias(n) for n in names])
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    past = Window.partitionBy(*part).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    before = sums.select(*[F.col(c).alias(f"_p_{c}") for c in part], F.col("_range").alias("_p_range"), *[F.coalesce(F.sum(n).over(past), F.lit(0)).alias(f"_{n}_past") for n in names], *[F.sum(n).over(whole).alias(f"{n}_all") for n in names])
    inner = Window.partitionBy(*part, "_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    joined = r.join(before, [F.col("_range") == F.col("_p_range"), *[F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in part]])
    return joined.select(*counts.columns, *[(F.col(f"_{n}_past") + F.coalesce(F.sum(n).over(inner), F.lit(0))).alias(f"{n}_before") for n in names], *[f"{n}_all" for n in names])


def nearest_rank(rows: DataFrame, part: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """Order statistics: name to an expression of n for the place from 0, as "n div 2" or "cast(0.95 * (n - 1) as int)".

    Values are counted and dealt to ranges before they are ordered, so no task orders a whole part. Nulls
    do not count.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("c"))
    upto = running(counts, value, ["c"], part).withColumnsRenamed({"c_all": "n", "c_before": "below"})
    picks = [F.max(F.when((F.col("below") + F.col("c") > F.expr(at)) & (F.col("below") <= F.expr(at)), F.col(value))).alias(name) for name, at in places.items()]
    return upto.groupBy(*part).agg(F.max("n").alias("n"), *picks)


def conflicts(rows: DataFrame, keys: list[str], value: str, within: str) -> DataFrame:
    """Keys with more than one distinct value: how many, over how many of `within`, and the extremes."""
    # two steps of plain counts instead of one with two distinct counts, which would multiply the rows
    by_value = rows.groupBy(*keys, value).agg(F.count("*").alias("rows"))
    values = by_value.groupBy(*keys).agg(F.count(value).alias("values"), F.min(value).alias("lowest"), F.max(value).alias("highest")).filter("values > 1")
    sources = rows.select(*keys, within).distinct().groupBy(*keys).agg(F.count(within).alias("sources"))
    return values.join(sources, same(values, sources, keys)).select(*[values[k] for k in keys], "values", "sources", "lowest", "highest")


def filled_from(rows: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with a missing value taken from the cache by key (UPDATE ... FROM); cache has one row per key."""
    c = cache.select(*keys, F.col(value).alias("_cached"))
    return rows.join(c, keys, "left").withColumn(value, F.coalesce(value, "_cached")).drop("_cached")


def cascaded(children: DataFrame, parents: DataFrame, key: str, on_delete: str = "cascade") -> DataFrame:
    """children after their parents were deleted: those without a parent go (cascade) or lose the key (null); a null key stays."""
    if on_delete == "cascade":
        orphans = children.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")
        return children.join(orphans.select(key).distinct(), key, "left_anti")
    there = parents.select(key).distinct().withColumn("_there", F.lit(True))
    return children.join(there, key, "left").withColumn(key, F.when(F.col("_there"), F.col(key))).drop("_there")


def violations(rows: DataFrame, checks: dict[str, Column], unique: list[str] | None = None, parents: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Constraint and number of rows that break it: checks by name (null breaks none), unique keys by which null equals null, and a foreign key."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()]) if checks else None
    out = None if counts is None else counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in checks]), F.array(*[F.col(f"`{n}`") for n in checks]))).alias("check", "rows"))
    more = []
    if unique:
        more.append(rows.groupBy(*unique).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit("unique").alias("check"), "rows"))
    if parents:
        table, key = parents
        more.append(rows.filter(F.col(key).isNotNull()).join(table.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("rows")).select(F.lit("foreign key").alias("check"), "rows"))
    for m in more:
        out = m if out is None else out.unionByName(m)
    return out


def load_counts(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row of what a load does: rows offered, inserted and already present."""
    offered = new.agg(F.count("*").alias("offered"))
    added = inserted(existing, new, keys).agg(F.count("*").alias("inserted"))
    return offered.join(F.broadcast(added)).withColumn("present", F.col("offered") - F.col("inserted"))  # two rows of one


def every_nth(rows: DataFrame, order: list[str], n: int, part: list[str]) -> DataFrame:
    """Every n-th row of each part in an order, the first among them."""
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % n == 0).drop("_n")


def preferred(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """cik, item and the tag to read: the named tag, or its variant only for a company with no fact under the named one; null if it has neither.

    wanted has item, tag and variant; facts cik and concept.
    """
    have = facts.select("cik", F.col("concept").alias("tag")).distinct()
    named = wanted.join(have, "tag").select("cik", "item", F.col("tag").alias("_named"))
    other = wanted.filter("variant is not null").join(have.withColumnRenamed("tag", "variant"), "variant").select("cik", "item", F.col("variant").alias("_other"))
    return named.join(other, ["cik", "item"], "full").select("cik", "item", F.coalesce("_named", "_other").alias("tag"))


def interval_classes(inner: DataFrame, outer: DataFrame, part: str, inner_id: str, outer_id: str, width: int = STRIPE) -> DataFrame:
    """For each interval of inner its container and class: unique, overlap, split, before_first or unresolved.

    unique has one container, overlap several (the first counts); split crosses the border of an interval;
    before_first ends before the first one of its part. Intervals are dealt to stripes of offsets, so a
    join within a part meets only what is near; outer intervals are listed in each stripe they touch.
    """
    i = inner.select(part, inner_id, F.col("char_start").alias("f"), F.col("char_end").alias("t")).distinct()
    stripes = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(b, a) / width)))
    o = outer.select(part, F.col(outer_id).alias("o_id"), F.col("char_start").alias("of"), F.col("char_end").alias("ot")).withColumn("stripe", stripes(F.col("of"), F.col("ot")))
    near = i.withColumn("stripe", stripes(F.col("f"), F.col("t"))).join(o, [part, "stripe"])
    holds, crosses = (F.col("of") <= F.col("f")) & (F.col("t") <= F.col("ot")), (F.col("of") < F.col("t")) & (F.col("f") < F.col("ot"))
    found = near.filter(crosses | holds).groupBy(part, inner_id, "f", "t").agg(
        F.min_by(F.when(holds, F.col("o_id")), F.when(holds, F.struct("of", "o_id"))).alias("container"),
        F.count_distinct(F.when(holds, F.col("o_id"))).alias("holders"), F.count_if(crosses & ~holds).alias("crossed"),
    )
    first = outer.groupBy(part).agg(F.min("char_start").alias("first"))
    out = i.join(found, [part, inner_id, "f", "t"], "left").join(first, part, "left")
    kind = F.when(F.col("holders") == 1, "unique").when(F.col("holders") > 1, "overlap").when(F.coalesce("crossed", F.lit(0)) > 0, "split").when(F.col("t") <= F.col("first"), "before_first").otherwise("unresolved")
    return out.select(part, inner_id, F.col("container").alias(outer_id), kind.alias("class"))


def resolution(classes: DataFrame) -> DataFrame:
    """One row: intervals, resolved, and the share resolved of all and of those not before the first."""
    ok = F.count_if(F.col("class").isin("unique", "overlap"))
    n, before = F.count("*"), F.count_if(F.col("class") == "before_first")
    return classes.agg(n.alias("intervals"), ok.alias("resolved"), F.round(F.coalesce(F.try_divide(ok, n), F.lit(0.0)), 6).alias("rate"), F.round(F.coalesce(F.try_divide(ok, n - before), F.lit(0.0)), 6).alias("rate_after_first"))
