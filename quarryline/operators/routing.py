"""Questions to filters, budgets and sub-queries, from a stored route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.periods import dates_in
from quarryline.functions.text import json_with_keys

ROUTE = "intent string, entities array<struct<ticker: string, company_name: string>>, fiscal_periods array<string>, form_types array<string>, sub_queries array<string>, confidence double"
#: Texts retrieved, texts kept and queries asked for each intent.
BUDGETS = (("lookup", 20, 5, 1), ("comparison", 50, 8, 2), ("synthesis", 50, 10, 1), ("unrouted", 50, 8, 1))
#: Form types that a route may name.
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")


def route(text: Column) -> Column:
    """Route parsed from a stored answer, null unless it has exactly the fields of ROUTE and a known intent."""
    parsed = json_with_keys(text, ROUTE, ["intent", "entities", "fiscal_periods", "form_types", "sub_queries", "confidence"])
    return F.when(parsed["intent"].isin("lookup", "comparison", "synthesis", "unsupported"), parsed)


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUDGETS), "intent string, k int, top_n int, queries int")


def planned(questions: DataFrame, least: float = 0.5) -> DataFrame:
    """Questions with intent and budget: unparsed routes are unrouted, unsupported ones have no budget and are declined.

    questions has query_id, question and route, a struct of ROUTE. least is the confidence below which a
    route gives no filters.
    """
    intent = F.coalesce(F.col("route.intent"), F.lit("unrouted"))
    rows = questions.withColumn("intent", intent).join(budgets(questions.sparkSession), "intent", "left")
    own = F.filter(F.coalesce("route.sub_queries", F.array().cast("array<string>")), lambda q: F.length(F.trim(q)) > 0)
    asked = F.slice(F.concat(own, F.array_repeat(F.col("question"), F.coalesce("queries", F.lit(1)))), 1, F.coalesce("queries", F.lit(1)))
    return rows.withColumns({"asked": asked, "declined": F.col("intent") == "unsupported", "confident": F.coalesce(F.col("route.confidence") >= least, F.lit(False))})


def period_filters(questions: DataFrame, filings: DataFrame) -> DataFrame:
    """Fiscal years and quarters that the periods of a route name, and the periods that resolve to nothing.

    A date stands for the filings that end on it, of the named tickers where there are any; a label such as
    FY2020 or Q3 FY2020 stands for itself. filings has ticker, period_end, fiscal_year and fiscal_quarter.
    """
    named = questions.filter("confident").select("query_id", F.transform("route.entities", lambda e: F.upper(e["ticker"])).alias("tickers"), F.explode("route.fiscal_periods").alias("period"))
    label = named.withColumns({"fy": F.regexp_extract("period", r"(?i)\bFY\s?(\d{4})\b", 1).try_cast("int"), "fq": F.regexp_extract("period", r"(?i)\bQ([1-4])\b", 1).try_cast("int"), "day": F.try_element_at(dates_in(F.col("period")), F.lit(1))})
    f = filings.filter("fiscal_year is not null").select(F.col("ticker").alias("f_ticker"), F.col("period_end").alias("day"), F.col("fiscal_year").alias("f_fy"), F.col("fiscal_quarter").alias("f_fq")).distinct()
    by_day = label.filter("day is not null").join(f, "day", "left").filter((F.size("tickers") == 0) | F.col("f_ticker").isNull() | F.array_contains("tickers", F.col("f_ticker")))
    found = by_day.select("query_id", "period", F.col("f_fy").alias("fy"), F.col("f_fq").alias("fq")).unionByName(label.filter("day is null").select("query_id", "period", "fy", "fq"))
    return found.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("fy").isNotNull(), F.struct("fy", "fq")))).alias("periods"),
        F.array_sort(F.collect_set(F.when(F.col("fy").isNull(), F.col("period")))).alias("unresolved"),
    )


def filters(questions: DataFrame, tickers: DataFrame) -> DataFrame:
    """query_id with the known tickers and forms of confident routes; unknown ones are dropped, an empty list does not restrict."""
    known = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    named = questions.filter("confident").select("query_id", "route.form_types", F.explode_outer(F.transform("route.entities", lambda e: F.upper(e["ticker"]))).alias("ticker"))
    real = named.join(known, "ticker", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    forms = F.array_intersect(F.coalesce("form_types", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in FORMS]))
    base = named.groupBy("query_id").agg(F.first(forms).alias("form_types"))
    return base.join(real, "query_id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))
