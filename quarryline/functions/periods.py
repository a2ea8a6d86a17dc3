"""Dates and fiscal periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a date such as May 5, 2020 or 2020-05-05.
DATE = r"(?i)(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.? \d{1,2}, \d{4}|\b\d{4}-\d{2}-\d{2}\b"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def dates_in(text: Column) -> Column:
    """Dates of a text in order; a day that does not exist is left out."""

    def one(found: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(found, 1, 3)))
        parts = F.regexp_extract_all(found, F.lit(r"\d+"), 0)
        written = F.concat_ws("-", F.element_at(parts, -1), F.lpad(month.cast("string"), 2, "0"), F.lpad(parts[0], 2, "0"))
        return F.when(month > 0, written).otherwise(found).try_cast("date")

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(DATE), 0), one), lambda d: d.isNotNull())


#: Days of three, six and nine months, both ends counted, and of a year.
MONTH_DAYS = ((85, 98), (175, 189), (262, 280))
YEAR_DAYS = (357, 371)


def period_kind(start: Column, end: Column, form: Column | None = None, quarter: Column | None = None) -> Column:
    """instant, annual, quarter, ytd or other, by the days from start to end, both counted.

    A year is one in an annual filing only, other spans are ones of months or whole weeks in a quarterly
    filing; up to 120 days they are a quarter, else ytd where their days are 80 to 95 for each quarter
    so far. Without a form or quarter any fits.
    """
    days = F.datediff(end, start) + 1
    months = F.lit(False)
    for low, high in MONTH_DAYS:
        months = months | days.between(low, high)
    regular = months | (days % 7 == 0)
    annual = F.lit(True) if form is None else F.upper(form).startswith("10-K")
    quarterly = F.lit(True) if form is None else F.upper(form).startswith("10-Q")
    if quarter is None:
        to_date = days.between(80 * 2, 95 * 2) | days.between(80 * 3, 95 * 3)
    else:
        to_date = quarter.isin(2, 3) & days.between(80 * quarter, 95 * quarter)
    return (
        F.when(start.isNull(), "instant")
        .when(F.coalesce(annual, F.lit(False)) & days.between(*YEAR_DAYS), "annual")
        .when(F.coalesce(quarterly, F.lit(False)) & regular & (days > 0) & (days <= 120), "quarter")
        .when(F.coalesce(quarterly & regular & to_date, F.lit(False)), "ytd")
        .otherwise("other")
    )


#: Fixed value: a fiscal label: a quarter as Q1 or in words, or FY, and a year.
LABEL = r"(?i)^\s*(?:Q([1-4])\s*|(first|second|third|fourth)\s+quarter\s+(?:of\s+)?)?(?:FY|fiscal(?:\s+year)?)?\s*'?(\d{4})\s*$"


def label_parts(text: Column) -> Column:
    """Year and quarter of a fiscal label, quarter null for a year; Q4 is the year. Null for any other text."""
    word = F.lower(F.regexp_extract(text, LABEL, 2))
    number = F.coalesce(F.regexp_extract(text, LABEL, 1).try_cast("int"), F.nullif(F.array_position(F.array(*[F.lit(w) for w in ("first", "second", "third", "fourth")]), word).cast("int"), F.lit(0)))
    year = F.regexp_extract(text, LABEL, 3).try_cast("int")
    return F.when(year.isNotNull(), F.struct(year.alias("fiscal_year"), F.when(number < 4, number).alias("fiscal_quarter")))


def period_ends(stated: DataFrame, filings: DataFrame) -> DataFrame:
    """The rows of stated (a period text and cik among others) with each period_end they mean: its dates, else the end of the company's own filing of the label."""
    dated = stated.withColumn("_dates", F.array_distinct(dates_in(F.col("period"))))
    by_date = dated.filter(F.size("_dates") > 0).select(*stated.columns, F.explode("_dates").alias("period_end"))
    labelled = dated.filter(F.size("_dates") <= 0).withColumn("_l", label_parts(F.col("period"))).filter("_l is not null")
    own = filings.select(F.col("cik").alias("_cik"), "period_end", F.col("fiscal_year").alias("_y"), F.col("fiscal_quarter").alias("_q")).distinct()
    by_label = labelled.join(own, (F.col("cik") == F.col("_cik")) & (F.col("_l.fiscal_year") == F.col("_y")) & F.col("_l.fiscal_quarter").eqNullSafe(F.col("_q"))).select(*stated.columns, "period_end")
    return by_date.unionByName(by_label).filter("period_end is not null").distinct()


def fiscal_quarter(label: Column) -> Column:
    """Quarter of a label such as Q3, null for a year."""
    return F.regexp_extract(F.upper(F.trim(label)), r"^Q([1-4])$", 1).try_cast("int")


def period_label(year: Column, quarter: Column) -> Column:
    """FY2020 or Q3 FY2020."""
    return F.concat(F.when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "))).otherwise(""), F.lit("FY"), year.cast("string"))


def years_before(day: Column, years: int) -> Column:
    """Same day so many years before; 29 February becomes 28 where it must."""
    return F.add_months(day, -12 * years)


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")
