"""Figures as printed: parsing, scales, comparison. Money stays decimal from end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"
#: Words for scales, and the powers of ten they stand for.
SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
#: A figure in running text that is not masked: sign, bracket, currency, digits, bracket, percent sign, scale word, at most one blank between them.
FIGURE = r"(?i)[-−]?\(?\s?\$?\s?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?\)?\s?%?(?:\s?(?:thousand|million|billion|trillion)s?\b)?"


def parse_number(text: Column) -> Column:
    """Number of a printed figure; null where the text is none.

    A dollar sign may stand before or in brackets, brackets make it negative, any dash is a minus, commas
    and spaces of any kind part groups, a lone dash or nothing inside the brackets is 0. A percent sign
    is not part of a number; null and blank texts give null.
    """
    bare = F.regexp_replace(F.trim(text), r"^\$\s*", "")
    negative = bare.rlike(r"^\(.*\)$")
    inside = F.regexp_replace(F.when(negative, F.regexp_replace(bare, r"^\(|\)$", "")).otherwise(bare), "[−–—]", "-")
    digits = F.regexp_replace(inside, r"[$,\s\u00a0\u2007\u2009\u202f]", "")
    number = F.when(digits.isin("", "-"), F.lit("0")).when(digits.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), digits).try_cast(MONEY)
    return F.when(F.trim(text) == "", None).otherwise(F.when(negative, -number).otherwise(number))


def power_of_ten(power: Column) -> Column:
    """10 ** power for -12 to 12, exact; null beyond."""
    out = F.lit(None).cast("decimal(26,12)")
    for p in range(-12, 13):
        out = F.when(power == p, F.lit(f"1e{p}").cast("decimal(26,12)")).otherwise(out)
    return out


def apply_scale(value: Column, power: Column, kind: str = MONEY) -> Column:
    """value * 10 ** power, null on overflow or for a null; with a kind of more decimals, negative powers keep up to 14."""
    if kind != MONEY:
        down = F.try_multiply(value.try_cast("decimal(28,6)"), F.when(power < 0, power_of_ten(power)).cast("decimal(13,12)"))
        return F.when(power < 0, down.try_cast(kind)).otherwise(apply_scale(value, power).try_cast(kind))
    return F.try_multiply(value.try_cast("decimal(28,6)"), power_of_ten(power)).try_cast(MONEY)


def scale_of(word: Column) -> Column:
    """Power of ten of the first of thousand, million, billion, trillion that a text names, in this order; null if none."""
    out = F.lit(None).cast("int")
    for name, power in reversed(SCALES.items()):
        out = F.when(F.lower(word).contains(name), F.lit(power)).otherwise(out)
    return out


def caption_scale(caption: Column) -> Column:
    """Power of ten that a caption names before any exception; null if it names none or two."""
    before = F.element_at(F.split(F.lower(caption), r"\bexcept\b"), 1)
    named = F.array_distinct(F.transform(F.regexp_extract_all(before, F.lit(r"\b(thousand|million|billion|trillion)s?\b")), scale_of))
    return F.when(F.size(named) == 1, named[0])


def is_value(text: Column) -> Column:
    """Whether a table cell is a figure: it has a digit and parses, a percent sign at its end aside."""
    return F.coalesce(text.rlike(r"\d") & parse_number(F.regexp_replace(F.trim(text), r"\s*%$", "")).isNotNull(), F.lit(False))


def figures(text: Column) -> Column:
    """Array of the figures of a running text: as printed, value at its own scale, and whether it is a percentage."""

    def one(printed: Column) -> Column:
        number = parse_number(F.regexp_extract(printed, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0))
        value = apply_scale(number, F.coalesce(scale_of(printed), F.lit(0)))
        negative = printed.rlike(r"^[-−]|^\(.*\)")
        return F.struct(F.trim(printed).alias("printed"), F.when(negative, -value).otherwise(value).alias("value"), printed.contains("%").alias("percent"))

    return F.transform(F.regexp_extract_all(text, F.lit(FIGURE), 0), one)


def within(a: Column, b: Column, percent: float) -> Column:
    """Whether magnitudes differ by at most a percentage of b; b = 0 asks for a = 0. No division, so no zero divisor."""
    return F.abs(F.abs(a) - F.abs(b)) * 100 <= F.abs(b) * F.lit(percent).cast("decimal(8,4)")


def printed_interval(printed: Column, power: Column) -> Column:
    """lo and hi of the values that would be printed so: half a unit of the last digit on both sides; null below two significant digits."""
    digits = F.regexp_replace(printed, "[^0-9.]", "")
    places = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
    value = digits.try_cast(MONEY)
    significant = F.length(F.regexp_replace(F.regexp_replace(F.when(places > 0, F.regexp_replace(digits, r"\.", "")).otherwise(F.regexp_replace(digits, "0+$", "")), "^0+", ""), r"\.", ""))
    half = power_of_ten(power - places) / 2
    mid = apply_scale(value, power)
    return F.when(significant >= 2, F.struct((mid - half).cast(MONEY).alias("lo"), (mid + half).cast(MONEY).alias("hi")))


#: What is blanked before figures are read, in this order: dates, ISO dates, days with a year, quarters, fiscal years, forms,
#: numbered parts, spans of time and bare years.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
MASKS = (
    rf"(?i)\b{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2},\s+(?:19|20)\d{2}\b",
    r"(?i)\bQ[1-4]\b",
    r"(?i)\b(?:FY|fiscal(?:\s+year)?)\s*'?\d{2,4}\b",
    r"(?i)\b(?:Form\s+)?(?:10-K|10-Q|8-K|20-F|S-1)(?:/A)?\b",
    r"(?i)\b(?:Item|Note|Part|Section|Exhibit)\s+[IVX\d]+[A-C]?(?:\.\d+)?\b",
    r"(?i)\b\d+[\s-](?:weeks?|months?|days?|quarters?|years?)\b",
    r"(?i)(?<![$\d,.])\b(?:19|20)\d{2}\b(?![\d,.%]|\s*(?:thousand|million|billion|trillion))",
)
#: Fixed value: a figure in masked text: minus, bracket, currency, number, bracket, percent sign, scale word.
MASKED_FIGURE = r"(?i)(?:[-−]\s*)?\(?\s*\$?\s*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*\)?\s*%?(?:\s*(?:thousand|million|billion|trillion)s?\b)?"
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def masked(text: Column) -> Column:
    """Text with dates, periods, forms, numbered parts and years blanked, so that their numbers are no figures.

    A match becomes one space: it begins and ends at the edge of a word, and where a pattern or a figure
    allows white space it allows any amount of it, so the length of the blank does not matter.
    """
    for pattern in MASKS:
        text = F.regexp_replace(text, pattern, " ")
    return text


def masked_figures(text: Column) -> Column:
    """Array of the figures of a masked text: as printed, number without sign and scale, percent, power of its scale word (null without) and negative."""

    def one(printed: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(printed, _NUMBER, 0), ",", "").try_cast(MONEY)
        power = F.when(F.lower(printed).rlike("(thousand|million|billion|trillion)s?$"), scale_of(printed))
        negative = printed.rlike(r"^\s*[-−]") | (printed.contains("(") & printed.contains(")"))
        return F.struct(F.trim(printed).alias("printed"), number.alias("number"), printed.contains("%").alias("percent"), power.alias("power"), negative.alias("negative"))

    return F.filter(F.transform(F.regexp_extract_all(masked(text), F.lit(MASKED_FIGURE), 0), one), lambda x: x["number"].isNotNull())


def object_interval(value: Column, power: Column) -> Column:
    """lo and hi of the values that a figure object's number stands for at its own digits; null below two significant digits."""
    plain = F.regexp_replace(F.regexp_replace(F.abs(value).cast(MONEY).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    places = F.length(F.regexp_extract(plain, r"\.(\d+)$", 1))
    trailing = F.when(places == 0, F.length(F.regexp_extract(plain, r"(0*)$", 1))).otherwise(F.lit(0))
    digits = F.length(F.regexp_replace(F.regexp_replace(F.when(places == 0, F.regexp_replace(plain, "0+$", "")).otherwise(plain), r"\.", ""), "^0+", ""))
    half = apply_scale(F.lit(0.5).cast(MONEY), power + trailing - places)
    mid = apply_scale(F.abs(value), power)
    return F.when(digits >= 2, F.struct((mid - half).cast(MONEY).alias("lo"), (mid + half).cast(MONEY).alias("hi")))


def is_nil(text: Column) -> Column:
    """Whether a cell is a lone dash of any length."""
    return F.coalesce(F.trim(text).rlike("^[-–—]$"), F.lit(False))


def tag_scale(scales: Column, monetary: Column) -> Column:
    """The one magnitude of 3, 6 and 9 that the tagged figures of a table have, null for none or several; any monetary figure of another scale vetoes it.

    scales and monetary are arrays of one entry per figure.
    """
    known = F.array_distinct(F.filter(scales, lambda s: s.isin(3, 6, 9)))
    veto = F.exists(F.arrays_zip(scales.alias("s"), monetary.alias("m")), lambda x: x["m"] & (x["s"] != known[0]))
    return F.when((F.size(known) == 1) & ~veto, known[0])


def caption_phrase_scale(caption: Column) -> Column:
    """Power of the last phrase of a caption that states a scale, in brackets or after "in", before any exception; null if it names two."""
    low = F.lower(caption)
    phrase = F.element_at(F.regexp_extract_all(low, F.lit(r"\([^()]*\b(?:thousand|million|billion)s?\b[^()]*\)|\bin\s+(?:thousand|million|billion)s?\b"), 0), -1)
    return F.when(F.size(F.regexp_extract_all(low, F.lit(r"\b(?:thousand|million|billion)s?\b"), 0)) > 0, caption_scale(F.when(phrase.isNotNull(), phrase)))


def seed_figures(text: Column) -> Column:
    """Figures of a quote without masks and scale words: printed, value with its sign, percent."""

    def one(printed: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(printed, _NUMBER, 0), ",", "").try_cast(MONEY)
        negative = printed.rlike(r"^\s*\$?\s*\(") & printed.contains(")") | printed.rlike(r"^[-−]")
        return F.struct(F.trim(printed).alias("printed"), F.when(negative, -number).otherwise(number).alias("value"), printed.contains("%").alias("percent"))

    return F.transform(F.regexp_extract_all(text, F.lit(rf"[-−]?\$?\s?\(?\$?(?:{_NUMBER})\)?\s?%?"), 0), one)


def printed_values(text: Column) -> Column:
    """Distinct magnitudes that a text prints, each at its own scale word."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(masked_figures(text), lambda x: ~x["percent"]), lambda x: F.when(x["power"].isNull(), x["number"]).otherwise(apply_scale(x["number"], x["power"])))))


def number_tokens(text: Column) -> Column:
    """Distinct number tokens as printed, trailing commas aside."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda x: F.regexp_replace(x, ",+$", ""))))


def decimals(printed: Column) -> Column:
    """Places that a figure is printed with."""
    return F.length(F.regexp_extract(printed, r"\d+(?:,\d{3})*\.(\d+)", 1))
