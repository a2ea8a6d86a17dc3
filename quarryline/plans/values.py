"""Queries of the scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import numbers, periods, text
from quarryline.operators import datasets
from quarryline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


@query(r"""WITH a AS (SELECT DISTINCT span_id, raw_text, regexp_replace(trim(raw_text), '^\$\s*', '') b FROM xbrl_spans),
c AS (SELECT *, regexp_matches(b, '^[(].*[)]$') neg, regexp_replace(regexp_replace(b, '[−–—]', '-', 'g'), '[$, ' || chr(160) || ']', '', 'g') n0 FROM a), e AS (SELECT *, CASE WHEN neg THEN regexp_replace(n0, '^[(]|[)]$', '', 'g') ELSE n0 END n FROM c)
SELECT span_id, CASE WHEN neg THEN -1 ELSE 1 END * CASE WHEN regexp_full_match(n, '[+-]?[0-9]+([.][0-9]*)?') THEN TRY_CAST(n AS DECIMAL(38,6)) END AS number FROM e""")
def spans_parsed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "xbrl_spans").select("span_id", "raw_text").distinct()
    return s.select("span_id", numbers.parse_number(F.col("raw_text")).alias("number"))


@query(r"""SELECT span_id, CAST(CAST(value AS DECIMAL(28,6)) / 1000 AS DECIMAL(28,3)) AS thousands FROM (SELECT DISTINCT span_id, value FROM xbrl_spans WHERE value % 1 = 0)""")
def spans_scaled(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "xbrl_spans").filter("value % 1 = 0").select("span_id", "value").distinct()
    return s.select("span_id", numbers.apply_scale(F.col("value"), F.lit(-3)).cast("decimal(28,3)").alias("thousands"))


@query("""SELECT span_id, CAST(CAST(value AS DECIMAL(28,6)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(38,9)) AS thousands FROM (SELECT DISTINCT span_id, value FROM xbrl_spans)""")
def spans_scaled_whole(spark: SparkSession, d: str) -> DataFrame:
    """All spans, also of fractional and null values."""
    s = table(spark, d, "xbrl_spans").select("span_id", "value").distinct()
    return s.select("span_id", numbers.apply_scale(F.col("value"), F.lit(-3), "decimal(38,9)").alias("thousands"))


@query(r"""WITH c AS (SELECT chunk_id, list_distinct(regexp_extract_all(split_part(lower(split_part(raw_text, chr(10), 1)), 'except', 1), '\b(thousand|million|billion|trillion)s?\b', 1)) w FROM chunks WHERE chunk_type = 'table')
SELECT chunk_id, CASE WHEN len(w) = 1 THEN CASE w[1] WHEN 'thousand' THEN 3 WHEN 'million' THEN 6 WHEN 'billion' THEN 9 ELSE 12 END END AS power FROM c""")
def captions_scaled(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("chunk_type = 'table'")
    return c.select("chunk_id", numbers.caption_scale(F.split("raw_text", "\n")[0]).alias("power"))


@query(r"""WITH f AS (SELECT chunk_id, regexp_extract_all(raw_text, '(?i)[-−]?[(]?\s?[$]?\s?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?[)]?\s?%?(?:\s?(?:thousand|million|billion|trillion)s?\b)?') x FROM chunks)
SELECT chunk_id, len(x) AS figures, len(list_filter(x, lambda s: contains(s, '%'))) AS percentages, len(list_filter(x, lambda s: regexp_matches(s, '(?i)(million|billion)'))) AS large FROM f""")
def chunk_figures(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "chunks").select("chunk_id", numbers.figures(F.col("raw_text")).alias("x"))
    n = lambda c: F.size(c).cast("long")
    return f.select("chunk_id", n("x").alias("figures"), n(F.filter("x", lambda s: s["percent"])).alias("percentages"), n(F.filter("x", lambda s: F.lower(s["printed"]).rlike("(million|billion)"))).alias("large"))


@query(r"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(question), '\d{1,3}(?:,\d{3})+(?:\.\d+)?|[a-z0-9]+(?:-[a-z0-9]+)*'), lambda t: replace(t, ',', '')), ' ') AS tokens FROM eval_items""")
def question_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.array_join(text.tokens(F.col("question")), " ").alias("tokens"))


@query(r"""SELECT concept, label, trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '[''’]', '', 'g'), '[^a-z0-9&() -]', ' ', 'g'), ' +', ' ', 'g')) AS phrase, count(*) AS facts FROM xbrl_facts WHERE label IS NOT NULL GROUP BY ALL""")
def label_phrases(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts").filter("label is not null")
    return f.groupBy("concept", "label").agg(F.count("*").alias("facts")).select("concept", "label", text.phrase_key(F.col("label")).alias("phrase"), "facts")


@query("""SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / nullif(length(text), 0), 0), 6) AS letters,
left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '[')), chr(10)), 400) AS excerpt FROM documents""")
def documents_excerpt(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", F.round(text.letters_share(F.col("text")), 6).alias("letters"), text.excerpt(F.col("text")).alias("excerpt"))


@query()
def documents_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"), (text.redacted(F.col("text")) != F.col("text")).alias("redacted"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(text, '(?i)(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.? \d{1,2}, \d{4}|\b\d{4}-\d{2}-\d{2}\b'),
lambda x: CAST(try_strptime(x, ['%B %d, %Y', '%b %d, %Y', '%Y-%m-%d']) AS DATE)), lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), ' ') AS dates FROM documents""")
def documents_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(periods.dates_in(F.col("text")), lambda x: x.cast("string")), " ").alias("dates"))


@query("""WITH f AS (SELECT *, period_end - period_start + 1 n, TRY_CAST(nullif(regexp_extract(upper(trim(fiscal_period)), '^Q([1-4])$', 1), '') AS INT) q, upper(trim(form_type)) ft FROM xbrl_facts),
k AS (SELECT *, (n BETWEEN 85 AND 98 OR n BETWEEN 175 AND 189 OR n BETWEEN 262 AND 280 OR n % 7 = 0) reg FROM f)
SELECT CASE WHEN period_start IS NULL THEN 'instant' WHEN starts_with(ft, '10-K') AND n BETWEEN 357 AND 371 THEN 'annual' WHEN starts_with(ft, '10-Q') AND reg AND n > 0 AND n <= 120 THEN 'quarter'
WHEN starts_with(ft, '10-Q') AND reg AND q IN (2, 3) AND n BETWEEN 80 * q AND 95 * q THEN 'ytd' ELSE 'other' END AS kind, q AS quarter, count(*) AS facts FROM k GROUP BY ALL""")
def facts_by_period_kind(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts").withColumn("quarter", periods.fiscal_quarter(F.col("fiscal_period")))
    return f.groupBy(periods.period_kind(F.col("period_start"), F.col("period_end"), F.trim("form_type"), F.col("quarter")).alias("kind"), "quarter").agg(F.count("*").alias("facts"))


@query("""SELECT DISTINCT accession, CASE WHEN fiscal_quarter IS NOT NULL THEN 'Q' || fiscal_quarter || ' ' ELSE '' END || 'FY' || fiscal_year AS period, CAST(filing_date - INTERVAL 5 YEAR AS DATE) AS since, strftime(filing_date, '%B %-d, %Y') AS filed FROM filings""")
def filings_periods(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filings")
    return f.select("accession", periods.period_label(F.col("fiscal_year"), F.col("fiscal_quarter")).alias("period"), periods.years_before(F.col("filing_date"), 5).alias("since"), periods.long_date(F.col("filing_date")).alias("filed")).distinct()


@query("""SELECT event_id, CASE WHEN json_keys(props) = ['k'] THEN CAST(props->>'k' AS INT) END AS k FROM events""")
def events_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.json_with_keys(F.col("props"), "k int", ["k"])["k"].alias("k"))


@query("""SELECT item_id, array_to_string(list_filter([CASE WHEN coalesce(length(trim(question)) > 0, false) THEN NULL ELSE 'question' END,
CASE WHEN coalesce(lower(difficulty) IN ('easy', 'medium', 'hard'), false) THEN NULL ELSE 'difficulty' END,
CASE WHEN coalesce(expected_abstain OR len(gold_evidence_sets) > 0, false) THEN NULL ELSE 'evidence' END,
CASE WHEN coalesce(expected_abstain OR reference_answer IS NOT NULL, false) THEN NULL ELSE 'answer' END], lambda x: x IS NOT NULL), ',') AS problems FROM eval_items""")
def items_checked(spark: SparkSession, d: str) -> DataFrame:
    checks = {
        "question": F.length(F.trim("question")) > 0,
        "difficulty": F.lower("difficulty").isin("easy", "medium", "hard"),
        "evidence": F.col("expected_abstain") | (F.size("gold_evidence_sets") > 0),
        "answer": F.col("expected_abstain") | F.col("reference_answer").isNotNull(),
    }
    return table(spark, d, "eval_items").select("item_id", F.array_join(datasets.problems(checks), ",").alias("problems"))


@query("""SELECT chunk_id, split_part(chunk_id, ':', 1) AS accession_of, split_part(chunk_id, ':', 1) = accession AS same, sha256(text) = content_hash AS hash_ok, contains(split_part(text, chr(10), 1), upper(trim(replace(ticker, '$', '')))) AS header_ok FROM chunks""")
def chunks_checked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select(
        "chunk_id", text.before_colon(F.col("chunk_id")).alias("accession_of"), (text.before_colon(F.col("chunk_id")) == F.col("accession")).alias("same"),
        (F.sha2("text", 256) == F.col("content_hash")).alias("hash_ok"), F.split("text", "\n")[0].contains(F.upper(F.trim(F.replace(F.col("ticker"), F.lit("$"), F.lit(""))))).alias("header_ok"),
    )
