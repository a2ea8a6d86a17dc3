"""Queries of the relational operators on facts, filings, chunks, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.keys import form_key
from quarryline.functions.text import digit_key
from quarryline.operators import documents as docs_
from quarryline.operators import metrics, relational
from quarryline.sources.filings import content_key
from quarryline.sources.tables import table
from quarryline.streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function of session and folder, and its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


FACT = ["cik", "concept", "period_start", "period_end", "unit"]
KEY = ["accession", "concept", "period_start", "period_end"]


@query("""SELECT cik, concept, period_start, period_end, unit, count(DISTINCT value) AS "values", count(DISTINCT accession) AS sources, min(value) AS lowest, max(value) AS highest
FROM xbrl_facts GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def facts_restated(spark: SparkSession, d: str) -> DataFrame:
    return relational.conflicts(table(spark, d, "xbrl_facts"), FACT, "value", "accession")


@query("""SELECT cik, concept, period_end, count(DISTINCT accession) AS filings FROM xbrl_facts GROUP BY ALL HAVING count(DISTINCT accession) > 1
ORDER BY filings DESC, cik, concept, period_end LIMIT 50""")
def facts_key_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Top report: the fifty keys in most filings."""
    per = table(spark, d, "xbrl_facts").select("cik", "concept", "period_end", "accession").distinct()
    counted = per.groupBy("cik", "concept", "period_end").agg(F.count("accession").alias("filings")).filter("filings > 1")
    return counted.orderBy(F.desc("filings"), "cik", "concept", "period_end").limit(50)


@query("""SELECT ticker, regexp_replace(regexp_replace(upper(form_type), '^\\s*FORM\\b', ''), '[^A-Z0-9/]', '', 'g') AS form, fiscal_year, count(*) AS filings, max(filing_date) AS latest
FROM filings JOIN companies USING (cik) GROUP BY ALL""")
def filings_by_company(spark: SparkSession, d: str) -> DataFrame:
    f, c = table(spark, d, "filings"), table(spark, d, "companies").select("cik", "ticker")
    return f.join(c, "cik").groupBy("ticker", form_key("form_type").alias("form"), "fiscal_year").agg(F.count("*").alias("filings"), F.max("filing_date").alias("latest"))


@query("""SELECT sector, chunk_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks
JOIN (SELECT DISTINCT accession, cik FROM filings) USING (accession, cik) JOIN companies USING (cik) GROUP BY ALL""")
def chunks_by_sector(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filings").select("accession", "cik").distinct()
    c = table(spark, d, "chunks").select("accession", "cik", "chunk_type", "token_count")
    return c.join(f, ["accession", "cik"]).join(table(spark, d, "companies").select("cik", "sector"), "cik").groupBy("sector", "chunk_type").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("tokens"))


@query("""SELECT f.accession, count(c.chunk_id) AS chunks FROM (SELECT DISTINCT accession FROM filings) f LEFT JOIN chunks c ON c.accession = f.accession GROUP BY f.accession""")
def filings_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "chunks").groupBy("accession").agg(F.count("chunk_id").alias("chunks"))
    return table(spark, d, "filings").select("accession").distinct().join(per, "accession", "left").fillna(0, ["chunks"])


@query("""SELECT parse_status, count(*) AS filings, count(parse_score) AS scored, count(*) FILTER (WHERE parse_error IS NOT NULL) AS failed,
count(*) FILTER (WHERE parse_status IS DISTINCT FROM 'parsed') AS waiting, round(avg(CAST(parse_score AS DOUBLE)), 6) AS mean_score FROM filings GROUP BY 1""")
def filings_by_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").groupBy("parse_status").agg(
        F.count("*").alias("filings"), F.count("parse_score").alias("scored"), F.count_if(F.col("parse_error").isNotNull()).alias("failed"),
        F.count_if(~F.col("parse_status").eqNullSafe("parsed")).alias("waiting"), F.round(F.avg(F.col("parse_score").cast("double")), 6).alias("mean_score"),
    )


@query("""WITH s AS (SELECT DISTINCT accession, span_id, char_start f, char_end t FROM xbrl_spans),
h AS (SELECT s.*, c.chunk_id id, row_number() OVER (PARTITION BY s.accession, span_id, f, t ORDER BY c.char_start, c.chunk_id) n, count(*) OVER (PARTITION BY s.accession, span_id, f, t) k
 FROM s JOIN chunks c ON c.accession = s.accession AND c.char_start <= f AND t <= c.char_end)
SELECT s.accession, s.span_id, h.id AS chunk_id, coalesce(k, 0) AS containers FROM s LEFT JOIN h ON h.accession = s.accession AND h.span_id = s.span_id AND h.f = s.f AND h.t = s.t AND h.n = 1""")
def spans_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    return relational.contained(table(spark, d, "xbrl_spans"), table(spark, d, "chunks"), "accession", "span_id", "chunk_id")


@query("""SELECT chunk_id, coalesce(last_value(CASE WHEN chunk_type = 'table' THEN chunk_id END IGNORE NULLS) OVER w, 'none') AS table_before,
coalesce(lead(chunk_type) OVER (PARTITION BY accession ORDER BY char_start, chunk_id) = 'table', false) AS table_next
FROM chunks WINDOW w AS (PARTITION BY accession ORDER BY char_start, chunk_id ROWS UNBOUNDED PRECEDING)""")
def chunks_table_before(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "accession", "char_start", "chunk_type")
    before = relational.last_before(c, ["accession"], ["char_start", "chunk_id"], F.when(F.col("chunk_type") == "table", F.col("chunk_id")), F.lit("none"))
    after = F.lead("chunk_type").over(Window.partitionBy("accession").orderBy("char_start", "chunk_id"))
    return c.select("chunk_id", before.alias("table_before"), F.coalesce(after == "table", F.lit(False)).alias("table_next"))


@query("""WITH a AS (SELECT accession, char_start, char_end, CASE WHEN char_start < max(char_end) OVER (PARTITION BY accession ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM chunks),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY accession ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) i FROM a)
SELECT accession, min(char_start) AS char_start, max(char_end) AS char_end, count(*) AS ranges FROM b GROUP BY accession, i""")
def chunk_ranges_merged(spark: SparkSession, d: str) -> DataFrame:
    return relational.islands(table(spark, d, "chunks").select("accession", "char_start", "char_end"), ["accession"], "char_start", "char_end")


def _feed(spark: SparkSession, d: str, feed: str) -> DataFrame:
    """Facts of a feed, one per key: that with the smallest id."""
    f = table(spark, d, "xbrl_facts").filter(F.col("feed") == feed)
    return f.groupBy(*KEY).agg(F.min_by(F.struct("fact_id", "value"), "fact_id").alias("r")).select(*KEY, "r.fact_id", "r.value")


_ONE = "SELECT accession, concept, period_start, period_end, min(fact_id) fact_id, arg_min(value, fact_id) v0, (list(value ORDER BY fact_id))[1] AS value FROM xbrl_facts WHERE feed = '{}' GROUP BY ALL"
_SAME = "a.accession = b.accession AND a.concept = b.concept AND a.period_start IS NOT DISTINCT FROM b.period_start AND a.period_end = b.period_end"


@query(f"""WITH a AS ({_ONE.format("companyfacts")}), b AS ({_ONE.format("inline")}) SELECT fact_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_SAME})""")
def facts_inserted(spark: SparkSession, d: str) -> DataFrame:
    return relational.inserted(_feed(spark, d, "companyfacts"), _feed(spark, d, "inline"), KEY).select("fact_id")


@query(f"""WITH a AS ({_ONE.format("companyfacts")}), b AS ({_ONE.format("vendor")})
SELECT fact_id, value FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME}) UNION ALL SELECT fact_id, value FROM b""")
def facts_upserted(spark: SparkSession, d: str) -> DataFrame:
    return relational.upserted(_feed(spark, d, "companyfacts"), _feed(spark, d, "vendor"), KEY).select("fact_id", "value")


@query(f"""WITH a AS ({_ONE.format("companyfacts")}), b AS ({_ONE.format("vendor")})
SELECT fact_id FROM a WHERE accession NOT IN (SELECT accession FROM b) UNION ALL SELECT fact_id FROM b""")
def facts_replaced(spark: SparkSession, d: str) -> DataFrame:
    return relational.replaced(_feed(spark, d, "companyfacts"), _feed(spark, d, "vendor"), "accession").select("fact_id")


@query(f"""WITH a AS ({_ONE.format("companyfacts")}), b AS ({_ONE.format("inline")}) SELECT a.accession, a.concept, a.period_start, a.period_end, a.value AS stored, b.value AS source
FROM a JOIN b ON {_SAME} WHERE a.value IS DISTINCT FROM b.value""")
def facts_drifted(spark: SparkSession, d: str) -> DataFrame:
    return relational.drifted(_feed(spark, d, "companyfacts"), _feed(spark, d, "inline"), KEY, "value")


@query("""SELECT CASE WHEN f.accession IS NULL THEN 'waiting' ELSE 'linked' END AS state, count(*) AS facts FROM xbrl_facts x
LEFT JOIN (SELECT DISTINCT accession FROM filings WHERE parse_status = 'parsed') f ON f.accession = x.accession GROUP BY 1""")
def facts_promoted(spark: SparkSession, d: str) -> DataFrame:
    linked, waiting = relational.promoted(table(spark, d, "xbrl_facts").select("accession"), table(spark, d, "filings").filter("parse_status = 'parsed'"), "accession")
    return linked.select(F.lit("linked").alias("state")).unionByName(waiting.select(F.lit("waiting").alias("state"))).groupBy("state").agg(F.count("*").alias("facts"))


@query("""SELECT event_type, count(value) AS n, (list_sort(list(value)))[CAST(count(value) // 2 AS INT) + 1] AS p50,
(list_sort(list(value)))[CAST(floor(0.95 * (count(value) - 1)) AS INT) + 1] AS p95, max(value) AS "most" FROM events GROUP BY 1""")
def events_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return relational.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p50": "n div 2", "p95": "cast(floor(0.95 * (n - 1)) as bigint)", "most": "n - 1"})


@query("""WITH p AS (SELECT event_type, (list_sort(list(value)))[CAST(count(value) // 2 AS INT) + 1] p50 FROM events GROUP BY 1)
SELECT event_type, count(*) AS slow FROM events JOIN p USING (event_type) WHERE value > 3 * p50 GROUP BY 1""")
def events_slow(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value")
    p = relational.nearest_rank(e, ["event_type"], "value", {"p50": "n div 2"})
    return e.join(p, "event_type").filter("value > 3 * p50").groupBy("event_type").agg(F.count("*").alias("slow"))


@query("""SELECT coalesce(event_type, 'all') AS event_type, count(*) AS events, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def events_by_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_source(table(spark, d, "events"), "event_type", {"events": F.count("*"), "mean": F.round(F.avg("value"), 6), "users": F.count_distinct("user_id")})


@query("""SELECT regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS source, count(*) FILTER (WHERE l = 'en') AS en, count(*) FILTER (WHERE l = 'fr') AS fr, count(*) FILTER (WHERE l = 'de') AS de, count(*) FILTER (WHERE l = 'es') AS es
FROM (SELECT *, lower(left(lang, 2)) l FROM documents) GROUP BY 1""")
def documents_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.regexp_replace(F.lower("source"), "[^a-z0-9]", "").alias("source"), F.lower(F.substring("lang", 1, 2)).alias("l"))
    return x.groupBy("source").pivot("l", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def documents_copies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query()
def corpus_key(spark: SparkSession, d: str) -> DataFrame:
    return content_key(table(spark, d, "chunks").select("chunk_id", "text"))


@query("""SELECT source, doc_id, CAST(n AS BIGINT) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY published_on DESC NULLS LAST, doc_id) n FROM documents) WHERE n <= 3""")
def documents_latest(spark: SparkSession, d: str) -> DataFrame:
    """Top report: the three latest documents of each spelling of a source."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("published_on"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")


@query(r"""WITH l AS (SELECT accession, trim(regexp_replace(regexp_replace(unnest(string_split(raw_text, chr(10))), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS line_key FROM chunks)
SELECT accession, line_key, count(*) AS repeats FROM l WHERE line_key <> '' GROUP BY ALL HAVING count(*) >= 3 AND NOT regexp_matches(line_key, '[.:]$')""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "chunks").select("accession", F.explode(F.split("raw_text", "\n")).alias("line"))
    return docs_.repeated_lines(lines, "accession", "line")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed(table(spark, d, "events"), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * o AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events, range(2) r(o) GROUP BY ALL""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed(table(spark, d, "events"), "1 hour", "30 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END n FROM events),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) i FROM a)
SELECT user_id, min(ts) AS session_start, count(*) AS events FROM b GROUP BY user_id, i""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"), "30 minutes").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query(r"""SELECT concept, count(*) AS spans, count(DISTINCT digit_form) AS forms FROM (SELECT concept, trim(regexp_replace(regexp_replace(raw_text, '\d+', '#', 'g'), '\s+', ' ', 'g')) digit_form FROM xbrl_spans) GROUP BY 1""")
def spans_by_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "xbrl_spans").groupBy("concept").agg(F.count("*").alias("spans"), F.count_distinct(digit_key(F.col("raw_text"))).alias("forms"))
