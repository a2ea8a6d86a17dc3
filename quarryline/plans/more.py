"""Queries of constraints, loads, pools, draws and reports, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import SCALE_EXCEPTION, stems
from quarryline.operators import datasets, documents, metrics, pools, relational, reports, retrieval, scoring, tables
from quarryline.plans import answers
from quarryline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


_SPAN_CLASS = """WITH s AS (SELECT DISTINCT accession, span_id, char_start f, char_end t FROM xbrl_spans WHERE accession IS NOT NULL), o AS (SELECT accession, chunk_id, char_start cf, char_end ct FROM chunks),
j AS (SELECT s.*, chunk_id, cf, cf <= f AND t <= ct h, cf < t AND f < ct x FROM s LEFT JOIN o USING (accession)), b AS (SELECT accession, min(cf) first FROM o GROUP BY 1),
g AS (SELECT accession, span_id, f, t, arg_min(CASE WHEN h THEN chunk_id END, CASE WHEN h THEN (cf, chunk_id) END) chunk_id, count(DISTINCT CASE WHEN h THEN chunk_id END) n, count(*) FILTER (WHERE x AND NOT h) c FROM j GROUP BY ALL),
k AS (SELECT accession, span_id, chunk_id, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'overlap' WHEN c > 0 THEN 'split' WHEN t <= first THEN 'before_first' ELSE 'unresolved' END AS class FROM g LEFT JOIN b USING (accession))"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return relational.interval_classes(table(spark, d, "xbrl_spans").filter("accession is not null"), table(spark, d, "chunks"), "accession", "span_id", "chunk_id")


@query(f"{_SPAN_CLASS} SELECT * FROM k")
def span_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


@query(f"""{_SPAN_CLASS}, r AS (SELECT count(*) n, count(*) FILTER (WHERE class IN ('unique', 'overlap')) ok, count(*) FILTER (WHERE class = 'before_first') bf FROM k)
SELECT n AS intervals, ok AS resolved, round(coalesce(ok / nullif(n, 0), 0), 6) AS rate, round(coalesce(ok / nullif(n - bf, 0), 0), 6) AS rate_after_first FROM r""")
def span_resolution(spark: SparkSession, d: str) -> DataFrame:
    return relational.resolution(_classes(spark, d))


@query("""WITH c AS (SELECT concept, min(label) l FROM xbrl_facts WHERE label IS NOT NULL GROUP BY 1) SELECT fact_id, coalesce(label, l) AS label FROM xbrl_facts LEFT JOIN c USING (concept)""")
def labels_filled(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts").select("fact_id", "concept", "label")
    cache = f.filter("label is not null").groupBy("concept").agg(F.min("label").alias("label"))
    return relational.filled_from(f, cache, ["concept"], "label").select("fact_id", "label")


@query("""SELECT 'order' AS "check", count(*) FILTER (WHERE char_end < char_start) AS "rows" FROM chunks UNION ALL SELECT 'tokens', count(*) FILTER (WHERE token_count <= 0) FROM chunks
UNION ALL SELECT 'unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) n FROM chunks GROUP BY accession, char_start) UNION ALL SELECT 'foreign key', count(*) FROM chunks WHERE accession IS NOT NULL AND accession NOT IN (SELECT accession FROM filings WHERE accession IS NOT NULL)""")
def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = {"order": F.col("char_end") >= F.col("char_start"), "tokens": F.col("token_count") > 0}
    return relational.violations(table(spark, d, "chunks"), checks, ["accession", "char_start"], (table(spark, d, "filings"), "accession"))


@query("""SELECT span_id, accession, CASE WHEN chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_type = 'table') THEN chunk_id END AS chunk_id FROM (SELECT DISTINCT span_id, accession, chunk_id FROM xbrl_spans)""")
def spans_set_null(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "xbrl_spans").select("span_id", "accession", "chunk_id").distinct()
    return relational.cascaded(s, table(spark, d, "chunks").filter("chunk_type = 'table'"), "chunk_id", "null").select("span_id", "accession", "chunk_id")


@query("""SELECT chunk_id FROM chunks WHERE accession IS NULL OR accession IN (SELECT accession FROM filings WHERE form_type = '10-K')""")
def chunks_cascaded(spark: SparkSession, d: str) -> DataFrame:
    return relational.cascaded(table(spark, d, "chunks"), table(spark, d, "filings").filter("form_type = '10-K'"), "accession").select("chunk_id")


@query("""WITH e AS (SELECT DISTINCT cik, concept, period_start, period_end, unit FROM xbrl_facts WHERE feed = 'companyfacts'), n AS (SELECT DISTINCT cik, concept, period_start, period_end, unit FROM xbrl_facts WHERE feed <> 'companyfacts'),
a AS (SELECT count(*) FILTER (WHERE e.cik IS NULL) i FROM n LEFT JOIN e ON n.cik = e.cik AND n.concept = e.concept AND n.period_start IS NOT DISTINCT FROM e.period_start AND n.period_end = e.period_end AND n.unit IS NOT DISTINCT FROM e.unit),
o AS (SELECT count(*) o FROM xbrl_facts WHERE feed <> 'companyfacts') SELECT o AS offered, i AS inserted, o - i AS present FROM o, a""")
def facts_load(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts")
    return relational.load_counts(f.filter("feed = 'companyfacts'"), f.filter("feed <> 'companyfacts'"), ["cik", "concept", "period_start", "period_end", "unit"])


@query("""SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY cik ORDER BY char_start, chunk_id) n FROM chunks) WHERE (n - 1) % 7 = 0""")
def every_seventh_chunk(spark: SparkSession, d: str) -> DataFrame:
    return relational.every_nth(table(spark, d, "chunks"), ["char_start", "chunk_id"], 7, ["cik"]).select("chunk_id")


@query("""WITH p AS (SELECT accession, max(period_end) e FROM filings GROUP BY 1) SELECT fact_id, period_end < e AS comparative FROM xbrl_facts JOIN p USING (accession)""")
def facts_comparative(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "filings").groupBy("accession").agg(F.max("period_end").alias("e"))
    return table(spark, d, "xbrl_facts").join(p, "accession").select("fact_id", (F.col("period_end") < F.col("e")).alias("comparative"))


@query("""WITH w(item, tag, variant) AS (VALUES ('sales', 'us-gaap:Revenues', 'us-gaap:NetRevenue'), ('assets', 'us-gaap:Assets', 'us-gaap:TotalAssets'), ('debt', 'us-gaap:LongTermDebt', NULL)), h AS (SELECT DISTINCT cik, concept FROM xbrl_facts),
n AS (SELECT cik, item, tag t FROM w JOIN h ON concept = tag), v AS (SELECT cik, item, variant t FROM w JOIN h ON concept = variant) SELECT cik, item, coalesce(n.t, v.t) AS tag FROM n FULL JOIN v USING (cik, item)""")
def tags_preferred(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame([("sales", "us-gaap:Revenues", "us-gaap:NetRevenue"), ("assets", "us-gaap:Assets", "us-gaap:TotalAssets"), ("debt", "us-gaap:LongTermDebt", None)], "item string, tag string, variant string")
    return relational.preferred(w, table(spark, d, "xbrl_facts"))


@query("""SELECT CASE unit WHEN 'USD' THEN 'monetary' WHEN 'USD/shares' THEN 'per_share' WHEN 'shares' THEN 'shares' ELSE 'none' END AS kind, count(*) AS "rows" FROM xbrl_facts GROUP BY 1""")
def facts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    from quarryline.operators.claims import fact_kind

    return reports.counts(table(spark, d, "xbrl_facts").select(fact_kind(F.col("unit")).alias("kind")), "kind")


@query(rf"""SELECT chunk_id FROM chunks WHERE unit_scale IS NOT NULL AND regexp_matches(text, '{SCALE_EXCEPTION}')""")
def scale_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter(F.col("unit_scale").isNotNull() & F.col("text").rlike(SCALE_EXCEPTION)).select("chunk_id")


@query("""SELECT chunk_id FROM chunks WHERE (fiscal_year = 2020 AND fiscal_quarter = 2) OR fiscal_year = 2018""")
def chunks_in_periods(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    none = F.array().cast("array<string>")
    periods = F.expr("array(named_struct('fy', 2020, 'fq', 2), named_struct('fy', 2018, 'fq', cast(null as int)))")
    f = spark.range(1).select(F.lit("q").alias("query_id"), none.alias("tickers"), none.alias("form_types"), F.array().cast("array<int>").alias("fiscal_years"), periods.alias("periods"))
    return retrieval.meets(c, f, "chunk_id")(c.select(F.lit("q").alias("query_id"), F.col("chunk_id").alias("doc"))).select(F.col("doc").alias("chunk_id"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts").select("fact_id", "cik", "accession", "concept", "label", "value", "unit", "period_start", "period_end", "fiscal_year", "fiscal_period", "form_type", "is_comparative")
    return pools.pool(pools.gold_facts(f, table(spark, d, "xbrl_spans")))


_POOL = """WITH g AS (SELECT accession, concept, value, list_sort(list(DISTINCT chunk_id)) c FROM xbrl_spans WHERE value IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL), f AS (SELECT x.*, coalesce(c, []) golds FROM xbrl_facts x LEFT JOIN g USING (accession, concept, value)),
k AS (SELECT cik, concept, period_start, period_end, min(value) lo, max(value) hi, bool_or(len(golds) = 0) z, bool_or(len(golds) > 3) m, bool_and(coalesce(is_comparative, false)) cmp, arg_min(fact_id, CASE WHEN NOT coalesce(is_comparative, false) THEN (accession, fact_id) END) fact_id,
min(CASE WHEN NOT coalesce(is_comparative, false) THEN accession END) own_accession, count(DISTINCT CASE WHEN NOT coalesce(is_comparative, false) THEN accession END) <> 1 AS ambiguous, list_sort(list_distinct(flatten(list(golds)))) chunks FROM f GROUP BY ALL),
p AS (SELECT * FROM k WHERE lo IS NOT DISTINCT FROM hi AND NOT z AND NOT m AND NOT cmp)"""


@query(f"{_POOL} SELECT cik, concept, period_start, period_end, fact_id, own_accession, ambiguous, array_to_string(chunks, ',') AS chunks FROM p")
def pool_eligible(spark: SparkSession, d: str) -> DataFrame:
    p = _pool(spark, d)
    return p.select("cik", "concept", "period_start", "period_end", "fact_id", "own_accession", "ambiguous", F.array_join(F.array_sort(pools.all_chunks(F.col("evidence"))), ",").alias("chunks"))


@query(f"{_POOL} SELECT fact_id, unnest(list_transform(chunks, lambda c: [c])) AS evidence FROM p")
def pool_evidence_sets(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).select("fact_id", F.explode(pools.evidence_sets(F.col("evidence"))).alias("evidence"))


@query()
def pool_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pools.pairs(_pool(spark, d).filter("not ambiguous"), [1, 2])
    return p.select("cik", "concept", "kind", "gap", F.col("earlier.fact_id").alias("earlier"), F.col("later.fact_id").alias("later"))


@query()
def comparison_items(spark: SparkSession, d: str) -> DataFrame:
    return pools.comparison_items(pools.pairs(_pool(spark, d).filter("not ambiguous"), [1]))


@query()
def fact_items(spark: SparkSession, d: str) -> DataFrame:
    keys = pools.slots(_pool(spark, d).filter("not ambiguous")).join(table(spark, d, "companies").select("cik", F.col("name").alias("company")), "cik")
    return pools.items(keys, [("a", "any", "What was {label} of {company} for {period}?"), ("b", "filing", "According to its filing, what did {company} report as {label} for {dates}?")], "t1", "v1")


@query("""WITH d AS (SELECT ticker, form_type, doc_id, row_number() OVER (PARTITION BY ticker, form_type ORDER BY md5('r1:' || doc_id), doc_id) turn, md5('r1:strata:' || concat_ws(':', ticker, form_type)) s FROM documents WHERE ticker IS NOT NULL AND form_type IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY turn, s, form_type) pos, count(*) OVER (PARTITION BY ticker) there FROM d) SELECT ticker, form_type, doc_id, pos AS position, there < 5 AS short FROM o WHERE pos <= 5""")
def round_robin_draw(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter("ticker is not null and form_type is not null").select("ticker", "form_type", "doc_id")
    places = x.select("ticker").distinct().withColumn("places", F.lit(5))
    return pools.round_robin(x, "ticker", ["form_type"], ["doc_id"], places, "r1").select("ticker", "form_type", "doc_id", "position", "short")


@query("""WITH s AS (SELECT source, count(*) size FROM eval_items WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT sum(size) t FROM s), q AS (SELECT source, floor(size * 36.0 / t) f, round(CAST(size AS DOUBLE) * 36 / t - floor(CAST(size AS DOUBLE) * 36 / t), 9) r FROM s, t),
p AS (SELECT source, f + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 36 - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END places FROM q),
w AS (SELECT source, item_id, places, row_number() OVER (PARTITION BY source ORDER BY md5('f1:' || item_id), item_id) pos FROM eval_items JOIN p USING (source)) SELECT source, item_id, pos AS position FROM w WHERE pos <= places""")
def fast_draw(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "eval_items").filter("source is not null").select("source", "item_id")
    return pools.quota_draw(i, "source", "item_id", 40, "f1", planned=4).select("source", "item_id", "position")


_OUT = "CASE WHEN expected_abstain AND reference_answer IS NULL THEN 'right' WHEN expected_abstain THEN 'wrong' WHEN reference_answer IS NULL THEN 'abstained' ELSE 'answered' END"


@query(f"""SELECT coalesce(source, 'none') AS source, coalesce(lower(difficulty), 'none') AS verdict, {_OUT} AS outcome, count(*) AS "rows" FROM eval_items GROUP BY ALL""")
def verdict_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts(table(spark, d, "eval_items").select("source", F.lower("difficulty").alias("verdict"), F.expr(_OUT).alias("outcome")), "source", "verdict", "outcome")


@query("""SELECT source, question_type, count(*) FILTER (WHERE lower(difficulty) = 'easy') AS easy, count(*) FILTER (WHERE lower(difficulty) = 'medium') AS medium, count(*) FILTER (WHERE lower(difficulty) = 'hard') AS hard FROM eval_items GROUP BY ALL""")
def type_matrix(spark: SparkSession, d: str) -> DataFrame:
    return reports.matrix(table(spark, d, "eval_items").withColumn("difficulty", F.lower("difficulty")), ["source", "question_type"], "difficulty", ["easy", "medium", "hard"])


@query("""SELECT CASE WHEN n_chars < 100 THEN '< 100' WHEN n_chars < 1000 THEN '100 to 1000' WHEN n_chars < 10000 THEN '1000 to 10000' WHEN n_chars >= 10000 THEN '>= 10000' END AS band, count(*) AS documents FROM documents GROUP BY 1""")
def lengths_banded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(pools.band(F.col("n_chars"), [100, 1000, 10000]).alias("band")).agg(F.count("*").alias("documents"))


@query("""WITH b AS (SELECT CAST(token_count AS DOUBLE) a, CAST(len(list_filter(string_split_regex(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+'), lambda t: t <> '')) AS DOUBLE) b FROM chunks)
SELECT count(*) AS items, count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS equal, count(*) FILTER (WHERE a > b) AS lost, count(*) FILTER (WHERE a < b) AS won, round(avg(b - a), 6) AS mean_change FROM b""")
def token_count_spread(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    now = c.select("chunk_id", F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")).alias("token_count"))
    return reports.spread(c.select("chunk_id", "token_count"), now, "chunk_id", "token_count")


_RATES = """v AS (SELECT coalesce(source, 'all') scope, round(avg(CAST(reference_answer IS NULL AS INT)), 6) abstained, round(avg(CAST(reviewed_by_human AS INT)), 6) reviewed FROM eval_items GROUP BY GROUPING SETS ((source), ())),
u AS (SELECT scope, 'abstained' metric, abstained AS "value" FROM v UNION ALL SELECT scope, 'reviewed', reviewed FROM v),
t(scope, metric, rule, tolerance) AS (VALUES ('all', 'abstained', 'max', 0.5), ('all', 'reviewed', 'min', 0.1), ('handwritten', 'abstained', 'max', 0.4), ('handwritten', 'reviewed', 'min', 0.1), ('handwritten', 'other', 'min', 0.9), ('llm_seeded', 'reviewed', 'min', 0.2), ('all', 'reviewed', 'delta', -0.05)),
g AS (SELECT t.scope, t.metric, t.rule, CAST(t.tolerance AS DOUBLE) tolerance, "value", CASE WHEN "value" IS NULL THEN 'pending' WHEN rule = 'min' THEN CASE WHEN "value" >= tolerance THEN 'pass' ELSE 'fail' END WHEN rule = 'max' THEN CASE WHEN "value" <= tolerance THEN 'pass' ELSE 'fail' END
WHEN round("value" - 0.2, 9) >= tolerance THEN 'pass' ELSE 'fail' END AS status FROM t LEFT JOIN u ON t.scope = u.scope AND t.metric = u.metric)"""


def _gate(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "eval_items").withColumns({"a": F.col("reference_answer").isNull().cast("int"), "r": F.col("reviewed_by_human").cast("int")})
    m = metrics.by_source(i.filter("source is not null").select("source", "a", "r"), "source", {"abstained": F.round(F.avg("a"), 6), "reviewed": F.round(F.avg("r"), 6)})
    values = m.select(F.col("source").alias("scope"), F.explode(F.create_map(F.lit("abstained"), "abstained", F.lit("reviewed"), "reviewed")).alias("metric", "value")).withColumn("baseline", F.lit(0.2))
    t = spark.createDataFrame([("abstained", "max", 0.5), ("reviewed", "min", 0.1)], "metric string, rule string, tolerance double")
    own = spark.createDataFrame([("abstained", 0.4), ("other", 0.9)], "metric string, tolerance double")
    each = spark.createDataFrame([("llm_seeded", "reviewed", 0.2)], "scope string, metric string, tolerance double")
    moved = spark.createDataFrame([("reviewed", -0.05)], "metric string, tolerance double")
    return metrics.gate(values, reports.threshold_rows(t, own, each, moved))


@query(f"""WITH {_RATES} SELECT scope, metric, rule, tolerance, "value", status FROM g""".replace("FROM eval_items GROUP", "FROM eval_items WHERE source IS NOT NULL GROUP"))
def gate_with_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d)


@query(f"""WITH {_RATES} SELECT count(*) AS rules, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, bool_and(status = 'pass') AS passes FROM g""".replace("FROM eval_items GROUP", "FROM eval_items WHERE source IS NOT NULL GROUP"))
def gate_passed(spark: SparkSession, d: str) -> DataFrame:
    return reports.passed(_gate(spark, d))


@query("""WITH c AS (SELECT ticker, count(*) chunks, count(DISTINCT accession) filings FROM chunks WHERE ticker IS NOT NULL GROUP BY 1) SELECT ticker, '{"chunks":' || chunks || ',"filings":' || filings || '}' AS payload FROM c""")
def corpus_payload(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("ticker is not null").groupBy("ticker").agg(F.count("*").alias("chunks"), F.count_distinct("accession").alias("filings"))
    return reports.payload(c, "ticker")


@query("""WITH r AS (SELECT accession, parser_version draw_hash FROM filings WHERE accession IS NOT NULL), d AS (SELECT DISTINCT accession FROM chunk_stats WHERE accession IS NOT NULL)
SELECT accession, 'duplicate' AS problem FROM r GROUP BY 1 HAVING count(*) > 1 UNION SELECT accession, 'foreign' FROM r WHERE accession NOT IN (SELECT accession FROM d)
UNION SELECT accession, 'other draw' FROM r WHERE draw_hash IS DISTINCT FROM (SELECT min(draw_hash) FROM r) UNION SELECT accession, 'missing' FROM d WHERE accession NOT IN (SELECT accession FROM r)""")
def record_problems(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "filings").filter("accession is not null").select("accession", F.col("parser_version").alias("draw_hash"))
    return pools.record_problems(r, table(spark, d, "chunk_stats").filter("accession is not null").select("accession").distinct(), "accession", r.agg(F.min("draw_hash")).first()[0])


@query(r"""WITH r AS (SELECT source, CASE WHEN length(question) < 40 THEN 'short' WHEN NOT regexp_matches(question, '[?]$') THEN 'no_question' END reason FROM eval_items) SELECT source, coalesce(reason, 'kept') AS stage, count(*) AS "rows" FROM r GROUP BY ALL""")
def seed_stages(spark: SparkSession, d: str) -> DataFrame:
    checks = {"short": F.length("question") >= 40, "no_question": F.col("question").rlike("[?]$")}
    i = table(spark, d, "eval_items").filter("question is not null or question is null").select("source", F.when(F.col("question").isNotNull(), datasets.first_failure(checks)).alias("reason"))
    return pools.stage_counts(i, ["source"], "reason")


_NUM = r"list_distinct(list_transform(regexp_extract_all({}, '\d[\d,]*(?:\.\d+)?'), lambda x: regexp_replace(x, ',+$', '')))"


@query(f"""WITH s AS (SELECT DISTINCT span_id, accession, chunk_id, unnest({_NUM.format("raw_text")}) token FROM xbrl_spans WHERE chunk_id IS NOT NULL), t AS (SELECT accession, chunk_id other, unnest({_NUM.format("text")}) token FROM chunks)
SELECT DISTINCT CAST(span_id AS VARCHAR) AS item_id, other FROM s JOIN t USING (accession, token) WHERE other <> chunk_id""")
def spans_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    from quarryline.functions.numbers import number_tokens

    s = table(spark, d, "xbrl_spans").filter("chunk_id is not null").select(F.col("span_id").cast("string").alias("item_id"), "accession", "chunk_id", F.explode(number_tokens(F.col("raw_text"))).alias("token")).distinct()
    return pools.figure_elsewhere(s, table(spark, d, "chunks"))


@query()
def numeric_report(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an answerer that quotes the first cited chunk, per source."""
    i = table(spark, d, "eval_items").withColumn("chunk_id", F.try_element_at(F.flatten("gold_evidence_sets"), F.lit(1)))
    said = i.join(table(spark, d, "chunks").select("chunk_id", F.col("raw_text").alias("answer")), "chunk_id", "left")
    rows = reports.references(said).withColumns({"abstained": F.col("answer").isNull(), "figures": F.array().cast("array<struct<value: decimal(38,6), unit: string>>")})
    return reports.numeric_report(reports.item_scores(rows))


@query()
def claim_rates(spark: SparkSession, d: str) -> DataFrame:
    from quarryline.operators import verification

    c = answers._checked(spark, d)
    kept = verification.supported(0.5)
    return reports.claim_report(c.withColumns({"supported": kept, "kept": kept, "answered": F.lit(True)}), [])


@query()
def misses_diagnosed(spark: SparkSession, d: str) -> DataFrame:
    """First cause of each question whose evidence is not wholly among the first texts."""
    r = answers._ranked(spark, d).withColumn("missed", ~F.coalesce("sufficient", F.lit(True)))
    return retrieval.miss_causes(r, {"no gold retrieved": F.col("recall") == 0, "part of the gold": F.col("recall") < 1, "ranked low": F.col("mrr") < 0.2}).select("query_id", "missed", "cause")


@query()
def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    """Texts by the share of a question's stems that they hold: the full-text way of sparse search."""
    c = retrieval.spread(table(spark, d, "chunks").select(F.col("chunk_id").alias("doc"), "text"))
    return retrieval.covering(c.select("doc", F.array_distinct(stems(F.col("text"))).alias("words")), answers.questions(spark, d).select("query_id", stems(F.col("question")).alias("words")))


@query()
def tables_extracted(spark: SparkSession, d: str) -> DataFrame:
    t = tables.extracted(documents.parsed(answers._pages(spark, d), "chunk_id", "html"))
    return t.select("key", "block_no", "header_rows", "title", "currency", "unit_scale", F.size("body").alias("rows"))


@query()
def printed_intervals(spark: SparkSession, d: str) -> DataFrame:
    from quarryline.functions.numbers import printed_interval

    s = table(spark, d, "xbrl_spans").select("span_id", "raw_text", "scale").distinct()
    return s.select("span_id", printed_interval(F.col("raw_text"), F.coalesce("scale", F.lit(0))).alias("i")).select("span_id", "i.lo", "i.hi")


@query("""SELECT CASE WHEN n <= 10 THEN '1-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE 'none' END AS class, count(*) AS chunks FROM (SELECT row_number() OVER (PARTITION BY cik ORDER BY chunk_id) n FROM chunks) GROUP BY 1""")
def rank_classes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("cik").orderBy("chunk_id"))
    return table(spark, d, "chunks").select(n.alias("n")).groupBy(scoring.rank_class(F.col("n")).alias("class")).agg(F.count("*").alias("chunks"))
