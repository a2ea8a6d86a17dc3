"""Queries of retrieval, evaluation and data-set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.numbers import is_value, printed_interval
from quarryline.functions import periods
from quarryline.functions.text import tokens
from quarryline.operators import chunking, claims, datasets, documents, metrics, retrieval, scoring, verification
from quarryline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: items whose number is divisible by 20."""
    i = table(spark, d, "eval_items")
    return i.filter(F.regexp_extract("item_id", r"-(\d{8})-", 1).try_cast("long") % 20 == 0).withColumn("query_id", F.col("item_id"))


def _bm25(spark: SparkSession, d: str, text: str = "text", k: int = 10, allowed=None) -> DataFrame:
    return retrieval.bm25(table(spark, d, "chunks"), "chunk_id", text, questions(spark, d).select("query_id", "question"), k, allowed)


_TOK = r"list_transform(regexp_extract_all(lower({}), '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|[a-z0-9]+(?:-[a-z0-9]+)*'), lambda t: replace(t, ',', ''))"
_Q = "q AS (SELECT item_id query_id, question, gold_evidence_sets, source FROM eval_items WHERE TRY_CAST(regexp_extract(item_id, '-([0-9]{8})-', 1) AS BIGINT) % 20 = 0)"


def _bm25_sql(name: str, text: str, where: str = "", k: int = 10) -> str:
    return f"""{name}_t AS (SELECT chunk_id doc, {_TOK.format(text)} t FROM chunks), {name}_l AS (SELECT doc, len(t) len FROM {name}_t), {name}_s AS (SELECT count(*) n, avg(len) a FROM {name}_l),
{name}_p AS (SELECT doc, term, count(*) tf FROM (SELECT doc, unnest(t) term FROM {name}_t) GROUP BY ALL), {name}_d AS (SELECT term, count(*) df FROM {name}_p GROUP BY 1),
{name}_a AS (SELECT query_id, unnest(list_distinct({_TOK.format("question")})) term FROM q),
{name}_r AS (SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 9) score
 FROM {name}_a JOIN {name}_d USING (term) JOIN {name}_p USING (term) JOIN {name}_l USING (doc), {name}_s {where} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS BIGINT) AS "rank" FROM {name}_r WHERE score > 0) WHERE "rank" <= {k})"""


@query(f'WITH {_Q}, {_bm25_sql("b", "text")} SELECT query_id, doc, round(score, 6) AS score, "rank" FROM b')
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def _filters(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return questions(spark, d).select("query_id", none.alias("tickers"), F.array(F.lit("10-K")).alias("form_types"), F.array(F.lit(2020), F.lit(2021)).alias("fiscal_years"))


_WHERE = "WHERE doc IN (SELECT chunk_id FROM chunks WHERE form_type = '10-K' AND fiscal_year IN (2020, 2021))"


@query(f'WITH {_Q}, {_bm25_sql("b", "text", _WHERE)} SELECT query_id, doc, round(score, 6) AS score, "rank" FROM b')
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, allowed=retrieval.meets(table(spark, d, "chunks"), _filters(spark, d), "chunk_id")).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f'''WITH {_Q}, {_bm25_sql("b", "text", _WHERE)}, {_bm25_sql("c", "text")} SELECT query_id, doc, "rank", false AS fell_back FROM b
UNION ALL SELECT query_id, doc, "rank", true AS fell_back FROM c WHERE query_id NOT IN (SELECT query_id FROM b)''')
def filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    some = _bm25(spark, d, allowed=retrieval.meets(table(spark, d, "chunks"), _filters(spark, d), "chunk_id"))
    return retrieval.with_fallback(some, _bm25(spark, d)).select("query_id", "doc", "rank", "fell_back")


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    one = _bm25(spark, d).select("query_id", F.lit(1).alias("list_no"), F.lit(1.0).alias("weight"), "rank", "doc")
    return one.unionByName(_bm25(spark, d, "section_title").select("query_id", F.lit(2).alias("list_no"), F.lit(0.5).alias("weight"), "rank", "doc"))


_LISTS = f'''WITH {_Q}, {_bm25_sql("b", "text")}, {_bm25_sql("c", "section_title")}, l AS (SELECT query_id, 1 list_no, 1.0 weight, "rank", doc FROM b UNION ALL SELECT query_id, 2, 0.5, "rank", doc FROM c)'''


@query(f'''{_LISTS}, f AS (SELECT query_id, doc, round(sum(CAST(weight AS DOUBLE) / (60 + "rank")), 9) score, min("rank") place FROM l GROUP BY ALL)
SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, doc) AS BIGINT) AS "rank" FROM f''')
def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_two_lists(spark, d))


@query(f'''{_LISTS}, m AS (SELECT query_id, doc, min(("rank", list_no)) p FROM (SELECT query_id, doc, "rank", list_no FROM l) GROUP BY ALL)
SELECT query_id, doc, place FROM (SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, doc) AS BIGINT) place FROM m) WHERE place <= 8''')
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.interleave(_two_lists(spark, d), 8)


@query(f'''WITH {_Q}, {_bm25_sql("b", "text")}, r AS (SELECT query_id, doc, round(1 / (1 + exp(-(score - 20) / 5)), 9) p FROM b)
SELECT query_id, doc, p, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p DESC, doc) AS BIGINT) AS "rank" FROM r WHERE p >= 0.3 QUALIFY "rank" <= 5''')
def reranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_bm25(spark, d), (F.col("score") - 20) / 5, 0.3, 5).select("query_id", "doc", "p", "rank")


_COS = "round(1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 9)"


@query(f'''SELECT query_id, doc, round(d, 6) AS distance, "rank" FROM (SELECT a.vec_id query_id, b.vec_id doc, {_COS} d, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS}, b.vec_id) AS BIGINT) AS "rank"
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE "rank" <= 10''')
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.dense(e, "vec_id", "embedding", q).select("query_id", "doc", F.round("distance", 6).alias("distance"), "rank")


_DENSE_C = f"""e AS (SELECT query_id, CAST(c.embedding AS DOUBLE[]) v FROM (SELECT query_id, flatten(gold_evidence_sets)[1] chunk_id FROM q) JOIN chunks c USING (chunk_id) WHERE list_sum(list_transform(c.embedding, lambda x: abs(x))) > 0),
dd AS (SELECT query_id, chunk_id doc, round(1 - list_dot_product(v, CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(v, v) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) dist FROM e, chunks WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
dl AS (SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, doc) AS BIGINT) AS "rank" FROM dd QUALIFY "rank" <= 20)"""


@query(f'''WITH {_Q}, {_bm25_sql("b", "text", k=20)}, {_DENSE_C}, l AS (SELECT query_id, "rank", doc FROM dl UNION ALL SELECT query_id, "rank", doc FROM b),
f AS (SELECT query_id, doc, round(sum(1.0 / (60 + "rank")), 9) score, min("rank") place FROM l GROUP BY ALL)
SELECT query_id, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, doc) AS BIGINT) AS "rank" FROM f QUALIFY "rank" <= 10''')
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Dense search by the vector of the first gold chunk fused with BM25 of the question."""
    c = table(spark, d, "chunks")
    first = questions(spark, d).select("query_id", F.try_element_at(F.flatten("gold_evidence_sets"), F.lit(1)).alias("chunk_id"))
    vectors = first.join(c.select("chunk_id", F.col("embedding").alias("query_vector")), "chunk_id").select("query_id", "query_vector")
    both = retrieval.hybrid(retrieval.dense(c, "chunk_id", "embedding", vectors, 20), _bm25(spark, d, k=20), 10)
    return both.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f'''SELECT vec_id, twin, cosine FROM (SELECT b.vec_id, a.vec_id twin, round(1 - {_COS}, 6) cosine, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS}, a.vec_id) n
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE 1 - {_COS} > 0.45) WHERE n = 1''')
def earlier_twins(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.earlier_twins(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.45).withColumn("cosine", F.round("cosine", 6))


@query(f"""SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({_TOK.format("text")}) term FROM documents) GROUP BY ALL) GROUP BY 1""")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return metrics.ranking(q.select("query_id", F.col("gold_evidence_sets").alias("sets")), _bm25(spark, d), 5).join(q.select("query_id", "source"), "query_id")


_RANKED = f'''WITH {_Q}, {_bm25_sql("b", "text")}, l AS (SELECT query_id, list(doc ORDER BY "rank") docs FROM b GROUP BY 1),
i AS (SELECT query_id, source, list_filter(gold_evidence_sets, lambda s: len(s) > 0) sets, coalesce(docs, []) docs FROM q LEFT JOIN l USING (query_id)),
m AS (SELECT query_id, source, CASE WHEN len(sets) > 0 THEN len(list_filter(sets, lambda s: list_has_all(docs[:5], s))) > 0 END sufficient,
CASE WHEN len(sets) > 0 THEN round(list_max(list_transform(sets, lambda s: len(list_intersect(s, docs[:5])) / len(list_distinct(s)))), 6) END recall,
CASE WHEN len(sets) > 0 THEN round(len(list_intersect(list_distinct(flatten(sets)), docs[:5])) / 5, 6) END "precision",
CASE WHEN len(sets) > 0 THEN round(coalesce(1 / list_min(list_filter(list_transform(list_distinct(flatten(sets)), lambda x: list_position(docs, x)), lambda p: p > 0)), 0), 6) END mrr,
CASE WHEN len(sets) > 0 THEN round(list_max(list_transform(sets, lambda s: list_sum(list_transform(list_distinct(s), lambda x: CASE WHEN list_position(docs[:5], x) > 0 THEN 1 / log2(list_position(docs[:5], x) + 1) ELSE 0 END)) / list_sum(list_transform(range(1, least(len(list_distinct(s)), 5) + 1), lambda p: 1 / log2(p + 1))))), 6) END ndcg FROM i)'''


@query(f"{_RANKED} SELECT * FROM m")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(f"""{_RANKED} SELECT coalesce(source, 'all') AS source, count(sufficient) AS items, round(avg(CAST(sufficient AS INT)), 6) AS sufficiency, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
FROM m GROUP BY GROUPING SETS ((source), ())""")
def ranking_by_source(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return metrics.by_source(_ranked(spark, d), "source", {"items": F.count("sufficient"), "sufficiency": mean(F.col("sufficient").cast("int")), "recall": mean("recall"), "mrr": mean("mrr"), "ndcg": mean("ndcg")})


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Items with a verdict as an answerer without sources would have it: abstained without a reference answer."""
    return table(spark, d, "eval_items").withColumn("verdict", F.when(F.col("reference_answer").isNull(), "ABSTAIN").otherwise("PASS"))


@query("""WITH c AS (SELECT question_type, count(*) FILTER (WHERE e AND a) ra, count(*) FILTER (WHERE NOT e AND a) oa, count(*) FILTER (WHERE e AND NOT a) fa, count(*) FILTER (WHERE NOT e AND NOT a) aw
FROM (SELECT question_type, expected_abstain e, reference_answer IS NULL a FROM eval_items) WHERE e IS NOT NULL GROUP BY 1)
SELECT question_type, ra AS right_abstain, oa AS over_abstain, fa AS false_answer, aw AS answered, round(fa / nullif(fa + ra, 0), 6) AS false_answer_rate, round(oa / nullif(oa + aw, 0), 6) AS over_abstain_rate,
round(ra / nullif(ra + oa, 0), 6) AS "precision", round(ra / nullif(ra + fa, 0), 6) AS recall, round(2 * (ra / nullif(ra + oa, 0)) * (ra / nullif(ra + fa, 0)) / nullif(ra / nullif(ra + oa, 0) + ra / nullif(ra + fa, 0), 0), 6) AS f1 FROM c""")
def abstention(spark: SparkSession, d: str) -> DataFrame:
    return metrics.two_by_two(_verdicts(spark, d), ["question_type"])


@query("""WITH r AS (SELECT CAST(expected_abstain AS VARCHAR) x, CAST(reference_answer IS NULL AS VARCHAR) y FROM eval_items WHERE expected_abstain IS NOT NULL), n AS (SELECT count(*) n, count(*) FILTER (WHERE x = y) same FROM r),
c AS (SELECT sum(l * r) c FROM (SELECT x k, count(*) l FROM r GROUP BY 1) JOIN (SELECT y k, count(*) r FROM r GROUP BY 1) USING (k))
SELECT n, round(same / n, 6) AS agreement, round((same / n - c / (n * n)) / nullif(1 - c / (n * n), 0), 6) AS kappa FROM n, c""")
def label_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kappa(table(spark, d, "eval_items").withColumn("none", F.col("reference_answer").isNull()), "expected_abstain", "none")


_SCORED = "SELECT length(question) s, expected_abstain y FROM eval_items WHERE expected_abstain IS NOT NULL AND question IS NOT NULL"


@query(f"""WITH r AS ({_SCORED}), c AS (SELECT s, count(*) FILTER (WHERE y) p, count(*) FILTER (WHERE NOT y) q FROM r GROUP BY 1), w AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM c)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, round(sum(p * (b + q / 2)) / nullif(sum(p) * sum(q), 0), 6) AS auc FROM w""")
def score_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(table(spark, d, "eval_items").withColumn("s", F.length("question").cast("long")), "s", "expected_abstain")


@query(f"""WITH r AS ({_SCORED}), c AS (SELECT s, count(*) FILTER (WHERE y) p, count(*) FILTER (WHERE NOT y) q FROM r GROUP BY 1),
w AS (SELECT s, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () - sum(q) OVER (ORDER BY s DESC) / sum(q) OVER (), 6) j FROM c) SELECT s AS cut, j AS youden FROM w ORDER BY j DESC, s LIMIT 1""")
def youden_cut(spark: SparkSession, d: str) -> DataFrame:
    return metrics.youden(table(spark, d, "eval_items").withColumn("s", F.length("question").cast("long")), "s", "expected_abstain")


@query("""WITH p(model, a, b) AS (VALUES ('view', 3.0, 15.0), ('click', 0.5, 1.5), ('signup', 1.0, 5.0)), c AS (SELECT user_id, event_type model, event_id % 1000 i, CASE WHEN event_type <> 'error' THEN event_id % 77 END o FROM events),
x AS (SELECT user_id, i, o, (i * a + o * b) / 1e6 k FROM c LEFT JOIN p USING (model))
SELECT user_id, count(*) AS calls, CAST(coalesce(sum(i), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(o), 0) AS BIGINT) AS tokens_out, CASE WHEN count(*) = count(k) THEN round(CAST(sum(k) AS DOUBLE), 6) END AS cost FROM x GROUP BY 1""")
def cost_per_user(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("user_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), F.when(F.col("event_type") != "error", F.col("event_id") % 77).alias("tokens_out"))
    prices = spark.createDataFrame([("view", 3.0, 15.0), ("click", 0.5, 1.5), ("signup", 1.0, 5.0)], "model string, price_in double, price_out double")
    return metrics.cost(calls, prices, "user_id")


@query(f'''WITH {_Q}, {_bm25_sql("b", "text")}, {_bm25_sql("c", "raw_text")}, x AS (SELECT query_id, list(doc ORDER BY "rank") a FROM b GROUP BY 1), y AS (SELECT query_id, list(doc ORDER BY "rank") b FROM c GROUP BY 1)
SELECT query_id, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a = b THEN 'identical' WHEN list_sort(a) = list_sort(b) THEN 'reordered' ELSE 'different' END AS kind,
CAST(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS BIGINT) AS first_difference FROM x FULL JOIN y USING (query_id)''')
def run_consistency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.consistency(_bm25(spark, d), _bm25(spark, d, "raw_text"))


@query(f"""{_RANKED}, v AS (SELECT coalesce(source, 'all') scope, round(avg(recall), 6) recall, round(avg(mrr), 6) mrr FROM m GROUP BY GROUPING SETS ((source), ())),
t(scope, metric, rule, tolerance) AS (VALUES ('all', 'recall', 'min', 0.2), ('all', 'mrr', 'max', 0.9), ('llm_seeded', 'recall', 'min', 0.8), ('none', 'recall', 'min', 0.1)),
u AS (SELECT scope, 'recall' metric, recall AS "value" FROM v UNION ALL SELECT scope, 'mrr', mrr FROM v)
SELECT scope, metric, rule, CAST(tolerance AS DOUBLE) AS tolerance, "value", CASE WHEN "value" IS NULL THEN 'pending' WHEN (rule = 'min' AND "value" >= tolerance) OR (rule = 'max' AND "value" <= tolerance) THEN 'pass' ELSE 'fail' END AS status FROM t LEFT JOIN u USING (scope, metric)""")
def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.by_source(_ranked(spark, d), "source", {"recall": F.round(F.avg("recall"), 6), "mrr": F.round(F.avg("mrr"), 6)})
    values = m.select(F.col("source").alias("scope"), F.explode(F.create_map(F.lit("recall"), "recall", F.lit("mrr"), "mrr")).alias("metric", "value")).withColumn("baseline", F.lit(None).cast("double"))
    t = [("all", "recall", "min", 0.2), ("all", "mrr", "max", 0.9), ("llm_seeded", "recall", "min", 0.8), ("none", "recall", "min", 0.1)]
    return metrics.gate(values, spark.createDataFrame(t, "scope string, metric string, rule string, tolerance double"))


@query("""WITH c AS (SELECT upper(trim(replace(ticker, '$', ''))) AS ticker, count(*) AS n FROM chunks GROUP BY 1), t AS (SELECT sum(n) t FROM c), q AS (SELECT ticker, n, (n * 100) // t f, (n * 100) % t r FROM c, t)
SELECT ticker, n AS "count", CAST(least(n, f + CASE WHEN row_number() OVER (ORDER BY r DESC, n DESC, ticker) <= 100 - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END) AS BIGINT) AS places FROM q""")
def places_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "chunks").groupBy(F.upper(F.trim(F.replace(F.col("ticker"), F.lit("$"), F.lit("")))).alias("ticker")).agg(F.count("*").alias("count"))
    return datasets.apportioned(counts, "ticker", 100)


@query("""WITH c AS (SELECT source, count(*) n FROM documents GROUP BY 1), t AS (SELECT sum(n) t FROM c), q AS (SELECT source, n, (n * 60) // t f, (n * 60) % t r FROM c, t),
p AS (SELECT source, least(n, f + CASE WHEN row_number() OVER (ORDER BY r DESC, n DESC, source) <= 60 - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END) places FROM q),
d AS (SELECT source, doc_id, places, row_number() OVER (PARTITION BY source ORDER BY md5('s1:' || doc_id), doc_id) pos FROM documents JOIN p USING (source))
SELECT source, doc_id, CAST(pos AS BIGINT) AS position, pos > places AS reserve FROM d WHERE pos <= places * 2""")
def stratified_draw(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("source", "doc_id")
    places = datasets.apportioned(x.groupBy("source").agg(F.count("*").alias("count")), "source", 60).select("source", "places")
    return datasets.drawn(x, ["source"], places, "doc_id", "s1", 2).select("source", "doc_id", "position", "reserve")


def _gold_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts").select("fact_id", "accession", "cik", "concept", "period_start", "period_end", "value", "is_comparative")
    s = table(spark, d, "xbrl_spans").select("accession", "concept", "value", "span_id").filter("value is not null").distinct().groupBy("accession", "concept", "value").agg(F.count("*").alias("gold"))
    return f.join(s, ["accession", "concept", "value"], "left").fillna(0, ["gold"])


@query("""WITH s AS (SELECT accession, concept, value, count(*) g FROM (SELECT DISTINCT accession, concept, value, span_id FROM xbrl_spans WHERE value IS NOT NULL) GROUP BY ALL),
f AS (SELECT x.*, coalesce(g, 0) g FROM xbrl_facts x LEFT JOIN s USING (accession, concept, value))
SELECT cik, concept, period_start, period_end, count(*) AS facts, CASE WHEN min(value) <> max(value) THEN 'value_differs' WHEN bool_and(g = 0) THEN 'no_gold' WHEN bool_or(g > 3) THEN 'many' WHEN bool_or(g = 0) THEN 'mixed'
WHEN bool_and(coalesce(is_comparative, false)) THEN 'comparative_only' ELSE 'eligible' END AS category FROM f GROUP BY ALL""")
def key_categories(spark: SparkSession, d: str) -> DataFrame:
    return datasets.key_category(_gold_counts(spark, d), ["cik", "concept", "period_start", "period_end"])


@query("""WITH o AS (SELECT cik, concept, fiscal_year, min(value) v FROM xbrl_facts WHERE value IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY ALL HAVING min(value) = max(value))
SELECT a.cik, a.concept, a.fiscal_year, a.v AS earlier, b.v AS later FROM o a JOIN o b ON a.cik = b.cik AND a.concept = b.concept AND b.fiscal_year = a.fiscal_year + 1""")
def period_pairs(spark: SparkSession, d: str) -> DataFrame:
    return datasets.period_pairs(table(spark, d, "xbrl_facts"), 1)


@query("""WITH s AS (SELECT DISTINCT accession, concept, value v, chunk_id FROM xbrl_spans) SELECT fact_id, coalesce(array_to_string(list_sort(list(DISTINCT chunk_id) FILTER (WHERE v = value AND chunk_id IS NOT NULL)), ','), '') AS gold, count(v) AS spans
FROM xbrl_facts LEFT JOIN s USING (accession, concept) GROUP BY 1""")
def gold_selection(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "xbrl_facts").select("fact_id", F.col("accession").alias("accession_key"), F.col("concept").alias("concept_key"), F.col("value").alias("amount"))
    s = table(spark, d, "xbrl_spans").select(F.col("accession").alias("accession_key"), F.col("concept").alias("concept_key"), F.col("value").alias("amount"), "chunk_id").distinct()
    return datasets.gold(f, s)


@query("""WITH n AS (SELECT *, TRY_CAST(regexp_extract(item_id, '-([0-9]{8})-', 1) AS BIGINT) no FROM eval_items), e AS (SELECT event_id % 1000 no, event_id, CASE event_type WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'edit' ELSE 'accept' END dec, 'edited ' || event_id ans FROM events),
l AS (SELECT no, arg_max(dec, event_id) dec, arg_max(ans, event_id) ans FROM e GROUP BY 1)
SELECT item_id, CASE WHEN dec = 'edit' THEN ans ELSE reference_answer END AS reference_answer, l.no IS NOT NULL AS reviewed FROM n LEFT JOIN l USING (no) WHERE dec IS DISTINCT FROM 'reject'""")
def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.regexp_extract("item_id", r"-(\d{8})-", 1).try_cast("long").alias("item_id"), "reference_answer")
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "edit").otherwise("accept")
    said = e.select((F.col("event_id") % 1000).alias("item_id"), F.col("event_id").alias("seq"), kind.alias("decision"), F.concat(F.lit("edited "), F.col("event_id").cast("string")).alias("answer"))
    return datasets.latest_decisions(items, said).select(F.col("id").alias("item_id"), "reference_answer", "reviewed")


@query("""SELECT item_id, CASE WHEN length(question) < 40 THEN 'short' WHEN NOT regexp_matches(question, '[?]$') THEN 'no_question' WHEN regexp_matches(lower(question), '\\b(it|they|this)\\b') THEN 'pronoun' END AS reason FROM eval_items""")
def seed_filters(spark: SparkSession, d: str) -> DataFrame:
    checks = {"short": F.length("question") >= 40, "no_question": F.col("question").rlike("[?]$"), "pronoun": ~F.lower("question").rlike(r"\b(it|they|this)\b")}
    return table(spark, d, "eval_items").select("item_id", datasets.first_failure(checks).alias("reason"))


@query("""WITH f AS (SELECT DISTINCT accession, cik, period_end FROM filings), z AS (SELECT DISTINCT span_id, accession, concept, value, regexp_replace(raw_text, '[^0-9.]', '', 'g') dg, coalesce(scale, 0) sc FROM xbrl_spans WHERE value IS NOT NULL),
y AS (SELECT *, length(regexp_extract(dg, '[.]([0-9]+)$', 1)) pl FROM z), w AS (SELECT *, length(regexp_replace(CASE WHEN pl > 0 THEN replace(dg, '.', '') ELSE regexp_replace(dg, '0+$', '') END, '^0+', '')) sg, TRY_CAST(dg AS DECIMAL(38,6)) dv FROM y),
i AS (SELECT span_id, accession, concept, value, CASE WHEN sg >= 2 THEN CAST(dv * CAST(power(10, sc) AS DECIMAL(18,2)) - power(10, sc - pl) / 2 AS DOUBLE) END lo, CASE WHEN sg >= 2 THEN CAST(dv * CAST(power(10, sc) AS DECIMAL(18,2)) + power(10, sc - pl) / 2 AS DOUBLE) END hi FROM w),
c AS (SELECT span_id claim_id, accession, cik, concept, period_end, value, lo, hi FROM i JOIN f USING (accession)),
j AS (SELECT c.*, x.period_end = c.period_end t, x.accession = c.accession ci, abs(abs(c.value) - abs(x.value)) * 100 <= abs(x.value) * 0.5 cl, x.value xv, abs(x.value) >= c.lo AND abs(x.value) < c.hi ins FROM c LEFT JOIN (SELECT * FROM xbrl_facts WHERE value IS NOT NULL) x ON x.cik = c.cik AND x.concept = c.concept),
g AS (SELECT claim_id, coalesce(bool_or(t AND ci AND cl), false) v, coalesce(bool_or(t AND ci), false) c, coalesce(bool_or(t AND NOT ci AND cl), false) r, coalesce(bool_or(t AND ci AND ins), false) ir, coalesce(bool_or(NOT t AND ci AND cl), false) e, min(CASE WHEN t AND ci THEN xv END) fact_value FROM j GROUP BY 1)
SELECT claim_id, s AS status, e AND s = 'contradiction' AS elsewhere, fact_value FROM (SELECT *, CASE WHEN v THEN 'verified' WHEN NOT c THEN 'no_fact' WHEN r THEN 'restatement' WHEN ir THEN 'rounded' ELSE 'contradiction' END s FROM g)""")
def claims_classified(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filings").select("accession", "cik", "period_end").distinct()
    s = table(spark, d, "xbrl_spans").filter("value is not null").select(F.col("span_id").alias("claim_id"), "accession", "concept", "value", "raw_text", "scale").distinct()
    span = printed_interval(F.col("raw_text"), F.coalesce("scale", F.lit(0)))
    rows = s.withColumns({"lo": span["lo"], "hi": span["hi"]}).drop("raw_text", "scale").distinct()
    return verification.classified(rows.join(f, "accession"), table(spark, d, "xbrl_facts"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Reference answers as answers of one claim per sentence, citing the gold chunks, with the figure object of their fact."""
    i = table(spark, d, "eval_items").filter("reference_answer is not null")
    f = table(spark, d, "xbrl_facts").filter("value is not null").select(F.col("fact_id").alias("xbrl_fact_id"), F.struct(
        F.col("value"), F.lit("ones").alias("unit"), F.when(F.upper(F.trim("unit")).startswith("USD"), "USD").alias("currency"),
        F.concat_ws(" ", F.when(F.col("fiscal_period") != "FY", F.col("fiscal_period")), F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))).alias("period"), F.col("label").alias("concept")).alias("f"))
    said = F.split("reference_answer", r"(?<=[.!?])\s+(?=[A-Z0-9])")
    rows = i.join(f, "xbrl_fact_id", "left").select(F.col("item_id").alias("answer_id"), "question", F.array_distinct(F.flatten("gold_evidence_sets")).alias("citations"), "f", F.posexplode(said).alias("claim_id", "text"))
    return rows.withColumn("figure", F.when(F.col("claim_id") == 0, F.col("f")).cast(claims.FIGURE)).drop("f")


def _sets(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    cited = rows.select(F.explode("citations").alias("chunk_id")).distinct()
    zero = table(spark, d, "xbrl_spans").filter("value = 0 and chunk_id is not null").select(F.col("chunk_id").alias("key"))
    return claims.text_sets(table(spark, d, "chunks").join(cited, "chunk_id", "left_semi"), "chunk_id", "text", zero)


@query()
def answers_grounded(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    sets = _sets(spark, d, rows)
    return claims.with_unit(claims.grounded(rows.drop("question"), sets), sets).select("answer_id", "claim_id", "numbers_grounded", "numbers_derived", "unit_ok", "period_stated", "citations_supporting", F.size("numbers").alias("numbers"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    sets = _sets(spark, d, rows)
    facts = table(spark, d, "xbrl_facts")
    phrases = claims.concept_tags(facts.select(F.col("label").alias("phrase"), F.col("concept").alias("tag"), F.lit(None).cast("string").alias("variant")).distinct())
    filings = table(spark, d, "filings").filter("cik is not null").select("accession", "cik", "period_end", "fiscal_year", "fiscal_quarter").distinct()
    own = rows.select("answer_id", "claim_id", F.explode("citations").alias("key")).select("answer_id", "claim_id", F.substring_index("key", ":", 1).alias("accession")).distinct()
    company = own.join(filings.select("accession", "cik").distinct(), "accession").select("answer_id", "claim_id", "cik").distinct()
    stated = rows.filter("figure.period is not null").select("answer_id", "claim_id", F.col("figure.period").alias("period")).join(company, ["answer_id", "claim_id"])
    ends = periods.period_ends(stated, filings)
    checks = claims.fact_checks(rows, phrases, filings, facts, ends, 0.5)
    given = rows.select("answer_id", F.explode("citations").alias("key")).distinct()
    names = table(spark, d, "companies").select("cik", F.explode(F.array("name", "ticker")).alias("name"))
    # stored entailment: the share of a claim's words that the text holds stands for a model's score
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    scored = rows.select("answer_id", "claim_id", "text", F.explode("citations").alias("key")).join(table(spark, d, "chunks").select(F.col("chunk_id").alias("key"), F.col("text").alias("t")), "key")
    entail = scored.select("answer_id", "claim_id", "key", F.coalesce(F.try_divide(F.size(F.array_intersect(words("text"), words("t"))), F.size(words("text"))), F.lit(0.0)).alias("entail"))
    return claims.checked(rows.drop("question"), rows.select("answer_id", "question").distinct(), given, sets, checks, entail, filings, names)


@query()
def answers_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every check of every claim, none of them a constant."""
    return _checked(spark, d).select("answer_id", "claim_id", "citation_valid", "entity_ok", "numbers_grounded", "unit_ok", "period_stated", "status", "period_ok", "contradiction", "entail")


@query()
def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verification.verdicts(_checked(spark, d), 0.5)


@query()
def claims_failed(spark: SparkSession, d: str) -> DataFrame:
    return claims.failed_checks(_checked(spark, d), verification.supported(0.5))


@query()
def answers_scored(spark: SparkSession, d: str) -> DataFrame:
    """Numeric scores of an answerer that quotes the first cited chunk."""
    i = table(spark, d, "eval_items").select("item_id", "reference_answer", F.try_element_at(F.flatten("gold_evidence_sets"), F.lit(1)).alias("chunk_id"))
    c = table(spark, d, "chunks").select("chunk_id", F.col("raw_text").alias("answer"))
    return scoring.numeric_scores(i.join(c, "chunk_id", "left"))


@query("""WITH s AS (SELECT DISTINCT span_id, chunk_id, char_start f, char_end t FROM xbrl_spans WHERE chunk_id IS NOT NULL), x AS (SELECT span_id, c.raw_text r, f - c.char_start a, t - c.char_start b FROM s JOIN chunks c USING (chunk_id)),
y AS (SELECT span_id, regexp_replace(rtrim(substring(r, greatest(1, a - 2), least(a, 3))), '[ $]+$', '') p, ltrim(substring(r, b + 1, 3)) q FROM x WHERE a >= 0)
SELECT CASE WHEN ends_with(p, '(') AND starts_with(q, ')') THEN 'brackets' WHEN regexp_matches(p, '[-−–]$') THEN 'minus' ELSE 'plain' END AS sign, count(*) AS spans FROM y GROUP BY 1""")
def signs_around_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "xbrl_spans").filter("chunk_id is not null").select("span_id", "chunk_id", F.col("char_start").alias("f"), F.col("char_end").alias("t")).distinct()
    x = s.join(table(spark, d, "chunks").select("chunk_id", "raw_text", "char_start"), "chunk_id").select("raw_text", (F.col("f") - F.col("char_start")).alias("a"), (F.col("t") - F.col("char_start")).alias("b"))
    return x.filter("a >= 0").groupBy(scoring.printed_sign(F.col("raw_text"), F.col("a"), F.col("b")).alias("sign")).agg(F.count("*").alias("spans"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as pages of markup: prose lines as paragraphs, table rows as rows."""
    c = table(spark, d, "chunks").select("chunk_id", F.split("raw_text", "\n").alias("lines"))
    esc = lambda x: F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;")
    row = lambda x: F.concat(F.lit("<table><tr><td>"), F.regexp_replace(F.regexp_replace(esc(x), r"^\|\s*|\s*\|\s*$", ""), r"\s*\|\s*", "</td><td>"), F.lit("</td></tr></table>"))
    body = F.array_join(F.transform("lines", lambda x: F.when(x.startswith("|"), row(x)).otherwise(F.concat(F.lit("<p>"), esc(x), F.lit("</p>")))), "\n")
    return c.select("chunk_id", F.concat(F.lit("<html><head><title>x</title></head><body>"), body, F.lit("</body></html>")).alias("html"))


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = documents.blocks(documents.parsed(_pages(spark, d), "chunk_id", "html"))
    return b.groupBy("key", "kind").agg(F.count("*").alias("blocks"), F.count_if(F.coalesce(documents.data_table(F.col("rows")), F.lit(False))).alias("data_rows"))


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return documents.sections(documents.blocks(documents.parsed(_pages(spark, d), "chunk_id", "html")))


@query()
def documents_chunked(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit("all").alias("section"), F.posexplode(F.split("text", r"\n+|(?<=[.!?])\s+")).alias("unit_no", "text"))
    return chunking.chunks(x, 60, 12)


@query(r"""WITH r AS (SELECT chunk_id, unnest(string_split(raw_text, chr(10))) l FROM chunks WHERE chunk_type = 'table'), c AS (SELECT chunk_id, list_transform(string_split(regexp_replace(regexp_replace(trim(l), '^[|]', ''), '[|]$', ''), '|'), lambda x: trim(x)) cells FROM r WHERE starts_with(l, '|'))
SELECT chunk_id, bool_or(len(list_filter(cells, lambda x: regexp_full_match(replace(replace(x, ' ', ''), chr(160), ''), '[$]?[(]?[-−–—]?[$]?[0-9][0-9,]*([.][0-9]*)?[)]?%?'))) >= 2) AS is_data, count(*) AS "rows" FROM c GROUP BY 1""")
def tables_classified(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chunks").filter("chunk_type = 'table'").select("chunk_id", F.explode(F.split("raw_text", "\n")).alias("l")).filter("startswith(l, '|')")
    cells = F.transform(F.split(F.regexp_replace(F.trim("l"), r"^\||\|$", ""), r"\|"), F.trim)
    return r.select("chunk_id", (F.size(F.filter(cells, is_value)) >= 2).alias("v")).groupBy("chunk_id").agg(F.bool_or("v").alias("is_data"), F.count("*").alias("rows"))


@query(f"""SELECT chunk_id, len(list_distinct({_TOK.format("text")})) AS distinct_tokens FROM chunks""")
def chunk_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("distinct_tokens"))
