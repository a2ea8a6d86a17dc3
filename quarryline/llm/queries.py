"""Queries of problems 1 to 5 and 7 to 10 by name, and the same queries in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import boilerplate, mixing, neardup, neighbours, packing, residue, sampling, splitting, survivors
from quarryline.sources.tables import table


#: Words of a piece and similarity that problem 4 states for these data.
P4 = (2, 0.7)


def _records(chunks: DataFrame, items: DataFrame) -> DataFrame:
    return neardup.texts_of((chunks.filter("chunk_type = 'prose'"), "chunk", "chunk_id", "text"), (items, "question", "item_id", "question"))


def _on(*names: str):
    """A query that gets its tables by name."""

    def wrap(f):
        def query(spark: SparkSession, d: str) -> DataFrame:
            return f(*(table(spark, d, n) for n in names))

        query.__doc__ = f.__doc__
        return query

    return wrap


QUERIES = {
    "p1_found": _on("chunks")(lambda c: splitting.pieces(c, "chunk_id", "text").filter("piece_no = 1").select("chunk_id")),
    "p1_pieces": _on("chunks")(lambda c: splitting.pieces(c, "chunk_id", "text")),
    "p2_found": _on("chunks")(boilerplate.furniture),
    "p2_lines": _on("chunks")(boilerplate.lines),
    "p2_body": _on("chunks")(boilerplate.body),
    "p3_found": _on("chunks", "sample_targets")(lambda c, t: sampling.report(c, t).filter("rows_missing > 0").select("target_id")),
    "p3_sample": _on("chunks", "sample_targets")(sampling.sample),
    "p3_report": _on("chunks", "sample_targets")(sampling.report),
    "p4_found": _on("chunks", "eval_items")(lambda c, e: neardup.pairs(_records(c, e), *P4).withColumnRenamed("kind", "record_kind")),
    "p4_groups": _on("chunks", "eval_items")(lambda c, e: neardup.groups(_records(c, e), *P4).withColumnRenamed("kind", "record_kind")),
    "p5_found": _on("chunks")(lambda c: neighbours.close_pairs(c, "chunk_id", "embedding", 5, 0.85).withColumnsRenamed({"a": "chunk_id_a", "b": "chunk_id_b"})),
    "p5_neighbours": _on("chunks")(lambda c: neighbours.neighbours(c, "chunk_id", "embedding", 5)),
    "p7_found": _on("xbrl_facts")(survivors.found),
    "p7_survivors": _on("xbrl_facts")(survivors.survivors),
    "p7_undated": _on("xbrl_facts")(lambda f: survivors.survivors(survivors.without_times(f))),
    "p7_order_learned": _on("xbrl_facts")(survivors.order_learned),
    "p8_found": _on("documents")(lambda d: packing.cut(packing.pack(packing.pieces(d)))),
    "p8_containers": _on("documents")(lambda d: packing.pack(packing.pieces(d))),
    "p8_fill": _on("documents")(lambda d: packing.fill(packing.pack(packing.pieces(d)))),
    "p8_contents": _on("documents")(lambda d: packing.contents(packing.pack(packing.pieces(d)), d)),
    "p9_found": _on("documents", "mix_targets")(lambda d, t: mixing.report(mixing.sizes(d), t).filter("short").select("source")),
    "p9_mix": _on("documents", "mix_targets")(lambda d, t: mixing.mix(mixing.sizes(d), t)),
    "p9_report": _on("documents", "mix_targets")(lambda d, t: mixing.report(mixing.sizes(d), t)),
}

QUERIES |= {
    "p10_found": _on("documents")(lambda d: residue.residue(d).filter("coverage > 0").select("doc_id")),
    "p10_residue": _on("documents")(residue.residue),
    "p10_clean": _on("documents")(residue.clean),
}

_TICKER = "regexp_replace(regexp_replace(upper(ticker), '^.*:', ''), '[^A-Z0-9]', '', 'g')"
_FORM = "regexp_replace(regexp_replace(upper(form_type), '^\\s*FORM\\b', ''), '[^A-Z0-9/]', '', 'g')"
_ITEM = "regexp_replace(regexp_replace(upper(item_code), '\\b(PART|ITEM)\\b', '', 'g'), '[^A-Z0-9]', '', 'g')"
_CONCEPT = r"regexp_replace(regexp_replace(lower(trim(concept)), '^([a-z][a-z0-9-]*[:/]|(us-gaap|dei|srt|ifrs-full)[_ ])', ''), '[^a-z0-9]', '', 'g')"
_ACCESSION = "lpad(ltrim(regexp_replace(accession, '[^0-9]', '', 'g'), '0'), 18, '0')"

SQL = {
    "p1_found": "SELECT chunk_id FROM chunks WHERE len(list_filter(string_split_regex(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+'), lambda t: t <> '')) > 512",
    "p3_found": f"""
WITH c AS (SELECT {_TICKER} t, {_FORM} f, {_ITEM} i, count(*) n FROM chunks GROUP BY ALL), s AS (SELECT count(*) // 20 AS size FROM chunks)
SELECT target_id FROM (SELECT target_id, {_TICKER} t, {_FORM} f, {_ITEM} i, greatest(min_rows, ceil(round(target_share * (SELECT size FROM s), 6))) need FROM sample_targets)
LEFT JOIN c USING (t, f, i) WHERE coalesce(n, 0) < need""",
    "p7_found": f"""
WITH r AS (SELECT *, {_ACCESSION} a, {_CONCEPT} c, CASE feed WHEN 'companyfacts' THEN 0 WHEN 'inline' THEN 1 WHEN 'vendor' THEN 2 ELSE 3 END p FROM xbrl_facts),
v AS (SELECT *, row_number() OVER (PARTITION BY a, c, period_start, period_end, value IS NULL ORDER BY p, ingested_at DESC, fact_id) rv,
 row_number() OVER (PARTITION BY a, c, period_start, period_end, label IS NULL ORDER BY p, ingested_at DESC, fact_id) rl FROM r)
SELECT min(fact_id) group_id, max(fact_id) FILTER (WHERE value IS NOT NULL AND rv = 1) value_fact_id, max(fact_id) FILTER (WHERE label IS NOT NULL AND rl = 1) label_fact_id
FROM v GROUP BY a, c, period_start, period_end HAVING count(*) >= 2""",
}
