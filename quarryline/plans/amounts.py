"""Queries on amounts in common units (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import units
from quarryline.sources.tables import table


def found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_amounts(table(spark, d, "xbrl_facts"), table(spark, d, "xbrl_spans"), table(spark, d, "chunks"))


def amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact and span with its amount in common units."""
    f = units.facts_of(table(spark, d, "xbrl_facts"))
    s = units.spans_of(table(spark, d, "xbrl_spans"), table(spark, d, "chunks"))
    of_facts = units.fact_amounts(f, units.unit_sources(f, s)).select(F.lit("fact").alias("record_kind"), F.col("fact_id").alias("id"), "dimension", "amount")
    return of_facts.unionByName(s.select(F.lit("span").alias("record_kind"), F.col("span_id").alias("id"), "dimension", "amount"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Every way of naming a unit with its conversion."""
    f = units.facts_of(table(spark, d, "xbrl_facts"))
    return units.unit_sources(f, units.spans_of(table(spark, d, "xbrl_spans"), table(spark, d, "chunks")))


QUERIES = {"p6_found": found, "p6_amounts": amounts, "p6_unit_sources": sources}

_POWER = """CASE WHEN regexp_matches({c}, '\\b(bps?|basis points?)\\b') THEN 0.0001
 WHEN regexp_matches({c}, '%|\\b(pct|per ?cent|cents?|usc)\\b') THEN 0.01
 WHEN regexp_matches({c}, '\\b(bn|bln|billions?|usdb|usdbn|busd)\\b') THEN 1000000000
 WHEN regexp_matches({c}, '\\b(mm|mn|mln|millions?|musd|usdm|usdmm|m)\\b') THEN 1000000
 WHEN regexp_matches({c}, '\\b(thousands?|k|kusd|usdk|000s?)\\b') THEN 1000 END"""
_CONCEPT = r"regexp_replace(regexp_replace(lower(trim(concept)), '^([a-z][a-z0-9-]*[:/]|(us-gaap|dei|srt|ifrs-full)[_ ])', ''), '[^a-z0-9]', '', 'g')"
_ACCESSION = "lpad(ltrim(regexp_replace(accession, '[^0-9]', '', 'g'), '0'), 18, '0')"
SQL = {
    "p6_found": rf"""
WITH f AS (SELECT fact_id, {_ACCESSION} acc, {_CONCEPT} con,
  CAST(CAST(value AS DECIMAL(28,6)) * CAST(coalesce({_POWER.format(c="lower(coalesce(unit, ''))")}, {_POWER.format(c="regexp_extract(lower(coalesce(label, '')), '([(][^()]*[)]|[[][^]]*[]]|,[^,]*|- [^()]*)$')")}, 1) AS DECIMAL(14,4)) AS DECIMAL(38,7)) amount
  FROM xbrl_facts WHERE value IS NOT NULL),
s0 AS (SELECT DISTINCT span_id, {_ACCESSION} acc, {_CONCEPT} con, raw_text, scale, chunk_id FROM xbrl_spans),
s1 AS (SELECT s0.*, CAST(regexp_replace(regexp_extract(s0.raw_text, '[0-9][0-9, ' || chr(160) || ']*([.][0-9]+)?'), '[^0-9.]', '', 'g') AS DECIMAL(28,6)) * (CASE WHEN regexp_matches(s0.raw_text, '^[^0-9]*[(−-]') THEN -1 ELSE 1 END) figure,
  coalesce({_POWER.format(c="lower(s0.raw_text)")}, CASE WHEN con LIKE '%pershare%' OR con LIKE '%rate' THEN NULL ELSE coalesce({_POWER.format(c="lower(c.unit_scale)")}, {_POWER.format(c="lower(split_part(regexp_extract(c.raw_text, '(?m)^[[]Table:([^' || chr(10) || ']*)', 1), '|', -1))")}) END, 1) said
  FROM s0 LEFT JOIN chunks c ON c.chunk_id = s0.chunk_id),
s AS (SELECT span_id, acc, con, CAST(figure * CAST(CASE scale WHEN 6 THEN 1000000 WHEN 3 THEN 1000 WHEN 0 THEN 1 WHEN -2 THEN 0.01 WHEN 9 THEN 1000000000 ELSE said END AS DECIMAL(14,4)) AS DECIMAL(38,7)) amount FROM s1)
SELECT DISTINCT fact_id, span_id FROM f JOIN s USING (acc, con, amount)""",
}
