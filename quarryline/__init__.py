"""Quarryline: DataFrame-first processing of filings, facts and answers on Spark."""
