"""Canonical forms of keys whose spellings differ in case, spacing, punctuation, prefix or zeros.

Every function takes and returns a Column and gives null for null. All stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accession_key(c: Column | str) -> Column:
    """Accession as 18 digits: separators go, leading zeros are restored."""
    digits = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^0-9]", "")
    return F.lpad(F.regexp_replace(digits, "^0+", ""), 18, "0")


def concept_key(c: Column | str) -> Column:
    """Concept without taxonomy prefix, case, spaces and punctuation."""
    low = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    bare = F.regexp_replace(low, "^(?:[a-z][a-z0-9-]*[:/]|(?:us-gaap|dei|srt|ifrs-full)[_ ])", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def ticker_key(c: Column | str) -> Column:
    """Ticker in capitals; an exchange prefix that ends in a colon and all signs go."""
    up = F.upper(F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(F.regexp_replace(up, "^.*:", ""), "[^A-Z0-9]", "")


def form_key(c: Column | str) -> Column:
    """Form type such as 10K or 10K/A; an amendment stays another form."""
    up = F.regexp_replace(F.upper(F.col(c) if isinstance(c, str) else c), "^\\s*FORM\\b", "")
    return F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9/]", ""), "^0+", "")


def item_key(c: Column | str) -> Column:
    """Item code such as 1A or II1A: the words Part and Item, signs and leading zeros go."""
    up = F.regexp_replace(F.upper(F.col(c) if isinstance(c, str) else c), "\\b(?:PART|ITEM)\\b", "")
    return F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9]", ""), "^(I*)0+", "$1")


def source_key(c: Column | str) -> Column:
    """Name of a source in lower case without spaces and punctuation."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]", "")
