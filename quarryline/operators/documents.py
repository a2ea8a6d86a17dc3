"""Filings in HTML to text, blocks, tables, tagged figures and sections.

One pass of the standard parser over each document gives one text; all offsets index that text. Parsing is
row by row in mapInPandas; what follows is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.numbers import is_value

#: Elements that break a block, cells, and elements without content.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol section article header footer nav blockquote pre hr br body tr table".split())
CELLS, HIDDEN, VOID = frozenset(("td", "th")), frozenset(("head", "script", "style", "noscript", "ix:hidden", "ix:header")), frozenset("br hr img input meta link col area base wbr".split())
FACTS = ("ix:nonfraction", "ix:nonnumeric")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARSED = (
    "key string, text string, blocks array<struct<block_no: int, kind: string, char_start: int, char_end: int, rows: array<array<string>>, cells: array<array<struct<char_start: int, char_end: int, colspan: int, rowspan: int>>>>>, "
    "spans array<struct<concept: string, context_ref: string, unit_ref: string, scale: int, sign: string, nil: boolean, char_start: int, char_end: int, raw_text: string>>, "
    "links array<struct<target: string, char_start: int, char_end: int>>, anchors map<string, int>, dei map<string, string>, "
    "contexts map<string, struct<period_start: string, period_end: string, dimensional: boolean>>, units map<string, string>"
)


class Walker(HTMLParser):
    """Collects one document. Text is written with white space collapsed; positions are those of the written text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.size = 0
        self.gap = ""
        self.hidden: list[str] = []
        self.open: list[tuple[str, dict]] = []
        self.blocks: list[tuple] = []
        self.begin, self.kind = -1, "paragraph"
        self.tables: list[list[list[list]]] = []
        self.table_begin = -1
        self.spans, self.links, self.anchors, self.dei = [], [], {}, {}
        self.contexts, self.units = {}, {}
        self.context = self.unit = None
        self.meta: list[str] = []
        # tagged facts in parts that are not shown: element, name, text so far
        self.unseen: list[tuple[str, str, list[str]]] = []

    def since(self, a: dict) -> str:
        """What was written since an element began, without the gap before it."""
        text = "".join(self.out[a["_n"] :])
        return text[1:] if text[:1] in (" ", "\n") else text

    def write(self, data: str) -> None:
        words = data.split()
        if not words:
            if data and not self.gap:
                self.gap = " "
            return
        if data[0].isspace() and not self.gap:
            self.gap = " "
        if self.size and self.gap:
            self.out.append(self.gap)
            self.size += 1
        if self.begin < 0:
            self.begin = self.size
        text = " ".join(words)
        self.out.append(text)
        self.size += len(text)
        self.gap = " " if data[-1].isspace() else ""

    def flush(self) -> None:
        if self.begin >= 0 and not self.tables:
            self.blocks.append((self.kind, self.begin, self.size, None, None))
            self.begin, self.kind = -1, "paragraph"
        if self.size:
            self.gap = "\n"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        hides = tag in HIDDEN or "display:none" in a.get("style", "").replace(" ", "").lower()
        if tag in VOID:
            if tag in BLOCKS:
                self.flush()
            return
        if self.hidden or hides:
            self.hidden.append(tag)
            self.facts(tag, a)
            if tag in FACTS and a.get("name"):
                self.unseen.append((tag, a["name"], []))
            return
        if self.tables and tag in (*CELLS, "tr"):
            # a cell or row that was left open ends where the next one begins
            inner = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == "table"), -1)
            left = next((i for i in range(inner + 1, len(self.open)) if self.open[i][0] in (CELLS if tag in CELLS else (*CELLS, "tr"))), None)
            if left is not None:
                for name, b in reversed(self.open[left:]):
                    self.close(name, b)
                del self.open[left:]
        if tag in BLOCKS:
            self.flush()
        if tag in HEADINGS:
            self.kind = "heading"
        if tag == "table":
            if not self.tables:
                self.table_begin = -1
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in CELLS and self.tables and self.tables[-1]:
            self.gap = self.gap or " "
            wide, high = (int(a[k]) if a.get(k, "").isdigit() and int(a[k]) > 0 else 1 for k in ("colspan", "rowspan"))
            self.tables[-1][-1].append([self.size, -1, wide, high])
        for name in (a.get("id"), a.get("name") if tag == "a" else None):
            if name:
                self.anchors.setdefault(name, self.size)
        self.facts(tag, a)
        self.open.append((tag, a | {"_at": self.size, "_n": len(self.out)}))

    def facts(self, tag: str, a: dict) -> None:
        """Contexts and units of tagged filings, whose elements are never shown."""
        if tag.endswith(":context"):
            self.context = [a.get("id", ""), None, None, False]
        elif tag.endswith(":unit"):
            self.unit = [a.get("id", ""), []]
        elif tag.endswith("explicitmember") and self.context:
            self.context[3] = True
        self.meta.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag.endswith(":context") and self.context:
            name, start, end, dim = self.context
            self.contexts.setdefault(name, (start, end, dim))
            self.context = None
        elif tag.endswith(":unit") and self.unit:
            self.units.setdefault(self.unit[0], "/".join(self.unit[1]))
            self.unit = None
        if self.hidden:
            if tag in FACTS and self.unseen and self.unseen[-1][0] == tag:
                _, name, parts = self.unseen.pop()
                if name.startswith("dei:"):
                    self.dei.setdefault(name, " ".join("".join(parts).split()))
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        for name, a in reversed(self.open[at:]):
            self.close(name, a)
        del self.open[at:]

    def close(self, tag: str, a: dict) -> None:
        start = a["_at"]
        if self.size > start and self.out[a["_n"]] in (" ", "\n"):
            start += 1
        if tag in FACTS and self.size > start:
            raw = self.since(a)
            if a.get("name", "").startswith("dei:"):
                self.dei.setdefault(a["name"], raw)
            if tag == "ix:nonfraction":
                scale = a.get("scale", "0") or "0"
                nil = a.get("xsi:nil", "").lower() in ("true", "1")
                self.spans.append((a.get("name"), a.get("contextref"), a.get("unitref"), int(scale) if re.fullmatch(r"-?\d+", scale) else 0, a.get("sign", ""), nil, start, self.size, raw))
        if tag == "a" and a.get("href", "").startswith("#"):
            self.links.append((a["href"][1:], start, self.size))
        if tag in CELLS and self.tables and self.tables[-1] and self.tables[-1][-1]:
            cell = self.tables[-1][-1][-1]
            cell[1] = self.size
            self.gap = self.gap or " "
        if tag == "table" and self.tables:
            rows = self.tables.pop()
            if not self.tables:
                text, base = "".join(self.out[a["_n"] :]), a["_at"]
                at = lambda s, e: text[s - base : e - base] if e > s else ""
                grid = [[x for s, e, n, _ in row for x in [at(s, e).strip(), *[""] * (n - 1)]] for row in rows]
                cells = [[self.trimmed(s, e, at(s, e)) + (n, m) for s, e, n, m in row] for row in rows]
                if self.begin >= 0:
                    self.blocks.append(("table", self.begin, self.size, grid, cells))
                self.begin, self.kind = -1, "paragraph"
                self.gap = "\n"
        elif tag in BLOCKS:
            self.flush()

    @staticmethod
    def trimmed(start: int, end: int, text: str) -> tuple[int, int]:
        """Place of a cell's text without the white space around it."""
        return (start + len(text) - len(text.lstrip()), end - len(text) + len(text.rstrip())) if text.strip() else (start, start)

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.unseen:
            parts.append(data)
        last = self.meta[-1] if self.meta else ""
        if self.context is not None and data.strip():
            if last.endswith("startdate"):
                self.context[1] = data.strip()
            elif last.endswith(("enddate", "instant")):
                self.context[2] = data.strip()
        elif self.unit is not None and data.strip() and last.endswith("measure"):
            self.unit[1].append(data.strip())
        if not self.hidden:
            self.write(data)


def parse_page(html: str) -> tuple:
    """One document as the fields of PARSED but the key."""
    w = Walker()
    w.feed(html)
    w.close_all() if hasattr(w, "close_all") else HTMLParser.close(w)
    for name, a in reversed(w.open):
        w.close(name, a)
    w.flush()
    blocks = [(n, *b) for n, b in enumerate(w.blocks)]
    return "".join(w.out), blocks, w.spans, w.links, w.anchors, w.dei, w.contexts, w.units


def parsed(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Documents of PARSED, one per page; null pages give none, broken markup what can be read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "text", "blocks", "spans", "links", "anchors", "dei", "contexts", "units"]
        for b in batches:
            yield pd.DataFrame([(k, *parse_page(h)) for k, h in zip(b["key"], b["html"]) if h is not None], columns=names)

    return pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(parse, PARSED)


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block with its text."""
    return docs.select("key", "text", F.explode("blocks").alias("b")).select("key", "b.*", F.expr("substring(text, b.char_start + 1, b.char_end - b.char_start)").alias("block_text"))


def broken_spans(docs: DataFrame) -> DataFrame:
    """Spans whose offsets do not cut their raw text out of the document; there should be none."""
    s = docs.select("key", "text", F.explode("spans").alias("s"))
    return s.filter(F.expr("substring(text, s.char_start + 1, s.char_end - s.char_start)") != F.col("s.raw_text")).select("key", "s.*")


def span_values(docs: DataFrame) -> DataFrame:
    """Tagged figures with their value: parsed, scaled, negated by the sign attribute; monetary by the unit's measure.

    A figure that does not parse keeps a null value, one marked nil is left out.
    """
    from quarryline.functions.numbers import apply_scale, parse_number

    s = docs.select("key", "units", F.explode("spans").alias("s")).filter("not s.nil").select("key", "s.*", "units")
    value = apply_scale(parse_number(F.col("raw_text")), F.col("scale"))
    measure = F.try_element_at("units", F.col("unit_ref"))
    return s.select("key", "concept", "context_ref", "scale", "char_start", "char_end", "raw_text", F.when(F.col("sign") == "-", -value).otherwise(value).alias("value"), monetary(measure).alias("monetary"))


def monetary(measure: Column) -> Column:
    """Whether a unit is one currency, not an amount per something."""
    return F.coalesce(F.lower(measure).startswith("iso4217:") & ~measure.contains("/"), F.lit(False))


def in_context(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with the period of their context; those whose context the document does not define are left out."""
    c = docs.select("key", F.explode("contexts").alias("context_ref", "c")).select("key", "context_ref", "c.*")
    return spans.join(c, ["key", "context_ref"])


def block_at(blocks: DataFrame, points: DataFrame) -> DataFrame:
    """key, point and block_no of the first block that ends after each point of its document; points has key and point."""
    hit = points.join(blocks.select("key", "block_no", "char_end"), "key").filter("char_end > point")
    return hit.groupBy("key", "point").agg(F.min("block_no").alias("block_no"))


def section_of(points: DataFrame, found: DataFrame) -> DataFrame:
    """points (key and block_no among others) with the item_code of the section whose blocks hold them, null for none."""
    s = found.select(F.col("key").alias("s_key"), "item_code", "first_block", "last_block")
    inside = (F.col("key") == F.col("s_key")) & F.col("block_no").between(F.col("first_block"), F.col("last_block"))
    hit = points.join(s, inside, "left")
    return hit.groupBy(*points.columns).agg(F.min_by("item_code", "first_block").alias("item_code"))


_ITEM, _PART = r"(?i)^\s*Item\s+\d{1,2}[A-C]?\b", r"(?i)^\s*PART\s+(?:I{1,3}|IV)\b"


def heading_rows(rows: Column) -> Column:
    """Rows of a table as texts, empty ones left out."""
    text = F.transform(rows, lambda r: F.trim(F.regexp_replace(F.array_join(F.filter(r, lambda c: c != ""), " "), r"\s+", " ")))
    return F.filter(text, lambda t: t != "")


def is_heading_table(rows: Column) -> Column:
    """Whether a table is one heading: its first row that is not empty is an Item or Part heading and no other row is."""
    heads = F.transform(heading_rows(rows), lambda t: t.rlike(_ITEM) | t.rlike(_PART))
    return F.coalesce((F.size(heads) > 0) & heads[0] & (F.size(F.filter(heads, lambda x: x)) == 1), F.lit(False))


def introduces_index(block_rows: DataFrame) -> Column:
    """Whether the next block is a table of several Items, so a Part heading before it heads an index."""
    following = F.lead("rows").over(Window.partitionBy("key").orderBy("block_no"))
    return F.coalesce(F.size(F.filter(heading_rows(following), lambda t: t.rlike(_ITEM))) >= 2, F.lit(False))


def headings(block_rows: DataFrame) -> DataFrame:
    """Blocks as sections() reads them: a heading table has its first row as text, a Part heading that introduces an index has none."""
    shown = F.when(is_heading_table(F.col("rows")), heading_rows(F.col("rows"))[0]).when((F.col("kind") == "table"), "").otherwise(F.col("block_text"))
    return block_rows.withColumn("_index", introduces_index(block_rows)).withColumn("block_text", F.when(F.col("_index") & shown.rlike(_PART), "").otherwise(shown)).drop("_index")


def index_entries(docs: DataFrame) -> DataFrame:
    """key, part, item_code and block_no that a table of contents links to: Item rows whose first link resolves, under the last Part row of the index.

    Heading tables are no index; a row without a link that resolves says nothing.
    """
    b = docs.select("key", F.explode("blocks").alias("b")).select("key", "b.*").filter(F.col("kind") == "table").filter(~is_heading_table(F.col("rows")))
    r = b.select("key", "block_no", F.posexplode(F.arrays_zip("rows", "cells")).alias("row_no", "r")).filter(F.size("r.cells") > 0)
    r = r.select("key", "block_no", "row_no", F.trim(F.regexp_replace(F.array_join(F.filter("r.rows", lambda c: c != ""), " "), r"\s+", " ")).alias("text"), F.array_min("r.cells.char_start").alias("lo"), F.array_max("r.cells.char_end").alias("hi"))
    links = docs.select(F.col("key").alias("l_key"), "anchors", F.explode("links").alias("l")).select("l_key", F.col("l.char_start").alias("at"), F.try_element_at("anchors", F.col("l.target")).alias("point")).filter("point is not null")
    target = r.join(links, (F.col("key") == F.col("l_key")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.greatest("hi", F.col("lo") + 1)), "left").groupBy("key", "block_no", "row_no", "text").agg(F.min_by("point", "at").alias("point"))
    is_part = F.col("text").rlike(_PART) & ~F.regexp_replace("text", r"(?i)^\s*PART\s+(?:I{1,3}|IV)\b[\s.,:\-–—]*", "").rlike(_ITEM)
    order = Window.partitionBy("key").orderBy("block_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    part = F.coalesce(F.last(F.when(is_part, F.upper(F.regexp_extract("text", r"(?i)^\s*PART\s+(I{1,3}|IV)\b", 1))), ignorenulls=True).over(order), F.lit("I"))
    items = target.withColumn("part", part).filter(F.col("text").rlike(_ITEM) & F.col("point").isNotNull())
    at = block_at(docs.select("key", F.explode("blocks").alias("b")).select("key", "b.block_no", "b.char_end"), items.select("key", "point").distinct())
    return items.join(at.withColumnRenamed("block_no", "target_block"), ["key", "point"]).select("key", "part", F.upper(F.regexp_extract("text", r"(?i)^\s*Item\s+(\d{1,2}[A-C]?)", 1)).alias("item_code"), F.col("target_block").alias("block_no"))


def sections(block_rows: DataFrame, longest: int = 200) -> DataFrame:
    """Sections by headings such as Item 1A: key, part, item_code, title, first and last block.

    Only short blocks can be headings. Part is that of the last Part heading before, I at first; a section
    ends before the next one's heading.
    """
    head = F.length("block_text") <= longest
    part = F.when(head, F.nullif(F.regexp_extract(F.upper("block_text"), r"^\s*PART\s+(I{1,3}|IV)\b", 1), F.lit("")))
    item = F.when(head, F.nullif(F.upper(F.regexp_extract("block_text", r"(?i)^\s*Item\s+(\d{1,2}[A-C]?)\b", 1)), F.lit("")))
    w = Window.partitionBy("key").orderBy("block_no")
    marked = block_rows.withColumn("part", F.coalesce(F.last(part, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("I"))).withColumn("item", item)
    last = F.max("block_no").over(Window.partitionBy("key"))
    heads = marked.withColumn("_last", last).filter("item is not null")
    title = F.trim(F.regexp_replace("block_text", r"(?i)^\s*Item\s+\d{1,2}[A-C]?\s*[.:\-–—]*\s*", ""))
    return heads.select("key", "part", F.concat_ws(".", "part", "item").alias("item_code"), title.alias("title"), F.col("block_no").alias("first_block"), (F.coalesce(F.lead("block_no").over(w), F.col("_last") + 1) - 1).alias("last_block"))


def missing_items(found: DataFrame, required: list[str]) -> DataFrame:
    """Per document the required item codes that no section has."""
    have = found.groupBy("key").agg(F.collect_set("item_code").alias("have"))
    return have.select("key", F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), "have")).alias("missing"))


def data_table(rows: Column) -> Column:
    """Whether a table holds data: some row has two figures or more. Else it is for layout."""
    return F.exists(rows, lambda r: F.size(F.filter(r, is_value)) >= 2)


def repeated_lines(lines: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Lines that repeat in a document with digits masked, at least so often, and that end in no full stop or colon."""
    from quarryline.functions.text import digit_key

    counted = lines.withColumn("line_key", digit_key(F.col(text))).filter("line_key <> ''").groupBy(key, "line_key").agg(F.count("*").alias("repeats"))
    return counted.filter((F.col("repeats") >= least) & ~F.col("line_key").rlike("[.:]$"))


def navigation_blocks(block_rows: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """key and block_no of the blocks that hold one set of link targets with at least so many others and read like no sentence.

    links has key, target, char_start and char_end; what remains of a block without its links is no sentence
    if it is short and ends in no stop.
    """
    b = block_rows.select("key", "block_no", "block_text", F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"))
    hit = b.join(links, "key").filter("char_start >= b_start and char_start < b_end")
    sets = hit.groupBy("key", "block_no", "block_text").agg(F.array_join(F.array_sort(F.collect_set("target")), "\x1f").alias("targets"), F.sum(F.col("char_end") - F.col("char_start")).alias("linked"))
    counts = sets.groupBy("key", "targets").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rest = F.length("block_text") - F.col("linked")
    return sets.join(counts, ["key", "targets"]).filter(~((rest > 40) & F.col("block_text").rlike(r"[.!?]\s*$"))).select("key", "block_no")


#: Items that may be no stubs, by form.
NO_STUBS = {"10-K": ("1", "1A", "7"), "10-Q": ("I.1", "I.2")}


def stub_items(lengths: DataFrame, most: int) -> DataFrame:
    """Per document the items whose sections have at most so many characters; lengths has key, item_code and chars."""
    return lengths.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("chars") <= most, F.col("item_code")))).alias("stubs"))


def quarantine(measures: DataFrame, bounds: dict) -> DataFrame:
    """measures with failures, the checks that a filing fails, and score, the mean of its defined components; a score never decides.

    measures has key, form_type, sections, missing, required, stubs, has_1a, data_tables, scaled_tables,
    scale_eligible, collapsed_tables, numeric_spans, resolved_spans, span_mismatches, alpha and fiscal_year.
    bounds has sections, data_tables and alpha (low, high). One row per filing, all by expressions.
    """
    low, high = bounds["alpha"]
    inside = (F.col("alpha") > low) & (F.col("alpha") < high)
    kept = F.when(F.col("form_type") == "10-K", F.array_intersect("stubs", F.array(*[F.lit(x) for x in NO_STUBS["10-K"]]))).otherwise(F.array_intersect("stubs", F.array(*[F.lit(x) for x in NO_STUBS["10-Q"]])))
    said = [
        F.when(F.col("sections") < bounds["sections"], F.lit("sections")),
        F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ","))),
        F.when(F.size(kept) > 0, F.concat(F.lit("stub "), F.array_join(kept, ","))),
        F.when((F.col("form_type") == "10-K") & ~F.coalesce("has_1a", F.lit(False)), F.lit("no 1A")),
        F.when(F.col("data_tables") < bounds["data_tables"], F.lit("data tables")),
        F.when(~F.coalesce(inside, F.lit(False)), F.lit("letters")),
        F.when(F.col("fiscal_year").isNull(), F.lit("no fiscal year")),
        F.when(F.col("span_mismatches") > 0, F.lit("spans")),
    ]
    return measures.withColumns({"failures": F.filter(F.array(*said), lambda x: x.isNotNull()), "score": score(
        [F.try_divide("scaled_tables", "scale_eligible"), 1 - F.try_divide("collapsed_tables", "data_tables"), F.try_divide("resolved_spans", "numeric_spans"), 1 - F.try_divide(F.size("missing"), "required"), F.coalesce(inside, F.lit(False)).cast("double")]
    )})


def score(components: list[Column]) -> Column:
    """Mean of the components that are defined, null for none."""
    known = F.filter(F.array(*[c.cast("double") for c in components]), lambda x: x.isNotNull())
    return F.round(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), 6)
