"""Tables of parsed documents as logical grids: columns with labels, body rows, title, scale and currency.

A table is one row and is laid out on its own, batch by batch; captions, scales of tagged figures and
titles come from joins within the document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.numbers import caption_phrase_scale, tag_scale

#: Characters before a table in which its caption is sought, and longest title.
CAPTION_WINDOW, TITLE = 500, 100
#: Cells that belong to the figure after or before them, a year that labels a column, a cell of brackets only, page marks, and labels of periods.
PREFIXES, SUFFIXES = ("$", "(", "($", "$("), (")", "%", ")%", "%)")
_YEAR, _BRACKETS = re.compile(r"(?:19|20)\d{2}"), re.compile(r"(?:\([^()]*\)\s*)+")
PERIOD_LABEL = r"(?i)\b(?:(?:19|20)\d{2}|Q[1-4]|FY|quarter|months|weeks|year)\b"
GRID = (
    "key string, block_no int, kind string, header_rows int, title string, columns array<string>, body array<array<string>>, "
    "offsets array<struct<char_start: int, char_end: int>>, header_text string, currency string"
)


def is_figure(text: str) -> bool:
    """Whether a cell is a figure: a digit, and nothing but signs of numbers around it."""
    return bool(re.search(r"\d", text)) and bool(re.fullmatch(r"\$?\s*\(?\s*[-+−–]?\s*\$?\s*(?:\d{1,3}(?:[,\s]\d{3})+|\d+)?(?:\.\d*)?\s*\)?\s*%?\)?", text.strip()))


def is_dash(text: str) -> bool:
    return text.strip() in ("-", "–", "—")


def placed(text: str, rows: list) -> list[list[tuple[int, int, str, int, int]]]:
    """Cells that hold text, by row: first column, column after, text, place. A cell of several rows keeps its columns in the rows below."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        column, cells = 0, []
        for start, end, wide, high in row:
            while (r, column) in taken:
                column += 1
            taken.update((r + down, column + right) for down in range(1, high) for right in range(wide))
            shown = " ".join(text[start:end].split())
            if shown:
                cells.append((column, column + wide, shown, start, end))
            column += wide
        if cells:
            out.append(cells)
    return out


def joined(row: list[tuple]) -> list[tuple]:
    """Cells with a currency or bracket before a figure and a bracket or percent sign after it as one."""
    glue = lambda a, b: (a[0], b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]))
    out: list[tuple] = []
    for cell in row:
        if out and (out[-1][2] in PREFIXES or cell[2] in SUFFIXES):
            out[-1] = glue(out[-1], cell)
        else:
            out.append(cell)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping ranges as one; those that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def meets(cell: tuple, group: tuple[int, int]) -> bool:
    return cell[0] < group[1] and cell[1] > group[0]


def layout(text: str, rows: list) -> dict:
    """One table as the fields of GRID but the key; a layout table, without two figures in a row, has its kind only."""
    grid = [joined(r) for r in placed(text, rows)]
    if not any(sum(is_figure(c[2]) for c in r) >= 2 for r in grid):
        return {"kind": "layout", "header_rows": 0, "title": None, "columns": [], "body": [], "offsets": [], "header_text": "", "currency": None}

    def is_body(row: list[tuple]) -> bool:
        values = [c for c in row if c[0] > 0]
        return any(is_figure(c[2]) and not _YEAR.fullmatch(c[2]) for c in row) or bool(values) and all(is_dash(c[2].strip("$%")) for c in values)

    first = next((i for i, r in enumerate(grid) if is_body(r)), len(grid))
    cells = [c for r in grid[first:] for c in r if c[0] > 0]
    figures = merged([c[:2] for c in cells if is_figure(c[2]) or is_dash(c[2])])
    # a text over several figure columns is a heading within the body, not a column
    texts = [c[:2] for c in cells if not (is_figure(c[2]) or is_dash(c[2])) and sum(meets(c, g) for g in figures) < 2]
    groups = merged(figures + texts)
    over_values = lambda c: bool(groups) and c[0] >= groups[0][0]
    header = max((i + 1 for i, r in enumerate(grid[:first]) if any(map(over_values, r))), default=0)
    labels: list[list[str]] = [[] for _ in range(len(groups) + 1)]
    title = None
    for row in grid[:header]:
        names_columns = any(map(over_values, row))
        for c in row:
            if over_values(c):
                for n, g in enumerate(groups, 1):
                    if meets(c, g):
                        labels[n].append(c[2])
            elif _BRACKETS.fullmatch(c[2]):
                continue
            elif names_columns:
                labels[0].append(c[2])
            else:
                title = title or c[2]
    columns = [" ".join(x) for x in labels]
    body, offsets = [], []
    for row in grid[header:]:
        out = [""] * len(columns)
        for c in row:
            n = next((n for n, g in enumerate(groups, 1) if meets(c, g)), 0)
            out[n] = f"{out[n]} {c[2]}".strip()
        body.append(out)
        offsets.append((min(c[3] for c in row), max(c[4] for c in row)))
    money = any(c[2].startswith("$") for r in grid[header:] for c in r)
    return {"kind": "data", "header_rows": header, "title": title, "columns": columns, "body": body, "offsets": offsets, "header_text": "\n".join(c[2] for r in grid[:first] for c in r), "currency": "USD" if money else None}


def grids(docs: DataFrame) -> DataFrame:
    """Tables of parsed documents on their logical grid: GRID."""
    names = [x.split(":")[0].split()[0] for x in ("key", "block_no", "kind", "header_rows", "title", "columns", "body", "offsets", "header_text", "currency")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, no, base, text, cells in zip(b["key"], b["block_no"], b["base"], b["piece"], b["cells"]):
                rows = [[(c["char_start"] - base, c["char_end"] - base, c["colspan"], c["rowspan"]) for c in r] for r in json.loads(cells or "[]")]
                own = layout(text, rows)
                own["offsets"] = [(lo + base, hi + base) for lo, hi in own["offsets"]]
                out.append({"key": key, "block_no": no, **own})
            yield pd.DataFrame(out, columns=names)

    t = docs.select("key", "text", F.explode("blocks").alias("b")).filter("b.kind = 'table'")
    piece = F.substring("text", F.col("b.char_start") + 1, F.col("b.char_end") - F.col("b.char_start"))
    return t.select("key", "b.block_no", F.col("b.char_start").alias("base"), piece.alias("piece"), F.to_json("b.cells").alias("cells")).mapInPandas(run, GRID)


def extracted(docs: DataFrame) -> DataFrame:
    """Data tables with title, unit_scale, scale_source (caption or tags) and fiscal_periods.

    The caption is sought in the header rows and in the CAPTION_WINDOW characters before the table, never
    before the end of the table before it. Where it states no scale, the tagged figures of the table do,
    unless a monetary one disagrees. A table without a title takes the nearest short heading before it.
    """
    t = grids(docs).filter("kind = 'data'")
    b = docs.select("key", "text", F.explode("blocks").alias("b")).select("key", "text", "b.block_no", "b.char_start", "b.char_end", "b.kind")
    order = Window.partitionBy("key").orderBy("block_no")
    past = F.last(F.when(F.col("kind") == "table", F.col("char_end")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(F.lit(0), F.col("char_start") - CAPTION_WINDOW, F.coalesce(past, F.lit(0)))
    own = F.trim(F.regexp_replace(F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")), r"\s+", " "))
    # texts that are passed over on the way back to a title are null; a text that ends the search is empty
    skipped = (own == "") | own.rlike(r"^(?:\([^()]*\)\s*)+$") | own.rlike(r"(?i)^(?:page\s+)?\d+$|table of contents") | own.endswith(":")
    title = F.when(F.col("kind") == "table", "").when(skipped, None).when((F.length(own) <= TITLE) & ~own.rlike("[.;]$"), own).otherwise("")
    marked = b.withColumns({"_start": start, "_title": title}).withColumn("near", F.last("_title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("near_at", F.last(F.when(F.col("_title").isNotNull(), F.col("char_end")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    where = marked.filter("kind = 'table'").select(
        "key", "block_no", "char_start", "char_end", F.substring("text", F.col("_start") + 1, F.col("char_start") - F.col("_start")).alias("preceding"),
        F.when((F.col("near") != "") & (F.col("char_start") - F.col("near_at") <= CAPTION_WINDOW), F.col("near")).alias("near"),
    )
    from quarryline.operators.documents import span_values

    s = span_values(docs).select(F.col("key").alias("s_key"), "scale", "monetary", F.col("char_start").alias("s_at"))
    inside = where.join(s, (F.col("key") == F.col("s_key")) & (F.col("s_at") >= F.col("char_start")) & (F.col("s_at") < F.col("char_end")))
    tags = inside.groupBy("key", "block_no").agg(F.collect_list("scale").alias("scales"), F.collect_list("monetary").alias("money"))
    j = t.join(where, ["key", "block_no"]).join(tags, ["key", "block_no"], "left")
    said, tagged = caption_phrase_scale(F.concat_ws("\n", "preceding", "header_text")), tag_scale(F.col("scales"), F.col("money"))
    word = lambda p: F.when(p == 3, "thousands").when(p == 6, "millions").when(p == 9, "billions")
    return j.select(
        "key", "block_no", "header_rows", F.coalesce("title", "near", F.nullif(F.trim(F.col("columns")[0]), F.lit(""))).alias("title"), "columns", "body", "offsets", "currency",
        word(F.coalesce(said, tagged)).alias("unit_scale"), F.when(said.isNotNull(), "caption").when(tagged.isNotNull(), "tags").alias("scale_source"),
        F.filter(F.slice("columns", 2, 10_000), lambda c: c.rlike(PERIOD_LABEL)).alias("fiscal_periods"),
        F.exists("body", lambda r: F.exists(F.slice(r, 2, 10_000), lambda c: (F.size(F.split(c, " ")) > 1) & F.forall(F.split(c, " "), lambda x: x.rlike(r"^\$?\(?[\d,.]+\)?%?$")))).alias("collapsed"),
    )


def context_line(title: Column, company: Column, period: Column, item: Column, scale: Column, currency: Column) -> Column:
    """[Table: title | company | period | item | in scale, currency], without what is not known."""
    units = F.concat_ws(", ", F.concat(F.lit("in "), scale), currency)
    head = F.coalesce(F.concat(F.lit("Table: "), title), F.lit("Table"))
    return F.concat(F.lit("["), F.concat_ws(" | ", head, company, period, item, F.nullif(units, F.lit(""))), F.lit("]"))


def markdown(context: Column, columns: Column, body: Column) -> Column:
    """Table as lines: context, header, rule and rows; pipes inside cells are escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(columns)))
    return F.array_join(F.concat(F.array(context, line(columns), rule), F.transform(body, line)), "\n")
