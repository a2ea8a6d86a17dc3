"""Sections packed into chunks, whole units at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import SENTENCE_END

SCHEMA = "key string, section string, chunk_no int, first_unit int, last_unit int, size int, text string"


def packed_units(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """First and last unit of every chunk: as many units as fit the target, begun with the last units of the
    chunk before as far as they fit the overlap; every chunk brings a new unit. A unit over the target is
    a chunk of its own."""
    out, first, at = [], 0, 0
    while at < len(sizes):
        total, last = sum(sizes[first:at]), at
        while last < len(sizes) and (last == at or total + sizes[last] <= target):
            total += sizes[last]
            last += 1
        out.append((first, last - 1))
        at, first, carried = last, last, 0
        while first > out[-1][0] + 1 and at < len(sizes) and carried + sizes[first - 1] <= overlap and carried + sizes[first - 1] + sizes[at] <= target:
            first -= 1
            carried += sizes[first]
    return out


def chunks(units: DataFrame, target: int, overlap: int, size: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of every section of every document: SCHEMA.

    units has key, section, unit_no and text. A group is a section of one document. size counts tokens,
    words where none is given. Null texts count as empty; a section without units has no chunk.
    """
    count = size or (lambda t: len(t.split()))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit_no")
        texts, numbers = [t or "" for t in rows["text"]], rows["unit_no"].tolist()
        sizes = [count(t) for t in texts]
        out = [(rows["key"].iloc[0], rows["section"].iloc[0], n, numbers[a], numbers[b], sum(sizes[a : b + 1]), "\n".join(texts[a : b + 1])) for n, (a, b) in enumerate(packed_units(sizes, target, overlap))]
        return pd.DataFrame(out, columns=["key", "section", "chunk_no", "first_unit", "last_unit", "size", "text"])

    return units.select(F.col("key").cast("string").alias("key"), F.col("section").cast("string").alias("section"), "unit_no", "text").groupBy("key", "section").applyInPandas(pack, SCHEMA)


def header(row: DataFrame) -> DataFrame:
    """Context line of chunks: name (ticker) | form | period | item: title, by columns of those names."""
    item = F.concat(F.lit("Item "), F.col("item_code"), F.when(F.col("section_title").isNotNull(), F.concat(F.lit(": "), "section_title")).otherwise(""))
    return row.withColumn("header", F.concat(F.lit("["), F.concat_ws(" | ", F.concat(F.col("name"), F.lit(" ("), F.col("ticker"), F.lit(")")), "form_type", "period_label", item), F.lit("]")))


def table_parts(rows: DataFrame, target: int) -> DataFrame:
    """Data tables cut into parts of at most target words, each repeating the header row; parts tile the table.

    rows has key, table_no and grid, an array of rows of cells of which the first is the header. One table
    is one row, so this is an expression per row: rows are numbered by the words before them.
    """
    words = lambda r: F.size(F.filter(F.split(F.array_join(r, " "), r"\s+"), lambda x: x != ""))
    body = F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))
    room = F.greatest(F.lit(1), F.lit(target) - F.col("_head"))
    one = rows.withColumn("_head", words(F.col("grid")[0])).withColumn("_rows", body)
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(acc, r):
        n = words(r)
        new = (acc["used"] > 0) & (acc["used"] + n > room)
        part = F.when(new, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), F.when(new, n).otherwise(acc["used"] + n).alias("used"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    numbered = one.withColumn("_parts", F.aggregate("_rows", start, step)["parts"])
    each = numbered.select("key", "table_no", F.col("grid")[0].alias("head"), F.explode(F.arrays_zip("_parts", "_rows")).alias("x"), "_parts")
    return each.groupBy("key", "table_no", "head", F.col("x._parts").alias("part_no")).agg(F.count("*").alias("rows"), F.array_join(F.collect_list(F.array_join("x._rows", " | ")), "\n").alias("body"))


_SENTENCE = re.compile(SENTENCE_END)
DOCUMENT = (
    "key string, section string, chunk_id string, chunk_type string, first_block int, last_block int, size int, text string, raw_text string, "
    "paragraphs_split int, paragraph_pieces int, whitespace_splits int, tables_split int, layout_tables_split int, over_budget int"
)


def groups_of(parts: list[str], count: Callable[[str], int], budget: int) -> list[str]:
    """Neighbouring parts joined by spaces as long as they fit the budget."""
    out: list[str] = []
    for p in parts:
        if out and count(f"{out[-1]} {p}") <= budget:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


def fitted(text: str, count: Callable[[str], int], budget: int) -> tuple[list[str], int]:
    """Pieces of a paragraph within the budget, and how many of them had to be cut between words.

    Sentences first, then clauses of a sentence that is too long, then words; a word over the budget stays
    one piece. Pieces are as long as they can be.
    """
    if count(text) <= budget:
        return [text], 0
    parts, cut = [], 0
    for sentence in _SENTENCE.split(text):
        if count(sentence) <= budget:
            parts.append(sentence)
            continue
        for clause in re.split(r"(?<=;)\s+", sentence):
            if count(clause) <= budget:
                parts.append(clause)
            else:
                by_word = groups_of(clause.split(), count, budget)
                cut += len(by_word)
                parts += by_word
    return groups_of(parts, count, budget), cut


def chunk_documents(units: DataFrame, target: int, overlap: int, size: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of every section of every document: DOCUMENT.

    units has key, section, block_no, kind (prose, table, layout), text, rows (lines of a table), header (the
    line on top of each chunk of the section) and context (lines repeated on each part of a table). Prose is
    fitted to the target and packed with whole pieces as overlap; a data table has chunks of its own, whose
    parts repeat the context and tile the rows; a layout table over the target is cut by rows and packed as
    prose. Furniture and navigation are left out before. Ids name the first and the last block with their
    pieces, so they are unique. Counters are those of the section, on its first chunk; over_budget counts
    chunks that one word or row makes larger than the target. A group is one section of a document.
    """
    count = size or (lambda t: len(t.split()))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_no")
        key, section = rows["key"].iloc[0], rows["section"].iloc[0]
        header = rows["header"].iloc[0] or ""
        room = max(1, target - count(header))
        stats = dict.fromkeys(("paragraphs_split", "paragraph_pieces", "whitespace_splits", "tables_split", "layout_tables_split", "over_budget"), 0)
        pieces: list[tuple[int, int, str]] = []
        out: list[tuple] = []

        def add(kind: str, first: tuple[int, int], last: tuple[int, int], body: str) -> None:
            text = "\n".join(x for x in (header, body) if x)
            n = count(text)
            stats["over_budget"] += n > target
            out.append((key, section, f"{key}:{first[0]}.{first[1]}:{last[0]}.{last[1]}", kind, first[0], last[0], n, text, body))

        def flush() -> None:
            if pieces:
                for a, b in packed_units([count(p[2]) for p in pieces], room, overlap):
                    own = pieces[a : b + 1]
                    add("prose", own[0][:2], own[-1][:2], "\n".join(p[2] for p in own))
                pieces.clear()

        for no, kind, text, lines, context in zip(rows["block_no"], rows["kind"], rows["text"], rows["rows"], rows["context"]):
            no, lines = int(no), list(lines) if lines is not None else []
            if kind == "table":
                flush()
                top = [c for c in (list(context) if context is not None else [])]
                space = max(1, room - sum(map(count, top)))
                parts, used = [[]], 0
                for line in lines:
                    n = count(line)
                    if parts[-1] and used + n > space:
                        parts.append([])
                        used = 0
                    parts[-1].append(line)
                    used += n
                stats["tables_split"] += len(parts) > 1
                for k, part in enumerate(parts):
                    add("table", (no, k), (no, k), "\n".join([*top, *part]))
                continue
            if kind == "layout" and count(text or "") > room:
                got, cut = [p for line in lines for p in fitted(line, count, room)[0]], 0
                stats["layout_tables_split"] += 1
            else:
                got, cut = fitted(text or "", count, room)
                if len(got) > 1:
                    stats["paragraphs_split"] += 1
                    stats["paragraph_pieces"] += len(got)
            stats["whitespace_splits"] += cut
            pieces += [(no, k, p) for k, p in enumerate(got) if p]
        flush()
        frame = pd.DataFrame(out, columns=["key", "section", "chunk_id", "chunk_type", "first_block", "last_block", "size", "text", "raw_text"])
        for name, n in stats.items():
            frame[name] = [n if i == 0 else 0 for i in range(len(frame))]
        return frame

    need = units.select(*[F.col(c).cast("string").alias(c) for c in ("key", "section")], F.col("block_no").cast("int").alias("block_no"), "kind", "text", "rows", "header", "context")
    return need.groupBy("key", "section").applyInPandas(pack, DOCUMENT)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counters of every document."""
    names = ("paragraphs_split", "paragraph_pieces", "whitespace_splits", "tables_split", "layout_tables_split", "over_budget")
    return chunks.groupBy("key").agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("chunks"))
