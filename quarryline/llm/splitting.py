"""Oversized texts cut into overlapping pieces at natural boundaries, by byte ranges.

A text is read in byte ranges with a halo of a few bytes on the left. Every range gives its tokens and
the kind of boundary before each; what a range cannot see, the end of the token before its first one and
the line feeds since, is carried over from range to range. Counts are added up over ranges; the boundary
tables are cut into blocks of equally many tokens. How cuts run through a block depends only on where
they enter it, so every block maps each entry to the entry of the next, the maps are chained in groups,
and pieces come out by byte offset. No step holds a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import checkpointed

LIMIT, OVERLAP = 512, 50
#: Bytes of a range, and bytes before it that are read: a sign that ends a sentence and two that close it.
RANGE, HALO = 65_536, 3
#: Tokens of a block of the boundary table, and ranges or blocks of a group that is summed or chained first.
BLOCK, GROUP = 4096, 512
#: Kinds of boundary, the higher the better. From SENTENCE on a boundary is natural.
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(5)


def ranges(texts: DataFrame, key: str, text: str, size: int = RANGE) -> DataFrame:
    """key, range_no, bytes_before (the halo) and body of every range of every text; null keys and texts give none.

    UTF-8 bytes are kept as such: the characters that part tokens are single bytes.
    """
    data = texts.select(F.col(key).alias("key"), F.encode(F.col(text), "UTF-8").alias("data")).filter("key is not null and data is not null")
    last = F.greatest(F.lit(0), F.floor((F.octet_length("data") - 1) / size)).cast("int")
    cut = data.withColumn("range_no", F.explode(F.sequence(F.lit(0), last)))
    at = F.col("range_no") * size
    halo = F.least(F.lit(HALO), at)
    return cut.select("key", "range_no", F.substring("data", at - halo + 1, halo).alias("halo"), F.substring("data", at + 1, F.lit(size)).alias("body"))


def file_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The same for every file of a folder or pattern, with its path as key; each task opens files at its offsets only.

    Files are listed with their lengths, never loaded whole. The workers must reach the path.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), "length")
    spans = files.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / size)).cast("int"))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for rows in batches:
            halos, bodies = [], []
            for path, no in zip(rows["key"], rows["range_no"]):
                place, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with place.open_input_file(name) as f:
                    at = int(no) * size
                    halo = min(HALO, at)
                    f.seek(at - halo)
                    data = f.read(halo + size)
                halos.append(data[:halo])
                bodies.append(data[halo:])
            if len(rows):
                yield pd.DataFrame({"key": rows["key"], "range_no": rows["range_no"], "halo": halos, "body": bodies})

    return spans.select("key", "range_no").repartition(F.col("key"), F.col("range_no")).mapInPandas(read, "key string, range_no int, halo binary, body binary")


def range_tokens(halo: Column, body: Column) -> Column:
    """Number of tokens that start in a range: a start is a byte other than space, tab, CR and LF after one of these or after nothing."""
    joined = F.concat(F.when(F.octet_length(halo) > 0, F.decode(F.substring(halo, -1, 1), "ISO-8859-1")).otherwise(F.lit(" ")), F.decode(body, "ISO-8859-1"))
    return F.regexp_count(joined, F.lit(r"[ \t\r\n](?=[^ \t\r\n])"))


def totals(by_range: DataFrame) -> DataFrame:
    """Tokens of every text: those of its ranges, added up; 0 for an empty text. Rows with the same key add up."""
    return by_range.groupBy("key").agg(F.sum(range_tokens(F.col("halo"), F.col("body"))).alias("tokens"))


_BOUNDS = T.StructType([
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("kinds", T.ArrayType(T.ByteType())),
    *[T.StructField(x, T.IntegerType()) for x in ("lead", "feeds", "tail", "sign")],
])


@F.pandas_udf(_BOUNDS)
def boundaries(halo: pd.Series, body: pd.Series) -> pd.DataFrame:
    """Tokens that start in the range, and what its neighbours need.

    starts and kinds are the offset of every token and the kind of boundary before it. lead is the number
    of line feeds before the first token if only white space is before it in the range, so its kind is
    not known here, else -1. feeds are all line feeds; tail those behind the last sign other than white
    space, and sign the kind that the token of that sign ends with, -1 if there is none in the range.
    """
    out = []
    for before, inside in zip(halo, body):
        data = np.frombuffer(before + inside, dtype=np.uint8)
        h = len(before)
        gap = (data == 32) | (data == 9) | (data == 10) | (data == 13)
        at = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        at = at[at >= h]
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        index = np.arange(len(data))
        last = np.maximum.accumulate(np.where(~gap, index, -1)) if len(data) else index

        def ends(end: np.ndarray) -> np.ndarray:
            """Kind that the token whose last byte is at end ends with; a sentence may close with two quotes or brackets."""
            sign = np.where(end >= 0, data[np.maximum(end, 0)], 0)
            for _ in range(2):
                closing = np.isin(sign, np.frombuffer(b"\"')]", dtype=np.uint8)) & (end > 0)
                end = np.where(closing, end - 1, end)
                sign = np.where(closing, data[np.maximum(end, 0)], sign)
            return np.where(np.isin(sign, np.frombuffer(b".!?", dtype=np.uint8)), SENTENCE, np.where(np.isin(sign, np.frombuffer(b",;:", dtype=np.uint8)), CLAUSE, WORD))

        end = np.where(at > 0, last[at - 1], -1) if len(at) else at
        lines = feeds[at] - feeds[np.maximum(end, 0)]
        kind = np.where(lines >= 2, PARAGRAPH, np.where(lines == 1, LINE, ends(end) if len(at) else lines))
        lead = int(feeds[at[0]] - feeds[h]) if len(at) and end[0] < h else -1
        final = int(last[-1]) if len(data) else -1
        seen = final >= h
        out.append((
            (at - h).astype(np.int32), kind.astype(np.int8), lead, int(feeds[-1] - feeds[h]),
            int(feeds[-1] - feeds[final + 1]) if seen else -1, int(ends(np.array([final]))[0]) if seen else -1,
        ))
    return pd.DataFrame(out, columns=["starts", "kinds", "lead", "feeds", "tail", "sign"])


def sums_before(rows: DataFrame, order: str, *values: str) -> DataFrame:
    """key, order and of each value the sum over the rows of the key before (as value_before) and over all (as value_all).

    Sums run within groups of GROUP numbers and over the groups then, so no task adds up a whole text.
    """
    group = rows.select("key", order, *values).withColumn("_group", F.floor(F.col(order) / GROUP))
    by_group = group.groupBy("key", "_group").agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy("key")
    past = whole.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    by_group = by_group.select("key", "_group", *[F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"{v}_past") for v in values], *[F.sum(v).over(whole).alias(f"{v}_all") for v in values])
    inner = Window.partitionBy("key", "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return group.join(by_group, ["key", "_group"]).select(
        "key", order, *[(F.col(f"{v}_past") + F.coalesce(F.sum(v).over(inner), F.lit(0))).alias(f"{v}_before") for v in values], *[f"{v}_all" for v in values]
    )


def last_before(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """key, order and carried: the last value that is not null in the rows of the key before; in groups as the sums."""
    group = rows.select("key", order, value.alias("v")).withColumn("_group", F.floor(F.col(order) / GROUP))
    by_group = group.groupBy("key", "_group").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col(order))).alias("v"))
    past = F.last("v", ignorenulls=True).over(Window.partitionBy("key").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    by_group = by_group.select("key", "_group", past.alias("past"))
    inner = F.last("v", ignorenulls=True).over(Window.partitionBy("key", "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return group.join(by_group, ["key", "_group"]).select("key", order, F.coalesce(inner, "past").alias("carried"))


def boundary_table(by_range: DataFrame) -> DataFrame:
    """Per range its tokens with the true kinds, n, the tokens before (base) and those of the text (total)."""
    found = by_range.select("key", "range_no", boundaries("halo", "body").alias("b")).select("key", "range_no", "b.*").withColumn("n", F.size("starts"))
    found = checkpointed(found)
    narrow = found.select("key", "range_no", "n", "lead", "feeds", "tail", "sign")
    sums = sums_before(narrow, "range_no", "n", "feeds")
    # the last token before a range: how it ends, and the line feeds of the text up to its end
    known = narrow.join(sums, ["key", "range_no"])
    told = last_before(known, "range_no", F.when(F.col("sign") >= 0, F.struct("sign", (F.col("feeds_before") + F.col("feeds") - F.col("tail")).alias("feeds_then"))))
    lines = F.col("feeds_before") + F.col("lead") - F.col("carried.feeds_then")
    kind = F.when(F.col("carried").isNull(), F.lit(WORD)).when(lines >= 2, F.lit(PARAGRAPH)).when(lines == 1, F.lit(LINE)).otherwise(F.col("carried.sign"))
    first = known.join(told, ["key", "range_no"]).select("key", "range_no", F.when(F.col("lead") >= 0, kind).cast("byte").alias("first_kind"), F.col("n_before").alias("base"), F.col("n_all").alias("total"))
    patched = F.when(F.col("first_kind").isNull(), F.col("kinds")).otherwise(F.concat(F.array("first_kind"), F.slice("kinds", 2, 1 << 30)))
    return found.select("key", "range_no", "starts", "kinds", "n").join(first, ["key", "range_no"]).select("key", "range_no", "starts", patched.alias("kinds"), "n", "base", "total")


def next_cut(kinds: np.ndarray, base: int, cut: int, end: int, limit: int, overlap: int) -> int:
    """Where the piece that follows cut ends: the best boundary in the second half of its room, else the
    last natural one before, else a clause, else where the room ends. A piece has more tokens than the
    overlap. kinds[0] belongs to token base."""
    start = max(cut - overlap, 0)
    stop = min(start + limit, end)
    if stop == end:
        return end
    low = max(cut + 1, start + limit // 2)
    for a, b, least in ((low, stop, SENTENCE), (start + overlap + 1, low - 1, SENTENCE), (low, stop, CLAUSE)):
        if b >= a:
            part = kinds[a - base : b + 1 - base]
            if (best := part.max()) >= least:
                wanted = part == best if a == low else part >= least
                return a + int(np.flatnonzero(wanted)[-1])
    return stop


def pieces(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """Pieces of every text of more than limit tokens: key, piece_no, tokens, byte_start, byte_end and text.

    A piece has at most limit tokens; all but the first begin with the last overlap tokens of the one
    before. Pieces end at a paragraph, line or sentence where there is one, and are cut out as they are in
    the text, without the white space after them. Texts within the limit, null and empty ones give none.
    Keys must be unique. A token longer than a range is one token; a single token is never cut. The result
    does not depend on the size of ranges and blocks.
    """
    # each token takes a byte and all but one a gap, so shorter texts are within the limit
    long = texts.filter(F.octet_length(text) > 2 * limit)
    return pieces_of_ranges(ranges(long, key, text, size), limit, overlap, size, block).withColumnRenamed("key", key)


def pieces_of_ranges(by_range: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """The same of ranges of any source, with the name key."""
    assert block > limit, "a piece reaches the next block at most"
    above = totals(by_range).filter(F.col("tokens") > limit).select("key")
    by_range = checkpointed(by_range.join(above, "key", "left_semi"))
    kind_of_key = dict(by_range.dtypes)["key"]
    table = boundary_table(by_range).filter("n > 0")
    # boundary table in blocks of equally many tokens, with those that pieces of the block may reach
    lo = F.greatest(F.lit(0), F.floor((F.col("base") - limit - 1) / block))
    hi = F.floor((F.col("base") + F.col("n") - 1 + overlap) / block)
    parts = table.withColumn("block_no", F.explode(F.sequence(lo, F.least(hi, F.floor((F.col("total") - 1) / block))))).withColumn(
        "from", F.greatest(F.lit(0), F.col("block_no") * block - overlap - F.col("base"))
    ).withColumn("to", F.least(F.col("n").cast("long"), (F.col("block_no") + 1) * block + limit + 1 - F.col("base"))).filter("to > from")
    sliced = lambda c: F.slice(c, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    blocks = parts.groupBy("key", "block_no", "total").agg(
        F.sort_array(F.collect_list(F.struct((F.col("base") + F.col("from")).alias("first"), F.transform(sliced("starts"), lambda s: s + F.col("range_no").cast("long") * size).alias("starts"), sliced("kinds").alias("kinds")))).alias("parts")
    ).select("key", "block_no", "total", F.col("parts")[0]["first"].alias("first"), F.flatten("parts.starts").alias("starts"), F.flatten("parts.kinds").alias("kinds"))

    @F.pandas_udf("array<int>")
    def exits(no: pd.Series, total: pd.Series, first: pd.Series, kinds: pd.Series) -> pd.Series:
        """For each token by which cuts can enter the block, the token by which they enter the next; -1 if they end."""
        out = []
        for k, end, base, kind in zip(no, total, first, kinds):
            kind, low, high = np.asarray(kind), k * block, min((k + 1) * block, end)
            leave: dict[int, int] = {}
            for cut in range(high - 1, low - 1, -1):
                nxt = next_cut(kind, base, cut, end, limit, overlap)
                leave[cut] = -1 if nxt >= end else nxt - high if nxt >= high else leave[nxt]
            out.append([leave[low + i] for i in range(min(limit, high - low))])
        return pd.Series(out)

    # a text of one block is entered at its begin; maps are needed for longer ones
    maps = checkpointed(blocks.filter(F.col("total") > block).select("key", "block_no", F.floor(F.col("block_no") / GROUP).alias("group_no"), exits("block_no", "total", "first", "kinds").alias("exits")))

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        """One map for the blocks of a group, one after the other."""
        rows = rows.sort_values("block_no")
        through = np.arange(len(rows["exits"].iloc[0]))
        for leave in rows["exits"]:
            leave = np.append(np.asarray(leave, dtype=np.int64), -1)  # what has ended stays ended
            through = leave[through]
        return pd.DataFrame({"key": rows["key"].iloc[:1].to_list(), "no": [int(rows["group_no"].iloc[0])], "exits": [through]})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """Where cuts enter each of the maps that follow each other, from the entry of the first."""
        entry, out = int(rows["entry"].iloc[0]), []
        for k, leave in sorted(zip(rows["no"], rows["exits"]), key=lambda x: x[0]):
            out.append((rows["key"].iloc[0], k, entry))
            if (entry := int(leave[entry])) < 0:
                break
        return pd.DataFrame(out, columns=["key", "no", "entry"])

    by_group = maps.groupBy("key", "group_no").applyInPandas(composed, f"key {kind_of_key}, no long, exits array<int>")
    entered = by_group.withColumn("entry", F.lit(0)).groupBy("key").applyInPandas(chain, f"key {kind_of_key}, no long, entry int").withColumnsRenamed({"no": "group_no"})
    inside = maps.join(entered, ["key", "group_no"]).withColumnRenamed("block_no", "no")
    entries = inside.groupBy("key", "group_no").applyInPandas(chain, f"key {kind_of_key}, no long, entry int").withColumnRenamed("no", "block_no")
    single = blocks.filter(F.col("total") <= block).withColumn("entry", F.lit(0))
    entered_blocks = single.unionByName(blocks.filter(F.col("total") > block).join(entries, ["key", "block_no"]))

    @F.pandas_udf("array<struct<cut: bigint, tokens: int, byte_start: bigint, byte_end: bigint>>")
    def cuts(no: pd.Series, total: pd.Series, first: pd.Series, starts: pd.Series, kinds: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for k, end, base, at, kind, into in zip(no, total, first, starts, kinds, entry):
            kind, cut, high, found = np.asarray(kind), k * block + into, min((k + 1) * block, end), []
            while cut < high:
                nxt, start = next_cut(kind, base, cut, end, limit, overlap), max(cut - overlap, 0)
                found.append((cut, nxt - start, int(at[start - base]), int(at[nxt - base]) if nxt < end else -1))
                cut = nxt
            out.append(found)
        return pd.Series(out)

    found = checkpointed(entered_blocks.select("key", "block_no", cuts("block_no", "total", "first", "starts", "kinds", "entry").alias("cuts")).withColumn("n", F.size("cuts")))
    before = sums_before(found, "block_no", "n").select("key", "block_no", "n_before")
    ends = by_range.groupBy("key").agg(F.max(F.col("range_no").cast("long") * size + F.octet_length("body")).alias("bytes"))
    numbered = (
        found.join(before, ["key", "block_no"]).select("key", "n_before", F.posexplode("cuts").alias("pos", "c")).select("key", (F.col("n_before") + F.col("pos")).cast("int").alias("piece_no"), "c.tokens", "c.byte_start", "c.byte_end")
        .join(ends, "key")
        .withColumn("byte_end", F.when(F.col("byte_end") < 0, F.col("bytes")).otherwise(F.col("byte_end")))
    )
    spread = numbered.withColumn("range_no", F.explode(F.sequence(F.floor(F.col("byte_start") / size).cast("int"), F.floor((F.col("byte_end") - 1) / size).cast("int"))))
    body = spread.join(by_range.select("key", "range_no", "body"), ["key", "range_no"]).withColumn("at", F.col("range_no").cast("long") * size)
    inner = F.greatest(F.lit(0), F.col("byte_start") - F.col("at"))
    part = F.substring("body", (inner + 1).cast("int"), (F.least(F.lit(size).cast("long"), F.col("byte_end") - F.col("at")) - inner).cast("int"))
    return body.groupBy("key", "piece_no", "tokens", "byte_start", "byte_end").agg(F.sort_array(F.collect_list(F.struct("range_no", part.alias("data")))).alias("parts")).select(
        "key",
        "piece_no",
        "tokens",
        "byte_start",
        "byte_end",
        F.regexp_replace(F.decode(F.aggregate("parts.data", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)), "UTF-8"), r"[ \t\r\n]+$", "").alias("text"),
    )
