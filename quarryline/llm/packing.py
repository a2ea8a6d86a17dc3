"""Texts packed whole into containers of fixed capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.tokens import TOKENIZERS, encoder, token_count
from quarryline.session import checkpointed

CAPACITY = 2048
#: Attention within a text is paid by square tiles of this many tokens on a side, so a short text costs a whole tile.
TILE = 64
#: Most texts of a container, and most tiles of attention: those of one text that fills it.
MAX_TEXTS, MAX_ATTENTION = 64, (CAPACITY // TILE) ** 2
#: Weights of free tokens, texts and attention cost in the norm of what would stay free.
WEIGHTS = (1.0, 0.02, 0.05)
#: Expected pieces of a shard; a shard is packed in one task whatever the size of the table.
SHARD_PIECES = 12_000


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Texts by size; one longer than capacity is cut into full pieces and a rest, at token offsets.

    Null ids, null texts and texts of no token take no container. whole says that the text was not cut.
    Every text is tokenised once; its size is kept.
    """
    sized = checkpointed(documents.filter("doc_id is not null").select("doc_id", token_count(F.col("text"), tokenizers).alias("doc_tokens"))).filter("doc_tokens > 0")
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("doc_tokens") - 1) / capacity))).alias("piece_no")
    return sized.select("doc_id", "doc_tokens", cut).select(
        "doc_id",
        "piece_no",
        (F.col("piece_no") * capacity).alias("token_start"),
        F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("piece_no") * capacity).alias("tokens"),
        (F.col("doc_tokens") <= capacity).alias("whole"),
    )


def attention(tokens: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Tiles of attention of texts."""
    return (-(-tokens // tile)) ** 2


def best_fit(tokens: np.ndarray, capacity: int, max_texts: int, max_attention: int, tile: int = TILE) -> np.ndarray:
    """Container of every piece: longest first, each into the open container that leaves the smallest norm free.

    What stays free of tokens, texts and attention is weighted by WEIGHTS as shares of their capacities.
    """
    order = np.argsort(-tokens, kind="stable")
    out = np.empty(len(tokens), dtype=np.int64)
    free = np.empty((3, 256))
    name = np.empty(256, dtype=np.int64)
    opened = live = 0
    wt, wn, wa = (w / cap**2 for w, cap in zip(WEIGHTS, (capacity, max_texts, max_attention)))
    cost = attention(tokens, tile)
    smallest = np.minimum.accumulate(tokens[order][::-1])[::-1] if len(tokens) else tokens
    for place, i in enumerate(order):
        n, w = float(tokens[i]), float(cost[i])
        t, c, a = free[0, :live], free[1, :live], free[2, :live]
        fits = (t >= n) & (c >= 1) & (a >= w)
        if fits.any():
            norm = wt * (t - n) ** 2 + wn * (c - 1) ** 2 + wa * (a - w) ** 2
            b = int(np.argmin(np.where(fits, norm, np.inf)))
        else:
            if live == free.shape[1]:
                free = np.concatenate([free, np.empty_like(free)], axis=1)
                name = np.concatenate([name, np.empty_like(name)])
            b, live = live, live + 1
            free[:, b], name[b] = (capacity, max_texts, max_attention), opened
            opened += 1
        free[:, b] -= (n, 1, w)
        out[i] = name[b]
        if free[0, b] < smallest[min(place + 1, len(order) - 1)] or free[1, b] < 1:  # full: nothing to come fits
            live -= 1
            free[:, b], name[b] = free[:, live], name[live]
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, max_texts: int = MAX_TEXTS, max_attention: int = MAX_ATTENTION) -> DataFrame:
    """items with the container that each piece goes to.

    Pieces are spread over shards by the hash of their id, as many as their number asks for; every shard
    is packed on its own. Containers are named by shard and number, so the result does not depend on how
    the tasks run. A cut text fills containers but for its rest. An empty table gives no container.
    """
    spread = items.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARD_PIECES)).alias("shards"))
    sharded = items.join(F.broadcast(spread)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("shards")).cast("int")).drop("shards")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece_no"], ignore_index=True)
        rows["container"] = best_fit(rows["tokens"].to_numpy(), capacity, max_texts, max_attention)
        return rows

    return sharded.groupBy("shard").applyInPandas(packed, "doc_id long, piece_no long, token_start long, tokens long, whole boolean, shard int, container long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens and the share of the capacity that is used; 0 for no container."""
    each = packed.groupBy("shard", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return each.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"),
        F.coalesce(F.try_divide(F.sum("tokens"), F.count("*") * capacity), F.lit(0.0)).alias("used_share"),
    )


def cut(packed: DataFrame) -> DataFrame:
    """doc_id of the texts whose pieces went to more than one container."""
    return packed.groupBy("doc_id").agg(F.count_distinct("shard", "container").alias("n")).filter("n > 1").select("doc_id")


def contents(packed: DataFrame, documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """shard, container, texts, tokens and the texts of every container in order of id and piece.

    A whole text comes as it is; of a cut one the tokens of the piece are turned back to text, where a
    character that the cut divides shows as replacement characters. Ids must be unique. A container
    holds at most its capacity, so no row grows with the table.
    """

    @F.pandas_udf("string")
    def part(text: pd.Series, start: pd.Series, n: pd.Series, whole: pd.Series) -> pd.Series:
        code = encoder(tokenizers)
        return pd.Series([t if w else code.decode(code.encode_ordinary(t)[a : a + k]) for t, a, k, w in zip(text, start, n, whole)])

    shown = packed.join(documents.select("doc_id", "text"), "doc_id").withColumn("own", part("text", "token_start", "tokens", "whole"))
    rows = shown.groupBy("shard", "container").agg(F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("doc_id", "piece_no", "own"))).alias("parts"))
    return rows.select("shard", "container", F.size("parts").alias("texts"), "tokens", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.own").alias("contents"))
