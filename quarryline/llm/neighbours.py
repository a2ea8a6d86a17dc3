"""Most similar vectors of every vector by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted file of each of
them, with that order. In a file, vectors are ranked for each query vector by the footrule distance of
the orders, and the first of them again by cosine. Pivots are drawn from the vectors, so dense places
have many; a file that is still too large is split by a second pivot of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import checkpointed

#: Pivots per square root of the number of vectors, and bounds; the index is fitted on as many vectors and the table of pivots is shared with all tasks.
PIVOTS_PER_ROOT, FEWEST, MOST = 5, 16, 32_768
#: Nearest pivots of a vector, in whose files it is posted and searched.
DEPTH = 16
#: Vectors of a file that are reranked for each query: this share of the file, and so many at least.
RERANKED_SHARE, RERANKED = 0.5, 128
#: A file of more vectors is split by the other pivots of a vector's order.
SPLIT_ABOVE = 16_384
#: Vectors of a file that are handled at once.
PART = 2048
#: Vectors are posted with 16 bits a number; cosines from them are off by less than this, and pairs so near to a threshold are computed again.
WHOLE, SLACK = 32_767.0, 1e-3


def unit(values: list) -> np.ndarray:
    """Vectors of length one, as float64."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in values])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector of the rows that take part: neither null, no null or nan inside, not all zero."""
    v = F.col(vector)
    return vectors.select(F.col(key).alias("key"), v.alias("v")).filter(
        F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    )


def vector_ids(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit name of every direction; vectors of one direction have one name."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(row.tobytes()) for row in np.round(x, 6) + 0.0], dtype=np.uint64).view(np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the nearest pivots of every vector, nearest first."""
    out = np.empty((len(x), depth), dtype=np.int32)
    for lo in range(0, len(x), 1024):
        near = x[lo : lo + 1024].astype(np.float32) @ pivots.T
        first = np.argpartition(-near, depth - 1, axis=1)[:, :depth] if depth < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
        order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
        out[lo : lo + 1024] = np.take_along_axis(first, order, 1)
    return out


def footrule_shared(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How much the orders of a and b agree: the footrule distance is depth * (depth + 1) less twice this.

    A pivot at place r weighs depth - r in its order, and 0 in an order that lacks it; the distance adds
    up the differences of weights, so shared pivots count with the smaller weight. Sums run pivot by
    pivot over the rows that hold it.
    """
    n, m = len(a), len(b)
    out = np.zeros(n * m, dtype=np.int16)

    def lists(perm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(perm, axis=None, kind="stable")
        return perm.ravel()[order], order // depth, (depth - order % depth).astype(np.int16)

    (pa, ra, wa), (pb, rb, wb) = lists(a), lists(b)
    names, starts, counts = np.unique(pa, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(pb, names, "left"), np.searchsorted(pb, names, "right")
    for s, c, l, h in zip(starts, counts, lo, hi):
        if h > l:
            rows, cols = ra[s : s + c], rb[l:h]
            out[(rows[:, None] * m + cols).ravel()] += np.minimum(wa[s : s + c, None], wb[l:h]).ravel()
    return out.reshape(n, m)


def search(q: tuple, o: tuple, size: int, k: int, least: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, object ids and cosines of the k best objects of each query among those whose orders are nearest to its own."""
    (ids_q, perm_q, x_q), (ids_o, perm_o, x_o) = q, o
    shared = footrule_shared(perm_q, perm_o, depth)
    # of a file in parts each part gives its share
    width = min(len(ids_o), max(-(-RERANKED * len(ids_o) // size), int(RERANKED_SHARE * len(ids_o)), k + 1))
    bar = np.partition(shared, len(ids_o) - width, axis=1)[:, len(ids_o) - width, None]
    cosine = x_q @ x_o.T
    cosine[(shared < bar) | (ids_q[:, None] == ids_o[None, :]) | (cosine < least)] = -9
    if least > 0:  # few are left
        r, c = np.nonzero(cosine > -9)
        return ids_q[r], ids_o[c], cosine[r, c]
    best = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(cosine.shape[1]), (len(cosine), 1))
    found = np.take_along_axis(cosine, best, 1)
    r, c = np.nonzero(found > -9)
    return ids_q[r], ids_o[best[r, c]], found[r, c]


def pivot_table(rows: DataFrame, n: int) -> np.ndarray:
    """Pivots of at most MOST vectors: the rows with the smallest hash of their key, so the draw does not depend on partitions."""
    wanted = int(min(MOST, max(FEWEST, PIVOTS_PER_ROOT * n**0.5)))
    h = F.xxhash64(F.lit(9), "key")
    share = int(min(1.0, 2.0 * wanted / max(1, n)) * (1 << 40))
    drawn = rows.filter(F.pmod(h, F.lit(1 << 40)) < share).orderBy(F.pmod(h, F.lit(1 << 40)), "key").limit(wanted).collect()
    if len(drawn) < FEWEST:
        drawn = rows.orderBy(F.pmod(h, F.lit(1 << 40)), "key").limit(wanted).collect()
    return np.unique(unit([r["v"] for r in drawn]).astype(np.float32), axis=0)


def index_hits(rows: DataFrame, n: int, k: int, least: float, depth: int = DEPTH, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """q, o and cosine of neighbours that the permutation index finds, some of them more than once.

    A split file posts a vector under its pivot with each other one of its order, so two of its vectors
    meet that share a second pivot. Files of any size go part by part.
    """
    pivots = pivot_table(rows, n)
    depth = min(depth, len(pivots))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = unit(b["v"].tolist())
                ids, first = np.unique(vector_ids(x), return_index=True)
                x = x[first]
                perm, body = nearest(x, shared.value, depth), np.round(x * WHOLE).astype(np.int16)
                yield pd.DataFrame({"vid": ids, "perm": list(perm), "body": [v.tobytes() for v in body]})

    # vectors of one direction are one
    indexed = checkpointed(rows.mapInPandas(order, "vid long, perm array<int>, body binary").groupBy("vid").agg(F.first("perm").alias("perm"), F.first("body").alias("body")))
    sizes = indexed.select(F.explode("perm").alias("p")).groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > split_above)
    large = F.array(*[F.lit(r["p"]) for r in sizes.collect()]) if not sizes.isEmpty() else None  # at most MOST numbers
    files = indexed.select("vid", "perm", "body", F.explode("perm").alias("p"))
    if large is None:
        posted = files.withColumn("other", F.lit(-1))
    else:
        hot = F.array_contains(large, F.col("p"))
        split = files.filter(hot).select("vid", "perm", "body", "p", F.explode(F.filter("perm", lambda x: x != F.col("p"))).alias("q"))
        # a pair of two large files is met under the smaller number only
        split = split.filter(~F.array_contains(large, F.col("q")) | (F.col("p") < F.col("q"))).withColumnRenamed("q", "other")
        posted = files.filter(~hot).withColumn("other", F.lit(-1)).unionByName(split)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []

        def file() -> Iterator[pd.DataFrame]:
            # the file, part by part, against itself and the parts before
            ids, perm, body = (np.concatenate(h) for h in zip(*held))
            x = body.astype(np.float32) / WHOLE
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            parts = [(ids[lo : lo + PART], perm[lo : lo + PART], x[lo : lo + PART]) for lo in range(0, len(ids), PART)]
            for a in parts:
                for b in parts:
                    q, o, c = search(a, b, len(ids), k, least, depth)
                    if len(q):
                        yield pd.DataFrame({"q": q, "o": o, "cosine": c.astype(np.float64)})

        for b in batches:
            if not len(b):
                continue
            names = np.stack([b["p"].to_numpy(), b["other"].to_numpy()], axis=1)
            ids, perm = b["vid"].to_numpy(), np.stack(b["perm"].to_numpy())
            body = np.frombuffer(b"".join(b["body"]), dtype=np.int16).reshape(len(b), -1)
            cut = np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(b))):
                if held and tuple(names[lo]) != name:
                    yield from file()
                    held.clear()
                name = tuple(names[lo])
                held.append((ids[lo:hi], perm[lo:hi], body[lo:hi]))
        if held:
            yield from file()

    met = posted.select("p", "other", "vid", "perm", "body").repartition("p", "other").sortWithinPartitions("p", "other")
    return met.mapInPandas(meet, "q long, o long, cosine double")


def neighbours(vectors: DataFrame, key: str, vector: str, k: int = 5, least: float = -1.0, depth: int = DEPTH) -> DataFrame:
    """key, neighbour, cosine and rank of the k most similar other vectors of every vector, of cosine `least` at least.

    Vectors of one direction are searched once; each of their keys has the others as neighbours of cosine
    1, smaller keys first, as at any tie. Null, empty and all-zero vectors, and vectors with a null or nan
    inside, take no part. All vectors have one length. With fewer than k others a key has fewer rows.
    The index may miss neighbours that share no pivot of their first `depth`, or whose orders differ too
    much; cosines are exact.
    """
    rows = usable(vectors, key, vector)
    n = rows.count()
    kind = dict(rows.dtypes)["key"]
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, neighbour {kind}, cosine double, rank int")

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "vid": vector_ids(unit(b["v"].tolist()))})

    named = rows.mapInPandas(name, f"key {kind}, vid long")
    hits = index_hits(rows, n, k, least - SLACK, depth)
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "o")
    # hits of one query come from several files: first the best of each file, then each other once
    near = hits.groupBy("q", "o").agg(F.max("cosine").alias("cosine")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    near = near.select("q", "o", "cosine")
    if least > -1:
        near = exact_near(checkpointed(near), rows, kind, least)
    named = checkpointed(named)
    # of each direction the first k + 1 keys are all that any result can need
    order = Window.partitionBy("vid").orderBy("key")
    firsts = named.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).groupBy("vid").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    others = near.join(firsts, near["o"] == firsts["vid"]).select("q", F.transform("keys", lambda x: F.struct((-F.col("cosine")).alias("c"), x.alias("key"))).alias("found"))
    own = firsts.filter(F.size("keys") > 1).select(F.col("vid").alias("q"), F.transform("keys", lambda x: F.struct(F.lit(-1.0).alias("c"), x.alias("key"))).alias("found"))
    lists = others.unionByName(own).groupBy("q").agg(F.flatten(F.collect_list("found")).alias("found"))
    mine = F.slice(F.array_sort(F.filter("found", lambda x: x["key"] != F.col("key"))), 1, k)
    return named.join(lists, named["vid"] == lists["q"]).select("key", F.posexplode(mine).alias("pos", "hit")).select(
        F.col("key").alias(key), F.col("hit.key").alias("neighbour"), (-F.col("hit.c")).alias("cosine"), (F.col("pos") + 1).alias("rank")
    )


def exact_near(near: DataFrame, rows: DataFrame, kind: str, least: float) -> DataFrame:
    """near without the pairs that the exact cosine puts below `least`; only pairs within SLACK of it are computed again."""
    clear, doubtful = near.filter(F.col("cosine") >= least + SLACK), near.filter(F.col("cosine") < least + SLACK)
    wanted = doubtful.select(F.explode(F.array("q", "o")).alias("vid")).distinct()

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = unit(b["v"].tolist())
                yield pd.DataFrame({"vid": vector_ids(x), "x": list(x)})

    exact = rows.mapInPandas(bodies, "vid long, x array<double>").join(wanted, "vid", "left_semi").groupBy("vid").agg(F.first("x").alias("x"))
    a, b = exact.select(F.col("vid").alias("q"), F.col("x").alias("xq")), exact.select(F.col("vid").alias("o"), F.col("x").alias("xo"))
    dot = F.aggregate(F.zip_with("xq", "xo", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    again = doubtful.join(a, "q").join(b, "o").select("q", "o", dot.alias("cosine")).filter(F.col("cosine") >= least)
    return clear.unionByName(again)


def close_pairs(vectors: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """Pairs of keys, smaller first, of cosine `least` at least, of which one has the other among its k most similar."""
    found = neighbours(vectors, key, vector, k, least)
    return found.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()
