"""Near-duplicate texts by a self-join of binary tries, checked exactly.

Similarity is that of the sets of adjacent words. Every distinct set gets a sketch of bits, of which two
sets differ in about half the dissimilarity. Sketches of sets that share a rare piece are put into a
binary trie of that piece; the trie is joined with itself: pairs of nodes go down together, add up the
bits in which they differ and are dropped when these exceed the error budget. Below a node of few
sketches a trie does not branch; two such nodes are compared as one table of 64-bit words. What reaches
the leaves is checked on the words.

Which pieces root a trie follows from the threshold: ordered from rare to common, two sets that are
similar enough share one of their first pieces, so no similar pair is in no trie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import checkpointed

#: Words of a piece, and similarity from which two texts are near-duplicates, where a query names none.
WORDS, SIMILARITY = 5, 0.8
#: Bits of a sketch, and bits by which the tries go down: small steps where nodes are shared, then the paths that no longer branch in longer ones.
BITS, STEPS = 128, (8, 8, 16, 32, 64)
#: Classes of size that a ratio of sizes equal to the threshold spans.
CLASSES = 2
#: Buckets of the histogram of pieces by which rare ones come first; one array of this size is shared with all tasks.
HISTOGRAM, SEGMENTS = 1 << 20, 64
#: Deviations by which the error budget exceeds the expected number of differing bits.
DEVIATIONS = 5.0
#: Sketches of a trie that are joined at once, a larger one part by part; pairs of sketches at hand at most; postings gathered before tries are joined.
PART, PAIRS, GATHERED = 1024, 4_000_000, 100_000
#: A trie of more sketches is not joined where it was gathered but spread over tasks, in blocks of so many sketches.
SPREAD = 65_536
#: Nodes of at most LEAF sketches do not branch; two of them are compared in one table, or with others at once where they make at most FEW pairs.
LEAF, FEW = 256, 600

_WORD = re.compile("[a-z0-9]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes, scrambled."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Pieces:
    """Hashed sets of adjacent words; the hashes of words are kept as long as the process lives, up to a bound."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes; empty for a text of fewer words."""
        from xxhash import xxh3_64_intdigest

        found, known = _WORD.findall(text.lower()), self.known
        if len(found) < self.words:
            return np.empty(0, dtype=np.uint64)
        if len(known) > 500_000:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in found), dtype=np.uint64, count=len(found))
        n = len(h) - self.words + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.words):
            out = mixed(out * _MIX + h[k : k + n])
        return np.unique(out)


def set_id(kind: str, pieces: np.ndarray) -> int:
    """Signed 64-bit name of a set of one kind."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(pieces.tobytes(), seed=hash_name(kind))).astype(np.int64))


def sketch(pieces: np.ndarray) -> np.ndarray:
    """BITS bits: pieces are spread over as many bins by hash, a bin gives a bit of its smallest piece, an empty one gives 0."""
    bins = (pieces >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    first = np.unique(bins, return_index=True)  # pieces are sorted and bins are their top bits, so the first is the smallest
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[first[0]] = (mixed(pieces[first[1]]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits)


def prefix(n: int, similarity: float) -> int:
    """Of n pieces the first so many: similar sets share one of them."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def leading(n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which places of a root are those that the smaller of two similar sets can have their first common piece at."""
    return place <= n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)


def budgets(similarity: float) -> list[int]:
    """Error budget at every depth: expected differing bits at the threshold, plus deviations."""
    p = (1 - similarity) / 2
    return [math.ceil(b * p + DEVIATIONS * math.sqrt(b * p * (1 - p))) for b in np.cumsum(STEPS)]


def budget_of_sizes(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Error budget of a whole sketch by the number of pieces of both sets.

    Bins that neither set has a piece in agree. In another one the smallest piece of both sets together is in
    both with the similarity as probability; else the bits differ every second time.
    """
    p = (1 - similarity) / 2 * (1 - (1 - 1 / BITS) ** (sizes / (1 + similarity)))
    return np.ceil(BITS * p + DEVIATIONS * np.sqrt(BITS * p * (1 - p)))


def words_of(sketches: list[bytes]) -> np.ndarray:
    """A row per sketch with its bits in STEPS, as unsigned numbers."""
    raw = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), BITS // 8).astype(np.uint64)
    out, at = [], 0
    for step in STEPS:
        word = np.zeros(len(raw), dtype=np.uint64)
        for k in range(at // 8, (at + step) // 8):
            word = (word << np.uint64(8)) | raw[:, k]
        out.append(word)
        at += step
    return np.stack(out, axis=1)


def size_class(n: np.ndarray, similarity: float) -> np.ndarray:
    """Class of sizes; sets that are similar enough differ by at most CLASSES classes."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(similarity) * CLASSES * (1 - 1e-9)).astype(np.int64)


def levels(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For rows sorted by columns: of each level the first row of every node, and of every node the first of its children, with the end."""
    new, firsts = np.zeros(len(columns[0]), dtype=bool), []
    new[0] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        firsts.append(np.append(np.flatnonzero(new), len(c)))
    firsts.append(np.arange(len(columns[0]) + 1))  # below the leaves the single rows
    return firsts, [np.searchsorted(below, above) for above, below in zip(firsts, firsts[1:])]


def expanded(fa: np.ndarray, ta: np.ndarray, fb: np.ndarray, tb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of fa..ta with all of fb..tb, for every place, and the place."""
    width = tb - fb
    total = (ta - fa) * width
    place = np.repeat(np.arange(len(total)), total)
    within = np.arange(len(place)) - np.repeat(np.cumsum(total) - total, total)
    down = within // width[place]
    return fa[place] + down, fb[place] + within - down * width[place], place


def head(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """The first 64 bits of sketches in STEPS as one number, and the depth that they reach; of other sketches their first number."""
    if bits.shape[1] != len(STEPS):
        return bits[:, 0], 0
    out, depth = bits[:, 0], int(np.searchsorted(np.cumsum(STEPS), 64))
    for k in range(1, depth + 1):
        out = (out << np.uint64(STEPS[k])) | bits[:, k]
    return out, depth


def trie_join(a: tuple, b: tuple | None, errors: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sketches under one root that differ in no more bits than the budget of every depth.

    a and b are roots, size classes and sketches, rows of a number per step. Without b, of a and later
    ones of a under the same root; with b, of a and b, which have one root. A node of a trie is a run of
    sorted rows that begin alike: root, size class, then the words of the sketch. Pairs of nodes go down
    together to the pairs of their children; they are dropped when the size classes are too far apart or
    the bits in which they differ, added up, exceed the budget. All tries go down at once.
    Two nodes that do not branch are compared by the first 64 bits of all their sketches; what is left of
    these pairs goes down depth by depth, so the pairs are those of a trie that branches.
    """
    sides = []
    for roots, classes, bits in (a,) if b is None else (a, b):
        order = np.lexsort((*bits.T[::-1], classes, roots))
        columns = [roots[order], classes[order], *bits[order].T]
        sides.append((order, columns, *levels(columns), *head(bits[order])))
    (order_a, ca, fa, da, ha, depth), (order_b, cb, fb, db, hb, _) = sides[0], sides[-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def checked(x: np.ndarray, y: np.ndarray) -> None:
        ok = np.abs(ca[1][x] - cb[1][y]) <= CLASSES
        x, y = x[ok], y[ok]
        spent = np.zeros(len(x), dtype=np.int64)
        for k, most in enumerate(errors):
            spent = spent + np.bitwise_count(ca[k + 2][x] ^ cb[k + 2][y])
            ok = spent <= most
            x, y, spent = x[ok], y[ok], spent[ok]
        found.append((x, y))

    def compared(la: np.ndarray, ua: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> None:
        few = (ua - la) * (ub - lb) <= FEW
        x, y, _ = expanded(la[few], ua[few], lb[few], ub[few])
        ok = np.bitwise_count(ha[x] ^ hb[y]) <= errors[depth]
        if b is None:
            ok &= x < y
        checked(x[ok], y[ok])
        xs, ys = [], []
        for lo, hi, low, high in zip(*(v[~few].tolist() for v in (la, ua, lb, ub))):
            x, y = np.nonzero(np.bitwise_count(ha[lo:hi, None] ^ hb[None, low:high]) <= errors[depth])
            x, y = x + lo, y + low
            if b is None:
                x, y = x[x < y], y[x < y]
            xs.append(x)
            ys.append(y)
        if xs:
            checked(np.concatenate(xs), np.concatenate(ys))

    na = nb = np.arange(len(fa[0]) - 1)
    cost = np.zeros(len(na), dtype=np.int64)
    for k in range(len(da)):
        la, ua, lb, ub = fa[k][na], fa[k][na + 1], fb[k][nb], fb[k][nb + 1]
        leaf = (np.maximum(ua - la, ub - lb) <= LEAF) | (k == len(da) - 1)
        compared(la[leaf], ua[leaf], lb[leaf], ub[leaf])
        na, nb, cost = na[~leaf], nb[~leaf], cost[~leaf]
        if not len(na):
            break
        xa, xb, place = expanded(da[k][na], da[k][na + 1], db[k][nb], db[k][nb + 1])
        if b is None:
            ahead = xa <= xb
            xa, xb, place = xa[ahead], xb[ahead], place[ahead]
        left, right = ca[k + 1][fa[k + 1][xa]], cb[k + 1][fb[k + 1][xb]]
        if k == 0:
            alive = np.abs(left - right) <= CLASSES
            cost = np.zeros(int(alive.sum()), dtype=np.int64)
        else:
            spent = cost[place] + np.bitwise_count(left ^ right)
            alive = spent <= errors[k - 1]
            cost = spent[alive]
        na, nb = xa[alive], xb[alive]
    return order_a[np.concatenate([x for x, _ in found])], order_b[np.concatenate([y for _, y in found])]


def histogram(texts: DataFrame, words: int) -> np.ndarray:
    """How many pieces of all texts fall into each of HISTOGRAM buckets; the size does not depend on the texts.

    Every task sends its counts in segments, which are added up as they come.
    """
    part = HISTOGRAM // SEGMENTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, n = Pieces(words), np.zeros(HISTOGRAM, dtype=np.int64)
        for rows in batches:
            got = [pieces(t) for t in rows["text"] if t]
            if got:
                n += np.bincount((np.concatenate(got) % np.uint64(HISTOGRAM)).astype(np.int64), minlength=HISTOGRAM)
        n = np.minimum(n, np.iinfo(np.int32).max).astype(np.int32).reshape(SEGMENTS, part)
        yield pd.DataFrame({"segment": range(SEGMENTS), "counts": [x.tobytes() for x in n]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for k, c in zip(rows["segment"], rows["counts"]):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, dtype=np.int32).astype(np.int64)
        if sums:
            yield pd.DataFrame({"segment": list(sums), "counts": [np.minimum(x, np.iinfo(np.int32).max).astype(np.int32).tobytes() for x in sums.values()]})

    schema = "segment int, counts binary"
    summed = texts.select("text").mapInPandas(count, schema).repartition(SEGMENTS // 4, "segment").mapInPandas(add, schema)
    out = np.zeros((SEGMENTS, part), dtype=np.int32)
    for r in summed.collect():  # SEGMENTS rows, HISTOGRAM numbers
        out[r["segment"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.ravel()


def postings(texts: DataFrame, words: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """Per distinct set and piece that roots a trie: root, id, number of pieces, place of the root among them and sketch.

    A set that several texts of a partition share is given once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, rank, seen = Pieces(words), shared.value, set()
        for rows in batches:
            roots, ids, sizes, places, bits = [], [], [], [], []
            for kind, text in zip(rows["kind"], rows["text"]):
                own = pieces(text) if text else ()
                if not len(own) or (i := set_id(kind, own)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(i)
                common = rank[(own % np.uint64(HISTOGRAM)).astype(np.int64)]
                first = own[np.lexsort((own, common))[: prefix(len(own), similarity)]]
                # kinds never meet, as the kind is part of the root
                roots.append((first * np.uint64(2 * abs(hash_name(kind)) + 1)).view(np.int64))
                ids.append(np.full(len(first), i))
                sizes.append(np.full(len(first), len(own), dtype=np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
                bits += [sketch(own).tobytes()] * len(first)
            if roots:
                yield pd.DataFrame({"root": np.concatenate(roots), "id": np.concatenate(ids), "pieces": np.concatenate(sizes), "place": np.concatenate(places), "bits": bits})

    return texts.select("kind", "text").mapInPandas(post, "root long, id long, pieces int, place int, bits binary")


def hash_name(name: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(name) >> 8


def candidates(posted: DataFrame, similarity: float, spread: int = SPREAD) -> DataFrame:
    """Pairs of set ids, smaller first, that some trie brings to its leaves within the error budget, and that of their sizes, once each.

    Postings are sorted by root. Small tries go down together; a trie of more than PART sketches is joined
    part by part, so the work at hand is bounded. A trie of more than spread sketches is passed on instead:
    its sketches are dealt to blocks and every two blocks meet in a task of their own. A pair also has to
    have sizes that allow the similarity, and enough pieces left from the shared root on.
    """
    errors = budgets(similarity)

    def met(x: np.ndarray, y: np.ndarray, a: tuple, b: tuple) -> pd.DataFrame:
        i, j, n, m = a[1][x], b[1][y], a[2][x], b[2][y]
        least = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
        ok = (i != j) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(n - a[3][x], m - b[3][y]) >= least)
        spent = np.bitwise_count(a[4][x[ok]] ^ b[4][y[ok]]).sum(axis=1)
        ok[ok] = spent <= budget_of_sizes(n[ok] + m[ok], similarity)
        i, j = i[ok], j[ok]
        return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)}).drop_duplicates()

    def joined(p: tuple, q: tuple | None) -> pd.DataFrame:
        side = lambda x: (x[0], size_class(x[2], similarity), x[4])
        return met(*trie_join(side(p), None if q is None else side(q), errors), p, p if q is None else q)

    def read(b: pd.DataFrame) -> tuple:
        return (*(b[c].to_numpy() for c in ("root", "id", "pieces", "place")), words_of(list(b["bits"])))

    def packed(rows: tuple, at: np.ndarray) -> pd.DataFrame:
        """Postings as they came."""
        raw = np.concatenate([rows[4][at, k].astype(f">u{step // 8}").view(np.uint8).reshape(len(at), -1) for k, step in enumerate(STEPS)], axis=1)
        return pd.DataFrame({"root": rows[0][at], "id": rows[1][at], "pieces": rows[2][at], "place": rows[3][at], "bits": [x.tobytes() for x in raw]})

    def cut_up(rows: tuple) -> list[tuple[bool, tuple]]:
        """Parts of a trie, and whether its rows lead; two that don't are in no pair by this root."""
        lead = leading(rows[2], rows[3], similarity)
        out = []
        for own in (True, False):
            some = tuple(x[lead == own] for x in rows)
            out += [(own, tuple(x[k : k + PART] for x in some)) for k in range(0, len(some[0]), PART)]
        return out

    def in_parts(rows: tuple) -> Iterator[pd.DataFrame]:
        parts = cut_up(rows)
        for n, (lead, p) in enumerate(parts):
            if lead:
                yield joined(p, None)
            for first, q in parts[:n]:
                if lead or first:
                    yield joined(p, q)

    def tries(rows: tuple) -> Iterator[pd.DataFrame]:
        # rows hold whole tries: roots, ids, sizes, places, sketches; a set that several partitions posted counts once
        order = np.lexsort((rows[1], rows[0]))
        again = (rows[0][order[1:]] == rows[0][order[:-1]]) & (rows[1][order[1:]] == rows[1][order[:-1]])
        rows = tuple(x[order[np.append(True, ~again)]] for x in rows)
        cut = np.flatnonzero(np.diff(rows[0])) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(rows[0]))
        width = ends - starts
        small = (width > 1) & (width <= PART)
        keep = np.repeat(small, width)
        few = tuple(x[keep] for x in rows)
        # as many tries at once as make a bounded number of pairs at the first level
        pairs = np.cumsum(width[small].astype(np.int64) ** 2)
        bounds = np.cumsum(width[small])
        done = taken = 0
        while done < len(bounds):
            upto = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + PAIRS, "right")))
            part = tuple(x[taken : bounds[upto - 1]] for x in few)
            done, taken = upto, bounds[upto - 1]
            yield joined(part, None)
        for lo, hi in zip(starts[width > PART], ends[width > PART]):
            yield from in_parts(tuple(x[lo:hi] for x in rows))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, large = 0, None
        for b in batches:
            if not len(b):
                continue
            new = read(b)
            if large is not None:  # a trie that is passed on, row by row as it comes
                more = int(np.searchsorted(new[0], large, "right"))
                if more:
                    yield packed(new, np.arange(more))
                if more == len(b):
                    continue
                new, large = tuple(x[more:] for x in new), None
            held.append(new)
            size += len(new[0])
            if size < GATHERED:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last trie may go on
            yield from whole(tuple(x[:last] for x in rows))
            rest = tuple(x[last:] for x in rows)
            held, size = [rest], min(len(rest[0]), GATHERED // 2)
            if len(rest[0]) > spread:
                yield packed(rest, np.arange(len(rest[0])))
                held, size, large = [], 0, rest[0][0]
        if held:
            yield from whole(tuple(np.concatenate(x) for x in zip(*held)))

    def whole(rows: tuple) -> Iterator[pd.DataFrame]:
        if not len(rows[0]):
            return
        _, place, width = np.unique(rows[0], return_inverse=True, return_counts=True)
        big = width[place] > spread
        if big.any():
            yield packed(rows, np.flatnonzero(big))
            rows = tuple(x[~big] for x in rows)
        if len(rows[0]):
            yield from tries(rows)

    # a and b of a pair, or a posting that is passed on
    schema = "a long, b long, root long, id long, pieces int, place int, bits binary"
    order = schema.replace(",", "").split()[::2]

    def filled(f):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for out in f(batches):
                if len(out):
                    yield out.reindex(columns=order).astype({c: "Int64" for c in ("a", "b", "root", "id")} | {c: "Int32" for c in ("pieces", "place")})

        return rows

    first = checkpointed(posted.repartition("root").sortWithinPartitions("root").mapInPandas(filled(join), schema))
    pairs = first.filter("a is not null").select("a", "b")
    passed = first.filter("root is not null").select("root", "id", "pieces", "place", "bits").dropDuplicates(["root", "id"])
    if passed.isEmpty():
        return pairs.distinct()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Two blocks of one root, or one with itself, that come one after the other."""
        name, held = None, []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                rows = tuple(np.concatenate(x) for x in zip(*held))
                held.clear()
                sides = [tuple(x[rows[5] == side] for x in rows[:5]) for side in sorted({name[1], name[2]})]
                if len(sides) == 1:
                    yield from in_parts(sides[0])
                else:
                    others = cut_up(sides[1])
                    for lead, p in cut_up(sides[0]):
                        for first, q in others:
                            if lead or first:
                                yield joined(p, q)

        for b in batches:
            if not len(b):
                continue
            names = b[["root", "lo", "hi"]].to_numpy()
            new = (*read(b), b["block"].to_numpy())
            cut = np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(b))):
                if name != tuple(names[lo]):
                    yield from flush()
                    name = tuple(names[lo])
                held.append(tuple(x[lo:hi] for x in new))
        yield from flush()

    counts = passed.groupBy("root").agg(F.ceil(F.count("*") / (spread // 2)).cast("int").alias("blocks"))
    dealt = passed.join(counts, "root").withColumn("block", F.pmod("id", "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "pieces", "place", "bits")
    more = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInPandas(meet, "a long, b long")
    return pairs.unionByName(more).distinct()


def jaccard(words: int):
    """Exact similarity of two texts."""

    @F.pandas_udf("double")
    def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pieces = Pieces(words)
        for left, right in pairs:
            out, last, own = [], None, None
            for a, b in zip(left, right):
                if a is not last:
                    last, own = a, pieces(a)
                other = pieces(b)
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(both / max(1, len(own) + len(other) - both))
            yield pd.Series(out, dtype=float)

    return similarity


def set_name(words: int):
    """Id of the set of a text, null for a text too short for a piece."""

    @F.pandas_udf("long")
    def name(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pieces = Pieces(words)
        for kinds, rows in batches:
            got = (pieces(t) if t else () for t in rows)
            yield pd.Series([set_id(k, p) if len(p) else None for k, p in zip(kinds, got)], dtype="Int64")

    return name


def identified(texts: DataFrame, words: int) -> DataFrame:
    """kind, key and id of the set of every text; texts too short for a piece are left out."""
    return texts.select("kind", "key", set_name(words)("kind", "text").alias("id")).filter("id is not null")


def similar_sets(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets with their exact similarity, and the texts with the id of their set.

    texts has kind, key and text; only texts of one kind are compared.
    """
    texts = texts.filter("text is not null and key is not null")
    named = checkpointed(identified(texts, words))
    pairs = checkpointed(candidates(postings(texts, words, similarity, histogram(texts, words)), similarity))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # the text of each set in a pair, from the first of its keys
    chosen = named.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("kind", "key")).alias("first")).select("id", "first.kind", "first.key")
    # a key may be repeated with another text, so the set of the text is named again
    candidates_of = chosen.join(texts, ["kind", "key"])
    same = candidates_of.withColumn("own", set_name(words)("kind", "text"))
    shown = checkpointed(same.filter("id = own").groupBy("id").agg(F.min("text").alias("text")))
    a, b = shown.select(F.col("id").alias("a"), F.col("text").alias("text_a")), shown.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    exact = pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(words)("text_a", "text_b").alias("similarity"))
    return exact.filter(F.col("similarity") >= similarity - 1e-9), named


def pairs(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """kind, key_a, key_b of all pairs of keys with at least the given similarity, key_a < key_b.

    Equal sets, so also copies, have similarity 1. Null texts and keys and texts of fewer words than a
    piece are in no pair; repeated keys count once.
    """
    exact, named = similar_sets(texts, words, similarity)
    named = named.distinct()
    members_a = named.select("kind", F.col("key").alias("ka"), F.col("id").alias("a"))
    members_b = named.select("kind", F.col("key").alias("kb"), F.col("id").alias("b"))
    different = exact.select("a", "b").join(members_a, "a").join(members_b, ["b", "kind"])
    copies = members_a.join(members_b.withColumnRenamed("b", "a"), ["a", "kind"]).filter("ka < kb").withColumn("b", F.col("a"))
    both = different.select("kind", "ka", "kb").unionByName(copies.select("kind", "ka", "kb"))
    return both.select("kind", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id of its component, for the ids of a, b edges.

    Large-star and small-star take turns until no edge changes, as many rounds as that takes; each round
    is checkpointed. A large-star links the larger neighbours of an id to its smallest one, a small-star
    the others, so components stay whole and end as stars. Rounds follow the logarithm of the number of
    ids (squared at worst), not the path.
    """
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("a").alias("label"))
    # from each id to a smaller one; an id alone is linked to itself
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ids = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).distinct()
    links = links.filter("u <> v")
    before = mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.filter("u <> v").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    return ids.join(links, ids["id"] == links["u"], "left").select("id", F.coalesce("v", "id").alias("label"))


def groups(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """kind, key, group_id and links of every text: the smallest key of all that near-duplicates connect it with, and with how many other keys it is similar.

    A text without a near-duplicate is a group of its own; null and shorter texts are left out, repeated
    keys count once. Copies are counted, not paired.
    """
    exact, named = similar_sets(texts, words, similarity)
    exact, named = checkpointed(exact), named.distinct()
    sizes = named.groupBy("id").agg(F.count("*").alias("copies"))
    ends = exact.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(exact.select(F.col("b").alias("id"), F.col("a").alias("other")))
    linked = ends.join(sizes.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("copies").alias("near"))
    placed = named.join(sizes, "id").join(linked, "id", "left").join(components(exact), "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = placed.groupBy("label").agg(F.min("key").alias("group_id"))
    return placed.join(first, "label").select("kind", "key", "group_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))


def texts_of(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """kind, key and text of several tables, each given as table, kind, key and text."""
    out = None
    for df, kind, key, text in parts:
        one = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out

