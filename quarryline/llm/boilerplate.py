"""Page furniture told from the body by a graphical model on the tree of a page.

A page is a tree: page, regions (tables and the text between), blocks (runs of lines of one layout),
lines. Every node has a label. Parent and child are tied by potentials, lines also by how their words and
layout look; sum-product messages from the lines to the page and back give each line its probability to
belong to the body.

No list of words says what furniture is. The labelled pages are those that are a table: what is neither
caption nor row of it came from the page around. The same furniture stands on all pages, so a first model
that tells these lines from all others gives it about the same score there, and body lines none; lines of
other pages are labelled by that score, and the model is fitted again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many pages are used for training, those with the smallest hash of their key.
PAGES = 10_000
#: A page is a labelled one if so large a share of its lines are rows or captions of a table.
TABLE_SHARE = 0.5
#: A word is known from so many lines on; rounds and lines of a step of training; how often lines are labelled anew; smoothing of the potentials.
LEAST_LINES, ROUNDS, STEP, FITS, SMOOTH = 3, 10, 256, 4, 1.0
#: Lines of other pages that score between these shares of what labelled lines score are left out of the next fit.
DOUBT = (0.02, 0.1)
#: Power of the potential between block and line: words of a line and its block tell partly the same.
TEMPER = 0.5
#: Lines below this probability of belonging to the body are furniture.
BODY = 0.5

_WORD = re.compile(r"[A-Za-zÀ-ÿ]+|\d[\d,.]*|[^\sA-Za-zÀ-ÿ\d]")
#: Layouts of lines; lines of one layout that follow each other form a block.
LAYOUTS = ("table", "long", "sentence", "short")


def layout(line: str) -> int:
    text = line.strip()
    if text.startswith(("|", "[Table")):
        return 0
    if len(text) > 120:
        return 1
    return 2 if text.endswith((".", ";", "?", "!", ":")) and len(text) > 25 else 3


def features(line: str) -> set[str]:
    """Names of a line's features: its words, how it begins and ends, its length and its signs."""
    text = line.strip()
    found = _WORD.findall(text)
    low = lambda w: "0" if w[0].isdigit() else w.lower()
    out = {"w=" + low(w) for w in set(found)}
    if found:
        out |= {"first=" + low(found[0]), "last=" + low(found[-1])}
    n = len(found)
    if n <= 6:
        out.add("is=" + re.sub(r"\d[\d,.]*", "0", text.lower()))
    return out | signs(text, n)


def signs(text: str, n: int) -> set[str]:
    """Features of layout of a stripped line of n words."""
    end = text[-1:]
    out = {f"n={n if n < 5 else 8 if n < 9 else 14 if n < 15 else 30 if n < 31 else 99}", f"layout={layout(text)}", f"end={end if not end.isalnum() else 'a'}"}
    if n < 40:
        out |= {"has=" + sign for sign in (" | ", " > ", "  ", " / ", "»", "•", "©") if sign in text[1:]}
        if text.isupper():
            out.add("upper")
        if sum(c.isdigit() for c in text) * 3 > len(text):
            out.add("digits")
    return out


def numbers(line: str, words: dict[str, int]) -> list[int]:
    """Numbers of a line's known features; an unknown word counts as a name or another word."""
    text = line.strip()
    found = _WORD.findall(text)
    get, out = words.get, set()
    for w in set(found):
        if (k := get("w=" + w.lower()) if not w[0].isdigit() else words["w=0"]) is None:
            k = words["w=NAME"] if w[0].isupper() else words["w=other"]
        out.add(k)
    for at, w in (("first=", found[0]), ("last=", found[-1])) if found else ():
        k = get(at + ("0" if w[0].isdigit() else w.lower()))
        out.add(words[at + ("NAME" if w[0].isupper() else "other")] if k is None else k)
    n = len(found)
    if n <= 6 and (k := get("is=" + re.sub(r"\d[\d,.]*", "0", text.lower()))) is not None:
        out.add(k)
    out.update(k for f in signs(text, n) if (k := get(f)) is not None)
    return sorted(out)


@dataclass(frozen=True)
class Model:
    """Weights of known features, and log potentials of line given block, block given region and layout, region given page and kind, and page."""

    words: dict[str, int]
    weights: np.ndarray
    line: np.ndarray
    block: np.ndarray
    region: np.ndarray
    page: np.ndarray


@dataclass(frozen=True)
class Tree:
    """Block of every line (-1 for an empty one), layout and region of every block, kind of every region: 0 table, 1 text."""

    blocks: np.ndarray
    layouts: np.ndarray
    regions: np.ndarray
    kinds: np.ndarray


def tree(lines: list[str]) -> Tree:
    """Tree of a page; empty lines part blocks."""
    blocks, layouts, regions, kinds, last = [], [], [], [], -1
    for text in lines:
        if not text.strip():
            blocks.append(-1)
            last = -1
            continue
        kind = layout(text)
        if kind != last:
            if not kinds or kinds[-1] != int(kind > 0):
                kinds.append(int(kind > 0))
            layouts.append(kind)
            regions.append(len(kinds) - 1)
            last = kind
        blocks.append(len(layouts) - 1)
    return Tree(*(np.array(x, dtype=np.int64) for x in (blocks, layouts, regions, kinds)))


def logistic(rows: list[list[int]], labels: np.ndarray, size: int) -> np.ndarray:
    """Weights of a regularised logistic regression by adaptive steps."""
    w, squares = np.zeros(size), np.full(size, 1e-3)
    rng = np.random.RandomState(3)
    lengths = np.array([len(r) for r in rows])
    starts, flat = np.concatenate([[0], np.cumsum(lengths)]), np.array([i for r in rows for i in r], dtype=np.int64)
    usable = np.flatnonzero(lengths > 0)
    for _ in range(ROUNDS):
        order = rng.permutation(usable)
        for lo in range(0, len(order), STEP):
            part = order[lo : lo + STEP]
            n = lengths[part]
            at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            own = flat[at]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[own], np.concatenate([[0], np.cumsum(n)[:-1]])), -30, 30)))
            g = np.bincount(own, weights=np.repeat(p - labels[part], n), minlength=size) + 1e-4 * w
            squares += g * g
            w -= 0.5 * g / np.sqrt(squares)
    return w


def from_table_pages(split: list[list[str]]) -> list[np.ndarray]:
    """Per page which of its lines the labelling knows to be furniture: on a page that is a table, what is no part of it."""
    out = []
    for lines in split:
        table = np.array([layout(x) == 0 for x in lines if x.strip()], dtype=bool)
        known = len(table) and table.mean() >= TABLE_SHARE
        out.append(np.array([bool(known and x.strip() and layout(x) != 0) for x in lines], dtype=bool))
    return out


def fit(pages: list[str]) -> Model:
    """Model from pages, of which those that are a table are labelled."""
    split = [p.split("\n") for p in pages]
    counts: Counter[str] = Counter()
    for lines in split:
        for x in lines:
            if x.strip():
                counts.update(features(x))
    known = sorted(f for f, n in counts.items() if n >= LEAST_LINES or not f.startswith(("w=", "first=", "last=", "is=")))
    names = {f: n for n, f in enumerate([*dict.fromkeys([*known, *(f"{k}={v}" for k in ("w", "first", "last") for v in ("NAME", "other", "0"))])])}
    sure = from_table_pages(split)
    rows = [numbers(x, names) for lines in split for x in lines if x.strip()]
    told = np.array([t for lines, own in zip(split, sure) for x, t in zip(lines, own) if x.strip()], dtype=bool)
    table = np.array([layout(x) == 0 for lines in split for x in lines if x.strip()], dtype=bool)
    flat, lengths = np.array([i for r in rows for i in r], dtype=np.int64), np.array([len(r) for r in rows], dtype=np.int64)
    weights, furniture, clear = np.zeros(len(names)), told.copy(), np.ones(len(told), dtype=bool)
    for n in range(FITS if told.any() else 0):
        weights = logistic([r for r, c in zip(rows, clear) if c], (~furniture[clear]).astype(float), len(names))
        p = 1 / (1 + np.exp(np.clip(np.bincount(np.repeat(np.arange(len(rows)), lengths), weights=weights[flat], minlength=len(rows)), -30, 30)))
        # at first only lines of labelled pages count as furniture, so furniture elsewhere scores about the share of them that is labelled
        low, high = (x * p[told].mean() for x in DOUBT) if n == 0 else (DOUBT[0], 0.5)
        furniture = ((p >= high) | told) & ~table
        clear = furniture | (p < low) | table
    if not told.any():
        weights[:] = 0
    line, block, region, page = np.full((2, 2), SMOOTH), np.full((2, len(LAYOUTS), 2), SMOOTH), np.full((2, 2, 2), SMOOTH), np.full(2, SMOOTH)
    at = 0
    for lines in split:
        t, n = tree(lines), sum(1 for x in lines if x.strip())
        said = 1 - furniture[at : at + n].astype(int)
        at += n
        if not n:
            continue
        own = t.blocks[t.blocks >= 0]
        most = lambda ids, labels, size: (np.bincount(ids, weights=labels, minlength=size) * 2 >= np.bincount(ids, minlength=size)).astype(int)
        of_block = most(own, said, len(t.layouts))
        of_region = most(t.regions[own], said, len(t.kinds))
        top = int(said.all())
        page[top] += 1
        np.add.at(region, (top, t.kinds, of_region), 1)
        np.add.at(block, (of_region[t.regions], t.layouts, of_block), 1)
        np.add.at(line, (of_block[own], said), 1)
    share = np.array([furniture.mean() if len(furniture) else 0.5, 1 - furniture.mean() if len(furniture) else 0.5]).clip(1e-6)
    normal = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    if not told.any():  # nothing is known to be furniture
        weights[[names[f] for f in names if f.startswith("layout=")]] = 30
    return Model(names, weights, TEMPER * (normal(line) - np.log(share)), normal(block), normal(region), normal(page))


def marginals(lines: list[str], model: Model, score) -> list[float]:
    """Probability of every line to belong to the body; nan for an empty line.

    score gives a line's log odds. Messages go up from lines to blocks, regions and the page, and down again.
    """
    t = tree(lines)
    if not len(t.layouts):
        return [float("nan")] * len(lines)
    real = t.blocks >= 0
    at = t.blocks[real]
    own = np.array([(0.0, score(x)) for x, b in zip(lines, t.blocks) if b >= 0])

    def up(child: np.ndarray, tie: np.ndarray, parent: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """What every child tells its parent, by the parent's label, and the sum at each parent; tie is child, parent label, child label."""
        told = np.logaddexp(tie[:, :, 0] + child[:, :1], tie[:, :, 1] + child[:, 1:])
        total = np.zeros((size, 2))
        np.add.at(total, parent, told)
        return told, total

    line_tie = np.broadcast_to(model.line, (len(at), 2, 2))
    block_tie = model.block[:, t.layouts, :].transpose(1, 0, 2)
    region_tie = model.region[:, t.kinds, :].transpose(1, 0, 2)
    line_told, blocks = up(own, line_tie, at, len(t.layouts))
    block_told, regions = up(blocks, block_tie, t.regions, len(t.kinds))
    region_told, top = up(regions, region_tie, np.zeros(len(t.kinds), dtype=np.int64), 1)

    def down(belief: np.ndarray, told: np.ndarray, tie: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """What the rest of the tree tells each child, by the child's label."""
        rest = belief[parent] - told
        return np.logaddexp(tie[:, 0, :] + rest[:, :1], tie[:, 1, :] + rest[:, 1:])

    to_regions = down(model.page + top, region_told, region_tie, np.zeros(len(t.kinds), dtype=np.int64))
    to_blocks = down(to_regions + regions, block_told, block_tie, t.regions)
    both = own + down(to_blocks + blocks, line_told, line_tie, at)
    out = np.full(len(lines), np.nan)
    out[real] = 1 / (1 + np.exp(-np.clip(both[:, 1] - both[:, 0], -50, 50)))
    return out.tolist()


def lines(pages: DataFrame, key: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """Every line that is not empty, with its number from 0 and its probability to belong to the body.

    Lines end at line feeds. Null and empty texts have no lines. Every text is read whole; only training
    is bounded, to PAGES pages. Rows with a null key keep it.
    """
    n = max(1, pages.count())
    h = F.pmod(F.xxhash64(F.lit(5), F.col(key).cast("string")), F.lit(1 << 40))
    share = int(min(1.0, 1.5 * PAGES / n) * (1 << 40))
    drawn = pages.select(F.col(text).alias("t"), h.alias("h")).filter(F.col("t").isNotNull() & (F.col("h") < share)).orderBy("h", "t").limit(PAGES).collect()
    model = fit([r["t"] for r in drawn])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # as many weights as features of the sample

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        seen: dict[str, float] = {}

        def score(x: str) -> float:
            if (s := seen.get(x)) is None:
                s = float(own.weights[numbers(x, own.words)].sum())
                if len(x) < 100 and len(seen) < 200_000:
                    seen[x] = s
            return s

        for rows in batches:
            keys, places, texts, ps = [], [], [], []
            for k, t in zip(rows["k"], rows["t"]):
                if not t:
                    continue
                own_lines = t.split("\n")
                for no, (x, p) in enumerate(zip(own_lines, marginals(own_lines, own, score))):
                    if p == p:
                        keys.append(k)
                        places.append(no)
                        texts.append(x)
                        ps.append(p)
            if keys:
                yield pd.DataFrame({"k": keys, "line_no": np.array(places, dtype=np.int32), "line": texts, "p_body": np.array(ps, dtype=float)})

    kind = dict(pages.dtypes)[key]
    found = pages.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(infer, f"k {kind}, line_no int, line string, p_body double")
    return found.withColumnRenamed("k", key)


def furniture(pages: DataFrame, key: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """Key and number of the lines that do not belong to the body."""
    return lines(pages, key, text).filter(F.col("p_body") < BODY).select(key, "line_no")


def body(pages: DataFrame, key: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """Per page the body lines in order, joined by line feeds; a page of furniture only has none and is left out."""
    kept = lines(pages, key, text).filter(F.col("p_body") >= BODY).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("kept"))
    return kept.select(key, F.array_join("kept.line", "\n").alias("body"), F.size("kept").alias("body_lines"))
