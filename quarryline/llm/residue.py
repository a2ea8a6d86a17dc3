"""Template residue, filler, error pages and script notices found in texts by character n-gram models.

Models of filler, of notices (error pages and pages that need scripts), of placeholders and of natural
prose give every character n-gram a likelihood ratio. Windows with a high mean ratio localise residue.
A run of filler or notice windows that covers most of its segment (a line or sentence) counts, as a text
that only speaks of such things holds few such characters. Any other run is judged by a second model on
its characters and those around it, trained on residue put into prose and on the runs that prose itself
has. What share of a text the segments cover is its coverage.

Both models are learned from all texts: n-grams are counted over the whole table, and every text gives its
own runs and takes residue that is put into it. The second model is fitted by rounds over these examples,
whose gradients are sums of whole numbers, so it does not depend on partitions.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import checkpointed

#: Order of the n-grams and number of their hash buckets.
ORDER, BUCKETS = 4, 1 << 16
#: Documents whose runs and examples are one block; tasks of a round at most, each of which sends the driver one array of JUDGED numbers.
BLOCK, TASKS = 500, 64
#: Length of a window, mean log ratio from which one counts, and share of its segment that windows must cover.
WINDOW, RATIO, COVER = 16, 0.7, 0.6
#: Placeholders are shorter and have a shorter window. Shortest run that is judged, and characters around it that are looked at.
FIELD_WINDOW, FIELD_RATIO, LEAST_RUN, AROUND = 4, 1.8, 4, 12
#: A run of filler or notice windows of this length and mean ratio counts without more ado.
STRONG_RUN, STRONG_RATIO = 20, 1.1
#: Texts at least that residue is put into to train the second model (of fewer documents each takes it several times), buckets of its features, its rounds at most, and its bar.
MADE, JUDGED, ROUNDS, JUDGE = 5000, 1 << 16, 24, 0.7
#: Weight of the squares of the second model's weights; parts of one that gradients are rounded to; steps that its curvature is told from.
RIDGE, FINE, STEPS = 1e-4, 1 << 20, 8
#: Ratio of a single n-gram is cut to this; weight of the counts against an even distribution.
CLIP, SEEN = 4.0, 0.9

#: Notices as servers and page shells print them.
NOTICES = """
404 Not Found | HTTP Status 410 - Gone | 410 Gone | Error 429: Too Many Requests | 403 Forbidden | 401 Unauthorized | 400 Bad Request
Server returned 504 for /filings/912 | HTTP 503 Service Temporarily Unavailable | HTTP 500 Internal Server Error | 502 Bad Gateway | nginx
{"error": {"code": 429, "message": "Too Many Requests"}} | {"error": {"code": 410, "message": "Gone"}} | {"error": {"code": 404, "message": "Not Found"}}
status=500 message=Internal Server Error | status=404 message=Not Found | status=503 message=Service Unavailable
404 - The requested document could not be found | This document is not available in your region. | The requested document could not be found.
Gateway time-out (ref 440) | Gateway Timeout | Request rate limit exceeded. | Please wait 28 minutes and try again.
Your session has expired. | Please sign in again to continue. | We are performing scheduled maintenance. | Please check back later.
Access denied. | Access Denied | You do not have permission to view this filing on this server. | You don't have permission to access this resource.
upstream server sent no response | Traceback (most recent call last): KeyError: 'period_end' | Unable to load exhibit. Retry | Failed to load page.
Error code 1020. Reference ID 81505 | 503. That is an error. | Oops! Something went wrong on our end. | Something went wrong.
Unusual traffic was detected from your network. | Complete the check below to continue. | Internal Server Error: NullPointer in FilingView.render (line 680)
The page you are looking for has moved or no longer exists. | Return to the home page. | Page not found | Sorry, this page does not exist.
Service Unavailable | Bad Gateway | Not Found | Gone | Forbidden | Internal Server Error | Service Temporarily Unavailable | Too Many Requests
Please enable JavaScript to view this filing. | You need to enable JavaScript to run this app. | JavaScript is off. | Turn it on in your settings and reload.
This viewer requires a browser with scripting turned on. | Your browser does not support scripts or has them disabled. | noscript
Loading... if nothing happens, allow scripts for this site. | Please turn on JavaScript in your browser. | This site requires JavaScript.
Ce site nécessite l'activation des scripts. | Veuillez activer JavaScript pour afficher ce rapport. | Accès refusé. | Vous n'êtes pas autorisé à consulter ce document.
Le service est momentanément indisponible, veuillez réessayer plus tard. | Erreur 404 : la page demandée est introuvable. | Votre session a expiré.
Für diese Seite müssen Skripte erlaubt sein. | Der Dienst ist vorübergehend nicht erreichbar. | Bitte aktivieren Sie JavaScript, um diesen Bericht anzuzeigen.
Fehler 404: Die angeforderte Seite wurde nicht gefunden. | Ihre Sitzung ist abgelaufen. | Zugriff verweigert. | Bitte melden Sie sich an.
Este visor requiere que los scripts estén permitidos. | Active JavaScript para ver este informe. | Su sesión ha caducado. | Acceso denegado.
El servicio no está disponible en este momento. | Error 404: no se encontró la página solicitada. | No tiene permiso para ver este documento.
"""

#: Status codes, their names and how servers print both.
CODES = (400, 401, 403, 404, 408, 410, 429, 500, 502, 503, 504, 520)
STATUS = "Bad Request|Unauthorized|Forbidden|Not Found|Request Timeout|Gone|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|Unknown Error"
STATUS_FORMS = "{code} {name}|Error {code}: {name}|HTTP Status {code} - {name}|HTTP {code} {name}|{name} ({code})|status={code} message={name}|{name}"

#: Filler as templates print it.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Heading goes here | Your text goes here. | DUMMY CONTENT DO NOT PUBLISH | Sample paragraph - replace before filing. | Body copy to come.
Insert management commentary here (approx. 200 words). | This is placeholder text for the risk section. | Test test test 123. | asdf asdf asdf
Placeholder text. | Sample text. | Text to be supplied. | Insert text here. | Your heading here | Dummy text | qwerty qwerty | foo bar baz
"""
#: Syllables of filler that imitates Latin, and words that open it.
SYLLABLES = "er nem eg dis is cit ul mor qua vel tus fa am por lib tor con se ips lor".split()
OPENERS = "Lorem Ipsum Dolor Vitae Mauris Consequor Sed Nullam Integer Aliquam Donec Praesent".split()

#: Names that placeholders stand for, and the forms that they take.
NAMES = "company name,registrant,period end,fiscal year,ticker,amount,headline,metric,segment,currency,quarter,auditor,item code,author title,contract date,prior value,plant name,total assets,date,city".split(",")
FORMS = (
    "{{%s}} {{ %s }} {{#each %s}} {%% if %s %%} ${%s} #{%s} <<%s>> <%s> <%%= %s %%> [[%s]] [%s] [INSERT %s] [enter %s here] @@%s@@ %%%%%s%%%% %%(%s)s __%s__ {%s} &lt;%s&gt; &lt;insert~%s&gt; |%s|TBD|"
).replace("[INSERT %s]", "[INSERT~%s]").replace("[enter %s here]", "[enter~%s~here]").replace("{{ %s }}", "{{~%s~}}").replace("{{#each %s}}", "{{#each~%s}}").replace(
    "{%% if %s %%}", "{%%~if~%s~%%}"
).replace("<%%= %s %%>", "<%%=~%s~%%>")
BARE = "???|$XXX million|[●]|$[●] million|[Month] [●]|[ ] percent|[to be completed]|[object Object]|undefined|NaN%|(name)|#N/A|#REF!|#VALUE!|TK TK|____________|$___ million|{0}|{1:N2}|null"

#: Forms of placeholders, by which runs in the sample of prose are kept out of the examples of natural prose. It decides nothing about the texts.
_FIELD = r"[A-Za-z][A-Za-z0-9_.#/ ]{0,40}"
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^%\n]{0,60}%\}|[$#]\{[^{}\n]{1,60}\}?|<<[^<>\n]{1,60}>>|<%[^%\n]{1,60}%>|\[\[[^\[\]\n]{1,60}\]\]|@@[^@\n]{1,60}@@|%%[^%\n]{1,60}%%"
    rf"|%\({_FIELD}\)s|__{_FIELD}__|_{{3,}}|\|{_FIELD}\|TBD\||<(?!(?:http|www)){_FIELD}>"
    r"|\{[A-Za-z]\w*(?: \w+){0,2}\}|\{\d(?::\w+)?\}"
    r"|\[(?:insert|enter|INSERT|ENTER|Insert|Enter)\b[^\[\]\n]{1,60}\]|\[(?:●|•|\s|to be completed|Month|object Object)\]"
    rf"|\[(?:{'|'.join(n.replace(' ', '[ _]?') for n in NAMES)})\]"
    r"|#(?:N/A|REF!|VALUE!|NAME\?|DIV/0!)|\bXXX\b|\bTK TK\b|\bNaN\b|\(name\)|(?<![A-Za-z] )\bundefined\b(?! terms)|(?<=\w )undefined\b|(?<!The )\bnull\b(?! hypothes)",
    re.IGNORECASE,
)
_SEGMENT = re.compile(r"\n+|(?<=[.!?])\s+")


@dataclass(frozen=True)
class Model:
    """Log ratios to prose of all n-gram buckets, with a column each for filler, notices and placeholders."""

    ratios: np.ndarray


def grams(text: str) -> np.ndarray:
    """Bucket of the n-gram that starts at each character; digits are one sign, case does not count."""
    codes = np.frombuffer(text.lower().translate(_DIGITS).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < ORDER:
        codes = np.concatenate([codes, np.full(ORDER - len(codes), 32, dtype=np.uint64)])
    mixed = np.zeros(len(codes) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - ORDER + 1 + k]
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


#: Names of the kinds of residue.
KINDS = ("filler", "notice", "placeholder")
_DIGITS = str.maketrans("123456789", "000000000")
_LETTERS = re.compile(r"[^\W\d_]+")


def filler_lines(n: int = 400) -> list[str]:
    """Imitated Latin, made by rule from the syllables."""
    rng = np.random.RandomState(5)
    out = []
    for _ in range(n):
        words = ["".join(rng.choice(SYLLABLES, rng.randint(1, 4))) for _ in range(rng.randint(5, 16))]
        out.append(" ".join([rng.choice(OPENERS), *words]) + ".")
    return out


def status_lines() -> list[str]:
    """Status lines of servers, made by rule from codes and their names."""
    return [form.format(code=code, name=name) for code, name in zip(CODES, STATUS.split("|")) for form in STATUS_FORMS.split("|")]


def placeholder_lines() -> list[str]:
    """Every form with every name in several cases."""
    out = []
    for name in NAMES:
        for shown in (name.replace(" ", "_"), name.title(), name.title().replace(" ", ""), name.upper().replace(" ", "_"), name):
            out += [form.replace("~", " ") % shown for form in FORMS.split(" ")]
    return [f" {x} " for x in out + BARE.split("|") * 20]  # as they stand between words


def classes() -> list[list[str]]:
    """Labelled lines of each kind."""
    lines = lambda block: [x.strip() for x in re.split(r"\n|(?<=\S) \| (?=\S)", block) if x.strip()]
    return [filler_lines() + lines(FILLER) * 20, lines(NOTICES) + status_lines(), placeholder_lines()]


def counted(texts: DataFrame) -> np.ndarray:
    """How often each n-gram bucket occurs in all texts; tasks send their counts in segments, which are added up before they are collected."""
    segments = 16
    part = BUCKETS // segments

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for rows in batches:
            for t in rows["t"]:
                if t is not None:
                    n += np.bincount(grams(t), minlength=BUCKETS)
        yield pd.DataFrame({"segment": range(segments), "counts": [x.tobytes() for x in n.reshape(segments, part)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for k, c in zip(rows["segment"], rows["counts"]):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, dtype=np.int64)
        if sums:
            yield pd.DataFrame({"segment": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    schema = "segment int, counts binary"
    out = np.zeros((segments, part), dtype=np.int64)
    for row in texts.select("t").mapInPandas(count, schema).repartition(segments // 4, "segment").mapInPandas(add, schema).collect():
        out[row["segment"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.ravel()


def ratios_of(counts: np.ndarray) -> np.ndarray:
    """Log ratios of the labelled lines to the texts, whose n-grams are counted.

    All tables are mixed with the same even distribution, so an n-gram that neither side has seen says
    nothing. The texts hold residue in the share that the table has; that lowers the ratios of its
    n-grams little, as a labelled line is a far larger part of its own table.
    """

    def table(n: np.ndarray) -> np.ndarray:
        return np.log(SEEN * n / max(1.0, n.sum()) + (1 - SEEN) / BUCKETS)

    base = table(counts)
    tables = [table(np.bincount(np.concatenate([grams(t) for t in c]), minlength=BUCKETS)) for c in classes()]
    return np.stack([np.clip(t - base, -CLIP, CLIP) for t in tables], axis=1).astype(np.float32)


def made_of(text: str, n: int, labelled: list[list[str]], model: Model) -> list[tuple[str, Run, int]]:
    """Texts with a run and its label: residue that is put into a text, n times, and what stands there by nature.

    A sentence or word makes place for a labelled line. What is drawn follows from the text alone.
    """
    out = []
    if len(text) <= 60:
        return out
    rng = Random(text)
    for _ in range(n):
        kind = (0, 1, 1, 2, 2, 2)[rng.randrange(6)]
        line = rng.choice(labelled[kind]).strip()
        at = rng.randrange(max(1, len(text) - 500))
        t = text[at : at + 500]
        # what stands there by nature is an example of prose in the same surroundings
        spaces = [m.start() for m in re.finditer(r" ", t)]
        if len(spaces) > 2:
            k = rng.randrange(len(spaces) - 1)
            a, b = spaces[k] + 1, spaces[k + 1] if kind == 2 else min(len(t), spaces[k] + 1 + len(line))
            if b - a >= LEAST_RUN:
                out.append((t, Run(a, b, kind, 2.0 if kind == 2 else 1.0, a, b, False), 0))
        gaps = [m.start() for m in (re.finditer(r" ", t) if kind == 2 else _SEGMENT.finditer(t))] or [len(t)]
        at = rng.choice(gaps)
        before, after = t[:at], t[at:].lstrip()
        if kind == 2 and rng.random() < 0.7:
            after = after.partition(" ")[2]
        glue = " " if kind == 2 or rng.random() < 0.5 else "\n"
        made = f"{before}{glue}{line} {after}" if kind == 2 else f"{before}{glue}{line}{' ' if rng.random() < 0.5 else glue}{after}"
        lo, hi = len(before) + 1, len(before) + 1 + len(line)
        out += [(made, r, 1) for r in runs(made, model) if r.lo < hi and r.hi > lo]
    return out


def fitted(examples: DataFrame, none: int, some: int) -> np.ndarray:
    """Weights of a regularised logistic regression on all examples, both labels with one weight in all.

    Rounds of L-BFGS; none and some are the numbers of examples of both labels. A round reads all examples.
    """
    if not none + some:
        return np.zeros(JUDGED)
    share = min(max(some / (none + some), 0.01), 0.99)
    weights = (0.5 / (1 - share), 0.5 / share)
    blocks, total = examples.select("block").filter("block is not null").coalesce(TASKS), none + some

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = examples.sparkSession.sparkContext.broadcast(w)

        def slope(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, loss, g = shared.value, 0.0, np.zeros(JUDGED)
            for rows in batches:
                for block in rows["block"]:
                    _, _, own, lengths, labels = pickle.loads(zlib.decompress(block))
                    scores = sums(w[own], lengths)
                    weight = np.where(labels > 0, weights[1], weights[0]) * (labels >= 0)
                    # whole numbers, whose sums do not depend on their order
                    part = np.rint((1 / (1 + np.exp(-np.clip(scores, -30, 30))) - (labels > 0)) * weight * FINE)
                    loss += np.rint(np.logaddexp(0, np.where(labels > 0, -scores, scores)) * weight * FINE).sum()
                    g += np.bincount(own, weights=np.repeat(part, lengths), minlength=JUDGED)
            yield pd.DataFrame({"loss": [loss], "g": [g.tobytes()]})

        loss, g = 0.0, np.zeros(JUDGED)
        for row in blocks.mapInPandas(slope, "loss double, g binary").collect():  # TASKS rows of JUDGED numbers at most
            loss, g = loss + row["loss"], g + np.frombuffer(row["g"])
        shared.destroy()
        return loss / FINE / total + RIDGE / 2 * float(w @ w), g / FINE / total + RIDGE * w

    w = np.zeros(JUDGED)
    loss, g = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    size = 1.0
    for _ in range(ROUNDS):
        d, back = g.copy(), []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d -= back[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 0.5 / max(1e-12, np.sqrt(g @ g))
        for (s, y), a in zip(past, reversed(back)):
            d += s * (a - (y @ d) / (s @ y))
        new = w - size * d
        next_loss, next_g = at(new)
        if next_loss > loss:  # the step was too long
            size /= 4
            continue
        s, y = new - w, next_g - g
        if s @ y > 1e-12:
            past = [*past[1 - STEPS :], (s, y)]
        done = loss - next_loss < 1e-5
        w, loss, g, size = new, next_loss, next_g, 1.0
        if done:
            break
    return w


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs are not empty."""
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) if len(lengths) else np.empty(0)


@dataclass(frozen=True)
class Run:
    """A run of hot windows: its characters, kind (filler, notice, placeholder), mean ratio, segment and whether it covers that."""

    lo: int
    hi: int
    kind: int
    mean: float
    begin: int
    end: int
    covers: bool


def marks(given: list[tuple[str, Run]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of runs, one run after the other, and how many each has.

    Features are character n-grams, as they are and by shape, inside the run, on both sides and at its edges.
    """
    if not given:
        return np.empty(0, dtype=np.uint16), np.empty(0, dtype=np.int64)
    parts, first = [], []
    for text, run in given:
        lo, hi = run.lo, run.hi
        for part in (text[lo:hi], text[max(0, lo - AROUND) : lo], text[hi : hi + AROUND], text[max(0, lo - 2) : lo + 3], text[max(0, hi - 3) : hi + 2]):
            plain = part.translate(_DIGITS)
            parts += [plain.lower(), _LETTERS.sub(lambda m: "A" if m.group()[0].isupper() else "a", plain)]
        first += [(run.kind << 20) | 1, (run.kind << 20) | 2 << 8 | min(12, (hi - lo) // 4), (run.kind << 20) | 3 << 8 | (int(run.mean * 4) & 255)]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    place = np.repeat(np.arange(len(parts)), sizes)  # ten parts of a run, in order
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    keys = [(np.repeat(np.arange(len(given)), 3) << 16) | scrambled(np.array(first, dtype=np.uint64))]
    for k in (1, 2, 3, 5):
        at = np.flatnonzero(left >= k)
        h = (place[at] % 10).astype(np.uint64) * np.uint64(8) + np.uint64(k + (1 << 32))
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + i]
        keys.append((place[at] // 10 << 16) | scrambled(h))
    own = np.unique(np.concatenate(keys))
    return (own & 0xFFFF).astype(np.uint16), np.bincount(own >> 16, minlength=len(given))


def scrambled(h: np.ndarray) -> np.ndarray:
    """Buckets of JUDGED."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(48)).astype(np.int64)


def hot_runs(ratios: np.ndarray, width: int, bar: float = RATIO) -> list[tuple[int, int, float]]:
    """Begin, end and mean ratio of the runs of windows whose mean ratio counts."""
    width = min(width, len(ratios))
    sums = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
    at = np.flatnonzero(sums[width:] - sums[:-width] > bar * width)
    if not len(at):
        return []
    parts = np.split(at, np.flatnonzero(np.diff(at) > width) + 1)
    return [(int(p[0]), int(p[-1]) + width, float((sums[p[-1] + width] - sums[p[0]]) / (p[-1] + width - p[0]))) for p in parts]


def runs(text: str, model: Model) -> list[Run]:
    """Hot runs of a text with their segments, which are searched in the whole text."""
    scores = model.ratios.take(grams(text), axis=0)
    found, breaks = [], None
    for kind, width in enumerate((WINDOW, WINDOW, FIELD_WINDOW)):
        for lo, hi, mean in hot_runs(scores[:, kind], width, FIELD_RATIO if kind == 2 else RATIO):
            hi = min(hi + ORDER - 1 if kind == 2 else hi, len(text))
            if hi - lo < LEAST_RUN:
                continue
            if breaks is None:
                breaks = [m.span() for m in _SEGMENT.finditer(text)]
                starts, ends = [0, *(e for _, e in breaks)], [*(b for b, _ in breaks), len(text)]
            half = WINDOW // 2 if kind < 2 else 0
            first, last = min(lo + half, hi - 1), max(hi - half, lo)
            begin = starts[bisect_right(starts, first) - 1]
            end = ends[min(bisect_left(ends, last), len(ends) - 1)]
            covers = kind < 2 and (min(hi, end) - max(lo, begin) >= COVER * max(1, end - begin) or (hi - lo >= STRONG_RUN and mean >= STRONG_RATIO))
            found.append(Run(lo, hi, kind, mean, begin, end, covers))
    return found


def examined(texts: DataFrame, kind: str, ratios: np.ndarray, copies: int) -> DataFrame:
    """k of every text, in order; the first text of BLOCK has the block of what is known of them, with the examples that they give.

    A block holds the length of each text and its runs, the features of all runs that do not cover their
    segment, then of residue put into the texts, and a label each: 1 residue, 0 prose, -1 neither.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Model(ratios))

    def examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, labelled = shared.value, classes()
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                rows = batch.iloc[lo : lo + BLOCK]
                lengths, found, judged, labels, made = [], [], [], [], []
                for t in rows["t"]:
                    own = [] if t is None else runs(t, model)
                    lengths.append(None if t is None else len(t))
                    found.append([(x.lo, x.hi, x.kind, x.begin, x.end, x.covers) for x in own])
                    for x in own:
                        if not x.covers:
                            judged.append((t, x))
                            labels.append(-1 if x.kind == 2 and PLACEHOLDER.search(t, max(0, x.lo - 45), min(len(t), x.hi + 45)) else 0)
                    made += made_of(t, copies, labelled, model) if t else []
                features, sizes = marks(judged + [x[:2] for x in made])
                labels = np.array(labels + [x[2] for x in made], dtype=np.int8)
                block = zlib.compress(pickle.dumps((lengths, found, features, sizes.astype(np.int32), labels), protocol=5), 1)
                n = len(rows) - 1
                yield pd.DataFrame({"k": rows["k"], "block": [block, *[None] * n], "none": [int((labels == 0).sum()), *[0] * n], "some": [int((labels == 1).sum()), *[0] * n]})

    return checkpointed(texts.mapInPandas(examine, f"k {kind}, block binary, none long, some long"))


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the characters, the share covered by segments with residue, and the kinds found.

    Every text is scored whole, and all texts are learned from. Null texts have null coverage and no kind,
    empty ones coverage 0. With no document the labelled lines alone are used.
    """
    kind = dict(documents.dtypes)[key]
    texts = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    ratios = ratios_of(counted(texts))
    copies = -(-MADE // max(1, texts.filter("length(t) > 60").count()))
    known = examined(texts, kind, ratios, copies)
    of = known.agg(F.sum("none").alias("none"), F.sum("some").alias("some")).first()
    shared = documents.sparkSession.sparkContext.broadcast(fitted(known, of["none"] or 0, of["some"] or 0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, bar, left = shared.value, np.log(JUDGE / (1 - JUDGE)), iter(())
        for rows in batches:
            out = []
            for k, block in zip(rows["k"], rows["block"]):
                if block is not None:  # of this text and those that follow
                    lengths, found, own, sizes, _ = pickle.loads(zlib.decompress(block))
                    accepted = iter((sums(judge[own], sizes) > bar).tolist())
                    left = iter(zip(lengths, found))
                n, runs_of = next(left)
                if n is None:
                    out.append((k, None, None, []))
                    continue
                spans = []
                for lo, hi, name, begin, end, covers in runs_of:
                    if covers:
                        spans.append((min(begin, lo), max(end, hi), KINDS[name]))
                    elif next(accepted):
                        spans.append((lo, hi, KINDS[name]))
                covered = end = 0
                for lo, hi, _ in sorted(spans):
                    covered, end = covered + max(0, hi - max(lo, end)), max(end, hi)
                out.append((k, n, min(1.0, covered / n) if n else 0.0, sorted({x[2] for x in spans})))
            if out:
                yield pd.DataFrame(out, columns=["k", "chars", "coverage", "kinds"]).astype({"chars": "Int64", "coverage": "Float64"})

    scored = known.select("k", "block").mapInPandas(score, f"k {kind}, chars long, coverage double, kinds array<string>")
    return scored.withColumnRenamed("k", key)


def clean(documents: DataFrame, key: str = "doc_id", text: str = "text", most: float = 0.0) -> DataFrame:
    """Keys of the documents of which residue covers at most the given share; null texts are out."""
    return residue(documents, key, text).filter(F.col("coverage") <= most).select(key)
