"""Find secrets: fixed rules, and a small character network over every other candidate.

Candidates are runs of key-like characters that are no plain words, or what the rules leave of them.  A convolutional network in numpy reads
each with its surrounding characters.  It is trained on labelled findings of the corpus
itself: what the rules find is a secret, other candidates and ordinary words are not.  Each
secret is also shown in strange surroundings, as it is and in other letters, and each word
also as part of a name or path, so that a key is known by its looks too.  Beside them stand
made-up secrets and harmless runs of many forms (``key_forms``) in surroundings of the corpus.
A held-out part of the examples, and whole forms that are not trained on, calibrate the
probabilities and set the threshold: the highest one that still finds the wanted share of
secrets, or the least one above it at which enough of what is marked is secret.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.key_forms import made
from fernweave.llm.sampling import least_hashes
from fernweave.llm.stored import stored

#: Fixed rules, in their order: pattern, the group whose length counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": (re.compile(ASSIGN, re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = (*RULES, "model")

#: What the network looks at: runs of these characters, but for words in one case or with a capital, also joined, unless they are long and MIXED.
LEAST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
PLAIN = re.compile(r"[+/_=.-]*(?:(?:[A-Z]?[a-z]{1,23}|[A-Z]{1,24})(?:[+/_=.-]+|\Z))*")
LONG = 16
MIXED = re.compile(r"(?=.*[A-Za-z])(?:.*[0-9+/_=]|.*[a-z][A-Z])")
LONG_WORD = re.compile(r"\S{8,}")
NAME_WORD = re.compile(r"(?<![^\s])[A-Za-z]{3,12}(?![^\s])")

#: Characters read of the candidate and on either side; a longer candidate is read in several windows.
INSIDE, ASIDE = 48, 24
WINDOW = INSIDE + 2 * ASIDE

#: The network: size of a character's vector, width and number of filters.
VECTOR, WIDTH, FILTERS = 8, 5, 16

#: Bounds of a fit: documents with findings, documents without, their length, made-up runs of each form; wanted recall and least precision.
FIT_FINDING = 1500
FIT_OTHER = 500
FIT_CHARS = 20_000
FIT_EXAMPLES = 3000
FIT_MADE = 200
RECALL = 0.98
PRECISION = 0.9
EPOCHS = 12

#: Letters of made-up keys, and what joins words to names that are none.
KEY_LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
JOINTS = list("._-/=")

Span = tuple[str, int, int, float]


def base_spans(text: str) -> list[Span]:
    """What the fixed rules find, by start and then by kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), 1.0) for m in RULES["assign"][0].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in RULES["access"][0].finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), 1.0) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    """Parts of a text that spans, in order of their starts, cover."""
    parts: list[tuple[int, int]] = []
    for _, start, end, _ in spans:
        if parts and start <= parts[-1][1]:
            parts[-1] = (parts[-1][0], max(end, parts[-1][1]))
        else:
            parts.append((start, end))
    return parts


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs, and the pieces of them on either side of spans found so far; one pass over both."""
    found, covered, first = [], _covered(taken), 0
    for m in CANDIDATE.finditer(text):
        at, pieces = m.start(), []
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        here = first
        while here < len(covered) and covered[here][0] < m.end():
            pieces.append((at, covered[here][0]))
            at = covered[here][1]
            here += 1
        for start, end in [*pieces, (at, m.end())]:
            piece = text[start:end]
            if len(piece) >= LEAST and (not PLAIN.fullmatch(piece) or len(piece) >= LONG and MIXED.match(piece)):
                found.append((start, end))
    return found


def window(text: str, start: int, end: int, left: str | None = None, right: str | None = None) -> np.ndarray:
    """Character numbers around and in a candidate, and beyond WINDOW of them which lie inside it."""
    before = (text[max(0, start - ASIDE) : start] if left is None else left).rjust(ASIDE, "\0")
    after = (text[end : end + ASIDE] if right is None else right).ljust(ASIDE, "\0")
    inner = text[start:end]
    points = np.frombuffer((before + inner + after).ljust(WINDOW, "\0").encode("utf-32-le"), np.uint32)[:WINDOW]
    ids = np.where(points == 0, 0, np.where((points >= 32) & (points < 127), points - 30, 1)).astype(np.int64)
    flags = np.zeros(WINDOW, np.int64)
    flags[ASIDE : ASIDE + len(inner)] = 1
    return np.concatenate([ids, flags])


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """All windows of a candidate; one unless it is longer than a window's inside."""
    if end - start <= INSIDE:
        return [window(text, start, end)]
    return [window(text, at, min(end, at + INSIDE)) for at in range(start, end - INSIDE // 2, INSIDE // 2)]


@dataclass
class CharNet:
    """Vectors of characters, one layer of filters, their greatest answers inside and anywhere, a logistic unit."""

    vectors: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    scale: np.ndarray
    threshold: float = 2.0
    reached: float = 0.0
    precise: float = 0.0

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, flags = x[:, :WINDOW], x[:, WINDOW:]
        long = flags * (flags.sum(axis=1, keepdims=True) / LONG)  # greatest answers cannot count, so the length is told
        seen = np.concatenate([self.vectors[ids], long[:, :, None]], axis=2)
        patches = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, axis=1).reshape(len(x), WINDOW - WIDTH + 1, -1)
        answers = np.maximum(patches @ self.filters + self.shift, 0)
        middle = flags[:, WIDTH // 2 : WINDOW - WIDTH // 2].astype(bool)
        inner = np.where(middle[:, :, None], answers, 0)
        at = answers.argmax(axis=1), inner.argmax(axis=1)
        tops = np.concatenate([np.take_along_axis(a, i[:, None, :], 1)[:, 0] for a, i in zip((answers, inner), at)], axis=1)
        return ids, patches, at, tops, tops @ self.out[:-1] + self.out[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that each window holds a secret."""
        parts = [self._layers(x[i : i + 256])[-1] for i in range(0, len(x), 256)]
        z = np.concatenate(parts) if parts else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        ids, patches, at, tops, z = self._layers(x)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        out = np.append(tops.T @ error, error.sum())
        down = error[:, None] * self.out[:-1] * (tops > 0)
        vectors, filters, shift = np.zeros_like(self.vectors), np.zeros_like(self.filters), np.zeros_like(self.shift)
        rows = np.arange(len(x))
        for half, places in enumerate(at):
            for f in range(FILTERS):
                d, place = down[:, half * FILTERS + f], places[:, f]
                filters[:, f] += patches[rows, place].T @ d
                shift[f] += d.sum()
                back = self.filters[:, f].reshape(VECTOR + 1, WIDTH)
                for k in range(WIDTH):
                    np.add.at(vectors, ids[rows, place + k], d[:, None] * back[:VECTOR, k])
        return [vectors, filters, shift, out]


def fit_net(x: np.ndarray, y: np.ndarray, recall: float = RECALL, precision: float = 0.0, more: tuple[np.ndarray, np.ndarray] | None = None) -> CharNet | None:
    """Train on three quarters of the examples, calibrate and set the threshold on the rest and on ``more``.

    The threshold reaches ``recall``; where less than ``precision`` of what it marks is secret,
    it is the least one that marks so much, or marks nothing where there is none.
    """
    draw = np.random.RandomState(7)
    if y.sum() < 8 or (1 - y).sum() < 8:
        return None
    order = draw.permutation(len(x))
    held, used = order[: len(x) // 4], order[len(x) // 4 :]
    if not y[held].sum() or y[held].all():
        return None
    net = CharNet(draw.normal(0, 0.3, (97, VECTOR)), draw.normal(0, 0.2, ((VECTOR + 1) * WIDTH, FILTERS)), np.zeros(FILTERS), draw.normal(0, 0.2, 2 * FILTERS + 1), np.array([1.0, 0.0]))
    params = [net.vectors, net.filters, net.shift, net.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        shuffled = draw.permutation(used)
        for i in range(0, len(shuffled), 64):
            step += 1
            batch = shuffled[i : i + 64]
            for p, g, m, v in zip(params, net.gradients(x[batch], y[batch]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    x, y = x[held], y[held]
    if more is not None and len(more[0]):
        x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]])
    z = np.concatenate([net._layers(x[i : i + 256])[-1] for i in range(0, len(x), 256)])
    a, b = 1.0, 0.0
    for _ in range(500):  # logistic calibration, with a little weight on the identity
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a - 0.05 * (((p - y) * z).mean() + 0.01 * (a - 1)), b - 0.05 * ((p - y).mean() + 0.01 * b)
    net.scale = np.array([a, b])
    p = net.probability(x)
    true = np.sort(p[y == 1])
    net.threshold = float(true[int(np.floor((1 - recall) * len(true)))]) - 1e-9
    falling = np.argsort(-p, kind="stable")
    share = np.cumsum(y[falling]) / np.arange(1, len(p) + 1)
    if (y[p >= net.threshold]).mean() < precision:
        enough = np.flatnonzero((share >= precision) & (np.diff(p[falling], append=-1.0) < 0))
        net.threshold = float(p[falling][enough[-1]]) - 1e-9 if len(enough) else 2.0
    net.reached, net.precise = float((true >= net.threshold).mean()), float(y[p >= net.threshold].mean()) if (p >= net.threshold).any() else 1.0
    return net


def made_examples(texts: list[str], each: int = FIT_MADE, held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows of made-up runs, each in the surroundings of some word of the texts."""
    draw = np.random.RandomState(13 + held_out)
    places = [(text, m) for text in texts for m in list(NAME_WORD.finditer(text))[:200]]
    if not places:
        return np.empty((0, 2 * WINDOW), np.int64), np.empty(0, np.int64)
    words = sorted({m[0] for _, m in places})
    rows, labels = [], []
    for before, key, label in made(draw, words, each, held_out):
        text, m = places[draw.randint(len(places))]
        left = (text[max(0, m.start() - ASIDE) : m.start()] + before)[-ASIDE:]
        rows.append(window(key, 0, min(len(key), INSIDE), left, text[m.end() : m.end() + ASIDE]))
        labels.append(label)
    return np.array(rows), np.array(labels)


def examples(texts: list[str], most: int = FIT_EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows from texts: findings of the rules, and candidates and words that are none."""
    draw = np.random.RandomState(11)
    secrets, others = [], []
    for text in texts:
        base = base_spans(text)
        for kind, start, end, _ in base:
            if kind == "assign":
                start = end - len(re.search(r"[A-Za-z0-9+/_.=-]+$", text[start:end])[0])
            secrets.append((text, start, end))
        words = [m.span() for m in LONG_WORD.finditer(text)]
        picked = [words[i] for i in draw.permutation(len(words))[:4]]
        others += [(text, s, e) for s, e in candidates(text, base)]
        others += [(text, s, e) for s, e in picked if not any(a < e and s < b for _, a, b, _ in base)]
    secrets = [secrets[i] for i in draw.permutation(len(secrets))[:most]]
    others = [others[i] for i in draw.permutation(len(others))[: 2 * most]]
    rows, labels = [], []
    for i, (text, s, e) in enumerate(secrets):
        rows.append(window(text, s, min(e, s + INSIDE)))
        labels.append(1)
        if others:  # where nothing around it gives it away: the same key, and one in other letters
            for key in (text[s:e], "".join(draw.choice(KEY_LETTERS, draw.randint(20, 45)))):
                strange, a, b = others[draw.randint(len(others))]
                rows.append(window(key, 0, min(len(key), INSIDE), strange[max(0, a - ASIDE) : a], strange[b : b + ASIDE]))
                labels.append(1)
    for i, (text, s, e) in enumerate(others):
        rows.append(window(text, s, min(e, s + INSIDE)))
        labels.append(0)
        named = [text[s:e].strip(".,;:!?")] + [others[j][0][others[j][1] : others[j][2]].strip(".,;:!?") for j in draw.randint(len(others), size=2)]
        path = draw.choice(JOINTS).join([*named, str(draw.randint(10_000))])  # words and a number joined as in names and paths
        rows.append(window(path, 0, min(len(path), INSIDE), text[max(0, s - ASIDE) : s], text[e : e + ASIDE]))
        labels.append(0)
    return (np.array(rows), np.array(labels)) if rows else (np.empty((0, 2 * WINDOW), np.int64), np.empty(0, np.int64))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_finding: int = FIT_FINDING, fit_other: int = FIT_OTHER, fit_chars: int = FIT_CHARS, recall: float = RECALL, precision: float = PRECISION) -> CharNet | None:
    """Fit on findings in at most ``fit_finding`` documents, and on words of ``fit_other`` more.

    They are those with the least hashes; of a document of more than ``fit_chars`` characters
    the part around its first finding is taken.  With too few findings there is no network,
    and only the rules speak.  NULL texts are passed over, repeated rows are read once, other
    columns are not read.
    """
    text, secret = F.col("t"), F.lit(ASSIGN.replace("(?i:", "(?i)(?:", 1) + r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    usable = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.concat_ws(" ", F.col(id_col).cast("string"), F.xxhash64(text_col)).alias("k"))
    marked = stored(usable.select("k", F.rlike(text, secret).alias("likely")), "secret-marks")
    finding, every = marked.agg(F.count_if("likely"), F.count("*")).first()
    keys = least_hashes(marked.where("likely"), F.col("k"), fit_finding, finding).union(least_hashes(marked, F.col("k"), fit_other, every)).select("k").distinct()
    around = F.substr(text, F.greatest(F.lit(1), F.regexp_instr(text, secret) - fit_chars // 2), F.lit(fit_chars))
    drawn = usable.join(F.broadcast(keys), "k", "left_semi").select(F.when(F.length(text) <= fit_chars, text).otherwise(around).alias("t"))
    rows = drawn.select("t").collect()
    texts = sorted({r[0] for r in rows})
    x, y = examples(texts)
    if y.sum() < 8:
        return None
    made_x, made_y = made_examples(texts)
    return fit_net(np.concatenate([x, made_x]), np.concatenate([y, made_y]), recall, precision, made_examples(texts, held_out=True))


def find(texts: list[str | None], net: CharNet | None) -> list[list[Span]]:
    """Spans of all texts: those of the rules, and candidates that the network takes for secrets."""
    spans = [base_spans(t) if t else [] for t in texts]
    if net is None:
        return spans
    rows, owners = [], []
    for i, text in enumerate(texts):
        for start, end in candidates(text, spans[i]) if text else ():
            for part in windows(text, start, end):
                rows.append(part)
                owners.append((i, start, end))
    best: dict[tuple[int, int, int], float] = {}
    for at in range(0, len(rows), 4096):
        for owner, p in zip(owners[at : at + 4096], net.probability(np.array(rows[at : at + 4096])).tolist()):
            best[owner] = max(p, best.get(owner, 0.0))
    for (i, start, end), p in best.items():
        if p >= net.threshold:
            spans[i].append(("model", start, end, p))
    return [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in spans]


FOUND = "array<struct<kind: string, start: int, end: int, score: double>>"


def spans_column(text: Column | str, net: Broadcast) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(texts), 512):  # bounds what is held of candidates
            rows += find([t.as_py() for t in texts[at : at + 512]], net.value)
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in rows], kind)

    return scan(text)


def scan_documents(docs: DataFrame, net: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each whole text: (id, spans), spans by start and then by kind.

    Places are code points, the end exclusive; spans of the rules have score 1.  NULL and
    empty texts have no spans.  Rows stand alone: repeated rows and NULL ids are returned as
    they come, an empty table gives an empty result, other columns are not carried.
    """
    return docs.select(F.col(id_col), spans_column(F.col(text_col), net).alias("spans"))


def mask_column(text: Column | str, net: Broadcast, mask: str = "[SECRET]") -> Column:
    """The text with every found span replaced; spans that touch or overlap are replaced together."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(texts), 512):
            part = [t.as_py() for t in texts[at : at + 512]]
            for text, spans in zip(part, find(part, net.value)):
                pieces, done = [], 0
                for _, start, end, _ in spans:
                    if start > done or not pieces:
                        pieces += [text[done:start], mask]
                    done = max(done, end)
                rows.append("".join(pieces) + text[done:] if pieces else text)
        return pa.array(rows, pa.string())

    return masked(text)
