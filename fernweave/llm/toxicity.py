"""Score texts for toxicity by multiple-instance learning, and locate the sentences that offend.

A document is a bag of sentences.  Each sentence has a logistic score over its words and
word beginnings; the document is toxic unless no sentence is: P = 1 - prod(1 - p).  Only
document labels are needed: the gradient of the noisy-or hands each document's label down
to those of its sentences that explain it.  Labels that no sentence explains belong to a
background term of the document, whatever its length.  Sentences below 0.5 count together
only for what they exceed as many sentences of clean documents by, so that length adds nothing.

The model is fitted in numpy on a bounded sample of labelled documents (the bounds are
parameters) and sent to the executors; every whole text is scored there.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.sampling import least_hashes

#: Labelled documents of either kind that a fit reads at most, and characters of all together.
FIT_TOXIC = 2000
FIT_CLEAN = 4000
FIT_CHARS = 24_000_000

#: Features kept, documents a feature must occur in, lengths of word beginnings.
FEATURES = 4000
LEAST_DOCUMENTS = 4
BEGINNINGS = (4, 5, 6, 7)

#: Steps, step length and weight decay of the fit.
STEPS = 300
RATE = 0.1
DECAY = 1e-4

MEMO_WORDS = 150_000

#: Names among the weights that no word can have: log odds of a document that no sentence explains, and mean and
#: mean square of what sentences below 0.5 of clean documents add.  So many means and standard errors are allowed for.
BACKGROUND, MEAN, SQUARE = " background", " mean", " square"
MEANS, ERRORS = 2, 3

#: A sentence with at least one letter, from its first letter on; and its words.
SENTENCE = re.compile(r"[^\W\d_][^.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if k <= len(word))]


@dataclass
class NoisyOr:
    """Weights of features and the bias of a sentence.

    Without BACKGROUND, MEAN and SQUARE among the weights it is the plain noisy-or of all sentences.
    """

    weights: dict[str, float]
    bias: float
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _memo={})

    def _word(self, word: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in word_features(word))
        if len(word) <= 48:
            if len(self._memo) >= MEMO_WORDS:
                self._memo.clear()
            self._memo[word] = found
        return found

    def logit(self, words: set[str]) -> float:
        memo = self._memo
        return self.bias + math.fsum(memo[w] if w in memo else self._word(w) for w in sorted(words))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and (start, end, score) of each sentence scored 0.5 or more."""
        if not text:
            return 0.0, []
        memo, low = self._memo, text.lower()
        if not any(memo[w] if w in memo else self._word(w) for w in set(WORD.findall(low))):
            sentences = sum(1 for _ in SENTENCE.finditer(text))
            added = sentences * _softplus(self.bias)
            return -math.expm1(-(self._total(added, 0.0, sentences) if self.bias < 0 else self._total(0.0, added, 0))), []
        small, large, n_small, found = 0.0, 0.0, 0, []
        for m in SENTENCE.finditer(text):
            z = self.logit(set(WORD.findall(m.group().lower())))
            if z >= 0:
                large += _softplus(z)
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
            else:
                small += _softplus(z)
                n_small += 1
        return -math.expm1(-self._total(small, large, n_small)), found

    def _total(self, small: float, large: float, n_small: int) -> float:
        """What sentences below 0.5, the others and the background add up to; 0 without a sentence."""
        if BACKGROUND not in self.weights or not (n_small or large):
            return small + large
        allowed = MEANS * n_small * self.weights[MEAN] + ERRORS * math.sqrt(n_small * self.weights[SQUARE])
        return _softplus(self.weights[BACKGROUND]) + max(0.0, small - allowed) + large


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def fit_noisy_or(texts: list[str], toxic: list[int], weight: tuple[float, float] = (1.0, 1.0)) -> NoisyOr:
    """Fit on labelled documents; ``weight`` is that of a clean and of a toxic document.

    Documents most of whose sentences have been seen before are passed over.

    Weights start at the cautious log odds of their features and are held near them, so that
    a word is not forgotten because others have already explained its documents.
    """
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return NoisyOr({}, 20.0 if len(y) and y.all() else -20.0)
    words_by_name: dict[str, int] = {}
    features_of: list[tuple[str, ...]] = []
    bags, seen, met, fresh = [], (Counter(), Counter()), set(), []
    for text, label in zip(texts, y):
        sentences = [m.group().lower() for m in SENTENCE.finditer(text)]
        digests = [hash(s) for s in sentences]
        fresh.append(2 * sum(d not in met for d in digests) >= len(digests))
        if not fresh[-1]:
            continue  # a copy of one before: its words are no further evidence
        met.update(digests)
        bag = []
        for sentence in sentences:
            numbers = array("i")
            for word in sorted(set(WORD.findall(sentence))):
                if word not in words_by_name:
                    words_by_name[word] = len(features_of)
                    features_of.append(tuple(word_features(word)))
                numbers.append(words_by_name[word])
            bag.append(numbers)
        seen[int(label)].update({f for numbers in bag for w in numbers for f in features_of[w]})
        bags.append(bag)
    y = y[np.array(fresh, bool)]
    n_clean, n_toxic = int((~y).sum()), int(y.sum())
    if not n_clean or not n_toxic:
        return NoisyOr({}, -20.0)

    def telling(f: str) -> float:
        """How far apart the shares of toxic and clean documents with the feature are, in standard errors."""
        a, b = seen[1][f], seen[0][f]
        share = (a + b + 1) / (n_clean + n_toxic + 2)
        return abs(a / n_toxic - b / n_clean) / math.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))

    common = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= LEAST_DOCUMENTS]
    chosen = sorted(common, key=lambda f: (-telling(f), f))[:FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    hits_of = [tuple(index[f] for f in features if f in index) for features in features_of]

    def outset(f: str) -> float:
        """The log odds of the feature, as near to 0 as two standard errors allow."""
        a, b = seen[1][f] + 0.5, seen[0][f] + 0.5
        odds, error = math.log(a / n_toxic) - math.log(b / n_clean), 2 * math.sqrt(1 / a + 1 / b)
        return math.copysign(max(0.0, abs(odds) - error), odds)
    rows, columns, owner = array("i"), array("i"), array("i")
    plain = np.zeros(len(y))
    for d, bag in enumerate(bags):
        for words in bag:
            hits = sorted({h for w in words for h in hits_of[w]})
            if hits:
                rows.extend([len(owner)] * len(hits))
                columns.extend(hits)
                owner.append(d)
            else:
                plain[d] += 1
    sentence, feature = np.array(rows, np.int64), np.array(columns, np.int64)
    owners, sample = np.array(owner, np.int64), np.where(y, weight[1], weight[0])
    sample = sample / sample.sum()

    start = np.array([outset(f) for f in chosen])
    w, b, c = start.copy(), -6.0, -4.0
    first, second = np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)
    for step in range(1, STEPS + 1):
        z = np.clip(b + np.bincount(sentence, w[feature], len(owners)), -30, 30)
        total = np.bincount(owners, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, b) + np.logaddexp(0, c)
        slope = sample * np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        by_sentence = slope[owners] / (1 + np.exp(-z))
        of_bias = by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-b))
        g = np.concatenate([np.bincount(feature, by_sentence[sentence], len(w)) + DECAY * (w - start), [of_bias, slope.sum() / (1 + np.exp(-c))]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b, c = w - move[:-2], b - move[-2], c - move[-1]
    w[np.abs(w) <= 0.05] = 0.0
    z = b + np.bincount(sentence, w[feature], len(owners))
    added, at_bias = np.logaddexp(0, z), float(np.logaddexp(0, b))
    below = z < 0
    small, n_small = np.bincount(owners, np.where(below, added, 0.0), len(y)), np.bincount(owners, below, len(y))
    large = np.bincount(owners, np.where(below, 0.0, added), len(y))
    squares = np.bincount(owners, np.where(below, added, 0.0) ** 2, len(y))
    if b < 0:
        small, n_small, squares = small + plain * at_bias, n_small + plain, squares + plain * at_bias**2
    else:
        large = large + plain * at_bias
    among = max(1.0, float(n_small[~y].sum()))
    mean, square = max(float(small[~y].sum()) / among, at_bias), max(float(squares[~y].sum()) / among, at_bias**2)
    told = large + np.maximum(0.0, small - MEANS * n_small * mean - ERRORS * np.sqrt(n_small * square))
    share = float(1 / (1 + np.exp(-c)))
    for _ in range(STEPS):  # share of documents toxic for what no counted sentence explains
        share = float((sample * y * share / (1 - (1 - share) * np.exp(-told))).sum())
        share = min(max(share, 1e-9), 1 - 1e-9)
    model = NoisyOr({f: float(v) for f, v in zip(chosen, w) if v}, float(b))
    model.weights |= {BACKGROUND: math.log(share / (1 - share)), MEAN: mean, SQUARE: square}
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_chars: int = FIT_CHARS) -> NoisyOr:
    """Fit on at most ``fit_toxic`` and ``fit_clean`` labelled documents of at most ``fit_chars`` characters in all.

    They are those with the least hashes of their ids, weighted to the shares of all labelled
    rows.  Documents are read whole, long ones too; either kind has its part of ``fit_chars``,
    and one that no longer fits into what is left of it is passed over.  Rows without id, label or text are left out; of several labels of one id the
    greatest counts.  Without documents of both kinds every text gets the same verdict.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__fw_id")).agg(F.max(label_col).alias("__fw_label"))
    counts = {r[0]: r[1] for r in known.groupBy("__fw_label").count().collect()}
    key = F.col("__fw_id").cast("string")
    sample = [least_hashes(known.where(F.col("__fw_label") == kind), key, most, counts.get(kind, 0)) for kind, most in ((1, fit_toxic), (0, fit_clean))]
    few = F.broadcast(sample[0].union(sample[1]))  # at most fit_toxic + fit_clean rows
    rows = docs.join(few, F.col(id_col) == F.col("__fw_id")).where(F.col(text_col).isNotNull()).select("__fw_label", F.col(text_col).alias("t"), "__fw_id")
    sizes = rows.groupBy("__fw_label", "__fw_id").agg(F.max(F.length("t")).alias("n")).orderBy(F.xxhash64("__fw_id"), "__fw_id").collect()
    left = {1: fit_chars * fit_toxic // max(1, fit_toxic + fit_clean), 0: fit_chars * fit_clean // max(1, fit_toxic + fit_clean)}
    fitting = []
    for label, key, size in sizes:
        if size <= left[label]:
            left[label] -= size
            fitting.append((key,))
    if len(fitting) < len(sizes):
        chosen = docs.sparkSession.createDataFrame(fitting, rows.select("__fw_id").schema)
        rows = rows.join(F.broadcast(chosen), "__fw_id", "left_semi").select("__fw_label", "t", "__fw_id")
    got = rows.dropDuplicates(["__fw_id"]).orderBy("__fw_id").collect()
    taken = Counter(r[0] for r in got)
    weight = tuple(counts.get(kind, 0) / max(1, taken[kind]) for kind in (0, 1))
    return fit_noisy_or([r[1] for r in got], [r[0] for r in got], weight)


SCORED = "struct<score: double, offending: array<struct<start: int, end: int, score: double>>>"


def score_column(text: Column | str, model: Broadcast) -> Column:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf(SCORED)
    def score(texts: pa.Array) -> pa.Array:
        rows = [model.value.score(t.as_py()) for t in texts]
        spans = pa.array([[dict(zip(("start", "end", "score"), s)) for s in found] for _, found in rows], pa.list_(span))
        return pa.StructArray.from_arrays([pa.array([s for s, _ in rows], pa.float64()), spans], names=["score", "offending"])

    return score(text)


def score_documents(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of each whole text and its offending sentences: (id, score, offending).

    A sentence offends if its own score is 0.5 or more; places are code points, the end
    exclusive.  NULL and empty texts have no sentence and score 0.  Rows stand alone:
    repeated rows and NULL ids are returned as they come, an empty table gives an empty
    result, other columns are not carried and cannot clash.
    """
    return docs.select(F.col(id_col), score_column(F.col(text_col), model).alias("__fw_s")).select(id_col, "__fw_s.score", "__fw_s.offending")


def keep_clean(docs: DataFrame, model: Broadcast, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, with their own columns."""
    return docs.withColumn("__fw_s", score_column(F.col(text_col), model)["score"]).where(F.col("__fw_s") < threshold).drop("__fw_s")


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text leaves ``fold`` when divided by ``folds``; false for NULL."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))
