"""Predict languages by estimating each document as a mixture of them.

Every language is a distribution over letter trigrams.  Expectation-maximisation finds the
proportions of the languages that best explain a document's trigrams; the set of languages
grows from the strongest one as long as the likelihood gains more than a penalty for each.

The distributions are counted in Spark over a sample of labelled documents whose size for
each language is a parameter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents of each language that a fit reads, on average of the hash, and languages and trigrams kept.
FIT_DOCUMENTS = 2000
MOST_LANGUAGES = 200
MOST_TRIGRAMS = 30_000

#: Added to every count; most rounds of the estimation; penalty for each further language, in logs of the text's length.
SMOOTHING = 0.5
ROUNDS = 30
PENALTY = 2.0

UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter; built once in each process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of a text; what is no letter is one space.

    A letter takes eight bits: ASCII itself, others by remainder.  Empty without a letter.
    """
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, np.where(points < 128, points, 128 + points % 127), 32).astype(np.int64)
    codes = np.concatenate([[32], codes, [32]])
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    return codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]


@dataclass
class Mixture:
    """Trigram distributions of languages."""

    languages: list[str]
    grams: np.ndarray
    logs: np.ndarray
    prior: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_place"}

    def _places(self) -> np.ndarray:
        if "_place" not in self.__dict__:
            place = np.zeros(1 << 24, np.int16)
            place[self.grams] = np.arange(1, len(self.grams) + 1)
            self._place, self._shares = place, np.exp(self.logs)
        return self._place

    def _proportions(self, shares: np.ndarray, counts: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        """Proportions of the given languages and the log-likelihood they reach."""
        p = np.full(shares.shape[1], 1 / shares.shape[1])
        for _ in range(ROUNDS):
            mixed = shares @ p
            better = p * ((counts / mixed) @ shares) / total
            done = np.abs(better - p).max() < 1e-3
            p = better
            if done:
                break
        return p, float(counts @ np.log(shares @ p))

    def proportions(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages of a text with their proportions, greatest first; empty without a letter."""
        found = trigrams(text)
        if not len(found) or not self.languages:
            return []
        counts = np.bincount(self._places()[found], minlength=len(self.grams) + 1)[1:]
        known = np.flatnonzero(counts)
        if not len(known):
            return [(self.languages[int(self.prior.argmax())], 1 / len(self.languages))]
        counts, logs = counts[known].astype(float), self.logs[known]
        total = counts.sum()
        alone = counts @ logs + np.log(self.prior)
        best = int(alone.argmax())
        chosen, reached, parts = [best], float(counts @ logs[:, best]), np.ones(1)
        if len(self.languages) > 1:
            shares = self._shares[known]
            whole, most = self._proportions(shares, counts, total)
            cost = PENALTY * np.log(total + 1)
            order = [best, *(int(i) for i in np.argsort(-whole, kind="stable") if i != best)]
            for size in range(2, len(order) + 1):
                if most - reached <= cost:  # even all languages together would not gain enough
                    break
                more, gained = self._proportions(shares[:, order[:size]], counts, total)
                if gained - reached <= cost:
                    break
                chosen, reached, parts = order[:size], gained, more
            if len(chosen) == 1:
                parts = whole[[best]]
        ranked = sorted(zip(chosen, parts), key=lambda c: (-c[1], c[0]))
        return [(self.languages[i], min(1.0, max(0.0, float(p)))) for i, p in ranked]


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", fit_documents: int = FIT_DOCUMENTS, most_languages: int = MOST_LANGUAGES) -> Mixture:
    """Count trigrams of about ``fit_documents`` documents of each language (all, where there are fewer).

    Documents are drawn by a hash of id and text.  Rows without text or label are left out.  The counts of
    the ``most_languages`` commonest labels and of the trigrams that rank highest within any of
    them reach the driver, so that rare languages keep theirs; further labels are never predicted.
    Without labelled rows the mixture has no language.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("key")
    )
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not sizes:
        return Mixture([], np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r[0], min(1.0, fit_documents / r[1]))))
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                grams, times = np.unique(trigrams(text.as_py()), return_counts=True)
                sums.setdefault(lang.as_py(), Counter()).update(dict(zip(grams.tolist(), times.tolist())))
            for lang, grams in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = drawn.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))  # one row for each trigram of a language
    pivoted = ranked.groupBy("gram").agg(
        F.min("place").alias("place"), *(F.sum(F.when(F.col("lang") == r[0], F.col("n")).otherwise(0)).alias(f"l{i}") for i, r in enumerate(sizes))
    )
    rows = pivoted.orderBy("place", "gram").limit(MOST_TRIGRAMS).collect()
    table = np.array([r[2:] for r in rows], float).reshape(len(rows), len(sizes)) + SMOOTHING
    totals = np.array([r[1] for r in sizes], float)
    return Mixture([r[0] for r in sizes], np.array([r[0] for r in rows], np.int64), np.log(table / table.sum(axis=0)), totals / totals.sum())


PREDICTED = "struct<lang: string, score: double, languages: array<struct<lang: string, share: double>>>"


def predict_column(text: Column | str, model: Broadcast) -> Column:
    part = pa.struct([("lang", pa.string()), ("share", pa.float64())])

    @F.arrow_udf(PREDICTED)
    def predict(texts: pa.Array) -> pa.Array:
        rows = [model.value.proportions(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0][0] if r else UNDETERMINED for r in rows], pa.string()),
                pa.array([r[0][1] if r else 0.0 for r in rows], pa.float64()),
                pa.array([[{"lang": a, "share": p} for a, p in r] for r in rows], pa.list_(part)),
            ],
            names=["lang", "score", "languages"],
        )

    return predict(text)


def predict_languages(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each whole text: (id, lang_pred, score, languages).

    ``score`` is the predicted language's proportion; ``languages`` lists the chosen set.
    NULL, empty and letterless texts are ``und`` with score 0.  Ties go to the commoner
    language.  Rows stand alone: repeated rows and NULL ids are returned as they come, an
    empty table gives an empty result, other columns are not carried and cannot clash.
    """
    made = docs.select(F.col(id_col), predict_column(F.col(text_col), model).alias("__fw_p"))
    return made.select(id_col, F.col("__fw_p.lang").alias("lang_pred"), "__fw_p.score", "__fw_p.languages")
