"""Yes/no and one-of-several columns derived from text by a user's callable.

The callable runs inside Spark tasks on Arrow batches; nothing passes through the driver
and no row ids are joined back.
"""

from __future__ import annotations

import heapq
import operator
import sys
import time
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.config import Extraction

Extractor = Callable[[str], object]

#: Calls of a batch that run side by side.
AT_ONCE = 10

# what runs in tasks travels with them, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RetryableError(Exception):
    """A failure that may pass, such as an overloaded service; any error with ``retryable`` set counts as one."""

    retryable = True


@dataclass(frozen=True)
class KeywordRule:
    """The first value one of whose words a text contains, case aside; as a callable, and as a column that needs no Python."""

    words: dict[object, list[str]]
    default: object

    def __call__(self, text: str) -> object:
        low = text.lower()
        return next((value for value, words in self.words.items() if any(w.lower() in low for w in words)), self.default)

    def column(self, text: Column) -> Column:
        low, value = F.lower(text), F.lit(self.default)
        for answer, words in reversed(self.words.items()):
            value = F.when(reduce(operator.or_, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(False)), F.lit(answer)).otherwise(value)
        return value


def keyword_flag(words: list[str]) -> KeywordRule:
    """Whether a text contains any of the words."""
    return KeywordRule({True: words}, False)


def keyword_choice(words: dict[str, list[str]], default: str) -> KeywordRule:
    """The first value one of whose words a text contains."""
    return KeywordRule(words, default)


def _attempt(text: str, extractor: Extractor, allowed: tuple) -> tuple[tuple, bool]:
    """(value, ok, error) of one call, and whether another may do better."""
    try:
        value = extractor(text)
    except Exception as error:  # noqa: BLE001 - the row's error column carries any failure
        return (None, False, str(error)), bool(getattr(error, "retryable", False))
    return ((value, True, None) if value in allowed else (None, False, f"not an allowed value: {value!r}")), False


def run_batch(texts: Iterable[str | None], extractor: Extractor, allowed: tuple, retries: int, backoff: float, at_once: int = AT_ONCE) -> list[tuple]:
    """(value, ok, error) for each text, in their order; blank text is a success without a value.

    Up to ``at_once`` calls run side by side.  A call that may be tried again waits for its
    turn in a queue, holding up no other.
    """
    texts = list(texts)
    out: list[tuple] = [(None, True, None) if t is None or not t.strip() else (None, False, "no attempt was made") for t in texts]
    due = [(0.0, i, 0) for i, done in enumerate(out) if not done[1]] if retries > 0 else []  # time, place, attempts before
    running: dict = {}
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        while due or running:
            now = time.monotonic()
            while due and due[0][0] <= now and len(running) < at_once:
                _, i, before = heapq.heappop(due)
                running[pool.submit(_attempt, texts[i], extractor, allowed)] = i, before
            pause = max(0.0, due[0][0] - now) if due and len(running) < at_once else None
            if not running:
                time.sleep(pause)
                continue
            for call in wait(running, pause, FIRST_COMPLETED).done:
                i, before = running.pop(call)
                out[i], again = call.result()
                if again and before + 1 < retries:
                    heapq.heappush(due, (time.monotonic() + backoff * 2**before, i, before + 1))
    return out


def run_extractor(text: str | None, extractor: Extractor, allowed: tuple, retries: int, backoff: float) -> tuple:
    """(value, ok, error) for one text."""
    return run_batch([text], extractor, allowed, retries, backoff, 1)[0]


def extract_column(
    df: DataFrame, extraction: Extraction, extractor: Extractor, retries: int = 3, backoff: float = 1.0, keep_status: bool = False,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Add the extracted column, NULL where the text is blank or extraction failed.

    ``keep_status`` also keeps ``_<output>_ok`` and ``_<output>_error``.  An extractor that has a
    ``column`` form is evaluated by Spark itself; any other callable runs on Arrow batches,
    ``at_once`` calls side by side (1 for one that is not safe to call from several threads).
    """
    if extraction.values is not None and len(extraction.values) < 2:
        raise ValueError("a choice needs at least two values")
    allowed = extraction.values or (True, False)
    dtype = T.StringType() if extraction.values else T.BooleanType()
    fields = [T.StructField("value", dtype), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]

    if hasattr(extractor, "column"):
        text = F.col(f"`{extraction.source}`").cast("string")
        value = F.when(text.rlike(r"(?U)\S"), extractor.column(text))
        fine = value.isNull() | value.isin(*allowed)
        out = df.withColumn(extraction.output, F.when(fine, value))
        error = F.when(~fine, F.concat(F.lit("not an allowed value: "), value.cast("string")))
        return out.withColumns({f"_{extraction.output}_ok": fine, f"_{extraction.output}_error": error}) if keep_status else out

    def batch(texts: pd.Series) -> pd.DataFrame:
        rows = run_batch(texts, extractor, allowed, retries, backoff, at_once)
        return pd.DataFrame(rows, columns=["value", "ok", "error"], dtype=object)

    # a callable may answer differently each time, so Spark must not evaluate it twice
    run = F.pandas_udf(batch, T.StructType(fields)).asNondeterministic()
    out = df.withColumn("_extracted", run(F.col(extraction.source).cast("string")))
    out = out.withColumn(extraction.output, F.col("_extracted.value"))
    if keep_status:
        out = out.withColumns(
            {f"_{extraction.output}_ok": F.col("_extracted.ok"), f"_{extraction.output}_error": F.col("_extracted.error")}
        )
    return out.drop("_extracted")
