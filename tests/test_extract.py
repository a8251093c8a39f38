"""Calls side by side, in order, with retries that hold up nothing."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from fernweave.config import Extraction
from fernweave.plans import extract


def test_calls_run_side_by_side_and_keep_their_order():
    running, most, lock = 0, 0, threading.Lock()

    def call(text: str) -> bool:
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.05)
        with lock:
            running -= 1
        return int(text) % 2 == 0

    began = time.monotonic()
    rows = extract.run_batch([str(i) for i in range(100)], call, (True, False), 1, 1.0)
    assert time.monotonic() - began < 1.0 and most == extract.AT_ONCE
    assert rows == [(i % 2 == 0, True, None) for i in range(100)]
    extract.run_batch(["1", "2", "3"], call, (True, False), 1, 1.0, at_once=1)


def test_waiting_retries_hold_up_no_other_call():
    tries: dict[str, int] = {}

    def call(text: str) -> bool:
        tries[text] = tries.get(text, 0) + 1
        if text.startswith("busy") and tries[text] < 3 or text == "never":
            raise extract.RetryableError(f"{text} is busy")
        if text == "broken":
            raise ValueError("no use")
        return text != "odd" or "other"

    texts = [*(f"busy{i}" for i in range(30)), "never", "broken", "odd", None, " ", "fine"]
    began = time.monotonic()
    rows = extract.run_batch(texts, call, (True, False), 3, 0.2)
    assert time.monotonic() - began < 1.5  # one after the other the waits alone are 30 * 0.6 s
    assert rows[:30] == [(True, True, None)] * 30
    assert rows[30:] == [(None, False, "never is busy"), (None, False, "no use"), (None, False, "not an allowed value: 'other'"), (None, True, None), (None, True, None), (True, True, None)]
    assert tries["never"] == 3 and tries["broken"] == 1


@pytest.mark.parametrize("retries", [0, 1])
def test_few_attempts(retries):
    assert extract.run_batch([], lambda t: True, (True,), retries, 0) == []
    assert extract.run_batch(["x"], lambda t: True, (True, False), retries, 0)[0][1] == bool(retries)


def test_a_slow_callable_on_a_frame(spark):
    def slow(text: str) -> str:
        time.sleep(0.02)
        if text == "7":
            raise ValueError("seven")
        return "a" if int(text) < 50 else "b"

    df = spark.range(200).select("id", F.col("id").cast("string").alias("t")).coalesce(1)
    out = extract.extract_column(df, Extraction("t", "kind", ("a", "b")), slow, keep_status=True).collect()
    assert {r["id"]: (r["kind"], r["_kind_error"]) for r in out} == {i: (None, "seven") if i == 7 else ("a" if i < 50 else "b", None) for i in range(200)}
