"""Exact quantiles without collecting or sorting a column in one place."""

from __future__ import annotations

import math
import random
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of each range drawn in a pass, on average; a range of at most this many is drawn whole.
SAMPLE = 4000


def _order(value: object) -> tuple:
    """Spark's order: NaN above everything."""
    nan = isinstance(value, float) and math.isnan(value)
    return nan, 0 if nan else value


def _between(first: object, second: object, share: float) -> object:
    if not share or first == second:
        return first
    if share == 0.5:
        return (first + second) / 2
    if isinstance(first, Decimal):
        return first + (second - first) * Decimal(share)
    return first + (second - first) * share


def _split(df: DataFrame, column: str, within: tuple, a: object, b: object) -> list[Column]:
    """Counts of a column's values inside the open range: below a, equal, between, equal to b, above b."""
    x, kind = F.col(f"`{column}`"), df.schema[column].dataType
    low, high, first, last = (None if v is None else F.lit(v).cast(kind) for v in (*within, a, b))
    inside = _inside(x, low, high)
    return [F.count_if(inside & part) for part in (x < first, x == first, (x > first) & (x < last), (x == last) & (x != first), x > last)]


def _inside(x: Column, low: Column | None, high: Column | None) -> Column:
    above = x.isNotNull() if low is None else x > low
    return above if high is None else above & (x < high)


def select_ranks(df: DataFrame, counts: dict[str, int], wanted: list[tuple[str, int]], sample: int = SAMPLE) -> tuple[dict, int]:
    """Values at the given ranks (column, rank from 0), and the passes it took.

    ``counts`` has each column's filled rows.  The open range of a rank lies strictly between
    two values.  A pass draws about ``sample`` rows of it, takes two drawn values closely
    around the rank as cuts, and counts the rows below, equal to the first, between, equal to
    the second, and above.  A rank that falls on a cut is found, however many rows are equal;
    otherwise the cuts drop out, so every pass shortens the range, in rows about twentyfold.
    """
    found: dict[tuple[str, int], object] = {}
    open_ = {(c, r): (None, None, 0, counts[c]) for c, r in wanted}  # least and greatest value outside, rows below, rows inside
    draw, passes = random.Random(0), 0
    while open_:
        passes += 1
        ranges = {(c, below, n): (low, high) for (c, _), (low, high, below, n) in open_.items()}
        picks = []
        for i, ((c, _, n), (low, high)) in enumerate(ranges.items()):
            x, kind = F.col(f"`{c}`"), df.schema[c].dataType
            taken = _inside(x, *(None if v is None else F.lit(v).cast(kind) for v in (low, high)))
            if n > sample:
                taken = taken & (F.rand(draw.getrandbits(30)) < sample / n)
            picks.append(F.when(taken, x).alias(f"s{i}"))
        lists = df.select(*picks).agg(*(F.collect_list(f"s{i}").alias(f"s{i}") for i in range(len(picks)))).first()
        drawn = {key: sorted(values, key=_order) for key, values in zip(ranges, lists)}
        cuts: dict[tuple, tuple] = {}
        for (c, rank), (low, high, below, n) in list(open_.items()):
            values = drawn[c, below, n]
            if n <= sample:
                found[c, rank] = values[rank - below]
                del open_[c, rank]
            elif values:
                middle, spread = (rank - below) / n * len(values), 2 * math.sqrt(len(values)) + 2
                cuts[c, rank] = (values[max(0, int(middle - spread))], values[min(len(values) - 1, int(middle + spread))])
        if not cuts:
            continue
        row = df.agg(*(part.alias(f"p{i}_{j}") for i, (key, ab) in enumerate(cuts.items()) for j, part in enumerate(_split(df, key[0], open_[key][:2], *ab)))).first()
        for i, ((c, rank), (a, b)) in enumerate(cuts.items()):
            low, high, below, _ = open_.pop((c, rank))
            for part, ends in zip(row[5 * i : 5 * i + 5], ((low, a), (a, a), (a, b), (b, b), (b, high))):
                if rank < below + part:
                    break
                below += part
            if ends in ((a, a), (b, b)):
                found[c, rank] = ends[0]
            else:
                open_[c, rank] = (*ends, below, part)
    return found, passes


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, object]:
    """The interpolated quantile of several numeric columns, None where a column has no value.

    Values are compared in the column's own type, and ranges shrink by rows and not by value,
    so ties, infinities and outliers do no harm.  A pass is two jobs for all columns together.
    """
    counts = df.agg(*(F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).first()
    places = {c: q * (n - 1) for c, n in zip(columns, counts) if n}
    wanted = [(c, r) for c, place in places.items() for r in {math.floor(place), math.ceil(place)}]
    values, _ = select_ranks(df, dict(zip(columns, counts)), wanted)
    return {
        c: _between(values[c, math.floor(places[c])], values[c, math.ceil(places[c])], places[c] - math.floor(places[c])) if c in places else None
        for c in columns
    }


def exact_quantile(df: DataFrame, column: str, q: float = 0.5) -> object:
    """The interpolated quantile of one numeric column, or None."""
    return exact_quantiles(df, [column], q)[column]
