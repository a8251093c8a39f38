"""Text clean-up as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.session import small_batches

# The accented letters and the plain letter each one becomes.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uppercase(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column) -> Column:
    return F.trim(c)


def normalize_spaces(c: Column) -> Column:
    """Runs of whitespace become one space; none at either end."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def remove_accents(c: Column) -> Column:
    """Accented letters become plain; text of one-byte characters has none and is passed as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))


_MARKS = re.compile("[\u0300-\u036f]+")


@F.arrow_udf(T.StringType())
def _drop_marks(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else _MARKS.sub("", unicodedata.normalize("NFD", t)) for t in (v.as_py() for v in texts)), pa.string())


def remove_all_accents(c: Column) -> Column:
    """Every combining mark, not just the usual letters; needs Python, so opt in.

    Texts go to Python in small batches; those of one-byte characters have no marks and are passed as they are.
    """
    if session := SparkSession.getActiveSession():
        small_batches(session)
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, c).otherwise(_drop_marks(F.when(~plain, c)))


def _each_run(c: Column, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to each run of letters and each run of other characters."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), change), "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters (also after ``'`` and ``-``)."""
    return _each_run(F.lower(c), lambda run: F.concat(F.upper(F.substring(run, 1, 1)), run.substr(F.lit(2), F.length(run))))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def swap_case(c: Column) -> Column:
    letters = F.split(c, "")
    return F.array_join(F.transform(letters, lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


#: Steps a rule may run on a value before matching it.
PREPROCESSORS: dict[str, Callable[[Column], Column]] = {
    "digits_only": lambda c: F.regexp_replace(c, r"[^0-9]", ""),
    "letters_only": lambda c: F.regexp_replace(c, r"[^a-zA-Z]", ""),
    "alphanumeric": lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9]", ""),
    "no_spaces": lambda c: F.replace(c, F.lit(" "), F.lit("")),
    "strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "uppercase": uppercase,
    "lowercase": lowercase,
    "capitalize": capitalize,
    "title": title_case,
    "swapcase": swap_case,
    "normalize_spaces": normalize_spaces,
    "remove_accents": remove_accents,
}


def preprocess(c: Column, chain: str | None) -> Column:
    """Run a ``|``-separated chain of steps; an unknown step is an error."""
    for step in filter(None, (s.strip() for s in (chain or "").split("|"))):
        if step not in PREPROCESSORS:
            raise ValueError(f"unknown pre-processing step {step!r}")
        c = PREPROCESSORS[step](c)
    return c
