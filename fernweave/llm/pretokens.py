"""Cut text into the pieces inside which byte-pair merges happen."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import regex
from public_tokenizers import PATTERN

#: What PATTERN says of ASCII text, in the faster of the two regular expression engines.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z", 2).replace(r"\p{N}", "0-9", 2)
ASCII_PATTERN = ASCII_PATTERN.replace("?A-Za-z+", "?[A-Za-z]+", 1).replace("?0-9+", "?[0-9]+", 1)

_general = regex.compile(PATTERN)
_ascii = re.compile(ASCII_PATTERN, re.ASCII)

#: Texts above this many characters are cut up in runs of pieces, so that no list of all pieces is held.
LONG_TEXT = 1 << 20
RUN = 1 << 16


def pieces(text: str) -> Iterator[list[str]]:
    """The pieces of a text in order, as one list or, for a long text, as several."""
    pattern = _ascii if text.isascii() else _general
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while run := list(islice(found, RUN)):
        yield run
