"""Made-up secrets and harmless runs of many forms, for the network of ``secret_scan``.

A form makes (before, run) from a random state and words of the corpus: what must stand
before the run for it to be what it is, and the run.  Whole forms are held out of training,
so that thresholds and tests see runs of a make that the network has not met.
"""

from __future__ import annotations

from collections.abc import Callable

from numpy.random import RandomState

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
ALNUM = UPPER + LOWER + DIGITS
HEX = DIGITS + "abcdef"

#: Words before short keys, which nothing else tells from names of things.
CUES = ("pwd ", "pwd=", "pass: ", "passphrase: ", "login with ", "credentials ", "key=", "auth: ", "pw: ")
ENDINGS = ("jpg", "png", "pdf", "txt", "csv", "docx", "html", "tar.gz", "log", "py")

Form = Callable[[RandomState, list[str]], tuple[str, str]]


def _run(draw: RandomState, letters: str, least: int, most: int) -> str:
    return "".join(letters[i] for i in draw.randint(len(letters), size=draw.randint(least, most + 1)))


def _pick(draw: RandomState, values: tuple[str, ...] | list[str]) -> str:
    return values[draw.randint(len(values))]


def _number(draw: RandomState, least: int, most: int, width: int = 0) -> str:
    return str(draw.randint(least, most)).zfill(width)


def _date(draw: RandomState, joint: str = "") -> str:
    return joint.join((_number(draw, 1960, 2040), _number(draw, 1, 13, 2), _number(draw, 1, 29, 2)))


def _bare(make: Callable[[RandomState, list[str]], str]) -> Form:
    return lambda draw, words: ("", make(draw, words))


def _cued(make: Callable[[RandomState, list[str]], str]) -> Form:
    return lambda draw, words: (_pick(draw, CUES), make(draw, words))


SECRETS: dict[str, Form] = {
    "letters and digits": _bare(lambda d, w: _run(d, ALNUM, 20, 44)),
    "letters and digits after a short prefix": _bare(lambda d, w: _run(d, LOWER, 2, 5) + _pick(d, ("_", "-")) + _run(d, ALNUM, 16, 40)),
    "two prefixes": _bare(lambda d, w: f"{_run(d, LOWER, 2, 3)}_{_pick(d, w).lower()[:6]}_{_run(d, ALNUM, 16, 32)}"),
    "held out: number and letters after a prefix": _bare(lambda d, w: f"{_run(d, LOWER, 3, 4)}-{_run(d, DIGITS, 10, 12)}-{_run(d, ALNUM, 20, 24)}"),
    "capitals and digits": _bare(lambda d, w: _run(d, UPPER + DIGITS, 18, 36)),
    "small letters and digits": _bare(lambda d, w: _run(d, LOWER + DIGITS, 18, 44)),
    "base 64": _bare(lambda d, w: _run(d, ALNUM + "+/", 22, 60) + "=" * d.randint(3)),
    "held out: base 64 of addresses": _bare(lambda d, w: _run(d, ALNUM + "-_", 22, 60)),
    "three parts with points": _bare(lambda d, w: ".".join(_run(d, ALNUM, 16, 40) for _ in range(3))),
    "hexadecimal capitals": _bare(lambda d, w: _run(d, DIGITS + "ABCDEF", 24, 64)),
    "groups of five": _bare(lambda d, w: "-".join(_run(d, UPPER + DIGITS, 5, 5) for _ in range(5))),
    "held out: capital prefix": _bare(lambda d, w: _run(d, UPPER, 3, 4) + "a" + _run(d, ALNUM + "-_", 24, 35)),
    "short key": _cued(lambda d, w: _run(d, ALNUM, 8, 14)),
    "word and number": _cued(lambda d, w: _pick(d, w).lower() + _number(d, 1, 9999) + _run(d, ALNUM, 1, 3)),
    "words and number": _cued(lambda d, w: f"{_pick(d, w)}-{_pick(d, w)}-{_number(d, 10, 9999)}"),
}

HARMLESS: dict[str, Form] = {
    "date": _bare(lambda d, w: _date(d, _pick(d, ("-", "/", ".")))),
    "held out: instant": _bare(lambda d, w: f"{_date(d, '-')}T{_number(d, 0, 24, 2)}"),
    "version": _bare(lambda d, w: f"{_pick(d, ('v', ''))}{_number(d, 0, 20)}.{_number(d, 0, 90)}.{_number(d, 0, 90)}{_pick(d, ('', '-beta', '-rc1', '.post2'))}"),
    "camera file": _bare(lambda d, w: f"{_run(d, UPPER, 2, 4)}_{_date(d)}_{_run(d, DIGITS, 6, 6)}.{_pick(d, ENDINGS)}"),
    "named file": _bare(lambda d, w: f"{_pick(d, w)}_{_pick(d, w)}{_pick(d, ('', '-v2', '_final', '_03'))}.{_pick(d, ENDINGS)}"),
    "held out: dated file": _bare(lambda d, w: f"{_pick(d, w)}-{_date(d, '-')}.{_pick(d, ENDINGS)}"),
    "capitals and a small number": _bare(lambda d, w: f"{_run(d, UPPER, 3, 6)}-{_number(d, 1, 100)}"),
    "phone number": _bare(lambda d, w: _pick(d, ("0", "+49", "+1-")) + _run(d, DIGITS, 7, 11)),
    "phone number in groups": _bare(lambda d, w: "-".join(_run(d, DIGITS, 2, 4) for _ in range(4))),
    "short commit": _bare(lambda d, w: _run(d, HEX, 7, 10)),
    "number": _bare(lambda d, w: _run(d, DIGITS, 6, 18)),
    "held out: book number": _bare(lambda d, w: f"978-{_number(d, 0, 9)}-{_run(d, DIGITS, 2, 3)}-{_run(d, DIGITS, 5, 6)}-{_number(d, 0, 9)}"),
    "held out: document number": _bare(lambda d, w: f"{_run(d, UPPER, 2, 4)}-{_number(d, 1990, 2040)}-{_run(d, DIGITS, 3, 6)}"),
    "path": _bare(lambda d, w: "/" + "/".join(_pick(d, w).lower() for _ in range(d.randint(2, 5))) + _number(d, 1, 30)),
    "address": _bare(lambda d, w: f"{_pick(d, w).lower()}{_number(d, 1, 20)}.{_pick(d, w).lower()}.com/{_pick(d, w).lower()}/{_run(d, LOWER, 1, 3)}"),
    "held out: address of a page": _bare(lambda d, w: f"www.{_pick(d, w).lower()}.org/{_date(d, '/')}/{_pick(d, w).lower()}-{_pick(d, w).lower()}.html"),
    "joined name": _bare(lambda d, w: "".join(_pick(d, w).capitalize() for _ in range(d.randint(2, 5)))),
    "name with underscores": _bare(lambda d, w: "_".join(_pick(d, w).lower() for _ in range(d.randint(2, 5))) + f"_{_number(d, 1, 100)}"),
    "constant": _bare(lambda d, w: "_".join(_pick(d, w).upper() for _ in range(d.randint(2, 4))) + f"_{_number(d, 1, 100)}"),
    "held out: joined name with a number": _bare(lambda d, w: _pick(d, w).lower() + _pick(d, w).capitalize() + _number(d, 1, 200)),
    "product": _bare(lambda d, w: f"{_pick(d, w).capitalize()}-{_run(d, UPPER, 0, 1)}{_number(d, 1, 999)}"),
    "amount": _bare(lambda d, w: f"{_number(d, 1, 999)}.{_run(d, DIGITS, 3, 3)}.{_run(d, DIGITS, 3, 3)}"),
    "unit": _bare(lambda d, w: f"{_number(d, 100, 99999)}{_pick(d, ('km/h', 'm/s', 'kWh/a', 'mg/dl'))}"),
    "identifier in groups": _bare(lambda d, w: "-".join(_run(d, HEX, n, n) for n in (8, 4, 4, 4, 12))),
    "hyphened words": _bare(lambda d, w: "-".join(_pick(d, w) for _ in range(d.randint(3, 7)))),
}


def made(draw: RandomState, words: list[str], each: int, held_out: bool) -> list[tuple[str, str, int]]:
    """(before, run, whether it is a secret): ``each`` runs of every trained form, or of every held-out one."""
    found = []
    for label, forms in ((1, SECRETS), (0, HARMLESS)):
        for name, form in forms.items():
            if name.startswith("held out") == held_out:
                found += [(*form(draw, words), label) for _ in range(each)]
    return found
