"""Value templates such as ``{d3}.{d3}-{d2}`` as regular expressions on columns.

A template names the *output* form.  ``{d}``/``{l}``/``{L}``/``{w}`` take one digit,
lower-cased letter, upper-cased letter or word character; a number repeats it, ``D``
and ``W`` take one or more, ``?`` makes a part optional and anything else is a literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernweave.functions.text import preprocess

_TOKEN = re.compile(r"\{([^}]*)\}|([^{]+)")
_SLOT = re.compile(r"([dDlLwW])(\d*)(\??)")
_CHARS = {"d": "[0-9]", "l": "[A-Za-z]", "w": "[A-Za-z0-9_]"}


@dataclass(frozen=True)
class Slot:
    """One captured part: its pattern and the case its letters get."""

    pattern: str
    case: str | None = None


@dataclass(frozen=True)
class Template:
    text: str
    parts: tuple[str | Slot, ...]
    pre: str

    @property
    def slots(self) -> list[Slot]:
        return [p for p in self.parts if isinstance(p, Slot)]

    def regex(self, prefix: bool = False) -> str:
        return "^" + "".join(f"({s.pattern})" for s in self.slots) + ("" if prefix else r"\z")

    def replacement(self) -> str:
        """The output with ``$n`` for slot n; ``$`` and ``\\`` in literals are escaped."""
        out, n = [], 0
        for part in self.parts:
            if isinstance(part, Slot):
                n += 1
                out.append(f"${n}")
            else:
                out.append(re.sub(r"([\\$])", r"\\\1", part))
        return "".join(out)


def template_error(text: str) -> str | None:
    """Why a template is not usable, or None."""
    if text.count("{") != text.count("}"):
        return "unbalanced braces"
    for inner in re.findall(r"\{([^}]*)\}", text):
        quoted = len(inner) >= 2 and inner[0] == inner[-1] == '"'
        if not quoted and not _SLOT.fullmatch(inner):
            return f"unknown placeholder {{{inner}}}"
    return None


def _repeat(letter: str, count: str, optional: str, loose: bool) -> str:
    variable = letter in "DW" or (loose and letter == "L")
    if variable and (loose or not count):
        return "*" if optional else "+"
    if count:
        return f"{{0,{count}}}" if optional and loose else f"{{{count}}}"
    return "?" if optional else ""


def parse_template(text: str, pre: str | None = None, loose: bool = False) -> Template:
    """Compile a template; ``loose`` lets every capital slot take one or more characters."""
    problem = template_error(text)
    if problem:
        raise ValueError(problem)
    parts: list[str | Slot] = []
    kinds: set[str] = set()
    for inner, literal in _TOKEN.findall(text):
        slot = _SLOT.fullmatch(inner)
        if literal or not slot:
            parts.append(literal or inner[1:-1])
            continue
        letter, count, optional = slot.groups()
        kinds.add(letter.lower())
        pattern = _CHARS[letter.lower()] + _repeat(letter, count, optional, loose)
        if count and optional and not loose:
            pattern = f"(?:{pattern})?"
        parts.append(Slot(pattern, {"l": "lower", "L": "upper"}.get(letter)))
    auto = {("d",): "digits_only", ("l",): "letters_only"}.get(tuple(sorted(kinds)), "alphanumeric")
    return Template(text, tuple(parts), auto if pre is None else pre)


def rewrite(c: Column, text: str) -> Column:
    """Format a value that fits the template; any other value passes unchanged."""
    t = parse_template(text)
    return F.regexp_replace(c, t.regex(), t.replacement())


def normalise(c: Column, text: str, pre: str | None = None, prefix: bool = False) -> Column:
    """Pre-process, match and format; NULL when the value does not fit.

    ``prefix=True`` ignores extra input after the match and lets capital slots vary in length.
    """
    t = parse_template(text, pre, loose=prefix)
    value, regex = preprocess(c.cast("string"), t.pre), t.regex(prefix)
    pieces, n = [], 0
    for part in t.parts:
        if isinstance(part, Slot):
            n += 1
            piece = F.regexp_extract(value, regex, n)
            pieces.append({"upper": F.upper, "lower": F.lower}.get(part.case, lambda x: x)(piece))
        else:
            pieces.append(F.lit(part))
    return F.when((c.cast("string") != "") & value.rlike(regex), F.concat(*pieces))


# The rules every installation starts with (name: output template).
DEFAULT_RULES = {
    "cpf_formatado": "{d3}.{d3}.{d3}-{d2}",
    "cpf_limpo": "{d11}",
    "cnpj_formatado": "{d2}.{d3}.{d3}/{d4}-{d2}",
    "cnpj_limpo": "{d14}",
    "telefone_formatado": "({d2}) {d5}-{d4}",
    "telefone_fixo_formatado": "({d2}) {d4}-{d4}",
    "telefone_e164": "+55{d11}",
    "cep_formatado": "{d5}-{d3}",
    "cep_limpo": "{d8}",
    "data_iso": "{d4}-{d2}-{d2}",
    "data_br": "{d2}/{d2}/{d4}",
    "placa_antiga": "{L3}-{d4}",
    "placa_mercosul": "{L3}{d}{L}{d2}",
}


def normalise_by_rule(c: Column, rule: str, rules: dict[str, str] | None = None) -> Column:
    """Normalise with a named rule."""
    known = DEFAULT_RULES if rules is None else rules
    if rule not in known:
        raise ValueError(f"unknown rule {rule!r}")
    return normalise(c, known[rule])


def normalise_result(c: Column, rule: str, rules: dict[str, str] | None = None) -> Column:
    """Outcome record per value: ok, original, normalised, rule, error."""
    result = normalise_by_rule(c, rule, rules)
    empty = F.coalesce(c.cast("string"), F.lit("")) == ""
    return F.struct(
        result.isNotNull().alias("ok"),
        F.coalesce(c.cast("string"), F.lit("")).alias("original"),
        result.alias("normalised"),
        F.when(~empty, F.lit(rule)).alias("rule"),
        F.when(empty, "empty value").when(result.isNull(), "value does not fit the rule").alias("error"),
    )
