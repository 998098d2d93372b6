"""Graders: does a predicted answer equal the gold one?

The fast grader is a column expression. The full one is a function of two strings,
exposed as a pandas UDF, since it recurses into tuples and lists and reads expressions.
Answers are model output and untrusted: nothing here runs them as code, and the work
on each is bounded.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import symbolic
from .text import strip

LONGEST = 1000
#: Units that answers may carry.
UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "week", "month", "year",
    "foot", "feet", "inch", "yard", "p.m.", "PM",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MAGNITUDES = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _simple_number(c: Column) -> Column:
    """Value of a plain number, a percentage, or a fraction; null for anything else."""
    frac = r"^(-?)\\[dt]?frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}$"
    over = r"^(-?[\d.]+)/(-?[\d.]+)$"
    num = lambda x: x.try_cast("double")
    part = lambda p, k: num(F.nullif(F.regexp_extract(c, p, k), F.lit("")))
    sign = F.when(F.regexp_extract(c, frac, 1) == "-", -1.0).otherwise(1.0)
    return (
        F.when(c.rlike(f"^{_NUMBER}$"), num(c))
        .when(c.rlike(f"^{_NUMBER}%$"), num(F.regexp_replace(c, "%$", "")) / 100)
        .when(c.rlike(frac), sign * F.try_divide(part(frac, 2), part(frac, 3)))
        .when(c.rlike(over), F.try_divide(part(over, 1), part(over, 2)))
    )


def simple_normal(c: Column) -> Column:
    """Answer without white space, dollar signs, thousands separators, sizing and spacing commands."""
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"\\left|\\right|\\!|\\,|\;|\\ |\\\$|\$|\\%", "")
    c = F.regexp_replace(c, r"\\text\{([^}]*)\}", "$1")
    c = F.regexp_replace(c, r"\\[dt]frac", r"\\frac")
    c = F.regexp_replace(c, r"(\d),(?=\d{3}(\D|$))", "$1")
    return F.regexp_replace(c, r"(?U)\s+|\.$", "")


def simple_equal(pred: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """Equal after normalising, or as numbers within an absolute tolerance; a null is never equal."""
    pair = F.array(F.struct(simple_normal(pred).alias("a"), simple_normal(gold).alias("b")))
    # Lambda variables hold the normal forms and values, which are used several times each.
    valued = F.transform(pair, lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), _simple_number(z["a"]).alias("x"), _simple_number(z["b"]).alias("y")))
    equal = F.transform(valued, lambda z: (z["a"] == z["b"]) | F.coalesce(F.abs(z["x"] - z["y"]) < tolerance, F.lit(False)))
    return F.when(pred.isNull() | gold.isNull(), False).otherwise(F.get(equal, F.lit(0)))


def tool_match(pred_function: Column, pred_params: Column, gold_function: Column, gold_params: Column) -> tuple[Column, Column]:
    """Whether functions match, and whether the call passes.

    A matching call without parameters passes; two JSON objects need the gold keys, in any case,
    among the predicted ones; anything else passes.
    """
    from .text import function_key

    matched = function_key(pred_function) == function_key(gold_function)
    keys = lambda c: F.transform(F.json_object_keys(c), F.lower)
    p, g = keys(pred_params), keys(gold_params)
    subset = F.when(p.isNull() | g.isNull(), True).otherwise(F.size(F.array_except(g, p)) == 0)
    return matched, F.when(~matched, False).when(pred_params.isNull(), True).otherwise(subset)


def _number(s: str) -> float | None:
    s = s.replace("{,}", "").replace(",", "").strip()
    percent = s.endswith("%")
    s = s.rstrip("%").rstrip("\\")
    if not re.fullmatch(_NUMBER, s):
        return None
    return float(s) / (100 if percent else 1)


#: Commands that are taken off an answer they enclose whole.
WRAPPERS = "text|mathrm|mathcal|textbf|textit"


def _argument_braces(s: str) -> str:
    """``\\frac12`` and ``\\frac1{2}`` get their braces; an answer that ends within its fraction stays as it is."""
    s = re.sub(r"\\frac +", r"\\frac", s)
    if re.search(r"\\frac(?!\{).?$", s.replace("\n", " ")):
        return s
    return re.sub(r"\\frac([^{])(\{|.)", lambda m: f"\\frac{{{m[1]}}}" + ("{" if m[2] == "{" else f"{{{m[2]}}}"), s)


def _without_units(s: str) -> str:
    """Cut at the only text command, unless nothing or a bracket stands before it; else texts lose their command."""
    marks = [m.start() for m in re.finditer(r"\\text\s*\{", s)]
    if len(marks) == 1 and s[: marks[0]] not in ("", "("):
        return s[: marks[0]]
    if marks:
        return re.sub(r"\\text\{([^}]+)\}", r"\1", s)
    return s.partition("\\mbox{")[0] if s.count("\\mbox{") == 1 else s


def full_normal(answer: str) -> str:
    """The form in which answers compare: see the steps."""
    s = answer
    if re.match(r"\$\d", s):  # a price
        s = s[1:]
    s = re.sub(r"^(\d+(?:\.\d+)?)\\?%$", r"\1", s)
    s = re.sub(r"\\left|\\right", "", s)
    s = re.sub(r"\s*\\text\{\s*(?:or|and)\s*\}\s*", ",", s)
    s = _without_units(re.sub(r",\s*,", ",", s))
    if "\\in " in s:
        s = s.split("\\in ")[1].strip()
    s = re.sub(rf"^\\(?:{WRAPPERS})\{{(.+?)\}}$", r"\1", s)
    s = re.sub(r"\\!|\\%|\\\$|\$|%|\^\{\\circ\}", "", s)
    s = s.replace(" or ", " , ").replace(" and ", " , ")
    for word, power in MAGNITUDES.items():
        s = s.replace(word, power)
    for unit in UNITS:
        s = re.sub(rf"{unit}(?:es)?s? *(?:\^[0-9]+)?", "", s)
    if "day" in s and not any(d in s for d in WEEKDAYS):
        s = re.sub(r"days?", "", s)
    s = re.sub(r"\^ *\\circ", "", s)
    if s[:1] == "{" and s[-1:] == "}":
        s = s[1:-1]
    s = _argument_braces(re.sub(r"\\sqrt(\s*\w+)", r"\\sqrt{\1}", s))
    s = re.sub(r"- *", "-", s)
    s = re.sub(r"([0-9]) +([0-9])", r"\1+\2", s)  # a mixed number
    s = re.sub(r"(\d+) *\\frac\{(\d+)\}\{(\d+)\}", r"\1+\2/\3", s)
    s = s.replace(" ", "")
    whole = s
    while (less := re.sub(r"(\d),(\d{3})(?!\d)", r"\1\2", whole)) != whole:
        whole = less
    bare = whole.split("_")[0] if re.fullmatch(r"-?[\d.]+_\d+", whole) else whole
    if re.fullmatch(_NUMBER, bare) and math.isfinite(value := float(bare)) and abs(value - round(value)) <= 1e-7:
        return str(round(value))
    return s


def _brackets(s: str) -> str:
    ends = {"Interval": "[]", "Interval.Ropen": "[)", "Interval.Lopen": "(]", "Interval.open": "()"}
    for name, (left, right) in ends.items():
        if s.startswith(f"{name}(") and s.endswith(")"):
            return left + s[len(name) + 1 : -1] + right
    return s


def _top_level(s: str) -> list[str]:
    """Parts between commas outside any bracket."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(s):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            parts.append(s[start:k])
            start = k + 1
    return [*parts, s[start:]]


def _cells(s: str) -> list[str] | None:
    """Cells of a matrix, row by row, in either notation."""
    latex = re.fullmatch(r"\\begin\{([pbv]?matrix)\}(.*)\\end\{\1\}", s, re.DOTALL)
    if latex:
        return re.split(r"\\\\|&", latex[2])
    plain = re.fullmatch(r"Matrix\(\[(.*)\]\)", s, re.DOTALL)
    return [c for row in _top_level(plain[1]) for c in _top_level(row[1:-1] if row[:1] == "[" and row[-1:] == "]" else row)] if plain else None


def full_equal(pred: str | None, gold: str | None, symbolically: Callable[[str, str], bool] = symbolic.equal) -> bool:
    """Whether answers are equal by text, number, interval, tuple, list, point, matrix, or as expressions."""
    if pred is None or gold is None or not str(pred).strip():
        return False
    a, b = str(pred), str(gold)
    if a.strip().lower() == b.strip().lower():
        return True
    a, b = full_normal(a)[:LONGEST], full_normal(b)
    if a.replace(" ", "").lower() == b.replace(" ", "").lower():
        return True
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(math.isclose(x, v, rel_tol=1e-4) for v in (y / 100, y, y * 100))
    a, b = _brackets(a), _brackets(b)
    strip_brackets = lambda s: re.sub(r"[\[\](){}]", "", s)
    closing, other = {"(": ")", "[": "]"}.get(a[:1]), {"(": "[", "[": "("}.get(a[:1])
    # brackets don't count, unless the other answer opens with the other kind
    if closing and a.endswith(closing) and not b.startswith(other) and strip_brackets(a).lower() == strip_brackets(b).lower():
        return True
    cells = [_cells(s) for s in (a, b)]
    if None not in cells:
        return len(cells[0]) == len(cells[1]) and all(full_equal(p, q, symbolically) for p, q in zip(*cells, strict=True))
    a, b = a.removeprefix("Point"), b.removeprefix("Point")
    enclosed = [len(s) > 1 and s[0] in "([" and s[-1] in ")]" for s in (a, b)]
    if all(enclosed) and a[0] + a[-1] != b[0] + b[-1] and ("[" in a + b):
        return False
    inner = [s[1:-1] if e else s for s, e in zip((a, b), enclosed, strict=True)]
    parts = [_top_level(s) for s in inner]
    if max(map(len, parts)) > 1:
        return len(parts[0]) == len(parts[1]) and all(full_equal(p, q, symbolically) for p, q in zip(*parts, strict=True))
    return symbolically(a, b)


@functools.lru_cache(1 << 16)
def _remembered(pred: str | None, gold: str | None) -> bool:
    return full_equal(pred, gold)


@F.pandas_udf(BooleanType())
def full_equal_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``full_equal`` of two columns; a worker remembers the last pairs."""
    for pred, gold in batches:
        yield pd.Series(list(map(_remembered, pred, gold)), dtype="boolean")


@F.pandas_udf(BooleanType())
def gold_in_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether an answer occurs in a text, literally or as any number or equal to one of its numbers."""

    def one(text: str | None, gold: str | None) -> bool:
        if not text or not gold:
            return False
        if gold in text:
            return True
        value = _number(gold)
        found = [n.replace(",", "") for n in re.findall(r"-?\d[\d,]*\.?\d*", text)]
        if value is not None and any(abs(float(n) - value) < 1e-6 for n in found if re.fullmatch(_NUMBER, n)):
            return True
        return any(full_equal(n, gold) for n in dict.fromkeys(found))

    for text, gold in batches:
        yield pd.Series([one(t, g) for t, g in zip(text, gold, strict=True)], dtype="boolean")
