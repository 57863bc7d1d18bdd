"""Column expressions over text.  Everything here stays inside the JVM except
:func:`nfkc`, which Spark has no built-in for."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space, written out because \s is ASCII-only in Java and RE2.
WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
CJK = r"\x{4e00}-\x{9fff}"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def squeeze(col: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), f"{WS}+", " "))


def compact(col: Column, max_chars: int = 4000) -> Column:
    """White space collapsed; longer texts end in ``...``."""
    flat = squeeze(col)
    return F.when(F.length(flat) <= max_chars, flat).otherwise(F.concat(F.substring(flat, 1, max_chars), F.lit("...")))


def quote(term: str) -> str:
    """Escape a literal for Java and RE2 patterns."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literals(terms: Iterable[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


_INLINE = 4  # longer lists are looped over as one literal array


def contains_any(col: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    if len(terms) <= _INLINE:
        return reduce(lambda a, b: a | b, [F.contains(col, F.lit(t)) for t in terms], F.lit(False))
    return let(col, lambda c: F.exists(_literals(terms), lambda t: F.contains(c, t)))


def starts_any(col: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(col, F.lit(p)) for p in prefixes], F.lit(False))


def rlike_any(col: Column, patterns: Iterable[str]) -> Column:
    return F.rlike(col, F.lit("|".join(f"(?:{p})" for p in patterns)))


def hits(col: Column, terms: Iterable[str]) -> Column:
    """Number of terms that occur in the text."""
    terms = list(terms)
    if len(terms) <= _INLINE:
        return reduce(lambda a, b: a + b, [F.contains(col, F.lit(t)).cast("int") for t in terms], F.lit(0))
    return let(col, lambda c: F.size(F.filter(_literals(terms), lambda t: F.contains(c, t))))


def occurrences(col: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a literal."""
    needle = F.lit(term) if isinstance(term, str) else term
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(
        ((F.length(col) - F.length(F.replace(col, needle, F.lit("")))) / F.length(needle)).cast("int")
    )


def total_occurrences(col: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    if len(terms) <= _INLINE:
        return reduce(lambda a, b: a + b, [occurrences(col, t) for t in terms], F.lit(0))
    return let(col, lambda c: F.aggregate(_literals(terms), F.lit(0), lambda n, t: n + occurrences(c, t)))


def alnum_chars(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))


def alnum_ratio(col: Column) -> Column:
    return alnum_chars(col) / F.greatest(F.length(col), F.lit(1))


def has_cjk(col: Column) -> Column:
    return F.rlike(col, F.lit(f"[{CJK}]"))


def lines(col: Column) -> Column:
    """Stripped, non-blank lines of a text as an array."""
    parts = F.split(F.regexp_replace(F.coalesce(col, F.lit("")), r"\r\n?", "\n"), "\n")
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0)


def substitute(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), rules, col)


def json_safe_text(col: Column) -> Column:
    """Control characters other than tab and line breaks become U+FFFD."""
    return F.regexp_replace(col, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�")


def json_safe_number(col: Column) -> Column:
    d = col.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)
