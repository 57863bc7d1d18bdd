"""The tokenisers.  They differ on purpose and are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import SEARCH_STOP_TERMS
from .text import CJK, strip

# fixed values: token patterns
WORD = rf"[{CJK}]|[A-Za-z0-9_.+-]+"
QUERY_RUN = rf"[A-Za-z0-9_./+\-#%℃Ωμu{CJK}]{{2,}}"
EVIDENCE_TERM = rf"[A-Za-z]{{1,8}}[0-9]{{0,5}}[A-Za-z0-9_.+-]*|[0-9]+(?:\.[0-9]+)?\s*[A-Za-zΩμ%]*|[{CJK}]{{2,}}"
SEARCH_TERM = (
    rf"[A-Za-z]{{1,8}}[0-9]{{0,6}}[A-Za-z0-9_.+-]*|[A-Za-z]{{3,}}|[{CJK}]{{2,}}|[0-9]+(?:\.[0-9]+)?[A-Za-z%]*"
)
LATIN = r"[a-zA-Z0-9][a-zA-Z0-9_+\-.]{1,}"
CJK_RUN = rf"[{CJK}]{{2,}}"
READ_TOKEN = rf"[a-zA-Z0-9_.+-]+|[{CJK}]{{2,}}"
EVIDENCE_STOP = ("请教", "问题", "为什么", "怎么", "处理", "以及", "这个", "电路", "作用", "哪些")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Single ideographs or latin/number runs, lower case."""
    return F.transform(_all(text, WORD), F.lower)


def query_runs(text: Column) -> Column:
    """Mixed runs of a question, edge punctuation cut, first spelling kept."""
    cut = F.transform(_all(text, QUERY_RUN), lambda x: F.regexp_replace(x, r"^[-_./+ ]+|[-_./+ ]+$", ""))
    return F.filter(cut, lambda x: F.length(x) >= 2)


def evidence_terms(text: Column) -> Column:
    cut = F.transform(_all(text, EVIDENCE_TERM), strip)
    return F.array_distinct(F.filter(cut, lambda x: (F.length(x) > 0) & ~x.isin(*EVIDENCE_STOP)))


def search_terms(text: Column, stop: tuple[str, ...] = SEARCH_STOP_TERMS) -> Column:
    low = F.transform(_all(text, SEARCH_TERM), F.lower)
    return F.array_distinct(F.filter(low, lambda x: (F.length(x) >= 2) & ~x.isin(*stop)))


def content_tokens(text: Column) -> Column:
    """Latin tokens, then ideograph runs up to four whole and longer ones as bigrams."""
    low = F.lower(F.coalesce(text, F.lit("")))
    grams = F.transform(
        _all(text, CJK_RUN),
        lambda run: F.when(F.length(run) <= 4, F.array(run)).otherwise(bigrams(run)),
    )
    return F.concat(_all(low, LATIN), F.flatten(grams))


def read_tokens(text: Column) -> Column:
    return _all(F.lower(F.coalesce(text, F.lit(""))), READ_TOKEN)


def bigrams(text: Column) -> Column:
    """Overlapping character pairs; one pass over the characters."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(
        F.filter(pairs, lambda p: p.isNotNull())
    )


def bigram_count(text: Column) -> Column:
    """``size(bigrams(text))`` without the pairs."""
    return F.when(text.isNotNull(), F.greatest(F.length(text) - 1, F.lit(0)))


def term_present(term: Column, low_text: Column) -> Column:
    """Whole-token match for latin terms, substring match for the rest."""
    latin = F.rlike(term, F.lit(r"^[a-z0-9_.+-]+( +[a-z0-9_.+-]+)*$"))
    quoted = F.regexp_replace(term, r"([.+])", r"\\$1")
    bounded = F.concat(F.lit(r"(^|[^a-z0-9_.+-])"), quoted, F.lit(r"($|[^a-z0-9_.+-])"))
    return F.when(latin, F.regexp_like(low_text, bounded)).otherwise(F.contains(low_text, term))
