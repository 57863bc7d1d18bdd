"""Technical entities of a text: normalisation, extraction, type and weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import DEFAULT, TOKEN_ALIASES, Lexicons
from .text import CJK, let, nfkc

# fixed values: entity shapes
COMPONENT = (
    r"(?i)(?<![A-Za-z0-9])(?:R|C|L|D|Q|U|IC|J|CN|FB|F|T|ZD|VR|NTC|PTC|LED|MOS|TVS)[0-9]+[A-Z0-9_.+-]*(?![A-Za-z0-9])"
)
MODEL = r"(?i)(?<![A-Za-z0-9])[A-Z]{1,}[0-9]{2,}[A-Z0-9_.+-]*(?![A-Za-z0-9])"
QUANTITY = (
    r"(?iu)(?<![A-Za-z0-9])[0-9]+(?:\.[0-9]+)?\s*"
    r"(?:v|a|w|ohm|kohm|mohm|Ω|kΩ|mΩ|ma|ua|μa|uf|μf|nf|pf|hz|khz|mhz|c|℃|°c|%|ms|us|μs|s)(?![A-Za-z0-9])"
)
ENGLISH = r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?:[-_/][A-Za-z0-9]+)*(?![A-Za-z0-9])"
RUN = rf"[{CJK}]{{2,}}"
KEPT = rf"[^{CJK}A-Za-z0-9.%+\-_/ΩμuUFVAHhmMkKnNpP℃°]+"
PHRASE_CUT = "的|了|是|为|把|被|用|和|与|或|及|在|对|到|使|让|实现|功能|造成|导致|需要|建议|检查|检测|测量|复核|可能"
TAILS = ("的", "了", "中", "上", "下", "时", "后", "前")
CAPS = {"structured": 40, "domain_abbrev": 24, "keyphrase": 48}
ABBREV_WEIGHT = 2.2
ENTITY = "struct<token:string,type:string,weight:double>"


def fold(text: Column, normalise: bool = True) -> Column:
    """Compatibility form with units spelled in latin letters."""
    base = F.coalesce(text, F.lit(""))
    base = nfkc(base) if normalise else base
    for sign, name in (("μ", "u"), ("Ω", "ohm"), ("ω", "ohm")):
        base = F.replace(base, F.lit(sign), F.lit(name))
    return base


# texts without any of these have nothing to fold
_FOLDABLE = "[" + CJK + "ΩωμΜ]|mosfet|MOSFET"


def normal(folded: Column) -> Column:
    """Comparison form of folded text: aliases applied, separators dropped."""

    def aliased(text: Column) -> Column:
        out = text
        for source, target in TOKEN_ALIASES.items():
            out = F.replace(out, F.lit(source), F.lit(target))
            if source.upper() != source:
                out = F.replace(out, F.lit(source.upper()), F.lit(target))
        return out

    foldable = F.rlike(folded, F.lit(_FOLDABLE))
    return F.lower(F.regexp_replace(F.when(foldable, aliased(folded)).otherwise(folded), KEPT, ""))


def normal_token(folded: Column) -> Column:
    """Comparison form of one token."""
    table = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    return let(
        normal(folded),
        lambda t: F.when(F.rlike(t, F.lit(_FOLDABLE)), F.coalesce(F.element_at(table, t), t)).otherwise(t),
    )


def _full(token: Column, pattern: str) -> Column:
    flags, body = ("(?iu)", pattern[5:]) if pattern.startswith("(?iu)") else ("(?i)", pattern[4:])
    return F.rlike(token, F.lit(f"{flags}^(?:{body})$"))


def low_value(token: Column, lex: Lexicons = DEFAULT) -> Column:
    tail = "|".join(lex.low_value_suffixes)
    return (F.length(token) <= 1) | token.isin(*lex.entity_stop) | F.rlike(token, F.lit(rf"^[0-9]+$|(?:{tail})$"))


def abbreviation(raw: Column, token: Column, lex: Lexicons = DEFAULT) -> Column:
    """``raw`` is the spelling in the text, ``token`` its normal form."""
    marked = F.rlike(token, F.lit(r"[0-9/\-]")) | (F.upper(token) == raw)
    shaped = F.rlike(token, F.lit(r"^[a-z][a-z0-9+\-_/]+$"))
    return (F.length(token) >= 2) & ~token.isin(*lex.entity_stop) & (token.isin(*lex.abbrevs) | (shaped & marked))


def kind(token: Column, lex: Lexicons = DEFAULT) -> Column:
    structured = _full(token, COMPONENT) | _full(token, MODEL) | _full(token, QUANTITY)
    return F.when(structured, "structured").when(abbreviation(token, token, lex), "domain_abbrev").otherwise("keyphrase")


def base_weight(token: Column, type_: Column) -> Column:
    """Weight before any corpus frequency is known; keyphrases count 1."""
    return (
        F.when(_full(token, COMPONENT), 3.5)
        .when(_full(token, MODEL), 3.0)
        .when(_full(token, QUANTITY), 2.7)
        .when(type_ == "domain_abbrev", ABBREV_WEIGHT)
        .otherwise(1.0)
    )


def phrase_weight(idf: Column) -> Column:
    return F.greatest(F.lit(0.8), F.least(F.coalesce(idf, F.lit(1.0)), F.lit(2.4)))


def _trim(phrase: Column) -> Column:
    out = F.regexp_replace(phrase, r"^[，。；：、,.!?！？（）()\[\]【】 ]+|[，。；：、,.!?！？（）()\[\]【】 ]+$", "")
    for tail in TAILS:
        out = F.regexp_replace(out, f"(?<=..){tail}$", "")
    return out


def phrases(text: Column, lex: Lexicons = DEFAULT) -> Column:
    """Ideograph phrases: runs cut at function words, then the whole run, at
    most six per run."""

    def of_run(run: Column) -> Column:
        parts = F.transform(F.concat(F.split(run, PHRASE_CUT), F.array(run)), _trim)
        good = F.filter(
            F.array_distinct(parts), lambda p: F.length(p).between(2, 12) & ~low_value(normal_token(p), lex)
        )
        return F.slice(good, 1, 6)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), of_run))


def candidates(folded: Column, lex: Lexicons = DEFAULT) -> Column:
    """Distinct normal tokens of a folded text."""
    shaped = F.concat(*[F.regexp_extract_all(folded, F.lit(p), F.lit(0)) for p in (COMPONENT, MODEL, QUANTITY)])
    words = F.transform(
        F.regexp_extract_all(folded, F.lit(ENGLISH), F.lit(0)),
        lambda w: F.struct(w.alias("raw"), normal_token(w).alias("token")),
    )
    english = F.transform(
        F.filter(words, lambda w: abbreviation(w["raw"], w["token"], lex)), lambda w: w["token"]
    )
    every = F.concat(F.transform(F.concat(shaped, phrases(folded, lex)), normal_token), english)
    return F.array_distinct(F.filter(every, lambda t: ~low_value(t, lex)))


def typed(tokens: Column, lex: Lexicons = DEFAULT) -> Column:
    """``array<struct<token,type,weight>>``, heaviest first, capped per type."""

    def weigh(token: Column) -> Column:
        return let(
            kind(token, lex),
            lambda k: F.struct((-base_weight(token, k)).alias("neg"), k.alias("type"), token.alias("token")),
        )

    def capped(ordered: Column) -> Column:
        def of_type(name: str, cap: int) -> Column:
            return F.slice(F.filter(ordered, lambda s: s["type"] == name), 1, cap)

        few = F.size(ordered) <= min(CAPS.values())
        return F.when(few, ordered).otherwise(F.array_sort(F.concat(*[of_type(n, c) for n, c in CAPS.items()])))

    return F.transform(
        let(F.array_sort(F.transform(tokens, weigh)), capped),
        lambda s: F.struct(s["token"].alias("token"), s["type"].alias("type"), (-s["neg"]).alias("weight")),
    )


def entities(folded: Column, lex: Lexicons = DEFAULT) -> Column:
    return typed(candidates(folded, lex), lex)
