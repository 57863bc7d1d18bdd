"""Search queries made from questions: planned, repaired and expanded, with the rule that made each.

A rewriting is an ordered table of rules, each with a name, a test and the query that it gives; the first rule whose test holds
decides, and its name stays in the row.  Terms are token arrays; everything is column expressions over the row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import EVIDENCE_STOP, _all
from .lexical import expansions

# fixed values: token shapes of questions, of hints for an answer, and of planned queries
QUESTION_TERM = r"[A-Za-z]{1,8}[0-9]{0,6}[A-Za-z0-9_.+-]*|[0-9]+(?:\.[0-9]+)?[ \t\r\n\f\x0b]*[A-Za-z%]*|[一-鿿]{2,}"
HINT_TERM = r"[A-Za-z]{1,8}[0-9]{0,5}[A-Za-z0-9_.+-]*|[0-9]+(?:\.[0-9]+)?[ \t\r\n\f\x0b]*[A-Za-zΩμ%]*|[一-鿿]{2,}"
PLAN_TERM = r"[A-Za-z0-9_.+-]+|[一-鿿]{2,}"
DESIGNATORS = (r"^[RCLDUQ][0-9]+[A-Z]?$", r"^[A-Z]{2,}[0-9]+[A-Z0-9-]*$")


@dataclass(frozen=True)
class Words:
    """Fixed values of the rules; every list can be replaced."""

    generic: tuple[str, ...] = (
        "原因", "处理", "问题", "异常", "分析", "电路", "电子", "怎么", "如何", "troubleshooting", "reason", "reasons", "issue", "issues",
        "problem", "problems", "fix", "repair", "solution",
    )
    stop: tuple[str, ...] = ("请教", "这个", "哪些", "以及", "为什么", "怎么处理", "问题", "电路")
    hint_stop: tuple[str, ...] = EVIDENCE_STOP
    tail: str = "electronics troubleshooting"
    parts: tuple[str, ...] = ("TL431", "MOS", "DCDC", "PWM", "PFC")
    phrases: tuple[str, ...] = (
        "输出电压", "纹波", "光耦", "反馈", "闭环", "补偿", "滤波", "噪声", "电源", "电路", "反激", "开关电源", "限流", "电流检测", "采样电阻",
        "电流采样", "尖峰", "低通滤波",
    )
    #: Upper-case tokens that bring further terms, and the terms that are left out of the first query as ambiguous.
    bring: tuple[tuple[str, tuple[str, ...]], ...] = (("LLC", ("LLC谐振电源", "谐振", "开关电源")),)
    ambiguous: tuple[str, ...] = ("LLC", "LLC谐振电源", "谐振")
    endings: tuple[str, str] = ("原因 处理 电子电路", "原因 处理 开关电源")
    #: (upper-case tokens, phrases, query): any of either brings the query.
    canned: tuple[tuple[tuple[str, ...], tuple[str, ...], str], ...] = (
        (("TL431",), ("光耦",), "TL431 optocoupler feedback compensation power supply ripple"),
        ((), ("反激", "限流", "电流检测", "电流采样", "采样电阻"), "flyback current sense resistor RC filter leading edge spike blanking"),
        ((), ("补偿", "反馈", "电阻", "电容"), "power supply feedback loop compensation resistor capacitor"),
    )
    last: str = "feedback compensation ripple power supply"


DEFAULT = Words()


def with_words(**changes) -> Words:
    return replace(DEFAULT, **changes)


def _text_list(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def question_terms(text: Column, words: Words = DEFAULT) -> Column:
    """Distinct terms of a question without stop and generic words, in order."""
    cut = F.transform(_all(text, QUESTION_TERM), T.strip)
    generic = _text_list([g.lower() for g in words.generic])
    kept = F.filter(cut, lambda t: (F.length(t) > 0) & ~F.array_contains(_text_list(words.stop), t) & ~F.array_contains(generic, F.lower(t)))
    return F.array_distinct(kept)


def answer_hints(text: Column, words: Words = DEFAULT, limit: int = 12) -> Column:
    """The first distinct terms of a question that an answer should take up."""
    cut = F.transform(_all(text, HINT_TERM), T.strip)
    kept = F.filter(cut, lambda t: (F.length(t) > 0) & ~F.array_contains(_text_list(words.hint_stop), t))
    return F.slice(F.array_distinct(kept), 1, limit)


def plan_terms(question: Column, words: Words = DEFAULT) -> Column:
    """Terms of a planned query: known parts, designators and model names among the tokens, then phrases and what tokens bring."""
    flat = T.squeeze(question)
    tokens = _all(flat, PLAN_TERM)
    upper = F.transform(tokens, F.upper)
    named = F.filter(tokens, lambda t: F.array_contains(_text_list(words.parts), F.upper(t)))
    shaped = F.filter(tokens, lambda t: F.rlike(F.upper(t), F.lit(DESIGNATORS[0])) | F.rlike(F.upper(t), F.lit(DESIGNATORS[1])))
    text = F.coalesce(question, F.lit(""))
    phrases = F.filter(_text_list(words.phrases), lambda p: F.contains(text, p))
    brought = [F.when(F.array_contains(upper, key), _text_list(terms)).otherwise(_text_list(())) for key, terms in words.bring]
    return F.array_distinct(F.concat(named, shaped, phrases, *brought))


def planned_queries(question: Column, words: Words = DEFAULT, limit: int = 3) -> Column:
    """The first queries of a plan: core terms with either ending, canned queries, the core with the last words; distinct, in order."""
    flat = T.squeeze(question)
    tokens = _all(flat, PLAN_TERM)
    upper = F.transform(tokens, F.upper)
    text = F.coalesce(question, F.lit(""))
    terms = F.slice(plan_terms(question, words), 1, 12)
    core = T.let(F.array_join(terms, " "), lambda c: F.when(c == "", F.array_join(F.slice(tokens, 1, 10), " ")).otherwise(c))

    def queries(core: Column) -> Column:
        clear = F.array_join(F.filter(F.split(core, " "), lambda t: ~F.array_contains(_text_list(words.ambiguous), t) & (t != "")), " ")
        first = F.concat_ws(" ", F.when(clear == "", core).otherwise(clear), F.lit(words.endings[0]))
        canned = [
            F.when(F.arrays_overlap(upper, _text_list(keys)) | T.contains_any(text, phrases) if keys else T.contains_any(text, phrases), F.lit(made))
            for keys, phrases, made in words.canned
        ]
        return F.array(first, F.concat_ws(" ", core, F.lit(words.endings[1])), *canned, F.concat_ws(" ", core, F.lit(words.last)))

    return T.let(core, lambda c: F.slice(F.array_distinct(F.array_compact(queries(c))), 1, limit))


def question_query(question: Column, words: Words = DEFAULT) -> Column:
    """A query of a question's first terms; empty without any."""
    terms = F.slice(question_terms(question, words), 1, 6)
    return F.when(F.size(terms) > 0, F.concat_ws(" ", F.array_join(terms, " "), F.lit(words.tail))).otherwise("")


def web_rules(query: Column, question: Column, seed: Column, words: Words = DEFAULT) -> list[tuple[str, Column, Column]]:
    """(name, test, query) of the rules for a web search, in order."""
    flat = T.squeeze(query)
    filled = F.when(flat == "", T.squeeze(seed)).otherwise(flat)
    asked = question_terms(question, words)
    own = question_terms(filled, words)
    shared = F.size(F.array_intersect(own, asked))
    missing = F.slice(F.filter(asked, lambda t: ~F.array_contains(own, t)), 1, 4)
    enhanced = F.array_join(F.array_distinct(F.concat(F.array(filled), missing)), " ")
    built = question_query(question, words)
    return [
        ("nothing_to_ask", (filled == "") & (built == ""), F.lit("")),
        ("from_question", filled == "", built),
        ("only_generic", (F.size(own) == 0) & (built != ""), built),
        ("no_terms", F.size(own) == 0, F.lit("")),
        ("key_terms_added", (shared < F.least(F.lit(2), F.size(asked))) & (F.size(missing) > 0), enhanced),
        ("from_seed", flat == "", filled),
        ("kept", F.lit(True), filled),
    ]


def local_rules(query: Column, question: Column, seed: Column, words: Words = DEFAULT, expand=expansions) -> list[tuple[str, Column, Column]]:
    """The rules for a local search: an empty query is filled, then the terms that ``expand`` finds in question and query are appended."""
    flat = T.squeeze(query)
    built = question_query(question, words)
    filled = F.when(flat != "", flat).when(T.squeeze(seed) != "", T.squeeze(seed)).otherwise(built)
    more = expand(F.trim(F.concat_ws(" ", F.coalesce(question, F.lit("")), filled)))
    joined = F.array_join(F.filter(F.array_distinct(F.concat(F.array(filled), more)), lambda t: t != ""), " ")
    return [
        ("expanded", F.size(more) > 0, joined),
        ("filled", (flat == "") & (filled != ""), filled),
        ("kept", F.lit(True), filled),
    ]


def rewritten(df: DataFrame, rules: list[tuple[str, Column, Column]], out: str = "rewritten", fired: str = "rule") -> DataFrame:
    """``df`` with the query of the first rule that holds, and its name."""
    name, made = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, test, query in reversed(rules):
        name = F.when(test, F.lit(rule)).otherwise(name)
        made = F.when(test, query).otherwise(made)
    return df.withColumn(fired, name).withColumn(out, made)


def limit_rule(limit: Column, most: int) -> Column:
    """A wanted number of results held to 1..most; unusable ones become ``most``."""
    return F.when(limit.isNull() | (limit < 1), most).otherwise(F.least(limit, F.lit(most))).cast("int")
