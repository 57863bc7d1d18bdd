"""Evidence: ranking, gaps, search-result scoring, read candidates, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import urls as U
from ..lexicons import DEFAULT, Lexicons
from ..session import cut_lineage
from . import cleaning as C
from .dense import clamp01
from .ordered import top_k

# fixed values: bonus per kind of evidence, and the order used for the answer
KIND_BONUS = {"domain_skill": 4.0, "image_inspection": 3.0, "local_kb_chunk": 1.5}
KIND_PRIORITY = {
    "image_inspection": 0, "domain_skill": 1, "local_kb_chunk": 2,
    "web_page": 3, "web_search_result": 4, "image_context": 5,
}
KIND_CHARS = {"image_inspection": 2200, "domain_skill": 650, "image_context": 180}


def _case(col: Column, table: dict, default) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default))


def trusted(source: Column, lex: Lexicons = DEFAULT) -> Column:
    return U.host(source).isin(*lex.trusted_hosts)


def rank(df: DataFrame, group: str, question: str, position: str, lex: Lexicons = DEFAULT, limit: int = 12) -> DataFrame:
    """Top evidence per question; the first item of each source counts.

    ``df`` has ``source``, ``title``, ``content``, ``score``, ``kind``.
    """
    key = F.lower(T.strip(F.coalesce(T.blank_to_null(F.col("source")), T.blank_to_null(F.col("title")), F.substring("content", 1, 80))))
    low = F.lower(F.concat_ws(" ", "title", "content", "source"))
    terms = F.transform(K.evidence_terms(F.col(question)), F.lower)
    scored = (
        df.withColumn("_key", key)
        .filter(F.length("_key") > 0)
        .withColumn("_low", low)
        .withColumn("_terms", terms)
        .withColumn(
            "evidence_score",
            F.coalesce("score", F.lit(0.0))
            + F.size(F.filter("_terms", lambda t: F.contains(F.col("_low"), t)))
            + _case(F.col("kind"), KIND_BONUS, 0.0)
            + F.when(trusted(F.col("source"), lex), 2.0).otherwise(0.0),
        )
    )
    kept = [c for c in df.columns if c not in (group, "_key")] + ["evidence_score"]
    unique = (
        scored.groupBy(group, "_key").agg(F.min_by(F.struct(*kept), F.col(position)).alias("_e")).select(group, "_e.*")
    )
    return top_k(unique, [group], [F.desc(F.round("evidence_score", 4)), F.col(position)], limit)


def gaps(df: DataFrame, group: str, question: str) -> DataFrame:
    """Component-like question terms no evidence mentions, and the verdict.

    Terms are tested inside each evidence row; only the set of terms found
    travels, never the evidence text.
    """
    shape = r"^([A-Z]{1,6}[0-9]{0,4}[A-Z0-9_.+-]*|[0-9]+(?:\.[0-9]+)?[A-Za-zΩμ]*)$"
    asked = F.filter(K.evidence_terms(F.col(question)), lambda t: F.rlike(t, F.lit(shape)))
    text = F.concat_ws(" ", "title", "content")
    staged = df.withColumn("_asked", asked).withColumn("_text", text)
    staged = staged.withColumn("_found", F.filter("_asked", lambda t: F.contains(F.col("_text"), t)))
    counts = staged.groupBy(group).agg(F.count("*").alias("evidence_count"), F.first("_asked").alias("_asked"))
    found = (
        staged.select(group, F.explode("_found").alias("_t"))
        .groupBy(group)
        .agg(F.collect_set("_t").alias("_found"))
    )
    whole = counts.join(found, group, "left").withColumn(
        "_found", F.coalesce("_found", F.array().cast("array<string>"))
    )
    missing = F.slice(F.array_except("_asked", "_found"), 1, 10)
    return (
        whole.withColumn("missing", missing)
        .withColumn("enough", (F.col("evidence_count") >= 2) & (F.size("missing") <= 4))
        .drop("_asked", "_found")
    )


def low_value_result(source: Column, title: Column, content: Column, lex: Lexicons = DEFAULT) -> Column:
    """Reason code of a search result that is not worth keeping, else NULL."""
    name = U.host(source)
    low_title = F.lower(F.coalesce(title, F.lit("")))
    both = F.concat_ws(" ", low_title, F.lower(F.coalesce(content, F.lit(""))))
    titled = T.contains_any(low_title, lex.low_value_titles)
    # fixed values: part names that outweigh a poor title, shop words, shop and video pages
    model = F.rlike(both, F.lit(r"(?i)\b(?:tl431|lm358|uc384[0-9]|rk3399|at32f[0-9]+|esp32|mr[0-9]+|irf[0-9]+)\b"))
    shop = T.contains_any(low_title, ("淘宝", "天猫", "店铺", "好货"))
    return (
        F.when(U.host_matches(name, lex.low_value_hosts), F.concat(F.lit("low_value_host:"), name))
        .when(T.contains_any(F.lower(U.path(source)), lex.low_value_paths), "low_value_path")
        .when(titled & ~model, "low_value_title")
        .when(titled & shop, "ecommerce_page")
        .when(T.contains_any(content, ("最新作品发布时间", "综合视频")), "short_video_search_page")
        .when(T.contains_any(content, ("欢迎来到淘宝网", "登录查看更多优惠")), "ecommerce_page")
    )


def model_term(term: Column) -> Column:
    return F.rlike(term, F.lit(r"(?i)[a-z]{1,8}[0-9]{2,6}|[0-9]{2,6}[a-z]{1,8}"))


def result_relevance(df: DataFrame, query: str, out: str = "relevance", lex: Lexicons = DEFAULT) -> DataFrame:
    """Relevance of provider results (``source``, ``title``, ``content``, ``score``)."""
    staged = (
        df.withColumn("_low", F.lower(F.concat_ws(" ", "title", "content", "source")))
        .withColumn("_terms", K.search_terms(F.col(query), lex.search_stop))
        .withColumn("_hit", F.filter("_terms", lambda t: K.term_present(t, F.col("_low"))))
    )
    base = F.coalesce("score", F.lit(0.0))
    coverage = F.size("_hit") / F.greatest(F.size("_terms"), F.lit(1))
    models = F.size(F.filter("_terms", model_term))
    model_hits = F.size(F.filter("_hit", model_term))
    ok = trusted(F.col("source"), lex)
    missed = (models > 0) & (model_hits == 0)
    score = (
        base + coverage * 3.0 + model_hits * 2.0 + F.when(ok, 1.0).otherwise(0.0) + F.when(missed, -1.5).otherwise(0.0)
    )
    dropped = ~ok & (
        (missed & (coverage < 0.35))
        | ((model_hits == 0) & (coverage < 0.12))
        | ((model_hits == 0) & (base <= 0) & (coverage < 0.2))
    )
    value = (
        F.when(F.size("_terms") == 0, F.greatest(base, F.lit(0.1)))
        .when(dropped, F.lit(0.0))
        .otherwise(F.greatest(score, F.lit(0.01)))
    )
    return staged.withColumn(out, value).drop("_low", "_terms", "_hit")


def rank_results(results: DataFrame, keys: list[str], query: str, order: str, limit: int | None = None, lex: Lexicons = DEFAULT) -> DataFrame:
    """Search results of a query in one pass: ``relevance``, ``outcome`` and ``place`` of every row.

    no_address     not a web address
    duplicate      the address came before, in ``order`` (whatever became of that row)
    low_value_...  ``low_value_result``
    low_relevance  no relevance
    over_limit     ranked after the first ``limit`` (default: none is)
    kept           with its place from 1, by relevance, then ``order``
    """
    staged = result_relevance(results.withColumn("_url", U.canonical(F.col("source"))), query, "relevance", lex)
    # the first row of each address by its key alone
    firsts = staged.filter(F.col("_url") != "").groupBy(*keys, "_url").agg(F.min(order).alias("_first"))
    staged = staged.join(firsts, [*keys, "_url"], "left")
    reason = (
        F.when(F.col("_url") == "", "no_address")
        .when(F.col(order) > F.col("_first"), "duplicate")
        .when(low_value_result(F.col("source"), F.col("title"), F.col("content"), lex).isNotNull(), low_value_result(F.col("source"), F.col("title"), F.col("content"), lex))
        .when(F.col("relevance") <= 0, "low_relevance")
    )
    staged = cut_lineage(staged.withColumn("_reason", reason).drop("_url", "_first"))
    ranked = staged.filter("_reason IS NULL").select(*keys, order, "relevance")
    best = top_k(ranked, keys, [F.desc("relevance"), F.col(order)], limit, "place") if limit else ranked.withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("relevance"), F.col(order)))
    )
    out = staged.join(best.select(*keys, order, "place"), [*keys, order], "left")
    outcome = F.coalesce("_reason", F.when(F.col("place").isNull(), "over_limit").otherwise("kept"))
    return out.withColumn("outcome", outcome).drop("_reason")


def html_result_relevance(df: DataFrame, query: str, body: str, out: str = "relevance", lex: Lexicons = DEFAULT) -> DataFrame:
    """Relevance of scraped results: domain terms, a little for query terms,
    a lot off for terms of other meanings."""
    low = F.col("_low")

    def present(term: str) -> Column:
        if all(c.isascii() for c in term):
            return F.rlike(low, F.lit(rf"(^|[^a-z0-9_.+-]){T.quote(term)}($|[^a-z0-9_.+-])"))
        return F.contains(low, F.lit(term))

    domain = sum((present(t).cast("int") for t in lex.html_terms), F.lit(0))
    bad = sum((present(t).cast("int") for t in lex.html_bad_terms), F.lit(0))
    ambiguous = ("llc", "原因", "处理", "电子电路")
    asked = F.array_distinct(K.read_tokens(F.col(query)))
    found = F.filter(asked, lambda t: ~t.isin(*ambiguous) & K.term_present(t, low))
    staged = df.withColumn("_low", F.lower(F.col(body))).withColumn("_domain", domain)
    score = F.col("_domain") + 0.2 * F.size(found) - 2.0 * bad
    return staged.withColumn(out, F.when(F.col("_domain") <= 0, F.lit(0.0)).otherwise(score)).drop("_low", "_domain")


# ------------------------------------------------------------ page reading


def read_quality(df: DataFrame, body: str, title: str, snippet: str, lex: Lexicons = DEFAULT, raw_chars: str | None = None) -> DataFrame:
    """Quality metrics and score of an extracted page.

    Adds ``clean_chars``, ``unique_ratio``, ``link_density``, ``context``,
    ``tech``, ``mojibake``, ``forum``, ``repeat``, ``penalty``,
    ``quality_score`` and ``quality_reason``.
    """
    text, low = F.col(body), F.lower(F.col(body))
    context = F.concat_ws(" ", title, snippet)
    asked = F.length(F.concat(F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))) > 0
    staged = (
        df.withColumn("_tok", K.content_tokens(text))
        .withColumn("clean_chars", F.length(text))
        .withColumn("_n", F.greatest(F.size("_tok"), F.lit(1)))
        .withColumn("unique_ratio", F.size(F.array_distinct("_tok")) / F.col("_n"))
        .withColumn("link_density", C.link_marks(low) / F.col("_n"))
        .withColumn("context", C.context_overlap(F.col("_tok"), context))
        .withColumn("tech", C.signal_count(F.col("_tok"), lex))
        .withColumn("mojibake", C.mojibake_ratio(text, lex))
        .withColumn("forum", C.forum_noise(text, lex))
        .withColumn("repeat", C.repeated_line_ratio(text))
        .withColumn("_nav", F.size(F.filter("_tok", lambda t: t.isin(*lex.nav_words))))
        .withColumn("_boiler", T.total_occurrences(low, lex.boilerplate))
    )
    penalty = F.least(
        F.col("_boiler") * 0.03
        + F.col("_nav") / F.col("_n") * 2.0
        + F.least(F.col("mojibake") * 10.0, F.lit(0.55))
        + F.least(F.col("repeat") * 0.4, F.lit(0.25))
        + F.least(F.col("forum") * 0.08, F.lit(0.45)),
        F.lit(0.75),
    )
    total = F.col(raw_chars) if raw_chars else F.length(text)
    ratio = F.least(F.col("clean_chars") / F.greatest(total, F.lit(1)), F.lit(1.0))
    one = lambda c, d: F.least(c / d, F.lit(1.0))
    score = (
        one(F.col("clean_chars"), 1800.0) * 0.35
        + one(F.col("unique_ratio"), 0.45) * 0.15
        + F.greatest(F.lit(0.0), 1.0 - F.least(F.col("link_density") * 12.0, F.lit(1.0))) * 0.15
        + one(ratio, 0.35) * 0.10
        + F.when(asked, one(F.col("context"), 0.12) * 0.15).otherwise(F.lit(0.08))
        + one(F.col("tech"), 6.0) * 0.10
        - F.col("penalty")
    )
    reason = (
        F.when(F.length(text) == 0, "empty_after_cleaning")
        .when(C.looks_failed(text, lex), "blocked_or_failure_page")
        .otherwise(
            C.hard_noise_reason(text, F.coalesce(F.col(title), F.lit("")), lex, F.col("mojibake"), F.col("repeat"))
        )
    )
    return (
        staged.withColumn("penalty", penalty)
        .withColumn("quality_reason", reason)
        .withColumn("quality_score", F.when(F.col("quality_reason").isNotNull(), F.lit(0.0)).otherwise(clamp01(score)))
        .drop("_tok", "_n", "_nav", "_boiler")
    )


def sufficiency_rank(score: Column, chars: Column) -> Column:
    """Order of competing extractions of one page."""
    return F.struct(
        (score + F.least(chars / 1200.0, F.lit(1.0)) * 0.08).alias("s"), F.least(chars, F.lit(20000)).alias("c")
    )


def forum_aggregation(body: Column, lex: Lexicons = DEFAULT) -> Column:
    found = T.total_occurrences(F.substring(body, 1, 2500), lex.forum_aggregation)
    return F.when(found <= 1, F.lit(0.0)).otherwise(F.least(found * 0.08, F.lit(0.7)))


def technical_hits(tokens: Column) -> Column:
    text = F.array_join(tokens, " ")
    # fixed values: part numbers, quantities and topic words
    parts = F.regexp_count(
        text,
        F.lit(r"\b[a-z]{1,8}[0-9]{2,6}[a-z0-9_.+-]*\b|\b[0-9]+(?:\.[0-9]+)?\s?(?:v|a|ma|uf|nf|pf|ohm|khz|mhz|w)\b"),
    )
    topics = (
        "voltage", "current", "resistor", "capacitor", "mosfet", "stm32", "emc", "i2c", "lcd", "relay", "feedback",
        "filter", "电压", "电流", "电阻", "电容", "电源", "电路",
    )
    return parts + T.hits(text, topics)


def read_candidate_score(
    df: DataFrame, body: str, title: str, snippet: str, lex: Lexicons = DEFAULT, minimum_chars: int = 400
) -> DataFrame:
    """Adds ``purity`` and ``final_score`` to candidates that carry the metrics
    of :func:`read_quality`."""
    text, low = F.col(body), F.lower(F.col(body))
    wanted = F.array_distinct(
        F.filter(K.read_tokens(F.concat_ws(" ", title, snippet)), lambda t: F.length(t) >= 4)
    )
    staged = (
        df.withColumn("_tok", K.read_tokens(text))
        .withColumn("_n", F.greatest(F.size("_tok"), F.lit(1)))
        .withColumn("_nav", F.size(F.filter("_tok", lambda t: t.isin(*lex.read_nav))))
        .withColumn("_agg", forum_aggregation(text, lex))
        .withColumn(
            "_noise",
            F.least(
                C.link_marks(low) / F.col("_n") * 2.5
                + F.col("_nav") / F.col("_n") * 2.0
                + F.round("mojibake", 2)
                + F.round("repeat", 2) * 0.5
                + F.round("forum", 1) * 0.025
                + F.col("_agg"),
                F.lit(1.0),
            ),
        )
        .withColumn("_wanted", wanted)
        .withColumn(
            "_ctx",
            F.when(F.size("_wanted") == 0, F.lit(0.0)).otherwise(
                F.size(F.array_intersect("_wanted", "_tok")) / F.size("_wanted")
            ),
        )
        .withColumn("_tech", F.least(technical_hits(F.col("_tok")) / 8.0, F.lit(1.0)))
        .withColumn("purity", F.greatest(F.lit(0.0), 1.0 - F.col("_noise")))
    )
    chars = F.col("clean_chars")
    length = F.least(chars / 1200.0, F.lit(1.0)) * F.when((chars > 12000) & (F.col("_noise") > 0.25), 0.75).otherwise(1.0)
    score = (
        F.col("quality_score") * 0.72
        + F.col("purity") * 0.08
        + length * 0.10
        + F.col("_ctx") * 0.06
        + F.col("_tech") * 0.04
        - F.col("_noise") * 0.16
    )
    off_topic = F.col("_ctx") < 0.40
    adjusted = (
        F.when((F.col("_agg") >= 0.5) & off_topic, score * 0.35)
        .when((F.col("_agg") >= 0.2) & off_topic, score - 0.25)
        .otherwise(score)
    ) - F.when(chars < minimum_chars, 0.12).otherwise(0.0)
    unusable = (F.col("quality_score") <= 0) | F.coalesce(
        F.col("quality_reason").isin("blocked_or_failure_page", "empty_after_cleaning", "mojibake_or_wrong_encoding"),
        F.lit(False),
    )
    return staged.withColumn("final_score", F.when(unusable, F.lit(0.0)).otherwise(clamp01(adjusted))).drop(
        "_tok", "_n", "_nav", "_agg", "_noise", "_wanted", "_ctx", "_tech"
    )


def best_read(df: DataFrame, key: str, backend: str, score_floor: float = 0.0) -> DataFrame:
    """Winning backend per page: score, then purity, then length.

    The floor is a condition of the aggregate.  As a filter on the rows, Spark would move it below the columns that make the
    score, which it then works out anew for each of their uses.
    """
    rank = F.struct(
        F.round("final_score", 6), F.round("purity", 6), F.least(F.col("clean_chars"), F.lit(12000)), F.col(backend)
    )
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(backend, "final_score", "purity", "clean_chars"), F.when(F.col("final_score") > score_floor, rank)).alias("_w"))
        .filter(F.col("_w").isNotNull())
        .select(key, "_w.*")
    )


def first_acceptable(df: DataFrame, key: str, priority: str, acceptable: Column, columns: list[str]) -> DataFrame:
    """First acceptable candidate in a fixed order of preference."""
    return (
        df.filter(acceptable)
        .groupBy(key)
        .agg(F.min(F.struct(priority, *columns)).alias("_c"))
        .select(key, "_c.*")
    )


# ----------------------------------------------------------------- skills


def match_skills(questions: DataFrame, question_id: str, question: str, skills: list[dict], limit: int = 5) -> DataFrame:
    """Skills whose triggers occur in the question, most triggers first.

    Skills are configuration: a short list, tested as literals inside the row.
    """
    low = F.lower(F.col(question))
    entries = [
        F.struct(
            T.hits(F.col("_low"), [t.lower() for t in s["triggers"]]).alias("hits"),
            F.lit(i).alias("position"),
            F.lit(s["id"]).alias("skill_id"),
        )
        for i, s in enumerate(skills)
    ]
    ordered = F.array_sort(
        F.transform(
            F.filter(F.array(*entries), lambda e: e["hits"] > 0),
            lambda e: F.struct((-e["hits"]).alias("neg"), e["position"].alias("position"), e["skill_id"].alias("skill_id")),
        )
    )
    return (
        questions.withColumn("_low", low)
        .select(question_id, F.posexplode(F.slice(ordered, 1, limit)).alias("rank", "_e"))
        .select(question_id, (F.col("rank") + 1).alias("rank"), F.col("_e.skill_id"), (-F.col("_e.neg")).alias("hits"))
    )


# fixed values: question words -> canned query
SEED_RULES = (
    (("反馈", "补偿", "电源", "环路", "纹波"), "switching power supply feedback loop compensation stability noise filtering"),
    (("反激", "电流检测", "采样", "限流", "尖峰"), "switch mode power supply current sense filter leading edge spike"),
    (("隔离", "光耦", "闭环", "地线", "布局"), "isolated feedback ripple noise PCB layout grounding"),
    (("负控", "正控", "保护板", "虚电压", "不能带载"), "MOSFET high side low side switch leakage ghost voltage bleed path"),
    (("运放", "调光", "栅极", "电位器", "LED"), "op amp power MOSFET LED dimmer gate drive feedback troubleshooting"),
)


def seed_queries(question: Column, skill_terms: Column | None = None, rules=SEED_RULES, limit: int = 4) -> Column:
    """Search queries for a question: skill terms, canned queries, own terms."""
    canned = [F.when(T.contains_any(question, keys), F.lit(q)) for keys, q in rules]
    own = F.array_join(F.slice(K.evidence_terms(question), 1, 10), " ")
    tail = F.when(F.length(own) > 0, F.concat(own, F.lit(" electronics circuit troubleshooting")))
    listed = F.array(*canned, tail)
    every = F.concat(skill_terms, listed) if skill_terms is not None else listed
    return F.slice(F.array_distinct(F.filter(F.array_compact(every), lambda q: F.length(T.strip(q)) > 0)), 1, limit)


# fixed values: design words that call for the knowledge base
FORMULA_MARKERS = (
    "公式", "计算", "推导", "选型", "formula", "calculate", "calculation", "layout", "emc", "emi", "参数", "设计",
)


def retrieval_score(question: Column, web_seen: Column, markers: tuple[str, ...] = FORMULA_MARKERS) -> Column:
    """How much a question (with its profile columns) calls for retrieval."""
    part = lambda name, per, cap: F.least(F.lit(cap), F.size(name) * per)
    return (
        part("models", 1.5, 3.0)
        + part("refdes", 1.5, 3.0)
        + part("values", 1.0, 3.0)
        + part("topology", 1.0, 2.0)
        + part("fault", 1.0, 2.0)
        + F.when(T.contains_any(F.lower(question), markers), 2.0).otherwise(0.0)
        + F.when(web_seen, 0.0).otherwise(1.0)
    )


def use_retrieval(score: Column, images: Column, inspected: Column) -> Column:
    return F.when(images & ~inspected & (score < 4.0), F.lit(False)).otherwise(score >= 2.0)


# fixed values: question buckets, first match wins; two rule sets
PLANNER_BUCKETS = (
    ("power_supply", ("电源", "开关", "反激", "LLC", "DCDC", "纹波", "TL431", "MOS")),
    ("embedded_software", ("程序", "代码", "编译", "驱动", "I2C", "SPI", "UART", "GPIO")),
    ("component_selection", ("选型", "型号", "参数", "电阻", "电容", "芯片", "传感器")),
    ("debugging", ("异常", "故障", "不工作", "报错", "问题", "怎么处理", "为什么")),
)
RUNTIME_BUCKETS = (
    ("power_supply", ("LLC", "DCDC", "TL431", "MOS", "PFC", "电源")),
    ("analog_driver_debugging", ("调光", "运放", "LM358")),
    ("battery_protection_switching", ("负控", "正控", "保护")),
)


def question_bucket(question: Column, buckets=PLANNER_BUCKETS, default: str = "general_component_anomaly") -> Column:
    upper = F.upper(question)
    out = None
    for name, keys in buckets:
        hit = T.contains_any(upper, [k.upper() for k in keys])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def planner_error_type(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(T.contains_any(low, ("invalid_request", "invalidparameter", "400")), "invalid_request")
        .when(T.contains_any(low, ("timeout", "timed out")), "timeout")
        .when(F.contains(low, F.lit("connection")), "connection_error")
        .otherwise("planner_error")
    )


# fixed values: what an answer is told about evidence of some kinds
CAUTIONS = {
    "local_kb_chunk": "注意: KB 证据来自预建技术文档索引，内容可能存在偏差，使用前需对照题面和图片验证一致性。",
    "image_inspection": "注意: 图片证据只代表视觉识别结果；疑似、看不清或无法确认的连接不能写成确定事实。",
}


def unique_evidence(df: DataFrame, group: str, order: str, chars: int | None = None) -> DataFrame:
    """Of evidence of one group with equal source, kind and content (its first ``chars`` characters where given) the first in ``order``."""
    fold = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    content = T.compact(F.col("content"), chars) if chars else T.squeeze(F.coalesce("content", F.lit("")))
    key = F.concat_ws("\n", fold(F.col("source")), fold(F.col("kind")), fold(content))
    keyed = df.withColumn("_key", F.sha2(F.encode(key, "UTF-8"), 256)).filter(T.strip(key) != "")
    firsts = keyed.groupBy(group, "_key").agg(F.min(order).alias(order))
    return keyed.join(firsts, [group, "_key", order], "left_semi").drop("_key")


def answer_context(df: DataFrame, group: str, lex: Lexicons = DEFAULT, limit: int = 12, cautions: dict[str, str] | None = None) -> DataFrame:
    """Numbered evidence text for an answer, by kind and score.

    At most ``limit`` items per group reach the concatenation.  ``cautions`` adds a line to evidence of its kinds.
    """
    top = top_k(df, [group], [_case(F.col("kind"), KIND_PRIORITY, 9), F.desc("score"), F.col("source")], limit, "n")
    top = C.compress(top, "content", "_kb", lex, 800)
    top = C.compress(top, "content", "_web", lex, 600)
    point = (
        F.when(F.col("kind") == "local_kb_chunk", F.col("_kb"))
        .when(F.col("kind").isin("web_page", "web_search_result"), F.col("_web"))
        .when(F.col("kind") == "image_inspection", T.compact(F.col("content"), 2200))
        .when(F.col("kind") == "domain_skill", T.compact(F.col("content"), 650))
        .when(F.col("kind") == "image_context", T.compact(F.col("content"), 180))
        .otherwise(T.compact(F.col("content"), 700))
    )
    caution = F.lit("")
    for kind, line in (cautions or {}).items():
        caution = F.when(F.col("kind") == kind, F.lit(f"\n{line}")).otherwise(caution)
    entry = F.format_string("[%d] 类型:%s\n标题:%s\n来源:%s%s\n要点:%s", "n", "kind", "title", "source", caution, point)
    return top.select(group, "n", entry.alias("entry")).groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda s: s["entry"]), "\n\n"
        ).alias("context")
    )


# fixed values: designators, part numbers, pins and value notations
_REFDES = r"(?i)[RCLDQUV][0-9]+[A-Z0-9]*"
_PART = r"(?i)[A-Z]{1,3}[0-9]{2,6}[A-Z]?[0-9]*[A-Z]*"
_PIN = r"(?i)(?:PIN|GPIO|引脚|第)\s*[0-9]+"
_NOT_PARTS = ("3V3", "5V", "12V", "24V", "220V", "311V", "0V", "1V", "2V", "10V", "15V", "30V")


def sanitise_answer(df: DataFrame, answer: str, question: str, context: str, out: str) -> DataFrame:
    """Take designators and part numbers out of an answer that neither the
    question nor the evidence mentions."""

    def found(text: Column, pattern: str) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.upper))

    both = F.concat_ws(" ", question, context)
    known = F.concat(*[found(both, p) for p in (_REFDES, _PART, _PIN)])
    staged = df.withColumn("_known", known)
    stray_refs = F.array_except(found(F.col(answer), _REFDES), F.col("_known"))

    def drop_ref(text: Column, ref: Column) -> Column:
        value = F.regexp_replace(text, F.concat(F.lit("(?i)"), ref, F.lit(r"\s*[=≈]\s*[0-9]+(?:\.[0-9]+)?\s*[A-Za-zΩμ]+")), F.lit(""))
        listed = F.regexp_replace(value, F.concat(F.lit(r"(?i)(?:,\s*|和\s*|、\s*)?"), ref), F.lit(""))
        return listed

    def drop_part(text: Column, part: Column) -> Column:
        noted = F.regexp_replace(text, F.concat(F.lit("(?i)"), part, F.lit(r"\s*[（(].*?[）)]")), F.lit(""))
        named = F.regexp_replace(noted, F.concat(F.lit(r"(?i)(?:芯片|IC|集成电路|型号)\s*"), part), F.lit(""))
        return F.regexp_replace(named, F.concat(F.lit("(?i)"), part), F.lit(""))

    staged = staged.withColumn("_clean", F.aggregate(stray_refs, F.col(answer), drop_ref))
    stray_parts = F.array_except(
        found(F.col("_clean"), _PART), F.concat("_known", F.array(*[F.lit(x) for x in _NOT_PARTS]))
    )
    tidy = T.substitute(
        F.aggregate(stray_parts, F.col("_clean"), drop_part),
        ((r"\(\s*\)", ""), (r"[,，]\s*[,，]", ","), (r"\s{2,}", " ")),
    )
    return staged.withColumn(out, T.strip(tidy)).drop("_known", "_clean")
