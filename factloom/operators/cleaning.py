"""Page and line level cleaning.

Line work keeps a text's lines in one array and answers positional questions
("first heading", "first of three prose lines", "first stop marker") by writing
one flag character per line into a string and locating a pattern in it.  No
line ever leaves its row, so cleaning needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import urls as U
from ..lexicons import DEFAULT, HOST_LINE_PATTERNS, Lexicons

# ---------------------------------------------------------------- page level


def boilerplate_text(low_flat: Column, lex: Lexicons = DEFAULT) -> Column:
    """``low_flat`` is lower case with white space collapsed."""
    noise = T.hits(low_flat, lex.noise)
    technical = T.hits(low_flat, tuple(t.lower() for t in lex.technical))
    legal = T.contains_any(low_flat, lex.legal) & (
        ~T.contains_any(low_flat, lex.high_value) | (technical < 3)
    )
    embed = F.contains(low_flat, F.lit(lex.embed_marker)) & (F.length(low_flat) < 1800)
    thin = (noise >= 1) & (technical == 0) & (T.alnum_ratio(low_flat) < 0.65)
    return (F.length(low_flat) == 0) | legal | (noise >= 2) | embed | thin


def low_value_source(source: Column, lex: Lexicons = DEFAULT) -> Column:
    return T.contains_any(F.lower(F.coalesce(source, F.lit(""))), lex.low_value_sources)


def project_source(source: Column, lex: Lexicons = DEFAULT) -> Column:
    return T.contains_any(F.lower(F.coalesce(source, F.lit(""))), lex.project_sources)


def deep_page(title: Column, body: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(F.concat_ws("\n", title, body))
    # fixed values: words that show a drawing or a measurement is discussed
    context = ("schematic", "原理图", "电路图", "波形", "scope", "故障", "异常")
    model = T.contains_any(low, [t.lower() for t in lex.technical[:20]])
    return (T.hits(low, [d.lower() for d in lex.diagnosis]) >= 2) | (model & T.contains_any(low, context))


def useful_reason(title: Column, url: Column, flat: Column, lex: Lexicons = DEFAULT, min_chars: int = 160) -> Column:
    """NULL for a useful page, else the first rule that rejects it."""
    low = F.lower(F.concat_ws("\n", title, url, flat))
    titled = F.lower(T.squeeze(F.concat_ws("\n", title, flat)))
    return (
        F.when(F.length(flat) < min_chars, "short")
        .when(low_value_source(url, lex), "low_value_source")
        .when(T.contains_any(low, lex.noise) & (F.length(flat) < 1200), "noise")
        .when(boilerplate_text(titled, lex), "boilerplate")
        .when(T.alnum_ratio(flat) < 0.35, "symbols")
    )


# fixed values: listing pages and bare directories are not articles
_LISTING = r"/[^/]+/[0-9]+_[0-9]+\.html$|/[^/]+/[^/]+/$|/[^/]+/$"


def source_allowed(title: Column, url: Column, lex: Lexicons = DEFAULT) -> Column:
    low_title = F.lower(T.strip(F.coalesce(title, F.lit(""))))
    low_url = F.lower(T.strip(F.coalesce(url, F.lit(""))))
    return (
        (F.length(low_title) > 0)
        & ~T.contains_any(low_title, lex.reject_titles)
        & ~F.contains(title, F.lit("�"))
        & ~T.contains_any(low_url, lex.reject_paths)
        & ~F.rlike(low_url, F.lit(_LISTING))
    )


def cleaned_is_valid(body: Column, title: Column, lex: Lexicons = DEFAULT, min_chars: int = 160) -> Column:
    low = F.lower(F.concat_ws("\n", title, body))
    found = (
        T.hits(low, [t.lower() for t in lex.technical])
        + T.hits(low, [t.lower() for t in lex.fault])
        + T.hits(low, lex.high_value)
    )
    return (F.length(body) >= min_chars) & (T.alnum_ratio(body) >= 0.35) & (found >= 2)


def technical_enough(body: Column, title: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(F.concat_ws("\n", title, body))
    technical = T.hits(low, [t.lower() for t in lex.technical + lex.public_content])
    return (technical >= 2) | (T.hits(low, lex.high_value) >= 1)


# fixed values: part families counted once per page
_MODEL_FAMILIES = (
    r"(?i)\b(?:TL431|LM358|LM324|LM393|UC384[2-5]|SG3525|IR2110|IR2153|NE555|LM78\d{2}|LM1117|AMS1117"
    r"|AO340[0-9]|IRF[0-9]+|STM32|ESP32|ATmega|PC817|EL817|4N25|MOC302[0-3]|BTA[0-9]+|BT136|TYN[0-9]+"
    r"|2N2222|2N3904|2N3906|BC547|BC557|TIP[0-9]+|LM2596|LM2576|XL4015|MP1584|MT3608|SX1308|TPS[0-9]+"
    r"|CS[0-9]+|OB[0-9]+|CR[0-9]+|MAX038|ICL8038|XR2206|AD8038|TDA7294)\b"
)
# fixed values: drawing references and navigation residue
_DRAWING = (
    "原理图", "电路图", "schematic", "circuit diagram", "pcb layout", "布线", "layout",
    "r1", "r2", "c1", "c2", "q1", "q2", "d1", "d2", "u1", "u2", "схема",
)
_NAV_RESIDUE = (
    "上一篇", "下一篇", "相关推荐", "热门推荐", "相关文章",
    "related articles", "related posts", "you may also like",
)


# fixed values: adjustments of single hosts
_MISMATCH_HOST = "elecfans.com"
_DOWNLOAD_MARKS = ("下载次数", "资源积分", "资源大小")
_DRAWING_WORDS = ("电路图", "原理图", "schematic", "电路分析", "设计实例")
_SHELL_HOST, _SHELL_MARKS = "circuitmaker.com", ("loading project", "please wait")
_PROFILE_HOSTS, _PROFILE_MARKS = ("hackster.io", "hackster.com"), (" - hackster.io", " - hackster.com")
_PATH_HOST, _PATHS, _CRUMB = "radiokot.ru", ("/circuit/", "/articles/"), "радиокот >"


def host_adjustment(title: Column, url: Column, low: Column, body: Column, host: Column, families: str) -> tuple[Column, Column]:
    """(penalty, bonus) of the rules of single hosts: a title naming models that the text does not have, a
    download page without drawings, a page still loading, a user profile, a path without articles."""
    on = lambda *names: T.contains_any(F.coalesce(host, F.lit("")), names)
    named = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(families), F.lit(0)))
    missing = F.size(F.filter(named, lambda m: ~F.contains(F.lower(body), m)))
    rules = (
        (on(_MISMATCH_HOST) & (F.size(named) > 0) & (missing >= F.floor(F.size(named) / 2)), -3),
        (on(_MISMATCH_HOST) & T.contains_any(low, _DOWNLOAD_MARKS) & ~T.contains_any(low, _DRAWING_WORDS), -10),
        (on(_SHELL_HOST) & T.contains_any(low, _SHELL_MARKS), -10),
        (on(*_PROFILE_HOSTS) & T.contains_any(low, _PROFILE_MARKS), -10),
        (on(_PATH_HOST) & ~T.contains_any(F.lower(url), _PATHS), -5),
    )
    penalty = sum((F.when(condition, F.lit(value)).otherwise(F.lit(0)) for condition, value in rules), F.lit(0))
    return penalty, F.when(on(_PATH_HOST) & F.contains(low, F.lit(_CRUMB)), F.lit(2)).otherwise(F.lit(0))


def page_quality(
    df: DataFrame, title: str, url: str, body: str, lex: Lexicons = DEFAULT, families: str = _MODEL_FAMILIES, host: str | None = None
) -> DataFrame:
    """Adds one column per quality dimension (``q_*``) and their sum ``quality``; ``host`` adds the rules of single hosts."""
    low = F.lower(F.concat_ws("\n", F.col(title), F.col(body)))
    staged = df.withColumn("_low", low).withColumn("_flat", T.squeeze(F.col("_low")))
    text, page = F.col("_low"), F.col(body)

    def capped(limit: int, terms: tuple[str, ...], per: int = 1) -> Column:
        found = T.hits(text, [t.lower() for t in terms])
        return F.least(F.lit(limit), F.floor(found / per).cast("int"))

    def flag(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    models = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(families), F.lit(0))))
    structure = (
        flag(F.length(page) > 2000, 1)
        + flag(T.occurrences(page, "##") >= 3, 1)
        + flag(F.rlike(page, F.lit(r"[0-9]+\.\s+[\p{L}\p{N}_]+")), 1)
    )
    penalties = (
        flag(low_value_source(F.col(url), lex), -5)
        + flag(boilerplate_text(F.col("_flat"), lex), -3)
        + flag(F.length(page) < 200, -3)
        + flag(T.contains_any(text, _NAV_RESIDUE), -2)
    )
    penalty, bonus = host_adjustment(F.col(title), F.col(url), text, page, F.col(host), families) if host else (F.lit(0), F.lit(0))
    scored = (
        staged.withColumn("q_diagnosis", capped(5, lex.diagnosis))
        .withColumn("q_depth", capped(5, lex.depth, 2))
        .withColumn("q_models", F.least(F.lit(3), models))
        .withColumn("q_drawings", capped(3, _DRAWING, 2))
        .withColumn("q_structure", structure)
        .withColumn("q_causal", capped(3, lex.causal, 3))
        .withColumn("q_qa", capped(3, lex.qa, 2))
        .withColumn("q_penalties", penalties + penalty)
        .withColumn("q_host_bonus", bonus)
    )
    parts = [c for c in scored.columns if c.startswith("q_")]
    return scored.withColumn("quality", sum((F.col(c) for c in parts), F.lit(0))).drop("_low", "_flat")


def chunk_is_useful(chunk: Column, lex: Lexicons = DEFAULT, short: int = 500) -> Column:
    return (F.length(chunk) >= short) | T.contains_any(F.lower(chunk), [k.lower() for k in lex.chunk_keywords])


# ---------------------------------------------------------------- line level

# fixed values: shapes of lines that carry no prose
_NOISE_LINE_SHAPES = (
    r"^[_\-*=#~.\s│|＋]+$",
    r"^_*!\[[\w.-]+\.(png|jpg|jpeg|gif|bmp|svg)\]\([^)]+\)$",
    r"^__?[0-9]+_{0,2}$",
    r"^[0-9]{1,6}$",
    r"^[A-Z]{2,4}-[a-f0-9]{20,}\.(png|jpg|jpeg|gif)\)?$",
)
_NOISE_LINE_SHAPES_LOW = (
    r"^[0-9]{1,3}\s*(次阅读|views|comments|shares|likes|浏览|回复)($|[^\p{L}\p{N}_])",
    r"^(posted|published|updated)\s+(on\s+)?[\p{L}\p{N}_\s,]+[0-9]{4}",
    r"^\[\s*email\s*protected\s*\]$",
    r"^(privacy policy|cookie policy|terms of use|terms of service)$",
    r"^©\s*copyright",
)
_IMAGE_LINE = r"^_*!\[.*\]\((https?:)?//[^)]+\)$"
_IMAGE_ADDRESS = r"^(https?:)?//[^/]+/.+\.(png|jpg|jpeg|gif|bmp|svg)\)?$"
_SHARE_LINE = r"^__+\s*(telegram|facebook|linkedin|whatsapp|email|print|twitter|youtube|instagram)?\s*__+$"


def noise_line(line: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(line)
    return (
        (F.length(line) == 0)
        | low.isin(*lex.nav_items)
        | ((F.length(line) < 8) & ~F.rlike(line, F.lit(r"\p{N}")))
        | T.rlike_any(line, _NOISE_LINE_SHAPES)
        | T.rlike_any(low, _NOISE_LINE_SHAPES_LOW)
        | ((F.length(line) < 300) & F.rlike(line, F.lit(_IMAGE_LINE)))
        | ((F.length(line) < 120) & F.rlike(low, F.lit(_IMAGE_ADDRESS)))
        | (F.contains(low, F.lit("data:image")) & F.contains(low, F.lit("base64")))
    )


def navigation_line(line: Column) -> Column:
    return (
        (F.startswith(line, F.lit("* ")) & (F.length(line) <= 24))
        | F.startswith(line, F.lit("####"))
        | F.startswith(line, F.lit("!["))
        | F.rlike(F.lower(line), F.lit(_SHARE_LINE))
    )


def link_boilerplate(line: Column, lex: Lexicons = DEFAULT) -> Column:
    """Lines made of links or images with almost no text around them."""
    links = T.occurrences(line, "](")
    images = T.occurrences(line, "![")
    no_images = F.regexp_replace(line, r"!\[[^\]]*\]\([^)]+\)", "")
    around = F.btrim(F.regexp_replace(no_images, r"\[[^\]]*\]\([^)]+\)", ""), F.lit(" -*_>|:;，,。"))
    labels = F.array_join(F.regexp_extract_all(line, F.lit(r"\[([^\]]*)\]\([^)]+\)"), F.lit(1)), " ")
    named = T.contains_any(labels, lex.boilerplate)
    thin = T.let(
        F.length(around),
        lambda rest: ((rest == 0) & (F.length(labels) <= 80))
        | ((links >= 2) & (rest <= 30))
        | ((images > 0) & (rest <= 20))
        | ((rest <= 30) & named),
    )
    return (F.contains(line, F.lit("](")) | F.contains(line, F.lit("!["))) & thin


def boilerplate_line(line: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(line)
    # fixed values: headers written by page readers
    headers = ("url source:", "published time:", "markdown content:", "warning: target url returned error")
    nav = lambda words: F.size(F.filter(words, lambda w: w.isin(*lex.nav_words)))
    few_words = T.let(
        K.content_tokens(low),
        lambda words: ((F.size(words) <= 8) & T.contains_any(low, lex.boilerplate))
        | ((F.size(words) <= 12) & (nav(words) >= 3))
        | ((F.size(words) <= 20) & (link_marks(low) >= 3)),
    )
    return (
        (F.length(line) <= 2)
        | T.starts_any(low, headers)
        | link_boilerplate(line, lex)
        | few_words
        | ((F.length(line) <= 40) & T.contains_any(line, lex.boilerplate))
        | F.rlike(line, F.lit(r"^[^\p{L}\p{N}]+$"))
    )


def flag_string(lines: Column, test) -> Column:
    """One character per line, ``1`` where the test holds."""
    return F.array_join(F.transform(lines, lambda x: F.when(test(x), "1").otherwise("0")), "")


def article_start(lines: Column, lex: Lexicons = DEFAULT) -> Column:
    """1-based line at which the article body begins."""

    def heading(x: Column) -> Column:
        title = T.strip(F.lower(F.regexp_extract(x, r"^#{1,2}\s+(.+)$", 1)))
        return F.startswith(x, F.lit("#")) & (F.length(title) >= 6) & ~T.contains_any(title, lex.noise_headings)

    def prose(x: Column) -> Column:
        return (F.length(x) >= 40) & (T.alnum_ratio(x) > 0.5) & ~noise_line(x, lex)

    first_heading = F.instr(flag_string(lines, heading), "1")
    first_prose = F.instr(flag_string(lines, prose), "111")
    return F.when(first_heading > 0, first_heading).when(first_prose > 0, first_prose).otherwise(F.lit(1))


def section_stop(line: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(line)
    return T.contains_any(low, [m.lower() for m in lex.section_stops]) | T.contains_any(line, lex.section_stops_cased)


# fixed values: text inserted by sites into article lines
INLINE_ARTIFACTS = (
    (r"\.?\s*[a-zA-Z0-9]{2,8}EETC-\s*$", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"(?i)\s*[（(]\s*(source|参考原文|编译自|文章来源)[：:]\s*[^)）]*[）)]", ""),
    (r"时间：[0-9\-]+\s*", ""),
    (r"作者：[^\s]+", ""),
    (r"来源：\S+", ""),
    (r"阅读：[0-9]*\s*", ""),
    (r"分享到：\s+", ""),
    (r"\b(微信|QQ空间|新浪微博|腾讯微博|人人网)\b", ""),
    (r"文章：[0-9]+\s*", ""),
    (r"被阅读：[0-9]+\s*", ""),
    (r"粉丝数：[0-9]+\s*", ""),
    (r"关注数：[0-9]+\s*", ""),
    (r"点赞数：[0-9]+\s*", ""),
    (r"次阅读\s*", ""),
    (r"[0-9]*\s*收藏\s*[（(][0-9]*[）)]?\s*", ""),
    (r"\b打印\b", ""),
    (r"\b举报\b", ""),
)
# one of these is in every line that a rule above changes
INLINE_MARKS = (
    "EETC-", "![", "(", "（", "时间：", "作者：", "来源：", "阅读：", "分享到：", "微信", "QQ空间", "新浪微博", "腾讯微博", "人人网",
    "文章：", "粉丝数：", "关注数：", "点赞数：", "次阅读", "收藏", "打印", "举报",
)
# fixed values: fragments left over once the lines are joined again
JOINED_ARTIFACTS = (
    (r"(?s)!\[[^\]]*?\]\s*\([^)]*?\)", ""),
    (r"(?m)^\s*[^\s!]+\]\([^)]*\.(png|jpg|jpeg|gif|bmp|svg)\)\s*$", ""),
    (r"\n_?//[^\s]+\n", "\n"),
)
TAIL_ARTIFACTS = (
    (r"(?m)^\s*\w+\.(com|cn|org|net|ru)/\S+\)?\s*$", ""),
    (r"(?mi)^\s*PCBWay\s*[–\-—].*$", ""),
    (r"\n{3,}", "\n\n"),
)


def _numbered(x: Column) -> Column:
    return F.rlike(x, F.lit(r"^[0-9]+\.\s+\S")) & (F.length(x) < 100)


def strip_trailing_numbers(df: DataFrame, body: str) -> DataFrame:
    """Cut a trailing block of numbered items (tag lists, related titles)."""
    arr, n, win = F.col("_arr"), F.col("_n"), F.least(F.lit(15), F.col("_n"))
    staged = (
        df.withColumn("_arr", F.transform(F.split(F.col(body), "\n"), T.strip))
        .withColumn("_n", F.size("_arr"))
        .withColumn("_flags", flag_string(F.slice(arr, n - win + 1, win), _numbered))
        # offset of the cluster: after the last gap of three or more plain lines
        .withColumn("_gap", F.regexp_extract("_flags", r"^(.*10{3,}|0*)1", 1))
        .withColumn("_start", n - win + F.length("_gap"))
        # the up to five lines before the cluster, never the very first line
        .withColumn("_low", F.greatest(F.lit(0), F.col("_start") - 6) + 1)
        .withColumn("_steps", F.greatest(F.col("_start") - F.col("_low"), F.lit(0)))
    )
    kind = F.array_join(
        F.transform(
            F.slice(arr, F.col("_low") + 1, F.col("_steps")),
            lambda x: F.when(F.length(x) == 0, "b")
            .when((F.length(x) > 40) & F.rlike(x, F.lit(r"[。！？.!?]$")), "e")
            .otherwise("o"),
        ),
        "",
    )
    staged = staged.withColumn("_kind", kind)
    last_break = F.length(F.regexp_extract("_kind", r"^(.*[be])o*$", 1))
    at_end = F.substring(F.col("_kind"), last_break, F.lit(1)) == "e"
    cut = (
        F.when(F.col("_steps") == 0, F.col("_start"))
        .when(last_break == 0, F.col("_low"))
        .when(at_end, F.col("_low") + last_break)
        .otherwise(F.col("_low") + last_break - 1)
    )
    numbered = F.length(F.replace(F.col("_flags"), F.lit("0"), F.lit("")))
    drop = (n >= 3) & (numbered >= 3) & (F.col("_cut") <= n - 3)
    head = T.strip(F.array_join(F.slice(F.split(F.col(body), "\n"), F.lit(1), F.greatest(F.col("_cut"), F.lit(0))), "\n"))
    return (
        staged.withColumn("_cut", cut)
        .withColumn(body, F.when(drop, head).otherwise(F.col(body)))
        .drop("_arr", "_n", "_flags", "_gap", "_start", "_low", "_steps", "_kind", "_cut")
    )


def without_artifacts(line: Column) -> Column:
    """``INLINE_ARTIFACTS`` removed; the patterns run only on lines with a mark of one."""
    return F.when(T.contains_any(line, INLINE_MARKS), T.substitute(line, INLINE_ARTIFACTS)).otherwise(line)


def clean_public_text(df: DataFrame, body: str, out: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """Article text of a crawled page, noise lines and site artefacts removed."""
    drops = [m.lower() for m in lex.line_drops]
    staged = (
        df.withColumn("_lines", T.lines(F.col(body)))
        .withColumn("_from", article_start(F.col("_lines"), lex))
        .withColumn("_stops", flag_string(F.col("_lines"), lambda x: section_stop(x, lex)))
        .withColumn("_to", F.expr("locate('1', _stops, _from)"))
        .withColumn(
            "_body",
            F.slice("_lines", F.col("_from"), F.when(F.col("_to") > 0, F.col("_to") - F.col("_from")).otherwise(F.size("_lines"))),
        )
    )

    def keep(x: Column) -> Column:
        return ~(noise_line(x, lex) | T.contains_any(F.lower(x), drops) | navigation_line(x))

    cut = F.transform(F.filter("_body", keep), without_artifacts)
    cut = F.filter(cut, lambda x: ~F.rlike(x, F.lit(r"^[_*\[\]\s\-.|/]*$")))
    staged = staged.withColumn(out, T.substitute(F.array_join(cut, "\n"), JOINED_ARTIFACTS))
    staged = strip_trailing_numbers(staged, out)
    # a last line of three or more short tags without punctuation
    staged = staged.withColumn("_last", F.substring_index(out, "\n", -1))
    last = T.strip(F.col("_last"))
    before = F.substring(F.col(out), F.lit(1), F.length(out) - F.length("_last") - 1)
    tags = (
        (F.length(last) < 120)
        & F.rlike(last, F.lit(r"^[^\s/]{2,20}([\s/]+[^\s/]{2,20}){2,}$"))
        & ~F.rlike(last, F.lit(r"[。！？.!?，,：:]"))
    )
    staged = staged.withColumn(
        out, F.when(tags, T.strip(before)).otherwise(F.col(out))
    )
    return staged.withColumn(out, T.strip(T.substitute(F.col(out), TAIL_ARTIFACTS))).drop(
        "_lines", "_from", "_stops", "_to", "_body", "_last"
    )


def cap_repeats(lines: Column, keep: int = 2) -> Column:
    """Lines without the third and later copies of the same normalised line.

    Copies are found by sorting (key, position) pairs, so the cost grows as
    n log n with the number of lines.
    """
    keyed = F.transform(
        lines,
        lambda x, i: F.struct(
            T.strip(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " ")).alias("key"), i.alias("at"), x.alias("line")
        ),
    )
    ordered = F.array_sort(F.filter(keyed, lambda s: F.length(s["key"]) > 0))
    shift = F.concat(F.array_repeat(F.lit(None).cast("string"), keep), F.transform(ordered, lambda s: s["key"]))
    marked = F.zip_with(
        ordered, shift, lambda s, back: F.struct(s["at"].alias("at"), s["line"].alias("line"), (back == s["key"]).alias("again"))
    )
    kept = F.filter(marked, lambda s: s["at"].isNotNull() & ~F.coalesce(s["again"], F.lit(False)))
    return F.transform(F.array_sort(kept), lambda s: s["line"])


def readable_lines(body: Column) -> Column:
    """Every line with inner white space collapsed; rule-only lines vanish."""
    parts = F.split(F.replace(F.coalesce(body, F.lit("")), F.lit("\r"), F.lit("\n")), "\n")
    flat = F.transform(parts, lambda x: T.strip(F.regexp_replace(T.squeeze(x), r"^\s*[-*|]+\s*$", "")))
    return F.filter(flat, lambda x: F.length(x) > 0)


def strip_host_lines(df: DataFrame, body: str, host: str, out: str) -> DataFrame:
    """Drop boilerplate lines by the patterns of the page's host."""
    universal = HOST_LINE_PATTERNS[("*",)]
    per_host = {h: p for hosts, pats in HOST_LINE_PATTERNS.items() for h in hosts for p in ["|".join(f"(?:{x})" for x in pats)]}
    table = F.create_map(*[F.lit(v) for pair in per_host.items() for v in pair])
    staged = df.withColumn("_rule", F.coalesce(F.element_at(table, F.col(host)), F.lit("(?!)")))

    def keep(x: Column) -> Column:
        short = (F.length(x) < 10) & ~F.rlike(x, F.lit(rf"[A-Za-z]{{3,}}|[{T.CJK}]{{2,}}"))
        image = F.startswith(x, F.lit("![")) & F.contains(x, F.lit(")"))
        return (F.length(x) == 0) | ~(T.rlike_any(x, universal) | F.regexp_like(x, F.col("_rule")) | short | image)

    kept = F.filter(F.transform(F.split(F.col(body), "\n"), T.strip), keep)
    return staged.withColumn(out, T.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))).drop("_rule")


def compress(df: DataFrame, body: str, out: str, lex: Lexicons = DEFAULT, max_chars: int = 600) -> DataFrame:
    """Best lines of a text within a length budget: ranked lines are taken until
    the first one that does not fit."""
    # fixed values: what makes a line worth keeping
    parts = r"(?i)\b(?:TL431|LM358|LM324|UC384|SG3525|IR2110|PC817|EL817|NE555|AO340|IRF[0-9]+|STM32|ESP32)\b"
    designator = r"(?i)[RCLDQUV][0-9]+[A-Z0-9]*"
    quantity = r"(?i)[0-9]+(?:\.[0-9]+)?(?:ohm|kohm|Ω|μF|uf|nf|pF|pf|Hz|khz|MHz|V|mA|A|W)"

    def keep(x: Column) -> Column:
        short = (F.length(x) < 15) & ~F.rlike(x, F.lit(r"[A-Za-z]{3,}|[0-9]+(?:\.[0-9]+)?[A-Za-z]"))
        return (F.length(x) > 0) & ~T.rlike_any(x, lex.compress_drops) & ~short

    def score(x: Column) -> Column:
        one = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0))
        return (
            one(T.rlike_any(x, lex.causal_patterns), 3)
            + one(F.rlike(x, F.lit(parts)), 2)
            + one(F.rlike(x, F.lit(designator)), 2)
            + one(F.rlike(x, F.lit(quantity)), 1)
            + one(F.length(x) >= 60, 1)
        )

    staged = df.withColumn("_keep", F.filter(F.transform(F.split(F.col(body), "\n"), T.strip), keep)).withColumn(
        "_ranked",
        F.array_sort(
            F.transform("_keep", lambda x, i: F.struct((-score(x)).alias("rank"), i.alias("at"), x.alias("line")))
        ),
    )
    taken = F.aggregate(
        "_ranked",
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda acc, s: F.when(
            ~acc["full"] & (acc["used"] + F.length(s["line"]) + 1 <= max_chars),
            F.struct((acc["used"] + F.length(s["line"]) + 1).alias("used"), (acc["n"] + 1).alias("n"), F.lit(False).alias("full")),
        ).otherwise(F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(True).alias("full"))),
        lambda acc: acc["n"],
    )
    best = F.array_join(F.transform(F.slice("_ranked", F.lit(1), taken), lambda s: s["line"]), " ")
    whole = F.array_join("_keep", " ")
    return staged.withColumn(out, F.when(F.length(whole) <= max_chars, whole).otherwise(best)).drop("_keep", "_ranked")


# ------------------------------------------------------------ content quality


def looks_failed(body: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    dense = F.length(F.regexp_replace(low, f"{T.WS}+", ""))
    return T.contains_any(low, lex.failure) & (
        (dense < 3000) | F.contains(low, F.lit("captcha")) | F.contains(low, F.lit("cloudflare"))
    )


def looks_like_html(body: Column) -> Column:
    return F.rlike(body, F.lit(r"(?i)<\s*(html|body|main|article|div|p|section|table|meta)\b"))


def mojibake_ratio(body: Column, lex: Lexicons = DEFAULT) -> Column:
    marks = T.total_occurrences(body, lex.mojibake)
    runs = F.length(F.array_join(F.regexp_extract_all(body, F.lit(r"[\x{c0}-\x{ff}]{2,}"), F.lit(0)), ""))
    return (marks + T.occurrences(body, "�") * 4 + runs * 4) / F.greatest(F.length(body), F.lit(1))


def repeated_line_ratio(body: Column) -> Column:
    long_lines = F.filter(F.transform(T.lines(body), F.lower), lambda x: F.length(x) >= 20)
    return T.let(
        long_lines,
        lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(x)) / F.size(x)),
    )


def forum_noise(body: Column, lex: Lexicons = DEFAULT) -> Column:
    # the score is defined on the opening of the page
    window = F.substring(body, 1, 2500)
    board = F.contains(window, F.lit("论坛")) & (F.contains(window, F.lit("发帖")) | F.contains(window, F.lit("返回列表")))
    return (T.total_occurrences(window, lex.forum_noise) + F.when(board, 2).otherwise(0)).cast("double")


def link_marks(low: Column) -> Column:
    return T.occurrences(low, "](") + T.occurrences(low, "http://") + T.occurrences(low, "https://")


def signal_count(tokens: Column, lex: Lexicons = DEFAULT) -> Column:
    known = F.size(F.filter(tokens, lambda t: t.isin(*lex.signal)))
    parts = F.size(F.filter(tokens, lambda t: F.rlike(t, F.lit("[a-z]+[0-9]+|[0-9]+[a-z]+"))))
    return known + F.least(parts, F.lit(4))


def context_overlap(tokens: Column, context: Column) -> Column:
    wanted = F.array_distinct(F.filter(K.content_tokens(context), lambda t: F.length(t) >= 4))
    return T.let(
        wanted,
        lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(w, tokens)) / F.size(w)),
    )


def hard_noise_reason(
    body: Column, title: Column, lex: Lexicons = DEFAULT, mojibake: Column | None = None, repeat: Column | None = None
) -> Column:
    """``mojibake`` and ``repeat`` may be given when they are already columns."""
    low = F.lower(body)
    moji = mojibake_ratio(body, lex) if mojibake is None else mojibake
    repeated = repeated_line_ratio(body) if repeat is None else repeat
    site_map = (
        F.contains(low, F.lit("sitemap"))
        | F.contains(body, F.lit("网站地图"))
        | F.contains(body, F.lit("站点地图"))
        | F.contains(F.lower(title), F.lit("sitemap"))
    )
    aggregated = T.contains_any(low, [a.lower() for a in lex.aggregation])
    daily = F.rlike(low, F.lit(r"\|\s*0\.[0-9]+\s*\|\s*daily\s*\|"))
    measured = F.struct(link_marks(low).alias("links"), repeated.alias("repeat"))
    return T.let(
        measured,
        lambda m: F.when((moji >= 0.08) & ~T.has_cjk(body), "mojibake_or_wrong_encoding")
        .when((m["links"] >= 10) & site_map, "site_map_or_link_index")
        .when((m["links"] >= 5) & daily, "site_map_or_link_index")
        .when(
            aggregated & ((m["links"] >= 5) | (m["repeat"] >= 0.35) | (F.length(body) < 800)), "search_or_aggregation_page"
        )
        .when((m["repeat"] >= 0.65) & (F.length(body) > 500), "repetitive_boilerplate"),
    )


def trim_to_context(body: Column, snippet: Column, title: Column) -> Column:
    """Start a page at the first place a piece of its search snippet occurs."""
    context = T.strip(F.coalesce(snippet, F.lit("")))
    # fixed values: leading pieces of the snippet that are looked up
    heads = F.array(*[T.strip(F.substring(context, 1, n)) for n in (120, 80, 50, 35, 25, 18, 12)])
    sentences = F.filter(F.transform(F.split(context, r"[。.!！?？\n]"), T.strip), lambda x: F.length(x) >= 20)
    pieces = F.filter(
        F.concat(heads, sentences),
        lambda x: F.length(x) >= F.when(T.has_cjk(x), F.lit(8)).otherwise(F.lit(20)),
    )
    at = F.array_min(F.filter(F.transform(pieces, lambda x: F.instr(body, x) - 1), lambda i: i > 250))
    keepers = F.filter(
        F.transform(F.slice(F.split(F.substring(body, F.lit(1), at), "\n\n"), 1, 4), T.strip),
        lambda x: F.startswith(x, F.lit("Title:")) | F.startswith(x, F.lit("#")),
    )
    lead = F.when(F.size(keepers) > 0, F.slice(keepers, 1, 2)).otherwise(
        F.filter(F.array(T.strip(title)), lambda x: F.length(x) > 0)
    )
    rest = F.regexp_replace(F.substring(body, at + 1, F.length(body)), f"^{T.WS}+", "")
    trimmed = T.strip(F.array_join(F.concat(lead, F.array(rest)), "\n\n"))
    return F.when((F.length(body) == 0) | (F.length(context) < 20) | at.isNull(), body).otherwise(trimmed)
