"""Sources, page rules, line cleaning and content quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import urls as U
from ..lexicons import DEFAULT
from ..operators import cleaning as C
from ..operators import evidence as E
from ..operators import html as H
from ..operators import ordered as O
from ..sources import catalog, pages, samples
from . import query
from .base import (
    CHUNKS, PAIRS, READ_OUT, SYN, chunks, pairs, q, sql_any, sql_hits, sql_in, sql_lines, sql_list, sql_occ, sql_occs, sql_ratio,
    sql_squeeze, sql_strip, table,
)

# ------------------------------------------------------------------ samples


@query(
    "sample_assembly",
    """SELECT conv_id,
       coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '') AS question,
       coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS reference,
       count(*) FILTER (WHERE role = 'user' AND trim(text) <> '') AS question_parts
       FROM conversations GROUP BY conv_id""",
)
def sample_assembly(spark, sf):
    return samples.assemble(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "dataset_validation",
    f"""WITH {PAIRS}, per_id AS (SELECT sample_id, count(*) AS n, count(*) FILTER (WHERE question = '') AS nq,
         count(*) FILTER (WHERE reference = '') AS nr FROM pairs GROUP BY 1)
       SELECT CAST(sum(n) AS BIGINT) AS total_samples, count(*) AS unique_samples,
         count(*) FILTER (WHERE n > 1) AS duplicate_samples, CAST(sum(nq) AS BIGINT) AS missing_question,
         CAST(sum(nr) AS BIGINT) AS missing_reference FROM per_id""",
)
def dataset_validation(spark, sf):
    return samples.validate(pairs(spark, sf))


# --------------------------------------------------------------------- pages

_MD_SQL = """md AS (SELECT doc_id, '**标题**: ' || substr(split_part(text, chr(10), 1), 1, 60) || chr(10)
   || '**链接**: https://' || source || '.example.org/' || CAST(doc_id AS VARCHAR) || chr(10)
   || CASE WHEN lang = 'de' THEN '' ELSE '**发布时间**: ' || lang || chr(10) END || text AS raw FROM documents)"""


def _markdown(spark, sf):
    """Crawled page files derived from the documents."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.concat(
            F.lit("**标题**: "), F.substring(F.substring_index("text", "\n", 1), 1, 60),
            F.lit("\n**链接**: https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"), F.lit("\n"),
            F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("**发布时间**: "), "lang", F.lit("\n"))), "text",
        ).alias("raw"),
        F.concat(F.lit("/corpus/page_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
    )


def _label(name: str) -> str:
    return f"regexp_extract(raw, '(?m)^[ \\t]*\\*\\*{name}\\*\\*[ \\t]*:[ \\t]*(.*?)[ \\t]*$', 1)"


@query(
    "markdown_page_parse",
    f"""WITH {_MD_SQL}, body AS (
      SELECT doc_id, raw, array_to_string(list_filter({sql_lines("raw")},
        lambda x: NOT regexp_matches(x, '^\\*\\*(标题|链接|发布时间)\\*\\*\\s*:')), chr(10)) AS text FROM md)
    SELECT doc_id, coalesce(nullif({sql_squeeze(_label("标题"))}, ''), 'page_' || CAST(doc_id AS VARCHAR)) AS title,
      {_label("链接")} AS url, coalesce(nullif({_label("发布时间")}, ''), '未知') AS published_at,
      length(text) AS chars, sha1(text) AS text_hash FROM body""",
)
def markdown_page_parse(spark, sf):
    parsed = pages.parse(_markdown(spark, sf), "raw", "path")
    return parsed.select("doc_id", "title", "url", "published_at", F.length("text").alias("chars"), "text_hash")


_URL_SQL = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)'"


def _url_part(n: int, col: str = "url") -> str:
    return f"regexp_extract({col}, {_URL_SQL}, {n})"


_HOST_SQL = f"regexp_replace(lower({_url_part(2)}), ':[0-9]*$', '')"


@query(
    "page_url_normalize",
    f"""SELECT page_id, {_HOST_SQL} AS host, {_url_part(3)} AS path,
        CASE WHEN lower({_url_part(1)}) IN ('http', 'https') AND {_url_part(2)} <> ''
             THEN lower({_url_part(1)}) || '://' || lower({_url_part(2)}) || regexp_replace({_url_part(3)}, '/+$', '')
             ELSE '' END AS canonical FROM pages""",
)
def page_url_normalize(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.host(url).alias("host"), U.path(url).alias("path"), U.canonical(url).alias("canonical")
    )


@query(
    "public_url_guard",
    f"""WITH addresses AS (
      SELECT url FROM pages UNION ALL
      SELECT 'http://' || json_extract_string(props, '$.k') || '.' || CAST(user_id AS VARCHAR) || '.0.1:8080/' || event_type FROM events
      UNION ALL SELECT CASE WHEN user_id < 20 THEN 'ftp' ELSE 'https' END || '://' || CASE WHEN value < 50 THEN 'localhost'
        ELSE '172.' || CAST(user_id % 40 AS VARCHAR) || '.3.4' END || '/x' FROM events),
    parts AS (SELECT url, lower({_url_part(1)}) AS s, {_HOST_SQL} AS h FROM addresses),
    octets AS (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]+(\\.[0-9]+){{3}}$') THEN string_split(h, '.') END AS o FROM parts)
    SELECT s AS scheme, count(*) AS n, count(*) FILTER (WHERE s IN ('http', 'https') AND h <> ''
      AND h NOT IN ('localhost', '127.0.0.1', '0.0.0.0', '::1', '[::1]')
      AND NOT coalesce(o[1] IN ('10', '127') OR (o[1] = '172' AND CAST(o[2] AS INT) BETWEEN 16 AND 31)
        OR (o[1] = '192' AND o[2] = '168') OR (o[1] = '169' AND o[2] = '254'), false)) AS public
    FROM octets GROUP BY s""",
)
def public_url_guard(spark, sf):
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    dotted = F.concat(F.lit("http://"), k, F.lit("."), user, F.lit(".0.1:8080/"), "event_type")
    name = F.when(F.col("value") < 50, "localhost").otherwise(
        F.concat(F.lit("172."), (F.col("user_id") % 40).cast("string"), F.lit(".3.4"))
    )
    named = F.concat(F.when(F.col("user_id") < 20, "ftp").otherwise("https"), F.lit("://"), name, F.lit("/x"))
    urls = (
        table(spark, sf, "pages").select("url")
        .unionByName(events.select(F.explode(F.array(dotted, named)).alias("url")))
    )
    return urls.groupBy(U.scheme(F.col("url")).alias("scheme")).agg(
        F.count("*").alias("n"), F.count_if(U.is_public(F.col("url"))).alias("public")
    )


@query(
    "redirect_decode",
    """SELECT page_id, url AS from_search, url AS from_result, url AS from_code, url AS from_yahoo FROM pages""",
)
def redirect_decode(spark, sf):
    """Every page address is wrapped in each redirect form and unwrapped again."""
    url = F.col("url")
    quoted = F.url_encode(url)
    coded = F.regexp_replace(F.translate(F.base64(F.encode(url, "UTF-8")), "+/", "-_"), "[=\r\n]+", "")
    wrapped = table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("https://duckduckgo.com/l/?uddg="), quoted, F.lit("&rut=1")).alias("a"),
        F.concat(F.lit("https://www.bing.com/ck/a?!&p=1&u=a1"), coded, F.lit("&ntb=1")).alias("b"),
        F.concat(F.lit("a1"), coded).alias("c"),
        F.concat(F.lit("https://r.search.yahoo.com/_ylt=1/RU="), quoted, F.lit("/RK=2")).alias("d"),
    )
    return wrapped.select(
        "page_id",
        U.redirect_target(F.col("a")).alias("from_search"),
        U.redirect_target(F.col("b")).alias("from_result"),
        U.redirect_target(F.col("c")).alias("from_code"),
        U.redirect_target(F.col("d")).alias("from_yahoo"),
    )


_LOW_FLAT = f"lower({sql_squeeze('text')})"


def _boilerplate_sql(low: str) -> str:
    """Boolean SQL over a column ``low`` (lower case, white space collapsed)."""
    noise, technical = sql_hits(low, SYN.noise), sql_hits(low, [t.lower() for t in SYN.technical])
    return f"""(length({low}) = 0 OR ({sql_any(low, SYN.legal)} AND (NOT {sql_any(low, SYN.high_value)} OR {technical} < 3))
      OR {noise} >= 2 OR (contains({low}, {q(SYN.embed_marker)}) AND length({low}) < 1800)
      OR ({noise} >= 1 AND {technical} = 0 AND {sql_ratio(low)} < 0.65))"""


@query(
    "boilerplate_flags",
    f"""WITH d AS (SELECT doc_id, lang, {_LOW_FLAT} AS low FROM documents)
        SELECT lang, count(*) AS docs, count(*) FILTER (WHERE {_boilerplate_sql('low')}) AS boilerplate FROM d GROUP BY lang""",
)
def boilerplate_flags(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.lower(T.squeeze(F.col("text"))).alias("low"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(C.boilerplate_text(F.col("low"), SYN)).alias("boilerplate")
    )


@query(
    "useful_page_funnel",
    f"""WITH {CHUNKS}, f AS (SELECT *, {sql_squeeze('text')} AS flat FROM chunks),
      l AS (SELECT *, lower(title || chr(10) || url || chr(10) || flat) AS low,
            lower({sql_squeeze("title || chr(10) || flat")}) AS titled FROM f)
      SELECT coalesce(CASE WHEN length(flat) < 160 THEN 'short' WHEN {sql_any('lower(url)', SYN.low_value_sources)} THEN 'low_value_source'
        WHEN {sql_any('low', SYN.noise)} AND length(flat) < 1200 THEN 'noise' WHEN {_boilerplate_sql('titled')} THEN 'boilerplate'
        WHEN {sql_ratio('flat')} < 0.35 THEN 'symbols' END, 'kept') AS outcome, count(*) AS pages FROM l GROUP BY 1""",
)
def useful_page_funnel(spark, sf):
    staged = chunks(spark, sf).withColumn("flat", T.squeeze(F.col("text")))
    reason = C.useful_reason(F.col("title"), F.col("url"), F.col("flat"), SYN)
    return staged.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("pages"))


@query(
    "source_rules",
    f"""WITH {CHUNKS} SELECT lang, count(*) AS pages, count(*) FILTER (WHERE {sql_any('lower(url)', SYN.low_value_sources)}) AS low_value,
      count(*) FILTER (WHERE {sql_any('lower(url)', SYN.project_sources)}) AS project,
      count(*) FILTER (WHERE regexp_extract(url, '://([^/]+)', 1) IN {sql_in(SYN.trusted_hosts)}) AS trusted,
      count(*) FILTER (WHERE {sql_hits("lower(title || chr(10) || text)", [d.lower() for d in SYN.diagnosis])} >= 2
        OR ({sql_any("lower(title || chr(10) || text)", [t.lower() for t in SYN.technical[:20]])}
            AND {sql_any("lower(title || chr(10) || text)", ("schematic", "原理图", "电路图", "波形", "scope", "故障", "异常"))})) AS deep,
      count(*) FILTER (WHERE trim(title) <> '' AND NOT {sql_any('lower(trim(title))', SYN.reject_titles)} AND NOT contains(title, '�')
        AND NOT {sql_any('lower(url)', SYN.reject_paths)}
        AND NOT regexp_matches(lower(url), '/[^/]+/[0-9]+_[0-9]+\\.html$|/[^/]+/[^/]+/$|/[^/]+/$')) AS allowed
      FROM chunks GROUP BY lang""",
)
def source_rules(spark, sf):
    url, title = F.col("url"), F.col("title")
    return chunks(spark, sf).groupBy("lang").agg(
        F.count("*").alias("pages"),
        F.count_if(C.low_value_source(url, SYN)).alias("low_value"),
        F.count_if(C.project_source(url, SYN)).alias("project"),
        F.count_if(E.trusted(url, SYN)).alias("trusted"),
        F.count_if(C.deep_page(title, F.col("text"), SYN)).alias("deep"),
        F.count_if(C.source_allowed(title, url, SYN)).alias("allowed"),
    )


@query(
    "public_page_filter",
    f"""WITH {CHUNKS}, l AS (SELECT lang, text, lower(title || chr(10) || text) AS low FROM chunks)
      SELECT lang, count(*) AS pages,
        count(*) FILTER (WHERE length(text) >= 160 AND {sql_ratio('text')} >= 0.35
          AND {sql_hits('low', [t.lower() for t in SYN.technical])} + {sql_hits('low', SYN.fault)} + {sql_hits('low', SYN.high_value)} >= 2) AS valid,
        count(*) FILTER (WHERE {sql_hits('low', [t.lower() for t in SYN.technical + SYN.public_content])} >= 2
          OR {sql_any('low', SYN.high_value)}) AS technical FROM l GROUP BY lang""",
)
def public_page_filter(spark, sf):
    body, title = F.col("text"), F.col("title")
    return chunks(spark, sf).groupBy("lang").agg(
        F.count("*").alias("pages"),
        F.count_if(C.cleaned_is_valid(body, title, SYN)).alias("valid"),
        F.count_if(C.technical_enough(body, title, SYN)).alias("technical"),
    )


# per host: allowed path parts, rejected path parts, rejected titles
_HOST_RULES = [
    ("example.com", ["/en/", "/de/"], ["?page"], ["than"]),
    ("example.net", ["/"], ["/fr/"], ["les", "und"]),
    ("example.org", ["/en/", "/fr/", "/es/"], ["/es/"], []),
]


@query(
    "host_rules",
    f"""WITH rules(site, allow, deny, titles) AS (VALUES {", ".join(
        f"({q(h)}, {sql_list(a)}, {sql_list(d)}, {sql_list(t) if t else 'CAST([] AS VARCHAR[])'})" for h, a, d, t in _HOST_RULES)}),
      p AS (SELECT page_id, lower({_url_part(3)}) AS path, regexp_extract({_HOST_SQL}, '([^.]+\\.[^.]+)$', 1) AS site,
            lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages)
      SELECT p.site, count(*) AS pages, count(*) FILTER (WHERE r.site IS NULL OR (
          len(list_filter(r.allow, lambda x: contains(path, x))) > 0 AND len(list_filter(r.deny, lambda x: contains(path, x))) = 0
          AND len(list_filter(r.titles, lambda x: contains(title, x))) = 0)) AS allowed
      FROM p LEFT JOIN rules r USING (site) GROUP BY p.site""",
)
def host_rules(spark, sf):
    rules = pages.host_rules(spark, _HOST_RULES)
    staged = table(spark, sf, "pages").select(
        "page_id",
        F.lower(U.path(F.col("url"))).alias("path"),
        F.regexp_extract(U.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("site"),
        F.lower(H.title(F.col("html"))).alias("title"),
    )
    flagged = pages.apply_host_rules(staged, rules, "site", "path", "title")
    return flagged.groupBy("site").agg(F.count("*").alias("pages"), F.count_if("allowed").alias("allowed"))


@query(
    "quick_candidates",
    f"""WITH {CHUNKS}, s AS (SELECT chunk_id, {sql_hits("lower(title || chr(10) || url)", [m.lower() for m in SYN.quick_check])} AS quick FROM chunks)
      SELECT chunk_id, quick FROM s WHERE quick > 0""",
)
def quick_candidates(spark, sf):
    low = F.lower(F.concat_ws("\n", "title", "url"))
    scored = chunks(spark, sf).select("chunk_id", T.hits(low, [m.lower() for m in SYN.quick_check]).alias("quick"))
    return scored.filter("quick > 0")


def _capped(limit: int, terms, per: int = 1) -> str:
    return f"least({limit}, {sql_hits('low', [t.lower() for t in terms])} // {per})"


_FAMILIES = r"(?i)\b(?:heed|eaux|unge|tionch)[a-z]*\b"


@query(
    "page_quality",
    f"""WITH {CHUNKS}, h AS (SELECT chunk_id, title, text || CASE chunk_id % 7 WHEN 0 THEN ' 下载次数 ' WHEN 1 THEN ' 下载次数 电路图' WHEN 2 THEN ' please wait' WHEN 3 THEN ' - hackster.io' WHEN 4 THEN ' радиокот > ' ELSE '' END AS text,
        url || CASE chunk_id % 3 WHEN 0 THEN '/circuit/1' ELSE '/x' END AS url, CASE chunk_id % 5 WHEN 0 THEN 'www.elecfans.com' WHEN 1 THEN 'circuitmaker.com' WHEN 2 THEN 'hackster.io' WHEN 3 THEN 'radiokot.ru' ELSE 'example.org' END AS host FROM chunks),
      l AS (SELECT *, lower(title || chr(10) || text) AS low, {sql_squeeze("lower(title || chr(10) || text)")} AS flat,
        list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^(heed|eaux|unge|tionch)[a-z]*$'))) AS named FROM h),
      s AS (SELECT chunk_id, {_capped(5, SYN.diagnosis)} AS q_diagnosis, {_capped(5, SYN.depth, 2)} AS q_depth,
        least(3, len(list_distinct(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^(heed|eaux|unge|tionch)[a-z]*$'))))) AS q_models, {_capped(3, C._DRAWING, 2)} AS q_drawings,
        CAST(length(text) > 2000 AS INT) + CAST({sql_occ('text', '##')} >= 3 AS INT) + CAST(regexp_matches(text, '[0-9]+\\.\\s+[\\p{{L}}\\p{{N}}_]+') AS INT) AS q_structure,
        {_capped(3, SYN.causal, 3)} AS q_causal, {_capped(3, SYN.qa, 2)} AS q_qa,
        CASE WHEN {sql_any('lower(url)', SYN.low_value_sources)} THEN -5 ELSE 0 END + CASE WHEN {_boilerplate_sql('flat')} THEN -3 ELSE 0 END
        + CASE WHEN length(text) < 200 THEN -3 ELSE 0 END + CASE WHEN {sql_any('low', C._NAV_RESIDUE)} THEN -2 ELSE 0 END
        + CASE WHEN host = 'www.elecfans.com' AND len(named) > 0 AND len(list_filter(named, lambda m: NOT contains(lower(text), m))) >= len(named) // 2 THEN -3 ELSE 0 END
        + CASE WHEN host = 'www.elecfans.com' AND regexp_matches(low, '下载次数|资源积分|资源大小') AND NOT regexp_matches(low, '电路图|原理图|schematic|电路分析|设计实例') THEN -10 ELSE 0 END
        + CASE WHEN host = 'circuitmaker.com' AND regexp_matches(low, 'loading project|please wait') THEN -10 ELSE 0 END
        + CASE WHEN host = 'hackster.io' AND regexp_matches(low, ' - hackster\\.(io|com)') THEN -10 ELSE 0 END
        + CASE WHEN host = 'radiokot.ru' AND NOT regexp_matches(lower(url), '/circuit/|/articles/') THEN -5 ELSE 0 END AS q_penalties,
        CASE WHEN host = 'radiokot.ru' AND contains(low, 'радиокот >') THEN 2 ELSE 0 END AS q_host_bonus FROM l)
      SELECT *, q_diagnosis + q_depth + q_models + q_drawings + q_structure + q_causal + q_qa + q_penalties + q_host_bonus AS quality FROM s""",
)
def page_quality(spark, sf):
    """Chunks stand for pages of the hosts that have rules of their own, with the marks those rules look for."""
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("chunk_id") % n + 1).cast("int"))
    marks = pick(7, " 下载次数 ", " 下载次数 电路图", " please wait", " - hackster.io", " радиокот > ", "", "")
    pages_ = chunks(spark, sf).select(
        "chunk_id", "title", F.concat("text", marks).alias("text"), F.concat("url", pick(3, "/circuit/1", "/x", "/x")).alias("url"),
        pick(5, "www.elecfans.com", "circuitmaker.com", "hackster.io", "radiokot.ru", "example.org").alias("host"),
    )
    scored = C.page_quality(pages_, "title", "url", "text", SYN, families=_FAMILIES, host="host")
    return scored.drop("title", "url", "text", "host")


@query(
    "chunk_quality",
    f"""SELECT source, count(*) AS chunks, count(*) FILTER (WHERE length(text) >= 500
        OR {sql_any('lower(text)', SYN.chunk_keywords)}) AS kept FROM documents GROUP BY source""",
)
def chunk_quality(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("chunks"), F.count_if(C.chunk_is_useful(F.col("text"), SYN)).alias("kept")
    )


# ------------------------------------------------------------------- lines


@query(
    "line_repeat_cap",
    f"""WITH l AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents),
      x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
      k AS (SELECT *, trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS key FROM x),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS n FROM k WHERE key <> ''),
      g AS (SELECT doc_id, count(*) AS kept_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM r WHERE n <= 2 GROUP BY doc_id)
      SELECT l.doc_id, len(ls) AS all_lines, coalesce(kept_lines, 0) AS kept_lines, coalesce(digest, md5('')) AS digest
      FROM l LEFT JOIN g USING (doc_id)""",
)
def line_repeat_cap(spark, sf):
    staged = table(spark, sf, "documents").select("doc_id", T.lines(F.col("text")).alias("ls"))
    staged = staged.withColumn("kept", C.cap_repeats(F.col("ls")))
    return staged.select(
        "doc_id",
        F.size("ls").cast("long").alias("all_lines"),
        F.size("kept").cast("long").alias("kept_lines"),
        F.md5(F.encode(F.array_join("kept", "\n"), "UTF-8")).alias("digest"),
    )


def _flags_sql(test: str) -> str:
    return f"array_to_string(list_transform(ls, lambda x: CASE WHEN {test} THEN '1' ELSE '0' END), '')"


@query(
    "section_stop",
    f"""WITH l AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents),
      f AS (SELECT doc_id, ls, strpos({_flags_sql(sql_any('lower(x)', [m.lower() for m in SYN.section_stops]) + ' OR ' + sql_any('x', SYN.section_stops_cased))}, '1') AS stop FROM l)
      SELECT doc_id, CAST(stop AS INT) AS stop_line, CASE WHEN stop > 0 THEN stop - 1 ELSE len(ls) END AS kept_lines FROM f""",
)
def section_stop(spark, sf):
    staged = table(spark, sf, "documents").select("doc_id", T.lines(F.col("text")).alias("ls"))
    stop = F.instr(C.flag_string(F.col("ls"), lambda x: C.section_stop(x, SYN)), "1")
    staged = staged.withColumn("stop_line", stop)
    kept = F.when(F.col("stop_line") > 0, F.col("stop_line") - 1).otherwise(F.size("ls"))
    return staged.select("doc_id", "stop_line", kept.cast("long").alias("kept_lines"))


def _noise_line_sql(x: str) -> str:
    low = f"lower({x})"
    shapes = " OR ".join(f"regexp_matches({x}, {q(p)})" for p in C._NOISE_LINE_SHAPES)
    low_shapes = " OR ".join(f"regexp_matches({low}, {q(p)})" for p in C._NOISE_LINE_SHAPES_LOW)
    return f"""(length({x}) = 0 OR {low} IN {sql_in(SYN.nav_items)} OR (length({x}) < 8 AND NOT regexp_matches({x}, '\\p{{N}}'))
      OR {shapes} OR {low_shapes} OR (length({x}) < 300 AND regexp_matches({x}, {q(C._IMAGE_LINE)}))
      OR (length({x}) < 120 AND regexp_matches({low}, {q(C._IMAGE_ADDRESS)}))
      OR (contains({low}, 'data:image') AND contains({low}, 'base64')))"""


_HEADING_SQL = f"""(length(trim(lower(regexp_extract(x, '^#{{1,2}}\\s+(.+)$', 1)))) >= 6
   AND NOT {sql_any("lower(regexp_extract(x, '^#{1,2}\\s+(.+)$', 1))", SYN.noise_headings)})"""


@query(
    "article_start",
    f"""WITH l AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents),
      f AS (SELECT doc_id, ls, {_flags_sql(_HEADING_SQL)} AS h,
            {_flags_sql(f"length(x) >= 40 AND {sql_ratio('x')} > 0.5 AND NOT {_noise_line_sql('x')}")} AS p FROM l)
      SELECT doc_id, CAST(CASE WHEN strpos(h, '1') > 0 THEN strpos(h, '1') WHEN strpos(p, '111') > 0 THEN strpos(p, '111') ELSE 1 END AS INT) AS start_line,
        length(p) - length(replace(p, '1', '')) AS prose_lines FROM f""",
)
def article_start(spark, sf):
    staged = table(spark, sf, "documents").select("doc_id", T.lines(F.col("text")).alias("ls"))
    prose = F.size(
        F.filter("ls", lambda x: (F.length(x) >= 40) & (T.alnum_ratio(x) > 0.5) & ~C.noise_line(x, SYN))
    )
    return staged.select("doc_id", C.article_start(F.col("ls"), SYN).alias("start_line"), prose.cast("long").alias("prose_lines"))


@query(
    "line_noise_counts",
    f"""WITH l AS (SELECT source, unnest({sql_lines('text')}) AS x FROM documents)
      SELECT source, count(*) AS all_lines, count(*) FILTER (WHERE {_noise_line_sql('x')}) AS noise,
       count(*) FILTER (WHERE (x LIKE '* %' AND length(x) <= 24) OR x LIKE '####%' OR x LIKE '![%'
         OR regexp_matches(lower(x), {q(C._SHARE_LINE)})) AS navigation FROM l GROUP BY source""",
)
def line_noise_counts(spark, sf):
    ls = table(spark, sf, "documents").select("source", F.explode(T.lines(F.col("text"))).alias("x"))
    return ls.groupBy("source").agg(
        F.count("*").alias("all_lines"),
        F.count_if(C.noise_line(F.col("x"), SYN)).alias("noise"),
        F.count_if(C.navigation_line(F.col("x"))).alias("navigation"),
    )


def _substitute_sql(col: str, rules) -> str:
    out = col
    for pattern, to in rules:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'g')"
    return out


_DECORATED = "text || ' （source：' || source || '）来源：' || lang || ' 阅读：' || CAST(n_chars AS VARCHAR) || ' ![x](y.png) 12收藏(3) 作者：' || source"


@query(
    "inline_artifacts",
    f"""SELECT doc_id, md5({_substitute_sql(_DECORATED, C.INLINE_ARTIFACTS)}) AS digest FROM documents""",
)
def inline_artifacts(spark, sf):
    col = F.concat(
        "text", F.lit(" （source："), "source", F.lit("）来源："), "lang", F.lit(" 阅读："), F.col("n_chars").cast("string"),
        F.lit(" ![x](y.png) 12收藏(3) 作者："), "source",
    )
    cleaned = T.substitute(col, C.INLINE_ARTIFACTS)
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(cleaned, "UTF-8")).alias("digest"))


@query("public_clean_text")
def public_clean_text(spark, sf):
    cleaned = C.clean_public_text(table(spark, sf, "documents"), "text", "cleaned", SYN)
    return cleaned.select("doc_id", F.length("cleaned").alias("chars"), F.md5(F.encode("cleaned", "UTF-8")).alias("digest"))


_LINE_HOSTS = [h for key in C.HOST_LINE_PATTERNS for h in key if h != "*"]
_HOST_PATTERNS = {h: "|".join(f"(?:{x})" for x in patterns) for key, patterns in C.HOST_LINE_PATTERNS.items() for h in key}
_HOST_CASES = " ".join(f"WHEN {q(h)} THEN regexp_matches(x, {q(p)})" for h, p in _HOST_PATTERNS.items() if h != "*")


@query(
    "host_line_strip",
    f"""WITH d AS (SELECT doc_id, {sql_list(_LINE_HOSTS)}[1 + doc_id % {len(_LINE_HOSTS)}] AS host, list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}) AS ls FROM documents),
      l AS (SELECT doc_id, host, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d),
      k AS (SELECT doc_id, host, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE length(x) = 0 OR NOT (regexp_matches(x, {q(_HOST_PATTERNS['*'])}) OR CASE host {_HOST_CASES} ELSE false END
          OR (length(x) < 10 AND NOT regexp_matches(x, '[A-Za-z]{{3,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) OR (starts_with(x, '![') AND contains(x, ')')))) AS body FROM l GROUP BY 1, 2)
      SELECT host, count(*) AS docs, CAST(sum(length({sql_strip("regexp_replace(coalesce(body, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")})) AS BIGINT) AS chars FROM k GROUP BY host""",
)
def host_line_strip(spark, sf):
    """Every document as a page of one of the hosts that have patterns of their own."""
    site = F.element_at(F.array(*[F.lit(h) for h in _LINE_HOSTS]), (F.col("doc_id") % len(_LINE_HOSTS) + 1).cast("int"))
    docs = table(spark, sf, "documents").withColumn("host", site)
    stripped = C.strip_host_lines(docs, "text", "host", "stripped")
    return stripped.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.length("stripped")).alias("chars"))


@query(
    "compact_text",
    f"""SELECT doc_id, length({sql_squeeze('text')}) AS flat_chars,
       md5(CASE WHEN length({sql_squeeze('text')}) <= 300 THEN {sql_squeeze('text')}
           ELSE substr({sql_squeeze('text')}, 1, 300) || '...' END) AS digest FROM documents""",
)
def compact_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(T.squeeze(text)).cast("long").alias("flat_chars"),
        F.md5(F.encode(T.compact(text, 300), "UTF-8")).alias("digest"),
    )


@query(
    "json_safe",
    """SELECT doc_id, md5(replace(text, 'e', '�')) AS digest,
       CASE WHEN n_chars % 3 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS number FROM documents""",
)
def json_safe(spark, sf):
    dirty = F.replace(F.col("text"), F.lit("e"), F.lit("\x07"))
    number = F.when(F.col("n_chars") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.encode(T.json_safe_text(dirty), "UTF-8")).alias("digest"),
        T.json_safe_number(number).alias("number"),
    )


# ----------------------------------------------------------- content quality

_DENSE = f"length(regexp_replace(lower(text), '{T.WS}+', '', 'g'))"
_LONG_LINES = f"list_filter(list_transform({sql_lines('text')}, lambda x: lower(x)), lambda x: length(x) >= 20)"


@query(
    "density_metrics",
    f"""WITH m AS (SELECT doc_id, text, lower(text) AS low, {_LONG_LINES} AS ll FROM documents)
      SELECT doc_id, round(({sql_occs('text', SYN.mojibake)} + 4 * {sql_occ('text', '�')}
          + 4 * length(array_to_string(regexp_extract_all(text, '[\\x{{c0}}-\\x{{ff}}]{{2,}}'), ''))) / CAST(greatest(length(text), 1) AS DOUBLE), 6) AS mojibake,
        round(CASE WHEN len(ll) = 0 THEN 0.0 ELSE 1.0 - len(list_distinct(ll)) / CAST(len(ll) AS DOUBLE) END, 6) AS repeated,
        CAST({sql_occ('low', '](')} + {sql_occ('low', 'http://')} + {sql_occ('low', 'https://')} AS INT) AS links,
        CAST({sql_occs('low', SYN.boilerplate)} AS INT) AS boilerplate,
        ({sql_any('low', SYN.failure)} AND ({_DENSE} < 3000 OR contains(low, 'captcha') OR contains(low, 'cloudflare'))) AS failed
      FROM m""",
)
def density_metrics(spark, sf):
    text, low = F.col("text"), F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.round(C.mojibake_ratio(text, SYN), 6).alias("mojibake"),
        F.round(C.repeated_line_ratio(text), 6).alias("repeated"),
        C.link_marks(low).alias("links"),
        T.total_occurrences(low, SYN.boilerplate).alias("boilerplate"),
        C.looks_failed(text, SYN).alias("failed"),
    )


@query(
    "hard_noise",
    f"""WITH m AS (SELECT lang, text, lower(text) AS low, {_LONG_LINES} AS ll,
        ({sql_occs('text', SYN.mojibake)} + 4 * {sql_occ('text', '�')}
          + 4 * length(array_to_string(regexp_extract_all(text, '[\\x{{c0}}-\\x{{ff}}]{{2,}}'), ''))) / CAST(greatest(length(text), 1) AS DOUBLE) AS moji FROM documents),
      n AS (SELECT *, CASE WHEN len(ll) = 0 THEN 0.0 ELSE 1.0 - len(list_distinct(ll)) / CAST(len(ll) AS DOUBLE) END AS rep,
        {sql_occ('low', '](')} + {sql_occ('low', 'http://')} + {sql_occ('low', 'https://')} AS links FROM m)
      SELECT lang, coalesce(CASE WHEN moji >= 0.08 AND NOT regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'mojibake_or_wrong_encoding'
        WHEN (contains(low, 'sitemap') OR contains(text, '网站地图') OR contains(text, '站点地图')) AND links >= 10 THEN 'site_map_or_link_index'
        WHEN regexp_matches(low, '\\|\\s*0\\.[0-9]+\\s*\\|\\s*daily\\s*\\|') AND links >= 5 THEN 'site_map_or_link_index'
        WHEN {sql_any('low', SYN.aggregation)} AND (links >= 5 OR rep >= 0.35 OR length(text) < 800) THEN 'search_or_aggregation_page'
        WHEN rep >= 0.65 AND length(text) > 500 THEN 'repetitive_boilerplate' END, 'clean') AS reason, count(*) AS docs FROM n GROUP BY 1, 2""",
)
def hard_noise(spark, sf):
    reason = F.coalesce(C.hard_noise_reason(F.col("text"), F.lit(""), SYN), F.lit("clean"))
    return table(spark, sf, "documents").groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("docs"))


_READABLE = f"""list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)),
    lambda x: {sql_strip(f"regexp_replace({sql_squeeze('x')}, '^\\s*[-*|]+\\s*$', '')")}), lambda x: length(x) > 0)"""
_NAV_WORDS = f"len(list_filter(words, lambda w: w IN {sql_in(SYN.nav_words)}))"


@query(
    "boilerplate_lines",
    f"""WITH l AS (SELECT source, unnest({_READABLE}) AS x FROM documents),
      m AS (SELECT *, lower(x) AS low, {sql_occ('x', '](')} AS links, {sql_occ('x', '![')} AS images,
        trim(regexp_replace(regexp_replace(x, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), ' -*_>|:;，,。') AS around,
        array_to_string(regexp_extract_all(x, '\\[([^\\]]*)\\]\\([^)]+\\)', 1), ' ') AS labels, regexp_extract_all(lower(x), {q(K.LATIN)}) AS words FROM l),
      n AS (SELECT *, (links > 0 OR images > 0) AND ((length(around) = 0 AND length(labels) <= 80) OR (links >= 2 AND length(around) <= 30) OR (images > 0 AND length(around) <= 20)
        OR (length(around) <= 30 AND {sql_any('labels', SYN.boilerplate)})) AS link_line,
        {sql_occ('low', '](')} + {sql_occ('low', 'http://')} + {sql_occ('low', 'https://')} AS marks FROM m)
      SELECT source, count(*) AS all_lines, count(*) FILTER (WHERE length(x) <= 2 OR starts_with(low, 'url source:') OR starts_with(low, 'published time:') OR starts_with(low, 'markdown content:')
          OR starts_with(low, 'warning: target url returned error') OR link_line OR (len(words) <= 8 AND {sql_any('low', SYN.boilerplate)}) OR (len(words) <= 12 AND {_NAV_WORDS} >= 3)
          OR (len(words) <= 20 AND marks >= 3) OR (length(x) <= 40 AND {sql_any('x', SYN.boilerplate)}) OR regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]+$')) AS boilerplate,
        count(*) FILTER (WHERE link_line) AS link_lines FROM n GROUP BY source""",
)
def boilerplate_lines(spark, sf):
    ls = table(spark, sf, "documents").select("source", F.explode(C.readable_lines(F.col("text"))).alias("x"))
    return ls.groupBy("source").agg(
        F.count("*").alias("all_lines"),
        F.count_if(C.boilerplate_line(F.col("x"), SYN)).alias("boilerplate"),
        F.count_if(C.link_boilerplate(F.col("x"), SYN)).alias("link_lines"),
    )


@query(
    "trim_to_context",
    f"""WITH d AS (SELECT doc_id, text, trim(substr(text, 400, 100)) AS snippet FROM documents),
      p AS (SELECT *, list_filter(list_transform([120, 80, 50, 35, 25, 18, 12], lambda n: {sql_strip('substr(snippet, 1, n)')})
              || list_filter(list_transform(regexp_split_to_array(snippet, '[。.!！?？\\n]'), lambda x: {sql_strip('x')}), lambda x: length(x) >= 20),
            lambda x: length(x) >= CASE WHEN regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 8 ELSE 20 END) AS pieces FROM d),
      a AS (SELECT *, list_min(list_filter(list_transform(pieces, lambda x: strpos(text, x) - 1), lambda i: i > 250)) AS pos FROM p)
      SELECT doc_id, md5(CASE WHEN length(snippet) < 20 OR pos IS NULL THEN text ELSE {sql_strip('substr(text, pos + 1)')} END) AS digest FROM a""",
)
def trim_to_context(spark, sf):
    snippet = F.trim(F.substring("text", 400, 100))
    trimmed = C.trim_to_context(F.col("text"), F.col("snippet"), F.lit(""))
    docs = table(spark, sf, "documents").withColumn("snippet", snippet)
    return docs.select("doc_id", F.md5(F.encode(trimmed, "UTF-8")).alias("digest"))


def _sql_one(condition: str, value: int) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


_DROPS = " OR ".join(f"regexp_matches(x, {q(p)})" for p in DEFAULT.compress_drops)
_WORTH = " + ".join([
    _sql_one(" OR ".join(f"regexp_matches(x, {q(p)})" for p in DEFAULT.causal_patterns), 3),
    _sql_one("regexp_matches(x, '(?i)(^|[^\\p{L}\\p{N}_])(TL431|LM358|LM324|UC384|SG3525|IR2110|PC817|EL817|NE555|AO340|IRF[0-9]+|STM32|ESP32)($|[^\\p{L}\\p{N}_])')", 2),
    _sql_one("regexp_matches(x, '(?i)[RCLDQUV][0-9]+[A-Z0-9]*')", 2),
    _sql_one("regexp_matches(x, '(?i)[0-9]+(?:\\.[0-9]+)?(?:ohm|kohm|Ω|μF|uf|nf|pF|pf|Hz|khz|MHz|V|mA|A|W)')", 1),
    _sql_one("length(x) >= 60", 1),
])


@query(
    "budgeted_prefix",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: length(x) > 0 AND NOT ({_DROPS})
        AND NOT (length(x) < 15 AND NOT regexp_matches(x, '[A-Za-z]{{3,}}|[0-9]+(?:\\.[0-9]+)?[A-Za-z]'))) AS ls FROM documents),
      r AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS pos FROM l),
      s AS (SELECT doc_id, x, row_number() OVER w AS n, sum(length(x) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, {_WORTH} AS worth FROM r) WINDOW w AS (PARTITION BY doc_id ORDER BY worth DESC, pos)),
      b AS (SELECT doc_id, string_agg(x, ' ' ORDER BY n) FILTER (WHERE used <= 600) AS best FROM s GROUP BY 1),
      o AS (SELECT doc_id, CASE WHEN length(array_to_string(ls, ' ')) <= 600 THEN array_to_string(ls, ' ') ELSE coalesce(best, '') END AS short FROM l LEFT JOIN b USING (doc_id))
      SELECT doc_id, CAST(length(short) AS INT) AS chars, md5(short) AS digest FROM o""",
)
def budgeted_prefix(spark, sf):
    out = C.compress(table(spark, sf, "documents"), "text", "short", DEFAULT, 600)
    return out.select("doc_id", F.length("short").alias("chars"), F.md5(F.encode("short", "UTF-8")).alias("digest"))


# ------------------------------------------------------------------ tokens


def _tok(pattern: str, col: str = "text") -> str:
    return f"regexp_extract_all({col}, {q(pattern)})"


@query(
    "tokenizer_counts",
    f"""SELECT doc_id, len(list_transform({_tok(K.WORD)}, lambda x: lower(x))) AS words,
        len(list_distinct(list_filter(list_transform({_tok(K.EVIDENCE_TERM)}, lambda x: {sql_strip('x')}),
            lambda x: length(x) > 0 AND x NOT IN {sql_in(K.EVIDENCE_STOP)}))) AS evidence_terms,
        len(list_distinct(list_filter(list_transform({_tok(K.SEARCH_TERM)}, lambda x: lower(x)),
            lambda x: length(x) >= 2 AND x NOT IN {sql_in(DEFAULT.search_stop)}))) AS search_terms,
        len({_tok(K.LATIN, 'lower(text)')}) AS content_tokens, len({_tok(K.READ_TOKEN, 'lower(text)')}) AS read_tokens,
        greatest(length(text) - 1, 0) AS bigrams FROM documents""",
)
def tokenizer_counts(spark, sf):
    text = F.col("text")
    size = lambda c, n: F.size(c).cast("long").alias(n)
    return table(spark, sf, "documents").select(
        "doc_id",
        size(K.words(text), "words"),
        size(K.evidence_terms(text), "evidence_terms"),
        size(K.search_terms(text), "search_terms"),
        size(K.content_tokens(text), "content_tokens"),
        size(K.read_tokens(text), "read_tokens"),
        K.bigram_count(text).cast("long").alias("bigrams"),
    )


# --------------------------------------------------------------------- html

_STRIP_TAGS = r"(?is)<(script|style|noscript|nav|footer|header|aside|form|iframe)\b.*?</(script|style|noscript|nav|footer|header|aside|form|iframe)\s*>"


@query(
    "html_strip_text",
    f"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
          {q(H.DROPPED)}, ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g') AS body FROM pages),
      e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(body, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS body FROM t),
      l AS (SELECT page_id, array_to_string({sql_lines('body')}, chr(10)) AS body FROM e)
      SELECT page_id, length(body) AS chars, md5(body) AS digest FROM l""",
)
def html_strip_text(spark, sf):
    body = H.strip_text(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", F.length(body).cast("long").alias("chars"), F.md5(F.encode(body, "UTF-8")).alias("digest")
    )


@query("html_main_text")
def html_main_text(spark, sf):
    body = H.main_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(body).alias("chars"), F.md5(F.encode(body, "UTF-8")).alias("digest"))


@query("extract_best")
def extract_best(spark, sf):
    best = H.extract(table(spark, sf, "pages", READ_OUT), "page_id", "html", SYN)
    return best.select(
        "page_id", "extractor", "clean_chars", F.round("quality_score", 4).alias("quality_score"), "quality_reason"
    )


# ------------------------------------------------------------------ catalogue


@query(
    "catalog_products",
    """WITH ranked AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS qty, min(l_extendedprice) AS price,
          row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY l_partkey, CAST(l_quantity AS BIGINT)),
      tiers AS (SELECT l_partkey, string_agg(CAST(qty AS VARCHAR) || '+: $' || printf('%.2f', price), ' | ' ORDER BY qty) AS price_str FROM ranked WHERE n <= 4 GROUP BY 1)
      SELECT 'C' || CAST(p_partkey AS VARCHAR) AS c_number, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS BIGINT) AS stock,
        p_size % 2 = 0 AS is_basic, coalesce(price_str, '暂无报价') AS price_str FROM part LEFT JOIN tiers ON p_partkey = l_partkey""",
)
def catalog_products(spark, sf):
    """Catalogue answers are rebuilt as JSON from parts and their order lines."""
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_quantity").cast("long").alias("qty"), F.col("l_extendedprice").alias("price")
    )
    tiers = lines.groupBy("l_partkey", "qty").agg(F.min("price").alias("price"))
    first = O.top_k(tiers, ["l_partkey"], [F.col("qty")], 4, "n")
    listed = first.groupBy("l_partkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("qty", "price"))),
            lambda t: F.struct(t["qty"].cast("string").alias("start"), F.format_string("%.2f", t["price"]).alias("price")),
        ).alias("tiers")
    )
    raw = (
        table(spark, sf, "part")
        .join(listed, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            F.to_json(
                F.struct(
                    F.concat(F.lit("https://example.org/product/C"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("url"),
                    F.col("p_name").alias("name"),
                    F.col("p_brand").alias("brand"),
                    F.col("p_type").alias("category"),
                    F.col("p_size").alias("stock"),
                    F.when(F.col("p_size") % 2 == 0, "base").otherwise("expand").alias("library"),
                    F.col("tiers").alias("prices"),
                )
            ).alias("payload")
        )
    )
    out = catalog.normalise(raw, "payload")
    return out.select("c_number", "name", "brand", "category", "stock", "is_basic", "price_str")
