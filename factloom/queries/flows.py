"""What is done around a search or an evaluation: scorers, read budgets, providers, numbers, joins with rejects."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import budget, chunking, cross, elements, numbering, predictions, reads, rewriting, trace
from ..operators import evidence as E
from ..operators import html as H
from ..operators import lexical as L
from ..operators import matching as M
from ..operators import reports as R
from ..plans import knowledge_base as kb
from ..sources import pages as pages_source
from ..sources import samples
from . import query
from .base import CHUNKS, EVAL_COLUMNS, EVALS, LOG, PAIRS, SYN, _split, chunks, evals, log, pairs, q, sql_any, sql_hits, sql_in, sql_list, sql_squeeze, sql_strip, table
from .building import _CHUNK_SQL
from .retrieval import _EVID, BM25, _bm25, _evidence

# ------------------------------------------------------------------ scorers


def word_cosine(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic scorer in place of a model; it refuses texts with an address."""
    out = []
    for asked, text in pairs:
        if "@" in text:
            raise ValueError("address in text")
        a, b = set(asked.lower().split(" ")), set(text.lower().split(" "))
        out.append(len(a & b) / math.sqrt(len(a) * len(b)))
    return out


@query(
    "cross_rerank",
    f"""WITH {BM25}, p AS (SELECT c.item_id, c.chunk_id, c.rank, CASE WHEN contains(d.text, '@') THEN 'ValueError: address in text' END AS reason,
        list_distinct(string_split(lower(b.text), ' ')) AS asked, list_distinct(string_split(lower(d.text), ' ')) AS held
        FROM cand c JOIN chunks d USING (chunk_id) JOIN benchmark b USING (item_id) WHERE c.rank <= 10),
      s AS (SELECT *, CASE WHEN reason IS NULL THEN len(list_intersect(asked, held)) / sqrt(CAST(len(asked) * len(held) AS DOUBLE)) END AS score FROM p)
      SELECT item_id, chunk_id, round(score, 6) AS score, reason,
        CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST, rank) AS INT) AS place FROM s
      QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST, rank) <= 4""",
)
def cross_rerank(spark, sf):
    """The ten best chunks of every question, ordered anew by a scorer of pairs."""
    asked = table(spark, sf, "benchmark").withColumnRenamed("text", "question")
    pairs = _bm25(spark, sf, 10).join(chunks(spark, sf).select("chunk_id", "text"), "chunk_id").join(asked, "item_id")
    best = cross.cross_rerank(pairs, word_cosine, ["item_id"], "question", "text", "rank", 4)
    return best.select("item_id", "chunk_id", F.round("cross_score", 6).alias("score"), F.col("cross_error").alias("reason"), "place")


# ------------------------------------------------------------------ budgets

_READ_URL = "'https://src' || CAST(k % 5 AS STRING) || '.example.org/' || CASE WHEN step % 6 = 0 THEN 'PDF/' ELSE '' END || CAST(step AS STRING) || CASE WHEN step % 11 = 0 THEN '.pdf' ELSE '' END"


@query(
    "page_read_budget",
    f"""WITH RECURSIVE {LOG}, rows AS (SELECT user_id, step, {_READ_URL} AS url, success, step % 4 = 0 AS second,
        row_number() OVER (PARTITION BY user_id ORDER BY step) AS n FROM log),
      known AS MATERIALIZED (SELECT *, lower(url) LIKE '%.pdf' OR contains(lower(url), '/pdf/') AS unread FROM rows),
      told AS (
        SELECT user_id, n, step, url, CAST(0 AS BIGINT) AS used, CAST('start' AS VARCHAR) AS read_outcome FROM (SELECT DISTINCT user_id, 0 AS n, 0 AS step, '' AS url FROM known)
        UNION ALL
        SELECT k.user_id, k.n, k.step, k.url, t.used + CASE WHEN t.used < 6 AND NOT k.unread AND (k.success OR k.second) THEN 1 ELSE 0 END,
          CASE WHEN t.used >= 6 THEN 'over_budget' WHEN k.unread THEN 'skipped' WHEN k.success THEN 'read' WHEN k.second THEN 'fallback' ELSE 'failed' END
        FROM told t JOIN known k ON k.user_id = t.user_id AND k.n = t.n + 1)
      SELECT user_id, step, url, read_outcome FROM told WHERE n > 0""",
)
def page_read_budget(spark, sf):
    """Each user's events as one long list of results; six pages may be read."""
    rows = log(spark, sf).withColumn("url", F.expr(_READ_URL))
    told = budget.page_reads(rows, ["user_id"], ["step"], F.to_date("ts"), "url", F.col("success"), F.col("step") % 4 == 0, 6)
    return told.select("user_id", "step", "url", "read_outcome")


PROVIDERS = ("alpha", "beta", "gamma")
_CALLS = """SELECT o_orderkey AS question, p.name AS provider,
  CASE WHEN (o_orderkey + p.n) % 7 = 0 THEN 'connection refused' END AS error, CAST((o_orderkey * 31 + p.n * 17) % 40 AS DOUBLE) AS elapsed
  FROM orders CROSS JOIN (SELECT unnest(['Alpha', 'beta ', 'gamma', 'delta']) AS name, unnest([1, 2, 3, 4]) AS n) p"""
_ROWS = """SELECT l_orderkey AS question, l_linenumber AS line, CASE l_suppkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS provider
  FROM lineitem WHERE l_linenumber <= 3"""


def _provider_calls(spark, sf):
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i + 1).alias("n")) for i, name in enumerate(("Alpha", "beta ", "gamma", "delta"))])
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question"), F.explode(names).alias("p"))
    return asked.select(
        "question",
        F.col("p.name").alias("provider"),
        F.when((F.col("question") + F.col("p.n")) % 7 == 0, "connection refused").alias("error"),
        ((F.col("question") * 31 + F.col("p.n") * 17) % 40).cast("double").alias("elapsed"),
    )


def _provider_rows(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linenumber <= 3")
    supplier = F.col("l_suppkey") % 4
    name = F.when(supplier == 0, "alpha").when(supplier == 1, "beta").when(supplier == 2, "gamma").otherwise("delta")
    return lines.select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("line"), name.alias("provider"))


_PROVIDED = f"""calls AS ({_CALLS}), came AS ({_ROWS}),
  n AS (SELECT question, provider, count(*) AS results FROM came GROUP BY 1, 2),
  known AS (SELECT coalesce(c.question, n.question) AS question, coalesce(lower(trim(c.provider)), n.provider) AS provider, error, coalesce(elapsed > 35, false) AS late,
    coalesce(results, 0) AS results FROM calls c FULL OUTER JOIN n ON c.question = n.question AND lower(trim(c.provider)) = n.provider),
  ranked AS (SELECT *, list_position({list(PROVIDERS)}, provider) AS place FROM known),
  win AS (SELECT question, min(place) AS best FROM ranked WHERE place > 0 AND error IS NULL AND NOT late AND results > 0 GROUP BY 1),
  told AS (SELECT r.*, CASE WHEN coalesce(place, 0) = 0 THEN 'unlisted' WHEN place = best THEN 'won' WHEN place > best THEN 'not_reached'
    WHEN error IS NOT NULL THEN 'failed' WHEN late THEN 'late' ELSE 'empty' END AS outcome FROM ranked r LEFT JOIN win USING (question))"""


@query(
    "provider_outcomes",
    f"""WITH {_PROVIDED} SELECT question, provider, results, outcome, CASE outcome WHEN 'failed' THEN provider || ': ' || error
        WHEN 'late' THEN provider || ': timed out' WHEN 'empty' THEN provider || ': no results' END AS reason FROM told""",
)
def provider_outcomes(spark, sf):
    return budget.provider_outcomes(_provider_calls(spark, sf), _provider_rows(spark, sf), "question", PROVIDERS, elapsed="elapsed", timeout=35)


@query("first_provider", f"WITH {_PROVIDED} SELECT c.question, c.line, c.provider FROM came c JOIN told t USING (question, provider) WHERE outcome = 'won'")
def first_provider(spark, sf):
    """The rows of the first provider that answered: each order's first lines are dealt to four providers, of which three are listed."""
    return budget.first_provider(_provider_calls(spark, sf), _provider_rows(spark, sf), "question", PROVIDERS, elapsed="elapsed", timeout=35)


# ------------------------------------------------------------------ numbers


@query("chunk_numbers", f"SELECT doc_id, chunk_index, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS chunk_id FROM ({_CHUNK_SQL}) AS c")
def chunk_numbers(spark, sf):
    """Dense ids of all chunks of all documents, in order."""
    found = chunking.overlap_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index")
    return numbering.numbered(found, ["doc_id", "chunk_index"], "chunk_id")


# -------------------------------------------------------------- predictions

_PREDICTED = """CASE WHEN o_orderkey % 29 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN 'X' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) || ' ' END"""


def _joined(spark, sf) -> predictions.Joined:
    asked = table(spark, sf, "orders").select(F.expr(_PREDICTED).alias("sample_id"), F.col("o_orderkey").alias("position"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_name").alias("question"))
    done = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"))
    return predictions.join_predictions(asked, known, done=done)


_JOINED = f"""asked AS (SELECT nullif(trim({_PREDICTED}), '') AS sample_id, o_orderkey AS position FROM orders),
  known AS (SELECT CAST(c_custkey AS STRING) AS sample_id, c_name AS question FROM customer),
  rows AS (SELECT coalesce(a.sample_id, k.sample_id) AS sample_id, a.position, k.question,
    CASE WHEN a.position IS NULL THEN 'missing' WHEN d.s_suppkey IS NOT NULL THEN 'resumed' WHEN k.sample_id IS NULL THEN 'skipped'
      WHEN a.position > min(a.position) OVER (PARTITION BY a.sample_id) THEN 'repeated' ELSE 'pending' END AS outcome
    FROM asked a FULL OUTER JOIN known k ON a.sample_id = k.sample_id LEFT JOIN supplier d ON CAST(d.s_suppkey AS STRING) = a.sample_id)"""


@query("prediction_join", f"WITH {_JOINED} SELECT sample_id, position, question, outcome FROM rows")
def prediction_join(spark, sf):
    """Orders as predictions for customers; some have no customer, some no key, and suppliers' keys have results."""
    return _joined(spark, sf).rows.select("sample_id", "position", "question", "outcome")


# ------------------------------------------------------------- page elements

_PARTS = ("article", "h1", "p", ".ad", "[class*='d']", "li", "ul")
_HIDDEN = ("footer", "script", "style", "head")
_TOKENS = (
    r"(?is)<!--.*?(?:-->|\z)|<!.*?(?:>|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|</?[a-z][a-z0-9:-]*[^>]*>|[^<]+|<"
)
_UNESCAPED = "tok"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, {q(_entity)}, {q(_char)})"
_CANDIDATES = f"""raw AS (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {q(_TOKENS)}) AS t FROM pages)),
  typed AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS tag,
    CASE WHEN starts_with(tok, '<!') THEN 'skip' WHEN regexp_matches(tok, '(?i)^<(script|style)\\b') THEN 'leaf' WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'close'
      WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open' WHEN {sql_strip(_UNESCAPED)} = '' THEN 'skip' ELSE 'text' END AS kind FROM raw),
  marks AS MATERIALIZED (SELECT page_id, tok, tag, CASE WHEN kind = 'open' AND (tag IN {sql_in(sorted(H.VOID))} OR ends_with(tok, '/>')) THEN 'leaf' ELSE kind END AS kind,
    row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, ' ' || regexp_extract(tok, '(?i)\\bclass\\s*=\\s*"([^"]*)"', 1) || ' ' AS cls FROM typed WHERE kind <> 'skip'),
  walk AS (
    SELECT page_id, CAST(0 AS BIGINT) AS n, '' AS kind, '' AS tok, CAST([] AS STRUCT(tag VARCHAR, cls VARCHAR, n BIGINT)[]) AS held FROM (SELECT DISTINCT page_id FROM marks)
    UNION ALL
    SELECT m.page_id, m.n, m.kind, m.tok, CASE WHEN m.kind = 'open' THEN list_append(w.held, {{'tag': m.tag, 'cls': m.cls, 'n': m.n}})
      WHEN m.kind = 'close' AND list_contains(list_transform(w.held, lambda x: x.tag), m.tag)
        THEN w.held[1:len(w.held) - list_position(list_reverse(list_transform(w.held, lambda x: x.tag)), m.tag)]
      ELSE w.held END
    FROM walk w JOIN marks m ON m.page_id = w.page_id AND m.n = w.n + 1),
  texts AS (SELECT page_id, n, {sql_strip(_UNESCAPED)} AS body, held, len(list_filter(held, lambda x: x.tag = 'a')) > 0 AS linked FROM walk
    WHERE kind = 'text' AND len(list_filter(held, lambda x: x.tag IN {sql_in(_HIDDEN)})) = 0),
  inside AS (SELECT page_id, n, body, linked, unnest(held) AS e FROM texts),
  hits AS (SELECT page_id, n, body, linked, e.n AS node, unnest(list_filter([CASE WHEN e.tag = 'article' THEN 0 END, CASE WHEN e.tag = 'h1' THEN 1 END, CASE WHEN e.tag = 'p' THEN 2 END,
    CASE WHEN contains(e.cls, ' ad ') THEN 3 END, CASE WHEN contains(e.cls, 'd') THEN 4 END, CASE WHEN e.tag = 'li' THEN 5 END, CASE WHEN e.tag = 'ul' THEN 6 END], lambda x: x IS NOT NULL)) AS place FROM inside),
  every AS (SELECT page_id, place, 'candidate:' || {sql_list(_PARTS)}[place + 1] AS candidate, count(DISTINCT node) AS nodes, sum(length(body)) AS chars,
      sum(CASE WHEN linked THEN length(body) ELSE 0 END) AS link_chars, string_agg(body, chr(10) ORDER BY node, n) AS content FROM hits GROUP BY 1, 2
    UNION ALL SELECT page_id, {len(_PARTS)}, 'full_cleaned_html', 1, sum(length(body)), sum(CASE WHEN linked THEN length(body) ELSE 0 END), string_agg(body, chr(10) ORDER BY n) FROM texts GROUP BY 1),
  found AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY page_id, content ORDER BY place) = 1)"""


def _candidates(spark, sf):
    tree = elements.element_tree(table(spark, sf, "pages"), "page_id", "html")
    return elements.candidates(tree, "page_id", _PARTS, _HIDDEN)


@query(
    "selector_candidates",
    f"""WITH RECURSIVE {_CANDIDATES} SELECT page_id, CAST(place AS INT) AS place, candidate, CAST(nodes AS BIGINT) AS nodes, CAST(chars AS BIGINT) AS chars,
        CAST(link_chars AS BIGINT) AS link_chars, md5(content) AS digest FROM found""",
)
def selector_candidates(spark, sf):
    """What each selector cuts out of each page, and the page without what is never part of its text."""
    found = _candidates(spark, sf)
    return found.select("page_id", "place", "candidate", "nodes", "chars", "link_chars", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(
    "selector_choice",
    f"""WITH RECURSIVE {_CANDIDATES}, s AS (SELECT *, round((chars - link_chars) / CAST(greatest(chars, 1) AS DOUBLE), 6) AS score FROM found)
      SELECT page_id, candidate, score, CAST(chars AS BIGINT) AS chars FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chars DESC, place) = 1""",
)
def selector_choice(spark, sf):
    return elements.chosen(_candidates(spark, sf), "page_id").select("page_id", "candidate", "score", "chars")


# ------------------------------------------------------------ query rewriting

_WORDS = rewriting.with_words(
    generic=("Thing", "heed", "que", "the"), stop=("of", "and", "les"), parts=("THE", "DER"), phrases=("tion", "eau", "ndst"), bring=(("THAT", ("that loop", "loop")),),
    ambiguous=("tion", "loop"), canned=((("WHAT",), ("ies",), "what was asked"), ((), ("und", "der"), "second canned query")),
)


def _sql_terms(col: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({col}, ''), {q(pattern)}), lambda x: {sql_strip('x')}), lambda x: length(x) > 0)"


def _sql_question_terms(col: str) -> str:
    """Distinct in order: an item stays where it is the first of its kind."""
    kept = f"list_filter({_sql_terms(col, rewriting.QUESTION_TERM)}, lambda x: x NOT IN {sql_in(_WORDS.stop)} AND lower(x) NOT IN {sql_in([g.lower() for g in _WORDS.generic])})"
    return _sql_distinct(kept)


def _sql_distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_ASKED = f"""asked AS (SELECT sample_id, question, CASE sample_id % 4 WHEN 0 THEN '' WHEN 1 THEN substr(reference, 1, 60) WHEN 2 THEN ' the  thing ' ELSE substr(question, 1, 90) END AS wanted,
    CASE WHEN sample_id % 8 = 0 THEN ' seed  query ' ELSE '' END AS seed FROM pairs),
  flat AS (SELECT *, {sql_squeeze('wanted')} AS f, {sql_squeeze('seed')} AS s FROM asked),
  filled AS (SELECT *, CASE WHEN f = '' THEN s ELSE f END AS q FROM flat),
  terms AS (SELECT *, {_sql_question_terms('question')} AS qt, {_sql_question_terms('q')} AS own FROM filled),
  made AS (SELECT *, CASE WHEN len(qt) > 0 THEN array_to_string(qt[1:6], ' ') || ' electronics troubleshooting' ELSE '' END AS built,
    list_filter(qt, lambda x: NOT list_contains(own, x))[1:4] AS missing, len(list_filter(own, lambda x: list_contains(qt, x))) AS shared FROM terms)"""


@query(
    "rewritten_queries",
    f"""WITH {PAIRS}, {_ASKED}, r AS (SELECT *, CASE WHEN q = '' AND built = '' THEN 'nothing_to_ask' WHEN q = '' THEN 'from_question' WHEN len(own) = 0 AND built <> '' THEN 'only_generic'
        WHEN len(own) = 0 THEN 'no_terms' WHEN shared < least(2, len(qt)) AND len(missing) > 0 THEN 'key_terms_added' WHEN f = '' THEN 'from_seed' ELSE 'kept' END AS rule FROM made)
      SELECT sample_id, rule, CASE rule WHEN 'nothing_to_ask' THEN '' WHEN 'no_terms' THEN '' WHEN 'from_question' THEN built WHEN 'only_generic' THEN built
        WHEN 'key_terms_added' THEN array_to_string(list_concat([q], list_filter(missing, lambda x: x <> q)), ' ') ELSE q END AS rewritten FROM r""",
)
def rewritten_queries(spark, sf):
    """Queries of samples repaired with the key terms of their questions: empty ones, generic ones, foreign ones and good ones."""
    base = pairs(spark, sf)
    wanted = (
        F.when(F.col("sample_id") % 4 == 0, "").when(F.col("sample_id") % 4 == 1, F.substring("reference", 1, 60)).when(F.col("sample_id") % 4 == 2, " the  thing ")
        .otherwise(F.substring("question", 1, 90))
    )
    asked = base.select("sample_id", "question", wanted.alias("wanted"), F.when(F.col("sample_id") % 8 == 0, " seed  query ").otherwise("").alias("seed"))
    rules = rewriting.web_rules(F.col("wanted"), F.col("question"), F.col("seed"), _WORDS)
    return rewriting.rewritten(asked, rules).select("sample_id", "rule", "rewritten")


_LOCAL = {"tion": ("transfer function", "function"), "eau": ("water",), "the": ("article",)}
_MORE = " || ".join(f"CASE WHEN contains(base, {q(k)}) THEN {sql_list(v)} ELSE [] END" for k, v in _LOCAL.items())


@query(
    "local_query_repair",
    f"""WITH {PAIRS}, {_ASKED}, l AS (SELECT *, CASE WHEN f <> '' THEN f WHEN s <> '' THEN s ELSE built END AS lq FROM made),
      b AS (SELECT *, trim(question || ' ' || lq) AS base FROM l), m AS (SELECT *, {_MORE} AS more FROM b), j AS (SELECT *, list_concat([lq], more) AS every FROM m)
      SELECT sample_id, CASE WHEN len(more) > 0 THEN 'expanded' WHEN f = '' AND lq <> '' THEN 'filled' ELSE 'kept' END AS rule,
        CASE WHEN len(more) > 0 THEN array_to_string(list_filter({_sql_distinct('every')}, lambda x: x <> ''), ' ') ELSE lq END AS rewritten FROM j""",
)
def local_query_repair(spark, sf):
    def expand(text):
        none = F.array().cast("array<string>")
        return F.concat(*[F.when(F.contains(text, F.lit(k)), F.array(*[F.lit(t) for t in v])).otherwise(none) for k, v in _LOCAL.items()])

    base = pairs(spark, sf)
    wanted = (
        F.when(F.col("sample_id") % 4 == 0, "").when(F.col("sample_id") % 4 == 1, F.substring("reference", 1, 60)).when(F.col("sample_id") % 4 == 2, " the  thing ")
        .otherwise(F.substring("question", 1, 90))
    )
    asked = base.select("sample_id", "question", wanted.alias("wanted"), F.when(F.col("sample_id") % 8 == 0, " seed  query ").otherwise("").alias("seed"))
    rules = rewriting.local_rules(F.col("wanted"), F.col("question"), F.col("seed"), _WORDS, expand)
    return rewriting.rewritten(asked, rules).select("sample_id", "rule", "rewritten")


_PLAN_TOKENS = f"regexp_extract_all({sql_squeeze('question')}, {q(rewriting.PLAN_TERM)})"
_TIES = f"""t AS (SELECT sample_id, question, {_PLAN_TOKENS} AS toks FROM pairs),
  u AS (SELECT *, list_transform(toks, lambda x: upper(x)) AS ups FROM t),
  k AS (SELECT *, list_filter(toks, lambda x: upper(x) IN {sql_in(_WORDS.parts)}) || list_filter(toks, lambda x: regexp_matches(upper(x), {q(rewriting.DESIGNATORS[0])})
      OR regexp_matches(upper(x), {q(rewriting.DESIGNATORS[1])})) || list_filter({sql_list(_WORDS.phrases)}, lambda x: contains(question, x))
      || CASE WHEN list_contains(ups, 'THAT') THEN ['that loop', 'loop'] ELSE [] END AS every FROM u),
  c AS (SELECT *, CASE WHEN len(every) > 0 THEN array_to_string({_sql_distinct('every')}[1:12], ' ') ELSE array_to_string(toks[1:10], ' ') END AS core FROM k),
  n AS (SELECT *, array_to_string(list_filter(string_split(core, ' '), lambda x: x <> '' AND x NOT IN {sql_in(_WORDS.ambiguous)}), ' ') AS clear FROM c),
  made AS (SELECT sample_id, list_filter([concat_ws(' ', CASE WHEN clear = '' THEN core ELSE clear END, {q(_WORDS.endings[0])}), concat_ws(' ', core, {q(_WORDS.endings[1])}),
      CASE WHEN list_contains(ups, 'WHAT') OR contains(question, 'ies') THEN 'what was asked' END, CASE WHEN contains(question, 'und') OR contains(question, 'der') THEN 'second canned query' END,
      concat_ws(' ', core, {q(_WORDS.last)})], lambda x: x IS NOT NULL) AS qs FROM n)"""


@query("planner_queries", f"WITH {PAIRS}, {_TIES}, d AS (SELECT sample_id, {_sql_distinct('qs')}[1:3] AS qs FROM made) SELECT sample_id, unnest(qs) AS query, CAST(generate_subscripts(qs, 1) AS INT) AS place FROM d")
def planner_queries(spark, sf):
    """The three first queries planned for every question."""
    planned = pairs(spark, sf).select("sample_id", rewriting.planned_queries(F.col("question"), _WORDS).alias("qs"))
    return planned.select("sample_id", F.posexplode("qs").alias("p", "query")).select("sample_id", "query", (F.col("p") + 1).alias("place"))


@query(
    "answer_hints",
    f"""WITH {PAIRS}, k AS (SELECT sample_id, list_filter({_sql_terms('question', rewriting.HINT_TERM)}, lambda x: x NOT IN {sql_in(rewriting.EVIDENCE_STOP)}) AS every FROM pairs)
      SELECT sample_id, array_to_string({_sql_distinct('every')}[1:12], '|') AS hints FROM k""",
)
def answer_hints(spark, sf):
    return pairs(spark, sf).select("sample_id", F.array_join(rewriting.answer_hints(F.col("question")), "|").alias("hints"))


# ------------------------------------------------------------ ordered stop

_QUALITY_RULES = [
    ("src1.example.org", ["/en", "/de"], ["/de"], []), ("src2.example.org", ["/"], [], ["the", "les"]), ("src3.example.org", ["/nowhere"], [], []),
]
_HEADS = f"""{CHUNKS}, rules(host, allow, deny, titles) AS (VALUES {", ".join(
    f"({q(h)}, {sql_list(a)}, {sql_list(d) if d else 'CAST([] AS VARCHAR[])'}, {sql_list(t) if t else 'CAST([] AS VARCHAR[])'})" for h, a, d, t in _QUALITY_RULES)}),
  h AS (SELECT chunk_id AS page_id, title, url, split_part(url, '/', 3) AS host, '/' || split_part(url, '/', 4) AS path FROM chunks),
  heads AS (SELECT page_id, {sql_hits("lower(title || chr(10) || url)", [m.lower() for m in SYN.quick_check])} AS quick,
    CASE WHEN r.host IS NOT NULL AND NOT (len(list_filter(r.allow, lambda x: contains(path, x))) > 0 AND len(list_filter(r.deny, lambda x: contains(path, x))) = 0
        AND len(list_filter(r.titles, lambda x: contains(lower(title), x))) = 0) THEN 'host_rules'
      WHEN {sql_any('lower(url)', SYN.low_value_sources)} THEN 'low_value_source'
      WHEN {sql_hits("lower(title || chr(10) || url)", [m.lower() for m in SYN.quick_check])} = 0 THEN 'no_terms' END AS reject_reason
    FROM h LEFT JOIN rules r ON h.host = r.host)"""


def _quality_heads(spark, sf):
    found = chunks(spark, sf).withColumnRenamed("chunk_id", "page_id")
    return kb.quality_headers(found, "page_id", SYN, pages_source.host_rules(spark, _QUALITY_RULES))


@query("quality_headers", f"WITH {_HEADS} SELECT page_id, CAST(quick AS INT) AS quick, reject_reason FROM heads")
def quality_headers(spark, sf):
    """The header phase of the high-quality builder: why a page is not looked at, or its score."""
    return _quality_heads(spark, sf).select("page_id", "quick", "reject_reason")


@query(
    "ordered_stop",
    f"""WITH {_HEADS}, k AS (SELECT h.page_id, h.quick FROM heads h JOIN chunks c ON h.page_id = c.chunk_id WHERE reject_reason IS NULL AND length(c.text) >= 300)
      SELECT page_id, row_number() OVER (ORDER BY quick DESC, page_id) - 1 AS place, row_number() OVER (ORDER BY quick DESC, page_id) <= 150 AS kept FROM k""",
)
def ordered_stop(spark, sf):
    """Pages that pass a test of their text, numbered in order of the header score; the builder stops after 150 of them, whatever it looked at before."""
    long = table(spark, sf, "documents").where(F.length("text") >= 300).select(F.col("doc_id").alias("page_id"))
    heads = _quality_heads(spark, sf).where("reject_reason IS NULL").withColumn("rank", F.negative("quick"))
    placed = kb.first_kept(heads.join(long, "page_id").select("page_id", "rank"), ["rank", "page_id"], None)
    return placed.select("page_id", "place", (F.col("place") < 150).alias("kept"))


# --------------------------------------------------------------- summaries

_ENTITY_COLUMNS = """(supp % 5) / 4.0 AS entity_precision, CASE WHEN line = 2 THEN NULL ELSE (part % 7) / 6.0 END AS entity_recall, unsupported / 7.0 AS unsupported_rate"""
_F_BETA = "CASE WHEN entity_precision + coalesce(entity_recall, 0) > 0 THEN 5.0 * entity_precision * coalesce(entity_recall, 0) / (4.0 * entity_precision + coalesce(entity_recall, 0)) ELSE 0.0 END"
_TEN = {
    "final_score": "final_score", "semantic": "semantic_similarity", "claim": "claim_rouge_l", "entity": "technical_entity_match",
    "entity_precision": "technical_entity_precision", "entity_recall": "technical_entity_recall", "entity_f_beta": "technical_entity_f_beta",
    "unsupported_rate": "unsupported_entity_rate",
}


@query(
    "summary_averages",
    f"""WITH e AS (SELECT {EVAL_COLUMNS}, l_suppkey AS supp, l_partkey AS part, l_linenumber AS line FROM lineitem), x AS (SELECT *, {_ENTITY_COLUMNS} FROM e),
      y AS (SELECT *, {_F_BETA} AS entity_f_beta FROM x)
      SELECT run, count(*) AS total, {", ".join(f"round(avg(coalesce({c}, 0.0)), 4) AS avg_{n}" for c, n in _TEN.items())},
        round(coalesce(avg(coverage), 0.0), 4) AS avg_scoring_point_coverage, round(coalesce(avg(required_coverage), 0.0), 4) AS avg_required_point_coverage FROM y GROUP BY run""",
)
def summary_averages(spark, sf):
    """All ten averages of a run, with F-beta."""
    lines = table(spark, sf, "lineitem").selectExpr(*_split(EVAL_COLUMNS), "l_suppkey AS supp", "l_partkey AS part", "l_linenumber AS line")
    rows = lines.selectExpr("*", "CAST((supp % 5) / 4.0 AS DOUBLE) AS entity_precision", "CASE WHEN line = 2 THEN NULL ELSE CAST((part % 7) / 6D AS DOUBLE) END AS entity_recall",
                            "CAST(unsupported / 7D AS DOUBLE) AS unsupported_rate")
    rows = rows.withColumn("entity_f_beta", M.f_beta(F.col("entity_precision"), F.coalesce("entity_recall", F.lit(0.0)), 2.0))
    summary = R.summarise(rows, "run")
    return summary.select("run", "total", *[f"avg_{n}" for n in _TEN.values()], "avg_scoring_point_coverage", "avg_required_point_coverage")


@query(
    "retrieval_usage",
    f"""WITH {LOG}, p AS (SELECT sample_id, bool_or(tool_name = 'local_retrieve' AND k % 3 <> 0) AS chosen, bool_or(k % 11 = 0) OR (bool_or(k % 4 = 0) AND bool_or(k % 7 = 1)) AS shown FROM log GROUP BY 1),
      c AS (SELECT step, CASE WHEN k % 5 = 1 THEN '/kb/' || CAST(k AS VARCHAR) || '/db' WHEN k % 5 = 2 THEN '/kb/' || CAST(k AS VARCHAR) END AS path,
        CASE WHEN k % 6 = 1 THEN true WHEN k % 6 = 2 THEN false END AS known FROM log WHERE tool_name = 'local_retrieve')
      SELECT (SELECT count(*) FILTER (WHERE chosen) FROM p) AS local_retrieve_selected_samples, (SELECT round(avg(CAST(shown AS DOUBLE)), 4) FROM p) AS kb_evidence_used_rate,
        (SELECT count(*) FROM c) AS local_retrieve_calls, (SELECT arg_max(path, step) FROM c WHERE path IS NOT NULL) AS index_path,
        (SELECT arg_max(known, step) FROM c WHERE known IS NOT NULL) AS index_exists""",
)
def retrieval_usage(spark, sf):
    """Who chose the knowledge base, whose answer shows it, and which index was used last."""
    rows = log(spark, sf)
    k = F.col("k")
    per_sample = rows.groupBy("sample_id").agg(
        F.collect_set(F.when((F.col("tool_name") == "local_retrieve") & (k % 3 != 0), F.col("tool_name"))).alias("selected"),
        F.concat_ws(" ", F.when(F.bool_or(k % 11 == 0), "local_kb_chunk 4"), F.when(F.bool_or(k % 4 == 0), "本地"), F.when(F.bool_or(k % 7 == 1), "知识库")).alias("answer"),
    )
    text = k.cast("string")
    status = F.concat_ws(
        ", ", F.when(k % 5 == 1, F.concat(F.lit('"db_path": "/kb/'), text, F.lit('/db"'))), F.when(k % 6 == 1, '"exists": true').when(k % 6 == 2, '"exists": false').when(k % 6 == 3, '"exists": "maybe"')
    )
    folder = F.when((k % 5 == 1) | (k % 5 == 2), F.concat(F.lit('"index_dir": "/kb/'), text, F.lit('", '))).otherwise("")
    outputs = F.concat(F.lit('{"metadata": {'), folder, F.lit('"index_status": {'), status, F.lit("}}}"))
    return trace.retrieval_usage(per_sample, rows.withColumn("outputs", outputs).withColumn("action", F.lit("run")))


@query(
    "missed_points",
    f"""WITH {EVALS}, f AS (SELECT run, position, ['point ' || CAST(position % 37 AS VARCHAR), 'point ' || CAST(position % 11 AS VARCHAR), 'point ' || CAST(position % 5 AS VARCHAR)] AS missed
        FROM evals WHERE coalesce(final_score, 0.0) < {R.FAILED_BELOW}),
      u AS (SELECT run, position, unnest(missed[1:2]) AS value, generate_subscripts(missed[1:2], 1) AS i FROM f),
      c AS (SELECT run, value, count(*) AS n, min(position * 10 + i) AS pos FROM u GROUP BY 1, 2)
      SELECT run, value, n, CAST(row_number() OVER (PARTITION BY run ORDER BY n DESC, pos) AS INT) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC, pos) <= 5""",
)
def missed_points(spark, sf):
    """What failed samples missed most: the first two points of each row count."""
    point = lambda n: F.concat(F.lit("point "), (F.col("position") % n).cast("string"))
    rows = evals(spark, sf).withColumn("missed", F.array(point(37), point(11), point(5)))
    return R.missed_points(rows, "missed", "position", "run", 5, 2).select("run", "value", "n", "rank")


# ----------------------------------------------------------------- datasets


@query(
    "validation_ids",
    f"""WITH {PAIRS}, s AS (SELECT sample_id % 90 AS id, CASE WHEN sample_id % 7 = 0 THEN '' ELSE question END AS question, CASE WHEN sample_id % 11 = 0 THEN '' ELSE reference END AS reference FROM pairs),
      g AS (SELECT id, count(*) > 1 AS dup, bool_or(length(question) = 0) AS noq, bool_or(length(reference) = 0) AS nor FROM s GROUP BY 1)
      SELECT 'duplicate' AS problem, id FROM g WHERE dup UNION ALL SELECT 'missing_question', id FROM g WHERE noq UNION ALL SELECT 'missing_reference', id FROM g WHERE nor""",
)
def validation_ids(spark, sf):
    """Which ids are repeated or lack a question or a reference."""
    blank = lambda c, n: F.when(F.col("sample_id") % n == 0, "").otherwise(F.col(c)).alias(c)
    rows = pairs(spark, sf).select((F.col("sample_id") % 90).alias("id"), blank("question", 7), blank("reference", 11))
    return samples.validation_ids(rows, "id")


@query(
    "own_id_overlap",
    f"""WITH d AS (SELECT doc_id, source, lang, list_distinct(list_transform(regexp_extract_all(text, {q(K.WORD)}), lambda x: lower(x))) AS toks FROM documents),
      b AS (SELECT item_id, 'src' || CAST(item_id % 23 AS VARCHAR) AS own, list_distinct(list_transform(regexp_extract_all(text, {q(K.WORD)}), lambda x: lower(x))) AS asked FROM benchmark),
      s AS (SELECT item_id, doc_id, len(list_intersect(asked, toks)) + CASE WHEN own = source OR own = lang THEN 8 ELSE 0 END AS overlap, len(asked) AS na, len(toks) AS nt FROM b CROSS JOIN d),
      r AS (SELECT item_id, doc_id, overlap, round(overlap / CAST(na AS DOUBLE) + overlap / sqrt(CAST(nt AS DOUBLE)), 4) AS score FROM s WHERE overlap > 0)
      SELECT item_id, doc_id, CAST(overlap AS BIGINT) AS overlap, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r
      QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 4""",
)
def own_id_overlap(spark, sf):
    """Token overlap where a document of the question's own source counts more."""
    asked = table(spark, sf, "benchmark").withColumn("own", F.concat(F.lit("src"), (F.col("item_id") % 23).cast("string")))
    docs = table(spark, sf, "documents").withColumn("pieces", F.array("source", "lang"))
    return L.overlap_search(asked, docs, "item_id", "text", "doc_id", "text", 4, ("own", "pieces"))


@query(
    "unique_evidence",
    f"""WITH {_EVID}, k AS (SELECT item_id, rank, sha256(lower({sql_strip('source')}) || chr(10) || kind || chr(10) || lower({sql_squeeze('content')})) AS key FROM ev)
      SELECT item_id, rank AS place FROM k QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY rank) = 1""",
)
def unique_evidence(spark, sf):
    """Evidence that says nothing new leaves before an answer is written."""
    return E.unique_evidence(_evidence(spark, sf), "item_id", "place").select("item_id", "place")


# -------------------------------------------------------------- page reads

_BACKENDS = ("first", "second", "third")
_ATTEMPTS = """SELECT page_id, b.backend, CASE WHEN (page_id + b.n) % 5 = 0 THEN 'timed out' END AS error,
  CASE WHEN (page_id * 3 + b.n) % 7 = 0 THEN 0 ELSE (length(html) * b.n) % 900 END AS clean_chars, ((page_id * 7 + b.n * 3) % 20) / 20.0 AS quality_score
  FROM pages CROSS JOIN (SELECT unnest(['first', 'second', 'third', 'spare']) AS backend, unnest([1, 2, 3, 4]) AS n) b"""
_CASCADE = f"""a AS ({_ATTEMPTS}), r AS (SELECT *, list_position({list(_BACKENDS)}, backend) AS place, error IS NULL AND clean_chars >= 200 AND quality_score >= 0.3 AS fine FROM a),
  w AS (SELECT page_id, min(place) AS best FROM r WHERE fine AND place > 0 GROUP BY 1),
  told AS (SELECT r.*, CASE WHEN coalesce(place, 0) = 0 THEN 'unlisted' WHEN place = best THEN 'won' WHEN place > best THEN 'not_reached' WHEN error IS NOT NULL THEN 'failed'
    WHEN clean_chars = 0 THEN 'empty' WHEN clean_chars < 200 THEN 'too_short' ELSE 'low_score' END AS outcome FROM r LEFT JOIN w USING (page_id))"""


def _cascade(spark, sf):
    names = F.array(*[F.struct(F.lit(b).alias("backend"), F.lit(i + 1).alias("n")) for i, b in enumerate((*_BACKENDS, "spare"))])
    rows = table(spark, sf, "pages").select("page_id", F.length("html").alias("size"), F.inline(names))
    page, n = F.col("page_id"), F.col("n")
    attempts = rows.select(
        "page_id", "backend", F.when((page + n) % 5 == 0, "timed out").alias("error"),
        F.when((page * 3 + n) % 7 == 0, 0).otherwise((F.col("size") * n) % 900).alias("clean_chars"), (((page * 7 + n * 3) % 20) / 20.0).alias("quality_score"),
    )
    return reads.read_cascade(attempts, "page_id", _BACKENDS, min_score=0.3, min_chars=200)


@query("page_read_cascade", f"WITH {_CASCADE} SELECT page_id, backend, outcome, CASE WHEN outcome = 'failed' THEN backend || ': ' || error WHEN outcome IN ('empty', 'too_short', 'low_score') THEN backend || ': ' || outcome END AS reason FROM told")
def page_read_cascade(spark, sf):
    """Which of several readers of every page has the first acceptable content, and what is wrong with those before it."""
    return _cascade(spark, sf).select("page_id", "backend", "outcome", "reason")


@query(
    "fetch_summary",
    f"""WITH {_CASCADE} SELECT backend, count(*) AS fetches, count(*) FILTER (WHERE outcome = 'won') AS wins, count(*) FILTER (WHERE outcome = 'failed') AS failures,
        round(avg(clean_chars), 0) AS avg_chars, round(avg(CAST(quality_score AS DOUBLE)), 4) AS avg_quality FROM told GROUP BY backend""",
)
def fetch_summary(spark, sf):
    return reads.fetch_summary(_cascade(spark, sf))


_SPECS = {
    "web_search": [("query", "string", True), ("limit", "integer", False)],
    "local_retrieve": [("query", "string", True), ("limit", "integer", False), ("strict", "boolean", False)],
    "finish_answer": [("allow_llm", "boolean", True)],
    "evidence_rank": [],
}
_ARGS = """CASE k % 9 WHEN 0 THEN '{"query": "x", "limit": 3}' WHEN 1 THEN '{"limit": "3"}' WHEN 2 THEN '{"query": 7}' WHEN 3 THEN '[1]' WHEN 4 THEN '{"query": null, "limit": true}'
  WHEN 5 THEN '{"query": "y", "limit": 2.5, "allow_llm": "no"}' WHEN 6 THEN '{"query": "z", "strict": 1, "allow_llm": false}' WHEN 7 THEN 'no json' ELSE '{"query": {"a": 1}, "allow_llm": null}' END"""
_TYPES = {"string": ("VARCHAR",), "integer": ("BIGINT", "UBIGINT", "BOOLEAN"), "boolean": ("BOOLEAN",)}


def _sql_problem() -> str:
    out = ""
    for tool, fields in _SPECS.items():
        if tool == "evidence_rank":
            out += f" WHEN tool_name = '{tool}' THEN 'tool is disabled'"
            continue
        out += f" WHEN tool_name = '{tool}' AND coalesce(kind, '') <> 'OBJECT' THEN 'arguments must be an object'"
        for key, kind, required in fields:
            seen = f"json_type(good, '$.{key}')"
            if required:
                out += f" WHEN tool_name = '{tool}' AND {seen} IS NULL THEN 'missing required argument: {key}'"
            out += f" WHEN tool_name = '{tool}' AND {seen} <> 'NULL' AND {seen} NOT IN {sql_in(_TYPES[kind])} THEN '{key} must be of type {kind}'"
        out += f" WHEN tool_name = '{tool}' THEN NULL"
    return f"CASE{out} ELSE 'unknown tool' END"


@query(
    "argument_problems",
    f"""WITH {LOG}, a AS (SELECT step, tool_name, {_ARGS} AS args FROM log), g AS (SELECT *, CASE WHEN json_valid(args) THEN args END AS good FROM a),
      t AS (SELECT *, json_type(good) AS kind FROM g) SELECT step, {_sql_problem()} AS problem FROM t""",
)
def argument_problems(spark, sf):
    """Why the arguments of a call cannot be used: shapes, types, what is missing, tools that are off or unknown."""
    rows = log(spark, sf).withColumn("args", F.expr(_ARGS))
    enabled = tuple(t for t in _SPECS if t != "evidence_rank")
    return rows.select("step", reads.argument_problem(F.col("tool_name"), F.col("args"), _SPECS, enabled).alias("problem"))
