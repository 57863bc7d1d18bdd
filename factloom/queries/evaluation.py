"""Answer evaluation: entities, claims, points, judge, final score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as N
from ..functions import tokens as K
from ..operators import judge as J
from ..operators import matching as M
from ..operators import scoring as S
from ..plans import evaluation as P
from . import query
from .base import EVALS, PAIRS, SYN, evals, pairs, q, sql_in, table

# ----------------------------------------------------------------- entities

_ALIAS_SQL = "x"
for _s, _t in N.TOKEN_ALIASES.items():
    _ALIAS_SQL = f"replace({_ALIAS_SQL}, {q(_s)}, {q(_t)})"
    if _s.upper() != _s:
        _ALIAS_SQL = f"replace({_ALIAS_SQL}, {q(_s.upper())}, {q(_t)})"
_B = "[A-Za-z0-9]"


def _normal_sql(col: str) -> str:
    return f"lower(regexp_replace({_ALIAS_SQL}, {q(N.KEPT)}, '', 'g'))".replace("replace(x,", f"replace({col},")


# RE2 has no look-around: word boundaries stand in for it, and the test
# data has no underscore next to a match, where the two would differ
def _plain(pattern: str) -> str:
    flags = pattern.split(")", 1)[0] + ")" if pattern.startswith("(?i") else ""
    body = pattern[len(flags):].replace(rf"(?<!{_B})", r"\b").replace(rf"(?!{_B})", r"\b")
    return flags.replace("u", "") + body


_SHAPES = [_plain(p) for p in (N.COMPONENT, N.MODEL, N.QUANTITY)]


def _full_sql(col: str, pattern: str) -> str:
    return f"regexp_full_match({col}, {q(_plain(pattern))})"


_LOW_SQL = f"(length(tok) <= 1 OR tok IN {sql_in(SYN.entity_stop)} OR regexp_matches(tok, {q('^[0-9]+$|(?:' + '|'.join(SYN.low_value_suffixes) + ')$')}))"
_FOLD = "replace(replace(replace({0}, 'μ', 'u'), 'Ω', 'ohm'), 'ω', 'ohm')"
_ABBR = f"""(length(tok) >= 2 AND tok NOT IN {sql_in(SYN.entity_stop)} AND (tok IN {sql_in(SYN.abbrevs)}
   OR (regexp_full_match(tok, '[a-z][a-z0-9+\\-_/]+') AND (regexp_matches(tok, '[0-9/\\-]') OR upper(tok) = raw))))"""
_KIND = f"""CASE WHEN {_full_sql('tok', N.COMPONENT)} OR {_full_sql('tok', N.MODEL)} OR {_full_sql('tok', N.QUANTITY)} THEN 'structured'
   WHEN {_ABBR.replace('upper(tok) = raw', 'upper(tok) = tok')} THEN 'domain_abbrev' ELSE 'keyphrase' END"""
_WEIGHT = f"""CASE WHEN {_full_sql('tok', N.COMPONENT)} THEN 3.5 WHEN {_full_sql('tok', N.MODEL)} THEN 3.0 WHEN {_full_sql('tok', N.QUANTITY)} THEN 2.7
   WHEN type = 'domain_abbrev' THEN 2.2 ELSE 1.0 END"""
ENTITIES = f"""{PAIRS}, texts AS (SELECT sample_id, 'reference' AS role, reference AS t FROM pairs UNION ALL SELECT sample_id, 'prediction', prediction FROM pairs
     UNION ALL SELECT sample_id, 'support', question || chr(10) || reference || chr(10) FROM pairs),
  folded AS (SELECT sample_id, role, {_FOLD.replace('{0}', 't')} AS f FROM texts),
  found AS (SELECT sample_id, role, unnest({" || ".join(f"regexp_extract_all(f, {q(p)})" for p in _SHAPES)}) AS raw, false AS word FROM folded
     UNION ALL SELECT sample_id, role, unnest(regexp_extract_all(f, {q(_plain(N.ENGLISH))})), true FROM folded),
  toks AS (SELECT sample_id, role, raw, word, {_normal_sql('raw')} AS tok FROM found),
  kept AS (SELECT DISTINCT sample_id, role, tok FROM toks WHERE NOT {_LOW_SQL} AND (NOT word OR {_ABBR})),
  kinds AS (SELECT *, {_KIND} AS type FROM kept),
  weighed AS (SELECT sample_id, role, tok AS token, type, CAST({_WEIGHT} AS DOUBLE) AS weight FROM kinds),
  known AS (SELECT DISTINCT sample_id, token FROM weighed WHERE role <> 'prediction'),
  ents AS (SELECT * FROM weighed w WHERE (role <> 'prediction' OR type <> 'keyphrase' OR weight >= 1.6 OR EXISTS (SELECT 1 FROM known k WHERE k.sample_id = w.sample_id AND k.token = w.token))
     QUALIFY row_number() OVER (PARTITION BY sample_id, role, type ORDER BY weight DESC, token) <= CASE type WHEN 'structured' THEN 40 WHEN 'domain_abbrev' THEN 24 ELSE 48 END)"""


@query("entity_rows", f"WITH {ENTITIES} SELECT sample_id, role, token, type, weight FROM ents")
def entity_rows(spark, sf):
    return M.entity_rows(pairs(spark, sf), SYN)


@query(
    "entity_counts",
    f"""WITH {ENTITIES} SELECT sample_id, role, count(*) FILTER (WHERE type = 'structured') AS structured, count(*) FILTER (WHERE type = 'domain_abbrev') AS domain_abbrev,
        count(*) FILTER (WHERE type = 'keyphrase') AS keyphrase, count(*) AS total FROM ents GROUP BY 1, 2""",
)
def entity_counts(spark, sf):
    return M.entity_counts(M.entity_rows(pairs(spark, sf), SYN))


_F = "CASE WHEN p + r = 0 THEN 0.0 ELSE (1 + {b}) * p * r / ({b} * p + r) END"


@query(
    "entity_prf",
    f"""WITH {ENTITIES}, pt AS (SELECT sample_id, token, bool_or(role = 'reference') AS r, bool_or(role = 'prediction') AS p, bool_or(role = 'support') AS s,
        max(weight) AS w, arg_max(type, weight) AS type FROM ents GROUP BY 1, 2),
      un AS (SELECT sample_id, sum(w) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY w DESC, token) AS n FROM pt
         WHERE p AND type <> 'keyphrase' AND NOT (s OR r)) WHERE n <= 12 GROUP BY 1),
      sm AS (SELECT sample_id, coalesce(sum(w) FILTER (WHERE r AND p), 0) AS hit, coalesce(sum(w) FILTER (WHERE r), 0) AS ref,
        coalesce(sum(w) FILTER (WHERE p AND (s OR r)), 0) AS backed, coalesce(sum(w) FILTER (WHERE p), 0) AS pred,
        coalesce(sum(w) FILTER (WHERE p AND type <> 'keyphrase'), 0) AS risky, count(*) FILTER (WHERE r) AS nr, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE r AND p) AS nm FROM pt GROUP BY 1),
      al AS (SELECT sample_id, coalesce(hit, 0) AS hit, coalesce(ref, 0) AS ref, coalesce(backed, 0) AS backed, coalesce(pred, 0) AS pred, coalesce(risky, 0) AS risky,
        coalesce(nr, 0) AS nr, coalesce(np, 0) AS np, coalesce(nm, 0) AS nm, coalesce(bad, 0) AS bad FROM pairs LEFT JOIN sm USING (sample_id) LEFT JOIN un USING (sample_id)),
      pr AS (SELECT *, CASE WHEN nr = 0 AND np = 0 THEN 1.0 WHEN CASE WHEN backed > 0 THEN backed ELSE pred END > 0 THEN hit / CASE WHEN backed > 0 THEN backed ELSE pred END ELSE 0.0 END AS p,
        CASE WHEN nr = 0 AND np = 0 THEN 1.0 WHEN ref > 0 THEN hit / ref ELSE 0.0 END AS r FROM al)
      SELECT sample_id, round(p, 6) AS precision, round(r, 6) AS recall, round({_F.format(b='1.0')}, 6) AS f1, round({_F.format(b='2.25')}, 6) AS score,
        round(CASE WHEN risky > 0 THEN bad / risky ELSE 0.0 END, 6) AS unsupported_entity_rate, nr AS reference_entities, np AS prediction_entities, nm AS matched_entities FROM pr""",
)
def entity_prf(spark, sf):
    data = pairs(spark, sf)
    return M.entity_match(M.entity_rows(data, SYN), data)


@query(
    "bigram_overlap",
    f"""WITH {PAIRS}, n AS (SELECT sample_id, {_normal_sql('reference')} AS r, {_normal_sql('prediction')} AS p FROM pairs),
      g AS (SELECT sample_id, list_distinct(list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) AS rg,
            list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS pg FROM n)
      SELECT sample_id, len(rg) AS grams, round(CASE WHEN len(rg) = 0 THEN 0.0 ELSE len(list_intersect(rg, pg)) / CAST(len(rg) AS DOUBLE) END, 6) AS overlap FROM g""",
)
def bigram_overlap(spark, sf):
    staged = pairs(spark, sf).select(
        "sample_id",
        F.array_distinct(K.bigrams(N.normal(F.col("reference")))).alias("rg"),
        K.bigrams(N.normal(F.col("prediction"))).alias("pg"),
    )
    share = F.when(F.size("rg") == 0, 0.0).otherwise(F.size(F.array_intersect("rg", "pg")) / F.size("rg"))
    return staged.select("sample_id", F.size("rg").cast("long").alias("grams"), F.round(share, 6).alias("overlap"))


@query("claim_rouge")
def claim_rouge(spark, sf):
    data = pairs(spark, sf)
    return M.claim_score(M.claim_rouge(data, lex=SYN), data)


@query("claim_rows")
def claim_rows(spark, sf):
    # every claim, against every claim of the prediction
    rows = M.claim_rouge(pairs(spark, sf), limit=None, lex=SYN)
    return rows.select("sample_id", "claim_no", F.length("claim").alias("chars"), F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score"))


@query("scoring_points")
def scoring_points(spark, sf):
    data = pairs(spark, sf)
    points = M.scoring_points(data, lex=SYN)
    matched = M.match_points(points, data, SYN)
    return matched.select("sample_id", "point_no", "type", "status", "weight", "evidence_score", "required")


@query("point_coverage")
def point_coverage(spark, sf):
    data = pairs(spark, sf)
    return M.point_coverage(M.match_points(M.scoring_points(data, lex=SYN), data, SYN))


# matches as the order lines give them: status by ship mode of the line
_MATCH = """m AS (SELECT 'O' || CAST(l_orderkey AS VARCHAR) AS sample_id, l_linenumber, CAST(l_quantity AS DOUBLE) / 10.0 AS weight,
   CASE l_linenumber WHEN 1 THEN 'core_conclusion' WHEN 2 THEN 'cause_mechanism' WHEN 3 THEN 'diagnostic_step' ELSE 'caveat' END AS type, l_linenumber <= 2 AS required,
   CASE l_partkey % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'partial' WHEN 2 THEN 'missed' ELSE 'contradicted' END AS status FROM lineitem)"""


@query(
    "coverage_rollup",
    f"""WITH {_MATCH}, s AS (SELECT *, CASE status WHEN 'hit' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'missed' THEN 0.0 ELSE -1.0 END AS sc FROM m)
      SELECT sample_id, count(*) AS points, round(greatest(0.0, least(1.0, sum(weight * sc) / sum(weight))), 6) AS coverage,
        round(sum(weight * greatest(sc, 0.0)) FILTER (WHERE required) / sum(weight) FILTER (WHERE required), 6) AS required_coverage,
        bool_or(type = 'core_conclusion' AND status IN ('hit', 'partial')) AS core_conclusion_hit,
        bool_or(type = 'core_conclusion' AND status = 'contradicted') AS core_contradicted FROM s GROUP BY sample_id""",
)
def coverage_rollup(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "core_conclusion").when(n == 2, "cause_mechanism").when(n == 3, "diagnostic_step").otherwise("caveat")
    k = F.col("l_partkey") % 4
    status = F.when(k == 0, "hit").when(k == 1, "partial").when(k == 2, "missed").otherwise("contradicted")
    score = F.when(k == 0, 1.0).when(k == 1, 0.5).when(k == 2, 0.0).otherwise(-1.0)
    matches = table(spark, sf, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("sample_id"),
        (F.col("l_quantity").cast("double") / 10.0).alias("weight"),
        kind.alias("type"), (n <= 2).alias("required"), status.alias("status"), score.alias("status_score"),
    )
    return M.point_coverage(matches)


@query("sequence_ratio")
def sequence_ratio(spark, sf):
    return M.similarity(pairs(spark, sf)).select("sample_id", "semantic_similarity")


@query(
    "vector_similarity",
    """SELECT a.vec_id, round(greatest(0.0, least(1.0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS semantic_similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_similarity(spark, sf):
    v = table(spark, sf, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p"))
    both = v.select("vec_id", F.col("embedding").alias("r")).join(nxt, "vec_id")
    both = both.withColumns({"reference": F.lit("x"), "prediction": F.lit("y")})
    return M.similarity(both, ("r", "p")).select("vec_id", "semantic_similarity")


# -------------------------------------------------------------------- judge

# replies built from order lines: every third is prose, some values are out of range
_REPLY = """reply AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE l_linenumber % 3 WHEN 0
   THEN 'accuracy: ' || CAST(l_quantity % 7 AS BIGINT) || ', completeness = ' || CAST(l_partkey % 6 AS BIGINT) || ' clarity: 3 usefulness: 4 factual_consistency: 0.' || CAST(l_suppkey % 10 AS BIGINT)
   ELSE '{"accuracy": ' || CAST(l_quantity % 7 AS BIGINT) || ', "completeness": ' || CAST(l_partkey % 6 AS BIGINT)
     || ', "clarity": 3, "usefulness": 4, "factual_consistency": 0.' || CAST(l_suppkey % 10 AS BIGINT) || ', "fully_correct": ' || CASE WHEN l_tax > 0.04 THEN 'true' ELSE 'false' END || '}' END AS raw FROM lineitem)"""


def _replies(spark, sf):
    line = table(spark, sf, "lineitem")
    whole = lambda c: c.cast("long").cast("string")
    a, c, s = whole(F.col("l_quantity") % 7), whole(F.col("l_partkey") % 6), whole(F.col("l_suppkey") % 10)
    prose = F.concat(
        F.lit("accuracy: "), a, F.lit(", completeness = "), c, F.lit(" clarity: 3 usefulness: 4 factual_consistency: 0."), s
    )
    strict = F.concat(
        F.lit('{"accuracy": '), a, F.lit(', "completeness": '), c, F.lit(', "clarity": 3, "usefulness": 4, "factual_consistency": 0.'), s,
        F.lit(', "fully_correct": '), F.when(F.col("l_tax") > 0.04, "true").otherwise("false"), F.lit("}"),
    )
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(F.col("l_linenumber") % 3 == 0, prose).otherwise(strict).alias("raw"),
    )


def _num(field: str, low: float, high: float) -> str:
    found = f"""TRY_CAST(coalesce(nullif(regexp_extract(raw, '"{field}"\\s*:\\s*([0-9.]+)', 1), ''), nullif(regexp_extract(raw, '{field}\\s*[:=]\\s*([0-9.]+)', 1), '')) AS DOUBLE)"""
    return f"CASE WHEN {found} BETWEEN {low} AND {high} THEN {found} ELSE CAST({low} AS DOUBLE) END"


@query(
    "judge_numbers",
    f"""WITH {_REPLY}, n AS (SELECT row_id, {", ".join(f"{_num(k, *J.FIELDS[k])} AS {k}" for k in ('accuracy', 'completeness', 'clarity', 'usefulness', 'factual_consistency'))} FROM reply)
      SELECT *, round(0.35 * (accuracy - 1) / 4 + 0.25 * (completeness - 1) / 4 + 0.10 * (usefulness - 1) / 4 + 0.10 * (clarity - 1) / 4 + 0.20 * factual_consistency, 6) AS judge_score FROM n""",
)
def judge_numbers(spark, sf):
    """Every reply is read number by number, as for replies that are no JSON."""
    names = ("accuracy", "completeness", "clarity", "usefulness", "factual_consistency")
    got = J.extract_numbers(F.col("raw"))
    rows = _replies(spark, sf).select("row_id", *[got[k].alias(k) for k in names])
    return rows.withColumn("judge_score", J.judge_score(*[F.col(k) for k in names]))


@query("judge_parse")
def judge_parse(spark, sf):
    """Replies of which every fifth is cut off inside the object."""
    cut = F.when(F.col("row_id") % 5 == 0, F.expr("substr(raw, 1, length(raw) - 18)")).otherwise(F.col("raw"))
    fenced = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    parsed = J.parse(_replies(spark, sf).withColumn("raw", fenced), "raw")
    return parsed.groupBy("parse_path", "accuracy", "completeness", "judge_fully_correct").agg(
        F.count("*").alias("replies"), F.round(F.avg("judge_score"), 6).alias("judge_score")
    )


# -------------------------------------------------------------- final score


@query(
    "weighted_final_score",
    f"""WITH {EVALS}, w AS (SELECT position, core_contradicted, (CASE WHEN judge_enabled THEN 0.45 ELSE 0.0 END + CASE WHEN coverage IS NULL THEN 0.0 ELSE 0.25 END + 0.30) AS tw,
        (CASE WHEN judge_enabled THEN 0.45 * judge_score ELSE 0.0 END + 0.25 * coalesce(coverage, 0.0) + 0.20 * semantic + 0.05 * claim + 0.05 * entity) AS s FROM evals)
      SELECT position, round(CASE WHEN core_contradicted THEN least(s / tw, 0.45) ELSE s / tw END, 6) AS final_score FROM w""",
)
def weighted_final_score(spark, sf):
    return evals(spark, sf).select("position", S.final_score().alias("final_score"))


_CORRECT = """(NOT core_contradicted AND point_errors = 0 AND (coverage IS NULL OR coverage >= 0.80) AND (required_coverage IS NULL OR (required_coverage >= 0.80 AND core_hit))
  AND CASE WHEN judge_enabled THEN accuracy >= 4 AND completeness >= 4 AND factual_consistency >= 0.85 AND judge_score >= 0.80 AND judge_errors = 0 ELSE coalesce(coverage >= 0.90, false) END)"""


@query(
    "error_reasons",
    f"""WITH {EVALS}, c AS (SELECT * EXCLUDE (fully_correct), {_CORRECT} AS fully_correct FROM evals),
      r AS (SELECT position, final_score, fully_correct, list_filter([CASE WHEN semantic < 0.55 THEN {q(S.REASONS['semantic'])} END, CASE WHEN claim < 0.20 THEN {q(S.REASONS['claim'])} END,
        CASE WHEN entity < 0.20 THEN {q(S.REASONS['entity'])} END, CASE WHEN coverage IS NULL THEN {q(S.REASONS['no_points'])} WHEN coverage < 0.5 THEN {q(S.REASONS['coverage'])} END,
        CASE WHEN core_contradicted THEN {q(S.REASONS['contradiction'])} END, CASE WHEN unsupported > 4 THEN {q(S.REASONS['unsupported'])} END,
        CASE WHEN judge_enabled AND judge_score < 0.5 THEN {q(S.REASONS['judge'])} END, CASE WHEN NOT fully_correct THEN {q(S.REASONS['not_correct'])} END], lambda x: x IS NOT NULL) AS reasons FROM c)
      SELECT array_to_string(reasons, '|') AS reasons, CASE WHEN len(reasons) >= 2 OR final_score < 0.45 THEN 'high' WHEN len(reasons) >= 1 THEN 'medium' ELSE 'low' END AS severity,
        fully_correct, count(*) AS samples FROM r GROUP BY 1, 2, 3""",
)
def error_reasons(spark, sf):
    rows = evals(spark, sf).withColumn("fully_correct", S.fully_correct()).withColumn("unsupported", F.greatest(F.col("unsupported") - 4, F.lit(0)))
    rows = rows.withColumn("reasons", S.reasons(unsupported="unsupported"))
    return rows.groupBy(
        F.array_join("reasons", "|").alias("reasons"), S.severity(F.col("reasons"), F.col("final_score")).alias("severity"), "fully_correct"
    ).agg(F.count("*").alias("samples"))


@query("evaluate_answers")
def evaluate_answers(spark, sf):
    """All metrics of all answers in one plan, without a judge."""
    out = P.evaluate(pairs(spark, sf), SYN)
    return out.select(
        "sample_id", "final_score", "fully_correct", "coverage", "required_coverage", "semantic", "claim", "entity", "severity"
    )
