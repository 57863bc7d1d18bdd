"""Scoring an answer against its reference.

All three text metrics work on a frame of pairs with the columns
``sample_id, question, reference, prediction``.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import entities as E
from ..functions import text as T
from ..functions import tokens as K
from ..lexicons import DEFAULT, Lexicons
from ..session import cut_lineage


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        (1 + b) * precision * recall / (b * precision + recall)
    )


# ------------------------------------------------------------ entity match


def entity_rows(pairs: DataFrame, lex: Lexicons = DEFAULT, idf: DataFrame | None = None, normalise: bool = True) -> DataFrame:
    """Long table (sample_id, role, token, type, weight) of the capped entities
    of reference, prediction and support (question, reference and aliases)."""
    aliases = F.coalesce("aliases", F.lit("")) if "aliases" in pairs.columns else F.lit("")
    texts = F.array(
        F.struct(F.lit("reference").alias("role"), F.col("reference").alias("t")),
        F.struct(F.lit("prediction").alias("role"), F.col("prediction").alias("t")),
        F.struct(F.lit("support").alias("role"), F.concat_ws("\n", "question", "reference", aliases).alias("t")),
    )
    long = pairs.select("sample_id", F.explode(texts).alias("_x")).select("sample_id", "_x.role", "_x.t")
    folded = long.withColumn("_f", E.fold(F.col("t"), normalise))
    tokens = folded.select("sample_id", "role", F.explode(E.candidates(F.col("_f"), lex)).alias("token"))
    typed = tokens.withColumn("type", E.kind(F.col("token"), lex))
    weight = E.base_weight(F.col("token"), F.col("type"))
    if idf is not None:
        typed = typed.join(idf.select("token", "idf"), "token", "left")
        weight = F.when(F.col("type") == "keyphrase", E.phrase_weight(F.col("idf"))).otherwise(weight)
    typed = typed.withColumn("weight", F.round(weight, 6)).select("sample_id", "role", "token", "type", "weight")
    return _prediction_phrases(typed)


def _prediction_phrases(typed: DataFrame) -> DataFrame:
    """A light keyphrase of the prediction counts only when it is supported;
    the caps apply after that."""
    known = typed.filter("role <> 'prediction'").select("sample_id", "token").distinct().withColumn("_known", F.lit(True))
    kept = (
        typed.join(known, ["sample_id", "token"], "left")
        .filter((F.col("role") != "prediction") | (F.col("type") != "keyphrase") | (F.col("weight") >= 1.6) | F.col("_known"))
        .drop("_known")
    )
    ranked = kept.withColumn(
        "_n", F.row_number().over(W.partitionBy("sample_id", "role", "type").orderBy(F.desc("weight"), "token"))
    )
    cap = F.when(F.col("type") == "structured", 40).when(F.col("type") == "domain_abbrev", 24).otherwise(48)
    return ranked.filter(F.col("_n") <= cap).drop("_n")


def entity_match(rows: DataFrame, samples: DataFrame, beta: float = 1.5) -> DataFrame:
    """Weighted precision, recall and F of the long entity table."""
    per_token = rows.groupBy("sample_id", "token").agg(
        F.bool_or(F.col("role") == "reference").alias("r"),
        F.bool_or(F.col("role") == "prediction").alias("p"),
        F.bool_or(F.col("role") == "support").alias("s"),
        F.max("weight").alias("w"),
        F.max_by("type", F.struct("weight", "type")).alias("type"),
    )
    risky = F.col("p") & (F.col("type") != "keyphrase")
    backed = F.col("s") | F.col("r")
    total = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(0.0))
    summed = per_token.groupBy("sample_id").agg(
        total(F.col("r") & F.col("p")).alias("_hit"),
        total(F.col("r")).alias("_ref"),
        total(F.col("p") & backed).alias("_backed"),
        total(F.col("p")).alias("_pred"),
        total(risky).alias("_risky"),
        F.sum(F.col("r").cast("long")).alias("reference_entities"),
        F.sum(F.col("p").cast("long")).alias("prediction_entities"),
        F.sum((F.col("r") & F.col("p")).cast("long")).alias("matched_entities"),
    )
    # the heaviest twelve unsupported entities carry the penalty
    order = W.partitionBy("sample_id").orderBy(F.desc("w"), "token")
    unsupported = (
        per_token.filter(risky & ~backed)
        .withColumn("_n", F.row_number().over(order))
        .filter("_n <= 12")
        .groupBy("sample_id")
        .agg(F.sum("w").alias("_bad"))
    )
    full = samples.select("sample_id").distinct().join(summed, "sample_id", "left").join(unsupported, "sample_id", "left")
    empty = (F.coalesce("reference_entities", F.lit(0)) == 0) & (F.coalesce("prediction_entities", F.lit(0)) == 0)
    base = F.when(F.col("_backed") > 0, F.col("_backed")).otherwise(F.col("_pred"))
    precision = F.when(empty, 1.0).otherwise(F.when(base > 0, F.col("_hit") / base).otherwise(0.0))
    recall = F.when(empty, 1.0).otherwise(F.when(F.col("_ref") > 0, F.col("_hit") / F.col("_ref")).otherwise(0.0))
    rate = F.when(F.col("_risky") > 0, F.coalesce("_bad", F.lit(0.0)) / F.col("_risky")).otherwise(0.0)
    return (
        full.withColumn("_p", precision)
        .withColumn("_r", recall)
        .select(
            "sample_id",
            F.round("_p", 6).alias("precision"),
            F.round("_r", 6).alias("recall"),
            F.round(f_beta(F.col("_p"), F.col("_r"), 1.0), 6).alias("f1"),
            F.round(f_beta(F.col("_p"), F.col("_r"), beta), 6).alias("score"),
            F.round(rate, 6).alias("unsupported_entity_rate"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reference_entities", "prediction_entities", "matched_entities")],
        )
    )


def entity_counts(rows: DataFrame) -> DataFrame:
    """Entities per sample, role and type."""
    return (
        rows.groupBy("sample_id", "role")
        .pivot("type", ["structured", "domain_abbrev", "keyphrase"])
        .agg(F.count("token"))
        .na.fill(0)
        .withColumn("total", F.col("structured") + F.col("domain_abbrev") + F.col("keyphrase"))
    )


# ----------------------------------------------------------------- claims

# fixed values: clause boundaries, relation and negation words
CLAUSE_CUT = r"[。；;！？!?\n]+|(?:^|\s)(?:[-*•]|[0-9]+[.)、]|[一二三四五六七八九十]+[、.])\s*"
SOFT_CUT = r"[，,、]|(?:并且|同时|另外|其中|因此|所以)"
CLAIM_RELATION = "因|由|致|使|若|当|则|需|应|可|会|与|对|把|将|为"
CLAIM_NEGATION = "不|未|无|非|勿|避免|禁止"
_EDGE = r" \t\r\n:：\-•*0-9.、)"


def clean_claim(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{_EDGE}]+|[{_EDGE}]+$", "")


def informative(claim: Column, lex: Lexicons = DEFAULT) -> Column:
    worded = F.rlike(claim, F.lit(f"{CLAIM_RELATION}|{CLAIM_NEGATION}"))
    return T.let(
        F.length(E.normal(claim)),
        lambda size: (size >= 4) & ((size >= 16) | ((size >= 10) & worded) | (F.size(E.candidates(claim, lex)) > 0)),
    )


def _soft_parts(claim: Column) -> Column:
    """Long claims are cut at commas; pieces under ten characters are joined to
    the piece that follows them."""
    parts = F.filter(F.split(claim, SOFT_CUT), lambda p: F.length(T.strip(p)) > 0)
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        piece = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit("，"), part))
        return F.when(
            F.length(E.normal(piece)) < 10, F.struct(acc["done"].alias("done"), piece.alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(piece)).alias("done"), F.lit("").alias("open")))

    def merged(pieces: Column) -> Column:
        return F.aggregate(
            pieces, start, step,
            lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
        )

    cut = T.let(parts, lambda p: F.when(F.size(p) <= 1, F.array(claim)).otherwise(merged(p)))
    return F.when(F.length(E.normal(claim)) <= 38, F.array(claim)).otherwise(cut)


def claims(folded: Column, limit: int | None = None, lex: Lexicons = DEFAULT) -> Column:
    """Distinct informative claims of a folded text, in order; all of them, or the first ``limit``."""
    clauses = F.filter(F.transform(F.split(folded, CLAUSE_CUT), clean_claim), lambda c: informative(c, lex))
    pieces = F.flatten(F.transform(clauses, lambda c: F.transform(_soft_parts(c), clean_claim)))
    found = F.array_distinct(F.filter(pieces, lambda c: informative(c, lex)))
    return found if limit is None else F.slice(found, 1, limit)


def claim_tokens(claim: Column, lex: Lexicons = DEFAULT) -> Column:
    words = F.transform(E.entities(claim, lex), lambda e: e["token"])
    pairs = T.let(E.normal(claim), lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(K.bigrams(t)))
    return F.array_distinct(F.concat(words, pairs))


def claim_weight(claim: Column, lex: Lexicons = DEFAULT) -> Column:
    relations = F.regexp_count(claim, F.lit(CLAIM_RELATION))

    def weigh(m: Column) -> Column:
        found, size = m["found"], m["size"]
        heavy = F.aggregate(
            found, F.lit(0.0), lambda acc, e: acc + F.when(e["weight"] >= 2.0, e["weight"]).otherwise(0.0)
        )
        raw = (
            1.0
            + F.least(heavy / 10.0, F.lit(0.55))
            + F.least(relations * 0.08, F.lit(0.25))
            + F.when(F.rlike(claim, F.lit(CLAIM_NEGATION)), 0.15).otherwise(0.0)
            + F.when(F.rlike(claim, F.lit("[0-9]")), 0.12).otherwise(0.0)
            + F.least(size / 80.0, F.lit(0.35))
        )
        thin = (F.size(found) == 0) & (size < 12)
        return F.greatest(F.lit(0.6), F.least(raw * F.when(thin, 0.75).otherwise(1.0), F.lit(2.0)))

    measured = F.struct(E.entities(claim, lex).alias("found"), F.length(E.normal(claim)).alias("size"))
    return T.let(measured, weigh)


def token_places(tokens: list) -> dict:
    """The places of each token, a bit per place."""
    where: dict = {}
    for i, token in enumerate(tokens):
        where[token] = where.get(token, 0) | (1 << i)
    return where


def lcs_lengths(ref: list, preds: list[list], places: list[dict] | None = None) -> list[float]:
    """Longest common subsequence of one token list with several others, whose ``places`` may be given.

    One integer holds a whole row of the usual table, a bit per position, so a
    token costs a few integer operations instead of a loop over the other list.
    """
    out = []
    for pred, where in zip(preds, places or map(token_places, preds)):
        full = (1 << len(pred)) - 1
        row = full
        for token in ref:
            if at := where.get(token):
                hit = row & at
                row = ((row + hit) | (row - hit)) & full
        out.append(float(len(pred) - row.bit_count()))
    return out


def best_scores(refs: list[list], preds: list[list], beta: float) -> list[float]:
    """Best score of each reference claim among all prediction claims, given the distinct tokens of each."""
    places = [token_places(pred) for pred in preds]
    b = beta * beta

    def pair_score(ref: list, pred: list, where: dict, lcs: float) -> float:
        if not ref or not pred:
            return float(not ref and not pred)
        precision, recall = lcs / len(pred), lcs / len(ref)
        f = 0.0 if precision + recall == 0 else (1 + b) * precision * recall / (b * precision + recall)
        return max(f, len(where.keys() & ref) / len(ref))

    out = []
    for ref in refs:
        rated = zip(preds, places, lcs_lengths(ref, preds, places))
        out.append(max((pair_score(ref, pred, where, lcs) for pred, where, lcs in rated), default=0.0))
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def _best_scores(ref: pa.Array, pred: pa.Array, beta: pa.Array) -> pa.Array:
    """Scores of all reference claims of a sample.  Token lists leave the Arrow batch one row at a time."""
    offsets, flat = [0], []
    for r, p, b in zip(ref, pred, beta):
        flat.extend(best_scores(r.as_py(), p.as_py(), b.as_py()))
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()))


def claim_rouge(pairs: DataFrame, beta: float = 1.5, limit: int | None = 12, lex: Lexicons = DEFAULT, normalise: bool = True) -> DataFrame:
    """One row per reference claim: ``claim_no``, ``claim``, ``weight``, ``score``.

    ``limit`` claims of the reference meet twice as many of the prediction; with None all meet all.
    """
    staged = pairs.select(
        "sample_id", E.fold(F.col("reference"), normalise).alias("_r"), E.fold(F.col("prediction"), normalise).alias("_p")
    ).withColumn("_pc", claims(F.col("_p"), limit and limit * 2, lex))
    staged = staged.select(
        "sample_id",
        F.transform(
            F.when(F.size("_pc") > 0, F.col("_pc")).otherwise(F.array("_p")), lambda c: claim_tokens(c, lex)
        ).alias("_pt"),
        F.transform(
            claims(F.col("_r"), limit, lex), lambda c: F.struct(c.alias("claim"), claim_tokens(c, lex).alias("tokens"))
        ).alias("_rc"),
    )
    # a sample goes to Python in one row: a row per claim would carry the whole prediction each time
    scored = staged.select("sample_id", "_rc", _best_scores("_rc.tokens", "_pt", F.lit(float(beta))).alias("_best"))
    found = F.zip_with("_rc", "_best", lambda c, best: F.struct(c["claim"].alias("claim"), best.alias("score")))
    rows = scored.select("sample_id", F.posexplode(found).alias("claim_no", "_c")).select("sample_id", "claim_no", "_c.*")
    return rows.select("sample_id", "claim_no", "claim", claim_weight(F.col("claim"), lex).alias("weight"), "score")


def claim_score(claim_rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Weighted mean of claim scores; 0 without claims."""
    scored = claim_rows.groupBy("sample_id").agg(
        F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("claim_rouge_l"),
        F.count("*").alias("claims"),
    )
    return samples.select("sample_id").distinct().join(scored, "sample_id", "left").na.fill(
        {"claim_rouge_l": 0.0, "claims": 0}
    )


# --------------------------------------------------------- scoring points

# fixed values: point words, statuses, types and weights
SENTENCE_CUT = r"[。；;！？!?\n]+"
RELATION = "因|由|致|使|造成|引起|导致|相关|影响|取决|反馈|补偿|耦合"
ACTION = "查|测|看|观察|确认|验证|复核|排查|更换|调整|增大|减小|并联|串联|处理|改善|补偿"
CAUTION = "不|未|无|非|避免|防止|注意|风险|可能|不确定|不能"
GENERIC = "建议|检查|可能|异常|问题|原因|需要|进一步|相关|处理"
NUMBER = r"(?iu)[0-9]+(?:\.[0-9]+)?\s*(?:v|a|w|ohm|Ω|kΩ|mΩ|ma|ua|μa|uf|μf|nf|pf|hz|khz|mhz|%|ms|us|μs|s)?"
STATUS_SCORES = {"hit": 1.0, "partial": 0.5, "missed": 0.0, "contradicted": -1.0}
TYPE_WEIGHTS = {
    "core_conclusion": 1.8, "cause_mechanism": 1.45, "component_or_value": 1.0,
    "diagnostic_step": 0.95, "fix_suggestion": 0.95, "caveat": 0.8,
}
REQUIRED_TYPES = ("core_conclusion", "cause_mechanism")
DIRECTIONS = (
    ("上管", "下管"), ("开路", "短路"), ("过大", "过小", "偏大", "偏小", "增大", "减小", "升高", "降低"),
    ("导通", "关断", "截止"), ("输入", "输出"), ("高电平", "低电平"), ("正向", "反向"),
)
POLARITY = (
    ("无需", "需要"), ("不需要", "需要"), ("不能", "能"), ("无法", "可以"), ("不是", "是"), ("并非", "是"),
)


def _has(col: Column, pattern: str) -> Column:
    return F.rlike(col, F.lit(pattern))


def _strength(found: Column) -> Column:
    return F.least(F.aggregate(found, F.lit(0.0), lambda acc, e: acc + e["weight"]) / 8.0, F.lit(1.0))


def _grams_shared(a: Column, b: Column) -> Column:
    return T.let(
        F.array_distinct(K.bigrams(a)),
        lambda own: F.when(F.size(own) == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(own, K.bigrams(b))) / F.size(own)
        ),
    )


def scoring_points(refs: DataFrame, limit: int = 12, lex: Lexicons = DEFAULT, normalise: bool = True) -> DataFrame:
    """Points a reference answer makes, one row each.

    ``refs`` has ``sample_id`` and ``reference``.  Rows: ``point_no`` (from 1),
    ``type``, ``text``, ``weight``, ``required``, ``aliases``, ``confidence``.
    """
    folded = refs.select("sample_id", E.fold(F.col("reference"), normalise).alias("_r"))
    sentences = folded.select(
        "sample_id", "_r", F.posexplode(F.transform(F.split("_r", SENTENCE_CUT), clean_claim)).alias("_s", "_sentence")
    ).filter(F.length("_sentence") > 0)
    pieces = F.when(F.length(E.normal(F.col("_sentence"))) > 60, claims(F.col("_sentence"), 4, lex)).otherwise(
        F.array("_sentence")
    )
    rows = (
        sentences.select("sample_id", "_s", F.posexplode(F.transform(pieces, clean_claim)).alias("_c", "text"))
        .withColumn("_norm", E.normal(F.col("text")))
        .withColumn("_ent", E.entities(F.col("text"), lex))
        .withColumn("_size", F.length("_norm"))
        .withColumn("_str", _strength(F.col("_ent")))
        .withColumn("_rel", _has(F.col("text"), RELATION))
        .withColumn("_act", _has(F.col("text"), ACTION))
        .withColumn("_cau", _has(F.col("text"), CAUTION))
    )
    bare = F.size("_ent") == 0
    info = F.when(F.col("_size") < 4, 0.0).otherwise(
        F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.0),
                0.45 * F.col("_str")
                + 0.35 * F.least(F.col("_size") / 36.0, F.lit(1.0))
                + F.when(F.col("_rel"), 0.25).otherwise(0.0)
                + F.when(F.col("_act"), 0.18).otherwise(0.0)
                + F.when(F.col("_cau"), 0.18).otherwise(0.0)
                - F.when(bare & _has(F.col("_norm"), f"^(?:{GENERIC})$"), 0.2).otherwise(0.0),
            ),
        )
    )
    at = F.struct("_s", "_c")
    rows = rows.withColumn("_info", info).withColumn("_at", at).filter(F.col("_size") >= 4)
    # the first usable piece is always a candidate, later ones need information
    # (a sample is one text, so its window holds the sentences of one cell)
    opening = rows.withColumn("_first", F.min("_at").over(W.partitionBy("sample_id")))
    named = opening.filter((F.col("_info") >= 0.35) | (F.col("_at") == F.col("_first")))
    cols = [c for c in named.columns if c not in ("sample_id", "_norm", "_first")]
    unique = (
        named.groupBy("sample_id", "_norm")
        .agg(F.min_by(F.struct(*cols), F.col("_at")).alias("_row"))
        .select("sample_id", "_norm", "_row.*")
    )
    numbered = unique.withColumn("point_no", F.row_number().over(W.partitionBy("sample_id").orderBy("_at"))).filter(
        F.col("point_no") <= limit
    )
    one = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    st, size, rel, act = F.col("_str"), F.col("_size"), F.col("_rel"), F.col("_act")
    scores = [
        (
            "core_conclusion",
            one(F.col("point_no") == 1, 0.38) + one((st >= 0.45) & (rel | (size >= 16)), 0.28) + one(bare & (size >= 16), 0.18),
        ),
        ("cause_mechanism", one(rel, 0.45)),
        ("component_or_value", st * 0.62 + one((size <= 16) & (st >= 0.5), 0.22)),
        ("diagnostic_step", one(act, 0.32)),
        ("fix_suggestion", one(act & ~bare, 0.32)),
        ("caveat", one(F.col("_cau"), 0.40)),
    ]
    # ties go to the type listed first
    listed = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores)])
    typed = numbered.withColumn("_best", F.array_max(listed)).withColumn("type", F.col("_best.n"))
    weight = reduce(
        lambda acc, kv: acc.when(F.col("type") == kv[0], kv[1]), TYPE_WEIGHTS.items(), F.when(F.lit(False), 0.0)
    )
    points = typed.select(
        "sample_id",
        "point_no",
        "type",
        "text",
        F.round(weight + F.least(F.col("_info") * 0.35, F.lit(0.35)), 6).alias("weight"),
        F.col("type").isin(*REQUIRED_TYPES).alias("required"),
        F.transform("_ent", lambda e: e["token"]).alias("aliases"),
        F.round(F.least(F.greatest(F.col("_best.s"), F.lit(0.35)), F.lit(1.0)), 6).alias("confidence"),
    )
    # matching, coverage and aliases all read the points again
    points = cut_lineage(points)
    return points.unionByName(_leftover_points(folded, points, limit, lex))


def _leftover_points(folded: DataFrame, points: DataFrame, limit: int, lex: Lexicons) -> DataFrame:
    """Heavy entities of the reference that no point mentions become value points."""
    covered = points.groupBy("sample_id").agg(
        E.normal(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_no", "text"))), lambda s: s["text"]), "")).alias("_cov"),
        F.max("point_no").alias("_n"),
    )
    rest = (
        folded.join(covered, "sample_id", "left")
        .withColumn("_cov", F.coalesce("_cov", F.lit("")))
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .select(
            "sample_id",
            "_n",
            F.posexplode(
                F.filter(E.entities(F.col("_r"), lex), lambda e: (e["weight"] >= 2.0) & ~F.contains(F.col("_cov"), e["token"]))
            ).alias("_i", "_e"),
        )
        .withColumn("point_no", F.col("_n") + F.col("_i") + 1)
        .filter(F.col("point_no") <= limit)
    )
    return rest.select(
        "sample_id",
        "point_no",
        F.lit("component_or_value").alias("type"),
        F.col("_e.token").alias("text"),
        F.lit(0.8).alias("weight"),
        F.lit(False).alias("required"),
        F.array("_e.token").alias("aliases"),
        F.lit(0.75).alias("confidence"),
    )


def match_points(points: DataFrame, preds: DataFrame, lex: Lexicons = DEFAULT, normalise: bool = True) -> DataFrame:
    """Status of every point in the prediction: hit, partial, missed, contradicted."""
    answers = (
        preds.select("sample_id", E.fold(F.col("prediction"), normalise).alias("_p"))
        .withColumn("_pn", E.normal(F.col("_p")))
        .withColumn("_pe", F.transform(E.entities(F.col("_p"), lex), lambda e: e["token"]))
    )
    staged = (
        points.join(answers, "sample_id")
        .withColumn("_norm", E.normal(F.col("text")))
        .withColumn("_ent", E.entities(F.col("text"), lex))
        .withColumn("_tok", F.transform("_ent", lambda e: e["token"]))
        .withColumn("_shared", F.array_intersect("_tok", "_pe"))
        .withColumn("entity_overlap", F.size("_shared") / F.greatest(F.size("_tok"), F.lit(1)))
        .withColumn("char_overlap", _grams_shared(F.col("_norm"), F.col("_pn")))
        .withColumn(
            "_content",
            F.slice(
                F.array_distinct(
                    F.concat("_tok", F.filter(K.bigrams(F.col("_norm")), lambda g: ~_has(g, f"^(?:{GENERIC})$")))
                ),
                1,
                80,
            ),
        )
        .withColumn("_found", F.size(F.filter("_content", lambda t: F.contains(F.col("_pn"), E.normal(t)))))
        .withColumn("claim_overlap", F.when(F.size("_content") == 0, 0.0).otherwise(F.col("_found") / F.size("_content")))
        .withColumn("_exact", (F.length("_norm") > 0) & F.contains("_pn", F.col("_norm")))
        .withColumn(
            "_aliased",
            F.exists("aliases", lambda a: F.array_contains(F.col("_pe"), a) | F.contains(F.col("_pn"), E.normal(a))),
        )
    )
    mixed = F.when(F.size("_tok") > 0, 0.65 * F.col("entity_overlap") + 0.35 * F.col("claim_overlap")).otherwise(0.0)
    named = F.when(F.col("_aliased") & (F.col("type") == "component_or_value"), 0.5).otherwise(0.0)
    evidence = F.when(F.col("_exact"), 1.0).otherwise(F.greatest("char_overlap", "claim_overlap", mixed, named))
    lenient = F.col("_aliased") & F.col("type").isin("component_or_value", "diagnostic_step", "fix_suggestion")
    status = (
        F.when(
            (F.col("evidence_score") >= 0.74) | ((F.col("entity_overlap") >= 0.85) & (F.col("claim_overlap") >= 0.35)), "hit"
        )
        .when((F.col("evidence_score") >= 0.42) | lenient, "partial")
        .otherwise("missed")
    )
    staged = staged.withColumn("evidence_score", evidence).withColumn("status", status)
    staged = staged.withColumn(
        "status",
        F.when((F.col("status") != "missed") & _contradicts(), "contradicted").otherwise(F.col("status")),
    )
    score = reduce(
        lambda acc, kv: acc.when(F.col("status") == kv[0], kv[1]), STATUS_SCORES.items(), F.when(F.lit(False), 0.0)
    )
    return staged.withColumn("status_score", score).select(
        "sample_id", "point_no", "type", "text", "weight", "required", "status", "status_score",
        *[F.round(c, 6).alias(c) for c in ("evidence_score", "entity_overlap", "char_overlap", "claim_overlap")],
    )


def _contradicts() -> Column:
    """Opposite polarity, opposite direction or other numbers for shared entities."""
    norm, pred = F.col("_norm"), F.col("_pn")
    related = (F.size("_shared") > 0) | (F.col("char_overlap") >= 0.28)
    heavy = F.exists(
        F.filter("_ent", lambda e: F.array_contains(F.col("_shared"), e["token"])),
        lambda e: ((e["weight"] >= 2.0) | (F.length(e["token"]) >= 3))
        & F.contains(norm, E.normal(e["token"]))
        & F.contains(pred, E.normal(e["token"])),
    )
    has = lambda col, term: F.contains(col, F.lit(term))
    flips = reduce(
        lambda a, b: a | b,
        [
            (has(norm, neg) & has(pred, pos) & ~has(pred, neg)) | (has(norm, pos) & has(pred, neg) & ~has(norm, neg))
            for neg, pos in POLARITY
        ],
    )
    polarity = heavy & (F.col("char_overlap") >= 0.45) & flips

    def opposite(group: tuple[str, ...]) -> Column:
        both = reduce(lambda a, b: a | b, [has(norm, t) & has(pred, t) for t in group])
        return T.contains_any(norm, group) & T.contains_any(pred, group) & ~both

    direction = reduce(lambda a, b: a | b, [opposite(g) for g in DIRECTIONS])
    own = F.regexp_extract_all(F.col("text"), F.lit(NUMBER), F.lit(0))
    theirs = F.regexp_extract_all(F.col("_p"), F.lit(NUMBER), F.lit(0))
    numbers = (F.size("_shared") > 0) & (F.size(own) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(own, theirs)
    return related & (polarity | direction | numbers)


def point_coverage(matches: DataFrame) -> DataFrame:
    """Coverage, required coverage and core verdict per sample (given matches)."""
    w, s = F.col("weight"), F.col("status_score")
    need = F.when(F.col("required"), w)
    core = F.col("type") == "core_conclusion"
    return matches.groupBy("sample_id").agg(
        F.count("*").alias("points"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(w * s) / F.sum(w))), 6).alias("coverage"),
        F.round(F.sum(need * F.greatest(s, F.lit(0.0))) / F.sum(need), 6).alias("required_coverage"),
        F.bool_or(core & F.col("status").isin("hit", "partial")).alias("core_conclusion_hit"),
        F.bool_or(core & (F.col("status") == "contradicted")).alias("core_contradicted"),
    )


# ------------------------------------------------------------- similarity


@F.pandas_udf(DoubleType())
def sequence_ratio(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    """Ratio of matching blocks; the fallback when no encoder is configured."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(reference, prediction)])


def similarity(pairs: DataFrame, vectors: tuple[str, str] | None = None) -> DataFrame:
    """``semantic_similarity`` from two vector columns, or from the texts."""
    from .dense import clamp01, dot

    ref, pred = F.coalesce("reference", F.lit("")), F.coalesce("prediction", F.lit(""))
    both, none = (F.length(ref) == 0) & (F.length(pred) == 0), (F.length(ref) == 0) | (F.length(pred) == 0)
    score = clamp01(dot(F.col(vectors[0]), F.col(vectors[1]))) if vectors else sequence_ratio(ref, pred)
    return pairs.withColumn("semantic_similarity", F.when(both, 1.0).when(none, 0.0).otherwise(F.round(score, 6)))
