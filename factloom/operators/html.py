"""Readable text from HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..lexicons import DEFAULT, Lexicons
from . import cleaning as C
from .evidence import read_quality, sufficiency_rank

# fixed values: elements without article text, and names of the main element
HIDDEN = ("script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe")
DROPPED = "|".join(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>" for t in HIDDEN)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN_WORDS = ("content", "main", "article", "post", "entry")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def strip_text(html: Column) -> Column:
    """Tags, comments and hidden elements removed; fully native."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), DROPPED, " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    # fixed values: entities resolved by the native variant, ampersand last
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.array_join(T.lines(bare), "\n")


class _MainText(HTMLParser):
    """Text per kind of main element; the best kind present wins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.hidden = 0
        self.taken: set[int] = set()
        self.text: dict[int, list[str]] = {}

    def _rank(self, tag: str, attrs: dict[str, str]) -> int | None:
        named = lambda key, words: any(w in (attrs.get(key) or "").lower() for w in words)
        tests = (
            tag == "article", tag == "main", attrs.get("role") == "main",
            named("id", MAIN_WORDS[:4]), named("class", MAIN_WORDS), tag == "body",
        )
        return next((i for i, hit in enumerate(tests) if hit and i not in self.taken), None)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        rank = None
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden:
            rank = self._rank(tag, dict(attrs))
            if rank is not None:
                self.taken.add(rank)
                self.text.setdefault(rank, [])
        self.open.append((tag, rank))

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.open):
            return
        while self.open:
            top, _ = self.open.pop()
            self.hidden -= top in HIDDEN
            if top == tag:
                return

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.hidden:
            for rank in {r for _, r in self.open if r is not None} | {len(VOID)}:
                self.text.setdefault(rank, []).append(piece)


def _main_text(html: str | None) -> str:
    parser = _MainText()
    parser.feed(html or "")
    parser.close()
    best = min(parser.text, default=None)
    return "\n".join(parser.text[best]) if best is not None else ""


@F.pandas_udf(StringType())
def main_text(values: pd.Series) -> pd.Series:
    return values.map(_main_text)


# ------------------------------------------------------------- extraction


def _short(line: Column) -> Column:
    from ..functions import tokens as K

    words = F.size(K.content_tokens(line))
    return (words > 0) & (words <= 5) & ~F.startswith(line, F.lit("#")) & ~F.startswith(line, F.lit("|"))


def merge_short_runs(lines: Column) -> Column:
    """Short lines are collected until three are held or a long one follows.

    A held run is written as one joined line; the line that closes the run is
    written after it.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("held"))

    def step(acc: Column, line: Column) -> Column:
        short = _short(line)
        held = F.when(short, F.concat(acc["held"], F.array(line))).otherwise(acc["held"])
        flush = F.when(F.size(held) > 0, F.array(F.array_join(held, " "))).otherwise(none)
        wait = short & (F.size(held) < 3)
        return F.when(wait, F.struct(acc["done"].alias("done"), held.alias("held"))).otherwise(
            F.struct(F.concat(acc["done"], flush, F.array(line)).alias("done"), none.alias("held"))
        )

    return F.aggregate(
        lines, start, step,
        lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["done"]),
    )


def clean_blocks(body: Column, lex: Lexicons = DEFAULT) -> Column:
    """Readable blocks of a text, separated by blank lines."""
    kept = F.filter(C.cap_repeats(C.readable_lines(body)), lambda x: ~C.boilerplate_line(x, lex))
    return F.array_join(merge_short_runs(kept), "\n\n")


def block_scores(df: DataFrame, body: str, title: str, snippet: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """``_blocks``: array of (score, index, block) of a cleaned text."""
    from ..functions import tokens as K

    context = F.concat_ws(" ", title, snippet)
    asked = F.length(F.trim(context)) > 0

    def weigh(block: Column, tokens: Column) -> Column:
        low = F.lower(block)
        n = F.greatest(F.size(tokens), F.lit(1))
        nav = F.size(F.filter(tokens, lambda t: t.isin(*lex.nav_words)))
        penalty = F.least(nav / n * 2.0 + T.total_occurrences(low, lex.boilerplate) * 0.04, F.lit(0.7)) + F.when(
            C.boilerplate_line(block, lex), 0.3
        ).otherwise(0.0)
        value = (
            F.least(F.length(block) / 900.0, F.lit(1.0)) * 0.35
            + F.when(asked, F.least(C.context_overlap(tokens, context) / 0.16, F.lit(1.0)) * 0.30).otherwise(0.08)
            + F.least(C.signal_count(tokens, lex) / 4.0, F.lit(1.0)) * 0.20
            + F.greatest(F.lit(0.0), 1.0 - F.least(C.link_marks(low) / n * 10.0, F.lit(1.0))) * 0.15
            - penalty
        )
        return F.when(F.size(tokens) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), value))

    def score(block: Column) -> Column:
        return T.let(K.content_tokens(block), lambda tokens: weigh(block, tokens))

    blocks = F.filter(F.transform(F.split(body, r"\n\s*\n"), T.strip), lambda x: F.length(x) > 0)
    return df.withColumn(
        "_blocks", F.transform(blocks, lambda b, i: F.struct(score(b).alias("score"), i.alias("at"), b.alias("block")))
    )


def select_blocks(df: DataFrame, body: str, title: str, snippet: str, out: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """Best blocks with their acceptable neighbours; short results and texts of
    fewer than four blocks stay as they are."""
    staged = block_scores(df, body, title, snippet, lex)
    best = F.reverse(F.array_sort(F.filter("_blocks", lambda b: b["score"] > 0.12)))
    room = F.greatest(F.lit(6), F.floor(F.size("_blocks") / 3).cast("int"))
    staged = staged.withColumn("_top", F.transform(F.slice(best, F.lit(1), room), lambda b: b["at"]))
    near = F.flatten(F.transform("_top", lambda i: F.array(i - 1, i + 1)))
    staged = staged.withColumn("_near", F.array_distinct(near))
    kept = F.filter(
        "_blocks",
        lambda b: F.array_contains(F.col("_top"), b["at"]) | ((b["score"] > 0.02) & F.array_contains(F.col("_near"), b["at"])),
    )
    staged = staged.withColumn("_picked", F.array_join(F.transform(kept, lambda b: b["block"]), "\n\n"))
    whole = (
        (F.size("_blocks") < 4)
        | (F.size("_top") == 0)
        | ((F.length("_picked") < 500) & (F.length(body) > 1200))
    )
    return staged.withColumn(out, F.when(whole, F.col(body)).otherwise(F.col("_picked"))).drop("_blocks", "_top", "_near", "_picked")


def extract(df: DataFrame, key: str, html: str, lex: Lexicons = DEFAULT, snippet: str | None = None) -> DataFrame:
    """Best extraction per page.

    Candidates are rows (page, extractor): main element or stripped page, each
    whole or reduced to its relevant blocks; the best by rank wins.

    The pair of readings is not a column of its own: from one, Spark infers a filter, for which every page is read once more by the
    few tasks of the scan.
    """
    rows = df.select(
        key,
        F.length(html).alias("raw_chars"),
        title(F.col(html)).alias("_title"),
        (F.col(snippet) if snippet else F.lit("")).alias("_snippet"),
        F.inline(
            F.array(
                F.struct(F.lit("main_text").alias("extractor"), main_text(F.col(html)).alias("_raw")),
                F.struct(F.lit("strip_text").alias("extractor"), strip_text(F.col(html)).alias("_raw")),
            )
        ),
    )
    rows = rows.withColumn("_clean", clean_blocks(F.col("_raw"), lex))
    rows = rows.withColumn("_clean", C.trim_to_context(F.col("_clean"), F.col("_snippet"), F.col("_title")))
    rows = select_blocks(rows, "_clean", "_title", "_snippet", "_sel", lex)
    forms = rows.select(
        key, "raw_chars", "_title", "_snippet", "extractor",
        F.explode(F.array_distinct(F.array("_clean", "_sel"))).alias("content"),
    )
    scored = read_quality(forms, "content", "_title", "_snippet", lex, raw_chars="raw_chars")
    rank = F.struct(
        sufficiency_rank(F.round("quality_score", 6), F.col("clean_chars")).alias("r"), F.col("extractor"), F.md5(F.encode("content", "UTF-8")).alias("tie")
    )
    cols = ["extractor", "content", "clean_chars", "raw_chars", "quality_score", "quality_reason", "penalty", "mojibake", "forum", "repeat"]
    return scored.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_b")).select(key, "_b.*")
