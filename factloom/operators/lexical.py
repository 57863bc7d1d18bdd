"""Lexical retrieval: query profiles, the term index, BM25, rule rerank.

The index is three tables derived from the chunks:

``postings``   (chunk_id, token, n)   how often a token occurs in a chunk
``lengths``    (chunk_id, dl)         indexed length of a chunk
``stats``      one row                number of chunks, average length

A query term matches as a substring, and a term without white space can only
occur inside one white-space separated token.  So terms are matched against the
*vocabulary* (distinct tokens, far smaller than the corpus) and the result joins
the postings on the token: no text is scanned per query and no pair of query and
chunk is formed unless they share a term.

A search that is asked once needs no index: ``bm25_scan`` carries the terms of all
queries to the chunks and keeps what they hold of them, so what is shuffled are
matches, not the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import tokens as K
from ..lexicons import DEFAULT, QUERY_EXPANSIONS, Lexicons
from ..session import cut_lineage, drop_table, spread
from . import cleaning as C
from .ordered import top_k

K1, B = 1.2, 0.75  # fixed values of the ranking function
IDF_FLOOR = 1e-6
CANDIDATES = 80
STRONG_LIMIT, TERM_LIMIT, OTHER_LIMIT = 6, 12, 4
#: Distinct terms that are carried to the chunks; with more of them, vocabulary and postings are joined.
MOST_CARRIED = 100_000
PHRASES = tuple(sorted({t.lower() for terms in QUERY_EXPANSIONS.values() for t in terms if " " in t}))

# fixed values: term classes, first match wins
_DESIGNATOR = r"^[rcldqutjf][0-9]+[a-z0-9_.+\-]*$"
_VALUE = r"^[0-9]+(\.[0-9]+)?\s*(r|k|m|ohm|v|a|ma|ua|w|uf|nf|pf|mh|uh|hz|khz|mhz)$"
_MODEL_LOW = (
    r"^[a-z]{2,8}[0-9]{2,}[a-z0-9_.+\-]*$",
    r"^[0-9]+[a-z]{1,}[a-z0-9_.+\-]*[0-9]*[a-z0-9_.+\-]*$",
    r"^[a-z]{2,}[0-9]+[a-z0-9_.+\-]*$",
)
_MODEL_CASED = r"^[A-Z](?=[A-Za-z0-9_.+\-]*[A-Z])[A-Za-z0-9_.+\-]{3,}$"
_MODEL_UPPER = r"^[A-Z]{3,8}$"
CLASSES = ("models", "refdes", "values", "topology", "fault", "other")


def model_like(term: Column, lex: Lexicons = DEFAULT) -> Column:
    raw = T.strip(term)
    low = F.lower(raw)
    shape = T.rlike_any(low, _MODEL_LOW) | T.rlike_any(raw, (_MODEL_CASED, _MODEL_UPPER))
    return ~low.isin(*lex.model_like) & ~F.upper(raw).isin(*lex.acronyms) & shape


def term_class(term: Column, lex: Lexicons = DEFAULT) -> Column:
    low = F.lower(term)
    return (
        F.when(F.rlike(low, F.lit(_DESIGNATOR)), "refdes")
        .when(F.rlike(low, F.lit(_VALUE)), "values")
        .when(model_like(term, lex), "models")
        .when(low.isin(*lex.topology), "topology")
        .when(low.isin(*lex.fault), "fault")
        .otherwise("other")
    )


def expansions(query: Column) -> Column:
    """Terms added for each expansion key found in the query, in table order."""
    found = [
        F.when(F.contains(query, F.lit(key)), F.array(*[F.lit(t) for t in terms])).otherwise(
            F.array().cast("array<string>")
        )
        for key, terms in QUERY_EXPANSIONS.items()
    ]
    return F.flatten(F.array(*found))


def query_profile(df: DataFrame, query: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """Adds the six term classes and ``fts_terms``, the terms that are searched."""
    text = F.coalesce(F.col(query), F.lit(""))
    extra = F.filter(K.words(text), lambda x: F.length(x) >= 2)
    staged = df.withColumn("_all", F.concat(K.query_runs(text), extra, expansions(text)))
    # first spelling of every case-insensitively distinct term
    pairs = F.array_sort(
        F.transform("_all", lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("t")))
    )
    shift = F.concat(F.array(F.lit(None).cast("string")), F.transform(pairs, lambda s: s["k"]))
    heads = F.filter(
        F.zip_with(pairs, shift, lambda s, back: F.struct(s["i"].alias("i"), s["t"].alias("t"), s["k"].alias("k"), back.alias("b"))),
        lambda s: s["i"].isNotNull() & ~s["k"].eqNullSafe(s["b"]),
    )
    staged = staged.withColumn("_terms", F.transform(F.array_sort(heads), lambda s: s["t"]))
    staged = staged.withColumn(
        "_tagged", F.transform("_terms", lambda t: F.struct(t.alias("t"), term_class(t, lex).alias("c")))
    )

    def of_class(name: str) -> Column:
        return F.transform(F.filter("_tagged", lambda s: s["c"] == name), lambda s: s["t"])

    staged = staged.withColumns({name: of_class(name) for name in CLASSES})
    broad = list(lex.broad)

    def specific(terms: Column) -> Column:
        kept = F.filter(terms, lambda t: ~F.lower(t).isin(*broad))
        return F.when(F.size(kept) > 0, kept).otherwise(terms)

    ordered = F.concat("models", "refdes", "values", "topology", "fault", F.slice("other", 1, OTHER_LIMIT))
    strong = F.concat("models", "refdes", "values")
    return (
        staged.withColumn("query_terms", F.concat("models", "refdes", "values", "topology", "fault", "other"))
        .withColumn("specific_terms", F.array_distinct(F.transform(specific(F.col("query_terms")), F.lower)))
        .withColumn(
            "fts_terms",
            F.when(F.size(strong) > 0, F.slice(strong, 1, STRONG_LIMIT)).otherwise(
                F.slice(F.array_distinct(specific(ordered)), 1, TERM_LIMIT)
            ),
        )
        .withColumn("like_terms", F.slice(specific(F.col("_terms")), 1, 4))
        .drop("_all", "_terms", "_tagged")
    )


def fts_expression(terms: Column) -> Column:
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.array_join(quoted, " OR ")


# ------------------------------------------------------------------- index


def _search_text(title: str, url: str, body: str) -> Column:
    # a blank that no term contains keeps matches inside one field
    return F.lower(F.concat_ws(" \n ", F.col(title), F.col(url), F.col(body)))


def _run_lengths(words: Column) -> Column:
    """``array<struct<token,n>>``: sort, keep the start of every run, and take
    the distance to the next start."""

    def starts(ordered: Column) -> Column:
        back = F.concat(F.array(F.lit(None).cast("string")), ordered)
        placed = F.transform(ordered, lambda x, i: F.struct(x.alias("t"), i.alias("i")))
        marked = F.zip_with(
            placed, back, lambda x, b: F.struct(x["t"].alias("t"), x["i"].alias("i"), x["t"].eqNullSafe(b).alias("same"))
        )
        return F.filter(marked, lambda m: m["t"].isNotNull() & ~m["same"])

    def runs(heads: Column, total: Column) -> Column:
        following = F.slice(heads, F.lit(2), F.greatest(F.size(heads), F.lit(1)))
        ends = F.concat(F.transform(following, lambda m: m["i"]), F.array(total))
        return F.zip_with(
            heads, ends, lambda m, end: F.struct(m["t"].alias("token"), (end - m["i"]).cast("long").alias("n"))
        )

    return T.let(
        F.array_sort(words),
        lambda o: F.when(F.size(o) == 0, F.array().cast("array<struct<token:string,n:bigint>>")).otherwise(
            T.let(starts(o), lambda h: runs(h, F.size(o)))
        ),
    )


def postings(
    chunks: DataFrame, chunk_id: str = "chunk_id", title: str = "title", url: str = "url", body: str = "text", with_length: bool = False
) -> DataFrame:
    """(chunk_id, token, n), and with ``with_length`` the chunk's ``dl``.  A chunk is one row, so its tokens are counted
    inside the row and nothing is shuffled.

    Multi-word expansion terms, a fixed list, are indexed like tokens.
    """
    kept = [F.col(chunk_id).alias("chunk_id"), *([_indexed_length(title, url, body).alias("dl")] if with_length else [])]
    staged = chunks.select(*kept, _search_text(title, url, body).alias("_text"))
    words = F.filter(F.split(F.col("_text"), f"{T.WS}+"), lambda t: F.length(t) >= 3)
    present = F.filter(F.array(*[F.lit(p) for p in PHRASES]), lambda p: F.contains(F.col("_text"), p))
    phrases = F.transform(
        present, lambda p: F.struct(p.alias("token"), T.occurrences(F.col("_text"), p).cast("long").alias("n"))
    )
    return staged.select(*staged.columns[:-1], F.inline(F.concat(_run_lengths(words), phrases)))


def _indexed_length(title: str, url: str, body: str) -> Column:
    grams = [F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in (title, url, body)]
    return grams[0] + grams[1] + grams[2]


def lengths(chunks: DataFrame, chunk_id: str = "chunk_id", title: str = "title", url: str = "url", body: str = "text") -> DataFrame:
    """Indexed length: number of character trigrams of the three fields."""
    return chunks.select(F.col(chunk_id).alias("chunk_id"), _indexed_length(title, url, body).alias("dl"))


def _trigrams(col: Column) -> Column:
    chars = F.split(col, "")
    size = F.greatest(F.size(chars), F.lit(1))
    two = F.zip_with(chars, F.slice(chars, F.lit(2), size), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(chars, F.lit(3), size), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(three, lambda g: g.isNotNull()))


def match_vocabulary(terms: DataFrame, posts: DataFrame) -> DataFrame:
    """(term, token, occ): how often each term occurs inside each token.

    Terms of fewer than three characters match nothing, as in a trigram index.
    """
    probe = terms.select("term").distinct().filter(F.length("term") >= 3)
    probe = probe.withColumn("gram", F.substring("term", 1, 3))
    vocabulary = spread(posts.select("token").distinct(), "token", scan=False).withColumn("gram", F.explode(_trigrams(F.col("token"))))
    inside = (
        vocabulary.join(probe, "gram")
        .filter(F.contains("token", "term"))
        .filter(~F.contains("token", F.lit(" ")) | (F.col("token") == F.col("term")))
        .select("term", "token", T.occurrences(F.col("token"), F.col("term")).alias("occ"))
    )
    return inside


def bm25(queries: DataFrame, posts: DataFrame, lens: DataFrame, query_id: str, limit: int = CANDIDATES) -> DataFrame:
    """Best ``limit`` chunks per query.  ``queries`` has one row per query with
    an array column ``fts_terms``.  Scores are negative, lower is better."""
    wanted = queries.select(query_id, F.explode(F.array_distinct(F.transform("fts_terms", F.lower))).alias("term"))
    matches = match_vocabulary(wanted, posts)
    tf = (
        posts.join(matches, "token")
        .groupBy("term", "chunk_id")
        .agg(F.sum(F.col("n") * F.col("occ")).alias("tf"))
    )
    # read twice: for the document frequencies and for the scores
    tf = cut_lineage(tf)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n_chunks = lens.agg(F.count("*")).scalar()
    idf = F.ln((n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select(
        "term",
        lens.agg(F.avg("dl")).scalar().alias("avgdl"),
        F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"),
    )
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    scored = (
        tf.join(weights, "term")
        .join(lens, "chunk_id")
        .select("term", "chunk_id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))
    )
    ranked = (
        scored.join(wanted, "term")
        .groupBy(query_id, "chunk_id")
        .agg((-F.sum("part")).alias("bm25_score"))
    )
    order = [F.round("bm25_score", 9), F.col("chunk_id")]
    return top_k(ranked, [query_id], order, limit)


# -------------------------------------------------------------------- scan

# fixed values: words that a task remembers, their longest, rows answered at a time
_REMEMBERED, _LONGEST_REMEMBERED, _SLICE = 100_000, 64, 256


class _Inside:
    """Which pieces a word holds, and how often: a piece is met on its first characters (up to three).  Words are
    remembered, as most of them come again."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.heads: dict[str, list[str]] = {}
        for piece in pieces:
            self.heads.setdefault(piece[:3], []).append(piece)
        self.sizes = sorted({len(head) for head in self.heads})
        self.known: dict[str, tuple[tuple[str, int], ...]] = {}

    def __call__(self, word: str) -> tuple[tuple[str, int], ...]:
        found = self.known.get(word)
        if found is None:
            held = set()
            for size in self.sizes:
                for at in range(len(word) - size + 1):
                    for piece in self.heads.get(word[at : at + size], ()):
                        if word.startswith(piece, at):
                            held.add(piece)
            found = tuple((piece, word.count(piece)) for piece in held)
            if len(word) <= _LONGEST_REMEMBERED:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found


def _rows_of(batches: Iterable[pa.RecordBatch], kept: list[str], texts: list[str], schema: pa.Schema, answers: Callable) -> Iterator[pa.RecordBatch]:
    """One row per answer to a row's ``texts``, behind its ``kept`` columns; a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            part = batch.slice(start, _SLICE)
            own, found = [], []
            for at, row in enumerate(zip(*[part.column(c).to_pylist() for c in texts], strict=True)):
                new = answers(*row)
                own.extend([at] * len(new))
                found.extend(new)
            arrays = [part.column(c).take(pa.array(own, pa.int32())) for c in kept]
            arrays += [pa.array([f[i] for f in found], field.type) for i, field in enumerate(list(schema)[len(kept) :])]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(schema, arrays)]))


def _answered(staged: DataFrame, kept: list[str], texts: list[str], added: list[StructField], make: Callable) -> DataFrame:
    """``mapInArrow`` of ``_rows_of``; ``make()`` gives each task its function from texts to rows."""
    schema = StructType([*[staged.schema[c] for c in kept], *added])
    types = {"string": pa.string(), "bigint": pa.int64()}
    arrow = pa.schema([pa.field(c, pa.null()) for c in kept] + [pa.field(f.name, types[f.dataType.simpleString()]) for f in added])
    return staged.mapInArrow(lambda batches: _rows_of(batches, kept, texts, arrow, make()), schema)


def term_counts(
    chunks: DataFrame, terms: list[str], chunk_id: str = "chunk_id", title: str = "title", url: str = "url", body: str = "text"
) -> DataFrame:
    """(row, chunk_id, dl, term, tf, token): how often a chunk holds each of ``terms``, by one scan of the chunks.

    Matches are those of ``match_vocabulary``: terms of three characters and more inside white-space separated words, and
    the expansion phrases as a whole.  ``token`` is the word with the term if the chunk has one such word, else null.
    """
    kept = [F.monotonically_increasing_id().alias("row"), F.col(chunk_id).alias("chunk_id"), _indexed_length(title, url, body).alias("dl")]
    staged = chunks.select(*kept, _search_text(title, url, body).alias("_text"))
    words = [t for t in terms if len(t) >= 3 and " " not in t]
    phrases = [t for t in terms if t in PHRASES]

    def make() -> Callable:
        inside = _Inside(words)

        def answers(text: str) -> list[tuple[str, int, str | None]]:
            found: dict[str, tuple[int, str | None]] = {p: (text.count(p), p) for p in phrases if p in text}
            for word, n in Counter(text.split()).items():
                for term, occ in inside(word):
                    found[term] = (found[term][0] + n * occ, None) if term in found else (n * occ, word)
            return [(term, tf, token) for term, (tf, token) in found.items()]

        return answers

    added = [StructField("term", StringType()), StructField("tf", LongType()), StructField("token", StringType())]
    return _answered(staged, ["row", "chunk_id", "dl"], ["_text"], added, make)


def _carried(wanted: DataFrame) -> list[str] | None:
    """The distinct terms, if they are few enough to be carried to the chunks."""
    terms = [r[0] for r in wanted.where(F.col("term").isNotNull()).select("term").distinct().limit(MOST_CARRIED + 1).collect()]
    return terms if len(terms) <= MOST_CARRIED else None


def bm25_scan(queries: DataFrame, chunks: DataFrame, query_id: str, limit: int = CANDIDATES) -> DataFrame:
    """``bm25`` without an index: one scan of the chunks for the terms of all queries, and what they match is shuffled.

    A term inside one word of the whole vocabulary counts each row of a repeated chunk id, as its posting list does; a term inside
    several words counts a chunk id once.
    """
    wanted = cut_lineage(queries.select(query_id, F.explode(F.array_distinct(F.transform("fts_terms", F.lower))).alias("term")))
    terms = _carried(wanted)
    if terms is None:
        return bm25(queries, cut_lineage(postings(chunks)), lengths(chunks), query_id, limit)
    total, average = lengths(chunks).agg(F.count("*"), F.avg("dl")).first()
    found = cut_lineage(term_counts(chunks, terms))
    single = (F.count("token") == F.count("*")) & (F.min("token") == F.max("token"))
    kinds = found.groupBy("term").agg(single.alias("single"))
    counted = found.join(F.broadcast(kinds), "term").withColumn("copy", F.when(F.col("single"), F.col("row")))
    tf = cut_lineage(counted.groupBy("term", "chunk_id", "copy").agg(F.sum("tf").alias("tf"), F.min("dl").alias("dl")))
    drop_table(found)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("term", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"))
    norm = K1 * (1 - B + B * F.col("dl") / float(average or 1.0))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    parts = tf.join(F.broadcast(weights), "term").select("term", "chunk_id", part.alias("part"))
    ranked = wanted.join(parts, "term").groupBy(query_id, "chunk_id").agg((-F.sum("part")).alias("bm25_score"))
    best = cut_lineage(top_k(ranked, [query_id], [F.round("bm25_score", 9), F.col("chunk_id")], limit))
    drop_table(tf)
    return best


def _holding(texts: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(chunk_id, term) of the chunks whose title or text contains a term: the first ``limit`` chunks of each, cut to so many in
    each task, as no query returns more of them."""

    def make() -> Callable:
        by_piece: dict[str, list[str]] = {}
        for term in terms:
            by_piece.setdefault(term.split()[0], []).append(term)
        inside = _Inside(by_piece)

        def answers(title: str, text: str) -> list[tuple[str]]:
            pieces = {p for word in {*title.split(), *text.split()} for p, _ in inside(word)}
            return [(t,) for p in pieces for t in by_piece[p] if t == p or t in title or t in text]

        return answers

    found = _answered(texts.where(F.col("chunk_id").isNotNull()), ["chunk_id"], ["_title", "_text"], [StructField("term", StringType())], make)
    place = F.dense_rank().over(W.partitionBy("term").orderBy("chunk_id"))
    return found.withColumn("_place", place).where(F.col("_place") <= limit).select("chunk_id", "term").distinct()


def like_search(queries: DataFrame, chunks: DataFrame, query_id: str, limit: int = CANDIDATES) -> DataFrame:
    """Fallback: chunks whose title or text contains one of the query's first specific
    terms, all with the same score, in chunk order.

    A term of any length counts, also of one or two characters, which an index of
    trigrams cannot answer.  The first word of a term is looked for inside the
    words of titles and texts, which it meets on its first characters (up to three);
    only chunks with such a word are searched for the whole term.  That is one scan of the
    chunks, unless the terms are too many to be carried there.
    """
    wanted = queries.select(query_id, F.explode(F.array_distinct(F.transform("like_terms", F.lower))).alias("term"))
    wanted = cut_lineage(wanted.filter(T.strip(F.col("term")) != ""))
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "text")]
    texts = chunks.select("chunk_id", fields[0].alias("_title"), fields[1].alias("_text"))
    terms = _carried(wanted)
    held = _joined_holding(texts, wanted) if terms is None else _holding(texts, terms, limit)
    found = held.join(wanted, "term").select(query_id, "chunk_id").distinct().withColumn("bm25_score", F.lit(10.0))
    return top_k(found, [query_id], [F.col("chunk_id")], limit)


def _joined_holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, term) of all chunks whose title or text contains a term, through the distinct words."""
    probe = wanted.select("term").distinct().withColumn("piece", F.split(T.strip(F.col("term")), f"{T.WS}+")[0])
    probe = probe.withColumn("gram", F.substring("piece", 1, 3))
    words = texts.select("chunk_id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "_title", "_text"), f"{T.WS}+"))).alias("token"))
    vocabulary = words.select("token").distinct().withColumn("gram", F.explode(F.concat(*[_grams(F.col("token"), n) for n in (1, 2, 3)])))
    inside = vocabulary.join(probe, "gram").filter(F.contains("token", "piece")).select("term", "token")
    candidates = words.join(inside, "token").select("chunk_id", "term").distinct()
    held = F.contains("_title", "term") | F.contains("_text", "term")
    return texts.join(candidates, "chunk_id").filter(held).select("chunk_id", "term")


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(n))))


# ------------------------------------------------------------------ rerank


def component_terms(tokens: Column) -> Column:
    low = F.transform(tokens, F.lower)
    shape = r"^[a-z]{1,4}[0-9]+[a-z0-9_.+\-]*$"
    return F.array_distinct(F.filter(low, lambda t: F.rlike(t, F.lit(shape)) | F.rlike(t, F.lit(_VALUE))))


def count_in(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def high_value_matches(text: Column) -> Column:
    """Distinct designators, values, topology and fault terms in the text."""
    pool = F.array_distinct(F.transform(F.concat("refdes", "values", "topology", "fault"), F.lower))
    return count_in(pool, text)


def technical_score(low: Column, lex: Lexicons = DEFAULT) -> Column:
    return (
        F.least(F.lit(3), T.hits(low, lex.high_value))
        + F.least(F.lit(3), T.hits(low, [t.lower() for t in lex.technical]))
        + F.rlike(low, F.lit(r"\b(r|c|l|d|q|u|j|t)[0-9]+\b")).cast("int")
        + F.rlike(low, F.lit(r"[0-9]+(\.[0-9]+)?\s*(v|a|ma|ua|w|uf|nf|pf|ohm|khz|mhz)\b")).cast("int")
    )


def rerank(hits: DataFrame, query: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """Adds ``rerank_score``.  ``hits`` carries the query, its profile columns,
    ``bm25_score`` and the chunk's ``title``, ``url``, ``text``."""
    staged = (
        hits.withColumn("_head", F.lower(F.concat_ws(" ", "title", "url")))
        .withColumn("_low", F.concat_ws(" ", "_head", F.lower("text")))
        .withColumn("_hv", high_value_matches(F.col("_low")))
    )
    head, low = F.col("_head"), F.col("_low")

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    def each(terms: str, worth) -> Column:
        return F.aggregate(
            F.transform(F.col(terms), F.lower), F.lit(0.0), lambda acc, t: acc + worth(t)
        )

    project = C.project_source(F.col("url"), lex)
    technical = [t.lower() for t in lex.technical]
    query_low = F.lower(F.col(query))
    shared_terms = sum(
        (
            points(F.contains(low, F.lit(t)) & (F.contains(query_low, F.lit(t)) | F.contains(head, F.lit(t))), 0.6)
            for t in technical
        ),
        F.lit(0.0),
    )
    same_parts = F.size(
        F.array_intersect(
            component_terms(F.col("specific_terms")),
            component_terms(F.regexp_extract_all(low, F.lit(r"[A-Za-z0-9_.+\-]+"), F.lit(0))),
        )
    )
    asks_high_value = (F.size("refdes") + F.size("values") + F.size("topology") + F.size("fault")) > 0
    score = (
        1.0 / (1.0 + F.abs("bm25_score"))
        + points(C.boilerplate_text(T.squeeze(low), lex), -8.0)
        + points(C.low_value_source(F.col("url"), lex), -8.0)
        + points(project, -2.5)
        + points(project & T.contains_any(F.lower("title"), lex.project_titles), -4.0)
        + points(project & (technical_score(low, lex) < 2), -2.0)
        + each("specific_terms", lambda t: F.when(F.contains(head, t), 3.0).when(F.contains(low, t), 1.0).otherwise(0.0))
        + each("models", lambda t: F.when(F.contains(low, t), 5.0).otherwise(-1.5))
        + each("refdes", lambda t: F.when(F.contains(low, t), 2.0).otherwise(0.0))
        + each("topology", lambda t: F.when(F.contains(head, t), 2.0).when(F.contains(low, t), 1.0).otherwise(0.0))
        + each("fault", lambda t: F.when(F.contains(low, t), 1.2).otherwise(0.0))
        + F.col("_hv")
        + points((F.size("models") == 0) & asks_high_value & (F.col("_hv") < 2), -2.0)
        + points(T.contains_any(low, lex.high_value), 0.8)
        + shared_terms
        + same_parts * 1.2
        + points(T.contains_any(low, lex.noise), -3.0)
        + points(F.length("text") < 160, -2.0)
    )
    return staged.withColumn("rerank_score", score).drop("_head", "_low", "_hv")


def required_terms_met(low: Column) -> Column:
    strong = F.transform(F.concat("models", "refdes", "values"), F.lower)
    asks_high_value = (F.size("topology") + F.size("fault")) > 0
    return (
        F.when(F.size(strong) > 0, F.exists(strong, lambda t: F.contains(low, t)))
        .when(asks_high_value, high_value_matches(low) >= 2)
        .otherwise(F.lit(True))
    )


def low_value_project(low: Column, lex: Lexicons = DEFAULT) -> Column:
    strong = F.transform(F.concat("models", "refdes", "values"), F.lower)
    technical = technical_score(low, lex)
    rescued = (F.exists(strong, lambda t: F.contains(low, t)) & (technical >= 2)) | (
        (F.size(strong) == 0) & (high_value_matches(low) >= 2) & (technical >= 3)
    )
    listed = T.contains_any(F.lower("title"), lex.project_titles)
    return C.project_source(F.col("url"), lex) & (listed | ~rescued)


#: What a document of the query's own id counts, in shared tokens.
OWN_BONUS = 8


def _best_overlaps(batches: Iterable[pa.RecordBatch], groups: dict[str, np.ndarray], asked: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """(doc, _size, _group, overlap) of a task's documents, as far as one of them can be among the first ``limit`` of its group.

    ``groups`` has the groups that a token counts for, ``asked`` the sizes of the queries.  Scores are compared as they are and ranked
    later as rounded to four places: what lies less than two units of the last place behind stays, and of exactly equal ones the least ids.
    """
    ids, sizes, of, overlap, raw = [], *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0)
    doc = np.zeros(0, np.int64)
    floor = np.zeros(len(asked))
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for start in range(0, batch.num_rows, _SLICE):
            part = batch.slice(start, _SLICE)
            own = part.column(0).to_pylist()
            own_sizes = np.array(part.column(1).to_pylist(), np.int64)
            found = []
            for at, tokens in enumerate(part.column(2).to_pylist()):
                if hit := [groups[t] for t in tokens if t in groups]:
                    some, counts = np.unique(np.concatenate(hit), return_counts=True)
                    found.append((np.full(len(some), at), some, counts))
            if not found:
                continue
            at, some, counts = (np.concatenate(c) for c in zip(*found, strict=True))
            value = counts / np.maximum(asked[some], 1) + counts / np.sqrt(np.maximum(own_sizes[at], 1))
            near = value >= floor[some]
            doc = np.concatenate([doc, at[near] + len(ids)])
            sizes = np.concatenate([sizes, own_sizes[at[near]]])
            of, overlap, raw = np.concatenate([of, some[near]]), np.concatenate([overlap, counts[near]]), np.concatenate([raw, value[near]])
            ids += own
            place = np.empty(len(ids), np.int64)
            place[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
            order = np.lexsort((place[doc], -raw, of))
            of, raw, doc = of[order], raw[order], doc[order]
            new_of = np.flatnonzero(np.diff(of, prepend=-1) != 0)
            last = new_of + limit - 1
            full = last < np.append(new_of[1:], len(of))
            floor[of[new_of[full]]] = raw[last[full]] - 2e-4
            new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(raw, prepend=-1.0) != 0))
            nth = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
            kept = (nth < limit) & (raw >= floor[of])
            order = order[kept]
            of, raw, doc, sizes, overlap = of[kept], raw[kept], doc[kept], sizes[order], overlap[order]
            held, doc = np.unique(doc, return_inverse=True)
            ids = [ids[i] for i in held]
    if kind is not None:
        columns = [pa.array([ids[i] for i in doc], kind), pa.array(sizes, pa.int32()), pa.array(of, pa.int64()), pa.array(overlap, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "_size", "_group", "overlap"])


def _scanned_overlaps(docs: DataFrame, wanted: list, query_id: str, doc_id: str, limit: int) -> tuple[DataFrame, list[tuple]]:
    """(doc, _size, _group, overlap) by one scan of documents with ids of their own, and (group, query, its size); ``docs`` has their
    ``_size`` and ``_parts``."""
    numbers: dict[tuple, int] = {}
    places: dict[str, list[int]] = {}
    for row in wanted:
        places.setdefault(row["token"], []).extend([numbers.setdefault((row[query_id], row["_wanted"]), len(numbers))] * row["weight"])
    groups = {token: np.array(at, np.int64) for token, at in places.items()}
    asked = np.array([n for _, n in numbers], np.int64)
    schema = StructType([StructField("doc", docs.schema[doc_id].dataType), *docs.select("_size").schema, StructField("_group", LongType()), StructField("overlap", LongType())])
    staged = docs.select(F.col(doc_id).alias("doc"), "_size", "_parts")
    return staged.mapInArrow(lambda batches: _best_overlaps(batches, groups, asked, limit), schema), [(g, *k) for k, g in numbers.items()]


def overlap_search(
    queries: DataFrame, docs: DataFrame, query_id: str, query: str, doc_id: str, body: str, limit: int = 4, own: tuple[str, str] | None = None
) -> DataFrame:
    """Token overlap: shared / query size + shared / sqrt(document size).

    ``own`` names a column of the queries with an id, and one of the documents with the pieces of its path: a document whose path
    has the id counts ``OWN_BONUS`` tokens more, also where it shares none.  Ids are matched like tokens, so no pairs are formed for them.

    The tokens of the queries are carried to the documents, and a task returns those that can be among the best.  Rows of a repeated
    id count together, so they are joined with the queries, as all documents are if the tokens are too many.
    """
    one = F.lit(1).alias("weight")
    asked = queries.withColumn("_asked", F.array_distinct(K.words(F.col(query)))).withColumn("_wanted", F.size("_asked"))
    wanted = asked.select(query_id, "_wanted", F.explode("_asked").alias("token"))
    mark = lambda c: F.concat(F.lit(" "), c)  # noqa: E731 - no token holds a blank
    if own:
        wanted = wanted.unionByName(asked.where((F.col("_wanted") > 0) & (F.col(own[0]) != "")).select(query_id, "_wanted", mark(F.col(own[0])).alias("token")))

    def joined(some: DataFrame) -> DataFrame:
        doc_tokens = some.withColumn("_tokens", F.array_distinct(K.words(F.col(body)))).withColumn("_size", F.size("_tokens"))
        exploded = doc_tokens.select(doc_id, "_size", F.explode("_tokens").alias("token"), one)
        if own:
            pieces = doc_tokens.select(doc_id, "_size", F.explode(F.array_distinct(own[1])).alias("token"), F.lit(OWN_BONUS).alias("weight"))
            exploded = exploded.unionByName(pieces.withColumn("token", mark(F.col("token"))))
        return exploded.join(wanted, "token").groupBy(query_id, doc_id, "_size", "_wanted").agg(F.sum("weight").alias("overlap"))

    weighed = wanted.where(F.col("token").isNotNull()).withColumn("weight", F.when(F.startswith("token", F.lit(" ")), OWN_BONUS).otherwise(1))
    carried = weighed.limit(MOST_CARRIED + 1).collect()
    if len(carried) > MOST_CARRIED:
        shared = joined(docs)
    else:
        repeated = cut_lineage(docs.groupBy(doc_id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(doc_id).alias("_repeated")))
        same = F.col(doc_id).eqNullSafe(F.col("_repeated"))
        tokens = F.array_distinct(K.words(F.col(body)))
        parts = F.concat("_tokens", F.coalesce(F.transform(F.array_distinct(own[1]), mark), F.array().cast("array<string>"))) if own else F.col("_tokens")
        single = docs.join(repeated, same, "left_anti").withColumn("_tokens", tokens).withColumn("_size", F.size("_tokens")).withColumn("_parts", parts)
        found, numbers = _scanned_overlaps(single, carried, query_id, doc_id, limit)
        names = StructType([StructField("_group", LongType()), *asked.select(query_id, "_wanted").schema])
        named = F.broadcast(docs.sparkSession.createDataFrame(numbers, names))
        shared = found.join(named, "_group").select(query_id, F.col("doc").alias(doc_id), "_size", "_wanted", "overlap")
        if not repeated.isEmpty():
            shared = shared.unionByName(joined(docs.join(repeated, same, "left_semi")))
    score = F.col("overlap") / F.greatest(F.col("_wanted"), F.lit(1)) + F.col("overlap") / F.sqrt(F.greatest(F.col("_size"), F.lit(1)).cast("double"))
    scored = shared.select(query_id, doc_id, "overlap", F.round(score, 4).alias("score"))
    return top_k(scored, [query_id], [F.desc("score"), F.col(doc_id)], limit)


def token_idf(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """Smoothed inverse document frequency of every token."""
    total = docs.agg(F.count("*")).scalar()
    frequency = (
        docs.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("df"))
    )
    idf = F.ln((total + 1) / (F.col("df") + 1)) + 1.0
    return frequency.select("token", "df", F.round(idf, 6).alias("idf"))
