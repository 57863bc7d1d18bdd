"""Crawled page files and per-host page rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicons import HOST_ALLOWED_PATHS, HOST_REJECT_PATHS, HOST_REJECT_TITLES

MAX_FILE_BYTES = 2_000_000
HEADER_BYTES = 8192
# fixed values: header labels of a page file and the word for "unknown"
TITLE, LINK, DATE, UNKNOWN = "标题", "链接", "发布时间", "未知"


def check_root(path: str, forbidden: tuple[str, ...]) -> str:
    """Refuse folders that must not serve as evidence (the test set)."""
    clean = path.rstrip("/") + "/"
    for root in forbidden:
        if clean.startswith(root.rstrip("/") + "/"):
            raise ValueError(f"source lies under a forbidden root: {path}")
    return path


def scan(spark: SparkSession, roots: list[str], forbidden: tuple[str, ...] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Page files of several folders: ``path, source_no, page_no, length, content``.

    The size test is pushed into the file listing, so oversized files are never
    opened; ``content`` is only read by plans that use it.
    """
    parts = []
    for number, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.md").load(check_root(root, forbidden))
        page = F.regexp_extract("path", r"page_([0-9]+)\.md$", 1).try_cast("long")
        parts.append(
            files.filter(F.col("length") <= max_bytes).select(
                "path", F.lit(number).alias("source_no"), page.alias("page_no"), "length", "content"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decode(col):
    """UTF-8 text of file bytes; broken sequences become U+FFFD."""
    return F.regexp_replace(F.decode(col, "UTF-8"), "^﻿", "")


def _label(raw, name: str):
    return F.regexp_extract(raw, rf"(?m)^[ \t]*\*\*{name}\*\*[ \t]*:[ \t]*(.*?)[ \t]*$", 1)


def headers(files: DataFrame) -> DataFrame:
    """Title, link and date from the head of each file: ``head`` of ``headers.scan_heads``, or the first bytes of ``content``."""
    head = F.decode(F.col("head") if "head" in files.columns else F.substring("content", 1, HEADER_BYTES), "UTF-8")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select(
        *[c for c in files.columns if c not in ("content", "head")],
        F.coalesce(T.blank_to_null(_label(head, TITLE)), stem).alias("title"),
        _label(head, LINK).alias("url"),
        F.coalesce(T.blank_to_null(_label(head, DATE)), F.lit(UNKNOWN)).alias("published_at"),
    )


def parse(df: DataFrame, raw: str, path: str) -> DataFrame:
    """Title, link, date, body and body hash of a page text."""
    text = F.col(raw)
    stem = F.regexp_extract(path, r"([^/]+)\.md$", 1)
    kept = F.filter(T.lines(text), lambda x: ~F.rlike(x, F.lit(rf"^\*\*({TITLE}|{LINK}|{DATE})\*\*\s*:")))
    return (
        df.withColumn("title", T.compact(F.coalesce(T.blank_to_null(_label(text, TITLE)), stem), 300))
        .withColumn("url", _label(text, LINK))
        .withColumn("published_at", F.coalesce(T.blank_to_null(_label(text, DATE)), F.lit(UNKNOWN)))
        .withColumn("text", F.array_join(kept, "\n"))
        .withColumn("text_hash", F.sha1(F.encode("text", "UTF-8")))
        .drop(*({raw} - {"text"}))
    )


def host_rules(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """``site, allow, deny, titles``: path and title rules per host."""
    if rules is None:
        sites = {**HOST_ALLOWED_PATHS, **HOST_REJECT_PATHS, **HOST_REJECT_TITLES}
        rules = [
            (s, [p.lower() for p in HOST_ALLOWED_PATHS.get(s, ("/",))], [p.lower() for p in HOST_REJECT_PATHS.get(s, ())],
             [t.lower() for t in HOST_REJECT_TITLES.get(s, ())])
            for s in sites
        ]
    return spark.createDataFrame(rules, "site string, allow array<string>, deny array<string>, titles array<string>")


# fixed values: hosts whose pages lie below a user's folder, and first folders there that hold no pages
PROJECT_HOSTS = ("www.hackster.io", "hackster.io", "oshwlab.com")
NO_PROJECTS = {"www.hackster.io": ("live", "contests", "channels", "products"), "hackster.io": ("live", "contests", "channels", "products")}


def path_rules(site, path, html_hosts: tuple[str, ...] = (), project_hosts: tuple[str, ...] = PROJECT_HOSTS, no_projects: dict[str, tuple[str, ...]] = NO_PROJECTS):
    """Whether a lower-case path suits its host: an ``.html`` page where these are asked for, a page below a user's folder where profiles lie at the top."""
    segments = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    fits = ~site.isin(*html_hosts) | F.endswith(path, F.lit(".html")) if html_hosts else F.lit(True)
    deep = ~site.isin(*project_hosts) | (F.size(segments) > 1) if project_hosts else F.lit(True)
    for host, firsts in no_projects.items():
        deep = deep & ~((site == host) & segments[0].isin(*firsts))
    return F.coalesce(fits & deep, F.lit(True))


def apply_host_rules(pages: DataFrame, rules: DataFrame, site: str, path: str, title: str, **paths) -> DataFrame:
    """Adds ``allowed``; hosts without rules pass, but for the rules of paths (``path_rules``)."""
    joined = pages.join(rules.withColumnRenamed("site", site), site, "left")
    hit = lambda terms, col: F.exists(terms, lambda t: F.contains(F.col(col), t))
    ok = hit("allow", path) & ~hit("deny", path) & ~hit("titles", title)
    listed = F.col("allow").isNull() | ok
    return joined.withColumn("allowed", listed & path_rules(F.col(site), F.col(path), **paths)).drop("allow", "deny", "titles")
