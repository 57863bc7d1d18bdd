"""URL columns: host, path, canonical form, public-address test, redirects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

# scheme :// user@ host :port path
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (F.length(authority(url)) > 0)


def canonical(url: Column) -> Column:
    """Scheme, lower-case authority and path without trailing slashes; empty
    when the address is not a web address."""
    bare = F.regexp_replace(path(url), r"/+$", "")
    return F.when(is_web(url), F.concat(scheme(url), F.lit("://"), authority(url), bare)).otherwise(F.lit(""))


def host_matches(host_col: Column, hosts: tuple[str, ...]) -> Column:
    """Host equal to a listed one or below it.

    The parents of a host are few, so the test is a set lookup on its suffixes
    instead of one comparison per listed host.
    """
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.arrays_overlap(suffixes, F.array(*[F.lit(h) for h in hosts]))


def is_public(url: Column) -> Column:
    """Web address that does not point into a private network."""
    name = host(url)
    octet = F.regexp_extract
    quad = r"^([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$"
    first = F.expr("0") + F.coalesce(F.nullif(octet(name, quad, 1), F.lit("")).try_cast("int"), F.lit(-1))
    second = F.coalesce(F.nullif(octet(name, quad, 2), F.lit("")).try_cast("int"), F.lit(-1))
    private = (
        first.isin(10, 127)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | ((first == 169) & (second == 254))
    )
    named = name.isin("localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]")
    return scheme(url).isin("http", "https") & (F.length(name) > 0) & ~named & ~private


def is_unreadable(url: Column) -> Column:
    """Documents and slow hosts whose page is not fetched."""
    low = F.lower(url)
    # fixed values: address parts that mark a page as not worth fetching
    return F.rlike(
        low,
        F.lit(
            r"\.pdf($|[?#])|analog\.com/en/resources/technical-articles/|ti\.com/lit/"
            r"|onsemi\.com/products/|st\.com/en/"
        ),
    )


def redirect_target(url: Column) -> Column:
    """Follow the redirect wrappers of three result pages without fetching."""
    site = host(url)
    route = path(url)
    uddg = F.regexp_extract(url, r"[?&]uddg=([^&#]*)", 1)
    u = F.regexp_extract(url, r"[?&]u=([^&#]*)", 1)
    ru = F.regexp_extract(route, r"/RU=([^/]+)", 1)
    coded = F.when(F.startswith(url, F.lit("a1")) & F.rlike(url, F.lit("^a1[A-Za-z0-9_-]+$")), url).when(
        F.endswith(site, F.lit("bing.com")) & F.startswith(route, F.lit("/ck/")) & (u != ""), F.try_url_decode(u)
    )
    body = F.substring(coded, 3, 1 << 20)
    padded = F.rpad(
        F.translate(body, "-_", "+/"), (F.ceil(F.length(body) / F.lit(4.0)) * 4).cast("int"), F.lit("=")
    )
    plain = F.try_to_binary(padded, F.lit("base64"))
    decoded = F.decode(plain, "UTF-8")
    return (
        F.when(F.length(F.regexp_replace(url, f"{WS}+", "")) == 0, F.lit(""))
        .when(
            F.endswith(site, F.lit("duckduckgo.com")) & F.startswith(route, F.lit("/l/")) & (uddg != ""),
            F.try_url_decode(uddg),
        )
        .when(
            coded.isNotNull() & F.rlike(coded, F.lit("^a1[A-Za-z0-9_-]+$")) & F.rlike(decoded, F.lit("^https?://")),
            decoded,
        )
        .when(coded.isNotNull(), coded)
        .when(F.endswith(site, F.lit("search.yahoo.com")) & (ru != ""), F.try_url_decode(ru))
        .otherwise(url)
    )
