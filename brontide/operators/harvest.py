"""Landed responses of portals: protocols, items, statuses, account lists."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths by which a portal's protocol is probed, in the order that counts.
PROBES = (("ckan", ("/api/3/action/package_list",)), ("openapi", ("/v2/api-docs", "/swagger.json", "/openapi.json", "/v3/api-docs")), ("sitemap", ("/sitemap.xml",)), ("jsonld", ("/",)), ("generic", ("/",)))
#: Pairs of words that mark a waiting room's page; an empty second word always holds.
WAITING = (("waitingroom", "main.html"), ("대기실", "접속"), ("대기실", "트래픽"), ("접속 대기", ""), ("잠시 대기", ""), ("트래픽 과부하", ""), ("서비스 대기", ""), ("please wait", "traffic"), ("waiting room", ""), ("대기 중", "과부하"), ("서비스 점검", "대기"))


def matches_protocol(protocol: str, body: Column) -> Column:
    """Whether a landed body answers a protocol's probe."""
    has = lambda p: F.get_json_object(body, p)
    return {
        "ckan": (has("$.success") == "true") & F.ltrim(has("$.result")).startswith("["),
        "openapi": F.ltrim(has("$.paths")).startswith("{") & F.coalesce(has("$.swagger"), has("$.openapi")).isNotNull(),
        "sitemap": F.coalesce(body, F.lit("")).rlike(r"(?s)<(\w+:)?(urlset|sitemapindex)\b.*<(\w+:)?loc>"),
        "jsonld": F.coalesce(body, F.lit("")).rlike(r'(?is)application/ld\+json.*"@type"\s*:\s*\[?\s*"[^"]*dataset"'),
        "generic": F.coalesce(body, F.lit("")).rlike("(?i)<html"),
    }[protocol]


def harvest(responses: DataFrame) -> DataFrame:
    """responses (host, path, body): (host, protocol, path) of the first probe that matches; "none" where none does."""
    hit = F.lit(None).cast("struct<ord:int,protocol:string>")
    n = 0
    for protocol, paths in reversed(PROBES):
        for p in reversed(paths):
            n += 1
            rank = F.struct(F.lit(100 - n).cast("int").alias("ord"), F.lit(protocol).alias("protocol"))
            hit = F.when((F.col("path") == p) & F.coalesce(matches_protocol(protocol, F.col("body")), F.lit(False)), rank).otherwise(hit)
    marked = responses.withColumn("hit", hit)
    best = marked.groupBy("host").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("hit", "path"))).alias("b"))
    return best.select("host", F.coalesce("b.hit.protocol", F.lit("none")).alias("protocol"), F.col("b.path").alias("path"))


def items_of(protocol: str, body: Column, base: Column) -> Column:
    """array<struct<name, url>> of a landed body: datasets, the specification's title, or a sitemap's locations."""
    item = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    if protocol == "ckan":
        return F.transform(F.from_json(F.get_json_object(body, "$.result"), "array<string>"), lambda n: item(n, F.concat(base, F.lit("/dataset/"), n)))
    if protocol == "openapi":
        return F.array(item(F.coalesce(F.get_json_object(body, "$.info.title"), base), base))
    places = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    name = lambda u: F.when(F.regexp_extract(u, "([^/]*)$", 1) != "", F.regexp_extract(u, "([^/]*)$", 1)).otherwise(u)
    return F.transform(places, lambda u: item(name(u), u))


def waiting_room(url: Column, content_type: Column, body: Column) -> Column:
    """Whether a response is a waiting room's page: by its URL, or by words in HTML that is no JSON."""
    low = F.lower(F.coalesce(body, F.lit("")))
    pairs = reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) & F.contains(low, F.lit(s)) for p, s in WAITING))
    by_url = F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("waitingroom"))
    return by_url | (F.try_parse_json(body).isNull() & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")) & pairs)


def scan_status(code: Column, body: Column, waiting: Column) -> Column:
    """success, not_found, timeout, waiting_room_timeout or error of a landed response; code 0 stands for no answer."""
    return F.when(waiting, "waiting_room_timeout").when((code == 200) & (F.coalesce(body, F.lit("")) != ""), "success").when(code == 404, "not_found").when(code == 0, "timeout").otherwise("error")


#: Outcomes of a try, the best first; a later try may only better the outcome.
OUTCOMES = ("success", "not_found", "waiting_room_timeout", "timeout", "error")


def settled(tries: DataFrame, id: str, attempt: str, status: str, most: int = 3) -> DataFrame:
    """(id, status, attempts, retry) of each id's landed tries: the best outcome so far, and whether to try again.

    success and not_found are final; any other outcome is tried again until there
    have been `most` tries.  A status that is none of OUTCOMES counts as error.
    """
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col(status))
    known = F.when(rank > 0, rank).otherwise(len(OUTCOMES))
    out = tries.groupBy(id).agg(F.min(known).alias("rank"), F.countDistinct(attempt).alias("attempts"))
    name = F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("rank").cast("int"))
    return out.select(id, name.alias(status), "attempts", ((F.col("rank") > 2) & (F.col("attempts") < most)).alias("retry"))


def rejection(url: Column) -> Column:
    """Why a URL must not be fetched, judged without looking up names: scheme, host, loopback, link_local, private, special; else null."""

    @F.pandas_udf("string")
    def of_address(hosts: pd.Series) -> pd.Series:
        def why(h: str) -> str | None:
            try:
                ip = ipaddress.ip_address((h or "").strip("[]"))
            except ValueError:
                return None
            kinds = (("loopback", ip.is_loopback), ("link_local", ip.is_link_local), ("private", ip.is_private), ("special", ip.is_multicast or ip.is_reserved or ip.is_unspecified))
            return next((k for k, yes in kinds if yes), None)

        return hosts.map(why)

    u = F.trim(F.coalesce(url, F.lit("")))
    authority = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.$", ""))
    return F.when(~u.rlike("(?i)^https?://"), "scheme").when(host == "", "host").otherwise(of_address(host))


def account_page(html: Column) -> Column:
    """struct<rows, pages, total> of an account list's page: arguments of detail calls, page numbers, declared total."""
    calls = F.array_distinct(F.regexp_extract_all(html, F.lit(r"fn_?[dD]etail\(([^)]*)\)"), 1))
    rows = F.transform(calls, lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"'([^']*)'|(\d+)"), 0), lambda a: F.replace(a, F.lit("'"), F.lit(""))))
    pages = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?:fn_?page|goPage|linkPage)\((\d+)\)"), 1), lambda p: p.cast("int"))))
    total = F.regexp_replace(F.regexp_extract(html, r'(?s)class="[^"]*total[^"]*"[^>]*>\D*([\d,]+)', 1), ",", "").try_cast("int")
    return F.struct(rows.alias("rows"), pages.alias("pages"), total.alias("total"))
