"""URL, HTTP header and log-line expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brontide.functions.text import trim

#: Hosts that are no external endpoint, and path segments that hint at one.
EXCLUDED_HOSTS = ("data.go.kr", "www.data.go.kr", "schema.org", "www.w3.org", "jquery.com")
ENDPOINT_PATH = r"(?i)/(openapi|api|service|services|rest|open-api|v\d+)\d*(/|$)"
#: Pages of the portal by type of data.
PAGES = {"openapi": "openapi.do", "fileData": "fileData.do", "standard": "standard.do"}
_PROGRESS = r"^\s*(.*?)\s*:?\s*(\d{1,3})%\|[^|]*\|\s*(\d+)/(\d+)"


def host(url: Column) -> Column:
    """The host of an absolute URL, lower-cased, without user, port and trailing dot; empty without one."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"\.?(:\d*)?$", ""))


def without_fragment(url: Column) -> Column:
    """The URL with its scheme lower-cased and its fragment gone."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    scheme = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.concat(F.lower(scheme), F.substring(plain, F.length(scheme) + 1, F.length(plain)))


def external_endpoints(html: Column) -> Column:
    """Distinct URLs in a page, in order, whose path hints at a service and whose host is not excluded."""
    text = F.replace(F.replace(F.coalesce(html, F.lit("")), F.lit("&amp;"), F.lit("&")), F.lit("\\/"), F.lit("/"))
    found = F.transform(F.regexp_extract_all(text, F.lit("(?i)https?://[^\\s<>\"'`]+"), 0), lambda u: F.regexp_replace(u, r"[.,;:)\]}\\]+$", ""))
    path = lambda u: F.regexp_extract(u, "^[^:]+://[^/?#]*([^?#]*)", 1)
    good = F.filter(found, lambda u: (host(u) != "") & ~host(u).isin(*EXCLUDED_HOSTS) & ~F.endswith(host(u), F.lit(".data.go.kr")) & path(u).rlike(ENDPOINT_PATH))
    return F.array_distinct(F.transform(good, without_fragment))


def api_id(url: Column) -> Column:
    """The number after /data/, else a slug of the URL."""
    number = F.regexp_extract(url, r"/data/(\d+)/", 1)
    slug = F.replace(F.replace(F.replace(url, F.lit("https://")), F.lit("http://")), F.lit("/"), F.lit("_"))
    return F.when(number != "", number).otherwise(F.concat(F.lit("api_"), slug))


def portal_url(number: Column, kind: Column) -> Column:
    page = F.lit(PAGES["openapi"])
    for k, p in PAGES.items():
        page = F.when(kind == k, p).otherwise(page)
    return F.concat(F.lit("https://www.data.go.kr/data/"), number.cast("string"), F.lit("/"), page)


def base_url(schemes: Column, host_: Column, path: Column) -> Column:
    """scheme://host/path of a specification, https by default; empty without a host."""
    scheme = F.coalesce(F.get(schemes, 0), F.lit("https"))
    return F.when(F.coalesce(host_, F.lit("")) == "", "").otherwise(F.concat(scheme, F.lit("://"), host_, F.coalesce(path, F.lit(""))))


def without_script(c: Column) -> Column:
    """A cell without script that leaked into it: a backquote and what follows from the next `var` on."""
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)`\s*var\s+.*$", ""))


def progress(line: Column) -> Column:
    """struct<label, done, total, percent> of a progress bar's line, null for other lines."""
    g = lambda i: F.regexp_extract(line, _PROGRESS, i)
    total, done = g(4).try_cast("bigint"), g(3).try_cast("bigint")
    label = F.when(trim(g(1)) == "", "진행 중").otherwise(trim(g(1)))
    return F.when(total > 0, F.struct(label.alias("label"), done.alias("done"), total.alias("total"), F.round(done * 100 / total, 1).alias("percent")))


def lines(c: Column) -> Column:
    """Split at line ends of every kind, a lone carriage return included."""
    return F.split(c, "\r\n|\n|\r")


def response_filename(disposition: Column, url: Column, fallback: str = "download.bin") -> Column:
    """The file name of a Content-Disposition, extended form first, else the URL's last segment."""
    extended = F.url_decode(F.replace(F.regexp_extract(disposition, r"(?i)filename\*=UTF-8''([^;]+)", 1), F.lit("+"), F.lit("%2B")))
    plain = F.regexp_extract(disposition, r'(?i)filename\s*=\s*"?([^";]+)', 1)
    last = F.regexp_extract(url, r"^[^:]+://[^/?#]*(?:/[^?#/]*)*/([^?#/]+)/?(?:[?#].*)?$", 1)
    pick = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c))
    return F.coalesce(pick(extended), pick(plain), pick(last), F.lit(fallback))


def safe_filename(c: Column) -> Column:
    """The last segment with characters that file systems refuse replaced; never empty."""
    name = F.regexp_replace(F.regexp_replace(c, "^.*/", ""), r'[<>:"/\\|?*\x00-\x1f]', "_")
    name = F.regexp_replace(name, "^[ .]+|[ .]+$", "")
    return F.when(name == "", "download.bin").otherwise(name)


def content_length(content_range: Column, length: Column) -> Column:
    """The total of a Content-Range, else Content-Length, else null."""
    total = F.regexp_extract(F.coalesce(content_range, F.lit("")), r"/(\d+)$", 1)
    return F.coalesce(F.when(total != "", total), length).try_cast("bigint")


def sniff_format(path: Column, head: Column, mime: Column | None = None) -> Column:
    """xlsx, zip, json, tsv, csv, text or unknown: by suffix, by the first characters, and by the MIME type where these say nothing."""
    p = F.lower(F.coalesce(path, F.lit("")))
    out = F.when(head.startswith("PK"), F.when(p.endswith(".xlsx"), "xlsx").otherwise("zip"))
    for suffix, kind in (("xlsx", "xlsx"), ("zip", "zip"), ("json", "json"), ("geojson", "json"), ("tsv", "tsv"), ("csv", "csv")):
        out = out.when(p.endswith("." + suffix), kind)
    out = out.when(F.ltrim(head).rlike(r"^[\[{]"), "json").when(p.endswith(".txt"), "text")
    if mime is not None:
        said = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
        out = out.when(F.contains(said, F.lit("json")), "json").when(F.contains(said, F.lit("tab-separated-values")), "tsv").when(said.startswith("text/") | F.contains(said, F.lit("csv")), "csv")
    return out.otherwise("unknown")
