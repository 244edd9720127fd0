"""Text expressions: tokens, cleaning, intents, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two kinds of runs that tokens are made of.
ASCII_WORD = "[a-z0-9]+"
CJK_RUN = "[가-힣ㄱ-ㆎ一-鿿]+"
#: What joins two intents of one query.
CONNECTORS = r"\s*[,/+]\s*|\s+(?:및|또는|하고)\s+|(?<=[가-힣])(?:와|과)\s+"
#: Every character that trims away: \s of Unicode, so that no-break and ideographic spaces count.
_EDGES = r"(?U)^\s+|\s+$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenize(c: Column) -> Column:
    """Lower-cased ASCII words, then every CJK run as bigrams (a run of one character as it is)."""

    def tokens(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(ASCII_WORD), 0)
        runs = F.regexp_extract_all(low, F.lit(CJK_RUN), 0)
        pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
        return F.concat(words, F.when(low.rlike(CJK_RUN), F.flatten(F.transform(runs, pairs))).otherwise(F.array().cast("array<string>")))

    return let(F.lower(F.coalesce(c.cast("string"), F.lit(""))), tokens)


def clean_markup(c: Column) -> Column:
    """Tags become spaces, white space is collapsed; null and "-" become empty."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " ")
    text = trim(text)
    return F.when(text == "-", "").otherwise(text)


def strip_markup(c: Column) -> Column:
    """Tags vanish, runs of spaces and tabs are collapsed, line ends stay."""
    return trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""), "[ \\t]+", " "))


def compact(c: Column) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def intents(c: Column) -> Column:
    """The whole query, and after it its parts of at least two characters if there are two of them; distinct, in order."""
    whole = trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(whole, CONNECTORS), trim), lambda p: F.length(p) >= 2)
    none = F.array().cast("array<string>")
    return F.when(whole == "", none).when(F.size(parts) < 2, F.array(whole)).otherwise(F.array_distinct(F.concat(F.array(whole), parts)))


#: Forms of a service id, and the sources there are.
_CANONICAL, _PLAIN = r"^[a-z][a-z0-9_]*:[A-Za-z0-9][A-Za-z0-9_-]*$", r"^\d+$"
SOURCES = ("openapi_new",)


def service_id(c: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """struct<id, source, api_id, error>: the canonical id source:api_id, or the code of what is wrong.

    A number alone gets the first source.
    """
    raw = trim(F.coalesce(c.cast("string"), F.lit("")))
    whole = raw.rlike(_CANONICAL)
    error = F.when(raw.rlike(_PLAIN), None).when(~whole, "INVALID_SERVICE_ID").when(~F.substring_index(raw, ":", 1).isin(*sources), "UNSUPPORTED_SOURCE")
    canonical = F.when(whole, raw).otherwise(F.concat(F.lit(sources[0] + ":"), raw))
    ok = lambda v: F.when(error.isNull(), v)
    return F.struct(ok(canonical).alias("id"), ok(F.substring_index(canonical, ":", 1)).alias("source"), ok(F.regexp_replace(canonical, "^[^:]*:", "")).alias("api_id"), error.alias("error"))


def top_category(c: Column, default: str = "기타") -> Column:
    """What stands before " - ", or default."""
    head = trim(F.substring_index(F.coalesce(c, F.lit("")), " - ", 1))
    return F.when(head == "", default).otherwise(head)


def keywords(c: Column) -> Column:
    """Parts between commas, ASCII or full width, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，]"), trim), lambda k: k != "")


#: The marks besides white space that part the words of a law's name.
_LAW_MARKS = "()·ㆍ,;:/"


def significant_tokens(c: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words of two characters and more that are not stop words; words end at white space and eight marks."""
    words = F.split(F.coalesce(c, F.lit("")), f"(?U)[\\s{_LAW_MARKS}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)))


def export_filename(name: Column, fmt: str) -> Column:
    """A safe file name that ends in the format's extension."""
    kind = (fmt or "JSON").strip().lower()
    ext = "xls" if kind == "xlsx" else kind
    base = F.regexp_replace(F.regexp_replace(trim(F.coalesce(name, F.lit("result"))), r'[\\/:*?"<>|]+', "-"), r"\s+", "_")
    base = F.when(base == "", "result").otherwise(base)
    return F.when(F.endswith(F.lower(base), F.lit("." + ext)), base).otherwise(F.concat(base, F.lit("." + ext)))


#: How many fields and endpoints of a document a prompt names, and the lines around its documents.
PROMPT_FIELDS, PROMPT_ENDPOINTS = 12, 3
PROMPT_HEAD = "다음 공공 API 문서들을 서로 다른 논리 노드의 입력으로 보고, 단일 API만으로는 알 수 없는 조합 활용 방안을 도출하라."
PROMPT_TAIL = ("출력 형식:", "1. 조합 가능한 서비스 아이디어", "2. 어떤 API 필드를 어떻게 연결하는지", "3. 이종 도메인 결합으로 생기는 새 가치", "4. 구현 시 필요한 추가 조건")


def prompt_block(place: Column, doc: Column) -> Column:
    """A document's part of a prompt.  doc: struct<name, provider, category, keywords, description, fields<key, desc>, endpoints<method, path, description>>."""
    some = lambda c, n, line, none: F.when(F.size(c) > 0, F.array_join(F.transform(F.slice(c, 1, n), line), "\n")).otherwise(none)
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))
    return F.concat_ws(
        "\n",
        say("API ", place.cast("string"), ". ", doc["name"]),
        say("제공기관: ", doc["provider"]),
        say("도메인: ", doc["category"]),
        say("키워드: ", dash(F.array_join(doc["keywords"], ", "))),
        say("설명: ", dash(doc["description"])),
        F.lit("제공 필드:"),
        some(doc["fields"], PROMPT_FIELDS, lambda f: say("- ", f["key"], ": ", f["desc"]), "- 필드 정보 없음"),
        F.lit("엔드포인트:"),
        some(doc["endpoints"], PROMPT_ENDPOINTS, lambda e: say("- ", e["method"], " ", e["path"], ": ", e["description"]), "- 엔드포인트 정보 없음"),
    )


def analysis_prompt(docs: Column, question: Column) -> Column:
    """The prompt about a selection of documents, an array of prompt_block's structs."""
    blocks = F.array_join(F.transform(docs, lambda d, i: prompt_block(i + 1, d)), "\n\n---\n\n")
    return F.concat_ws("\n", F.lit(PROMPT_HEAD), F.concat(F.lit("사용자 질문: "), question), F.lit(""), blocks, F.lit(""), *map(F.lit, PROMPT_TAIL))


def clip(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis if some were cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
