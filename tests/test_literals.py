"""Small literal inputs with answers that are known or that SQL works out: unit tests of the operators that the queries run over tables."""

import uuid  # noqa: F401

import pytest
from pyspark.sql import functions as F

from brontide.functions import scalars, text, web  # noqa: F401
from brontide.operators import catalog, chunks, harvest, ledger, payloads, profile, registry, review  # noqa: F401
from brontide.registry_of_queries import values
from brontide.sources import files  # noqa: F401
from brontide.streaming import ledger as streams  # noqa: F401
from tests.conftest import DATA, same_rows

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



# From queries_review

_ONE = "SELECT * FROM (VALUES {rows}) AS t({columns})"


_RESPONSES = """('a.kr', '/api/3/action/package_list', '{"success": true, "result": ["x", "y"]}'), ('a.kr', '/sitemap.xml', '<urlset><url><loc>http://a.kr/1</loc></url></urlset>'), ('b.kr', '/api/3/action/package_list', 'oops'), ('b.kr', '/openapi.json', '{"openapi": "3", "paths": {}, "info": {"title": "B"}}'), ('c.kr', '/sitemap.xml', '<urlset><url><loc> http://c.kr/p/1 </loc></url><url><loc>http://c.kr/q?a=1&amp;b=2</loc></url></urlset>'), ('d.kr', '/', '<html></html>'), ('e.kr', '/', '')"""


@query(_ONE.format(rows="('a.kr', 'ckan', '/api/3/action/package_list'), ('b.kr', 'openapi', '/openapi.json'), ('c.kr', 'sitemap', '/sitemap.xml'), ('d.kr', 'generic', '/'), ('e.kr', 'none', NULL)", columns="host, protocol, path"))
def portal_protocols(spark, d):
    return harvest.harvest(values(spark, _RESPONSES, "host, path, body"))


@query(_ONE.format(rows="('a.kr', 'x', 'http://a.kr/dataset/x'), ('a.kr', 'y', 'http://a.kr/dataset/y'), ('b.kr', 'B', 'http://b.kr'), ('c.kr', '1', 'http://c.kr/p/1'), ('c.kr', 'q?a=1&b=2', 'http://c.kr/q?a=1&b=2')", columns="host, name, url"))
def portal_items(spark, d):
    t = values(spark, _RESPONSES, "host, path, body")
    best = harvest.harvest(t).filter("protocol in ('ckan', 'openapi', 'sitemap')").join(t, ["host", "path"])
    base = F.concat(F.lit("http://"), F.col("host"))
    every = F.when(F.col("protocol") == "ckan", harvest.items_of("ckan", F.col("body"), base)).when(F.col("protocol") == "openapi", harvest.items_of("openapi", F.col("body"), base)).otherwise(harvest.items_of("sitemap", F.col("body"), base))
    return best.select("host", F.inline(every))


_SCANS = """(1, 200, 'u', 'text/html', '<p>접속 대기실</p>'), (2, 200, 'u/WaitingRoom', '', 'x'), (3, 200, 'u', 'text/html', '{"대기실": "접속"}'), (4, 404, 'u', '', ''), (5, 0, 'u', '', ''), (6, 500, 'u', '', ''), (7, 200, 'u', 'text/html', '')"""


@query(_ONE.format(rows="(1, 'waiting_room_timeout'), (2, 'waiting_room_timeout'), (3, 'success'), (4, 'not_found'), (5, 'timeout'), (6, 'error'), (7, 'error')", columns="id, status"))
def landed_status(spark, d):
    w = harvest.waiting_room(F.col("url"), F.col("kind"), F.col("body"))
    return values(spark, _SCANS, "id, code, url, kind, body").select("id", harvest.scan_status(F.col("code"), F.col("body"), w).alias("status"))


_TARGETS = "('http://127.0.0.1/x', 'loopback'), ('https://10.1.2.3', 'private'), ('http://169.254.1.1:80/', 'link_local'), ('http://[::1]/', 'loopback'), ('ftp://x.kr', 'scheme'), ('http://', 'host'), ('https://x.kr/a', NULL), ('http://8.8.8.8', NULL), ('http://224.0.0.1', 'special'), (NULL, 'scheme')"


@query(_ONE.format(rows=_TARGETS, columns="url, why"))
def fetch_targets(spark, d):
    return values(spark, _TARGETS, "url, expected").select("url", harvest.rejection(F.col("url")).alias("why"))


_ACCOUNTS = """<a href="#" onclick="fn_detail('A1', 3)">[승인] x</a><a onclick="fn_detail('A1', 3)">x</a><a onclick="fn_detail('B2', 4)">y</a>
<a onclick="goPage(2)">2</a><a onclick="goPage(1)">1</a><p class="total-count">총 1,234건</p>"""


@query(_ONE.format(rows="(1, 'A1/3|B2/4', '1,2', 1234)", columns="id, rows, pages, total"))
def account_list(spark, d):
    t = spark.createDataFrame([(1, _ACCOUNTS)], "id int, html string").select("id", harvest.account_page(F.col("html")).alias("p"))
    return t.select("id", F.array_join(F.transform("p.rows", lambda r: F.array_join(r, "/")), "|").alias("rows"), F.array_join(F.transform("p.pages", lambda x: x.cast("string")), ",").alias("pages"), F.col("p.total").alias("total"))


@query(_ONE.format(rows="(1, 'selected-subset-of-details', 'c'), (1, 'selected-in-search', 'b'), (1, 'relations-not-skipped', 'relations'), (1, 'plan-missing-reported', 'm2'), (1, 'contract-limits', 'too many'), (1, 'contract-limits', 'repeated'), (2, 'contract-limits', 'stage order')", columns="run, rule, subject"))
def critic_findings(spark, d):
    v = lambda rows, c: values(spark, rows, c)
    return review.critic(
        v("(1, 'a'), (1, 'b'), (1, 'c'), (1, 'a'), (2, 'a')", "run, id"),
        v("(1, 'a'), (1, 'b'), (2, 'a')", "run, id"),
        v("(1, 'a'), (1, 'c'), (2, 'a')", "run, id"),
        v("(1, 1, 'search', 'ok'), (1, 2, 'relations', 'skipped'), (2, 1, 'detail', 'ok'), (2, 2, 'search', 'ok')", "run, ord, name, status"),
        v("(1, 'm1'), (1, 'm2')", "run, item"),
        v("(1, 'lost m1 here')", "run, text"),
    )


@query(_ONE.format(rows="(1, 'contradiction'), (2, 'evidence_gap')", columns="run, verdict"))
def critic_verdicts(spark, d):
    return review.verdict(critic_findings(spark, d), ("selected-in-search",))


@query(_ONE.format(rows="('dangling-edge', '1>9'), ('support-cycle', '2>3'), ('support-cycle', '4'), ('unsupported-claim', '1'), ('unsupported-claim', '5'), ('unresolved-conflict', '1'), ('unresolved-conflict', '5')", columns="code, subject"))
def argument_findings(spark, d):
    nodes = values(spark, "(1, 'claim'), (2, 'claim'), (3, 'claim'), (4, 'claim'), (5, 'claim'), (6, 'premise')", "node, kind")
    edges = values(spark, "(1, 9, 'support'), (2, 3, 'support'), (3, 2, 'support'), (4, 4, 'support'), (1, 5, 'attack'), (5, 1, 'attack'), (6, 3, 'support')", "src, dst, kind")
    return review.judge_arguments(nodes, edges)


def _process(spark):
    nodes = values(spark, "('a', 'L1', 'S1', 'task', 0.9D), ('b', 'L1', 'S2', 'task', 0.5D), ('c', 'L1', 'S1', 'gate', 1.5D), ('d', 'L1', 'S2', 'task', 0.7D), ('e', 'L1', 'S2', 'odd', 0.7D), ('f', 'L1', 'S2', 'task', 0.7D)", "node, lane, stage, type, confidence")
    edges = values(spark, "('a', 'b', 'sequence'), ('b', 'c', 'sequence'), ('e', 'f', 'sequence'), ('f', 'e', 'sequence'), ('a', 'z', 'sequence')", "src, dst, type")
    return nodes, edges


@query(_ONE.format(rows="('orphan-node', 'd'), ('unreachable-node', 'e'), ('unreachable-node', 'f'), ('backward-sequence', 'b>c'), ('empty-lane', 'L2'), ('empty-stage', 'S3')", columns="rule, subject"))
def process_audit(spark, d):
    return review.audit_process(*_process(spark), values(spark, "('L1'), ('L2')", "lane"), values(spark, "('S1', 1), ('S2', 2), ('S3', 3)", "stage, ord"))


@query(_ONE.format(rows="('unknown-end', 'a>z'), ('type-not-allowed', 'e'), ('confidence-out-of-range', 'c')", columns="rule, subject"))
def registry_validation(spark, d):
    return review.validate_registry(*_process(spark), {"type": ("task", "gate")}, {"confidence": (0, 1)})


@query(_ONE.format(rows="('repeated', 'a'), ('unknown', 'z'), ('own', 'b'), ('cycle', 'c'), ('cycle', 'd'), ('cycle', 'e')", columns="rule, subject"))
def dag_validation(spark, d):
    return review.validate_dag(values(spark, "('a'), ('a'), ('b'), ('c'), ('d'), ('e')", "node"), values(spark, "('z', 'a'), ('b', 'b'), ('c', 'd'), ('d', 'c'), ('d', 'e')", "src, dst"))


@query(_ONE.format(rows="(1, 'u1'), (2, 'u2'), (3, 'u3')", columns="id, item"))
def unresolved_sources(spark, d):
    laws = values(spark, "(1, '「시설 안전 관리법」'), (2, '서울시 주차장 조례'), (3, '환경 오염 대응 매뉴얼 및 편람'), (4, '민법')", "id, law")
    return review.unresolved_matches(laws, values(spark, "('u1', '시설안전관리법', 'internal-rule'), ('u2', '지역 조례', 'local-scope'), ('u3', '환경 업무', 'external-official-document'), ('u4', '다른 것', 'external-official-document')", "item, name, reason"))


@query(_ONE.format(rows="(1, 'u1'), (1, 'u2'), (2, 'u3'), (3, 'u1'), (3, 'u4'), (5, 'u2')", columns="id, url"))
def law_source_sets(spark, d):
    """Composites, aliases either way, and laws with what is below them."""
    citations = values(spark, "(1, '난민법 및 행정소송법'), (2, '공정거래법'), (3, '난민법 및 하위법령'), (4, '없는법'), (5, '「행정 소송법」')", "id, law")
    sources = values(spark, "('u1', '난민법', NULL), ('u2', '행정소송법', NULL), ('u3', '독점규제 및 공정거래에 관한 법률', NULL), ('u4', '시행 안내', '난민법 시행령')", "url, name, official")
    return registry.find_sources(citations, sources, values(spark, "('공정거래법', '독점규제 및 공정거래에 관한 법률')", "alias, official"))


# From queries_catalog

@query("SELECT id, string_agg(coalesce(n, t), ',' ORDER BY i) AS names FROM (SELECT id, i, tags[i] AS t FROM (SELECT id, string_split(t, '+') AS tags FROM (VALUES (1, 'a+b+z'), (2, 'b')) AS t(id, t)), range(1, 4) AS r(i) WHERE i <= len(tags)) LEFT JOIN (VALUES ('a', '대기'), ('b', '물')) AS c(k, n) ON t = k GROUP BY id")
def tag_concepts(spark, d):
    tags = values(spark, "(1, 'a+b+z'), (2, 'b')", "id, t").select("id", F.posexplode(F.split("t", r"\+")).alias("i", "tag"))
    names = values(spark, "('a', '대기'), ('b', '물')", "k, n")
    j = tags.join(names, F.col("tag") == F.col("k"), "left")
    return j.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", "tag").alias("n")))), lambda x: x["n"]), ",").alias("names"))


@query("SELECT id, array_to_string(list_sort(list_intersect(string_split(a, ','), string_split(b, ','))), ',') AS shared, list_sort(string_split(a, ',')) = list_sort(string_split(b, ',')) AS same FROM (VALUES (1, 'x,y,z', 'z,x'), (2, 'p,q', 'q,p'), (3, 'a', 'b')) AS t(id, a, b)")
def key_intersection(spark, d):
    t = values(spark, "(1, 'x,y,z', 'z,x'), (2, 'p,q', 'q,p'), (3, 'a', 'b')", "id, a, b").select("id", F.split("a", ",").alias("a"), F.split("b", ",").alias("b"))
    same = (F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)
    return t.select("id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"), same.alias("same"))


@query("SELECT r, n::BIGINT AS number FROM (VALUES (1, ' 15000001 ', 'x', 15000001), (2, 'abc', '1234567', 1234567), (3, 'abc', '12', NULL)) AS t(r, a, b, n)")
def doc_number(spark, d):
    t = values(spark, "(1, ' 15000001 ', 'x'), (2, 'abc', '1234567'), (3, 'abc', '12')", "r, a, b")
    return t.select("r", files.doc_number(F.col("a"), F.array("a", "b")).alias("number"))


_SNIFF = "('a.XLSX', 'PK..'), ('b.bin', 'PK..'), ('c.json', 'x'), ('d.dat', ' [1]'), ('e.tsv', 'a'), ('f.csv', 'a'), ('g.txt', 'a'), ('h', 'a')"


@query(f"SELECT p AS path, CASE WHEN h LIKE 'PK%' THEN CASE WHEN lower(p) LIKE '%.xlsx' THEN 'xlsx' ELSE 'zip' END WHEN p LIKE '%.json' THEN 'json' WHEN p LIKE '%.tsv' THEN 'tsv' WHEN p LIKE '%.csv' THEN 'csv' WHEN trim(h)[1] IN ('[', '{{') THEN 'json' WHEN p LIKE '%.txt' THEN 'text' ELSE 'unknown' END AS format FROM (VALUES {_SNIFF}) AS t(p, h)")
def format_sniff(spark, d):
    return values(spark, _SNIFF, "path, head").select("path", web.sniff_format(F.col("path"), F.col("head")).alias("format"))


_DOCS = "('1', '대기질 정보', 'Spec A', '환경부', '환경 - 대기', '미세먼지, 대기 ,', '<b>측정</b> 값', '2024-01-02'), ('2', '-', 'Spec B', '-', '교통', '', '설명', ''), ('3', '', '', '국토부', '', 'x', '-', '-')"


def _documents(spark):
    t = values(spark, _DOCS, "api_id, name, spec_title, provider, category, words, note, updated")
    info = F.create_map(*(x for k, c in (("목록명", "name"), ("제공기관", "provider"), ("분류체계", "category"), ("키워드", "words"), ("설명", "note"), ("수정일", "updated")) for x in (F.lit(k), F.col(c))))
    return t.select("api_id", info.alias("info"), "spec_title", F.lit("").alias("spec_description"), F.concat(F.lit("https://p.kr/"), "api_id").alias("crawled_url"))


@query(f"""SELECT 'openapi_new:' || a AS service_id, CASE WHEN n NOT IN ('', '-') THEN n ELSE s END AS name, trim(regexp_replace(regexp_replace(replace(d, '-', ''), '<[^>]+>', ' ', 'g'), ' +', ' ', 'g')) AS description, replace(p, '-', '') AS provider, c AS category,
array_to_string(list_filter(list_transform(string_split(k, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords, CASE WHEN u = '-' THEN '' ELSE u END AS updated_at, 'https://p.kr/' || a AS url FROM (VALUES {_DOCS}) AS t(a, n, s, p, c, k, d, u)""")
def catalog_details(spark, d):
    return catalog.details(_documents(spark)).withColumn("keywords", F.array_join("keywords", "|"))


@query("SELECT id, CASE WHEN trim(coalesce(a, '')) <> '' THEN trim(a) WHEN trim(coalesce(b, '')) <> '' THEN trim(b) ELSE '' END AS v FROM (VALUES (1, ' x ', 'y'), (2, ' ', 'y'), (3, NULL, NULL)) AS t(id, a, b)")
def coalesce_fields(spark, d):
    t = values(spark, "(1, ' x ', 'y'), (2, ' ', 'y'), (3, NULL, NULL)", "id, a, b")
    return t.select("id", catalog.present(text.trim(F.col("a")), text.trim(F.col("b"))).alias("v"))


@query("SELECT step, spec IS NOT NULL AS known FROM (VALUES ('s1', 'mail', 1), ('s2', 'mail', 2), ('s3', 'file', 1)) AS p(step, op, v) LEFT JOIN (VALUES ('mail', 1, 'x'), ('file', 1, 'y')) AS o(op, v, spec) USING (op, v)")
def plan_operations(spark, d):
    p, o = values(spark, "('s1', 'mail', 1), ('s2', 'mail', 2), ('s3', 'file', 1)", "step, op, v"), values(spark, "('mail', 1, 'x'), ('file', 1, 'y')", "op, v, spec")
    return p.join(o, ["op", "v"], "left").select("step", F.col("spec").isNotNull().alias("known"))


@query("SELECT path, size_bytes, sha256(c) AS checksum FROM (VALUES ('a', 'alpha', 5), ('b', '', 0)) AS t(path, c, size_bytes)")
def crawl_manifest(spark, d):
    return files.manifest(values(spark, "('a', 'alpha'), ('b', '')", "path, c").select("path", F.col("c").cast("binary").alias("content")))


@query("SELECT id, id IN (1, 3, 4, 5) AS load FROM (VALUES (1), (2), (3), (4), (5)) AS t(id)")
def change_gate(spark, d):
    t = values(spark, "(1, '2024-02-01', '2024-01-01', true, false), (2, '2024-01-01', '2024-01-01', true, false), (3, '2024-01-01', NULL, true, false), (4, '2024-01-01', '2024-01-01', false, false), (5, '2024-01-01', '2024-01-01', true, true)", "id, page, stored, targets, forced")
    return t.select("id", ledger.change_gate(F.col("page"), F.col("stored"), F.col("targets"), F.col("forced")).alias("load"))


@query("SELECT id, m AS missing FROM (VALUES (1, 'b'), (2, '')) AS t(id, m)")
def dry_run_missing(spark, d):
    t = values(spark, "(1, 'a,b', 'a'), (2, 'a', 'a,c')", "id, need, have")
    inputs = F.map_from_entries(F.transform(F.split("have", ","), lambda x: F.struct(x, F.lit("v"))))
    return t.select("id", F.array_join(ledger.missing_inputs(F.split("need", ","), inputs), ",").alias("missing"))


@query("SELECT step, CASE WHEN v IS NULL THEN 'missing' WHEN k = 'integer' AND try_cast(v AS BIGINT) IS NULL THEN 'type' WHEN length(v) > n THEN 'length' WHEN NOT regexp_full_match(v, p) THEN 'pattern' ELSE 'ok' END AS verdict FROM (VALUES ('a', '12', 'integer', 5, '[0-9]+'), ('b', 'x', 'integer', 5, '.*'), ('c', 'toolong', 'string', 3, '.*'), ('d', 'Q', 'string', 3, '[a-z]'), ('e', NULL, 'string', 3, '.*')) AS t(step, v, k, n, p)")
def plan_validation(spark, d):
    t = values(spark, "('a', '12', 'integer', 5, '[0-9]+'), ('b', 'x', 'integer', 5, '.*'), ('c', 'toolong', 'string', 3, '.*'), ('d', 'Q', 'string', 3, '[a-z]'), ('e', NULL, 'string', 3, '.*')", "step, v, k, n, p")
    return t.select("step", payloads.input_verdict(F.col("v"), F.col("k"), F.col("n"), F.col("p")).alias("verdict"))


@query("""SELECT id, sha256(b) AS hash FROM (VALUES (1, '{"a":"1","b":"x"}'), (2, '{"k":"say ' || chr(92) || '"hi' || chr(92) || '""}')) AS t(id, b)""")
def canonical_hash(spark, d):
    t = values(spark, "(1, 'b', 'x', 'a', '1'), (2, 'k', 'say \"hi\"', 'content_hash', 'zz')", "id, k1, v1, k2, v2")
    return t.select("id", ledger.canonical_hash(F.create_map("k1", "v1", "k2", "v2")).alias("hash"))


# From queries_search

_CJK = "(1, '미세먼지 API v2'), (2, '물 관리'), (3, 'Air-Quality 대기질'), (4, '')"


@query(f"""WITH t AS (SELECT * FROM (VALUES {_CJK}) AS t(id, s)), r AS (SELECT id, regexp_extract_all(lower(s), '[a-z0-9]+') AS w, regexp_extract_all(s, '[가-힣]+') AS c FROM t)
SELECT id, array_to_string(list_concat(w, flatten(list_transform(c, lambda x: CASE WHEN length(x) = 1 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) END))), ' ') AS tokens FROM r""")
def tokenize_cjk(spark, d):
    return values(spark, _CJK, "id, s").select("id", F.array_join(text.tokenize(F.col("s")), " ").alias("tokens"))


@query()
def split_intents(spark, d):
    return values(spark, "(1, '미세먼지 및 날씨'), (2, '병원과 약국 위치, 주차장'), (3, 'a/b+cd')", "id, s").select("id", F.array_join(text.intents(F.col("s")), "|").alias("intents"))


_MISSING = "('', 'null', 'none', 'nil', 'na', 'n/a', 'nan', '-')"


_SMALL = "(1, 'count', '1'), (2, 'count', 'oops'), (3, 'count', '3'), (4, 'count', ' '), (5, 'count', '4'), (6, 'count', '200'), (7, 'count', '2'), (8, 'count', '1,000'), (1, 'flag', 'Y'), (2, 'flag', 'no'), (1, 'when', '2024-01-02'), (2, 'when', '2024-01-02 03:04:05'), (1, 'code', '007'), (2, 'code', '12'), (1, 'amount', '1.5'), (2, 'amount', '2'), (1, 'empty', '-'), (2, 'empty', 'N/A')"


_INFER = r"""CASE WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'boolean' WHEN regexp_matches(replace(v, ',', ''), '^[+-]?\d+$') THEN CASE WHEN regexp_matches(replace(v, ',', ''), '^[+-]?0\d+$') THEN 'string' ELSE 'integer' END
WHEN regexp_matches(replace(v, ',', ''), '^[+-]?(\d+\.\d*|\d*\.\d+)([eE][+-]?\d+)?$') THEN 'number' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') AND try_cast(v AS DATE) IS NOT NULL THEN 'date'
WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2})?)?$') AND try_cast(substr(v, 1, 10) AS DATE) IS NOT NULL THEN 'datetime' ELSE 'string' END"""


_SMALL_SQL = f"""WITH c AS (SELECT col, r, trim(v) AS v FROM (VALUES {_SMALL}) AS t(r, col, v)), p AS (SELECT col, r, v, CASE WHEN lower(v) NOT IN {_MISSING} THEN {_INFER} END AS k FROM c)"""


def _small(spark):
    return values(spark, _SMALL, "row, column, value")


@query(_SMALL_SQL + """, g AS (SELECT col, list_sort(list(DISTINCT k) FILTER (k IS NOT NULL)) AS ks, count(*) AS n, count(k) AS m, array_to_string((list(v ORDER BY r) FILTER (k IS NOT NULL))[1:5], '|') AS s FROM p GROUP BY col)
SELECT col AS "column", CASE WHEN coalesce(len(ks), 0) = 0 THEN 'null' WHEN ks = ['integer', 'number'] OR ks = ['number'] THEN 'number' WHEN ks = ['integer'] THEN 'integer' WHEN ks = ['date', 'datetime'] OR ks = ['datetime'] THEN 'datetime' WHEN len(ks) = 1 THEN ks[1] ELSE 'string' END AS inferred_type,
round((n - m)::DOUBLE / n, 4) AS null_ratio, coalesce(s, '') AS samples FROM g""")
def infer_types(spark, d):
    return profile.infer_columns(_small(spark)).select("column", "inferred_type", "null_ratio", F.array_join("sample_values", "|").alias("samples"))


@query(_SMALL_SQL + ' SELECT col AS "column", k AS observed_type, count(*) AS "count" FROM p WHERE k IS NOT NULL GROUP BY col, k')
def observed_types(spark, d):
    return profile.observed_types(_small(spark))


@query(_SMALL_SQL + """, f AS (SELECT col, CASE col WHEN 'count' THEN k = 'integer' WHEN 'amount' THEN k IN ('integer', 'number') WHEN 'when' THEN k IN ('date', 'datetime') ELSE true END AS ok FROM p WHERE k IS NOT NULL)
SELECT col AS "column", sum(ok::INT)::BIGINT AS matching_count, sum((NOT ok)::INT)::BIGINT AS mismatch_count, round(sum(ok::INT) / count(*), 4) AS ratio FROM f GROUP BY col""")
def type_consistency(spark, d):
    return profile.type_consistency(_small(spark), {"count": "integer", "amount": "number", "when": "datetime"})


@query(f"SELECT v AS \"value\", CASE WHEN regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(v AS DOUBLE) END AS number FROM (SELECT replace(v, ',', '') AS v FROM (VALUES ('1,000'), ('1e5'), ('1d'), ('nan'), ('-2.5'), ('x'), ('.5')) AS t(v))")
def numeric_parse(spark, d):
    t = values(spark, "('1,000'), ('1e5'), ('1d'), ('nan'), ('-2.5'), ('x'), ('.5')", "v")
    return t.select(F.replace("v", F.lit(","), F.lit("")).alias("value"), scalars.number(F.col("v")).alias("number"))


_ADDR = "('도로명주소', '서울특별시 중구 세종대로 110'), ('도로명주소', '부산광역시 해운대구 센텀중앙로 79'), ('도로명주소', '-'), ('지번주소', '서울특별시 중구 태평로1가 31'), ('지번주소', '대구 수성구 범어동 산 12-3'), ('우편번호', '04524'), ('우편번호', '135-080'), ('우편번호', '12'), ('비고', '메모'), ('곳', '경기도 수원시 효원로 1')"


_KIND = f"CASE WHEN regexp_matches(v, '{scalars.POSTAL}') THEN 'postal' WHEN regexp_matches(v, '{scalars.ROAD}') THEN 'road' WHEN regexp_matches(v, '{scalars.JIBUN}') THEN 'jibun' END"


@query(f"SELECT c AS \"column\", v AS \"value\", CASE WHEN {_KIND} IS NULL THEN 'invalid' ELSE 'verified' END AS status, {_KIND} AS kind FROM (VALUES {_ADDR}) AS t(c, v)")
def address_values(spark, d):
    return values(spark, _ADDR, "column, value").select("column", "value", F.inline(F.array(scalars.validate_address(F.col("value")))))


@query(f"""WITH k AS (SELECT c, v <> '-' AS p, CASE WHEN v <> '-' THEN {_KIND} END AS k FROM (VALUES {_ADDR}) AS t(c, v)), h AS (SELECT c, count(*) AS n, sum(p::INT) AS s, count(k) FILTER (k = 'road') AS road, count(k) FILTER (k = 'jibun') AS jibun, count(k) FILTER (k = 'postal') AS postal,
CASE c WHEN '도로명주소' THEN 'road' WHEN '지번주소' THEN 'jibun' WHEN '우편번호' THEN 'postal' END AS hk FROM k GROUP BY c),
v AS (SELECT *, CASE hk WHEN 'road' THEN road WHEN 'jibun' THEN jibun WHEN 'postal' THEN postal ELSE road + jibun + postal END AS ok FROM h WHERE hk IS NOT NULL OR road + jibun > 0)
SELECT c AS "column", coalesce(hk, CASE WHEN road > 0 THEN 'road' ELSE 'jibun' END) AS kind, CASE WHEN ok::DOUBLE / s >= 0.6 THEN 'verified' WHEN ok = 0 AND hk IS NOT NULL THEN 'invalid' ELSE 'unverified' END AS status,
round(least(1.0::DOUBLE, (CASE WHEN hk IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + 0.7::DOUBLE * ok / s) * (1 - 0.5::DOUBLE * (n - s) / n)), 3) AS quality_score, round(ok::DOUBLE / s, 3) AS valid_ratio, ok::BIGINT AS valid_samples FROM v""")
def address_profile(spark, d):
    return profile.address_profile(values(spark, _ADDR, "column, value"))


_GEO = "(1, '37.56', '126.97'), (2, '40.1', '127.0'), (3, '', '127.0'), (4, '33.5', '126.5'), (5, 'x', 'y'), (6, '35.1', '135.0')"


_GEO_STATUS = "CASE WHEN try_cast(la AS DOUBLE) IS NULL OR try_cast(lo AS DOUBLE) IS NULL THEN 'unverified' WHEN try_cast(la AS DOUBLE) BETWEEN 32 AND 39.5 AND try_cast(lo AS DOUBLE) BETWEEN 124 AND 132 THEN 'verified' ELSE 'invalid' END"


@query(f"SELECT count(*) AS pairs, count(*) FILTER (s = 'verified') AS valid, round((count(*) FILTER (s = 'verified'))::DOUBLE / count(*), 3) AS ratio, CASE WHEN bool_or(s = 'invalid') THEN 'invalid' WHEN bool_or(s = 'unverified') THEN 'unverified' ELSE 'verified' END AS status FROM (SELECT {_GEO_STATUS} AS s FROM (VALUES {_GEO}) AS t(id, la, lo))")
def coord_profile(spark, d):
    return profile.coordinate_profile(values(spark, _GEO, "id, la, lo"), "la", "lo")


@query(f"SELECT id, {_GEO_STATUS} AS status, CASE WHEN {_GEO_STATUS} = 'verified' THEN try_cast(lo AS DOUBLE) END AS lon, CASE WHEN {_GEO_STATUS} = 'verified' THEN try_cast(la AS DOUBLE) END AS lat FROM (VALUES {_GEO}) AS t(id, la, lo)")
def geojson_features(spark, d):
    f = values(spark, _GEO, "id, la, lo").select("id", scalars.geojson_feature(F.col("la"), F.col("lo"), F.struct("id")).alias("f"))
    return f.select("id", F.col("f.coordinate_status").alias("status"), F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"))


@query("SELECT c AS name, CASE WHEN c LIKE '%우편%' THEN 'postal' WHEN c LIKE '%도로명%' THEN 'road' WHEN c LIKE '%지번%' THEN 'jibun' WHEN c LIKE '%주소%' OR c LIKE '%addr%' THEN 'address' END AS kind, CASE lower(c) WHEN '위도' THEN 'lat' WHEN 'lng' THEN 'lon' END AS axis FROM (VALUES ('우편 번호'), ('도로명주소'), ('지번 주소'), ('주소'), ('home_addr'), ('위도'), ('LNG'), ('값')) AS t(c)")
def header_kinds(spark, d):
    return values(spark, "('우편 번호'), ('도로명주소'), ('지번 주소'), ('주소'), ('home_addr'), ('위도'), ('LNG'), ('값')", "name").select("name", scalars.header_kind(F.col("name")).alias("kind"), scalars.axis(F.col("name")).alias("axis"))


@query("SELECT coalesce(id, 'row-' || r) AS record_id, trim(a) AS address FROM (VALUES (1, 'a', '서울 세종대로 110'), (2, NULL, ' 부산 중앙로 1 '), (3, 'c', ' ')) AS t(r, id, a) WHERE trim(a) <> ''")
def geocode_requests(spark, d):
    t = values(spark, "(1, 'a', '서울 세종대로 110'), (2, NULL, ' 부산 중앙로 1 '), (3, 'c', ' ')", "r, id, a")
    return t.filter(text.trim(F.col("a")) != "").select(F.coalesce("id", F.concat(F.lit("row-"), F.col("r").cast("string"))).alias("record_id"), text.trim(F.col("a")).alias("address"))


@query("SELECT p AS raw, f AS phone FROM (VALUES ('02)1234-5678', '02-1234-5678'), ('0311234567', '031-123-4567'), ('010 1234 5678', '010-1234-5678'), ('0000', NULL), ('없음', NULL), ('1588-0000', '15880000')) AS t(p, f)")
def phone_format(spark, d):
    t = values(spark, "('02)1234-5678'), ('0311234567'), ('010 1234 5678'), ('0000'), ('없음'), ('1588-0000')", "raw")
    return t.select("raw", scalars.phone(F.col("raw")).alias("phone"))


# From queries_registry

_NEWS = "(1, 'u1', '신규 제도 도입', '절차 개선', '2024-01-02', 'press'), (2, 'u1', '중복', '절차', '2024-01-03', 'press'), (3, '', '제도 안내', '기존 승인제', '2024-01-04', 'policy_briefing'), (4, 'u4', '채용 공고', '제도', '2024-01-05', 'press'), (5, '', '', '제도', '2024-01-05', 'press')"


@query(f"""WITH s AS (SELECT o, u, t, p, CASE k WHEN 'policy_briefing' THEN 3 WHEN 'press' THEN 2 ELSE 1 END + 2 * contains(t || ' ' || b, '제도')::INT + 2 * contains(t || ' ' || b, '절차')::INT + 3 * (contains(t || ' ' || b, '신규')::INT + contains(t || ' ' || b, '도입')::INT) - 5 * contains(t || ' ' || b, '승인제')::INT - 20 * contains(t || ' ' || b, '채용')::INT AS s,
row_number() OVER (PARTITION BY CASE WHEN u <> '' THEN u ELSE replace(t, ' ', '') END ORDER BY o) AS k FROM (VALUES {_NEWS}) AS t(o, u, t, b, p, k) WHERE u <> '' OR t <> '') SELECT u AS url, t AS title, p AS published, s::INT AS score FROM s WHERE k = 1 AND s > 0""")
def news_rank(spark, d):
    items = values(spark, _NEWS, "ordinal, url, title, body, published, source_type")
    signals = {"institution": ("제도",), "process": ("절차",), "novelty": ("신규", "도입"), "noise": ("채용",)}
    return registry.rank_news(items, signals, ("승인제",), {"policy_briefing": 3, "press": 2})


_ITEMS = "('전산 연계'), ('처리일 지연'), ('증빙 서식'), ('수수료 금액'), ('현장 관행'), ('담당 부처'), ('기타 사실')"


@query(f"SELECT v AS item, CASE WHEN regexp_matches(v, '시스템|전산|온라인|데이터|DB|연계') THEN '정보시스템' WHEN regexp_matches(v, '기한|기간|소요|처리일|지연') THEN '처리기간' WHEN regexp_matches(v, '서식|문서|자료|증빙|보고서') THEN '문서·증빙' WHEN regexp_matches(v, '예산|비용|수수료|금액|재원') THEN '재정·비용' WHEN regexp_matches(v, '관행|실무|내부|현장|운영') THEN '실무 관행' WHEN regexp_matches(v, '기관|부처|지자체|담당|권한') THEN '기관·권한' ELSE '운영 사실' END AS domain FROM (VALUES {_ITEMS}) AS t(v)")
def domain_classify(spark, d):
    return values(spark, _ITEMS, "item").select("item", registry.classify_domain(F.col("item")).alias("domain"))


@query(f"SELECT domain, count(*) AS n FROM (SELECT CASE WHEN v LIKE '%전산%' THEN '정보시스템' WHEN v LIKE '%처리일%' THEN '처리기간' WHEN v LIKE '%서식%' THEN '문서·증빙' WHEN v LIKE '%수수료%' THEN '재정·비용' WHEN v LIKE '%관행%' THEN '실무 관행' WHEN v LIKE '%부처%' THEN '기관·권한' ELSE '운영 사실' END AS domain FROM (VALUES {_ITEMS}) AS t(v)) GROUP BY domain")
def verification_queue(spark, d):
    return domain_classify(spark, d).groupBy("domain").agg(F.count("*").alias("n"))


@query()
def law_steps(spark, d):
    law = "(1, '제1조(협의) 사업자는 평가서를 30일 이내 협의기관에 제출하여야 한다. 협의기관은 보완을 요청할 수 있다. 제2조(공고) 승인기관은 그 내용을 지체 없이 공고하여야 한다.')"
    return values(spark, law, "id, text").select("id", F.inline(registry.law_steps(F.col("text"))))


@query("SELECT id, strftime(day - INTERVAL 2 DAY, '%Y%m%d') AS first_day, strftime(day, '%Y%m%d') AS last_day FROM (VALUES (1, DATE '2024-03-01'), (2, DATE '2024-01-01')) AS t(id, day)")
def date_windows(spark, d):
    w = registry.date_window(F.col("day"))
    return values(spark, "(1, date '2024-03-01'), (2, date '2024-01-01')", "id, day").select("id", F.get(w, 0).alias("first_day"), F.get(w, 1).alias("last_day"))


@query("SELECT id, CASE WHEN c LIKE '% - %' THEN split_part(c, ' - ', 1) WHEN c = '' THEN '기타' ELSE c END AS top, array_to_string(list_filter(list_transform(string_split(replace(k, '，', ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM (VALUES (1, '환경 - 대기', 'a, b,,c'), (2, '교통', 'x，y'), (3, '', '')) AS t(id, c, k)")
def top_categories(spark, d):
    t = values(spark, "(1, '환경 - 대기', 'a, b,,c'), (2, '교통', 'x，y'), (3, '', '')", "id, c, k")
    return t.select("id", text.top_category(F.col("c")).alias("top"), F.array_join(text.keywords(F.col("k")), "|").alias("keywords"))


@query("SELECT * FROM (VALUES (1, 'https://api.x.kr/openapi/list?a=1&b=2|http://y.kr/v2/items')) AS t(id, urls)")
def external_endpoints(spark, d):
    page = "(1, 'see https://api.x.kr/openapi/list?a=1&amp;b=2, and HTTP://y.kr/v2/items#f. not https://www.data.go.kr/api/x nor https://z.kr/restaurants/1 nor https://q.data.go.kr/api/')"
    return values(spark, page, "id, html").select("id", F.array_join(web.external_endpoints(F.col("html")), "|").alias("urls"))


@query("SELECT * FROM (VALUES (1, '한 글.csv', '한 글.csv', 10), (2, 'a.zip', 'a.zip', 7), (3, 'b.xlsx', 'b.xlsx', NULL), (4, 'download.bin', 'download.bin', NULL), (5, 'x:y.csv', 'x_y.csv', NULL)) AS t(id, name, safe, size)")
def response_names(spark, d):
    t = values(spark, "(1, 'attachment; filename*=UTF-8''''%ED%95%9C%20%EA%B8%80.csv', 'https://h/x', 'bytes 0-1/10', '2'), (2, 'attachment; filename=\"a.zip\"', 'https://h/x', NULL, '7'), (3, '', 'https://h/p/b.xlsx?q=1', NULL, NULL), (4, '', 'https://h', NULL, 'x'), (5, 'filename=x:y.csv', '', NULL, NULL)", "id, cd, url, cr, cl")
    name = web.response_filename(F.col("cd"), F.col("url"))
    return t.select("id", name.alias("name"), web.safe_filename(name).alias("safe"), web.content_length(F.col("cr"), F.col("cl")).cast("int").alias("size"))


@query("SELECT * FROM (VALUES (1, 'Hello world', 1)) AS t(id, text, errors)")
def token_stream(spark, d):
    t = values(spark, "(1, '{\"response\": \"Hello\"}'), (2, '{\"response\": \" world\", \"done\": true}'), (3, 'broken')", "i, value")
    r = streams.token_stream(t.select("value")).withColumn("i", F.monotonically_increasing_id())
    return r.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "response"))), lambda x: x["response"]), "").alias("text"), F.count("error").cast("int").alias("errors")).select(F.lit(1).alias("id"), "text", "errors")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_literal(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() > 0
