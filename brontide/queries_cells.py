"""Queries of cells, catalog rows and plans: inputs are worked out from tables by expressions that every engine reads alike."""

from pyspark.sql import functions as F

from brontide.functions import scalars, text, web
from brontide.operators import catalog, chunks, ledger, payloads, profile, registry
from brontide.registry_of_queries import Derived, in_turn, query, table
from brontide.sources import files
from brontide.sources.stored import spread
from brontide.streaming import ledger as streams

# Catalog rows.

_TAGS = Derived("part", id="p_partkey", a="p_brand", b="p_type", c="'tag' || p_size")
_CONCEPTS = Derived("part", tag="p_brand", name="'concept of ' || p_brand", wide="p_size > 25")


@query(f"""WITH c AS (SELECT DISTINCT tag, name FROM {_CONCEPTS.sql} WHERE wide), t AS (SELECT * FROM {_TAGS.sql})
SELECT id, coalesce(x.name, a) || ',' || coalesce(y.name, b) || ',' || coalesce(z.name, t.c) AS names FROM t LEFT JOIN c x ON a = x.tag LEFT JOIN c y ON b = y.tag LEFT JOIN c z ON t.c = z.tag""")
def tag_concepts(spark, d):
    tags = _TAGS(spark, d).select("id", F.posexplode(F.array("a", "b", "c")).alias("ordinal", "tag"))
    return catalog.concept_names(tags, _CONCEPTS(spark, d).filter("wide").select("tag", "name").distinct()).withColumn("names", F.array_join("names", ","))


_KEYS = Derived("part", id="p_partkey", a="'x' || (p_size % 3) || ',y' || (p_partkey % 2) || ',z' || (p_partkey % 5)", b="'z' || (p_size % 5) || ',x' || (p_partkey % 3) || ',y' || (p_size % 2)")


@query(f"SELECT id, array_to_string(list_sort(list_intersect(string_split(a, ','), string_split(b, ','))), ',') AS shared, list_sort(string_split(a, ',')) = list_sort(string_split(b, ',')) AS same FROM {_KEYS.sql}")
def key_intersection(spark, d):
    t = _KEYS(spark, d).select("id", F.inline(F.array(catalog.key_sets(F.split("a", ","), F.split("b", ",")))))
    return t.withColumn("shared", F.array_join("shared", ","))


_NUMBERS = Derived("part", r="p_partkey", a=in_turn("p_partkey", "' ' || (15000000 + p_partkey) || ' '", "'abc'", "p_name", "'12'"), b=in_turn("p_size", "'x'", "'' || (1234567 + p_partkey)", "'' || p_size"))


@query(f"SELECT r, coalesce(try_cast(trim(a) AS BIGINT), CASE WHEN regexp_full_match(a, '[0-9]{{6,}}') THEN try_cast(a AS BIGINT) END, CASE WHEN regexp_full_match(b, '[0-9]{{6,}}') THEN try_cast(b AS BIGINT) END) AS number FROM {_NUMBERS.sql}")
def doc_number(spark, d):
    return _NUMBERS(spark, d).select("r", files.doc_number(F.col("a"), F.array("a", "b")).alias("number"))


_SNIFF = Derived("part", path=in_turn("p_partkey", "p_partkey || '.XLSX'", "p_partkey || '.bin'", "p_name || '.json'", "p_partkey || '.dat'", "p_name || '.tsv'", "'a.b.csv'", "p_brand || '.txt'", "p_name"), head=in_turn("p_size", "'PK' || p_name", "' [' || p_size || ']'", "'{}'", "p_name"), mime=in_turn("p_partkey", "'application/json; charset=utf-8'", "'text/html'", "NULL", "'application/octet-stream'", "'TEXT/tab-separated-values'", "'application/csv'", "''"))


@query(f"SELECT path, head, CASE WHEN head LIKE 'PK%' THEN CASE WHEN lower(path) LIKE '%.xlsx' THEN 'xlsx' ELSE 'zip' END WHEN lower(path) LIKE '%.xlsx' THEN 'xlsx' WHEN path LIKE '%.json' THEN 'json' WHEN path LIKE '%.tsv' THEN 'tsv' WHEN path LIKE '%.csv' THEN 'csv' WHEN trim(head)[1] IN ('[', '{{') THEN 'json' WHEN path LIKE '%.txt' THEN 'text' WHEN mime LIKE '%json%' THEN 'json' WHEN lower(mime) LIKE '%tab-separated-values%' THEN 'tsv' WHEN mime LIKE 'text/%' OR mime LIKE '%csv%' THEN 'csv' ELSE 'unknown' END AS format FROM {_SNIFF.sql}")
def format_sniff(spark, d):
    return _SNIFF(spark, d).select("path", "head", web.sniff_format(F.col("path"), F.col("head"), F.col("mime")).alias("format"))


_DOCS = Derived(
    "part",
    a="'' || p_partkey",
    n=in_turn("p_partkey", "p_name", "'-'", "''"),
    s="'Spec ' || p_brand",
    p=in_turn("p_size", "p_brand", "'-'"),
    c="p_type || ' - ' || p_size",
    k=in_turn("p_size", "p_name || ', ' || p_type || ' ,'", "''", "p_brand"),
    t=in_turn("p_partkey", "'<b>' || p_name || '</b> value'", "p_type", "'-'"),
    u=in_turn("p_size", "'2024-01-0' || (1 + p_partkey % 9)", "''", "'-'"),
)


@query(f"""SELECT 'openapi_new:' || a AS service_id, CASE WHEN n NOT IN ('', '-') THEN n ELSE s END AS name, trim(regexp_replace(regexp_replace(CASE WHEN t = '-' THEN '' ELSE t END, '<[^>]+>', ' ', 'g'), ' +', ' ', 'g')) AS description, CASE WHEN p = '-' THEN '' ELSE p END AS provider, c AS category,
array_to_string(list_filter(list_transform(string_split(k, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords, CASE WHEN u = '-' THEN '' ELSE u END AS updated_at, 'https://p.kr/' || a AS url FROM {_DOCS.sql}""")
def catalog_details(spark, d):
    info = F.create_map(*(x for k, c in (("목록명", "n"), ("제공기관", "p"), ("분류체계", "c"), ("키워드", "k"), ("설명", "t"), ("수정일", "u")) for x in (F.lit(k), F.col(c))))
    docs = _DOCS(spark, d).select(F.col("a").alias("api_id"), info.alias("info"), F.col("s").alias("spec_title"), F.lit("").alias("spec_description"), F.concat(F.lit("https://p.kr/"), "a").alias("crawled_url"))
    return catalog.details(docs).withColumn("keywords", F.array_join("keywords", "|"))


_FIELDS = Derived("part", id="p_partkey", a=in_turn("p_partkey", "' ' || p_name || ' '", "' '", "NULL"), b=in_turn("p_size", "p_type", "NULL", "' ' || p_brand"))


@query(f"SELECT id, CASE WHEN trim(coalesce(a, '')) <> '' THEN trim(a) WHEN trim(coalesce(b, '')) <> '' THEN trim(b) ELSE '' END AS v FROM {_FIELDS.sql}")
def coalesce_fields(spark, d):
    return _FIELDS(spark, d).select("id", catalog.present(text.trim(F.col("a")), text.trim(F.col("b"))).alias("v"))


@query("SELECT 'doc-' || doc_id AS path, octet_length(encode(text))::INT AS size_bytes, sha256(text) AS checksum FROM documents")
def crawl_manifest(spark, d):
    return files.manifest(table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content")))


# Plans and gates.

_PLAN = Derived("customer", step="c_custkey", operation="c_mktsegment", version="c_custkey % 4")
_SPECS = Derived("customer", operation="c_mktsegment", version="c_nationkey % 4", spec="c_name", known_from="c_nationkey < 14")


@query(f"WITH o AS (SELECT operation, version, min(spec) AS spec FROM {_SPECS.sql} WHERE known_from AND operation <> 'MACHINERY' GROUP BY 1, 2) SELECT step, spec IS NOT NULL AS known, spec FROM {_PLAN.sql} p LEFT JOIN o USING (operation, version)")
def plan_operations(spark, d):
    specs = _SPECS(spark, d).filter("known_from and operation <> 'MACHINERY'").groupBy("operation", "version").agg(F.min("spec").alias("spec"))
    return payloads.with_operations(_PLAN(spark, d), specs).select("step", "known", "spec")


_GATE = Derived("orders", id="o_orderkey", page="'2024-0' || (1 + o_orderkey % 9) || '-01'", stored=in_turn("o_custkey", "NULL", "'2024-0' || (1 + o_custkey % 9) || '-01'", "'2024-05-01'"), targets="o_orderstatus <> 'P'", forced="o_orderpriority LIKE '1%'")


@query(f"SELECT id, forced OR NOT targets OR stored IS NULL OR page > stored AS load FROM {_GATE.sql}")
def change_gate(spark, d):
    return _GATE(spark, d).select("id", ledger.change_gate(F.col("page"), F.col("stored"), F.col("targets"), F.col("forced")).alias("load"))


_INPUTS = Derived("part", id="p_partkey", need="'a,b' || (p_size % 4) || ',c' || (p_partkey % 3)", have="'a,b' || (p_partkey % 4) || ',c' || (p_size % 3)")


@query(f"SELECT id, array_to_string(list_sort(list_filter(string_split(need, ','), lambda x: NOT list_contains(string_split(have, ','), x))), ',') AS missing FROM {_INPUTS.sql}")
def dry_run_missing(spark, d):
    inputs = F.map_from_entries(F.transform(F.split("have", ","), lambda x: F.struct(x, F.lit("v"))))
    return _INPUTS(spark, d).select("id", F.array_join(ledger.missing_inputs(F.split("need", ","), inputs), ",").alias("missing"))


_CHECKED = Derived("part", step="p_partkey", v=in_turn("p_partkey", "'' || p_size", "p_name", "p_brand", "NULL", "'x'"), k=in_turn("p_size", "'integer'", "'string'", "'string'"), n="3 + p_size % 8", p=in_turn("p_size", "'[0-9]+'", "'[a-z ]+'", "'.*'"))


@query(f"SELECT step, CASE WHEN v IS NULL THEN 'missing' WHEN k = 'integer' AND try_cast(v AS BIGINT) IS NULL THEN 'type' WHEN length(v) > n THEN 'length' WHEN NOT regexp_full_match(v, p) THEN 'pattern' ELSE 'ok' END AS verdict FROM {_CHECKED.sql}")
def plan_validation(spark, d):
    return _CHECKED(spark, d).select("step", payloads.input_verdict(F.col("v"), F.col("k"), F.col("n"), F.col("p")).alias("verdict"))


@query("""SELECT c_custkey AS id, sha256('{"name":"' || c_name || '","segment":"say \\"' || c_mktsegment || '\\""}') AS hash FROM customer""")
def canonical_hash(spark, d):
    m = F.create_map(F.lit("segment"), F.concat(F.lit('say "'), "c_mktsegment", F.lit('"')), F.lit("name"), F.col("c_name"), F.lit("content_hash"), F.lit("zz"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ledger.canonical_hash(m).alias("hash"))


# Texts.

_CJK = Derived("part", id="p_partkey", s=in_turn("p_partkey", "'미세먼지 API v' || p_size", "'물 관리 ' || p_name", "'Air-Quality 대기질' || p_brand", "p_name || '시'"))


@query(f"""WITH r AS (SELECT id, regexp_extract_all(lower(s), '[a-z0-9]+') AS w, regexp_extract_all(s, '[가-힣]+') AS c FROM {_CJK.sql})
SELECT id, array_to_string(list_concat(w, flatten(list_transform(c, lambda x: CASE WHEN length(x) = 1 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) END))), ' ') AS tokens FROM r""")
def tokenize_cjk(spark, d):
    return _CJK(spark, d).select("id", F.array_join(text.tokenize(F.col("s")), " ").alias("tokens"))


_ASKED = Derived("part", id="p_partkey", a="p_name", b="p_type || p_size", joined=in_turn("p_partkey", "' 및 '", "', '", "' / '", "' + '", "' 또는 '"))


@query(f"SELECT id, a || joined || b || '|' || a || '|' || b AS intents FROM {_ASKED.sql}".replace("a || joined || b || '|'", "trim(regexp_replace(a || joined || b, ' +', ' ', 'g')) || '|'"))
def split_intents(spark, d):
    return _ASKED(spark, d).select("id", F.array_join(text.intents(F.concat("a", "joined", "b")), "|").alias("intents"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate::DATE - INTERVAL 2 DAY, '%Y%m%d') AS first_day, strftime(o_orderdate::DATE, '%Y%m%d') AS last_day FROM orders")
def date_windows(spark, d):
    w = registry.date_window(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(w, 0).alias("first_day"), F.get(w, 1).alias("last_day"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24) + INTERVAL 9 HOUR, '%Y-%m-%d') END AS day FROM orders""")
def published_days(spark, d):
    """Dates of feeds as days in Korea: RFC 822 and ISO with an offset, a policy's month/day/year, and one that is none."""
    at = F.expr("o_orderdate + make_interval(0, 0, 0, 0, cast(o_custkey % 24 as int))")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), registry.kst_date(said).alias("day"))


_CATEGORIES = Derived("part", id="p_partkey", c=in_turn("p_partkey", "p_type || ' - ' || p_name", "p_type", "''"), k=in_turn("p_size", "p_name || ', ' || p_brand || ',,' || p_size", "p_name || '，' || p_type", "''"))


@query(f"SELECT id, CASE WHEN c LIKE '% - %' THEN split_part(c, ' - ', 1) WHEN c = '' THEN '기타' ELSE c END AS top, array_to_string(list_filter(list_transform(string_split(replace(k, '，', ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM {_CATEGORIES.sql}")
def top_categories(spark, d):
    return _CATEGORIES(spark, d).select("id", text.top_category(F.col("c")).alias("top"), F.array_join(text.keywords(F.col("k")), "|").alias("keywords"))


@query("SELECT c_custkey AS id, 'https://api' || c_custkey || '.x.kr/openapi/list?a=' || c_nationkey || '&b=2' || CASE WHEN c_custkey % 2 = 0 THEN '|http://y.kr/v' || (1 + c_nationkey) || '/items' ELSE '' END AS urls FROM customer")
def external_endpoints(spark, d):
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    other = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("and HTTP://y.kr/v"), (F.col("c_nationkey") + 1).cast("string"), F.lit("/items#f."))).otherwise("nor https://www.data.go.kr/api/x")
    page = F.concat(F.lit("<p>see https://api"), k, F.lit(".x.kr/openapi/list?a="), n, F.lit("&amp;b=2, "), other, F.lit(" nor https://z.kr/restaurants/"), k, F.lit(" nor https://q.data.go.kr/api/</p> https://api"), k, F.lit(".x.kr/openapi/list?a="), n, F.lit("&amp;b=2"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(web.external_endpoints(page), "|").alias("urls"))


_RESPONSES = Derived(
    "customer",
    id="c_custkey",
    cd=in_turn("c_custkey", "'attachment; filename*=UTF-8''''%ED%95%9C%20' || c_custkey || '.csv'", "'attachment; filename=\"a' || c_custkey || '.zip\"'", "''", "''", "'filename=x:' || c_custkey || '.csv'").replace("''''", "' || chr(39) || chr(39) || '"),
    url=in_turn("c_custkey", "'https://h/x'", "'https://h/x'", "'https://h/p/b' || c_nationkey || '.xlsx?q=1'", "'https://h'", "''"),
    cr=in_turn("c_nationkey", "'bytes 0-1/' || c_custkey", "NULL"),
    cl=in_turn("c_nationkey", "'2'", "'' || c_custkey", "'x'"),
)


@query(f"""SELECT id, name, replace(name, ':', '_') AS safe, CASE WHEN cr IS NOT NULL THEN try_cast(split_part(cr, '/', 2) AS INT) ELSE try_cast(cl AS INT) END AS size
FROM (SELECT *, CASE WHEN cd LIKE '%UTF-8%' THEN '한 ' || id || '.csv' WHEN cd LIKE '%"%' THEN split_part(cd, '"', 2) WHEN cd LIKE 'filename=%' THEN substr(cd, 10) WHEN url LIKE '%?q=1' THEN split_part(split_part(url, '/p/', 2), '?', 1) ELSE 'download.bin' END AS name FROM {_RESPONSES.sql})""")
def response_names(spark, d):
    name = web.response_filename(F.col("cd"), F.col("url"))
    return _RESPONSES(spark, d).select("id", name.alias("name"), web.safe_filename(name).alias("safe"), web.content_length(F.col("cr"), F.col("cl")).cast("int").alias("size"))


_LINES = Derived("conversations", conv_id="conv_id", line="turn + 1", value="CASE WHEN turn % 5 = 3 THEN 'broken ' || role WHEN turn % 7 = 5 THEN '[1]' WHEN turn % 4 = 2 THEN ' ' ELSE '{\"response\": \"' || role || turn || ' \", \"done\": false}' END")


@query(f"""SELECT conv_id, coalesce(string_agg(CASE WHEN value LIKE '{{%' THEN split_part(split_part(value, '": "', 2), '", "', 1) END, '' ORDER BY line), '') AS text, coalesce(string_agg(CASE WHEN value LIKE 'broken%' THEN line || ': no JSON' WHEN value LIKE '[%' THEN line || ': no JSON object' END, '; ' ORDER BY line), '') AS errors FROM {_LINES.sql} WHERE trim(value) <> '' GROUP BY conv_id""")
def token_stream(spark, d):
    said = streams.concat_tokens(_LINES(spark, d), "conv_id", "line")
    return said.withColumn("errors", F.array_join(F.transform("errors", lambda e: F.concat(e["line"].cast("string"), F.lit(": "), e["error"])), "; "))


# News, domains, law.

_NEWS = Derived(
    "orders",
    o="o_orderkey",
    u=in_turn("o_custkey", "'u' || (o_custkey % 90)", "'u' || o_orderkey", "''"),
    t=in_turn("o_orderkey", "'신규 제도 도입 ' || o_custkey % 40", "'제도 안내'", "'채용 공고 ' || o_custkey", "''", "'절차 ' || o_custkey % 60"),
    b=in_turn("o_custkey", "'절차 개선'", "'기존 승인제'", "'제도'", "''"),
    p="'2024-0' || (1 + o_custkey % 9) || '-0' || (1 + o_orderkey % 9)",
    k=in_turn("o_orderkey", "'press'", "'policy_briefing'", "'other'"),
)


@query(f"""WITH s AS (SELECT o, u, t, p, CASE k WHEN 'policy_briefing' THEN 3 WHEN 'press' THEN 2 ELSE 1 END + 2 * contains(t || ' ' || b, '제도')::INT + 2 * contains(t || ' ' || b, '절차')::INT + 3 * (contains(t || ' ' || b, '신규')::INT + contains(t || ' ' || b, '도입')::INT) - 5 * contains(t || ' ' || b, '승인제')::INT - 20 * contains(t || ' ' || b, '채용')::INT AS s,
row_number() OVER (PARTITION BY CASE WHEN u <> '' THEN u ELSE replace(t, ' ', '') END ORDER BY o) AS k FROM {_NEWS.sql} WHERE u <> '' OR t <> '') SELECT u AS url, t AS title, p AS published, s::INT AS score FROM s WHERE k = 1 AND s > 0 ORDER BY s DESC, p DESC, o LIMIT 30""")
def news_rank(spark, d):
    items = _NEWS(spark, d).withColumnsRenamed({"o": "ordinal", "u": "url", "t": "title", "b": "body", "p": "published", "k": "source_type"})
    signals = {"institution": ("제도",), "process": ("절차",), "novelty": ("신규", "도입"), "noise": ("채용",)}
    return registry.rank_news(items, signals, ("승인제",), {"policy_briefing": 3, "press": 2})


_ITEMS = Derived("part", id="p_partkey", item=in_turn("p_partkey", "p_name || ' 전산 연계'", "'처리일 지연 ' || p_size", "'증빙 서식'", "p_brand || ' 수수료 금액'", "'현장 관행'", "'담당 부처 ' || p_type", "'기타 사실'", "'내부 서식 기한'"))
_DOMAIN = "CASE WHEN regexp_matches(item, '시스템|전산|온라인|데이터|DB|연계') THEN '정보시스템' WHEN regexp_matches(item, '기한|기간|소요|처리일|지연') THEN '처리기간' WHEN regexp_matches(item, '서식|문서|자료|증빙|보고서') THEN '문서·증빙' WHEN regexp_matches(item, '예산|비용|수수료|금액|재원') THEN '재정·비용' WHEN regexp_matches(item, '관행|실무|내부|현장|운영') THEN '실무 관행' WHEN regexp_matches(item, '기관|부처|지자체|담당|권한') THEN '기관·권한' ELSE '운영 사실' END"


@query(f"SELECT id, item, {_DOMAIN} AS domain FROM {_ITEMS.sql}")
def domain_classify(spark, d):
    return _ITEMS(spark, d).select("id", "item", registry.classify_domain(F.col("item")).alias("domain"))


@query(f"SELECT domain, count(*) AS n FROM (SELECT {_DOMAIN} AS domain FROM {_ITEMS.sql}) GROUP BY domain")
def verification_queue(spark, d):
    return domain_classify(spark, d).groupBy("domain").agg(F.count("*").alias("n"))


_LAW = Derived("customer", id="c_custkey", a="'제' || (1 + c_custkey % 90) || '조(협의)'", b="'제' || (2 + c_custkey % 90) || '조(공고)'", days="(10 + c_nationkey) || '일'", who=in_turn("c_custkey", "'사업자'", "'승인기관'", "'주민'"))


@query(f"""WITH l AS (SELECT * FROM {_LAW.sql})
SELECT id, a AS article, a || ' ' || who || '는 평가서를 ' || days || ' 이내 협의기관에 제출하여야 한다' AS sentence, CASE who WHEN '주민' THEN '협의기관' WHEN '사업자' THEN '사업자/시행자' ELSE who END AS lane, '제출' AS action, 'G1 착수·스코핑' AS stage, days || '이내' AS deadline, 'task' AS type, 0.95::DOUBLE AS confidence, '평가서' AS documents, who || '는 평가서를 ' || days || ' 이내 협의기관' AS receiver, NULL AS condition, '평가서 제출' AS name FROM l
UNION ALL SELECT id, a, '협의기관은 보완을 요청할 수 있다', '협의기관', '요청', 'G5 협의검토·보완', NULL, 'task', 0.8, '', NULL, NULL, '요청 업무' FROM l
UNION ALL SELECT id, b, b || ' 승인기관은 그 내용을 지체 없이 공고하여야 한다', '승인기관', '공고', 'G3 공고·공람', '지체없이', 'notice', 0.85, '', NULL, NULL, '공고 업무' FROM l
UNION ALL SELECT id, b, '시장은 필요한 경우 ' || who || '에게 의견서를 통보하여야 한다', CASE who WHEN '사업자' THEN '사업자/시행자' WHEN '승인기관' THEN who ELSE '관할 지자체' END, '통보', 'G4 의견수렴·본안', NULL, 'task', 0.95, '의견서', NULL, '시장은 필요한 경우', '의견서 통보' FROM l
UNION ALL SELECT id, b, '이 법은 ' || days || '부터 시행되는 것으로 한다', '사업자/시행자', NULL, 'G1 착수·스코핑', NULL, 'task', 0.35, '', NULL, NULL, '이 법은 ' || days || '부터 시행되는 것으로 한다' FROM l""")
def law_steps(spark, d):
    say = lambda *x: F.concat(*(F.col(p) if p in ("a", "b", "who", "days") else F.lit(p) for p in x))
    text_ = say("a", " ", "who", "는 평가서를 ", "days", " 이내 협의기관에 제출하여야 한다. 협의기관은 보완을 요청할 수 있다. ", "b", " 승인기관은 그 내용을 지체 없이 공고하여야 한다. 시장은 필요한 경우 ", "who", "에게 의견서를 통보하여야 한다. 이 법은 ", "days", "부터 시행되는 것으로 한다.")
    return spread(_LAW(spark, d), "id").select("id", F.inline(registry.law_steps(text_))).withColumn("documents", F.array_join("documents", "|"))


# Cells of a profile.

_CELLS = {
    "count": in_turn("o_orderkey", "'' || o_orderkey", "'oops'", "' '", "'1,00' || (o_orderkey % 10)"),
    "flag": in_turn("o_orderkey", "'Y'", "'no'", "'TRUE'"),
    "when": in_turn("o_orderkey", "'2024-01-0' || (1 + o_orderkey % 9)", "'2024-01-02 03:04:0' || (o_orderkey % 10)"),
    "code": in_turn("o_orderkey", "'00' || o_orderkey", "'' || o_custkey"),
    "amount": in_turn("o_orderkey", "o_custkey || '.5'", "'' || o_custkey", "'-.5e1'"),
    "empty": in_turn("o_orderkey", "'-'", "'N/A'", "NULL"),
}
_MISSING = "('', 'null', 'none', 'nil', 'na', 'n/a', 'nan', '-')"
_INFER = r"""CASE WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'boolean' WHEN regexp_matches(replace(v, ',', ''), '^[+-]?\d+$') THEN CASE WHEN regexp_matches(replace(v, ',', ''), '^[+-]?0\d+$') THEN 'string' ELSE 'integer' END
WHEN regexp_matches(replace(v, ',', ''), '^[+-]?(\d+\.\d*|\d*\.\d+)([eE][+-]?\d+)?$') THEN 'number' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') AND try_cast(v AS DATE) IS NOT NULL THEN 'date'
WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2})?)?$') AND try_cast(substr(v, 1, 10) AS DATE) IS NOT NULL THEN 'datetime' ELSE 'string' END"""
_CELLS_SQL = "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, o_orderkey AS r, trim(coalesce({e}, '')) AS v FROM orders" for c, e in _CELLS.items()) + f"), p AS (SELECT col, r, v, CASE WHEN lower(v) NOT IN {_MISSING} THEN {_INFER} END AS k FROM c)"
_DECLARED = {"count": "integer", "amount": "number", "when": "datetime"}
_FITS = "CASE col WHEN 'count' THEN k = 'integer' WHEN 'amount' THEN k IN ('integer', 'number') WHEN 'when' THEN k IN ('date', 'datetime') ELSE true END"


def _cells(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", *(f"{e} AS {c}" for c, e in _CELLS.items()))
    return profile.cells(o, list(_CELLS), F.col("o_orderkey"))


@query(_CELLS_SQL + """, s AS (SELECT col, v, min(r) AS f FROM p WHERE k IS NOT NULL GROUP BY col, v), t AS (SELECT col, string_agg(v, '|' ORDER BY i) AS s FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY f, v) AS i FROM s) WHERE i <= 5 GROUP BY col),
g AS (SELECT col, list_sort(list(DISTINCT k) FILTER (k IS NOT NULL)) AS ks, count(*) AS n, count(k) AS m FROM p GROUP BY col)
SELECT col AS "column", CASE WHEN coalesce(len(ks), 0) = 0 THEN 'null' WHEN ks = ['integer', 'number'] OR ks = ['number'] THEN 'number' WHEN ks = ['integer'] THEN 'integer' WHEN ks = ['date', 'datetime'] OR ks = ['datetime'] THEN 'datetime' WHEN len(ks) = 1 THEN ks[1] ELSE 'string' END AS inferred_type,
round((n - m)::DOUBLE / n, 4) AS null_ratio, coalesce(s, '') AS samples FROM g LEFT JOIN t USING (col)""")
def infer_types(spark, d):
    return profile.infer_columns(_cells(spark, d)).select("column", "inferred_type", "null_ratio", F.array_join("sample_values", "|").alias("samples"))


@query(_CELLS_SQL + ' SELECT col AS "column", k AS observed_type, count(*) AS "count" FROM p WHERE k IS NOT NULL GROUP BY col, k')
def observed_types(spark, d):
    return profile.observed_types(_cells(spark, d))


@query(_CELLS_SQL + f""", f AS (SELECT col, {_FITS} AS ok FROM p WHERE k IS NOT NULL)
SELECT col AS "column", sum(ok::INT)::BIGINT AS matching_count, sum((NOT ok)::INT)::BIGINT AS mismatch_count, round(sum(ok::INT) / count(*), 4) AS ratio FROM f GROUP BY col""")
def type_consistency(spark, d):
    return profile.type_consistency(_cells(spark, d), _DECLARED)


@query(_CELLS_SQL + f""", f AS (SELECT col, r, v, k, row_number() OVER (PARTITION BY col ORDER BY r, v) AS i FROM p WHERE k IS NOT NULL AND NOT ({_FITS}))
SELECT col AS "column", i::INT AS rank, r AS row, v AS "value", k AS observed_type FROM f WHERE i <= 20""")
def type_mismatches(spark, d):
    """The cells of each column that are first to break its declared type, as a profile lists them after its outliers."""
    return profile.type_mismatches(_cells(spark, d), _DECLARED)


_PARSED = Derived("part", id="p_partkey", v=in_turn("p_partkey", "'1,00' || (p_size % 10)", "'1e' || (p_size % 9)", "p_size || 'd'", "'nan'", "'-' || p_size || '.5'", "p_name", "'.5'"))


@query(f"SELECT id, replace(v, ',', '') AS \"value\", CASE WHEN regexp_matches(replace(v, ',', ''), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(replace(v, ',', '') AS DOUBLE) END AS number FROM {_PARSED.sql}")
def numeric_parse(spark, d):
    return _PARSED(spark, d).select("id", F.replace("v", F.lit(","), F.lit("")).alias("value"), scalars.number(F.col("v")).alias("number"))


# Addresses, coordinates, phones.

_ADDR = Derived(
    "customer",
    id="c_custkey",
    c=in_turn("c_custkey", "'도로명주소'", "'지번주소'", "'우편번호'", "'비고'", "'곳'"),
    v=in_turn(
        "c_custkey",
        "'서울특별시 중구 세종대로 ' || c_custkey",
        "'대구 수성구 범어동 산 ' || (1 + c_nationkey) || '-3'",
        "'0' || (1000 + c_nationkey)",
        "'메모 ' || c_name",
        "'경기도 수원시 효원로 ' || (1 + c_nationkey)",
        "'-'",
        "'서울특별시 중구 태평로1가 ' || (1 + c_nationkey)",
        "'13' || c_nationkey || '-080'",
        "c_mktsegment",
        "'부산광역시 해운대구 센텀중앙로 7' || (c_nationkey % 10)",
        "'부산 ' || c_mktsegment",
    ),
)
_KIND = f"CASE WHEN regexp_matches(v, '{scalars.POSTAL}') THEN 'postal' WHEN regexp_matches(v, '{scalars.ROAD}') THEN 'road' WHEN regexp_matches(v, '{scalars.JIBUN}') THEN 'jibun' END"


@query(f"SELECT id, v AS \"value\", CASE WHEN {_KIND} IS NULL THEN 'invalid' ELSE 'verified' END AS status, {_KIND} AS kind FROM {_ADDR.sql}")
def address_values(spark, d):
    return _ADDR(spark, d).select("id", F.col("v").alias("value"), F.inline(F.array(scalars.validate_address(F.col("v")))))


@query(f"""WITH k AS (SELECT c, v <> '-' AS p, CASE WHEN v <> '-' THEN {_KIND} END AS k FROM {_ADDR.sql}), h AS (SELECT c, count(*) AS n, sum(p::INT) AS s, count(k) FILTER (k = 'road') AS road, count(k) FILTER (k = 'jibun') AS jibun, count(k) FILTER (k = 'postal') AS postal,
CASE c WHEN '도로명주소' THEN 'road' WHEN '지번주소' THEN 'jibun' WHEN '우편번호' THEN 'postal' END AS hk FROM k GROUP BY c),
v AS (SELECT *, CASE WHEN greatest(road, jibun, postal) = 0 THEN NULL WHEN road = greatest(road, jibun, postal) THEN 'road' WHEN jibun = greatest(road, jibun, postal) THEN 'jibun' ELSE 'postal' END AS most, CASE hk WHEN 'road' THEN road WHEN 'jibun' THEN jibun WHEN 'postal' THEN postal ELSE road + jibun + postal END AS ok FROM h)
SELECT c AS "column", coalesce(hk, most) AS kind, CASE WHEN ok::DOUBLE / s >= 0.6 THEN 'verified' WHEN ok = 0 AND hk IS NOT NULL THEN 'invalid' ELSE 'unverified' END AS status,
round(least(1.0::DOUBLE, (CASE WHEN hk IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + 0.7::DOUBLE * ok / s) * (1 - 0.5::DOUBLE * (n - s) / n)), 3) AS quality_score, round(ok::DOUBLE / s, 3) AS valid_ratio, ok::BIGINT AS valid_samples FROM v WHERE hk IS NOT NULL OR most <> 'postal'""")
def address_profile(spark, d):
    return profile.address_profile(_ADDR(spark, d).select(F.col("c").alias("column"), F.col("v").alias("value")))


_GEO = Derived("customer", id="c_custkey", la=in_turn("c_custkey", "'3' || (c_custkey % 10) || '.' || (c_nationkey % 7)", "'33.' || c_custkey", "'40.1'", "''", "'x'", "'39.5'"), lo=in_turn("c_nationkey", "'12' || (c_custkey % 10) || '.' || (c_nationkey % 10)", "'126.' || c_custkey", "'132'", "'y'"))
_GEO_STATUS = "CASE WHEN try_cast(la AS DOUBLE) IS NULL OR try_cast(lo AS DOUBLE) IS NULL THEN 'unverified' WHEN try_cast(la AS DOUBLE) BETWEEN 32 AND 39.5 AND try_cast(lo AS DOUBLE) BETWEEN 124 AND 132 THEN 'verified' ELSE 'invalid' END"


@query(f"SELECT count(*) AS pairs, count(*) FILTER (s = 'verified') AS valid, round((count(*) FILTER (s = 'verified'))::DOUBLE / count(*), 3) AS ratio, CASE WHEN bool_or(s = 'invalid') THEN 'invalid' WHEN bool_or(s = 'unverified') THEN 'unverified' ELSE 'verified' END AS status FROM (SELECT {_GEO_STATUS} AS s FROM {_GEO.sql})")
def coord_profile(spark, d):
    return profile.coordinate_profile(_GEO(spark, d), "la", "lo")


@query(f"SELECT id, {_GEO_STATUS} AS status, CASE WHEN {_GEO_STATUS} = 'verified' THEN try_cast(lo AS DOUBLE) END AS lon, CASE WHEN {_GEO_STATUS} = 'verified' THEN try_cast(la AS DOUBLE) END AS lat FROM {_GEO.sql}")
def geojson_features(spark, d):
    f = _GEO(spark, d).select("id", scalars.geojson_feature(F.col("la"), F.col("lo"), F.struct("id")).alias("f"))
    return f.select("id", F.col("f.coordinate_status").alias("status"), F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"))


_HEADS = Derived("part", id="p_partkey", name=in_turn("p_partkey", "'우편 번호 ' || p_size", "p_name || ' 도로명주소'", "'지번 주소'", "'주소 ' || p_size", "'home_addr'", "'위도'", "'LNG'", "p_name", "' Y 좌표'", "p_type"))


@query(f"SELECT id, name, CASE WHEN name LIKE '%우편%' THEN 'postal' WHEN name LIKE '%도로명%' THEN 'road' WHEN name LIKE '%지번%' THEN 'jibun' WHEN name LIKE '%주소%' OR name LIKE '%addr%' THEN 'address' END AS kind, CASE WHEN name IN ('위도', ' Y 좌표') THEN 'lat' WHEN name = 'LNG' THEN 'lon' END AS axis FROM {_HEADS.sql}")
def header_kinds(spark, d):
    return _HEADS(spark, d).select("id", "name", scalars.header_kind(F.col("name")).alias("kind"), scalars.axis(F.col("name")).alias("axis"))


_PLACES = Derived("customer", r="c_custkey", id=in_turn("c_nationkey", "'c' || c_custkey", "NULL"), a=in_turn("c_custkey", "'서울 세종대로 ' || c_custkey", "' 부산 중앙로 ' || c_nationkey || ' '", "' '", "NULL"))


@query(f"SELECT coalesce(id, 'row-' || r) AS record_id, trim(a) AS address FROM {_PLACES.sql} WHERE trim(a) <> ''")
def geocode_requests(spark, d):
    return profile.geocoding_requests(_PLACES(spark, d), "r", "id", "a")


_PHONES = Derived("customer", id="c_custkey", raw=in_turn("c_custkey", "'02)' || (1234 + c_nationkey) || '-5678'", "'031123' || (4000 + c_nationkey)", "'010 1234 ' || (5000 + c_nationkey)", "'0000'", "'없음'", "'1588-' || (1000 + c_nationkey)", "'02-' || c_nationkey"))


@query(f"WITH p AS (SELECT id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM {_PHONES.sql}) SELECT id, raw, CASE WHEN d = '' OR regexp_full_match(d, '0+') THEN NULL WHEN d LIKE '02%' AND length(d) >= 9 THEN substr(d, 1, 2) || '-' || substr(d, 3, length(d) - 6) || '-' || right(d, 4) WHEN length(d) >= 10 THEN substr(d, 1, 3) || '-' || substr(d, 4, length(d) - 7) || '-' || right(d, 4) ELSE d END AS phone FROM p")
def phone_format(spark, d):
    return _PHONES(spark, d).select("id", "raw", scalars.phone(F.col("raw")).alias("phone"))


# Scans, registries, article texts, blobs.

_KINDS = Derived("customer", id="c_custkey", kind=in_turn("c_custkey", "' link '", "'REST'", "''", "NULL"), other=in_turn("c_nationkey", "'soap'", "''", "NULL"), last="c_mktsegment", wide="c_nationkey % 2 = 0")


@query(f"SELECT id, upper(trim(CASE WHEN coalesce(kind, '') <> '' THEN kind WHEN coalesce(other, '') <> '' THEN other WHEN other IS NULL AND wide THEN last ELSE '' END)) AS api_type FROM {_KINDS.sql}")
def api_types(spark, d):
    """The type by the first and the last of the columns' names, else by its place in rows of thirty cells."""
    pad = lambda n: [F.lit("x")] * n
    cells = F.when(F.col("wide"), F.array(*pad(29), F.col("last"))).otherwise(F.array(*pad(20)))
    row = F.create_map(F.lit("API 유형"), F.col("kind"), F.lit("API타입"), F.col("other"))
    return _KINDS(spark, d).select("id", payloads.api_type_value(row, cells).alias("api_type"))


@query("""WITH r AS (SELECT event_type IN ('click', 'view') AND value < 30 AS found, event_type = 'error' AS failed, value > 10 AS retried, event_type = 'signup' AS waiting FROM events)
SELECT count(*) AS total_scanned, count(*) FILTER (found) AS data_found, count(*) FILTER (NOT found AND NOT failed) AS data_not_found, count(*) FILTER (failed) AS failed, count(*) FILTER (retried) AS retried, count(*) FILTER (retried AND found) AS retry_success, count(*) FILTER (waiting) AS waiting_room_detected,
printf('%.2f%%', 100.0 * count(*) FILTER (retried AND found) / count(*) FILTER (retried)) AS retry_success_rate, printf('%.2f%%', 100.0 * count(*) FILTER (found) / count(*)) AS success_rate FROM r""")
def scan_summary(spark, d):
    kind = F.col("event_type")
    return ledger.scan_summary(table(spark, d, "events"), kind.isin("click", "view") & (F.col("value") < 30), kind == "error", F.col("value") > 10, kind == "signup")


@query("""WITH s AS (SELECT o_custkey, count(*) AS nodes, sum(o_orderkey % 7)::BIGINT AS refs, sum(o_orderkey % 3)::BIGINT AS ok, count(DISTINCT o_orderpriority) AS sources, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'article-verified' WHEN bool_or(o_orderstatus = 'P') THEN 'needs-review' ELSE 'source-linked' END AS status FROM orders GROUP BY 1)
SELECT count(*) AS models, sum(nodes)::BIGINT AS process_nodes, sum(refs)::BIGINT AS article_references, sum(ok)::BIGINT AS verified_references, sum(sources)::BIGINT AS sources, count(*) FILTER (status = 'article-verified') AS article_verified, count(*) FILTER (status = 'needs-review') AS needs_review FROM s""")
def registry_stats(spark, d):
    status = F.col("o_orderstatus")
    state = F.when(F.every(status == "F"), "article-verified").when(F.bool_or(status == "P"), "needs-review").otherwise("source-linked")
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("nodes"), F.sum(F.col("o_orderkey") % 7).alias("refs"), F.sum(F.col("o_orderkey") % 3).alias("ok"), F.countDistinct("o_orderpriority").alias("sources"), state.alias("status"))
    return registry.registry_stats(s, "nodes", "refs", "ok", "sources", "status")


_ARTICLES = Derived("part", id="p_partkey", n="1 + p_partkey % 300", m="1 + p_size", text="'제' || (1 + p_partkey % 300) || '조(목적) 환경영향평가법 제' || (1 + p_size) || '조제1항, 제7조의2에 따른다.' || chr(10) || ' 제2조는 시행령 제5조와 같다.' || chr(10) || '제 ' || (2 + p_partkey % 300) || ' 조의 ' || (1 + p_size) || ' (정의)' || chr(10) || '제9조와 다르다'")


@query(f"SELECT id, '제' || n || '조,제' || (n + 1) || '조의' || m AS headers, array_to_string(list_distinct(['제' || n || '조', '제2조', '제' || (n + 1) || '조의' || m, '제9조']), ',') IS NOT NULL AS masked FROM {_ARTICLES.sql}")
def article_headers(spark, d):
    """The articles that a text has, and whether nothing but its own law's articles is left when other laws' are masked."""
    t = _ARTICLES(spark, d)
    own = F.array(F.concat(F.lit("제"), "n", F.lit("조")), F.lit("제2조"), F.concat(F.lit("제"), F.col("n") + 1, F.lit("조의"), "m"), F.lit("제9조"))
    left = registry.article_references(registry.mask_cross_law(F.col("text")))
    return t.select("id", F.array_join(registry.article_headers(F.col("text")), ",").alias("headers"), ((F.size(F.array_except(left, own)) == 0) & (F.size(F.array_except(own, left)) == 0)).alias("masked"))


_SERVICE = Derived("customer", service_id="c_custkey", name="'<b>' || c_name || '</b>'", description="'about ' || c_mktsegment", category="c_mktsegment", provider_agency_name="'agency ' || c_nationkey", minimal="c_nationkey = 4", body="'body  of ' || c_name", concept="'k' || c_nationkey")
_CALLS = Derived("orders", service_id="o_custkey", ordinal="o_orderkey", path="'/' || o_orderkey", summary="'<i>' || o_orderpriority || '</i>'", field_name="'f' || o_orderkey", field_path="'$.' || o_orderstatus", description="o_orderstatus", alias="'alias ' || o_orderkey")


@query(f"""WITH s AS (SELECT * FROM {_SERVICE.sql}), o AS (SELECT service_id, string_agg(path, ' ' ORDER BY ordinal) AS paths, string_agg(regexp_replace(summary, '<[^>]+>', '', 'g'), ' ' ORDER BY ordinal) AS summaries, string_agg(field_name, ' ' ORDER BY ordinal) AS names, string_agg(description, ' ' ORDER BY ordinal) AS said, string_agg(field_path, ' ' ORDER BY ordinal) AS places, string_agg(alias, ' ' ORDER BY ordinal) AS aliases FROM {_CALLS.sql} GROUP BY 1),
j AS (SELECT s.*, regexp_replace(name, '<[^>]+>', '', 'g') AS plain, replace(body, '  ', ' ') AS b, coalesce(n_name, concept) AS meant, paths, summaries, names, said, places, aliases FROM s LEFT JOIN o USING (service_id) LEFT JOIN nation ON 'k' || n_nationkey = concept AND n_nationkey < 12)
SELECT service_id, CASE WHEN minimal THEN b ELSE trim(regexp_replace(concat_ws(' ', plain, description, 'word ' || category, category, provider_agency_name, b, paths, summaries, names, said, places, aliases, 'domain', concept, meant, 'chunk of ' || plain), ' +', ' ', 'g')) END AS all, plain AS service_name, 'word ' || category AS keywords,
CASE WHEN minimal THEN '' ELSE coalesce(paths, '') END AS endpoint_paths, CASE WHEN minimal THEN '' ELSE coalesce(summaries, '') END AS endpoint_summaries, CASE WHEN minimal THEN '' ELSE coalesce(names, '') END AS field_names, CASE WHEN minimal THEN '' ELSE coalesce(said, '') END AS field_descriptions, CASE WHEN minimal THEN '' ELSE coalesce(places, '') END AS field_paths,
CASE WHEN minimal THEN category ELSE 'domain ' || concept || ' ' || meant END AS semantic FROM j""".replace(" AS all,", ' AS "all",'))
def search_blobs(spark, d):
    s, o = _SERVICE(spark, d), _CALLS(spark, d)
    tables = {
        "services": s.withColumn("keywords", F.array(F.lit("word"), F.col("category"))),
        "documents": s.select("service_id", "body"),
        "endpoints": o,
        "fields": o,
        "mappings": o.withColumn("aliases", F.array("alias")),
        "tags": s.select("service_id", F.array(F.lit("domain")).alias("domain_ids"), F.array("concept").alias("concept_ids")),
        "concepts": table(spark, d, "nation").filter("n_nationkey < 12").select(F.concat(F.lit("k"), "n_nationkey").alias("concept_id"), F.col("n_name").alias("canonical_name")),
        "chunks": s.select("service_id", F.lit(0).alias("ordinal"), F.concat(F.lit("chunk of "), "name").alias("search_text")),
    }
    return chunks.search_blobs(tables, s.filter("minimal"))
