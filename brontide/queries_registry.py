"""Registry, HTML, URL, workflow and stream queries."""

from pyspark.sql import functions as F

from brontide.functions import text, web
from brontide.operators import catalog, harvest, html, payloads, registry, review
from brontide.plans import flow
from brontide.registry_of_queries import query, table
from brontide.sources import files
from brontide.sources.stored import spread
from brontide.streaming import ledger as streams


@query("SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders")
def registry_totals(spark, d):
    n = lambda c: F.count_if(c)
    return table(spark, d, "orders").agg(F.count("*").alias("orders"), n(F.col("o_orderstatus") == "F").alias("verified"), n(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("SELECT o_orderpriority AS facet, count(*) AS n, round(count(*)::DOUBLE / max(count(*)) OVER (), 4) AS bar FROM orders GROUP BY 1")
def facet_counts(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("facet")).agg(F.count("*").alias("n"))
    most = g.agg(F.max("n").alias("most"))
    return g.crossJoin(F.broadcast(most)).select("facet", "n", F.round(F.col("n") / F.col("most"), 4).alias("bar"))


_METRICS = "SELECT o_custkey, count(*)::DOUBLE AS orders, avg(o_totalprice) AS price FROM orders GROUP BY 1"


@query(f"WITH m AS ({_METRICS}), s AS (SELECT avg(orders) AS a, stddev_pop(orders) AS b, avg(price) AS c, stddev_pop(price) AS e FROM m), z AS (SELECT o_custkey, 'orders' AS metric, (orders - a) / b AS z FROM m, s UNION ALL SELECT o_custkey, 'price', (price - c) / e FROM m, s) SELECT o_custkey, metric, round(z, 4) AS z FROM z WHERE abs(z) > 2")
def audit_zscore(spark, d):
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    return registry.z_outliers(m, "o_custkey", ["orders", "price"])


@query("SELECT o_custkey, (3 * max((o_orderstatus = 'P')::INT) + least(sum((o_orderpriority LIKE '1%')::INT), 3) + 2 * sum((o_totalprice > 400000)::INT) + sum((o_totalprice < 50000)::INT))::BIGINT AS priority FROM orders GROUP BY 1")
def audit_priority(spark, d):
    return registry.audit_priority(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "P", F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") > 400000, F.col("o_totalprice") < 50000)


@query("SELECT item_id, len(list_filter(['the', 'with', 'that', 'ing'], lambda w: contains(lower(text), w)))::INT AS signals FROM benchmark")
def keyword_signals(spark, d):
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in ("the", "with", "that", "ing")), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", hits.alias("signals"))


@query("SELECT p_partkey, replace(p_name, ' ', '') || p_size AS name FROM part")
def law_name_compact(spark, d):
    law = F.concat(F.lit("「"), "p_name", F.lit("」 ("), "p_brand", F.lit("), ·"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", registry.compact_law(law).alias("name"))


@query("SELECT p_partkey AS id, '「' || p_name || '」 (x)' AS law, (SELECT min(q.p_name) FROM part q WHERE replace(q.p_name, ' ', '') = replace(p.p_name, ' ', '')) AS source FROM part p UNION ALL SELECT s_suppkey, 'alias ' || s_suppkey, s_name FROM supplier UNION ALL SELECT n_nationkey, 'unknown ' || n_nationkey, NULL FROM nation")
def law_sources(spark, d):
    p, s, n = (table(spark, d, t) for t in ("part", "supplier", "nation"))
    c = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("「"), "p_name", F.lit("」 (x)")).alias("law"))
    c = c.unionByName(s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("alias "), F.col("s_suppkey").cast("string")).alias("law"))).unionByName(n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("unknown "), F.col("n_nationkey").cast("string")).alias("law")))
    sources = p.select(F.col("p_name").alias("name")).unionByName(s.select(F.col("s_name").alias("name"))).distinct()
    return registry.match_sources(c, sources, s.select(F.concat(F.lit("alias  "), F.col("s_suppkey").cast("string")).alias("alias"), F.col("s_name").alias("official")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '제' || l_suppkey || '조,제' || (l_suppkey + 1) || '조,제' || (l_suppkey + 2) || '조,제9999조의2' WHEN l_returnflag = 'A' THEN '제' || l_suppkey || '조의2,제' || l_suppkey || '조의3' ELSE '제1조,제' || (l_suppkey + 500) || '조' END AS refs, l_partkey FROM lineitem")
def article_references(spark, d):
    n = lambda k=0: (F.col("l_suppkey") + k).cast("string")
    say = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    text_ = F.when(F.col("l_returnflag") == "R", say("제", n(), "조~제", n(2), "조 및 제9999조의2, 제", n(1), "조")).when(F.col("l_returnflag") == "A", say("제", n(), "조의2 ~ 제", n(), "조의3")).otherwise(say("제1조 ~ 제", n(500), "조"))
    rows = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey", 32_768)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(registry.article_references(text_), ",").alias("refs"), "l_partkey")


@query("SELECT coalesce(n_nationkey, r) AS k, CASE WHEN p THEN coalesce(e, n_name) ELSE coalesce(n_name, e) END AS v, CASE WHEN n_name IS NULL THEN 'existing' WHEN p THEN 'pinned' ELSE 'generated' END AS origin FROM nation FULL JOIN (SELECT s_suppkey AS r, s_name AS e, s_acctbal > 0 AS p FROM supplier) ON n_nationkey = r")
def merged_sources(spark, d):
    g = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("v"))
    return registry.merge_sources(g, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), (F.col("s_acctbal") > 0).alias("p")), "k", "v", "p")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(range(len(w)), lambda i: CASE WHEN list_position(w, w[i + 1]) = i + 1 THEN w[i + 1] END), lambda x: x IS NOT NULL), '|') AS tokens FROM (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: length(x) >= 2) AS w FROM part)")
def significant_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.significant_tokens(F.concat("p_name", F.lit(" 및, 법률;a ("), "p_type", F.lit(")")), registry.LAW_STOP), "|").alias("tokens"))


@query("SELECT p_brand, count(DISTINCT t) = 1 AND count(*) >= 2 AND min(t) <> '' AS shared, CASE WHEN count(DISTINCT t) = 1 AND count(*) >= 2 AND min(t) <> '' THEN min(t) END AS top FROM (SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN p_brand ELSE p_type END AS t FROM part) GROUP BY p_brand")
def shared_category(spark, d):
    own = F.when(F.endswith("p_brand", F.lit("1")), F.col("p_brand")).otherwise(F.col("p_type"))
    return registry.shared_top_category(table(spark, d, "part").select("p_brand", F.concat(own, F.lit(" - "), F.col("p_name")).alias("category")), "p_brand", "category")


@query("SELECT p_partkey, p_name || ' ' || p_type AS cleaned, p_name || p_type AS stripped, '' AS dash FROM part")
def clean_text_forms(spark, d):
    raw = F.concat(F.lit(" <p>"), "p_name", F.lit("</p>"), "p_type", F.lit("<br/> \n"))
    return table(spark, d, "part").select("p_partkey", text.clean_markup(raw).alias("cleaned"), text.strip_markup(raw).alias("stripped"), text.clean_markup(F.lit(" - ")).alias("dash"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'openapi_new:' || event_id END AS id, CASE WHEN event_type IN ('click', 'view') THEN 'openapi_new' END AS source, CASE WHEN event_type IN ('click', 'view') THEN event_id::VARCHAR END AS api_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN NULL WHEN 'error' THEN 'UNSUPPORTED_SOURCE' ELSE 'INVALID_SERVICE_ID' END AS error FROM events")
def service_ids(spark, d):
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    raw = F.when(kind == "click", F.concat(F.lit(" "), n)).when(kind == "view", F.concat(F.lit("openapi_new:"), n)).when(kind == "error", F.concat(F.lit("other:"), n)).when(kind == "signup", F.concat(F.lit("a b"), n)).otherwise("")
    return table(spark, d, "events").select("event_id", F.inline(F.array(text.service_id(raw))))


@query("SELECT page_id, regexp_extract(url, '/([0-9]+)([/.?#]|$)', 1) AS number, 'api_' || replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_') AS slug, 'https://www.data.go.kr/data/' || page_id || '/fileData.do' AS portal FROM pages")
def url_ids(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "/([0-9]+)([/.?#]|$)", 1).alias("number"), web.api_id(F.col("url")).alias("slug"), web.portal_url(F.col("page_id"), F.lit("fileData")).alias("portal"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'http://' || 'h' || p_size || '/p' ELSE 'https://h' || p_size END AS base FROM part")
def base_urls(spark, d):
    k = F.col("p_size") % 3
    host = F.when(k == 0, "").otherwise(F.concat(F.lit("h"), F.col("p_size").cast("string")))
    schemes = F.when(k == 1, F.array(F.lit("http"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", web.base_url(schemes, host, F.when(k != 2, F.lit("/p"))).alias("base"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN 'Crawling' END AS label, CASE WHEN l_returnflag <> 'N' THEN l_suppkey + 1 END AS done, CASE WHEN l_returnflag <> 'N' THEN (l_suppkey + 1) * 4 END AS total, CASE WHEN l_returnflag <> 'N' THEN 25.0::DOUBLE END AS percent FROM lineitem")
def progress_lines(spark, d):
    n = lambda k: ((F.col("l_suppkey") + 1) * k).cast("string")
    line = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Crawling:  25%|##5   | "), n(1), F.lit("/"), n(4), F.lit(" [00:10<00:12,  4.5it/s]"))).otherwise("plain line")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", web.progress(line).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("p.label").alias("label"), F.col("p.done").cast("bigint").alias("done"), F.col("p.total").cast("bigint").alias("total"), F.col("p.percent").alias("percent"))


@query("SELECT p_partkey, p_name AS v FROM part")
def script_leak(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("` var x = 1; alert(x)"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", web.without_script(raw).alias("v"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END || ',' || lang || ',' || n_chars AS line FROM documents")
def export_csv(spark, d):
    return table(spark, d, "documents").select("doc_id", files.csv_line([F.col("text"), F.col("lang"), F.col("n_chars")]).alias("line"))


@query("SELECT p_partkey AS apiId, p_name AS name, p_brand AS provider, p_type AS category, p_name || ', ' || p_type AS keywords, p_size AS fields, p_retailprice AS searchScore FROM part")
def export_rows(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("apiId"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.col("p_type").alias("category"), F.concat_ws(", ", "p_name", "p_type").alias("keywords"), F.col("p_size").alias("fields"), F.col("p_retailprice").alias("searchScore"))


@query("SELECT p_partkey, '<tr><td>' || p_partkey || '</td><td>' || replace(replace(p_brand, '&', '&amp;'), '<', '&lt;') || '</td></tr>' AS row FROM part")
def export_html(spark, d):
    return table(spark, d, "part").select("p_partkey", files.html_row([F.col("p_partkey"), F.col("p_brand")]).alias("row"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') || '-' || p_size || '.json' AS f FROM part")
def export_filenames(spark, d):
    name = F.concat(F.lit(" "), "p_name", F.lit(":"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ".json").otherwise(" "))
    return table(spark, d, "part").select("p_partkey", text.export_filename(name, "json").alias("f"))


_SUMMARY = "'<b> ' || role || ' </b>' || text || '<b>' || role || '</b>'"


@query(f"SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'empty' WHEN turn = 2 THEN 'unreadable_body' ELSE 'ok' END AS status, CASE WHEN turn IN (1, 2) THEN '' ELSE array_to_string(list_distinct_ordered(list_transform(regexp_extract_all({_SUMMARY}, '(?s)<b>(.*?)</b>', 1), lambda h: trim(h))), '|') END AS headings FROM conversations".replace("list_distinct_ordered(", "list_filter(").replace("lambda h: trim(h)))", "lambda h: trim(h)), lambda h, i: i = 1)"))
def quick_summary(spark, d):
    t = table(spark, d, "conversations")
    whole = F.concat(F.lit("<b> "), "role", F.lit(" </b>"), "text", F.lit("<b>"), "role", F.lit("</b>"))
    body = F.when(F.col("turn") == 1, '{"code": 0, "result": " "}').when(F.col("turn") == 2, "oops").otherwise(F.to_json(F.struct(F.lit(0).alias("code"), whole.alias("result"))))
    s = t.select("conv_id", "turn", payloads.quick_summary(body).alias("s"))
    return s.select("conv_id", "turn", F.col("s.status").alias("status"), F.array_join("s.headings", "|").alias("headings"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""WITH d AS (SELECT l_orderkey AS id, l_linenumber AS i, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS fmt, 'u?atchFileId=' || l_partkey || '&x' AS url, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'u?atchFileId=' || l_partkey || '&amp;x') AS k FROM lineitem WHERE l_linestatus = 'O')
SELECT id, CASE WHEN n = 1 THEN 'file' WHEN fmt <> '' THEN 'file (' || fmt || ')' ELSE 'file_' || k END AS key, url FROM d""")
def download_map(spark, d):
    li = table(spark, d, "lineitem")
    url = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("u?atchFileId="), F.col("l_partkey").cast("string"), F.lit("&amp;x"))).otherwise("elsewhere")
    t = li.select(F.col("l_orderkey").alias("id"), "l_linenumber", F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("fmt"), url.alias("url"), F.lit("file").alias("base"))
    return payloads.download_map(t, "id", "l_linenumber", "fmt", "url", "base")


# HTML.


@query("SELECT page_id, replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.read_html(F.col("html"), "title").alias("title"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS n FROM pages")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(html.read_html(F.col("html"), "links")).cast("bigint").alias("n"))


@query()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.read_html(F.col("html"), "text").alias("text"))


def _page(spark, d):
    """A page for each part, made of its columns, so that SQL can say what must be read from it."""
    t = spread(table(spark, d, "part"), "p_partkey")
    say = lambda *parts: F.concat(*(F.col(x[1:]).cast("string") if x.startswith("$") else F.lit(x) for x in parts))
    return t.select(
        F.col("p_partkey").alias("id"),
        say(
            "<html><head><title>", "$p_name", "</title><meta name='keywords' content='", "$p_type", "'></head><body><input id='publicDataPk' value='", "$p_partkey", "'>",
            "<div id='tab-layer-1'><table><caption>요청변수</caption><thead><tr><th>항목명(영문)</th><th>항목명(국문)</th><th>항목구분</th><th>데이터 타입</th><th>항목설명</th></tr></thead>",
            "<tbody><tr><td><a href='/q", "$p_size", "'>", "$p_name", "</a></td><td>이름</td><td>필수</td><td>string</td><td>", "$p_type", "</td></tr><tr><td>page</td><td></td><td>옵션</td><td></td><td>쪽</td></tr></tbody></table></div>",
            "<table><caption>응답</caption><tr><th>HTTP 상태코드</th><th>항목명(영문)</th><th>설명</th></tr><tr><td>200</td><td>", "$p_brand", "</td><td>ok</td></tr></table>",
            "<strong class='key'>제공기관</strong><div class='value'> ", "$p_brand", " </div><select id='open_api_detail_select'><option value='", "$p_size", "' selected>", "$p_name", "</option><option value=''>-</option></select>",
            "<p>요청방식 GET 요청주소 https://h.kr/api/", "$p_partkey", "</p><script type='application/ld+json'><![CDATA[{\"@type\": \"https://schema.org/Dataset\", \"description\": \"say \"", "$p_brand", "\", and more\", \"name\": \"", "$p_name", "\",}]]></script><script type='application/ld+json'>{\"@type\": \"NotADataset\", \"name\": \"no\"}</script></body></html>",
        ).alias("html"),
    )


@query("SELECT p_partkey AS id, '제공기관' AS k, p_brand AS v FROM part")
def html_key_values(spark, d):
    return _page(spark, d).select("id", F.explode(html.read_html(F.col("html"), "key_values")).alias("k", "v"))


@query("SELECT p_partkey AS id, p_name AS name, p_type AS note, '/q' || p_size AS link FROM part UNION ALL SELECT p_partkey, 'page', '쪽', NULL FROM part")
def html_grid(spark, d):
    g = _page(spark, d).select("id", F.explode(html.read_html(F.col("html"), "grid")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return g.select("id", at("항목명(영문)").alias("name"), at("항목설명").alias("note"), at("항목명(영문)_link").alias("link"))


@query("""SELECT p_partkey AS id, 'request' AS section, p_name AS name, '이름: ' || p_type AS description, true AS required, 'string' AS type, 'unverified' AS status_code FROM part
UNION ALL SELECT p_partkey, 'request', 'page', '쪽', false, 'unverified', 'unverified' FROM part UNION ALL SELECT p_partkey, 'response', p_brand, p_brand || ': ok', false, 'unverified', '200' FROM part""")
def html_parameters(spark, d):
    return _page(spark, d).select("id", F.inline(html.read_html(F.col("html"), "parameters")))


@query("SELECT p_partkey AS id, p_size::VARCHAR AS value, p_name AS name, true AS selected FROM part")
def html_options(spark, d):
    return _page(spark, d).select("id", F.inline(html.read_html(F.col("html"), "options")))


@query("SELECT p_partkey AS id, p_size::VARCHAR AS value, p_name AS name, true AS selected, 'unverified' AS detail_key, p_partkey::VARCHAR AS data_key FROM part")
def html_functions(spark, d):
    return _page(spark, d).select("id", F.inline(html.read_html(F.col("html"), "functions")))


@query("""SELECT p_partkey AS id, p_name AS name, 'say "' || p_brand || '", and more' AS description FROM part""")
def html_datasets(spark, d):
    j = _page(spark, d).select("id", F.explode(html.read_html(F.col("html"), "datasets")).alias("j"))
    return j.select("id", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.description").alias("description"))


@query("SELECT p_partkey AS id, p_name AS title, p_type AS keywords FROM part")
def html_metadata(spark, d):
    p = _page(spark, d).select("id", html.read_html(F.col("html"), "title", "metadata").alias("p"))
    return p.select("id", F.col("p.title").alias("title"), F.col("p.metadata.keywords").alias("keywords"))


@query("SELECT p_partkey AS id, 'GET' AS method, '/api/' || p_partkey AS path FROM part")
def html_stated(spark, d):
    t = _page(spark, d).select("id", html.read_html(F.col("html"), "text").alias("t"))
    return t.select("id", html.stated_method(F.col("t")).alias("method"), html.stated_path(F.col("t")).alias("path"))


@query("SELECT DISTINCT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages WHERE url LIKE 'https://%' AND url NOT LIKE '%.example.org/%'")
def link_tasks(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", web.host(F.col("url")).alias("host"))
    return p.filter(F.lower("url").startswith("https://") & ~F.endswith("host", F.lit(".example.org"))).dropDuplicates(["page_id", "url"])


@query("SELECT c_custkey, c_name || '가' AS text, CASE c_nationkey % 3 WHEN 0 THEN 'utf-16' WHEN 1 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, true AS verified FROM customer")
def decode_text(spark, d):
    text_ = F.concat("c_name", F.lit("가"))
    mark = F.col("c_nationkey") % 3
    content = F.when(mark == 0, F.encode(text_, "UTF-16")).when(mark == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text_, "UTF-8"))).otherwise(F.encode(text_, "UTF-8"))
    return files.decoded(table(spark, d, "customer").select("c_custkey", content.alias("content"))).drop("content")


#: A file for each customer: in turn a CSV with repeated and blank headers, a JSON table, a single JSON object, broken JSON, JSON that is no table, and a format that is not read.
_FILE = "c_custkey % 6"


def _files(spark, d):
    kind, key, name = F.expr(_FILE), F.col("c_custkey").cast("string"), F.col("c_name")
    body = F.when(kind == 0, F.concat(F.lit("id;id;\n"), key, F.lit(";"), name, F.lit(";\n;;\n"))).when(kind == 1, F.concat(F.lit('{"items": [{"k": '), key, F.lit('}, {"v": [1, 2]}]}'))).when(kind == 2, F.concat(F.lit('{"k": "'), name, F.lit('"}'))).when(kind == 3, "{oops").when(kind == 4, "[1, 2]").otherwise("PK")
    path = F.concat(key, F.when(kind == 0, ".csv").when(kind == 5, ".zip").otherwise(".json"))
    return table(spark, d, "customer").select(path.alias("path"), F.encode(body, "UTF-8").alias("content"))


@query(f"""WITH c AS (SELECT *, {_FILE} AS f FROM customer)
SELECT c_custkey || '.csv' AS path, 0 AS row, unnest(['id', 'id_2', 'column_3']) AS "column", unnest([c_custkey::VARCHAR, c_name, '']) AS "value" FROM c WHERE f = 0
UNION ALL SELECT c_custkey || '.json', unnest([0, 0, 1, 1]), unnest(['k', 'v', 'k', 'v']), unnest([c_custkey::VARCHAR, '', '', '[1, 2]']) FROM c WHERE f = 1 UNION ALL SELECT c_custkey || '.json', 0, 'k', c_name FROM c WHERE f = 2""")
def table_cells(spark, d):
    return files.read_cells(_files(spark, d)).withColumn("row", F.col("row").cast("int"))


@query(f"SELECT c_custkey || CASE f WHEN 0 THEN '.csv' WHEN 5 THEN '.zip' ELSE '.json' END AS path, CASE WHEN f < 3 THEN 'ok' WHEN f = 3 THEN 'error' ELSE 'unsupported' END AS status, CASE f WHEN 0 THEN 'csv' WHEN 5 THEN 'unknown' ELSE 'json' END AS format, CASE f WHEN 0 THEN 'id,id_2,column_3' WHEN 1 THEN 'k,v' WHEN 2 THEN 'k' ELSE '' END AS columns, CASE f WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS rows FROM (SELECT *, {_FILE} AS f FROM customer)")
def table_statuses(spark, d):
    return files.table_status(_files(spark, d)).select("path", "status", "format", F.array_join("columns", ",").alias("columns"), "rows")


@query("SELECT c_custkey || '.csv' AS path, 'euc-kr' AS encoding, c_custkey AS number, c_name AS name FROM customer")
def catalog_numbers(spark, d):
    body = F.concat(F.lit("name,key\n"), F.col("c_name"), F.lit(","), F.col("c_custkey").cast("string"), F.lit("\nnone,x\n"))
    f = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return files.catalog_rows(f).select("path", "encoding", "number", F.col("row.name").alias("name"))


# Workflows and streams.


def _flow_docs(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("apiId"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.col("p_type").alias("category"), F.col("p_name").alias("keywords"), F.lit("").alias("description"), F.col("p_retailprice").alias("searchScore"))


@query("""WITH a AS (SELECT p_partkey AS apiId, p_name AS name, 0 AS part FROM part WHERE contains(lower(p_brand), 'brand#1')), b AS (SELECT p_partkey, p_name, 1 FROM part WHERE contains(lower(p_type), 'small') OR contains(lower(p_name), 'small')), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT apiId, name, min(u.part)::INT AS part FROM u GROUP BY apiId, name""")
def flow_pipeline(spark, d):
    """Two filters over all parts, merged in the order of their edges, the first of each id."""
    docs = _flow_docs(spark, d)
    nodes = [{"id": "p", "type": "providerFilter", "data": {"provider": "Brand#1"}}, {"id": "c", "type": "categoryFilter", "data": {"category": "Small"}}, {"id": "m", "type": "mergeNode"}, {"id": "o", "type": "exportNode", "data": {"filename": "x", "format": "csv"}}]
    edges = [{"source": s, "target": t} for s, t in (("all", "p"), ("all", "c"), ("p", "m"), ("c", "m"), ("m", "o"))]
    out = flow.compile_flow(docs, [{"id": "all", "type": "apiDocs"}, *nodes], edges, "o", given={"all": docs})["m"]
    return out.docs.select("apiId", "name", F.col("ordinal.part").alias("part"))


@query("SELECT key, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(string_split(source || ',' || lang, ',')) AS key FROM documents) GROUP BY key")
def merge_fields(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("source", "lang").alias("fields"))
    return flow.merged_field_keys(docs, "fields", "doc_id").select("key", F.col("at").alias("first_doc"))


@query("SELECT o_orderkey, 'API 1. ' || c_name AS first, 'API 2. ' || o_orderpriority AS second, '사용자 질문: ' || o_orderkey AS asked FROM orders JOIN customer ON o_custkey = c_custkey")
def analysis_prompts(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    doc = lambda name: F.struct(F.col(name).alias("name"), F.col("c_mktsegment").alias("provider"), F.lit("x").alias("category"), F.array("o_orderstatus").alias("keywords"), F.lit("").alias("description"), F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("desc"))).alias("fields"), F.expr("cast(array() as array<struct<method:string,path:string,description:string>>)").alias("endpoints"))
    p = o.select("o_orderkey", text.analysis_prompt(F.array(doc("c_name"), doc("o_orderpriority")), F.col("o_orderkey").cast("string")).alias("p"))
    line = lambda pattern: F.regexp_extract("p", f"(?m)^({pattern}.*)$", 1)
    return p.select("o_orderkey", line("API 1").alias("first"), line("API 2").alias("second"), line("사용자").alias("asked"))


@query("SELECT n_nationkey, (n_nationkey % 3) * 320 AS x, (n_nationkey // 3) * 220 AS y FROM nation")
def flow_layout(spark, d):
    n = flow.layout(table(spark, d, "nation").select("n_nationkey"), "n_nationkey")
    return n.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return streams.event_windows(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id::VARCHAR AS who, 'x' AS fixed, NULL::VARCHAR AS gone FROM events")
def render_template(spark, d):
    template = F.create_map(*map(F.lit, ("who", "$user", "fixed", "x", "gone", "$none")))
    m = payloads.render_payload(template, F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", *(F.col(f"m.{k}").alias(k) for k in ("who", "fixed", "gone")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts)::TIMESTAMP END AS at FROM events")
def iso_times(spark, d):
    """Times written with the zone Z; the zone of the session is UTC here, as the driver's and the tests'."""
    said = F.when(F.col("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "events").select("event_id", payloads.iso_time(said).cast("timestamp_ntz").alias("at"))


_ORD = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(f"SELECT event_id, {_ORD} - coalesce(lag({_ORD}) OVER (PARTITION BY user_id ORDER BY event_id), 0) = 1 AS follows FROM events")
def stage_order(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.expr(_ORD).alias("ord"))
    return payloads.stages_in_order(t, "user_id", "event_id", "ord").select("event_id", "follows")


@query("SELECT user_id AS run, CASE WHEN bool_or(event_type = 'error') THEN 'contradiction' ELSE 'evidence_gap' END AS verdict FROM events WHERE event_type <> 'view' GROUP BY user_id")
def critic_verdict(spark, d):
    found = table(spark, d, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("run"), F.col("event_type").alias("rule"))
    return review.verdict(found, ("error",))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'r' || o_custkey WHEN 'O' THEN 'p' || o_custkey ELSE 'a,b,c' END AS picked FROM orders")
def selection_fallback(spark, d):
    none = F.array().cast("array<string>")
    one = lambda mark, status: F.when(F.col("o_orderstatus") == status, F.array(F.concat(F.lit(mark), F.col("o_custkey").cast("string")))).otherwise(none)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(payloads.picked(one("r", "F"), one("p", "O"), F.array(*map(F.lit, "abcd"))), ",").alias("picked"))


@query("SELECT user_id AS host, arg_min(event_type, event_id) AS protocol, min(event_id) AS ord FROM events GROUP BY user_id")
def protocol_probe(spark, d):
    """The first protocol in the order of probing that answers, per host."""
    t = table(spark, d, "events").select(F.col("user_id").alias("host"), F.col("event_type").alias("protocol"), F.col("event_id").alias("ord"))
    return catalog.first_per_key(t, ["host"], "ord")


_CODE = "CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 200 WHEN 'error' THEN 404 WHEN 'signup' THEN 0 ELSE 500 END"


@query(f"SELECT event_id, CASE {_CODE} WHEN 200 THEN CASE WHEN event_type = 'view' THEN 'waiting_room_timeout' ELSE 'success' END WHEN 404 THEN 'not_found' WHEN 0 THEN 'timeout' ELSE 'error' END AS status FROM events")
def scan_status(spark, d):
    t = table(spark, d, "events").select("event_id", F.expr(_CODE).alias("code"), F.when(F.col("event_type") == "view", "<p>접속 대기실</p>").otherwise("{}").alias("body"))
    waiting = harvest.waiting_room(F.lit("u"), F.lit("text/html"), F.col("body"))
    return t.select("event_id", harvest.scan_status(F.col("code"), F.col("body"), waiting).alias("status"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS places FROM lineitem GROUP BY ALL")
def issue_groups(spark, d):
    g = registry.issue_groups(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber")
    return g.withColumn("places", F.array_join(F.transform("places", lambda x: x.cast("string")), ","))


_REFS = "SELECT l_suppkey AS slug, CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'missing' WHEN l_returnflag = 'A' AND l_quantity > 49 THEN 'uncheckable' ELSE 'verified' END AS s FROM lineitem"
_COVERAGE = f"""SELECT s_suppkey AS slug, s_nationkey AS priority, coalesce(n, 0)::BIGINT AS article_references, coalesce(v, 0)::BIGINT AS verified, coalesce(m, 0)::BIGINT AS missing, coalesce(u, 0)::BIGINT AS uncheckable, (s_acctbal < 0)::INT AS unresolved, CASE WHEN s_acctbal >= 0 AND coalesce(m, 0) = 0 AND coalesce(u, 0) = 0 THEN 'article-verified' ELSE 'needs-review' END AS status
FROM supplier LEFT JOIN (SELECT slug, count(*) AS n, count(*) FILTER (s = 'verified') AS v, count(*) FILTER (s = 'missing') AS m, count(*) FILTER (s = 'uncheckable') AS u FROM ({_REFS}) GROUP BY slug) ON slug = s_suppkey"""


def _coverage(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slug"), F.expr(_REFS[_REFS.index("CASE") : _REFS.index(" AS s FROM")]).alias("status"))
    some = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_nationkey").alias("priority"), (F.col("s_acctbal") < 0).cast("int").alias("unresolved"))
    return registry.article_coverage(refs, some)


@query(_COVERAGE)
def coverage_report(spark, d):
    return _coverage(spark, d)


@query(f"SELECT count(*) AS institutions, count(*) FILTER (status = 'article-verified') AS article_verified, sum(article_references)::BIGINT AS article_references, sum(verified)::BIGINT AS verified, sum(missing)::BIGINT AS missing, sum(uncheckable)::BIGINT AS uncheckable, sum(unresolved)::BIGINT AS unresolved FROM ({_COVERAGE})")
def coverage_totals(spark, d):
    return registry.coverage_totals(_coverage(spark, d))