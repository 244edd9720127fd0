"""Queries of portals, critics, argument and process graphs and law sources: inputs are worked out from tables by expressions that every engine reads alike."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.operators import harvest, ledger, registry, review
from brontide.plans import tables
from brontide.registry_of_queries import Derived, in_turn, query, table
from brontide.sources import csv_ranges, sinks
from brontide.sources.stored import shared_folder

# Portals.

_ASKED = "'/api/3/action/package_list'"
_FIRST = Derived("supplier", host="'s' || s_suppkey || '.kr'", path=_ASKED, body=in_turn("s_suppkey", "'{\"success\": true, \"result\": [\"x' || s_suppkey || '\", \"y\"]}'", "'oops'", "'{\"success\": false, \"result\": []}'"))
_SECOND = Derived(
    "supplier",
    host="'s' || s_suppkey || '.kr'",
    path=in_turn("s_nationkey", "'/openapi.json'", "'/sitemap.xml'", "'/'", "'/sitemap.xml'"),
    body=in_turn("s_nationkey", "'{\"openapi\": \"3\", \"paths\": {}, \"info\": {\"title\": \"T' || s_suppkey || '\"}}'", "'<urlset><url><loc> http://s.kr/p/' || s_suppkey || ' </loc></url><url><loc>http://s.kr/q?a=1&amp;b=' || s_suppkey || '</loc></url></urlset>'", "'<html></html>'", "''"),
)
_BEST = f"""WITH r AS (SELECT host, path, body, 1 AS o, 'ckan' AS protocol FROM {_FIRST.sql} WHERE body LIKE '%"success": true%' UNION ALL
SELECT host, path, body, CASE path WHEN '/openapi.json' THEN 2 WHEN '/sitemap.xml' THEN 3 ELSE 4 END, CASE path WHEN '/openapi.json' THEN 'openapi' WHEN '/sitemap.xml' THEN 'sitemap' ELSE 'generic' END FROM {_SECOND.sql} WHERE body <> ''),
b AS (SELECT host, arg_min({{'protocol': protocol, 'path': path, 'body': body}}, o) AS b FROM r GROUP BY host)"""


def _responses(spark, d):
    return _FIRST(spark, d).unionByName(_SECOND(spark, d))


@query(f"{_BEST} SELECT h.host, coalesce(b.protocol, 'none') AS protocol, b.path AS path FROM {_FIRST.sql} h LEFT JOIN b USING (host)")
def portal_protocols(spark, d):
    return harvest.harvest(_responses(spark, d))


@query(f"""{_BEST}, i AS (SELECT host, b.protocol AS p, b.body AS body FROM b WHERE b.protocol <> 'generic'),
u AS (SELECT host, unnest(list_transform(regexp_extract_all(body, '<loc>\\s*([^<]*?)\\s*</loc>', 1), lambda x: replace(x, '&amp;', '&'))) AS url FROM i WHERE p = 'sitemap')
SELECT host, n AS name, 'http://' || host || '/dataset/' || n AS url FROM (SELECT host, unnest(regexp_extract_all(split_part(body, '[', 2), '"([^"]*)"', 1)) AS n FROM i WHERE p = 'ckan') UNION ALL
SELECT host, split_part(split_part(body, '"title": "', 2), '"', 1), 'http://' || host FROM i WHERE p = 'openapi' UNION ALL SELECT host, regexp_extract(url, '([^/]*)$', 1), url FROM u""")
def portal_items(spark, d):
    t = _responses(spark, d)
    best = harvest.harvest(t).filter("protocol in ('ckan', 'openapi', 'sitemap')").join(t, ["host", "path"])
    base = F.concat(F.lit("http://"), F.col("host"))
    every = F.when(F.col("protocol") == "ckan", harvest.items_of("ckan", F.col("body"), base)).when(F.col("protocol") == "openapi", harvest.items_of("openapi", F.col("body"), base)).otherwise(harvest.items_of("sitemap", F.col("body"), base))
    return best.select("host", F.inline(every))


_LANDED = Derived(
    "events",
    id="event_id",
    code=in_turn("event_id", "200", "404", "0", "500", "200"),
    url=in_turn("user_id", "'http://h/' || event_id", "'http://h/WaitingRoom/' || event_id", "'u'"),
    kind=in_turn("user_id", "'text/html; charset=utf-8'", "'application/json'", "'TEXT/HTML'", "NULL"),
    body=in_turn("event_id", "'<p>접속 대기실 ' || user_id || '</p>'", "'{\"대기실\": \"접속\"}'", "''", "'<p>' || event_type || '</p>'", "NULL", "'Please wait: traffic ' || event_id", "'<b>대기실</b>'"),
)


@query(f"""WITH w AS (SELECT *, lower(url) LIKE '%waitingroom%' OR (lower(coalesce(kind, '')) LIKE '%text/html%' AND NOT json_valid(coalesce(body, 'x')) AND ((body LIKE '%대기실%' AND body LIKE '%접속%') OR (lower(body) LIKE '%please wait%' AND lower(body) LIKE '%traffic%'))) AS wait FROM {_LANDED.sql})
SELECT id, CASE WHEN wait THEN 'waiting_room_timeout' WHEN code = 200 AND coalesce(body, '') <> '' THEN 'success' WHEN code = 404 THEN 'not_found' WHEN code = 0 THEN 'timeout' ELSE 'error' END AS status FROM w""")
def landed_status(spark, d):
    w = harvest.waiting_room(F.col("url"), F.col("kind"), F.col("body"))
    return _LANDED(spark, d).select("id", harvest.scan_status(F.col("code"), F.col("body"), w).alias("status"))


_HOST = in_turn("c_custkey", "'127.0.0.' || (c_nationkey + 1)", "'10.1.' || c_nationkey || '.3'", "'169.254.' || c_nationkey || '.1:80'", "'user@192.168.0.' || c_nationkey", "'x' || c_custkey || '.kr'", "'8.8.' || c_nationkey || '.8'", "'224.0.0.' || (c_nationkey + 1)", "''", "'172.16.' || c_nationkey || '.1'", "'0.0.0.0'")
_TARGETS = Derived("customer", id="c_custkey", url=in_turn("c_nationkey", "'http://'", "'https://'", "'ftp://'", "' HTTPS://'").replace(" END", f" END || {_HOST} || '/p?q=1'"))


@query(f"""WITH h AS (SELECT *, regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1) AS a FROM {_TARGETS.sql}), n AS (SELECT *, regexp_replace(regexp_replace(a, '^.*@', ''), ':[0-9]*$', '') AS h FROM h)
SELECT id, url, CASE WHEN NOT regexp_matches(trim(url), '^(?i)https?://') THEN 'scheme' WHEN h = '' THEN 'host' WHEN h LIKE '127.%' THEN 'loopback' WHEN h LIKE '169.254.%' THEN 'link_local' WHEN regexp_matches(h, '^(10|192[.]168|172[.]16|0)[.][0-9]') THEN 'private' WHEN h LIKE '224.%' THEN 'special' END AS why FROM n""")
def fetch_targets(spark, d):
    return _TARGETS(spark, d).select("id", "url", harvest.rejection(F.col("url")).alias("why"))


_ACCOUNTS = Derived(
    "customer",
    id="c_custkey",
    html="'<a href=\"#\" onclick=\"fn_detail(' || chr(39) || 'A' || c_custkey || chr(39) || ', 3)\">[승인] x</a><a onclick=\"fn_detail(' || chr(39) || 'A' || c_custkey || chr(39) || ', 3)\">x</a><a onclick=\"fn_detail(' || chr(39) || 'B' || c_nationkey || chr(39) || ', 4)\">y</a><a onclick=\"goPage(' || (2 + c_nationkey) || ')\">n</a><a onclick=\"goPage(1)\">1</a><p class=\"total-count\">총 ' || (1 + c_nationkey) || ',' || (100 + c_custkey % 900) || '건</p>'",
)


@query("SELECT c_custkey AS id, 'A' || c_custkey || '/3|B' || c_nationkey || '/4' AS rows, '1,' || (2 + c_nationkey) AS pages, ((1 + c_nationkey) * 1000 + 100 + c_custkey % 900)::INT AS total FROM customer")
def account_list(spark, d):
    t = _ACCOUNTS(spark, d).select("id", harvest.account_page(F.col("html")).alias("p"))
    return t.select("id", F.array_join(F.transform("p.rows", lambda r: F.array_join(r, "/")), "|").alias("rows"), F.array_join(F.transform("p.pages", lambda x: x.cast("string")), ",").alias("pages"), F.col("p.total").alias("total"))


# Critics: a customer's orders are a run.

_ORDERS = Derived("orders", run="o_custkey", id="o_orderkey % 6", item="'m' || (o_orderkey % 3)", text="'lost m' || (o_totalprice > 250000) || ' m' || (o_orderkey % 2) || ' here'", status="o_orderstatus", urgent="o_orderpriority LIKE '1%'", dear="o_totalprice > 60000")
_STAGE = "CASE event_type WHEN 'signup' THEN 'search' WHEN 'view' THEN 'detail' WHEN 'click' THEN 'relations' WHEN 'purchase' THEN 'compose' ELSE 'other' END"
_STAGES = Derived("events", run="user_id", ord="event_id", name=_STAGE, status="CASE WHEN value > 15 THEN 'skipped' ELSE 'ok' END")
_CRITIC = f"""WITH o AS (SELECT * FROM {_ORDERS.sql}), s AS (SELECT run, id FROM o WHERE status = 'F'), n AS (SELECT run, count(*) AS n, count(DISTINCT id) AS d FROM s GROUP BY run),
g AS (SELECT *, array_position(['search', 'detail', 'relations', 'compose'], name) AS p FROM {_STAGES.sql}), q AS (SELECT run, p, lag(p) OVER (PARTITION BY run ORDER BY ord) AS q FROM g WHERE p > 0),
m AS (SELECT DISTINCT run, item FROM o WHERE status = 'P'), w AS (SELECT run, text FROM o WHERE urgent),
f AS (SELECT run, 'selected-subset-of-details' AS rule, id::VARCHAR AS subject FROM s WHERE (run, id) NOT IN (SELECT run, id FROM o WHERE status = 'O') UNION ALL
SELECT run, 'selected-in-search', id::VARCHAR FROM s WHERE (run, id) NOT IN (SELECT run, id FROM o WHERE dear) UNION ALL
SELECT run, 'relations-not-skipped', 'relations' FROM g WHERE name = 'relations' AND status = 'skipped' AND run IN (SELECT run FROM n WHERE n >= 2) UNION ALL
SELECT run, 'plan-missing-reported', item FROM m WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.run = m.run AND contains(w.text, m.item)) UNION ALL
SELECT run, 'contract-limits', 'too many' FROM n WHERE n > 3 UNION ALL SELECT run, 'contract-limits', 'repeated' FROM n WHERE n <> d UNION ALL SELECT DISTINCT run, 'contract-limits', 'stage order' FROM q WHERE p < q)"""


@query(f"{_CRITIC} SELECT * FROM f")
def critic_findings(spark, d):
    o = _ORDERS(spark, d)
    key = lambda where: o.filter(where).select("run", "id")
    return review.critic(key("status = 'F'"), key("status = 'O'").distinct(), key("dear").distinct(), _STAGES(spark, d), o.filter("status = 'P'").select("run", "item").distinct(), o.filter("urgent").select("run", "text"))


@query(f"{_CRITIC} SELECT run, CASE WHEN bool_or(rule = 'selected-in-search') THEN 'contradiction' ELSE 'evidence_gap' END AS verdict FROM f GROUP BY run")
def critic_verdicts(spark, d):
    return review.verdict(critic_findings(spark, d), ("selected-in-search",))


# Argument graphs: in turn a support cycle of two, of one, and two claims that attack each other; some edges lead nowhere.

_CLAIMS = Derived("customer", node="c_custkey", kind="CASE WHEN c_nationkey > 20 THEN 'premise' ELSE 'claim' END")
_EDGES = Derived("customer", src="c_custkey", dst="CASE WHEN c_nationkey = 3 THEN c_custkey + 1000000 ELSE " + in_turn("c_custkey", "c_custkey + 1", "c_custkey - 1", "c_custkey", "c_custkey + 1", "c_custkey - 1") + " END", kind=in_turn("c_custkey", "'support'", "'support'", "'support'", "'attack'", "'attack'"))


@query(f"""WITH n AS (SELECT * FROM {_CLAIMS.sql}), e AS (SELECT * FROM {_EDGES.sql}), g AS (SELECT * FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n))
SELECT 'dangling-edge' AS code, src || '>' || dst AS subject FROM e WHERE (src, dst) NOT IN (SELECT src, dst FROM g) UNION ALL
SELECT 'support-cycle', CASE WHEN a.src = a.dst THEN '' || a.src ELSE a.src || '>' || a.dst END FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src AND a.kind = 'support' AND b.kind = 'support' WHERE a.src <= a.dst UNION ALL
SELECT 'unsupported-claim', '' || node FROM n WHERE kind = 'claim' AND node NOT IN (SELECT dst FROM g WHERE kind = 'support') UNION ALL
SELECT 'unresolved-conflict', '' || a.src FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src AND a.kind = 'attack' AND b.kind = 'attack'""")
def argument_findings(spark, d):
    return review.judge_arguments(_CLAIMS(spark, d), _EDGES(spark, d))


# Process graphs, registries and plans.

_STEPS = Derived("customer", node="c_custkey", lane="c_mktsegment", stage="'S' || (c_nationkey % 5)")
_FLOW = Derived("customer", src="c_custkey", dst=in_turn("c_custkey", "c_custkey + 1", "c_custkey + 2", "(c_custkey * 7) % 1600", "c_custkey - 1"), type="CASE WHEN c_nationkey % 3 = 0 THEN 'loop' ELSE 'sequence' END")
_STAGED = Derived("nation", stage="'S' || (n_nationkey % 7)", ord="n_nationkey % 7")
_LANES = "(SELECT c_mktsegment AS lane FROM customer UNION SELECT n_name FROM nation)"


@query(f"""WITH RECURSIVE n AS (SELECT * FROM {_STEPS.sql}), e AS (SELECT * FROM {_FLOW.sql} WHERE dst IN (SELECT node FROM n)), q AS (SELECT * FROM e WHERE type = 'sequence'), t AS (SELECT DISTINCT * FROM {_STAGED.sql}),
r(node) AS (SELECT node FROM n WHERE node NOT IN (SELECT dst FROM q) UNION SELECT dst FROM r JOIN e ON src = node), lone AS (SELECT node FROM n WHERE node NOT IN (SELECT src FROM e UNION SELECT dst FROM e))
SELECT 'orphan-node' AS rule, '' || node AS subject FROM lone UNION ALL SELECT 'no-terminal', 'graph' WHERE NOT EXISTS (SELECT 1 FROM n WHERE node NOT IN (SELECT src FROM q)) UNION ALL
SELECT 'unreachable-node', '' || node FROM n WHERE node NOT IN (SELECT node FROM r) AND node NOT IN (SELECT node FROM lone) UNION ALL
SELECT 'backward-sequence', src || '>' || dst FROM q JOIN n a ON src = a.node JOIN n b ON dst = b.node JOIN t x ON a.stage = x.stage JOIN t y ON b.stage = y.stage WHERE y.ord < x.ord UNION ALL
SELECT 'empty-lane', lane FROM {_LANES} WHERE lane NOT IN (SELECT lane FROM n) UNION ALL SELECT 'empty-stage', stage FROM t WHERE stage NOT IN (SELECT stage FROM n)""")
def process_audit(spark, d):
    lanes = table(spark, d, "customer").select(F.col("c_mktsegment").alias("lane")).union(table(spark, d, "nation").select("n_name")).distinct()
    return review.audit_process(_STEPS(spark, d), _FLOW(spark, d), lanes, _STAGED(spark, d).distinct())


_NODES = Derived("part", node="p_partkey - p_partkey % 2 * CASE WHEN p_size = 7 THEN 1 ELSE 0 END", lane="p_brand", type="p_type", confidence="p_size / 40.0E0", current="p_size = 1")
_LINKS = Derived("part", src="p_partkey", dst="p_partkey + p_size * 40")
_SAID = Derived("part", lane="p_brand || CASE WHEN p_size = 50 THEN 'x' ELSE '' END", size="p_size")


@query(f"""WITH n AS (SELECT * FROM {_NODES.sql}), e AS (SELECT * FROM {_LINKS.sql}), l AS (SELECT lane FROM n GROUP BY lane HAVING min(node) > 3), c AS (SELECT lane, count(*) FILTER (current) AS k, count(*) AS held FROM n GROUP BY lane), s AS (SELECT lane, count(*) AS n FROM {_SAID.sql} GROUP BY lane)
SELECT 'repeated-id' AS rule, '' || node AS subject FROM n GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'unknown-end', src || '>' || dst FROM e WHERE src NOT IN (SELECT node FROM n) OR dst NOT IN (SELECT node FROM n) UNION ALL
SELECT 'type-not-allowed', '' || node FROM n WHERE type NOT IN ('SMALL', 'ECONOMY') UNION ALL SELECT 'confidence-out-of-range', '' || node FROM n WHERE confidence > 1 UNION ALL SELECT 'lane-unknown', '' || node FROM n WHERE lane NOT IN (SELECT lane FROM l) UNION ALL
SELECT 'no-current', lane FROM c WHERE k = 0 UNION ALL SELECT 'several-current', lane FROM c WHERE k > 1 UNION ALL SELECT 'count-mismatch', lane FROM s LEFT JOIN c USING (lane) WHERE n <> coalesce(held, 0)""")
def registry_validation(spark, d):
    n = _NODES(spark, d)
    lanes = n.groupBy("lane").agg(F.min("node").alias("first")).filter("first > 3")
    declared = _SAID(spark, d).groupBy("lane").agg(F.count("*").alias("n"))
    return review.validate_registry(n, _LINKS(spark, d), {"type": ("SMALL", "ECONOMY")}, {"confidence": (0, 1)}, {"lane": lanes}, ("lane", "current"), declared)


_TASKS = Derived("part", node="CASE WHEN p_size = 9 THEN p_partkey - 1 ELSE p_partkey END")
_DEPS = Derived("part", src=in_turn("p_partkey", "p_partkey - 1", "p_partkey", "p_partkey + 1", "p_partkey + 100000", "p_partkey - 2"), dst="p_partkey")


@query(f"""WITH RECURSIVE t AS (SELECT node FROM {_TASKS.sql}), e AS (SELECT * FROM {_DEPS.sql}), i AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)),
c(seed, node) AS (SELECT src, dst FROM i UNION SELECT seed, dst FROM c JOIN i ON node = src), y AS (SELECT DISTINCT node FROM c WHERE seed = node), b AS (SELECT node FROM y UNION SELECT c.node FROM c JOIN y ON c.seed = y.node)
SELECT 'repeated' AS rule, '' || node AS subject FROM t GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'unknown', '' || src FROM e WHERE src NOT IN (SELECT node FROM t) UNION ALL SELECT 'own', '' || src FROM e WHERE src = dst UNION ALL SELECT 'cycle', '' || node FROM b""")
def dag_validation(spark, d):
    return review.validate_dag(_TASKS(spark, d), _DEPS(spark, d))


_PLANS = Derived("customer", plan="c_custkey", expires="CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey END", name="c_name", segment="c_mktsegment", changed="c_custkey % 5 = 0")


@query(f"""WITH p AS (SELECT * FROM {_PLANS.sql}) SELECT 'expired' AS rule, '' || plan AS subject FROM p WHERE expires <= 8 UNION ALL SELECT 'no-expiry', '' || plan FROM p WHERE expires IS NULL UNION ALL SELECT 'hash-mismatch', '' || plan FROM p WHERE changed""")
def plan_checks(spark, d):
    content = lambda segment: F.create_map(F.lit("name"), F.col("name"), F.lit("segment"), segment)
    said = ledger.canonical_hash(content(F.col("segment")))
    plans = _PLANS(spark, d).select("plan", F.col("expires").alias("expires_at"), said.alias("content_hash"), F.map_concat(content(F.when(F.col("changed"), "other").otherwise(F.col("segment"))), F.create_map(F.lit("content_hash"), said)).alias("content"))
    return review.validate_plans(plans, F.lit(8))


# Law sources.

_LAWS = Derived("customer", id="c_custkey", law=in_turn("c_custkey", "'「시설 안전 관리법 ' || c_nationkey || '」'", "'서울시 주차장 조례 ' || c_mktsegment", "'환경 오염 대응 매뉴얼 및 편람'", "c_name || ' 법률'", "'법'"))
_OPEN = Derived("supplier", item="'u' || s_suppkey", name=in_turn("s_suppkey", "'시설안전관리법' || s_nationkey", "'지역 조례 ' || s_nationkey", "'환경 업무 ' || s_suppkey", "'Customer#00000' || (1000 + s_suppkey)", "'법'"), reason=in_turn("s_suppkey", "'internal-rule'", "'local-scope'", "'external-official-document'", "'title-needs-confirmation'", "'none'"))
_COMPACT = "regexp_replace(regexp_replace({0}, '\\([^)]*\\)', '', 'g'), '[「」\\s·ㆍ]', '', 'g')"


@query(f"""WITH l AS (SELECT id, law, {_COMPACT.format('law')} AS k FROM {_LAWS.sql}), u AS (SELECT item, name, reason, {_COMPACT.format('name')} AS u, count(*) OVER (PARTITION BY reason) AS alone FROM {_OPEN.sql})
SELECT DISTINCT id, item FROM l, u WHERE k = u OR (least(length(k), length(u)) >= 6 AND (contains(k, u) OR contains(u, k)))
OR (CASE reason WHEN 'local-scope' THEN law LIKE '%조례%' WHEN 'external-official-document' THEN regexp_matches(law, '편람|매뉴얼') ELSE false END AND (alone = 1 OR (reason = 'local-scope' AND (list_contains(string_split(name, ' '), '조례') AND list_contains(string_split(law, ' '), '조례') OR false)) OR (reason = 'external-official-document' AND contains(name, '환경 ') AND law LIKE '환경 %')))""")
def unresolved_sources(spark, d):
    return review.unresolved_matches(_LAWS(spark, d), _OPEN(spark, d))


_CITED = Derived("part", id="p_partkey", law=in_turn("p_partkey", "'「Law ' || p_brand || '」'", "'alias ' || p_size", "'nothing ' || p_partkey", "'Law ' || p_brand || ' 및 하위법령'"))
_SOURCES = Derived("supplier", url="'u' || s_suppkey", name="CASE WHEN s_suppkey % 2 = 0 THEN 'Law Brand#' || s_nationkey ELSE 'guide ' || s_suppkey END", official="CASE WHEN s_suppkey % 2 = 1 THEN 'Law Brand#' || s_nationkey || ' decree' END")
_ALIASES = Derived("nation", alias="'alias ' || n_nationkey", official="'Law Brand#' || n_nationkey")


@query(f"""WITH s AS (SELECT url, replace(n, ' ', '') AS n FROM (SELECT url, unnest([name, official]) AS n FROM {_SOURCES.sql}) WHERE n IS NOT NULL),
c AS (SELECT id, law, CASE WHEN law LIKE '「%' THEN 'Law' || split_part(split_part(law, ' ', 2), '」', 1) WHEN law LIKE 'alias%' THEN 'LawBrand#' || split_part(law, ' ', 2) WHEN law LIKE 'Law%' THEN 'Law' || split_part(law, ' ', 2) END AS k, law LIKE '%하위법령' AS below FROM {_CITED.sql})
SELECT DISTINCT id, url FROM c JOIN s ON n = k OR (below AND starts_with(n, k)) WHERE law NOT LIKE 'alias%' OR split_part(law, ' ', 2)::INT < 25""")
def law_source_sets(spark, d):
    return registry.find_sources(_CITED(spark, d), _SOURCES(spark, d), _ALIASES(spark, d))


# Flows: a customer's orders are the nodes; the i-th feeds the one at i // 2, and in some flows the first feeds the last.


def _flow_nodes(spark, d):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("node"), at.alias("at"))


def _flow_edges(spark, d):
    n = _flow_nodes(spark, d)
    to = n.select("flow", F.col("node").alias("dst"), F.col("at").alias("half"))
    tree = n.withColumn("half", F.floor(F.col("at") / 2).cast("int")).join(to, ["flow", "half"]).select("flow", F.col("node").alias("src"), "dst", "at")
    ends = n.groupBy("flow").agg(F.min_by("node", "at").alias("src"), F.max_by("node", "at").alias("dst"), F.max("at").alias("at")).filter("flow % 5 = 0 and src <> dst")
    return tree.unionByName(ends.select("flow", "src", "dst", (F.col("at") + 1).alias("at")))


_FLOWS = "n AS (SELECT o_custkey AS flow, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS spot, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)"


@query(f"""WITH {_FLOWS}, h AS (SELECT *, CASE WHEN flow % 5 = 0 AND size > 1 THEN 0 ELSE list_max(list_filter(range(40), lambda k: spot * (1::BIGINT << k) <= size)) END AS height FROM n)
SELECT flow, node, row_number() OVER (PARTITION BY flow ORDER BY height, spot) - 1 AS position FROM h""")
def flow_order(spark, d):
    """The order of all flows' nodes: a tree's by height and place, a cyclic flow's as it is listed."""
    return tables.order_flows(_flow_nodes(spark, d), _flow_edges(spark, d))


@query(f"""WITH RECURSIVE {_FLOWS}, e AS (SELECT a.flow, a.node AS src, b.node AS dst FROM n a JOIN n b ON a.flow = b.flow AND b.spot = a.spot // 2 UNION SELECT flow, min(node), max(node) FROM n WHERE flow % 5 = 0 AND size > 1 GROUP BY flow),
r(flow, output, node) AS (SELECT flow, min(node), min(node) FROM n GROUP BY flow UNION SELECT r.flow, r.output, e.src FROM r JOIN e ON e.flow = r.flow AND e.dst = r.node) SELECT flow, output, node FROM r""")
def flow_upstream(spark, d):
    """What each flow's first node, the root of its tree, depends on."""
    roots = _flow_nodes(spark, d).groupBy("flow").agg(F.min("node").alias("node"))
    return tables.upstream_of(_flow_edges(spark, d), roots)


# Files written from tables and read back.


@query("SELECT 'euc-kr' AS encoding, o_orderkey + 15000000 AS number, o_orderpriority || chr(10) || 'said \"' || o_orderstatus || '\", and more' AS note FROM orders")
def catalog_ranges(spark, d):
    """The orders as a catalog of quoted CSV with line ends inside cells, read by ranges."""
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    note = F.concat("o_orderpriority", F.lit("\n"), F.lit('said "'), "o_orderstatus", F.lit('", and more'))
    rows = table(spark, d, "orders").select((F.col("o_orderkey") + 15_000_000).alias("key"), note.alias("note"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return csv_ranges.catalog_table(spark, path).select("encoding", "number", F.col("row.note").alias("note"))


@query("SELECT event_type AS target, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def committed_split(spark, d):
    """Events in a folder for each of three types, put in place together, and read back."""
    path = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    sinks.write_split(table(spark, d, "events").select("event_id", "event_type"), path, "event_type", ["click", "view", "error"])
    back = spark.read.schema("event_id bigint, event_type string").json([f"{path}/{t}" for t in ("click", "view", "error")])
    return back.groupBy(F.col("event_type").alias("target")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT s_suppkey::VARCHAR AS api_id, s_name AS name, 'n' || s_nationkey AS folder FROM supplier")
def committed_documents(spark, d):
    """A file for each supplier, in a folder for each nation, put in place together, and read back."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("api_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("api_type"), F.col("s_name").alias("name"))
    sinks.write_documents(docs, path)
    back = spark.read.schema("api_id string, name string").option("recursiveFileLookup", True).json(path)
    return back.select("api_id", "name", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1).alias("folder"))
