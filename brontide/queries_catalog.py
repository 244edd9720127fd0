"""Catalog, relation, ledger and graph queries."""

from functools import reduce

from pyspark.sql import functions as F

from brontide.functions import text, web
from brontide.operators import catalog, graph, ledger, payloads, relate
from brontide.registry_of_queries import query, table, values
from brontide.sources import files

# Relations.


@query("SELECT a.s_suppkey AS source, b.s_suppkey AS target, 'same-agency' AS type, a.s_nationkey AS key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def rel_same_key(spark, d):
    return relate.same_key(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "same-agency")


_OVER = "SELECT a.l_suppkey AS source, b.l_suppkey AS target, count(*) AS {n}, round(least(0.9::DOUBLE, {base}::DOUBLE + 0.2::DOUBLE * count(*)), 2) AS confidence FROM {a} a JOIN {b} b ON a.p = b.p AND a.l_suppkey {op} b.l_suppkey GROUP BY ALL"
_PARTS = "(SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem WHERE {c})"


@query("SELECT * FROM (" + _OVER.format(n="shared", base=0.3, a=_PARTS.format(c="true"), b=_PARTS.format(c="true"), op="<") + ") WHERE shared >= 5")
def rel_param_overlap(spark, d):
    return relate.parameter_overlap(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 5)


@query(_OVER.format(n="links", base=0.4, a=_PARTS.format(c="l_returnflag = 'R'"), b=_PARTS.format(c="l_returnflag = 'A'"), op="<>"))
def rel_io_chain(spark, d):
    rows = table(spark, d, "lineitem")
    return relate.io_chain(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), "l_suppkey", "l_partkey")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type AS c FROM events), g AS (SELECT user_id, max({'t': ts, 'i': event_id, 'c': c}) AS l, max({'t': ts, 'i': event_id, 'c': c}) FILTER (ts <= TIMESTAMP '2024-01-10') AS b FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN b IS NULL THEN 'unverified' WHEN l.t > TIMESTAMP '2024-01-10' AND l.c IS DISTINCT FROM b.c THEN 'stale' ELSE 'fresh' END AS status, l.t AS latest_at FROM g""")
def asof_freshness(spark, d):
    return relate.freshness(table(spark, d, "events"), "user_id", "ts", "event_type", F.expr("timestamp_ntz '2024-01-10'"), "event_id")


_ALL = """WITH s AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS agency, (s_suppkey % 7)::VARCHAR AS domain FROM supplier), q AS (SELECT DISTINCT l_suppkey AS id, 'p' || l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), w AS (SELECT DISTINCT l_suppkey AS id, 'p' || l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'),
o AS (SELECT a.id AS source, b.id AS target, count(*) AS n, string_agg(a.k, ',' ORDER BY a.k) AS evidence FROM q a JOIN q b ON a.k = b.k AND a.id < b.id GROUP BY ALL), c AS (SELECT a.id AS source, b.id AS target, count(*) AS n, string_agg(a.k, ',' ORDER BY a.k) AS evidence FROM w a JOIN q b ON a.k = b.k AND a.id <> b.id GROUP BY ALL)
SELECT a.id AS source, b.id AS target, 'same-agency' AS type, 1.0::DOUBLE AS confidence, a.agency AS evidence FROM s a JOIN s b ON a.agency = b.agency AND a.id < b.id
UNION ALL SELECT a.id, b.id, 'same-domain', 1.0::DOUBLE, a.domain FROM s a JOIN s b ON a.domain = b.domain AND a.id < b.id
UNION ALL SELECT source, target, 'param-overlap', round(least(0.9::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * n), 2), evidence FROM o UNION ALL SELECT source, target, 'io-chain', round(least(0.9::DOUBLE, 0.4::DOUBLE + 0.2::DOUBLE * n), 2), evidence FROM c"""


@query(_ALL)
def rel_all(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("service_id"), F.col("s_nationkey").cast("string").alias("provider_agency_name"), (F.col("s_suppkey") % 7).cast("string").alias("category"))
    named = lambda flag: table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("service_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"))
    return relate.all_relations(s, named("R"), named("A"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query(f"SELECT {_HOST} AS host, count(DISTINCT page_id) AS records, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def host_inventory(spark, d):
    return relate.host_inventory(table(spark, d, "pages"), "page_id", "url")


@query(f"""WITH h AS (SELECT {_HOST} AS host, count(DISTINCT page_id) AS records FROM pages GROUP BY 1), p AS (SELECT regexp_extract(host, '[^.]+$') AS protocol, count(*) AS hosts, sum(records)::BIGINT AS records FROM h GROUP BY 1)
SELECT protocol, hosts, records, round(hosts::DOUBLE / (SELECT sum(hosts) FROM p), 4) AS host_share, round(records::DOUBLE / (SELECT sum(records) FROM p), 4) AS record_share FROM p""")
def weighted_coverage(spark, d):
    h = relate.host_inventory(table(spark, d, "pages"), "page_id", "url").withColumn("protocol", F.regexp_extract("host", "[^.]+$", 0))
    return relate.weighted_coverage(h, "protocol", "records")


@query(f"SELECT host, count(*) AS total, count(*) FILTER (l = 'en') AS en, count(*) FILTER (l = 'de') AS de, round(100.0::DOUBLE * count(*) FILTER (l = 'en') / count(*), 1) AS pct FROM (SELECT {_HOST} AS host, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS l FROM pages) GROUP BY host")
def host_pivot(spark, d):
    p = table(spark, d, "pages").select(web.host(F.col("url")).alias("host"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
    return relate.status_pivot(p, "host", "lang", ["en", "de"])


# Look-ups, unions, drift.


@query("SELECT o_orderkey, c_custkey, coalesce(c_mktsegment, '기타') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def catalog_left_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey", F.coalesce("c_mktsegment", F.lit("기타")).alias("segment"))


@query("SELECT c_custkey, o.o_orderkey AS last_order, o.n AS orders FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey")
def catalog_one_to_one(spark, d):
    """The last row of each key for a 1:1 look-up, counted beside the 1:n form."""
    o = table(spark, d, "orders")
    last = catalog.latest_per_key(o.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey").join(n, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("o_orderkey").alias("last_order"), "orders")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def catalog_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def catalog_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT position, w.c_custkey, c.c_custkey IS NOT NULL AS found FROM (VALUES (1, 7), (2, 999999), (3, 0), (4, 7)) AS w(position, c_custkey) LEFT JOIN customer c USING (c_custkey)")
def ordered_lookup(spark, d):
    return catalog.ordered_lookup(values(spark, "(1, 7), (2, 999999), (3, 0), (4, 7)", "position, c_custkey"), table(spark, d, "customer"), "c_custkey")


@query("SELECT user_id AS id, max(printf('%05d', event_id)) AS path FROM events GROUP BY 1".replace("printf('%05d', event_id)", "user_id || '_' || lpad(event_id::VARCHAR, 9, '0') || '.json'").replace("user_id AS id", "user_id::VARCHAR AS id"))
def newest_per_key(spark, d):
    paths = table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".json")).alias("path"))
    return files.newest_per_id(paths)


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def ordered_distinct(spark, d):
    return catalog.first_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT min(event_id), user_id, 'view' FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY user_id")
def union_precedence(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return catalog.union_by_precedence([e.filter("event_type = 'click'"), e.filter("event_type = 'view'")], ["user_id"], "event_id")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def set_drift(spark, d):
    return catalog.set_drift(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT t AS target, coalesce(n, 0) AS rows FROM (VALUES ('click'), ('view'), ('refund'), ('_unknown')) AS v(t) LEFT JOIN (SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '_unknown' END AS k, count(*) AS n FROM events GROUP BY 1) ON k = t")
def split_by_type(spark, d):
    return catalog.split_by_type(table(spark, d, "events"), F.col("event_type"), ["click", "view", "refund"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND upper(o_orderpriority) LIKE '%LOW%'")
def range_scan(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderkey").between(100, 900)).filter(F.contains(F.upper("o_orderpriority"), F.lit("LOW"))).select("o_orderkey", "o_orderstatus")


@query("SELECT min(o_orderkey) AS first_number, max(o_orderkey) AS last_number FROM orders")
def number_range(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderkey").alias("first_number"), F.max("o_orderkey").alias("last_number"))


@query("SELECT o_custkey AS api_id, min(i)::INT AS ordinal, method, path, arg_min(o_orderstatus, i) AS summary FROM (SELECT o_custkey, o_orderstatus, upper(o_orderpriority) AS method, '/' || o_orderstatus AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY o_custkey, method, path")
def listed_endpoints(spark, d):
    """Each customer's orders as the endpoints a page lists; of the same method and path the first stays."""
    one = F.struct(F.col("o_orderkey").alias("i"), F.lower("o_orderpriority").alias("method"), F.concat(F.lit("/"), "o_orderstatus").alias("path"), F.concat(F.lit("<b>"), "o_orderstatus", F.lit("</b>")).alias("description"))
    docs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("api_id")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["method"].alias("method"), x["path"].alias("path"), x["description"].alias("description"))).alias("endpoints"))
    return catalog.listed_endpoints(docs)


def _specs(spark, d):
    """A specification for each part, made of its columns: two paths, a repeated and an unknown parameter, and a definition."""
    t = table(spark, d, "part")
    parts = ('{"paths": {"/list/', "$p_partkey", '": {"get": {"summary": "', "$p_name", '", "tags": ["', "$p_brand", '"], "parameters": [{"name": "page", "in": "query", "type": "integer", "required": true}, {"name": "page", "in": "query"}, {"name": "', "$p_brand", '", "in": "query"}]}, "trace": {"summary": "no"}}, "/item": {"post": {"description": "', "$p_type", '"}}}, "definitions": {"Item": {"properties": {"id": {"type": "integer"}, "', "$p_brand", '": {"type": "string"}}}}}')
    spec = F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))
    return t.select(F.col("p_partkey").alias("api_id"), spec.alias("spec"))


@query("SELECT p_partkey AS api_id, '/list/' || p_partkey AS path, 'GET' AS method, p_name AS summary, p_brand AS section, 3 AS n_parameters FROM part UNION ALL SELECT p_partkey, '/item', 'POST', p_type, 'Default', 0 FROM part")
def spec_endpoints(spark, d):
    return catalog.spec_endpoints(_specs(spark, d)).drop("parameters")


@query("SELECT p_partkey AS api_id, 'GET /list/' || p_partkey AS endpoint_id, 'page' AS name, 'integer' AS type, true AS required FROM part UNION ALL SELECT p_partkey, 'GET /list/' || p_partkey, p_brand, 'query', false FROM part")
def request_fields(spark, d):
    return catalog.request_fields(_specs(spark, d))


@query("SELECT p_partkey AS api_id, 'Item.id' AS path, 'id' AS name, 'integer' AS type FROM part UNION ALL SELECT p_partkey, 'Item.' || p_brand, p_brand, 'string' FROM part")
def response_fields(spark, d):
    return catalog.response_fields(_specs(spark, d))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text, len(w) AS n_items, len(w) > 12 AS truncated, array_to_string(w[1:12], ' ') AS items FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)")
def compact_projection(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", " ").alias("items"))
    out = catalog.compact_projection(docs, "text", "items", 200, 12)
    return out.withColumns({"items": F.array_join("items", " "), "n_items": F.col("n_items").cast("bigint")})


@query("SELECT event_id, CASE WHEN k IN ('email', 'api_key') THEN '***' ELSE v END AS v, k FROM (SELECT event_id, unnest(['email', 'kind', 'api_key']) AS k, unnest([user_id::VARCHAR, event_type, event_id::VARCHAR]) AS v FROM events)")
def mask_map(spark, d):
    m = F.create_map(F.lit("email"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("api_key"), F.col("event_id").cast("string"))
    masked = catalog.mask_keys(m, payloads.SENSITIVE, payloads.SENSITIVE_ENDS)
    return table(spark, d, "events").select("event_id", F.explode(masked).alias("k", "v"))


@query("""SELECT event_id, '{"deep": [{"email": "***", "id": ' || event_id || '}], "kind": "' || event_type || '", "name": "***", "session_token": "***"}' AS masked FROM events""")
def mask_payloads(spark, d):
    payload = F.to_json(F.struct(F.col("user_id").alias("name"), F.col("event_type").alias("kind"), F.array(F.struct(F.lit("a@b.kr").alias("email"), F.col("event_id").alias("id"))).alias("deep"), F.lit("x").alias("session_token")))
    return table(spark, d, "events").select("event_id", payloads.mask_json(payload).alias("masked"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS kept FROM events")
def allow_list(spark, d):
    m = F.create_map(F.col("event_type"), F.lit("x"), F.lit("other"), F.lit("y"))
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(payloads.allowed_fields(m, ("click", "view"))), ",").alias("kept"))


_UNSAFE = " OR ".join(f"regexp_matches(text, '{p}')" for p in payloads.UNSAFE)


@query(f"SELECT doc_id, {_UNSAFE} AS unsafe FROM documents")
def unsafe_values(spark, d):
    return table(spark, d, "documents").select("doc_id", payloads.unsafe(F.col("text")).alias("unsafe"))


@query(f"SELECT doc_id, {_UNSAFE} AS unsafe FROM documents")
def unsafe_payloads(spark, d):
    """The same texts, two levels down in JSON."""
    deep = F.to_json(F.struct(F.struct(F.array("lang", "text").alias("items")).alias("body"), F.col("n_chars")))
    return table(spark, d, "documents").select("doc_id", payloads.unsafe_json(deep).alias("unsafe"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%LOW%' THEN 'link' WHEN o_totalprice > 300000 THEN 'swagger' ELSE 'legacy' END AS subtype, CASE WHEN o_orderpriority LIKE '%LOW%' THEN 'catalog kind' WHEN o_totalprice > 300000 THEN 'specification' ELSE 'neither' END AS evidence FROM orders")
def api_subtype(spark, d):
    kind = F.when(F.contains("o_orderpriority", F.lit("LOW")), "api (link)").otherwise("api")
    return table(spark, d, "orders").select("o_orderkey", F.inline(F.array(payloads.api_subtype(kind, F.col("o_totalprice") > 300000))))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#17' AND contains(lower(p_name || ' ' || p_type), 'small') AND contains(lower(p_name || ' ' || p_type), 'red')")
def facet_filter(spark, d):
    return catalog.facet_filter(table(spark, d, "part"), {"p_brand": "Brand#17"}, "Small red", ["p_name", "p_type"]).select("p_partkey")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1997-05%' ORDER BY day DESC, o_orderkey")
def gazette_filter(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return o.filter((F.col("o_orderstatus") == "F") & F.date_format("day", "yyyy-MM-dd").startswith("1997-05")).select("o_orderkey", "day").orderBy(F.desc("day"), "o_orderkey")


# Ledgers: a user is a run, an event type a status.


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS sequence FROM events")
def event_sequence(spark, d):
    return ledger.sequence(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "sequence")


_ALLOWED = {"signup": ("view", "click"), "view": ("click", "view"), "click": ("purchase", "view", "click"), "purchase": ("view",), "error": ()}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, bs in _ALLOWED.items() for b in bs)


@query(f"SELECT event_id, user_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NOT NULL AND (previous, event_type) NOT IN ({_PAIRS})")
def illegal_transitions(spark, d):
    return ledger.illegal_transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", allowed=_ALLOWED).select("event_id", "user_id", "previous", "event_type")


_STEP = "CASE event_type WHEN 'error' THEN CASE WHEN value > 100 THEN 'failed' ELSE 'blocked' END WHEN 'signup' THEN CASE WHEN value > 200 THEN 'outcome_unknown' ELSE 'succeeded' END ELSE 'succeeded' END"


@query(f"SELECT user_id, CASE WHEN bool_or(s = 'outcome_unknown') THEN 'outcome_unknown' WHEN bool_or(s IN ('failed', 'blocked')) THEN CASE WHEN bool_or(s = 'succeeded') THEN 'partially_succeeded' ELSE 'failed' END WHEN bool_and(s = 'succeeded') THEN 'succeeded' ELSE 'failed' END AS final_status FROM (SELECT user_id, {_STEP} AS s FROM events) GROUP BY user_id")
def run_final_status(spark, d):
    e = table(spark, d, "events").select("user_id", F.expr(_STEP).alias("s"))
    return ledger.final_status(e, "user_id", "s")


@query("SELECT user_id, count(*) AS requests, min(event_id) AS first_request, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id")
def idempotency_conflicts(spark, d):
    return ledger.idempotency(table(spark, d, "events"), "user_id", "event_type", "event_id")


_LEASE = "CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'view' THEN 'queued' ELSE 'done' END"


def _leases(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_LEASE).alias("status"), "ts", (F.col("ts") + F.expr("interval 1 day")).alias("lease_until"))


@query(f"SELECT event_id FROM events WHERE {_LEASE} = 'running' AND ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-05'")
def expired_leases(spark, d):
    return ledger.expired_leases(_leases(spark, d), "lease_until", F.expr("timestamp_ntz '2024-01-05'")).select("event_id")


@query(f"SELECT event_id FROM (SELECT event_id, ts, {_LEASE} AS s, ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-05' AS x FROM events) WHERE s = 'queued' OR (s = 'running' AND x) ORDER BY CASE WHEN s = 'running' AND x THEN 0 ELSE 1 END, ts, event_id LIMIT 5")
def next_work(spark, d):
    return ledger.next_work(_leases(spark, d), "ts", "lease_until", F.expr("timestamp_ntz '2024-01-05'"), 5, "event_id").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 4")
def tail_buffer(spark, d):
    return ledger.tail(table(spark, d, "events"), "user_id", 4, "ts", "event_id").select("event_id")


@query("SELECT event_id, s::INT AS sequence FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) WHERE s > 40")
def replay_after(spark, d):
    return ledger.replay(table(spark, d, "events"), "user_id", 40, "ts", "event_id").select("event_id", "sequence")


@query("""WITH a AS (SELECT o_custkey AS run, max({'t': o_orderkey, 'h': o_orderstatus, 'e': o_totalprice > 100000, 'c': o_orderpriority LIKE '1%'}) AS x FROM orders GROUP BY 1)
SELECT c_custkey AS run_id, CASE WHEN x IS NULL THEN 'missing' WHEN x.c THEN 'consumed' WHEN x.h <> 'F' THEN 'hash_mismatch' WHEN NOT x.e THEN 'expired' ELSE 'valid' END AS state FROM customer LEFT JOIN a ON run = c_custkey""")
def approval_checks(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("F").alias("hash"))
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("approved_at"), F.col("o_orderstatus").alias("plan_hash"), F.when(F.col("o_totalprice") > 100000, 9).otherwise(3).alias("expires_at"), F.col("o_orderpriority").startswith("1").alias("consumed"))
    return ledger.approval_state(runs, a, F.lit(5))


@query("SELECT user_id, event_type AS kind, CASE WHEN max(event_id) % 4 = 0 THEN 'outcome_unknown' ELSE 'done' END AS last FROM events GROUP BY 1, 2")
def step_fold(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), "event_id", F.expr("CASE WHEN event_id % 4 = 0 THEN 'started' ELSE 'done' END").alias("status"))
    return ledger.last_per_step(e, ["user_id", "kind"], "status", "event_id")


@query("SELECT event_id FROM events WHERE user_id = 7")
def owner_filter(spark, d):
    return table(spark, d, "events").filter(F.col("user_id") == 7).select("event_id")


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, printf('%.1f%%', 100.0 * count(*) FILTER (event_type <> 'error') / count(*)) AS rate, round(avg(value), 4) AS avg_time FROM events")
def crawl_summary(spark, d):
    return ledger.crawl_summary(table(spark, d, "events"), F.col("event_type") != "error", "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return ledger.outcome_counts(table(spark, d, "events"), "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def top_orgs(spark, d):
    return ledger.outcome_counts(table(spark, d, "events"), "user_id").orderBy(F.desc("n"), "user_id").limit(5)


@query("SELECT conv_id, count(*) AS turns, md5(string_agg(text, '' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def conversation_concat(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), "").alias("t"))
    return c.select("conv_id", "turns", F.md5(F.col("t").cast("binary")).alias("digest"))


# Graphs over whole tables: parts (4p + 1), suppliers (4s + 2) and orders (4o), linked by all rows of lineitem.

_PART, _SUPP = "4 * l_partkey + 1", "4 * l_suppkey + 2"
#: A part points to its supplier, or, where the row was accepted, the supplier to the part.
_EDGES = f"SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN {_SUPP} ELSE {_PART} END AS src, CASE WHEN l_returnflag = 'A' THEN {_PART} ELSE {_SUPP} END AS dst FROM lineitem"
#: Orders point to their parts and parts to their suppliers, so nothing points back.
_DAG = f"SELECT DISTINCT 4 * l_orderkey AS src, {_PART} AS dst FROM lineitem UNION SELECT DISTINCT {_PART}, {_SUPP} FROM lineitem"
_NODES = "SELECT 4 * p_partkey + 1 AS node FROM part UNION ALL SELECT 4 * s_suppkey + 2 FROM supplier"


def _edges(spark, d):
    return _links(spark, d).distinct()


def _links(spark, d):
    """The rows that edges come from, some more than once."""
    part, supp, back = F.expr(_PART), F.expr(_SUPP), F.col("l_returnflag") == "A"
    return table(spark, d, "lineitem").select(F.when(back, supp).otherwise(part).alias("src"), F.when(back, part).otherwise(supp).alias("dst"))


def _dag(spark, d):
    return _dag_links(spark, d).distinct()


def _dag_links(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(F.expr("4 * l_orderkey").alias("src"), F.expr(_PART).alias("dst")).unionByName(rows.select(F.expr(_PART).alias("src"), F.expr(_SUPP).alias("dst")))


def _nodes(spark, d):
    return table(spark, d, "part").select(F.expr("4 * p_partkey + 1").alias("node")).unionByName(table(spark, d, "supplier").select(F.expr("4 * s_suppkey + 2").alias("node")))


def _steps(spark, d):
    return _nodes(spark, d).unionByName(table(spark, d, "orders").select(F.expr("4 * o_orderkey").alias("node")))


#: The states that each user passes through: an edge from each event's type to the next one's.
_KIND = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
_STATES = f"SELECT DISTINCT src, dst FROM (SELECT 8 * user_id + {_KIND} AS src, lead(8 * user_id + {_KIND}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"


def _states(spark, d):
    e = table(spark, d, "events").select(F.expr(f"8 * user_id + {_KIND}").alias("node"), "user_id", "ts", "event_id")
    return graph.sequence_edges(e, "user_id", "ts", "event_id").distinct()


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT 5::BIGINT UNION SELECT dst FROM r JOIN e ON node = src) SELECT node FROM r")
def graph_reach(spark, d):
    return graph.reachable(_links(spark, d), _nodes(spark, d).filter("node = 5"))


@query(f"WITH RECURSIVE e AS ({_STATES}), r(seed, node) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT seed, dst FROM r JOIN e ON node = src) SELECT a.seed AS node, min(a.node) AS component, count(*) AS size FROM r a JOIN r b ON a.seed = b.node AND a.node = b.seed GROUP BY 1")
def graph_scc(spark, d):
    return graph.strong_components(_states(spark, d))


@query()
def graph_scc_parts(spark, d):
    """Strong components of the whole graph of parts and suppliers; its closure is too large for SQL."""
    return graph.strong_components(_links(spark, d))


@query(f"""WITH RECURSIVE e AS ({_STATES}), r(seed, node) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT seed, dst FROM r JOIN e ON node = src),
c AS (SELECT a.seed AS node, min(a.node) AS component, count(*) AS size FROM r a JOIN r b ON a.seed = b.node AND a.node = b.seed GROUP BY 1),
i AS (SELECT src, dst, x.component, x.size FROM e JOIN c x ON src = x.node JOIN c y ON dst = y.node WHERE x.component = y.component),
p(component, size, node, path) AS (SELECT component, size, dst, [src] FROM i WHERE src = component UNION ALL SELECT p.component, p.size, i.dst, list_append(path, p.node) FROM p JOIN i ON i.src = p.node WHERE p.node <> p.component AND NOT list_contains(path, p.node)),
f AS (SELECT component, size, path, row_number() OVER (PARTITION BY component ORDER BY len(path), path) AS k FROM p WHERE node = component)
SELECT component, size, array_to_string(path, '>') AS path FROM f WHERE k = 1""")
def graph_cycles(spark, d):
    return graph.cycles(_states(spark, d)).withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@query(f"WITH e AS ({_EDGES}) SELECT node FROM ({_NODES}) WHERE node NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def graph_orphans(spark, d):
    return graph.orphans(_nodes(spark, d), _edges(spark, d))


@query(f"WITH e AS ({_EDGES}), n AS (SELECT 4 * s_suppkey + 2 AS node FROM supplier UNION ALL SELECT 4 * p_partkey + 1 FROM part WHERE p_size < 25) SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM n) OR dst NOT IN (SELECT node FROM n)")
def graph_dangling(spark, d):
    return graph.dangling(_small_parts(spark, d), _edges(spark, d))


@query(f"WITH e AS ({_EDGES}), n AS (SELECT 4 * s_suppkey + 2 AS node FROM supplier UNION ALL SELECT 4 * p_partkey + 1 FROM part WHERE p_size < 25) SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def relation_edges_within(spark, d):
    return graph.within(_small_parts(spark, d), _edges(spark, d))


def _small_parts(spark, d):
    """The selection that edges are held against: all suppliers, and parts of a size below 25."""
    small = table(spark, d, "part").filter("p_size < 25").select(F.expr("4 * p_partkey + 1").alias("node"))
    return table(spark, d, "supplier").select(F.expr("4 * s_suppkey + 2").alias("node")).unionByName(small)


@query("WITH e AS (SELECT 4 * c_custkey AS src, 4 * c_nationkey + 3 AS dst FROM customer UNION ALL SELECT 4 * s_suppkey + 2, 4 * s_nationkey + 3 FROM supplier), n AS (SELECT src AS node, dst AS home FROM e UNION SELECT dst, dst FROM e), l AS (SELECT home, min(node) AS component FROM n GROUP BY home) SELECT node, component FROM n JOIN l USING (home)")
def graph_connected(spark, d):
    c = table(spark, d, "customer").select(F.expr("4 * c_custkey").alias("src"), F.expr("4 * c_nationkey + 3").cast("bigint").alias("dst"))
    s = table(spark, d, "supplier").select(F.expr("4 * s_suppkey + 2").alias("src"), F.expr("4 * s_nationkey + 3").cast("bigint").alias("dst"))
    return graph.connected(c.unionByName(s))


@query(f"WITH RECURSIVE e AS ({_DAG}), l(node, level) AS (SELECT node, 0 FROM ({_NODES} UNION ALL SELECT 4 * o_orderkey FROM orders) UNION SELECT dst, level + 1 FROM l JOIN e ON node = src) SELECT node, max(level)::INT AS level FROM l GROUP BY node")
def dag_levels(spark, d):
    return graph.dag_levels(_steps(spark, d), _dag_links(spark, d))


@query()
def grounded_labels(spark, d):
    return graph.grounded(_nodes(spark, d), _links(spark, d))


@query(f"WITH e AS ({_DAG}) SELECT dst AS node, array_to_string(list_sort(list(DISTINCT src)), ',') AS blockers FROM e WHERE src % 16 <> 0 GROUP BY dst")
def blocked_steps(spark, d):
    steps = _steps(spark, d).withColumn("status", F.when(F.col("node") % 16 == 0, "succeeded").otherwise("failed"))
    return graph.blocked_steps(steps, _dag(spark, d)).withColumn("blockers", F.array_join(F.transform("blockers", lambda b: b.cast("string")), ","))


@query(f"""WITH e AS ({_DAG}), o AS (SELECT 4 * o_orderkey AS node, o_orderstatus <> 'P' AS good FROM orders), n AS ({_NODES}),
p AS (SELECT n.node, count(src) FILTER (NOT coalesce(good, false)) AS bad, count(src) AS deps FROM n LEFT JOIN e ON dst = n.node AND src % 4 = 0 LEFT JOIN o ON src = o.node GROUP BY 1)
SELECT node, 0 AS level, CASE WHEN good THEN 'succeeded' ELSE 'failed' END AS state FROM o UNION ALL SELECT node, CASE WHEN deps > 0 THEN 1 ELSE 0 END, CASE WHEN bad > 0 THEN 'blocked' ELSE 'succeeded' END FROM p WHERE node % 4 = 1
UNION ALL SELECT node, CASE WHEN m > 0 THEN 2 WHEN k > 0 THEN 1 ELSE 0 END, CASE WHEN b > 0 THEN 'blocked' ELSE 'succeeded' END FROM (SELECT n.node, count(src) AS k, count(*) FILTER (deps > 0) AS m, count(*) FILTER (bad > 0) AS b FROM n LEFT JOIN e ON dst = n.node LEFT JOIN p ON src = p.node WHERE n.node % 4 = 2 GROUP BY 1)""")
def run_order(spark, d):
    """Orders that are not pending have succeeded; parts and suppliers would, if nothing blocks them."""
    good = table(spark, d, "orders").select(F.expr("4 * o_orderkey").alias("node"), F.when(F.col("o_orderstatus") != "P", "succeeded").otherwise("failed").alias("status"))
    return graph.run_order(good.unionByName(_nodes(spark, d).withColumn("status", F.lit("succeeded"))), _dag_links(spark, d))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'click') THEN 'success' WHEN bool_or(event_type = 'view') THEN 'timeout' ELSE 'error' END AS status, count(*) AS attempts, NOT bool_or(event_type = 'click') AND count(*) < 40 AS retry FROM events GROUP BY user_id")
def scan_retries(spark, d):
    from brontide.operators import harvest

    said = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "timeout").otherwise(F.col("event_type"))
    return harvest.settled(table(spark, d, "events").select("user_id", "event_id", said.alias("status")), "user_id", "event_id", "status", 40)


@query("SELECT conv_id, n AS n_files FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ORDER BY conv_id DESC LIMIT 10")
def recent_manifests(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("files"))
    return ledger.recent_manifests(m, "conv_id", "files").select("conv_id", F.col("n_files").cast("bigint").alias("n_files"))


@query("SELECT event_id AS src, nxt AS dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def sequence_edges(spark, d):
    return graph.sequence_edges(table(spark, d, "events").select(F.col("event_id").alias("node"), "user_id", "ts", "event_id"), "user_id", "ts", "event_id")
