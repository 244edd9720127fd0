"""Chunk, harvest and review queries."""

from pyspark.sql import functions as F

from brontide.operators import chunks, harvest, profile, registry, review
from brontide.plans import flow
from brontide.registry_of_queries import query, table


@query()
def document_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    head = chunks.identity_header(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("source"), F.col("lang"), F.lit(""))
    return chunks.search_chunks(docs, "doc_id", head, F.col("text"), F.array(F.lit("- GET /a : x")), F.array().cast("array<string>"))


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(source || ' ' || lang || ' ' || text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS blob FROM documents")
def search_blob(spark, d):
    return table(spark, d, "documents").select("doc_id", chunks.search_blob(F.col("source"), F.col("lang"), F.col("text")).alias("blob"))


@query("SELECT event_id, event_type <> 'error' AND user_id % 3 <> 0 AND event_id % 2 = 0 AS allowed FROM events")
def connections(spark, d):
    e = table(spark, d, "events")
    source, target, kind = F.when(F.col("event_type") == "error", "interpretation").otherwise("claim"), F.when(F.col("user_id") % 3 != 0, F.lit("claim")), F.when(F.col("event_id") % 2 == 0, "support").otherwise("other")
    return e.select("event_id", F.coalesce(review.connection_allowed(source, target, kind), F.lit(False)).alias("allowed"))


_ACTION = "CASE event_type WHEN 'signup' THEN '작성' WHEN 'view' THEN '제출' WHEN 'click' THEN '검토' WHEN 'error' THEN '보완' ELSE '반려' END"


@query(f"WITH a AS (SELECT event_id, user_id, {_ACTION} AS a FROM events), p AS (SELECT event_id AS src, a, max(CASE WHEN a IN ('제출', '검토', '협의') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dst FROM a) SELECT src, dst FROM p WHERE a IN ('보완', '반려') AND dst IS NOT NULL")
def loop_edges(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("node"), F.col("user_id").alias("process"), F.expr(_ACTION).alias("action"))
    return review.loop_edges(t, "node", "action")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '2024 · ' || o_orderpriority WHEN 'O' THEN '2024 ' || o_orderpriority END AS text FROM orders")
def warning_texts(spark, d):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    key = F.when(s == "F", "message").when(s == "O", "detail").otherwise("other")
    said = F.when(s == "F", F.concat(F.lit(" "), p, F.lit(" "))).otherwise(F.concat(F.lit("2024 "), p))
    return table(spark, d, "orders").select("o_orderkey", review.warning_text(F.create_map(key, said, F.lit("date"), F.lit("2024"))).alias("text"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS article_verified, count(*) FILTER (o_orderstatus = 'O') AS source_linked, 0::BIGINT AS scope_limited, count(*) FILTER (o_orderstatus = 'P') AS needs_review, count(*) FILTER (o_totalprice < 60000) AS field_check FROM orders")
def verification_summary(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "article-verified").when(F.col("o_orderstatus") == "O", "source-linked").otherwise("needs-review")
    return review.verification_summary(table(spark, d, "orders").select(state.alias("s"), (F.col("o_totalprice") / 100000).alias("c")), "s", "c")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC LIMIT 7")
def collated_sort(spark, d):
    return table(spark, d, "nation").orderBy(F.collate("n_name", "ko").desc(), "n_nationkey").limit(7).select("n_nationkey", "n_name")


@query("""WITH f AS (SELECT user_id AS run, event_type AS rule, event_id::VARCHAR AS subject FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id AS run FROM events), e AS (SELECT run, unnest(['error', 'missing']) AS rule FROM r)
SELECT run, rule, 'violation' AS severity, subject FROM f UNION ALL SELECT run, rule, 'info', '-' FROM e WHERE (run, rule) NOT IN (SELECT run, rule FROM f)""")
def critic_severities(spark, d):
    e = table(spark, d, "events")
    found = e.filter("event_type = 'error'").select(F.col("user_id").alias("run"), F.col("event_type").alias("rule"), F.col("event_id").cast("string").alias("subject"))
    return review.with_severity(found, e.select(F.col("user_id").alias("run")).distinct(), rules=("error", "missing"))


@query("SELECT DISTINCT o_custkey AS run, 'relations-verified' AS rule, 'ships:' || l_partkey || ':' || l_suppkey AS subject FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2) AND (o_custkey, l_partkey, l_suppkey) NOT IN (SELECT o_custkey, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R')")
def critic_relations(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rel = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("run"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("ships").alias("type"), "l_returnflag")
    selected = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"))
    key = ["run", "source", "target", "type"]
    return review.verified_relations(selected, rel.filter("l_returnflag = 'R'").select(*key).distinct(), rel.filter("l_returnflag <> 'R'").select(*key))


_NATION_REL = "SELECT 'n' || s_suppkey AS id, s_nationkey AS source, (s_suppkey % 25) AS target, 'trades' AS type FROM supplier"


@query(f"SELECT 'rel-' || id AS id, 'node' || source AS source, 'node' || target AS target, type AS label, CASE WHEN source > 12 THEN 'approved' ELSE 'derived' END AS status, source <= 12 AS animated, CASE WHEN source > 12 THEN '#475569' ELSE '#f59e0b' END AS stroke FROM ({_NATION_REL}) WHERE target <> 3 AND source <> 3")
def canvas_edges(spark, d):
    nodes = table(spark, d, "nation").filter("n_nationkey <> 3").select(F.concat(F.lit("node"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_nationkey").cast("bigint").alias("service"))
    rel = table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").cast("bigint").alias("source"), (F.col("s_suppkey") % 25).alias("target"), F.lit("trades").alias("type"))
    return flow.canvas_edges(nodes, rel, rel.filter("source > 12").select(F.concat(F.lit("rel-"), F.col("id")).alias("id")))


@query("SELECT o_custkey AS run, 'q' || o_custkey AS name, n AS nodes, last AS last_x, (n * (n - 1)) // 2 AS edges, CASE WHEN n > 1 THEN n - 1 END AS notes FROM (SELECT o_custkey, count(*) AS n, 80 + ((count(*) - 1) % 3) * 320 AS last FROM orders GROUP BY 1)")
def flow_exports(spark, d):
    """Each customer's orders as a flow: a node each, an edge between each two, read back from the JSON."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("at"), F.concat(F.lit("src:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("t").alias("title"))
    pairs = o.alias("a").join(o.alias("b"), (F.col("a.run") == F.col("b.run")) & (F.col("a.at") < F.col("b.at")))
    rel = pairs.select(F.col("a.run").alias("run"), F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.lit("same").alias("type"), F.lit("note").alias("note"))
    runs = o.select("run").distinct().select("run", F.concat(F.lit("q"), F.col("run").cast("string")).alias("query"), F.array().cast("array<string>").alias("warnings"))
    f = flow.flow_json(o, rel, runs, "flow", "2024-01-01T00:00:00Z")
    shape = "name string, nodes array<struct<id:string,position:struct<x:bigint,y:bigint>,data:struct<apiId:string,relationNotes:array<string>>>>, edges array<struct<id:string>>"
    j = f.select("run", F.from_json("flow", shape).alias("f")).select("run", "f.*")
    notes = F.size(F.get("nodes", 0)["data"]["relationNotes"])
    return j.select("run", "name", F.size("nodes").cast("bigint").alias("nodes"), F.element_at("nodes", -1)["position"]["x"].alias("last_x"), F.size("edges").cast("bigint").alias("edges"), F.when(notes > 0, notes.cast("bigint")).alias("notes"))


@query("""SELECT unnest(['p_size', 'p_type']) AS "column", unnest(['integer', 'string']) AS inferred_type, count(*)::VARCHAR AS observed, unnest([count(DISTINCT p_size), count(DISTINCT p_type)])::VARCHAR AS distinct_count, unnest([min(p_size)::DOUBLE::VARCHAR, NULL]) AS minimum FROM part""")
def quality_reports(spark, d):
    r = profile.quality_report(profile.cells(table(spark, d, "part"), ["p_size", "p_type"], F.col("p_partkey")))
    get = lambda p: F.get_json_object("report", p)
    return r.select("column", get("$.inferred_type").alias("inferred_type"), get("$.observed_count").alias("observed"), get("$.distinct_count").alias("distinct_count"), get("$.numbers[0].minimum").alias("minimum"))


@query("""SELECT unnest(['p_brand', 'p_type']) AS "column", true AS whole""")
def quality_html(spark, d):
    r = profile.report_html(profile.quality_report(profile.cells(table(spark, d, "part"), ["p_brand", "p_type"], F.col("p_partkey"))))
    return r.select("column", (F.startswith("html", F.concat(F.lit("<tr><td>"), F.col("column"), F.lit("</td><td>string</td><td>0.00%</td><td>100.00%</td>"))) & F.endswith("html", F.lit("</td></tr>"))).alias("whole"))
