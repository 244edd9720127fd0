"""Search and profile queries."""

import uuid

from pyspark.sql import functions as F

from brontide.operators import index, profile, search
from brontide.plans import flow
from brontide.registry_of_queries import query, table
from brontide.sources.stored import shared_folder

_BM25 = """
WITH t AS ({docs}), q AS (SELECT unnest([{terms}]) AS q),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM t),
tf AS (SELECT id, q, dl, {tf} AS f FROM t, q),
d AS (SELECT q, sum((f > 0)::INT)::DOUBLE AS df FROM tf GROUP BY q),
r AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN d USING (q), s WHERE f > 0 GROUP BY id)
SELECT id AS {id}, round(s, 4) AS score FROM r ORDER BY s DESC, id LIMIT {k}
"""
_DOCS = "SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts, len(ts) AS dl FROM documents"
_TF = "len(list_filter(ts, lambda x: x = q))::DOUBLE"


def _bm25_sql(terms, k=10):
    return _BM25.format(docs=_DOCS, terms=", ".join(f"'{t}'" for t in terms), tf=_TF, id="doc_id", k=k)


@query(_bm25_sql(["ering", "thst", "anea"]))
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), "ering thst anea", {"text": 1})


_PART = """SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS a, regexp_extract_all(lower(p_brand), '[a-z0-9]+') AS b,
regexp_extract_all(lower(p_type), '[a-z0-9]+') AS c, 3 * len(a) + 2 * len(b) + len(c) AS dl FROM part"""
_PART_TF = "(3 * len(list_filter(a, lambda x: x = q)) + 2 * len(list_filter(b, lambda x: x = q)) + len(list_filter(c, lambda x: x = q)))::DOUBLE"
_WEIGHTS = {"p_name": 3, "p_brand": 2, "p_type": 1}


@query(_BM25.format(docs=_PART, terms="'brand', '17', 'small', 'economy'", tf=_PART_TF, id="p_partkey", k=10))
def bm25_fielded(spark, d):
    return search.bm25(table(spark, d, "part"), "Brand 17 small economy", _WEIGHTS, "p_partkey")


@query("SELECT count(*) AS n_docs, sum(len(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS total_len, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS avg_len FROM documents")
def corpus_stats(spark, d):
    return search.corpus_stats(table(spark, d, "documents"), {"text": 1})


@query("SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents) GROUP BY token")
def token_df(spark, d):
    return search.token_frequencies(table(spark, d, "documents"))


@query("""SELECT p_partkey, token, sum(w)::BIGINT AS tf FROM (
SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token, 3 AS w FROM part UNION ALL
SELECT p_partkey, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')), 2 FROM part UNION ALL
SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')), 1 FROM part) GROUP BY p_partkey, token""")
def weighted_terms(spark, d):
    return search.term_frequencies(table(spark, d, "part"), "p_partkey", _WEIGHTS)


#: The stated query set: every vector whose id is divisible by 100.
_VEC_SQL = """WITH q AS (SELECT vec_id AS intent, embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT intent, vec_id, label, round(list_inner_product(embedding::DOUBLE[], query), 9) AS sim FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY sim DESC, vec_id) AS rank FROM s)"""


def _hits(spark, d, k):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("intent"), F.col("embedding").alias("query"))
    return search.vector_topk(e, q, k, "vec_id")


@query(_VEC_SQL + " SELECT intent, vec_id, round(sim, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 20")
def vector_topk(spark, d):
    return _hits(spark, d, 20).withColumn("similarity", F.round("similarity", 4))


def _stored(spark, kind, d, build):
    """The path of an index over a folder's table; one is built for each session and folder."""
    key = (spark.sparkContext.applicationId, kind, d)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


_BUILT: dict[tuple, str] = {}


def _lexical(spark, d):
    docs = table(spark, d, "documents")
    return index.Lexical(spark, _stored(spark, "lexical", d, lambda path: index.build_lexical(docs, path, "doc_id", {"text": 1})))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return index.Vectors(spark, _stored(spark, "vectors", d, lambda path: index.build_vectors(e, path, "vec_id", "embedding")))


@query(_VEC_SQL + " SELECT intent, vec_id, round(sim, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 20")
def indexed_vectors(spark, d):
    q = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("intent"), F.col("embedding").alias("query"))
    return _vectors(spark, d).topk(q, 20, "vec_id").withColumn("similarity", F.round("similarity", 4))


@query(_bm25_sql(["ering", "thst", "anea"], 20))
def indexed_bm25(spark, d):
    return _lexical(spark, d).bm25({"one": "ering thst anea"}, 20)["one"]


@query(_VEC_SQL + """ SELECT label, round(max(sim), 4) AS score, array_to_string(list_sort(list(DISTINCT intent)), ',') AS intents FROM r WHERE rank <= 120 AND sim >= 0.15 GROUP BY label ORDER BY max(sim) DESC, label LIMIT 5""")
def vector_best_per_label(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    best = search.best_per_service(_hits(spark, d, 120).join(labels, "vec_id"), "label", 5, 0.15)
    return best.select("label", F.round("score", 4).alias("score"), F.array_join(F.transform("matched_intents", lambda i: i.cast("string")), ",").alias("intents"))


def _lists(spark, d):
    docs = table(spark, d, "documents")
    both = search.bm25_all(docs, {"one": "ering thst anea", "two": "thst with enou"}, {"text": 1}, k=20)
    return tuple(search.with_rank(both[x], F.desc("score"), F.col("doc_id")) for x in ("one", "two"))


def _rrf_sql(w1, w2, k):
    a, b = _bm25_sql(["ering", "thst", "anea"], 20), _bm25_sql(["thst", "with", "enou"], 20)
    return f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({a})), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({b})),
u AS (SELECT doc_id, 0 AS n, rank, 'vector' AS c, {w1} / (60 + rank) AS p FROM a UNION ALL SELECT doc_id, 1, rank, 'lexical', {w2} / (60 + rank) FROM b),
g AS (SELECT doc_id, sum(p) AS s, min(n * 1000 + rank) AS f, string_agg(c, '+' ORDER BY n) AS channels FROM u GROUP BY doc_id)
SELECT doc_id::VARCHAR AS doc_id, round(s, 6) AS score, channels FROM g ORDER BY s DESC, f LIMIT {k}"""


def _fused(spark, d, weights, k):
    a, b = _lists(spark, d)
    out = search.fuse_ranks({"vector": a, "lexical": b}, "doc_id", k, weights)
    return out.select("doc_id", "score", F.array_join("match_channels", "+").alias("channels"))


@query(_rrf_sql("1.0::DOUBLE", "1.0::DOUBLE", 15))
def rrf_fuse(spark, d):
    return _fused(spark, d, None, 15)


@query(_rrf_sql("0.9::DOUBLE", "1.1::DOUBLE", 15))
def rrf_weighted(spark, d):
    return _fused(spark, d, {"vector": 0.9, "lexical": 1.1}, 15)


@query(f"SELECT doc_id, score FROM ({_rrf_sql('0.9::DOUBLE', '1.1::DOUBLE', 20)}) WHERE doc_id IN (SELECT doc_id::VARCHAR FROM labels) ORDER BY score DESC, doc_id LIMIT 10")
def hybrid_policy(spark, d):
    a, b = _lists(spark, d)
    return search.hybrid(a, b, "doc_id", 10, table(spark, d, "labels")).select("doc_id", "score")


@query("""SELECT s_suppkey, round(s_acctbal / 100000, 6) + CASE WHEN n_name NOT LIKE 'NATION_1%' THEN 0.004 ELSE 0 END AS raw, round(raw, 6) AS score, CASE WHEN n_name NOT LIKE 'NATION_1%' THEN 'nationwide' END AS coverage_prior
FROM supplier JOIN nation ON s_nationkey = n_nationkey""".replace("AS raw, round(raw, 6) AS score", "AS score").replace("round(s_acctbal / 100000, 6) + CASE", "round(round(s_acctbal / 100000, 6) + CASE").replace("ELSE 0 END AS score", "ELSE 0 END, 6) AS score"))
def coverage_prior(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    ranked = s.select("s_suppkey", "n_name", F.round(F.col("s_acctbal") / 100000, 6).alias("score"))
    return search.coverage_prior(ranked, "n_name", ("NATION_1",)).select("s_suppkey", "score", "coverage_prior")


_G = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"
_TERMS = ("small", "brnd12")


def _tier_sql():
    fields = {"p_name": 5, "p_brand": 3, "p_type": 1}
    c = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9]+', '', 'g')"
    ratio = lambda n, h: f"(len(list_intersect({_G.format(n)}, {_G.format(h)}))::DOUBLE / len({_G.format(n)}))"
    parts = [f"CASE WHEN contains(lower({f}), '{t}') THEN {w} WHEN contains({c(f)}, '{t}') THEN {w} * 0.8 WHEN {ratio(repr(t), c(f))} >= 0.5 THEN {ratio(repr(t), c(f))} * {w} * 0.45 ELSE 0 END" for t in _TERMS for f, w in fields.items()]
    blob = c("p_name || ' ' || p_brand || ' ' || p_type")
    broad = [f"CASE WHEN {ratio(repr(t), blob)} >= 0.25 THEN {ratio(repr(t), blob)} ELSE 0 END" for t in _TERMS]
    return f"""WITH s AS (SELECT p_partkey, p_name, ({' + '.join(parts)})::DOUBLE AS a, ({' + '.join(broad)})::DOUBLE AS b FROM part), t AS (SELECT p_partkey, p_name, CASE WHEN a > 0 THEN 1 ELSE 2 END AS tier, CASE WHEN a > 0 THEN a ELSE b END AS s FROM s)
SELECT p_partkey, tier, round(s, 4) AS score FROM t WHERE s > 0 ORDER BY tier, s DESC, p_name, p_partkey LIMIT 25"""


@query(_tier_sql())
def local_search_tiered(spark, d):
    return search.tiered_search(table(spark, d, "part"), "Small brnd12", {"p_name": 5, "p_brand": 3, "p_type": 1}, "p_partkey", "p_name", 25)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'small') OR contains(lower(p_name), 'small')")
def category_filter(spark, d):
    docs = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"), F.col("p_name").alias("name"))
    return flow.filter_category(docs, " Small ").select("p_partkey")


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_2')")
def provider_filter(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return flow.filter_provider(s.select("s_suppkey", F.col("n_name").alias("provider")), "Nation_2").select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 950 ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 12")
def score_filter(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("apiId"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("searchScore"))
    return flow.top_by_score(docs, 12, 950).select(F.col("apiId").alias("p_partkey"))


# Profiles over tables cast to strings.
_MISSING = "('', 'null', 'none', 'nil', 'na', 'n/a', 'nan', '-')"


def _long_sql(t, id_, columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {id_} AS r, CAST({c} AS VARCHAR) AS v FROM {t}" for c in columns)


_CUST = ["c_name", "c_nationkey", "c_mktsegment"]
_CUST_SQL = _long_sql("customer", "c_custkey", _CUST)
_NUM = ["l_linenumber", "l_suppkey", "l_partkey"]
_NUM_SQL = _long_sql("lineitem", "l_orderkey * 10 + l_linenumber", _NUM)


def _customer(spark, d):
    return profile.cells(table(spark, d, "customer"), _CUST, F.col("c_custkey"))


def _lineitem(spark, d):
    return profile.cells(table(spark, d, "lineitem"), _NUM, F.col("l_orderkey") * 10 + F.col("l_linenumber"))


_PRESENT = f"CASE WHEN v IS NOT NULL AND lower(trim(v)) NOT IN {_MISSING} THEN trim(v) END"


@query(f'SELECT col AS "column", count(*) AS observed_count, count(p) AS non_null_count, count(*) - count(p) AS missing_count, count(DISTINCT p) AS distinct_count FROM (SELECT col, {_PRESENT} AS p FROM ({_CUST_SQL})) GROUP BY col')
def quality_columns(spark, d):
    return profile.column_quality(_customer(spark, d))


@query(f"""SELECT col AS "column", count(*) AS "count", round(min(x), 4) AS minimum, round(max(x), 4) AS maximum, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_pop(x), 4) AS standard_deviation,
round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3 FROM (SELECT col, CAST(v AS DOUBLE) AS x FROM ({_NUM_SQL})) GROUP BY col""")
def quality_numeric(spark, d):
    return profile.numeric_profile(_lineitem(spark, d))


@query(f"""WITH c AS (SELECT col, trim(v) AS v, count(*) AS n, min(r) AS f FROM ({_CUST_SQL}) GROUP BY col, trim(v)), t AS (SELECT *, sum(n) OVER (PARTITION BY col) AS s, row_number() OVER (PARTITION BY col ORDER BY n DESC, f, v) AS k FROM c)
SELECT col AS "column", k::INT AS rank, v AS "value", n AS "count", round(n / s, 4) AS ratio FROM t WHERE k <= 5""")
def quality_topvalues(spark, d):
    return profile.top_values(_customer(spark, d))


@query(f'SELECT col AS "column", min(length(v)) AS min_length, max(length(v)) AS max_length, round(avg(length(v)), 4) AS mean_length, min(v) AS minimum, max(v) AS maximum FROM ({_CUST_SQL}) GROUP BY col')
def quality_lengths(spark, d):
    return profile.text_lengths(_customer(spark, d)).withColumns({"min_length": F.col("min_length").cast("bigint"), "max_length": F.col("max_length").cast("bigint")})


@query("SELECT count(*)::BIGINT AS rows, (count(*) - count(DISTINCT (c_nationkey, c_mktsegment)))::BIGINT AS duplicate_rows, 0::BIGINT AS missing_cells FROM customer")
def quality_dataset(spark, d):
    return profile.dataset_quality(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query(f"""WITH n AS (SELECT 'value' AS col, event_id AS r, value AS x FROM events WHERE value IS NOT NULL), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM n), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q),
o AS (SELECT *, row_number() OVER (ORDER BY least(x - lo, hi - x), r) AS k FROM n, f WHERE x < lo OR x > hi)
SELECT col AS "column", k::INT AS rank, r AS row, round(x, 4) AS numeric_value, round(lo, 4) AS lower_fence, round(hi, 4) AS upper_fence FROM o WHERE k <= 20""")
def iqr_outliers(spark, d):
    return profile.iqr_outliers(profile.cells(table(spark, d, "events"), ["value"], F.col("event_id")))


