"""Lexical, vector and hybrid search over a catalog."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brontide.functions.text import compact, let, tokenize
from brontide.sources.stored import written

#: Ranking parameters.
K1, B = 1.2, 0.75
RRF_K = 60
MIN_SIMILARITY = 0.42
COVERAGE_BONUS = 0.004
OVERSAMPLE, CANDIDATES, MOST = 12, 4, 20


def token_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, df): how many documents have each token; a document sends each of its tokens once."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def term_frequencies(docs: DataFrame, id: str, weights: dict[str, int]) -> DataFrame:
    """(id, token, tf): weighted occurrences over the fields."""
    weighed = lambda w: lambda t: F.struct(t.alias("token"), F.lit(w).alias("w"))
    parts = [F.transform(tokenize(F.col(f)), weighed(w)) for f, w in weights.items()]
    return docs.select(id, F.inline(F.concat(*parts))).groupBy(id, "token").agg(F.sum("w").alias("tf"))


def corpus_stats(docs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(n_docs, total_len, avg_len) of the weighted token counts."""
    size = reduce(lambda a, b: a + b, (F.size(tokenize(F.col(f))) * w for f, w in weights.items()))
    return docs.select(size.alias("dl")).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_len"), F.avg("dl").alias("avg_len"))


def bm25(docs: DataFrame, query: str, weights: dict[str, int], id: str = "doc_id", k: int = 10) -> DataFrame:
    """The k best documents by BM25 with field weights; ties by id; rows (id, score)."""
    return bm25_all(docs, {"query": query}, weights, id, k)["query"]


def bm25_all(docs: DataFrame, queries: dict[str, str], weights: dict[str, int], id: str = "doc_id", k: int = 10) -> dict[str, DataFrame]:
    """bm25 of several queries, by name, in one pass over the documents.

    The pass tokenises each field once and keeps, of documents that have any
    query token, the length and the count of each; these narrow rows are written
    and all queries are scored from them.  How many documents there are, their
    mean length and how many have each token are observed on the way, so the
    texts are neither read again nor shuffled.
    """
    asked = {name: query_tokens(docs.sparkSession, q) for name, q in queries.items()}
    terms = list(dict.fromkeys(t for ts in asked.values() for t in ts))
    if not terms:
        none = docs.select(id, F.lit(0.0).alias("score")).limit(0)
        return {name: none for name in queries}

    def counted(field: str, w: int) -> Column:
        is_ = lambda q: lambda x: x == q
        one = lambda t: F.struct((F.size(t) * w).alias("dl"), *((F.size(F.filter(t, is_(q))) * w).alias(f"tf{i}") for i, q in enumerate(terms)))
        return let(tokenize(F.col(field)), one)

    def added(fields: Column) -> Column:
        total = lambda c: reduce(lambda a, b: a + b, (F.get(fields, n)[c] for n in range(len(weights))))
        return F.struct(*(total(c).alias(c) for c in ("dl", *(f"tf{i}" for i in range(len(terms))))))

    fields = F.array(*(counted(f, w) for f, w in weights.items()))
    rows = docs.select(id, F.inline(F.array(let(fields, added))))
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = written(rows.filter(reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(terms))))))
    s = seen.get
    norm = F.lit(K1) * (1 - F.lit(B) + F.lit(B) * F.col("dl") / F.lit(float(s["avgdl"]) or 1.0))

    def part(term: str) -> Column:
        i = terms.index(term)
        idf = F.log(F.lit(1 + (s["n"] - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5)))
        return idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)

    def best(ts: list[str]) -> DataFrame:
        score = reduce(lambda a, b: a + b, map(part, ts), F.lit(0.0))
        return hits.select(id, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), id).limit(max(1, k)).select(id, F.round("score", 4).alias("score"))

    return {name: best(ts) for name, ts in asked.items()}


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """The distinct tokens of a query, in order: the text is the caller's, so this is one literal row."""
    return list(dict.fromkeys(spark.range(1).select(tokenize(F.lit(query))).first()[0]))


#: Queries of one block: a bound on what is held and broadcast at a time.
QUERY_BLOCK = 4096
#: Products that a task holds at a time: of a batch of vectors with so many queries of a block.
MOST_PRODUCTS = 1 << 21


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, id: str, embedding: str = "embedding", intent: str = "intent", block: int = QUERY_BLOCK) -> DataFrame:
    """The k chunks of largest inner product for each intent: (intent, id, similarity, rank).

    queries: (intent, query), in double precision; products are rounded to nine
    digits, so that copies tie, and ties go by id.  Vectors that are null, or have
    null components or another length than the query, are no chunks of it.

    Queries are dealt by hash into blocks of about `block`, and each block meets
    all chunks: a batch of chunks times a block is one matrix product.  Of a
    batch only an intent's k best chunks, and those that tie, leave the task.
    """
    spark = chunks.sparkSession
    asked = queries.select(F.col(intent).alias("intent"), F.col("query").cast("array<double>").alias("query")).filter(F.col("query").isNotNull() & ~F.exists("query", lambda x: x.isNull()))
    blocks = max(1, -(-asked.count() // block))
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("id", chunks.schema[id].dataType), T.StructField("similarity", T.DoubleType())])
    rows = chunks.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    parts = []
    for n in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("intent"), F.lit(blocks)) == n).collect()  # about `block` rows
        if held:
            sent = spark.sparkContext.broadcast([(i, r["query"]) for i, r in enumerate(held)])
            names = spark.createDataFrame([(i, r["intent"]) for i, r in enumerate(held)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField(intent, queries.schema[intent].dataType)]))
            parts.append(rows.mapInArrow(_products(sent, k), schema).join(F.broadcast(names), "i"))
    if not parts:
        return chunks.select(F.lit(None).cast(queries.schema[intent].dataType).alias(intent), id, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    order = Window.partitionBy(intent).orderBy(F.desc("similarity"), F.col(id))
    return reduce(DataFrame.unionByName, parts).select(intent, F.col("id").alias(id), "similarity").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _products(sent, k: int):
    """The k best rows of each batch for each query, with ties: rows (i, id, similarity)."""

    def run(batches):
        by_size: dict[int, list[tuple[int, list[float]]]] = {}
        for i, q in sent.value:
            by_size.setdefault(len(q), []).append((i, q))
        asked = {d: (np.array([i for i, _ in qs], np.int32), np.array([q for _, q in qs], np.float64).T) for d, qs in by_size.items()}
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
            for d, (numbers, q) in asked.items():
                at = np.flatnonzero(lengths == d)
                if not len(at):
                    continue
                x, step = flat[starts[at][:, None] + np.arange(d)], max(1, MOST_PRODUCTS // len(at))
                for low in range(0, len(numbers), step):
                    sims = np.round(x @ q[:, low : low + step], 9)
                    least = np.partition(sims, len(at) - k, axis=0)[len(at) - k] if len(at) > k else np.full(sims.shape[1], -np.inf)
                    row, col = np.nonzero(sims >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[low + col]), ids.take(pa.array(at[row])), pa.array(sims[row, col])], ["i", "id", "similarity"])

    return run


def best_per_service(hits: DataFrame, service: str, k: int, least: float = MIN_SIMILARITY, intent: str = "intent") -> DataFrame:
    """Each service's best hit among those of at least `least`, and the intents it answers; the k best."""
    good = hits.filter((F.col("similarity") >= least) & F.col(service).isNotNull())
    best = good.groupBy(service).agg(F.max("similarity").alias("score"), F.sort_array(F.collect_set(intent)).alias("matched_intents"))
    return best.orderBy(F.desc("score"), service).limit(max(1, k))


def fuse_ranks(lists: dict[str, DataFrame], id: str, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (id, rank): (id, score, match_channels).

    A record without an id keeps its rank but scores nothing.  Ties: by the first
    list and rank in which an id stands.
    """
    parts = []
    for n, (name, df) in enumerate(lists.items()):
        w = max(0.0, float((weights or {}).get(name, 1.0)))
        parts.append(df.select(F.col(id).cast("string").alias(id), F.lit(n).alias("n"), F.lit(name).alias("channel"), "rank", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part")))
    rows = reduce(DataFrame.unionByName, parts).filter(F.col(id).isNotNull() & (F.col(id) != ""))
    fused = rows.groupBy(id).agg(F.sum("part").alias("sum"), F.min(F.struct("n", "rank")).alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("n", "rank", "channel"))), lambda x: x["channel"]).alias("match_channels"))
    return fused.orderBy(F.desc("sum"), "first").limit(max(1, k)).select(id, F.round("sum", 6).alias("score"), "match_channels")


def coverage_prior(ranked: DataFrame, provider: str, regions: tuple[str, ...], query: str = "", bonus: float = COVERAGE_BONUS) -> DataFrame:
    """Adds bonus to the score of providers whose name starts with no region; nothing if the query names one."""
    if bonus <= 0 or any(r in query for r in regions):
        return ranked.withColumn("coverage_prior", F.lit(None).cast("string"))
    name = F.trim(F.coalesce(F.col(provider), F.lit("")))
    local = reduce(lambda a, b: a | b, (name.startswith(r) for r in regions), F.lit(False))
    wide = (name != "") & ~local
    return ranked.withColumn("score", F.when(wide, F.round(F.col("score") + bonus, 6)).otherwise(F.col("score"))).withColumn("coverage_prior", F.when(wide, "nationwide"))


def with_rank(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank; for lists already cut to their k best, so one small task orders them."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(vector: DataFrame, lexical: DataFrame, id: str, k: int, available: DataFrame | None = None, weights: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """Fusion of both channels, or the one that has rows; then the availability filter, then the k best.

    vector, lexical: (id, score, rank).  Which of the channels have rows is part
    of the plan: nothing runs while it is made.  The filter comes after the
    candidates are cut, so fewer than k rows may stay.
    """
    most = min(MOST, max(k, k * CANDIDATES))
    named = lambda df, n, name: df.orderBy("rank").limit(most).select(F.col(id).cast("string").alias(id), F.col("score"), F.array(F.lit(name)).alias("match_channels"), F.lit(n).alias("part"))
    both = fuse_ranks({"vector": vector, "lexical": lexical}, id, most, {"vector": weights[0], "lexical": weights[1]}).withColumn("part", F.lit(0))
    alone = named(vector, 1, "vector").unionByName(named(lexical, 2, "lexical"))
    channels = alone.agg(F.countDistinct("part").alias("channels"))
    ranked = both.unionByName(alone).crossJoin(F.broadcast(channels)).filter((F.col("part") == 0) == (F.col("channels") == 2)).drop("part", "channels")
    if available is not None:
        ranked = ranked.join(available.select(F.col(id).cast("string").alias(id)).distinct(), id, "left_semi")
    return ranked.orderBy(F.desc("score"), id).limit(k)


def _grams(c: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(F.filter(pairs, lambda g: g != ""))


def overlap_ratio(needle: Column, hay: Column) -> Column:
    """The share of the needle's bigrams that hay has."""
    return let(_grams(needle), lambda n: F.coalesce(F.try_divide(F.size(F.array_intersect(n, _grams(hay))), F.size(n)), F.lit(0.0)))


def tiered_search(docs: DataFrame, query: str, fields: dict[str, float], id: str, name: str, k: int = 10) -> DataFrame:
    """Weighted field search, filled up by a wider search over all fields when it finds fewer than k: (id, tier, score).

    A field's plain and compact forms and its bigrams are worked out once for all
    words of the query; the wider search is only worked out for rows that the
    first finds nothing in.
    """
    terms = [t for t in re.split(r"[\s,，/|]+", query.lower()) if t]
    low = {f: F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields}
    asked = docs.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, terms)), lambda t: F.struct(compact(t).alias("c"), _grams(compact(t)).alias("g")))).first()[0] if terms else []
    sum_ = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0.0))

    def ratio(grams: Column, n: int) -> Column:
        own = asked[n]["g"]
        return F.size(F.array_intersect(grams, F.array(*map(F.lit, own)))) / F.lit(float(len(own))) if own else F.lit(0.0)

    def hit(form: Column, weight: float, n: int) -> Column:
        needle = asked[n]["c"]
        near = let(ratio(form["g"], n), lambda r: F.when(r >= 0.5, r * weight * 0.45).otherwise(0.0)) if len(needle) >= 2 else F.lit(0.0)
        return F.when(F.contains(form["p"], F.lit(terms[n])), F.lit(float(weight))).when(F.contains(form["c"], F.lit(needle)) if needle else F.lit(False), F.lit(weight * 0.8)).otherwise(near)

    def strict(f: str, weight: float) -> Column:
        form = lambda p: let(compact(p), lambda c: let(F.struct(p.alias("p"), c.alias("c"), _grams(c).alias("g")), lambda x: sum_(hit(x, weight, n) for n in range(len(terms)))))
        return let(low[f], form)

    broad = let(_grams(compact(F.concat_ws(" ", *low.values()))), lambda g: sum_(let(ratio(g, n), lambda r: F.when(r >= 0.25, r).otherwise(0.0)) for n in range(len(terms))))
    first = sum_(strict(f, w) for f, w in fields.items()) if terms else F.lit(1.0)
    tiers = docs.select(id, name, F.inline(F.array(let(first, lambda s: F.struct(F.when(s > 0, 1).otherwise(2).alias("tier"), F.when(s > 0, s).otherwise(broad).alias("score"))))))
    # A second-tier row only shows where the first tier is short: the order says so, so no count is needed.
    return tiers.filter("score > 0").orderBy("tier", F.desc("score"), name, id).limit(max(1, k)).select(id, "tier", F.round("score", 4).alias("score"))
