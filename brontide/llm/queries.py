"""The operators of this subpackage bound to the tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import bpe, cotraining, divergence, embedding_dedup, html_extraction, licenses, mixing, quality_rules, sharding, simhash, toxicity, url_filters, vector_codes
from brontide.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def codec(name: str = VOCABULARY) -> bpe.Codec:
    import public_tokenizers

    return bpe.Codec(bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_text=False)
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=False)
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"), shards.alias("shards"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))
    return groups.select("vec_id", "n_links", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), allowed=~held_out)
    scored = toxicity.toxicity(docs, model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "threshold", "flagged")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), codec(), digest=True, keep_text=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.tree(8), sharding.tree(9), carry=False)
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5),
named AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g FROM win),
again AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM named) WHERE c > 1),
cover AS (SELECT rid, count(DISTINCT p + k) AS n FROM again, range(5) AS r(k) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(ws, lambda x: list_contains({stop}, rtrim(x, '.,')))) AS BIGINT) AS n_stop, len(ls) AS n_lines
      FROM w LEFT JOIN cover USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed{rules} AS kept FROM b
"""
_METRIC = {"words": "n_words", "chars_per_word": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_words_per_word": "n_stop / n_words", "dup_lines_per_line": "n_dup_lines / n_lines", "words_per_line": "n_words / n_lines"}


def _op1_sql() -> str:
    stop = sorted({x for w in quality_rules.STOP_WORDS for x in (w, w.capitalize(), w.upper())})
    rules = ""
    for r in quality_rules.RULES:
        a, _, b = _METRIC[r.metric].partition(" / ")
        m = lambda granted: f"CAST({a} + {granted} AS DOUBLE)" + (f" / nullif({b}, 0)" if b else "")  # noqa: E731, B023
        bad = " OR ".join([f"{m(r.slack)} < {r.low}"] * (r.low is not None) + [f"{m(-r.slack)} > {r.high}"] * (r.high is not None))
        rules += f" AND NOT coalesce({bad}, false)"
    return _OP1.replace("{stop}", "[" + ", ".join(f"'{x}'" for x in stop) + "]").replace("{rules}", rules)


def _md5(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS BIGINT)"


_OP4 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(CAST(doc_id AS VARCHAR), '') AS id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT *, {_md5("'block'", "id")} % 1024 AS block, {_md5("'order'", "id")} AS o FROM d),
s AS (SELECT k, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY k = '', k) - 1 AS i FROM p GROUP BY k),
v AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][i % 3 + 1] AS weight, 2.0::DOUBLE * n AS cap FROM s),
c AS (SELECT *, sum(cap) OVER q AS capped, sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS opened,
             lead(cap / weight) OVER (ORDER BY cap / weight, k) AS nxt, row_number() OVER (ORDER BY cap / weight, k) AS r
      FROM v WINDOW q AS (ORDER BY cap / weight, k)),
l AS (SELECT (1.5::DOUBLE * (SELECT sum(n) FROM s) - capped) / opened AS lam, nxt, r FROM c WHERE opened > 0
      UNION ALL SELECT 1.5::DOUBLE * sum(n) / sum(weight), min(cap / weight), 0 FROM v),
g AS (SELECT coalesce(arg_min(lam, r) FILTER (lam <= nxt), 1e300) AS lam FROM l),
t AS (SELECT k, n AS source_size, least(cap, (SELECT lam FROM g) * weight) AS target FROM v),
b AS (SELECT k, block, sum(size)::BIGINT AS block_size FROM p GROUP BY k, block),
e AS (SELECT b.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
             coalesce(sum(block_size) OVER (PARTITION BY k ORDER BY {_md5("'permute'", "'7'", "k", "CAST(block AS VARCHAR)")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM b JOIN t USING (k)),
m AS (SELECT *, least(block_size, greatest(0, round(target - epochs * source_size)::BIGINT - start)) AS missing FROM e),
x AS (SELECT p.doc_id, p.rid, k, block, size, source_size, target, epochs, missing, block_size,
             coalesce(sum(size) OVER (PARTITION BY k, block ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM p JOIN m USING (k, block)),
y AS (SELECT k, block, unnest(range(1, epochs + CASE WHEN missing > 0 THEN 2 ELSE 1 END)) AS turn FROM m),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_md5("'deal'", "'7'", "k", "CAST(block AS VARCHAR)", "CAST(turn AS VARCHAR)")}, block, turn) AS place FROM y),
n0 AS (SELECT 0::BIGINT AS lo, s.i, s.k, count(*) AS have FROM y JOIN s USING (k) GROUP BY ALL),
{{tree}}
z AS (SELECT k, lo AS shard, have, sum(have) OVER (PARTITION BY k ORDER BY lo) AS last FROM n{{levels}}),
h AS (SELECT a.k, block, turn, shard FROM a JOIN z ON a.k = z.k AND place > last - have AND place <= last),
w AS (SELECT rid, turn, shard, CASE WHEN turn <= epochs THEN size ELSE least(size, greatest(0, missing - before)) END AS words FROM x JOIN h USING (k, block)),
g2 AS (SELECT rid, sum(words)::BIGINT AS taken, count(*)::INTEGER AS n_draws, string_agg(shard, ',' ORDER BY turn) AS shards FROM w WHERE words > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_draws, 0)::INTEGER AS n_draws, coalesce(shards, '') AS shards FROM x LEFT JOIN g2 USING (rid)
"""


def _op4_sql(shards: int = 64) -> str:
    """The mix in SQL; the tree's levels are written out, for a number of shards that is a power of two."""
    key = "xor(h, v)"
    steps = f"[{key}]"
    for shift, factor in mixing._MIX:
        steps = f"list_transform({steps}, lambda q: xor(q, q >> {shift}) * {factor}::UBIGINT & 4294967295::UBIGINT)"
    tree, size, level = "", shards, 0
    while size > 1:
        keyed = f"list_reduce([0::UBIGINT, 7::UBIGINT, lo::UBIGINT, (lo + {size})::UBIGINT, i::UBIGINT, j::UBIGINT], lambda h, v: {steps}[1])"
        tree += f"""u{level} AS (SELECT lo, i, k, row_number() OVER (PARTITION BY lo ORDER BY key, i, j) AS r, count(*) OVER (PARTITION BY lo) AS total
       FROM (SELECT *, {keyed} AS key FROM (SELECT *, unnest(range(have)) AS j FROM n{level}))),
n{level + 1} AS (SELECT CASE WHEN r <= total // 2 THEN lo ELSE lo + {size // 2} END AS lo, i, k, count(*) AS have FROM u{level} GROUP BY ALL),
"""
        size, level = size // 2, level + 1
    return _OP4.replace("{tree}", tree.strip()).replace("{levels}", str(level))


_OP5 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE list_inner_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9),
r AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, r.c AS component_id, v.vec_id = r.c AS kept FROM v JOIN r ON r.a = v.vec_id
"""


def _op8_sql() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_filters.RULES)
    return rf"""
WITH rules(rh, rp, rv) AS (VALUES {rules}),
s AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(t, length(regexp_extract(t, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM s),
f AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, f.rule, coalesce(rv, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.k = 1
"""


def _op11_sql() -> str:
    """Both trees level by level: the child with the least draw of each node."""
    number = lambda *parts: "CAST('0x' || substr(md5(" + " || '/' || ".join(parts) + f"), 1, {sharding.BITS // 4}) AS BIGINT)"

    def won(children: dict[str, float]) -> str:
        draws = ", ".join(f"{{'d': -ln(({number('key', repr(n))}::DOUBLE + 0.5) / {1 << sharding.BITS}) / {w}, 'i': {i}, 'n': {n!r}}}" for i, (n, w) in enumerate(children.items()))
        return f"list_min([{draws}]).n"

    def level(shards: list, depth: int) -> str:
        name = lambda s: "/".join([s.region, s.rack, str(s.shard)][: depth + 1])
        nodes: dict[str, dict[str, float]] = {}
        for s in shards:
            node = nodes.setdefault("/".join([s.region, s.rack][:depth]), {})
            node[name(s)] = node.get(name(s), 0.0) + s.weight
        if depth == 0:
            return won(nodes[""])
        return f"CASE n{depth - 1} " + " ".join(f"WHEN {n!r} THEN {won(c)}" for n, c in nodes.items()) + " END"

    steps = ""
    for of, shards in (("a", sharding.tree(8)), ("b", sharding.tree(9))):
        for depth in range(3):
            under = "d0" if depth == 0 else f"{of}{depth - 1}"
            steps += f"{of}{depth} AS (SELECT *, {level(shards, depth)} AS n{depth} FROM {under}),\n"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN doc_id IS NULL THEN '' ELSE 'k' || doc_id END AS key,
                  octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, coalesce(text, '') AS t FROM documents),
t AS (SELECT list(CASE WHEN c & 255 = k THEN v END ORDER BY k) AS crc FROM (SELECT k, k AS c, list_reduce(list_prepend(k::BIGINT, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(k))),
h AS (SELECT d.*, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: (instr('0123456789ABCDEF', b[1]) * 16 + instr('0123456789ABCDEF', b[2]) - 17)::BIGINT) AS bytes FROM d),
d0 AS (SELECT doc_id, rid, key, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, t),{steps}
f AS (SELECT a2.*, b2.n2 AS grown FROM a2 JOIN b2 USING (rid))
SELECT doc_id, size, text_crc32, 'key' AS law, split_part(n2, '/', 3)::INTEGER AS shard, split_part(grown, '/', 3)::INTEGER AS grown_shard, n0 AS region, n1 AS rack,
       row_number() OVER (PARTITION BY n2 ORDER BY {number('key', 'size', 'text_crc32')}, key, size, text_crc32) - 1 AS slot FROM f
"""


_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS kept FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
ns AS (SELECT lang, source, sum(n) AS words FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS words FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(words, 0) + kept) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN ns USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(words) + any_value(kept)) AS q FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def _op13_sql() -> str:
    assign = lambda k: f"""
a{k} AS (SELECT rid, part, x, e.entry, d FROM (
           SELECT rid, part, x, b.entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b.c[i]) * (x[i] - b.c[i])))::BIGINT AS d,
                  row_number() OVER (PARTITION BY rid, part ORDER BY d, b.entry) AS r FROM parts JOIN b{k} b USING (part)) e WHERE r = 1),"""  # noqa: E731
    update = lambda k: f"""
s{k} AS (SELECT part, entry, list(c ORDER BY i) AS c FROM (
           SELECT part, entry, i, floor(sum(x[i])::DECIMAL(38, 0) / count(*))::BIGINT AS c FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN s{k} s USING (part, entry)),"""  # noqa: E731
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, unnest(range(0, {vector_codes.PARTS})) AS part, v[part * len(v) // {vector_codes.PARTS} + 1:(part + 1) * len(v) // {vector_codes.PARTS}] AS x FROM kept),
first AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept QUALIFY entry < {vector_codes.ENTRIES}),
b0 AS (SELECT part, entry, x AS c FROM parts JOIN first USING (rid)),
{assign(0)}{update(0)}{assign(1)}{update(1)}{assign(2)}
coded AS (SELECT rid, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
f AS (SELECT vec_id, label, code, error FROM kept JOIN coded USING (rid)),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM f GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN l ON f.label IS NOT DISTINCT FROM l.label CROSS JOIN digest
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op4_mixing": _op4_sql(), "op5_embedding_dedup": _OP5, "op8_url_filters": _op8_sql(), "op11_sharding": _op11_sql(), "op12_divergence": _OP12, "op13_vector_codes": _op13_sql()}
