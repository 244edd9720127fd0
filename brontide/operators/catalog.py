"""Catalog documents: projections of details, endpoints and fields; look-ups, unions and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.functions.text import clean_markup, clip

_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def present(*options: Column) -> Column:
    """The first option that is neither null, empty nor "-"; else empty."""
    return F.coalesce(*(F.when((o != "") & (o != "-"), o) for o in options), F.lit(""))


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last row by order: the struct maximum, so one partial aggregate and no sort of groups."""
    best = F.max(F.struct(*order, *(c for c in df.columns if c not in order and c != key)))
    return df.groupBy(key).agg(best.alias("x")).select(key, "x.*").select(*df.columns)


def first_per_key(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Ordered distinct: each key's first row by ordinal, rows with a blank key dropped."""
    blank = reduce(lambda a, b: a | b, (F.col(k).isNull() | (F.col(k).cast("string") == "") for k in key))
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(ordinal, *(c for c in rest if c != ordinal)))
    return df.filter(~blank).groupBy(*key).agg(best.alias("x")).select(*key, "x.*").select(*df.columns)


def union_by_precedence(parts: list[DataFrame], key: list[str], ordinal: str) -> DataFrame:
    """All rows of the first part, then rows of later parts whose key no earlier part has."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = Window.partitionBy(*key).orderBy("part", ordinal)
    return rows.withColumn("least", F.min("part").over(Window.partitionBy(*key))).withColumn("k", F.row_number().over(first)).filter((F.col("part") == 0) | ((F.col("part") == F.col("least")) & (F.col("k") == 1))).drop("part", "least", "k")


def ordered_lookup(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """wanted (position, key) with found: whether the table has the key; request order is kept as position."""
    known = table.select(key).distinct().withColumn("hit", F.lit(True))
    return wanted.join(known, key, "left").select("position", key, F.coalesce("hit", F.lit(False)).alias("found"))


def set_drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_only, right_only, both): one full outer join of the distinct keys."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    return a.join(b, key, "full_outer").agg(n(F.col("b").isNull(), "left_only"), n(F.col("a").isNull(), "right_only"), n(F.col("a").isNotNull() & F.col("b").isNotNull(), "both"))


def split_by_type(df: DataFrame, kind: Column, targets: list[str]) -> DataFrame:
    """(target, rows): counts per target and of _unknown; a target without rows shows 0, so a sink can refuse."""
    counted = df.groupBy(F.when(kind.isin(*targets), kind).otherwise("_unknown").alias("target")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(t,) for t in [*targets, "_unknown"]], "target string")
    return every.join(counted, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("rows"))


def details(docs: DataFrame) -> DataFrame:
    """Flat detail of crawled documents (api_id, crawled_url, info map, title, description of the specification)."""
    info = lambda k: F.try_element_at("info", F.lit(k))
    words = F.filter(F.transform(F.split(present(info("키워드")), ","), lambda k: F.trim(k)), lambda k: k != "")
    return docs.select(
        F.concat(F.lit("openapi_new:"), F.col("api_id")).alias("service_id"),
        clean_markup(present(info("목록명"), F.col("spec_title"))).alias("name"),
        clean_markup(present(info("설명"), F.col("spec_description"))).alias("description"),
        clean_markup(present(info("제공기관"))).alias("provider"),
        clean_markup(present(info("분류체계"))).alias("category"),
        words.alias("keywords"),
        clean_markup(present(info("수정일"))).alias("updated_at"),
        present(F.col("crawled_url")).alias("url"),
    )


def listed_endpoints(docs: DataFrame) -> DataFrame:
    """(api_id, ordinal, method, path, summary) of listed endpoints, the first of each method and path."""
    e = docs.select("api_id", F.posexplode("endpoints").alias("ordinal", "e"))
    rows = e.select("api_id", "ordinal", F.upper(present(F.col("e.method"))).alias("method"), present(F.col("e.path")).alias("path"), clean_markup(present(F.col("e.description"))).alias("summary"))
    return first_per_key(rows.filter("path <> ''").withColumn("method_key", F.concat("method", F.lit(" "), "path")), ["api_id", "method_key"], "ordinal").drop("method_key")


def spec_endpoints(docs: DataFrame, spec: str = "spec") -> DataFrame:
    """(api_id, path, method, summary, section, n_parameters) of a specification held as a JSON string."""
    op = "map<string,map<string,struct<summary:string,description:string,tags:array<string>,parameters:array<struct<name:string,`in`:string,type:string,required:boolean,description:string>>>>>"
    paths = docs.select("api_id", F.explode(F.from_json(F.get_json_object(spec, "$.paths"), op)).alias("path", "ops"))
    ops = paths.select("api_id", "path", F.explode("ops").alias("method", "op")).withColumn("method", F.upper("method")).filter(F.col("method").isin(*_METHODS))
    return ops.select("api_id", "path", "method", clean_markup(F.coalesce("op.summary", "op.description")).alias("summary"), F.coalesce(F.get("op.tags", 0), F.lit("Default")).alias("section"), F.coalesce(F.size("op.parameters"), F.lit(0)).alias("n_parameters"), F.col("op.parameters").alias("parameters"))


def request_fields(docs: DataFrame, spec: str = "spec") -> DataFrame:
    """(api_id, endpoint_id, name, type, required) of a specification's parameters, distinct by endpoint and name."""
    e = spec_endpoints(docs, spec).select("api_id", F.concat_ws(" ", "method", "path").alias("endpoint_id"), F.posexplode("parameters").alias("ordinal", "p"))
    rows = e.select("api_id", "endpoint_id", "ordinal", present(F.col("p.name")).alias("name"), present(F.col("p.type"), F.col("p.in")).alias("type"), F.coalesce("p.required", F.lit(False)).alias("required"))
    return first_per_key(rows.filter("name <> ''"), ["api_id", "endpoint_id", "name"], "ordinal").drop("ordinal")


def response_fields(docs: DataFrame, spec: str = "spec") -> DataFrame:
    """(api_id, path, name, type) of the properties of a specification's definitions."""
    kind = "map<string,struct<properties:map<string,struct<type:string,description:string>>>>"
    d = docs.select("api_id", F.explode(F.from_json(F.get_json_object(spec, "$.definitions"), kind)).alias("def", "body"))
    return d.select("api_id", "def", F.explode("body.properties").alias("name", "p")).select("api_id", F.concat_ws(".", "def", "name").alias("path"), "name", present(F.col("p.type")).alias("type"))


def compact_projection(df: DataFrame, text: str, items: str, length: int, most: int) -> DataFrame:
    """text clipped, items cut to the first `most`, with the true count and whether some were cut."""
    return df.withColumns({text: clip(F.col(text), length), "n_items": F.size(items), "truncated": F.size(items) > most, items: F.slice(items, 1, most)})


def mask_keys(m: Column, keys: tuple[str, ...], suffixes: tuple[str, ...], mask: str = "***") -> Column:
    """A map with the values of sensitive keys masked."""
    hit = lambda k: reduce(lambda a, b: a | b, (F.endswith(F.lower(k), F.lit(s)) for s in suffixes), F.lower(k).isin(*keys))
    return F.transform_values(m, lambda k, v: F.when(hit(k), mask).otherwise(v))


def facet_filter(df: DataFrame, equal: dict[str, str], query: str, text: list[str]) -> DataFrame:
    """Rows that match every facet given and whose text has every word of the query."""
    blob = F.lower(F.concat_ws(" ", *text))
    out = df.filter(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in equal.items()), F.lit(True)))
    return out.filter(reduce(lambda a, b: a & b, (F.contains(blob, F.lit(t)) for t in query.lower().split()), F.lit(True)))


def concept_names(tags: DataFrame, concepts: DataFrame, id: str = "id") -> DataFrame:
    """(id, names): the names of each service's tags in order, the tag itself where no concept has it.

    tags: (id, ordinal, tag); concepts: (tag, name), of several names the least.
    """
    named = concepts.groupBy("tag").agg(F.min("name").alias("name"))
    j = tags.join(named, "tag", "left").groupBy(id).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("name", "tag").alias("name")))).alias("t"))
    return j.select(id, F.transform("t", lambda x: x["name"]).alias("names"))


def key_sets(a: Column, b: Column) -> Column:
    """struct<shared, same>: the keys that both arrays have, sorted, and whether they have the same keys."""
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("shared"), same.alias("same"))
