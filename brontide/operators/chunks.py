"""Search chunks of catalog documents: greedy packing in one Arrow pass."""

from __future__ import annotations

from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brontide.functions.text import clean_markup

#: Characters a chunk may hold.
MOST_CHARS = 650
#: Documents that a task reads, and chunks that it holds to hand on, at a time.
DOCUMENTS, CHUNKS = 256, 4096


def pack(items: list[str], most: int = MOST_CHARS) -> list[str]:
    """Items joined by line ends into groups of at most `most` characters; longer items are cut hard."""
    out: list[str] = []
    for item in (str(i or "").strip() for i in items):
        for at in range(0, len(item), most):
            piece = item[at : at + most]
            if out and len(out[-1]) + 1 + len(piece) <= most:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out


def chunks_of(identity: str, description: str | None, endpoints: list[str], fields: list[str], most: int = MOST_CHARS) -> list[tuple[str, str]]:
    """(kind, text): the identity before each group; overview, endpoints and fields in turn, to the end of the longest."""
    groups = {"overview": pack([description], most) if description else [""], "endpoints": pack(endpoints, most), "response_fields": pack(fields, most)}
    heads = {"overview": "[설명]", "endpoints": "[엔드포인트]", "response_fields": "[응답필드]"}
    out = []
    for i in range(max(map(len, groups.values()))):
        for kind, parts in groups.items():
            if i < len(parts):
                body = f"{heads[kind]}\n{parts[i]}" if parts[i] else ""
                text = "\n".join(x for x in (identity, body) if x)
                if text:
                    out.append((kind, text))
    return out


def search_chunks(docs: DataFrame, id: str, identity: Column, description: Column, endpoints: Column, fields: Column) -> DataFrame:
    """(id, chunk_index, chunk_type, text): all chunks of each document."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, DOCUMENTS):
                key, *columns = b.slice(at, DOCUMENTS).columns
                texts = zip(*(c.to_pylist() for c in columns), strict=True)
                made = ((i, n, k, t) for i, (w, x, y, z) in enumerate(texts) for n, (k, t) in enumerate(chunks_of(w or "", x, y or [], z or [])))
                for part in batched(made, CHUNKS):
                    i, n, k, t = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(i)), pa.array(n, pa.int32()), pa.array(k), pa.array(t)], ["id", "chunk_index", "chunk_type", "text"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), identity.alias("a"), description.alias("b"), endpoints.alias("c"), fields.alias("d"))
    return rows.mapInArrow(run, f"id {kind}, chunk_index int, chunk_type string, text string").withColumnRenamed("id", id)


def identity_header(title: Column, provider: Column, category: Column, keywords: Column) -> Column:
    """The lines that every chunk repeats; blank fields give none."""
    line = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{mark}] "), c))
    return F.concat_ws("\n", line("제목", title), line("기관", provider), line("분류", category), line("키워드", keywords))


def search_blob(*parts: Column) -> Column:
    """All searchable text of a service in one cleaned, lower-cased string."""
    joined = F.concat_ws(" ", *parts)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(joined, "<[^>]+>", " "), r"\s+", " ")))


#: The texts that a service is searched in.
BLOBS = ("all", "service_name", "keywords", "endpoint_paths", "endpoint_summaries", "field_names", "field_descriptions", "field_paths", "semantic")


def search_blobs(tables: dict[str, DataFrame], minimal: DataFrame | None = None, id: str = "service_id", order: str = "ordinal") -> DataFrame:
    """(id, one column for each of BLOBS): the nine named texts of each service, cleaned.

    tables: services (name, description, keywords, category, provider_agency_name),
    documents (body), endpoints (path, summary), fields (field_name, description,
    field_path), mappings (aliases), tags (domain_ids, concept_ids), concepts
    (concept_id, canonical_name) and chunks (search_text), all but concepts with
    id; those with many rows of a service with order.  `all` joins the sixteen
    sources.  minimal: (id) of services that are known by their document alone.
    """
    words = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    put = lambda parts: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, parts.alias("v")))), lambda x: x["v"]), " ")
    many = lambda name, **made: tables[name].groupBy(id).agg(*(put(c).alias(k) for k, c in made.items()))
    one = lambda name, **made: tables[name].select(id, *(c.alias(k) for k, c in made.items()))
    tagged = tables["tags"].select(id, F.posexplode_outer("concept_ids").alias("ordinal_", "concept_id"))
    named = tagged.join(tables["concepts"].groupBy("concept_id").agg(F.min("canonical_name").alias("canonical_name")), "concept_id", "left")
    concepts = named.groupBy(id).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal_", F.coalesce("canonical_name", "concept_id").alias("v")))), lambda x: x["v"]), " ").alias("concept_names"))
    parts = (
        one("documents", body=text("body")),
        many("endpoints", endpoint_paths=text("path"), endpoint_summaries=text("summary")),
        many("fields", field_names=clean_markup(text("field_name")), field_descriptions=clean_markup(text("description")), field_paths=clean_markup(text("field_path"))),
        many("mappings", aliases=words(F.transform("aliases", clean_markup))),
        one("tags", domains=words(F.col("domain_ids")), concepts=words(F.col("concept_ids"))),
        concepts,
        many("chunks", chunk_texts=text("search_text")),
    )
    rows = tables["services"].select(id, "name", "description", words(F.col("keywords")).alias("words"), "category", "provider_agency_name")
    for p in parts:
        rows = rows.join(p, id, "left")
    rows = rows.join((rows.select(id).limit(0) if minimal is None else minimal.select(id).distinct()).withColumn("minimal", F.lit(True)), id, "left")
    known = F.coalesce("minimal", F.lit(False))
    sources = ("name", "description", "words", "category", "provider_agency_name", "body", "endpoint_paths", "endpoint_summaries", "field_names", "field_descriptions", "field_paths", "aliases", "domains", "concepts", "concept_names", "chunk_texts")
    joined = F.concat_ws(" ", *map(text, sources))
    blob = {
        "all": F.when(known, text("body")).otherwise(joined),
        "service_name": text("name"),
        "keywords": text("words"),
        **{c: F.when(known, "").otherwise(text(c)) for c in BLOBS[3:8]},
        "semantic": F.when(known, text("category")).otherwise(F.concat_ws(" ", text("domains"), text("concepts"), text("concept_names"))),
    }
    return rows.select(id, *(clean_markup(blob[b]).alias(b) for b in BLOBS))


def build_index(docs: DataFrame, path: str, built_at: str, id: str, **columns: Column) -> DataFrame:
    """Writes the chunks, then a manifest row; a reader that finds no manifest must not use the chunks."""
    spark = docs.sparkSession
    spark.createDataFrame([], "built_at string, chunks bigint, documents bigint").write.mode("overwrite").json(f"{path}/manifest")
    chunks = search_chunks(docs, id, **columns)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    made = spark.read.parquet(f"{path}/chunks")
    manifest = made.agg(F.lit(built_at).alias("built_at"), F.count("*").alias("chunks"), F.countDistinct(id).alias("documents"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return made
