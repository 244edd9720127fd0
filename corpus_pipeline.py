"""A training corpus from the table of documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works
on all rows of docs.  run() writes each stage's rows as Parquet to the shared
folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import bpe, cotraining, mixing, quality_rules, simhash
from brontide.llm.common import Plain, discard, stored, table
from brontide.llm.queries import codec


def _kept(docs: DataFrame, judged, verdict: str) -> DataFrame:
    """The rows of docs that judged finds good, with docs' own columns, whatever judged appends to them and under which names."""
    table = Plain(docs)
    return judged(table).filter(verdict).select(*table.own())


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))

    def judged(d: Plain) -> DataFrame:
        metadata = tuple(c for c in map(d.find, ("lang", "source", "n_chars")) if c)
        view = d.df.withColumnRenamed(d.name("doc_id"), "id")
        return cotraining.quality_classifier(view, labels, "id", d.name("text"), "label", metadata).withColumnRenamed("id", d.name("doc_id"))

    return _kept(docs, judged, "kept")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return _kept(docs, lambda d: quality_rules.quality_rules(d.df, d.name("text")), "kept")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix draws a document; documents that it doesn't draw go."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row's text in its place, and whether they decode to it; a column of docs named as one of these is replaced."""
    return bpe.encode_documents(docs, codec(), verify=True, keep_text=False)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("simhash near-dedup", drop_copies),
    ("mixing sources", mix),
    ("byte-level bpe", tokenize),
]

#: The classifier is a fitted model, which SQL can't express; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        last, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(last)
    return docs
