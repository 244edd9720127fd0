"""All operators and the pipeline's stages on odd tables, and with workers that can't import the package."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brontide.llm import bpe, cotraining, divergence, embedding_dedup, html_extraction, licenses, mixing, quality_rules, sharding, simhash, toxicity, url_filters, vector_codes
from brontide.llm.common import Plain
from brontide.llm.queries import codec
from tests.conftest import ROOT

#: Names that operators append or use on the way; a table may have columns so named, in any case.
CLASHES = """
key block order spot size source_size target taken draws extra missing edge gap epochs homes turns rank shard at slice left position words
n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_lines base_failed failed_rules n_base first_word last_word base_labels labels
score kept text_score meta_score id x m u y h n predicted threshold flagged host path rule verdict row root rep copies component component_id least
law region rack shard slot grown_shard home size text_crc32 range part within first start among row column s n df kept item code error label_error codebooks_sha256 v of
n_links count_row root_row stay_id stay_h fp made n_tokens ids ids_sha256 decoded_sha256 round_trip decoded n_chars_ c0 C1 mix_key simhash_rank value
""".split()


def clashing(df):
    """df with columns named as all helpers, in upper case, unless df has such a column itself."""
    own = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(f"mine {c}").alias(c.upper()) for c in dict.fromkeys(x.lower() for x in CLASHES) if c not in own))


TEXTS = [None, "", " \n\t", "one", "The same text of some words. " * 9, "The same text of some words. " * 9, "Mit License\nidiot " * 3, "w " * 60_000, "é漢🙂" * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 3}", None if i == 2 else i) for i, t in enumerate(TEXTS)]
    return clashing(spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (5, 1, 0), (6, 0, 1), (7, 0, 0), (8, None, None), (None, 1, 1), (6, 0, 1), (1, 1, 0), (1, 0, 1)]
    return clashing(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [2.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0])]
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(None).cast("int")))


@pytest.fixture(scope="module")
def pages(spark):
    page = "<nav>Home</nav><article><p>Some text that is long enough to be read.</p></article>"
    rows = [(1, None, None), (2, "", ""), (3, "http://COM/x", page), (3, "http://COM/x", page), (None, "http://a.net/es/" + "x" * 100_000, page * 300)]
    return clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))


CASES = {
    "op1": ("docs", lambda d, x: quality_rules.quality_rules(d)),
    "op2": ("docs", lambda d, x: cotraining.quality_classifier(d, x)),
    "op2 without text": ("docs", lambda d, x: cotraining.quality_classifier(d, x, keep_text=False)),
    "op3": ("docs", lambda d, x: simhash.simhash_groups(d)),
    "op3 fingerprints": ("docs", lambda d, x: simhash.with_fingerprints(d)),
    "op3 dedup": ("docs", lambda d, x: simhash.simhash_dedup(d)),
    "op4": ("docs", lambda d, x: mixing.mix_sources(d)),
    "op4 narrow": ("docs", lambda d, x: mixing.mix_sources(d, carry=False)),
    "op4 documents": ("docs", lambda d, x: mixing.mixed_documents(d)),
    "op5": ("vectors", lambda d, x: embedding_dedup.embedding_groups(d)),
    "op6": ("docs", lambda d, x: toxicity.toxicity(d, toxicity.fit_toxicity(d, x))),
    "op7": ("docs", lambda d, x: bpe.encode_documents(d, codec(), verify=True)),
    "op7 digest": ("docs", lambda d, x: bpe.encode_documents(d, codec(), digest=True, keep_text=False)),
    "op7 decode": ("docs", lambda d, x: bpe.decode_documents(bpe.encode_documents(d, codec()), codec())),
    "op8": ("pages", lambda d, x: url_filters.judge_urls(d)),
    "op9": ("pages", lambda d, x: html_extraction.extract_main_text(d)),
    "op10": ("docs", lambda d, x: licenses.license_scan(d)),
    "op11": ("docs", lambda d, x: sharding.shard_documents(d, sharding.tree(8), sharding.tree(9))),
    "op11 narrow": ("docs", lambda d, x: sharding.shard_documents(d, sharding.tree(8), carry=False)),
    "op12": ("docs", lambda d, x: divergence.source_divergence(d)),
    "op13": ("vectors", lambda d, x: vector_codes.encode_vectors(d)),
}
#: Cases whose rows are not the table's, one for one.
OTHER_ROWS = ("op3 dedup", "op4 documents", "op12", "op13")
APPENDED = {
    "op1": {"kept", "n_words"},
    "op2": {"score", "kept"},
    "op4": {"taken", "draws", "size"},
    "op5": {"n_links", "component_id", "kept"},
    "op6": {"score", "predicted"},
    "op7": {"ids", "round_trip"},
    "op8": {"host", "path", "rule", "verdict"},
    "op9": {"text", "n_chars"},
    "op10": {"labels", "score"},
    "op11": {"size", "shard", "slot", "law", "region", "rack", "text_crc32", "grown_shard"},
    "op13": {"code", "error", "label_error", "codebooks_sha256"},
}


@pytest.mark.parametrize("case", CASES)
def test_nulls_repeats_long_texts_and_clashing_names(case, request, labels):
    kind, run = CASES[case]
    table = request.getfixturevalue(kind)
    out = run(table, labels)
    names = [c.lower() for c in out.columns]
    assert len(set(names)) == len(names)
    rows = out.collect()
    if case not in OTHER_ROWS:
        assert len(rows) == table.count()
    made = APPENDED.get(case, set())
    assert made <= set(out.columns)
    if "narrow" not in case and case != "op3":  # every column that is not replaced is there as it was
        for c in set(table.columns) & set(out.columns) - made:
            if c.isupper():
                assert {r[c] for r in rows} <= {f"mine {c.lower()}", f"mine {c}"}, c
    # Repeated rows fare alike, but that one of several copies stays or is drawn.
    if case not in ("op3 dedup", "op4", "op4 narrow", "op4 documents", "op11", "op11 narrow", "op12"):
        same = [repr(r) for r in rows if r[out.columns[0]] == (4 if kind != "pages" else 3)]
        assert len(set(same)) == 1 and len(same) > 1
    assert run(table.limit(0), labels).count() == 0
    assert run(table.limit(0), labels.limit(0)).count() == 0


def test_all_columns_null(spark):
    docs = spark.createDataFrame([(None,) * 5] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    for case, (kind, run) in CASES.items():
        if kind == "docs" and case != "op12":
            assert run(docs, labels).count() == (1 if case == "op3 dedup" else 0 if case == "op4 documents" else 3), case


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    import corpus_pipeline

    rows = [(7, 0, 0), (5, 1, 0), (4, 1, 0), (8, 0, 0), (6, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        own = {tuple(map(repr, r)) for r in table.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            got = out.collect()
            if name == "byte-level bpe":
                assert len(got) == table.count() and {"ids", "n_tokens", "round_trip", "source", "HOST"} <= set(out.columns)
            else:
                assert out.columns == table.columns and {tuple(map(repr, r)) for r in got} <= own, name


def test_plain_names():
    class Table:
        columns = ["A", "a", "b"]

        def toDF(self, *names):
            return names

    t = Plain(Table(), ["B"])
    assert (t.name("A"), t.name("a"), t.name("B"), t.find("c")) == ("c0", "c1", "c2", None) and t.kept == [0, 1]
    with pytest.raises(ValueError):
        t.name("c")


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from tests.llm.test_odd_tables import CASES
docs = spark.createDataFrame([(i, "word " * i + "other", "en", "s", i) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
pages = spark.createDataFrame([(i, "http://a.com/x", "<article><p>Some text here.</article>") for i in range(9)], "page_id long, url string, html string")
found = spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("brontide") is None).collect()
assert found == [True], "workers can import the package"
for name, (kind, run) in CASES.items():
    assert len(run(dict(docs=docs, vectors=vectors, pages=pages)[kind], labels).collect()) >= 0
    print("ran", name)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(SCRIPT.format(root=str(ROOT))))
    # An environment of its own: the caller's path may hold the package, which workers would inherit.
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not (Path(p) / "brontide").exists()]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": os.pathsep.join(paths)} if paths else {})
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("ran ") == len(CASES), done.stderr[-3000:]
