"""What the operators of this subpackage share.

Intermediate tables that cut lineage are written as Parquet below the folder of
``spark.checkpoint.dir``, which the driver and all executors share; a lost
executor therefore never loses them.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brontide.llm

# Functions that run on executors travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(brontide.llm)

#: The white space that separates words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may leave that unset; it gets a temporary folder.  On a
    cluster the driver's own folders are not the executors', so there it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brontide-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


_STORED: dict[int, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: the plan above it starts from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _STORED[id(back)] = path
    weakref.finalize(back, _STORED.pop, id(back), None)
    return back


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored tables that nothing will read again."""
    for df in frames:
        path = _STORED.pop(id(df), None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what one Arrow batch of whole texts can take of a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def white_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null and for blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, WHITE_RUN))


def with_columns(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    """batch with columns appended, those of the same name replaced."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in set(names)]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], [*(batch.schema.names[i] for i in kept), *names])


class Plain:
    """A table with its columns named c0, c1, ... by position.

    No name of the table's own, in any case, can then meet the name of a helper
    column.  made: the columns that an operator appends; own columns of those
    names, in any case, are the ones it replaces.
    """

    def __init__(self, df: DataFrame, made: Iterable[str] = ()):
        self.names = list(df.columns)
        self.df = df.toDF(*(f"c{i}" for i in range(len(self.names))))
        gone = {m.lower() for m in made}
        self.kept = [i for i, n in enumerate(self.names) if n.lower() not in gone]

    def find(self, wanted: str) -> str | None:
        """The new name of a column: the one so named, else the first so named in another case, else None."""
        at = [i for i, n in enumerate(self.names) if n == wanted] or [i for i, n in enumerate(self.names) if n.lower() == wanted.lower()]
        return f"c{at[0]}" if at else None

    def name(self, wanted: str) -> str:
        found = self.find(wanted)
        if found is None:
            raise ValueError(f"no column {wanted} among {', '.join(self.names)}")
        return found

    def slim(self, *but: str) -> DataFrame:
        """The table without the columns that are replaced; columns named in but, by new name, stay."""
        return self.df.select(*(c for i, c in enumerate(self.df.columns) if i in set(self.kept) or c in but))

    def own(self, *but: str) -> list[Column]:
        """The columns that stay, under their own names, but for those whose new name is in but."""
        return [F.col(f"c{i}").alias(self.names[i]) for i in self.kept if f"c{i}" not in but]


def appended(schema: T.StructType, drop: Iterable[str], **made: T.DataType) -> T.StructType:
    """schema without the fields in drop and with those made at its end."""
    gone = set(drop)
    return T.StructType([f for f in schema if f.name not in gone] + [T.StructField(k, t) for k, t in made.items()])


def least_by_hash(df: DataFrame, h: str, n: int) -> DataFrame:
    """The rows of df with the least hex hashes, at most n of them and nearly n.

    The driver sees a histogram of the hashes' leading digits, 65,536 rows at
    most, not n rows from every partition as a sort with a limit would send it.
    """
    prefix, digits = "", 4
    while len(prefix) <= 24:
        part = df.filter(F.col(h).startswith(prefix)) if prefix else df
        counts = sorted(part.groupBy(F.substring(h, len(prefix) + 1, digits).alias("k")).count().collect())
        total, cut = 0, None
        for k, c in counts:
            if total + c > n:
                cut = k
                break
            total += c
        if cut is None:
            return part
        if total:
            return part.filter(F.substring(h, len(prefix) + 1, digits) < cut)
        prefix += cut
    return df.limit(0)
