"""Tables written once to the folder that a cluster shares, so that what follows starts from files.

Neither lineage nor the loss of an executor grows with the rounds of a fixpoint
that writes each of them.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PLACES: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local session may leave that unset; it gets a temporary folder.  A
    cluster's executors don't share the driver's folders, so there it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brontide-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = path
    weakref.finalize(out, _PLACES.pop, id(out), None)
    return out


def written_counting(df: DataFrame, flag: str) -> tuple[DataFrame, int]:
    """written, and how many of the rows have the flag: counted as they are written, so no further job reads them.  df has rows."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(F.col(flag)).alias("n")))
    return out, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more."""
    for df in tables:
        path = _PLACES.pop(id(df), None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a task whose rows take long.
TASK_ROWS = 4096


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by key into tasks of about `rows` rows each: a table of few bytes, one task as it is read, may take long to work on."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, key) if tasks > 1 else df


class Log:
    """A table that grows by appended rounds; each round writes its own rows and no others."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.rounds = spark, schema, 0
        self.path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"

    def append(self, df: DataFrame) -> DataFrame:
        """Writes the rows of df as the next round and returns them, read back."""
        at = f"{self.path}/round={self.rounds}"
        df.write.parquet(at)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def rows(self) -> DataFrame:
        """All rows so far, with the number of their round."""
        schema = f"{self.schema}, round int"
        return self.spark.read.schema(schema).parquet(self.path) if self.rounds else self.spark.createDataFrame([], schema)

    def discard(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
