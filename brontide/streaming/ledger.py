"""Streaming forms: progress of runs, idempotent appends, windows over late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, ts: str, kind: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n) per tumbling window; events later than the watermark are dropped, as a stream must."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    marked = timed.withWatermark("at", late) if events.isStreaming else timed
    return marked.groupBy(F.window("at", size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def first_requests(requests: DataFrame, key: str, ts: str, late: str = "2 days") -> DataFrame:
    """One row per idempotency key, the first; a stream keeps the one that comes first and forgets keys older than the watermark."""
    timed = requests.withColumn("at", F.col(ts).cast("timestamp"))
    if requests.isStreaming:
        return timed.withWatermark("at", late).dropDuplicatesWithinWatermark([key])
    rest = [c for c in timed.columns if c not in (key, "at")]
    return timed.groupBy(key).agg(F.min(F.struct("at", *rest)).alias("x")).select(key, "x.*").select(*timed.columns)


def append_only(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a Parquet ledger, exactly once by its checkpoint, and stops when all that is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def token_stream(lines: DataFrame, value: str = "value") -> DataFrame:
    """NDJSON lines as (response, done, error): error is set where a line is no JSON object."""
    v = F.from_json(value, "response string, done boolean")
    return lines.select(F.coalesce(v["response"], F.lit("")).alias("response"), F.coalesce(v["done"], F.lit(False)).alias("done"), F.when(F.try_parse_json(value).isNull(), F.lit("invalid line")).alias("error"))


def concat_tokens(lines: DataFrame, key: str, number: str, value: str = "value") -> DataFrame:
    """(key, text, errors): the responses of each stream of NDJSON lines put together in the order of their numbers.

    errors: for each line that is no JSON object its number and what is wrong, in
    order.  Blank lines say nothing.  A number is a line's place in its stream.
    """
    whole = lines.filter(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    parsed = F.try_parse_json(value)
    wrong = F.when(parsed.isNull(), "no JSON").when(~F.ltrim(value).startswith("{"), "no JSON object")
    said = F.when(wrong.isNull(), F.coalesce(F.get_json_object(value, "$.response"), F.lit("")))
    part = F.struct(F.col(number).alias("at"), said.alias("said"), wrong.alias("wrong"))
    ordered = whole.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("p"))
    bad = F.transform(F.filter("p", lambda x: x["wrong"].isNotNull()), lambda x: F.struct(x["at"].cast("bigint").alias("line"), x["wrong"].alias("error")))
    return ordered.select(key, F.array_join(F.transform("p", lambda x: x["said"]), "").alias("text"), bad.alias("errors"))
