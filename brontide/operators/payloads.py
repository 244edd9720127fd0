"""Payloads of planned operations: masking, rejection, rendering, validation, stages.

Payloads are JSON text.  What must look at every depth of one is a small function
per value, in Arrow batches; everything else is built-in expressions.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys whose values are masked, by name and by how they end.
SENSITIVE = ("name", "applicant_name", "birth_date", "birthdate", "resident_id", "phone", "email", "address", "identity_token", "documents", "token", "secret", "password")
SENSITIVE_ENDS = ("_token", "_secret", "_password", "_key")
#: Shapes that no input value may have: URLs, parent and system paths, drive letters, shell operators, line ends.
UNSAFE = (r"(?i)(?:https?|ftp|file)://", r"(?:^|[\\/])\.\.(?:[\\/]|$)", r"^[A-Za-z]:[\\/]", r"(?i)^/(?:etc|proc|sys|var|usr|home|root|tmp)(?:/|$)", r"(?:;|&&|\|\||`|\$\()", r"[\r\n]")


def _leaves(value):
    """The strings at any depth of a JSON value, without recursion."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, (dict, list)):
            todo.extend(v.values() if isinstance(v, dict) else v)


def _masked(value, keys: frozenset, ends: tuple, mask: str):
    if isinstance(value, list):
        return [_masked(v, keys, ends, mask) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: mask if k.lower() in keys or k.lower().endswith(ends) else _masked(v, keys, ends, mask) for k, v in value.items()}


def _loaded(text):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def mask_json(payload: Column, keys: tuple[str, ...] = SENSITIVE, ends: tuple[str, ...] = SENSITIVE_ENDS, mask: str = "***") -> Column:
    """JSON text with the values of sensitive keys masked at every depth; null for what is no JSON."""
    named = frozenset(keys)

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda t: None if (v := _loaded(t)) is None else json.dumps(_masked(v, named, ends, mask), ensure_ascii=False, sort_keys=True))

    return run(payload)


def unsafe(value: Column) -> Column:
    """Whether a string has a shape that no input value may have."""
    return reduce(lambda a, b: a | b, (value.rlike(p) for p in UNSAFE))


def unsafe_json(payload: Column) -> Column:
    """Whether any string at any depth of JSON text is unsafe; text that is no JSON is judged as one string."""
    shapes = [re.compile(p) for p in UNSAFE]

    @F.pandas_udf("boolean")
    def run(c: pd.Series) -> pd.Series:
        def found(t: str) -> bool:
            value = _loaded(t)
            return any(s.search(leaf) for leaf in _leaves(t if value is None else value) for s in shapes)

        return c.map(lambda t: None if t is None else found(t))

    return run(payload)


def render_payload(template: Column, inputs: Column) -> Column:
    """A template map with each value "$key" replaced by the input of that name, null where there is none; other values stay."""
    return F.transform_values(template, lambda k, v: F.when(F.startswith(v, F.lit("$")), F.try_element_at(inputs, F.substring(v, 2, 1 << 30))).otherwise(v))


def allowed_fields(m: Column, keys: tuple[str, ...]) -> Column:
    """A map with the allowed keys only."""
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def input_verdict(value: Column, kind: Column, most: Column, pattern: Column) -> Column:
    """missing, type, length or pattern for an input that breaks its specification, in this order; else ok."""
    whole = F.regexp_like(value, F.concat(F.lit("^("), pattern, F.lit(")$")))
    return F.when(value.isNull(), "missing").when((kind == "integer") & value.try_cast("bigint").isNull(), "type").when(F.length(value) > most, "length").when(~whole, "pattern").otherwise("ok")


#: What marks a linked operation, and the kinds of operation there are.
LINK_MARK = "LINK"
SUBTYPES = ("link", "swagger", "legacy")


#: Names of the catalog's column of API types, in the order they are tried, and its place where it has none of them.
TYPE_COLUMNS, TYPE_PLACE = ("API 유형", "API유형", "API 타입", "API타입"), 30


def api_type_value(row: Column, values: Column) -> Column:
    """A catalog row's API type, trimmed and in capitals: the first of TYPE_COLUMNS that has one, else, where the last of them is missing, the 30th value.

    row: map of the row's cells by column; values: its cells in order.  Empty without a type.
    """
    cell = lambda name: F.try_element_at(row, F.lit(name))
    named = F.coalesce(*(F.when(cell(n) != "", cell(n)) for n in TYPE_COLUMNS))
    placed = F.when(cell(TYPE_COLUMNS[-1]).isNull() & (F.size(values) >= TYPE_PLACE), F.get(values, TYPE_PLACE - 1))
    return F.upper(F.trim(F.coalesce(named, placed, F.lit(""))))


def api_subtype(kind: Column, has_specification: Column) -> Column:
    """struct<subtype, evidence>: link by the catalog's kind, swagger by a specification, else legacy."""
    linked = F.contains(F.upper(F.coalesce(kind, F.lit(""))), F.lit(LINK_MARK))
    spec = F.coalesce(has_specification, F.lit(False))
    link, swagger, legacy = SUBTYPES
    return F.struct(
        F.when(linked, link).when(spec, swagger).otherwise(legacy).alias("subtype"),
        F.when(linked, "catalog kind").when(spec, "specification").otherwise("neither").alias("evidence"),
    )


def picked(requested: Column, planned: Column, candidates: Column, most: int = 3) -> Column:
    """The ids to go on with: those requested, else those planned, else the first candidates."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(requested), some(planned), F.slice(candidates, 1, most))


def stages_in_order(stages: DataFrame, run: str, at: str, ord: str) -> DataFrame:
    """stages with follows: whether a stage's number in the required order is the one after that of the stage before it in its run."""
    before = F.lag(ord).over(Window.partitionBy(run).orderBy(at))
    return stages.withColumn("follows", F.col(ord) - F.coalesce(before, F.lit(0)) == 1)


def quick_summary(body: Column) -> Column:
    """struct<status, text, headings>: of a summary response; headings are its distinct <b> texts, in order."""
    r = F.get_json_object(body, "$.result")
    status = F.when(F.try_parse_json(body).isNull(), "unreadable_body").when(F.coalesce(F.trim(r), F.lit("")) == "", "empty").otherwise("ok")
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(r, F.lit("")), F.lit("(?s)<b>(.*?)</b>"), 1), lambda h: F.trim(h)))
    return F.struct(status.alias("status"), F.when(status == "ok", r).alias("text"), F.when(status == "ok", found).otherwise(F.array().cast("array<string>")).alias("headings"))


def download_map(distributions: DataFrame, id: str, at: str, fmt: str, url: str, base: str, marker: str = "atchFileId=") -> DataFrame:
    """(id, key, url) of a dataset's downloads: those whose URL has marker.

    The key is base for a single one, else base with its format, or with its
    place where the format is blank.
    """
    d = distributions.filter(F.contains(url, F.lit(marker)))
    one = Window.partitionBy(id)
    n, place = F.count("*").over(one), F.row_number().over(one.orderBy(at, url))
    rows = d.select("*", n.alias("download_n"), place.alias("download_place"))
    key = F.when(F.col("download_n") == 1, F.col(base)).when(F.coalesce(F.col(fmt), F.lit("")) != "", F.concat(F.col(base), F.lit(" ("), F.col(fmt), F.lit(")"))).otherwise(F.concat(F.col(base), F.lit("_"), F.col("download_place").cast("string")))
    return rows.select(id, key.alias("key"), F.replace(url, F.lit("&amp;"), F.lit("&")).alias("url"))


def iso_time(c: Column) -> Column:
    """An ISO 8601 time as a timestamp; one without a zone is in the session's, what is no time is null."""
    return c.try_cast("timestamp")


def with_operations(steps: DataFrame, operations: DataFrame, operation: str = "operation", version: str = "version") -> DataFrame:
    """steps with known and the columns of the operation of the same name and version; operations has one row for each of these."""
    return steps.join(operations.withColumn("known", F.lit(True)), [operation, version], "left").withColumn("known", F.coalesce("known", F.lit(False)))
