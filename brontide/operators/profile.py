"""Column profiles: inference, quality, outliers, addresses, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.functions import scalars
from brontide.sources.stored import discard, written


def cells(df: DataFrame, columns: list[str], row: Column | None = None) -> DataFrame:
    """(row, column, value): one row per cell, as strings; row orders the table."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.inline(pairs))


def infer_columns(long: DataFrame, samples: int = 5) -> DataFrame:
    """(column, inferred_type, null_ratio, sample_values) from cells."""
    v = F.trim(F.coalesce("value", F.lit("")))
    missing = scalars.is_missing(v)
    base = long.select("column", "row", v.alias("v"), missing.alias("missing"))
    types = base.groupBy("column").agg(F.collect_set(F.when(~F.col("missing"), scalars.infer_scalar(F.col("v")))).alias("types"), F.count("*").alias("n"), F.sum(F.col("missing").cast("int")).alias("gone"))
    first = base.filter("not missing").groupBy("column", "v").agg(F.min("row").alias("at"))
    rank = Window.partitionBy("column").orderBy("at", "v")
    taken = first.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= samples).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("sample_values"))
    return types.join(taken, "column", "left").select("column", scalars.merge_types(F.col("types")).alias("inferred_type"), F.round(F.col("gone") / F.col("n"), 4).alias("null_ratio"), F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"))


def column_quality(long: DataFrame) -> DataFrame:
    """(column, observed, non_null, missing, distinct) with exact distinct counts."""
    present = F.when(~scalars.is_missing(F.col("value")), F.trim("value"))
    return long.select("column", present.alias("v")).groupBy("column").agg(F.count("*").alias("observed_count"), F.count("v").alias("non_null_count"), (F.count("*") - F.count("v")).alias("missing_count"), F.countDistinct("v").alias("distinct_count"))


def _placed(numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of numbers (column, x): (column, x, c, before), each distinct value with how often it and all smaller ones occur; and (column, n).

    Values are counted with a partial aggregate, dealt in ranges and written, so
    a column of any size is spread over all tasks; only the ranges' sums are put
    in order in one place.
    """
    counted = written(numbers.groupBy("column", "x").agg(F.count("*").alias("c")))  # dealing in ranges reads it twice
    ranged = written(counted.repartitionByRange("column", "x").withColumn("part", F.spark_partition_id()))
    discard(counted)
    sums = ranged.groupBy("column", "part").agg(F.sum("c").alias("s"))
    ahead = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("column", "part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("column", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, ["column", "part"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return placed.select("column", "x", "c", "before"), sums.groupBy("column").agg(F.sum("s").alias("n"))


def quantiles(numbers: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(column, n, one column per name in shares): exact quantiles of type 7 of the numbers (column, x) of each column."""
    placed, totals = _placed(numbers)
    return _quantiles(placed, totals, shares)


def _quantiles(placed: DataFrame, totals: DataFrame, shares: dict[str, float]) -> DataFrame:
    rows = placed.join(totals, "column")
    picks = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        for end, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("x"))).alias(f"{name}_{end}"))
    ends = rows.groupBy("column", "n").agg(*picks)
    part = lambda share: (F.col("n") - 1) * F.lit(share) - F.floor((F.col("n") - 1) * F.lit(share))
    return ends.select("column", "n", *((F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * part(v)).alias(k) for k, v in shares.items()))


def numeric_profile(long: DataFrame) -> DataFrame:
    """Count, range, mean, median, population deviation and type-7 quartiles of the numbers of each column."""
    n = long.select("column", scalars.number(F.col("value")).alias("x")).filter("x is not null")
    placed, totals = _placed(n)
    q = _quantiles(placed, totals, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    base = placed.groupBy("column").agg(F.sum("c").alias("count"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))
    # The mean is taken off before squares are summed, so nothing cancels.
    spread = placed.join(base.select("column", "mean"), "column").groupBy("column").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("mean"), 2) * F.col("c")) / F.sum("c")).alias("standard_deviation"))
    r = lambda c: F.round(c, 4).alias(c)
    return base.join(q, "column").join(spread, "column").select("column", "count", *map(r, ("minimum", "maximum", "mean", "median", "standard_deviation", "q1", "q3")))


def top_values(long: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column with count and share; ties by first row."""
    v = long.select("column", "row", F.trim("value").alias("value")).filter(~scalars.is_missing(F.col("value")))
    counted = v.groupBy("column", "value").agg(F.count("*").alias("count"), F.min("row").alias("first"))
    total = v.groupBy("column").agg(F.count("*").alias("total"))
    rank = Window.partitionBy("column").orderBy(F.desc("count"), "first", "value")
    best = counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best.join(total, "column").select("column", "rank", "value", "count", F.round(F.col("count") / F.col("total"), 4).alias("ratio"))


def text_lengths(long: DataFrame) -> DataFrame:
    """Shortest, longest and mean length, and the range of the values themselves."""
    v = long.select("column", F.trim("value").alias("v")).filter(~scalars.is_missing(F.col("v")))
    return v.groupBy("column").agg(F.min(F.length("v")).alias("min_length"), F.max(F.length("v")).alias("max_length"), F.round(F.avg(F.length("v")), 4).alias("mean_length"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


def dataset_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, duplicate_rows, missing_cells): duplicates by the normalised cells themselves."""
    norm = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    missing = sum((scalars.is_missing(F.col(c).cast("string")).cast("int") for c in columns), F.lit(0))
    rows = df.select(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(norm))).alias("key"), missing.alias("missing")).groupBy("key").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))
    return rows.agg(F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("duplicate_rows"), F.sum("missing").alias("missing_cells"))


def observed_types(long: DataFrame) -> DataFrame:
    """(column, observed_type, count)."""
    v = long.select("column", F.trim("value").alias("v")).filter(~scalars.is_missing(F.col("v")))
    return v.groupBy("column", scalars.infer_scalar(F.col("v")).alias("observed_type")).agg(F.count("*").alias("count"))


def type_consistency(long: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column, matching, mismatching, ratio) of the cells against the declared types."""
    v = long.select("column", F.trim("value").alias("v")).filter(~scalars.is_missing(F.col("v")))
    fits = F.lit(True)
    for c, kind in expected.items():
        fits = F.when(F.col("column") == c, scalars.matches_type(F.col("v"), kind)).otherwise(fits)
    return v.groupBy("column").agg(F.sum(fits.cast("int")).alias("matching_count"), F.sum((~fits).cast("int")).alias("mismatch_count")).withColumn("ratio", F.round(F.col("matching_count") / (F.col("matching_count") + F.col("mismatch_count")), 4))


def iqr_outliers(long: DataFrame, k: int = 20) -> DataFrame:
    """The k numbers of each column furthest outside the quartile fences, if it has 4 numbers and a spread."""
    n = long.select("column", "row", "value", scalars.number(F.col("value")).alias("x")).filter("x is not null")
    q = quantiles(n.select("column", "x"), {"q1": 0.25, "q3": 0.75}).filter("n >= 4 and q3 > q1")
    fenced = q.select("column", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"))
    out = n.join(fenced, "column").filter("x < lower or x > upper")
    rank = Window.partitionBy("column").orderBy(F.least(F.col("x") - F.col("lower"), F.col("upper") - F.col("x")), "row")
    best = out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best.select("column", "rank", "row", F.round("x", 4).alias("numeric_value"), F.round("lower", 4).alias("lower_fence"), F.round("upper", 4).alias("upper_fence"))


def address_profile(long: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Kind, score and status of each address-like column, from its cells and its name."""
    kind = scalars.address_kind(F.col("value"))
    missing = scalars.is_missing(F.col("value"))
    agg = long.groupBy("column").agg(
        F.count("*").alias("n"),
        F.sum(missing.cast("int")).alias("gone"),
        *(F.sum(F.coalesce((~missing & (kind == k)).cast("int"), F.lit(0))).alias(k) for k in ("road", "jibun", "postal")),
    )
    head = scalars.header_kind(F.col("column"))
    most = F.greatest("road", "jibun", "postal")
    dominant = F.when(most == 0, None).when(F.col("road") == most, "road").when(F.col("jibun") == most, "jibun").otherwise("postal")
    valid = F.when(head.isNull() | (head == "address"), F.col("road") + F.col("jibun") + F.col("postal")).otherwise(F.when(head == "road", F.col("road")).when(head == "jibun", F.col("jibun")).otherwise(F.col("postal")))
    sampled = F.col("n") - F.col("gone")
    ratio = F.when(sampled > 0, valid / sampled)
    evidence = head.isNotNull() | (dominant.isNotNull() & (dominant != "postal"))
    score = F.round(F.least(F.lit(1.0), (F.when(head.isNotNull(), 0.3).otherwise(0.0) + 0.7 * F.coalesce(ratio, F.lit(0.0))) * (1 - 0.5 * F.col("gone") / F.col("n"))), 3)
    status = F.when(ratio >= 0.6, "verified").when((sampled > 0) & (valid == 0) & head.isNotNull(), "invalid").otherwise("unverified")
    return agg.filter(F.coalesce(evidence, F.lit(False))).select("column", F.coalesce(head, dominant, F.lit("address")).alias("kind"), status.alias("status"), score.alias("quality_score"), F.round(ratio, 3).alias("valid_ratio"), valid.alias("valid_samples"))


def coordinate_profile(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """(pairs, valid, ratio, status): row-aligned; invalid beats unverified beats verified."""
    status = scalars.coordinate_status(F.col(lat), F.col(lon))
    worst = F.when(F.bool_or(status == "invalid"), "invalid").when((F.count("*") == 0) | F.bool_or(status == "unverified"), "unverified").otherwise("verified")
    valid = F.sum((status == "verified").cast("int"))
    return df.agg(F.count("*").alias("pairs"), valid.alias("valid"), F.round(valid / F.count("*"), 3).alias("ratio"), worst.alias("status"))


def quality_report(long: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """One row per column: everything above as a struct's JSON text (column, report).

    Numbers have their figures and outliers, other columns their lengths and most
    frequent values; each its missing and distinct values, inferred type and
    agreement with the expected types.
    """
    one = lambda df, name: df.groupBy("column").agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c != "column")))).alias(name))
    parts = [infer_columns(long), column_quality(long), type_consistency(long, expected or {})]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "column", "left")
    for name, df in (("numbers", numeric_profile(long)), ("lengths", text_lengths(long)), ("top_values", top_values(long)), ("outliers", iqr_outliers(long))):
        out = out.join(one(df, name), "column", "left")
    return out.select("column", F.to_json(F.struct(*(c for c in out.columns if c != "column"))).alias("report"))


def report_html(report: DataFrame, order: str = "column") -> DataFrame:
    """(column, html): each column's report as a row of an HTML table: name, type, missing and matching share, and the rest."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    get = lambda path: F.get_json_object("report", path)
    share = lambda c: F.concat(F.format_number(c.cast("double") * 100, 2), F.lit("%"))
    cells = (F.col("column"), get("$.inferred_type"), share(get("$.null_ratio")), share(F.coalesce(get("$.ratio"), F.lit("1"))), F.col("report"))
    return report.select("column", F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in cells), F.lit("</tr>")).alias("html")).orderBy(order)


def geocoding_requests(rows: DataFrame, row: str, id: str, address: str) -> DataFrame:
    """(record_id, address) of the rows that have an address; a row without an id is named by its number."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(address), F.lit("")), r"^\s+|\s+$", ""))
    return rows.filter(plain != "").select(F.coalesce(F.col(id), F.concat(F.lit("row-"), F.col(row).cast("string"))).alias("record_id"), plain.alias("address"))


def type_mismatches(long: DataFrame, expected: dict[str, str], k: int = 20) -> DataFrame:
    """(column, rank, row, value, observed_type): of each column the first k cells, by row, that are not of the declared type."""
    v = long.select("column", "row", F.trim("value").alias("value")).filter(~scalars.is_missing(F.col("value")))
    fits = F.lit(True)
    for c, kind in expected.items():
        fits = F.when(F.col("column") == c, scalars.matches_type(F.col("value"), kind)).otherwise(fits)
    rank = Window.partitionBy("column").orderBy("row", "value")
    first = v.filter(~fits).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return first.select("column", "rank", "row", "value", scalars.infer_scalar(F.col("value")).alias("observed_type"))
