"""Event ledgers: sequences, transitions, folds, idempotency, leases, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.operators.ordered import neighbour, numbered

#: The states a run may go to from each state.
TRANSITIONS = {
    "draft": ("validating", "cancelled"),
    "validating": ("blocked", "awaiting_approval", "cancelled"),
    "blocked": (),
    "awaiting_approval": ("approved", "blocked", "cancelled"),
    "approved": ("queued", "awaiting_approval", "cancelled"),
    "queued": ("running", "cancelled"),
    "running": ("succeeded", "partially_succeeded", "failed", "outcome_unknown", "awaiting_user", "cancelled"),
    "outcome_unknown": ("succeeded", "partially_succeeded", "failed", "awaiting_user"),
    "succeeded": (),
    "partially_succeeded": (),
    "failed": (),
    "awaiting_user": (),
    "cancelled": (),
}


def sequence(events: DataFrame, run: str, *order: str) -> DataFrame:
    """events with sequence: gap-free numbers from 1 within each run, of any length."""
    return numbered(events, run, *order)


def illegal_transitions(events: DataFrame, run: str, status: str, *order: str, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Steps of a run whose status may not follow the one before: events with previous appended."""
    table = TRANSITIONS if allowed is None else allowed
    known = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    stepped = neighbour(events, run, F.col(status), "previous", *order)
    legal = F.array_contains(F.try_element_at(known, F.col("previous")), F.col(status))
    return stepped.filter(F.col("previous").isNotNull() & ~F.coalesce(legal, F.lit(False)))


def final_status(steps: DataFrame, run: str, status: str) -> DataFrame:
    """(run, final): unknown, then awaiting, then failed or partial, then succeeded."""
    any_ = lambda *v: F.bool_or(F.col(status).isin(*v))
    final = (
        F.when(any_("outcome_unknown"), "outcome_unknown")
        .when(any_("awaiting_user"), "awaiting_user")
        .when(any_("failed", "blocked"), F.when(any_("succeeded"), "partially_succeeded").otherwise("failed"))
        .when(F.every(F.col(status) == "succeeded"), "succeeded")
        .otherwise("failed")
    )
    return steps.groupBy(run).agg(final.alias("final_status"))


def idempotency(requests: DataFrame, key: str, hash_: str, order: str) -> DataFrame:
    """(key, requests, first, conflict): the request each key stands for, and whether another hash came with it."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.min(F.struct(order, hash_)).getField(order).alias("first_request"), (F.min(hash_) != F.max(hash_)).alias("conflict"))


def expired_leases(runs: DataFrame, lease_until: str, now: Column) -> DataFrame:
    return runs.filter((F.col("status") == "running") & (F.col(lease_until) < now))


def next_work(runs: DataFrame, created: str, lease_until: str, now: Column, k: int = 1, id: str = "run_id") -> DataFrame:
    """The k runs to take next: running ones whose lease ran out, then queued ones, oldest first, ties by id."""
    expired = (F.col("status") == "running") & (F.col(lease_until) < now)
    return runs.filter(expired | (F.col("status") == "queued")).orderBy(F.when(expired, 0).otherwise(1), created, id).limit(k)


def tail(events: DataFrame, run: str, n: int, *order: str) -> DataFrame:
    """The last n events of each run."""
    back = Window.partitionBy(run).orderBy(*(F.desc(o) for o in order))
    return events.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n).drop("back")


def replay(events: DataFrame, run: str, after: int, *order: str) -> DataFrame:
    return sequence(events, run, *order).filter(F.col("sequence") > after)


def approval_state(runs: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """(run_id, state) of each run's latest approval: missing, consumed, hash_mismatch, expired or valid."""
    last = approvals.groupBy("run_id").agg(F.max(F.struct("approved_at", "plan_hash", "expires_at", "consumed")).alias("a"))
    j = runs.join(last, "run_id", "left")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("a.consumed"), "consumed").when(F.col("a.plan_hash") != F.col("hash"), "hash_mismatch").when(F.col("a.expires_at") < now, "expired").otherwise("valid")
    return j.select("run_id", state.alias("state"))


def last_per_step(events: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """The fold of a step's events to its last status; a step that only started is outcome_unknown."""
    last = events.groupBy(*keys).agg(F.max(F.struct(order, status)).getField(status).alias("last"))
    return last.withColumn("last", F.when(F.col("last") == "started", "outcome_unknown").otherwise(F.col("last")))


def outcome_counts(events: DataFrame, action: str) -> DataFrame:
    return events.groupBy(action).agg(F.count("*").alias("n"))


def crawl_summary(events: DataFrame, ok: Column, seconds: str) -> DataFrame:
    """One row: total, success, failed, the rate as text and the mean time."""
    good = F.sum(ok.cast("bigint"))
    return events.agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("failed"), F.format_string("%.1f%%", F.when(F.count("*") > 0, 100.0 * good / F.count("*")).otherwise(0.0)).alias("rate"), F.round(F.avg(seconds), 4).alias("avg_time"))


def scan_summary(results: DataFrame, found: Column, failed: Column, retried: Column, waiting: Column) -> DataFrame:
    """One row: what a scan looked at and found, what failed, how many were tried again and found then, and both rates as text.

    The columns are conditions of a result; a result that was retried and found
    is a retry's success.  Rates of nothing are 0.00%.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rate = lambda a, b: F.format_string("%.2f%%", F.when(b > 0, 100.0 * a / b).otherwise(0.0))
    counted = results.agg(F.count("*").alias("total_scanned"), n(found).alias("data_found"), n(~found & ~failed).alias("data_not_found"), n(failed).alias("failed"), n(retried).alias("retried"), n(retried & found).alias("retry_success"), n(waiting).alias("waiting_room_detected"))
    return counted.select("*", rate(F.col("retry_success"), F.col("retried")).alias("retry_success_rate"), rate(F.col("data_found"), F.col("total_scanned")).alias("success_rate"))


def recent_manifests(manifests: DataFrame, started: str, files: str, k: int = 10) -> DataFrame:
    """The k manifests that started last, newest first, with how many files each has; ties by all columns' text."""
    n = manifests.withColumn("n_files", F.size(files))
    return n.orderBy(F.desc(started), F.to_json(F.struct(*manifests.columns))).limit(k)


def missing_inputs(required: Column, inputs: Column) -> Column:
    """Required names that the inputs don't have."""
    return F.array_sort(F.array_except(required, F.map_keys(inputs)))


def change_gate(page: Column, stored: Column, targets_exist: Column, forced: Column) -> Column:
    """Whether to load anew: forced, a target missing, nothing stored, or the page newer than what is stored."""
    return forced | ~targets_exist | stored.isNull() | (page > stored)


def canonical_hash(m: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys, content_hash left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: k != "content_hash")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ",")
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)
