"""Operator control of live runs: patches, gate decisions, held requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels, paths

RUN = ("run_id",)


def control_state(patches: DataFrame, keys=RUN) -> DataFrame:
    """Current control document per run; patches can only tighten.

    The rate is the last positive one, never above the run's ceiling; mutating
    traffic once turned off stays off; excluded paths add up. patches: keys, seq,
    status, intercept, allow_mutating, max_rps, exclude_paths, ceiling.
    """
    c = F.col
    last = lambda v, ok: F.max_by(v, F.when(ok, c("seq")))
    rate = F.least(c("max_rps"), F.coalesce("ceiling", "max_rps"))
    return patches.groupBy(*keys).agg(
        F.coalesce(last(c("status"), c("status").isin("running", "paused", "canceled")),
                   F.lit("running")).alias("status"),
        F.coalesce(last(c("intercept"), c("intercept").isin("off", "mutating", "all")),
                   F.lit("off")).alias("intercept"),
        F.bool_and(F.coalesce("allow_mutating", F.lit(True))).alias("allow_mutating"),
        last(rate, c("max_rps") > 0).alias("max_rps"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.coalesce(
            "exclude_paths", F.array().cast("array<string>")))), lambda p: p != "")))
        .alias("exclude_paths"))


def gate_decisions(requests: DataFrame, control: DataFrame, keys=RUN) -> DataFrame:
    """What the gate does with each logged request: send, skip or hold.

    Internal purposes are exempt; excluded paths and forbidden mutating requests
    are skipped; intercepted ones are held. Works for a batch log and for a stream
    joined with a static control table.
    """
    c = F.col
    rows = requests.join(control.select(
        *keys, c("intercept").alias("_mode"), c("allow_mutating").alias("_mut"),
        c("exclude_paths").alias("_exc")), list(keys), "left")
    mutating = ~labels.is_safe_method(c("method"))
    path = paths.url_path(c("url"))
    excluded = F.exists(F.coalesce("_exc", F.array().cast("array<string>")),
                        lambda p: path.startswith(p))
    mode = F.coalesce("_mode", F.lit("off"))
    decision = (F.when(c("purpose").isin(*fixed.INTERNAL_PURPOSES), "send")
                .when(excluded, "skip").when(mutating & ~F.coalesce("_mut", F.lit(True)), "skip")
                .when((mode == "all") | ((mode == "mutating") & mutating), "hold")
                .otherwise("send"))
    return rows.withColumn("decision", decision).drop("_mode", "_mut", "_exc")


def held_outcomes(held: DataFrame, decisions: DataFrame, keys=RUN,
                  timeout: int = fixed.INTERCEPT_TIMEOUT_SECONDS, delay: str = "1 minute"):
    """Held requests with their decision in time, else skip.

    held: keys, seq, held_at; decisions: keys, seq, decided_at, verdict. On streams
    this is a left outer interval join with watermarks on both sides; on tables
    the same join runs as a batch.
    """
    c = F.col
    h, d = held, decisions.select(*[c(k).alias(f"_{k}") for k in keys],
                                  c("seq").alias("_seq"), "decided_at", "verdict")
    if held.isStreaming:
        h, d = h.withWatermark("held_at", delay), d.withWatermark("decided_at", delay)
    on = (c("seq") == c("_seq")) & (c("decided_at") >= c("held_at")) & (
        c("decided_at") <= c("held_at") + F.expr(f"interval {timeout} seconds"))
    for k in keys:
        on = on & (c(k) == c(f"_{k}"))
    answered = c("verdict").isin("allow", "allow_rest")
    return h.join(d, on, "leftOuter").select(
        *held.columns, "decided_at", F.when(answered, "send").otherwise("skip")
        .alias("outcome"), c("verdict").isNull().alias("timed_out"))


def pending_requests(held: DataFrame, decisions: DataFrame, keys=RUN) -> DataFrame:
    """Held requests without a decision."""
    return held.join(decisions.select(*keys, "seq"), [*keys, "seq"], "left_anti")
