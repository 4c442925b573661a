"""Counts, scores, groupings and queues over findings and work units.

Everything here is an aggregation with map-side combine; caps are features of
the reports and queues and use two-round top-n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..functions.labels import truthy
from .ordered import ordered_position, top_n

SCAN = ("scan_id",)


# ---- scan summary (D1, D3) ----------------------------------------------------
def scan_summary(findings: DataFrame, keys=SCAN) -> DataFrame:
    """Totals and risk of a scan; severities count findings that are not dismissed."""
    is_open = labels.is_open(F.col("state"))
    sev = F.col("severity")
    points = F.sum(F.when(is_open, labels.risk_points(sev)).otherwise(F.lit(0.0)))
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~is_open).alias("dismissed"),
        F.count_if(F.col("state") == "needs_info").alias("needs_review"),
        *[F.count_if(is_open & (sev == s)).alias(f"n_{s}") for s in fixed.SEVERITIES],
        labels.risk_score(points).alias("risk_score"))


def category_counts(findings: DataFrame, keys=SCAN, open_only: bool = True) -> DataFrame:
    rows = findings.where(labels.is_open(F.col("state"))) if open_only else findings
    return rows.groupBy(*keys, F.coalesce(truthy(F.col("category")), F.lit("uncategorized"))
                        .alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ---- dashboard (D2, W1, O9) -----------------------------------------------------
def latest_scans(scans: DataFrame, keys=("project_id",)) -> DataFrame:
    """Newest scan per project; equal times go to the highest id."""
    rest = [c for c in scans.columns if c not in keys]
    return scans.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(
        "created_at", "scan_id")).alias("s")).select(*keys, "s.*")


def dashboard(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: counts over all states of its latest scan."""
    latest = latest_scans(scans).select("project_id", "scan_id")
    sev = F.col("severity")
    counts = findings.join(latest, "scan_id").groupBy("project_id", "scan_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(labels.is_open(F.col("state"))).alias("open_findings"),
        F.count_if(F.col("state") == "needs_info").alias("needs_review"),
        *[F.count_if(sev == s).alias(f"n_{s}") for s in fixed.SEVERITIES])
    numbers = [c for c in counts.columns if c not in ("project_id", "scan_id")]
    return latest.join(counts, ["project_id", "scan_id"], "left").select(
        "project_id", "scan_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def top_values(df: DataFrame, keys, value: Column, name: str, n: int) -> DataFrame:
    """Most frequent values per group, ties in value order."""
    counted = df.groupBy(*keys, value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return top_n(counted, keys, [F.desc("n"), F.col(name)], n)


def dashboard_tops(scans: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(top 12 categories, top 10 files) of every project's latest scan."""
    rows = findings.join(latest_scans(scans).select("project_id", "scan_id"), "scan_id")
    cat = F.coalesce(truthy(F.col("category")), F.lit("uncategorized"))
    located = rows.where(truthy(F.col("file_path")).isNotNull())
    return (top_values(rows, ["project_id"], cat, "category", 12),
            top_values(located, ["project_id"], F.col("file_path"), "file_path", 10))


# ---- groupings for the finding list (D15, D16, P15, O12) -------------------------
def visible_findings(findings: DataFrame, show_unverified=False, show_dismissed=False):
    rows = findings
    if not show_unverified:
        rows = rows.where(~F.coalesce("unverified", F.lit(False)))
    return rows if show_dismissed else rows.where(labels.is_open(F.col("state")))


def hidden_counts(findings: DataFrame, keys=SCAN) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count_if(F.coalesce("unverified", F.lit(False))).alias("unverified"),
        F.count_if(~labels.is_open(F.col("state"))).alias("dismissed"))


def issue_groups(findings: DataFrame, keys=SCAN) -> DataFrame:
    """Instances per issue type with top severity, confirmed count and a label."""
    c = F.col
    rank = labels.severity_rank(c("severity"))
    return findings.groupBy(*keys, labels.group_key(c("cwe"), c("category"), c("title"))
                            .alias("group_key")).agg(
        F.count(F.lit(1)).alias("instances"), F.min(rank).alias("top_rank"),
        F.min_by("severity", rank).alias("top_severity"),
        F.count_if(c("state") == "confirmed").alias("confirmed"),
        F.min(labels.group_label(c("cwe"), c("category"), c("title"))).alias("label"))


def sort_groups(groups: DataFrame, keys=SCAN) -> DataFrame:
    return groups.orderBy(*keys, "top_rank", F.desc("instances"), "group_key")


def source_buckets(findings: DataFrame, keys=SCAN) -> DataFrame:
    """Findings per source bucket plus an ``all`` row per group (grouping sets)."""
    rows = findings.withColumn("bucket", labels.source_bucket(F.col("source")))
    full = [F.col(k) for k in keys]
    return rows.groupingSets([[*full, F.col("bucket")], full], *full, F.col("bucket")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def ranked(rows: DataFrame, keys, order, cap: int | None, name: str) -> DataFrame:
    """Rows with their place (from 1) in the group: all, or the first *cap*."""
    if cap is not None:
        return top_n(rows, keys, order, cap, name)
    return ordered_position(rows, list(keys), order, name).withColumn(
        name, (F.col(name) + 1).cast("int"))


# ---- report (S22 tables, D19, O1, O2, O7, H21) ------------------------------------
def report_counters(findings: DataFrame, keys=SCAN) -> DataFrame:
    st = F.col("state")
    live = F.col("live_verdict") if "live_verdict" in findings.columns \
        else F.lit(None).cast("string")
    return findings.groupBy(*keys).agg(
        F.count_if(labels.is_open(st)).alias("open"),
        F.count_if(st == "confirmed").alias("confirmed"),
        F.count_if(st == "needs_info").alias("needs_review"),
        F.count_if(~labels.is_open(st)).alias("dismissed"),
        F.count_if(F.coalesce(live == "confirmed_vuln", F.lit(False))).alias("live_confirmed"))


def report_findings(findings: DataFrame, keys=SCAN, cap: int | None = None):
    """Open findings of the report: severity first, confirmed before others."""
    return ranked(findings.where(labels.is_open(F.col("state"))), keys, [
        labels.severity_rank(F.col("severity")),
        (F.col("state") != "confirmed").cast("int"), F.col("finding_id")], cap, "position")


def report_dismissed(findings: DataFrame, keys=SCAN, cap: int | None = None):
    return ranked(findings.where(~labels.is_open(F.col("state"))), keys,
                 [F.col("finding_id")], cap, "position")


def report_matrix(endpoints: DataFrame, keys=("artifact_id",), cap: int | None = None):
    from ..functions.routes import effective_risk
    c = F.col
    risk = effective_risk(c("risk"), c("heuristic_risk"))
    rows = endpoints.where(F.coalesce(truthy(c("authn")), truthy(c("auth_scope"))).isNotNull())
    return ranked(rows.select(
        *keys, "endpoint_id", "method", "path",
        F.coalesce(truthy(c("authn")), c("auth_scope")).alias("authn"),
        F.coalesce(truthy(c("authz")), F.lit("-")).alias("authz"), risk.alias("risk")),
        keys, [labels.risk_rank(c("risk"), 3), c("path"), c("method"), c("endpoint_id")],
        cap, "position")


def sort_by_severity(findings: DataFrame, *more) -> DataFrame:
    return findings.orderBy(labels.severity_rank(F.col("severity"), 99), *more)


# ---- capped queues (O3-O6) ---------------------------------------------------------
def capped_queue(rows: DataFrame, keys, order, cap: int | None, ids) -> DataFrame:
    """All rows, those within the cap of their group with a queue position.

    Only ids and ordering columns go through the ranking; the overflow keeps a
    NULL position, nothing is dropped.
    """
    chosen = ranked(rows.select(*keys, *ids, *[o.alias(f"_o{i}") for i, (o, _) in
                                              enumerate(order)]),
                   keys, [F.desc(f"_o{i}") if d else F.asc(f"_o{i}")
                          for i, (_, d) in enumerate(order)], cap, "position")
    places = chosen.groupBy(*keys, *ids).agg(F.min("position").alias("position"))
    return rows.join(places, [*keys, *ids], "left")


def verification_queue(findings: DataFrame, keys=SCAN, floor: str = "medium",
                       cap: int | None = None) -> DataFrame:
    """Open findings at or above a severity, most severe and confident first;
    beyond a *cap*, if given, they are marked skipped."""
    c = F.col
    rows = findings.where(labels.is_open(F.coalesce("state", F.lit("")))
                          & labels.severity_at_least(c("severity"), floor))
    out = capped_queue(rows, keys, [(labels.severity_weight(c("severity")), True),
                                    (F.coalesce("confidence", F.lit(0.0)), True),
                                    (c("finding_id"), False)], cap, ["finding_id"])
    return out.withColumn("verification", F.when(c("position").isNull(), "skipped")
                          .otherwise("queued"))


def triage_queue(hits: DataFrame, keys=SCAN, cap: int | None = None) -> DataFrame:
    return capped_queue(hits, keys, [(labels.severity_weight(F.col("severity")), True),
                                     (F.col("finding_id"), False)], cap, ["finding_id"])


def second_look_queue(files: DataFrame, keys=("artifact_id",),
                      cap: int | None = None) -> DataFrame:
    """Sink-bearing files: those no reviewer read first, then by score."""
    return capped_queue(files, keys, [(F.col("unreviewed").cast("int"), True),
                                      (F.col("score"), True), (F.col("path"), False)],
                        cap, ["path"])


# ---- work units and review health (D4, D23, D24, J26, U4, U6) -------------------------
def completed_units(units: DataFrame, keys=SCAN) -> DataFrame:
    """Finished units per phase; a scan resumes when any phase but inputs has some."""
    n = units.groupBy(*keys, "phase").agg(F.count(F.lit(1)).alias("completed"))
    work = units.where(F.col("phase") != "inputs").select(*keys).distinct() \
        .withColumn("resumable", F.lit(True))
    return n.join(work, list(keys), "left").withColumn(
        "resumable", F.coalesce("resumable", F.lit(False)))


def remaining_units(planned: DataFrame, done: DataFrame,
                    keys=("scan_id", "phase", "chunk_key")) -> DataFrame:
    return planned.join(done.select(*keys), list(keys), "left_anti")


def review_health(units: DataFrame, keys=SCAN, early: int = 8) -> DataFrame:
    """Failures and whether the first *early* finished units all failed."""
    first = top_n(units, keys, [F.col("finished_at"), F.col("chunk_key")], early).groupBy(
        *keys).agg((F.bool_and("failed") & (F.count(F.lit(1)) >= early)).alias("stop_early"))
    total = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"),
                                     F.count_if("failed").alias("failed_units"))
    return total.join(first, list(keys))


def unreviewed_files(failures: DataFrame, reviewers: int, keys=("artifact_id",)) -> DataFrame:
    """Files every reviewer failed on."""
    return failures.groupBy(*keys, "path").agg(
        F.count_distinct("reviewer").alias("reviewers_failed")) \
        .where(F.col("reviewers_failed") == reviewers)


def merge_counters(*frames: DataFrame, by, value: str = "n") -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(*by).agg(F.sum(value).alias(value))


# ---- token usage (D11) ------------------------------------------------------------------
def token_usage(calls: DataFrame, keys=SCAN) -> DataFrame:
    """Prompt, completion, total tokens and calls per model, with a total row."""
    rows = calls.select(*keys, F.coalesce(truthy(F.col("model")), F.lit("unknown"))
                        .alias("model"),
                        F.coalesce("prompt_tokens", F.lit(0)).alias("p"),
                        F.coalesce("completion_tokens", F.lit(0)).alias("q"))
    full = [F.col(k) for k in keys]
    return rows.groupingSets([[*full, F.col("model")], full], *full, F.col("model")).agg(
        F.sum("p").alias("prompt_tokens"), F.sum("q").alias("completion_tokens"),
        F.sum(F.col("p") + F.col("q")).alias("total_tokens"),
        F.count(F.lit(1)).alias("calls")).withColumn(
        "model", F.coalesce("model", F.lit("(total)")))


# ---- coverage report (D17) -----------------------------------------------------------------
COVERAGE = ("files_total", "files_loaded", "files_unreviewed", "static_candidates",
            "candidates_addressed", "candidates_triaged", "candidates_over_cap",
            "candidates_missing", "second_look_files", "second_look_findings",
            "true_positive", "false_positive", "uncertain", "verify_over_cap",
            "not_verified", "endpoints_total", "endpoints_assessed")


def coverage_report(counters: DataFrame, keys=SCAN, coverage_on=True, access_on=True):
    """Progress ratios and the list of gaps from one row of counters per scan."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in COVERAGE}
    verdicts = n["candidates_addressed"] + n["candidates_triaged"]
    unread = n["files_total"] - n["files_loaded"]
    gap = lambda v, s: F.when(v > 0, F.concat(v.cast("string"), F.lit(s)))
    gaps = [gap(n["files_unreviewed"], " file(s) no reviewer could read"),
            gap(unread, " file(s) unreadable"),
            gap(n["candidates_over_cap"], " scanner hit(s) over the triage cap"),
            gap(n["candidates_missing"], " scanner hit(s) without a verdict"),
            gap(n["verify_over_cap"], " finding(s) over the verification cap"),
            gap(n["not_verified"], " finding(s) without a verifier verdict")]
    if not coverage_on:
        gaps.append(gap(n["static_candidates"] - verdicts, " scanner hit(s) not addressed"))
    if access_on:
        gaps.append(gap(n["endpoints_total"] - n["endpoints_assessed"],
                        " endpoint(s) not assessed"))
    ratio = lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    return counters.select(
        *keys, ratio(n["files_loaded"] - n["files_unreviewed"], n["files_total"])
        .alias("files_reviewed"),
        ratio(verdicts, n["static_candidates"]).alias("hits_with_verdict"),
        F.format_string("%d (%d new)", n["second_look_files"].cast("bigint"),
                        n["second_look_findings"].cast("bigint")).alias("second_look"),
        F.format_string("%d confirmed, %d rejected, %d to a human",
                        *[n[k].cast("bigint") for k in
                          ("true_positive", "false_positive", "uncertain")])
        .alias("verification"),
        ratio(n["endpoints_assessed"], n["endpoints_total"]).alias("endpoints_assessed"),
        F.array_compact(F.array(*gaps)).alias("gaps"))


# ---- recent history (O10) --------------------------------------------------------------------
def recent(messages: DataFrame, keys, order: Column, n: int = 10) -> DataFrame:
    """The last *n* rows of every group, numbered oldest first."""
    picked = top_n(messages, keys, [order.desc()], n, "_back")
    size = F.count(F.lit(1)).over(_bounded(keys))
    return picked.withColumn("position", (size - F.col("_back") + 1).cast("int")).drop("_back")


def _bounded(keys):
    from pyspark.sql import Window
    return Window.partitionBy(*keys)  # at most n rows per group remain here
