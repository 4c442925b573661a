"""Finding normalisation, dedupe, verdicts, triage and deterministic policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..functions.labels import truthy
from ..functions.text import safe_int, strip, truncate

SCAN = ("scan_id",)


def _replace(df: DataFrame, extra=(), **updates) -> DataFrame:
    """One projection with some columns recomputed and new ones appended."""
    new = [v.alias(k) for k, v in updates.items() if k not in df.columns]
    return df.select(*[updates.get(c, F.col(c)).alias(c) for c in df.columns], *new, *extra)


# ---- candidates (W3, U1, H25, M14) ------------------------------------------
def union_candidates(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_candidates(candidates: DataFrame, keys=SCAN, order: str = "ord") -> DataFrame:
    """One candidate per (file, line, CWE or rule or title): the first with a
    snippet, else the first. A min over structs, so map-side combined."""
    kind = F.substring(F.coalesce(truthy(F.col("cwe")), truthy(F.col("rule")),
                                  F.col("title"), F.lit("")), 1, 60)
    rest = [c for c in candidates.columns if c not in keys]
    rank = F.struct(truthy(F.col("code_snippet")).isNull(), F.col(order))
    best = candidates.groupBy(*keys, F.col("file_path").alias("_f"),
                              F.col("line_start").alias("_l"), kind.alias("_k")).agg(
        F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, "_r.*").select(*candidates.columns)


def candidate_findings(candidates: DataFrame) -> DataFrame:
    c = F.col
    keep = [k for k in candidates.columns if k not in
            ("source", "rule", "title", "message", "severity")]
    return candidates.select(
        *keep, F.coalesce(truthy(c("title")), truthy(c("rule")),
                          F.lit("Static-analysis finding")).alias("title"),
        F.coalesce("message", F.lit("")).alias("description"),
        F.coalesce(truthy(c("severity")), F.lit("medium")).alias("severity"),
        F.lit(0.5).alias("confidence"),
        F.when(c("source").isin("semgrep", "sonarqube", "access"), c("source"))
        .otherwise("semgrep").alias("source"), F.lit("proposed").alias("state"), "rule")


def stored_candidates(findings: DataFrame, repaired: str | None = None) -> DataFrame:
    """Scanner candidates rebuilt from stored findings, with repairs."""
    c = F.col
    path = F.coalesce(c(repaired), c("file_path")) if repaired else c("file_path")
    snippet = F.when(strip(c("code_snippet")) == "requires login", None).otherwise(
        c("code_snippet"))
    rows = findings.where(c("source").isin("semgrep", "sonarqube"))
    return _replace(rows, file_path=path, code_snippet=snippet,
                    rule=F.coalesce("rule", F.lit("")))


# ---- normalisation (H22-H25) --------------------------------------------------
def normalize_findings(findings: DataFrame, judged_by: str | None = None,
                       require_evidence: bool = True) -> DataFrame:
    """Valid enums, clamped confidence, bounded title; a finding without a file is
    never confirmed. Rows without a title are no findings."""
    c = F.col
    state = F.lower(F.coalesce("state", F.lit("proposed")))
    conf = labels.clamp01(c("confidence"))
    unsupported = F.lit(require_evidence) & truthy(c("file_path")).isNull() \
        & (state == "confirmed")
    judge = F.lit(f"judge:{judged_by}" if judged_by else None).cast("string")
    return _replace(
        findings.where(truthy(c("title").cast("string")).isNotNull()),
        title=truncate(c("title"), 300),
        description=F.coalesce(c("description").cast("string"), F.lit("")),
        severity=labels.choose(F.coalesce("severity", F.lit("medium")),
                               fixed.SEVERITIES, "medium"),
        confidence=F.when(unsupported, F.least(conf, F.lit(0.4))).otherwise(conf),
        source=labels.choose(F.coalesce("source", F.lit("ai")), fixed.SOURCES, "ai"),
        state=F.when(unsupported, "proposed").otherwise(
            F.when(state.isin(*fixed.STATES), state).otherwise("proposed")),
        line_start=safe_int(c("line_start")), line_end=safe_int(c("line_end")),
        triaged_by=F.coalesce(truthy(c("triaged_by")), judge))


def storable_findings(findings: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """What a findings table takes: a title for every row, numbers as line numbers, and whole
    texts unless *widths* (column -> characters) says how wide a column is."""
    c = F.col
    text_of = {"title": F.coalesce(truthy(c("title").cast("string")), F.lit("Untitled finding"))}
    for name, width in (widths or {}).items():
        text_of[name] = truncate(text_of.get(name, c(name)), width)
    return _replace(findings, **text_of, line_start=safe_int(c("line_start")), line_end=safe_int(c("line_end")))


# ---- verification (M2, P20) ----------------------------------------------------
def verdict_name(raw):
    v = F.translate(F.lower(F.coalesce(raw, F.lit(""))), "- ", "__")
    return F.when(v.isin("true_positive", "false_positive", "uncertain"), v) \
        .otherwise("uncertain")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, keys=("finding_id",)):
    """Verifier verdicts (one per finding) applied to state, confidence, severity."""
    c = F.col
    v = verdicts.select(*keys, F.struct(
        verdict_name(c("verdict")).alias("verdict"),
        labels.clamp01(c("confidence"), None).alias("confidence"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.lower("severity").alias("severity"),
        c("human_question").alias("question")).alias("_v"))
    rows = findings.join(v, list(keys), "left")
    name, conf = c("_v.verdict"), c("_v.confidence")
    old = F.coalesce(F.nullif(c("confidence").cast("double"), F.lit(0.0)), F.lit(1.0))
    sev = c("_v.severity")
    changed = F.coalesce(sev.isin(*fixed.SEVERITIES)
                         & (sev != F.coalesce(F.lower("severity"), F.lit(""))), F.lit(False))
    return _replace(
        rows.select(*[c(x) for x in findings.columns], "_v"),
        state=F.when(name == "false_positive", "dismissed").when(
            name == "true_positive", "confirmed").when(
            name == "uncertain", "needs_info").otherwise(c("state")),
        confidence=F.when(name == "false_positive", F.least(
            F.coalesce(conf, F.lit(0.2)), old)).when(
            name == "true_positive", F.coalesce(conf, c("confidence"))).when(
            name == "uncertain", F.least(F.coalesce(conf, F.lit(0.5)), old)).otherwise(
            c("confidence")),
        triage_note=F.when(name == "false_positive", F.concat(
            F.lit("Verifier: "), c("_v.reasoning"))).otherwise(c("triage_note")),
        human_question=F.when(name == "uncertain", F.coalesce(
            truthy(c("_v.question")), truthy(c("human_question")), c("_v.reasoning")))
        .otherwise(c("human_question")),
        severity_original=F.when(changed, c("severity")),
        severity=F.when(changed, sev).otherwise(c("severity")),
        verification=F.coalesce(name, F.lit("not_verified"))).drop("_v")


def apply_live_verdicts(findings: DataFrame, verdicts: DataFrame, keys=("finding_id",)):
    """Live-check outcomes: confirmed at 0.9 or more, enforced dismissed (M5)."""
    c = F.col
    rows = findings.join(verdicts.select(*keys, c("verdict").alias("_v"),
                                         c("reason").alias("_why")), list(keys), "left")
    conf = F.coalesce(F.nullif(c("confidence"), F.lit(0.0)), F.lit(0.5))
    hit, held = c("_v") == "confirmed_vuln", c("_v") == "enforced"
    return _replace(
        rows.select(*[c(x) for x in findings.columns], "_v", "_why"),
        state=F.when(hit, "confirmed").when(held, "dismissed").otherwise(c("state")),
        confidence=F.when(hit, F.greatest(conf, F.lit(0.9))).when(
            held, F.least(conf, F.lit(0.2))).otherwise(c("confidence")),
        triage_note=F.when(held, F.concat(
            F.lit("Live check: access control is enforced here: "),
            F.coalesce("_why", F.lit("")))).otherwise(c("triage_note")),
        live_verdict=c("_v")).drop("_v", "_why")


# ---- human triage (M7) and scan status (M15) -------------------------------------
def apply_triage(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Last decision per finding wins: state, note, by whom and when. Decisions of one
    moment and number are settled by their values, so that reruns agree."""
    last = decisions.groupBy("finding_id").agg(F.max_by(
        F.struct("state", "triage_note", "triaged_by", "triaged_at"),
        F.struct("triaged_at", "seq", "state", "triage_note", "triaged_by")).alias("_d"))
    rows = findings.join(last, "finding_id", "left")
    got = F.col("_d").isNotNull()
    pick = lambda n: F.when(got, F.col(f"_d.{n}")).otherwise(
        F.col(n) if n in findings.columns else F.lit(None))
    return _replace(rows.select(*[F.col(x) for x in findings.columns], "_d"),
                    **{n: pick(n) for n in ("state", "triage_note", "triaged_by",
                                            "triaged_at")}).drop("_d")


def scan_status(findings: DataFrame, keys=SCAN) -> DataFrame:
    return findings.groupBy(*keys).agg(F.when(
        F.bool_or(F.col("state") == "needs_info"), "needs_review")
        .otherwise("completed").alias("status"))


# ---- deterministic policies (M9-M12, D20, X5) --------------------------------------
def merge_duplicates(findings: DataFrame, keys=SCAN, order: str = "ord") -> DataFrame:
    """First finding per (title, file) with how many were merged into it."""
    rest = [c for c in findings.columns if c not in (*keys, "title", "file_path")]
    return findings.groupBy(*keys, "title", "file_path").agg(
        F.min_by(F.struct(*rest), order).alias("_r"),
        F.count(F.lit(1)).alias("merged_count")) \
        .select(*keys, "title", "file_path", "_r.*", "merged_count")


def judge_policy(findings: DataFrame, keys=SCAN, order: str = "ord") -> DataFrame:
    """Merge duplicates, confirm what cites a file, dismiss what does not (M9)."""
    c = F.col
    located = truthy(c("file_path")).isNotNull()
    waiting = c("state") == "needs_info"
    conf = F.coalesce("confidence", F.lit(0.5))
    return _replace(
        merge_duplicates(findings, keys, order),
        state=F.when(waiting, c("state")).when(located, "confirmed").otherwise("dismissed"),
        confidence=F.when(~waiting & located, F.greatest(conf, F.lit(0.75)))
        .otherwise(c("confidence")),
        triaged_by=F.lit("judge:policy"))


def triage_policy(hits: DataFrame) -> DataFrame:
    """High and critical hits stay proposed, the rest is dismissed."""
    c = F.col
    real = F.coalesce("severity", F.lit("medium")).isin("critical", "high")
    return _replace(
        hits, title=F.coalesce(truthy(c("title")), truthy(c("rule")),
                               F.lit("Static-analysis result")),
        severity=F.coalesce("severity", F.lit("medium")),
        category=F.coalesce(truthy(c("category")), F.lit("static-analysis")),
        source=F.lit("correlated"), confidence=F.when(real, 0.6).otherwise(0.3),
        state=F.when(real, "proposed").otherwise("dismissed"))


def endpoint_policy(mapped: DataFrame, keys=("artifact_id",)) -> DataFrame:
    """Endpoint verdicts from the map alone."""
    c = F.col
    authed = c("auth_scope").isin("route", "file", "global")
    return mapped.select(
        *keys, "endpoint_id",
        F.when(authed, "required").when(c("likely_public"), "public").otherwise("none")
        .alias("authn"),
        F.when(F.size("ownership_hints") > 0, "ownership").when(
            F.size("role_hints") > 0, "role").otherwise("unclear").alias("authz"),
        F.when(~authed & c("state_changing") & ~c("likely_public"), "high").otherwise("low")
        .alias("risk"), F.lit("policy verdict").alias("notes"))


def endpoint_policy_findings(mapped: DataFrame, keys=("artifact_id",)) -> DataFrame:
    """The two kinds of finding the endpoint policy reports."""
    c = F.col
    authed = c("auth_scope").isin("route", "file", "global")
    label = F.concat_ws(" ", "method", "path")
    open_write = ~authed & c("state_changing")
    unowned = (F.size("path_params") > 0) & (F.size("ownership_hints") == 0)
    rows = mapped.where(~c("likely_public") & (open_write | unowned))
    either = lambda a, b: F.when(open_write, F.lit(a)).otherwise(F.lit(b))
    return rows.select(
        *keys, "endpoint_id", label.alias("endpoint"),
        F.concat(either("Missing authentication on ", "Possible IDOR on "), label)
        .alias("title"), either("high", "medium").alias("severity"),
        either(0.55, 0.4).alias("confidence"), either("CWE-306", "CWE-639").alias("cwe"),
        either("proposed", "needs_info").alias("state"), F.lit("access").alias("source"),
        F.lit("access-control").alias("category"), "file_path",
        c("line").alias("line_start"))


def verification_policy(findings: DataFrame) -> DataFrame:
    """Verdict rows: no located code → false positive, open question → uncertain."""
    c = F.col
    lost = truthy(c("file_path")).isNull() | F.coalesce(
        c("evidence_status").isin("file_missing", "line_out_of_range"), F.lit(False))
    waiting = c("state") == "needs_info"
    conf = F.coalesce(F.nullif(c("confidence"), F.lit(0.0)), F.lit(0.5))
    return findings.select(
        "finding_id",
        F.when(lost, "false_positive").when(waiting, "uncertain").otherwise("true_positive")
        .alias("verdict"),
        F.when(lost, 0.2).when(waiting, 0.4).otherwise(F.greatest(conf, F.lit(0.8)))
        .cast("string").alias("confidence"),
        F.when(lost, "cited code not located").when(waiting, "depends on business rules")
        .otherwise("no guard between source and sink").alias("reasoning"),
        F.lit(None).cast("string").alias("severity"),
        F.when(waiting, F.coalesce(truthy(c("human_question")), F.lit(
            "Confirm the intended authorisation rule."))).alias("human_question"))


# ---- payloads (P23) ---------------------------------------------------------------------
SLIM = ("title", "description", "severity", "confidence", "cwe", "owasp", "category",
        "file_path", "line_start", "line_end", "code_snippet", "remediation", "source",
        "state", "human_question", "reviewed_by", "triage_note", "where_to_look",
        "attack_scenario", "proof_of_concept", "risk", "recommendation", "evidence",
        "reviewer_agreement", "endpoint")
FLAG_PAYLOAD = ("flag_id", "endpoint_id", "endpoint", "rule", "title", "severity", "id_kind")


def payloads(rows: DataFrame, ids, columns=SLIM) -> DataFrame:
    """JSON objects of the wanted columns that are present, NULLs left out."""
    have = [c for c in columns if c in rows.columns]
    return rows.select(*ids, F.to_json(F.struct(*have)).alias("payload"))
