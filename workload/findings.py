"""Queries over findings: differences, roll-ups, matching, verdicts, queues."""

from pyspark.sql import functions as F

from auditspan.functions import fixed, labels, text
from auditspan.operators import diff, matching, rollups, verdicts
from auditspan.operators.lifecycle import replace_sources

from .base import VIEWS, query, spark_sql, table, view

RANK = ("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
        "WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END")
WEIGHT = ("CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 "
          "WHEN 'low' THEN 1.0 WHEN 'info' THEN 0.2 ELSE 0.0 END")
FP = ("concat(CASE WHEN cwe IS NOT NULL THEN concat('cwe:', lower(trim(split_part(cwe, ':', 1)))) "
      "WHEN rule IS NOT NULL THEN concat('rule:', lower(rule)) "
      "WHEN category IS NOT NULL THEN concat('cat:', lower(category)) "
      "ELSE concat('title:', array_to_string(regexp_extract_all(lower(title), '[a-z0-9]{4,}')[1:6], ' ')) END, "
      "'|', coalesce(nullif(file_path, ''), endpoint, ''))")
PAIRS = """
pairs AS (SELECT s.scan_id, b.baseline_id FROM v_scans s JOIN (
  SELECT project_id, created_at, lag(m) OVER (PARTITION BY project_id ORDER BY created_at) AS baseline_id
  FROM (SELECT project_id, created_at, max(scan_id) AS m FROM v_scans GROUP BY 1, 2)) b
  USING (project_id, created_at) WHERE b.baseline_id IS NOT NULL)"""
DIFF = f"""
WITH {PAIRS},
reps AS (SELECT * FROM (SELECT *, {FP} AS fingerprint, row_number() OVER (
  PARTITION BY scan_id, {FP} ORDER BY {RANK}, finding_id) AS rn
  FROM v_findings WHERE state <> 'dismissed') WHERE rn = 1),
cur AS (SELECT r.* FROM reps r JOIN pairs p USING (scan_id)),
base AS (SELECT p.scan_id AS for_scan, r.* FROM reps r JOIN pairs p ON r.scan_id = p.baseline_id),
d AS (SELECT coalesce(c.scan_id, b.for_scan) AS scan_id,
  coalesce(c.fingerprint, b.fingerprint) AS fingerprint,
  CASE WHEN b.finding_id IS NULL THEN 'new' WHEN c.finding_id IS NULL THEN 'fixed' ELSE 'still_open' END AS status,
  coalesce(c.finding_id, b.finding_id) AS finding_id, coalesce(c.severity, b.severity) AS severity,
  CASE WHEN c.severity <> b.severity THEN b.severity END AS severity_changed_from
  FROM cur c FULL OUTER JOIN base b ON c.scan_id = b.for_scan AND c.fingerprint = b.fingerprint)"""


def findings(spark, sf):
    return view(spark, sf, "v_findings")


def scans(spark, sf):
    return view(spark, sf, "v_scans")


# ---- differences -----------------------------------------------------------------
@query("scan_diff", DIFF + " SELECT * FROM d")
def scan_diff(spark, sf):
    pairs = diff.baseline_scans(scans(spark, sf))
    return diff.scan_diff(findings(spark, sf), pairs).select(
        "scan_id", "fingerprint", "status", "finding_id", "severity", "severity_changed_from")


@query("scan_diff_counts", DIFF + """
SELECT p.scan_id, p.baseline_id, count(*) FILTER (status = 'new') AS new,
  count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status = 'still_open') AS still_open
FROM pairs p LEFT JOIN d USING (scan_id) GROUP BY 1, 2""")
def scan_diff_counts(spark, sf):
    pairs = diff.baseline_scans(scans(spark, sf))
    return diff.diff_counts(diff.scan_diff(findings(spark, sf), pairs), pairs)


@query("baseline_scans", f"WITH {PAIRS} SELECT scan_id, baseline_id FROM pairs")
def baseline_scans(spark, sf):
    return diff.baseline_scans(scans(spark, sf))


@query("representatives", f"""
SELECT scan_id, fingerprint, finding_id, severity FROM (SELECT scan_id, {FP} AS fingerprint,
  finding_id, severity, row_number() OVER (PARTITION BY scan_id, {FP} ORDER BY {RANK}, finding_id) AS rn
  FROM v_findings WHERE state <> 'dismissed') WHERE rn = 1""")
def representatives(spark, sf):
    return diff.representatives(findings(spark, sf)).select(
        "scan_id", "fingerprint", "rep.finding_id", "rep.severity")


# ---- roll-ups ----------------------------------------------------------------------
SEV_COUNTS = ", ".join(f"count(*) FILTER (state <> 'dismissed' AND severity = '{s}') AS n_{s}"
                       for s in fixed.SEVERITIES)
ALL_SEV_COUNTS = ", ".join(f"count(finding_id) FILTER (severity = '{s}') AS n_{s}"
                           for s in fixed.SEVERITIES)


@query("scan_summary", f"""
SELECT scan_id, count(*) AS total, count(*) FILTER (state = 'dismissed') AS dismissed,
  count(*) FILTER (state = 'needs_info') AS needs_review, {SEV_COUNTS},
  round(100 * (1 - 1 / (1 + sum(CASE WHEN state <> 'dismissed' THEN CAST({WEIGHT} AS DOUBLE) ELSE 0.0 END) / 25)), 1) AS risk_score
FROM v_findings GROUP BY scan_id""")
def scan_summary(spark, sf):
    return rollups.scan_summary(findings(spark, sf))


@query("risk_bands", f"""
SELECT scan_id, CASE WHEN score >= 66 THEN 'high' WHEN score >= 33 THEN 'medium' ELSE 'low' END AS band FROM (SELECT scan_id,
  round(100 * (1 - 1 / (1 + sum(CASE WHEN state <> 'dismissed' THEN CAST({WEIGHT} AS DOUBLE) ELSE 0.0 END) / 25)), 1) AS score FROM v_findings GROUP BY 1)""")
def risk_bands(spark, sf):
    return rollups.scan_summary(findings(spark, sf)).select("scan_id", labels.risk_band(F.col("risk_score")).alias("band"))


@query("category_counts", """
SELECT scan_id, coalesce(category, 'uncategorized') AS category, count(*) AS n
FROM v_findings WHERE state <> 'dismissed' GROUP BY 1, 2""")
def category_counts(spark, sf):
    return rollups.category_counts(findings(spark, sf))


LATEST = """latest AS (SELECT project_id, scan_id, created_at, status FROM (SELECT *, row_number() OVER (
  PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM v_scans) WHERE rn = 1)"""


@query("latest_scans", f"WITH {LATEST} SELECT project_id, scan_id, status FROM latest")
def latest_scans(spark, sf):
    return rollups.latest_scans(scans(spark, sf)).select("project_id", "scan_id", "status")


@query("dashboard", f"""
WITH {LATEST} SELECT l.project_id, l.scan_id, count(f.finding_id) AS total_findings,
  count(f.finding_id) FILTER (state <> 'dismissed') AS open_findings,
  count(f.finding_id) FILTER (state = 'needs_info') AS needs_review, {ALL_SEV_COUNTS}
FROM latest l LEFT JOIN v_findings f USING (scan_id) GROUP BY 1, 2""")
def dashboard(spark, sf):
    return rollups.dashboard(scans(spark, sf), findings(spark, sf))


def _top(value, n):
    return f"""
WITH {LATEST}, c AS (SELECT l.project_id, {value} AS v, count(*) AS n FROM latest l
  JOIN v_findings f USING (scan_id) GROUP BY 1, 2)
SELECT project_id, v, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id
  ORDER BY n DESC, v) AS rn FROM c) WHERE rn <= {n}"""


@query("dashboard_top_categories", _top("coalesce(category, 'uncategorized')", 12))
def dashboard_top_categories(spark, sf):
    return rollups.dashboard_tops(scans(spark, sf), findings(spark, sf))[0] \
        .withColumnRenamed("category", "v")


@query("dashboard_top_files", _top("file_path", 10))
def dashboard_top_files(spark, sf):
    return rollups.dashboard_tops(scans(spark, sf), findings(spark, sf))[1] \
        .withColumnRenamed("file_path", "v")


@query("issue_groups", f"""
SELECT scan_id, lower(trim(coalesce(cwe, category, title, 'other'))) AS group_key,
  count(*) AS instances, min({RANK}) AS top_rank,
  count(*) FILTER (state = 'confirmed') AS confirmed, min(coalesce(category, title, cwe, 'Other')) AS label
FROM v_findings GROUP BY 1, 2""")
def issue_groups(spark, sf):
    return rollups.sort_groups(rollups.issue_groups(findings(spark, sf))).drop("top_severity")


@query("source_buckets", """
SELECT scan_id, coalesce(bucket, 'all') AS bucket, count(*) AS n FROM (SELECT scan_id,
  CASE WHEN source IN ('semgrep','sonarqube','access','dast') THEN source ELSE 'ai' END AS bucket
  FROM v_findings WHERE state <> 'dismissed') GROUP BY GROUPING SETS ((scan_id, bucket), (scan_id))""")
def source_buckets(spark, sf):
    rows = findings(spark, sf).withColumn("unverified", F.lit(False))
    return rollups.source_buckets(rollups.visible_findings(rows))


@query("hidden_counts", """
SELECT scan_id, count(*) FILTER (source = 'access' AND confidence <= 0.3) AS unverified,
  count(*) FILTER (state = 'dismissed') AS dismissed FROM v_findings GROUP BY 1""")
def hidden_counts(spark, sf):
    return rollups.hidden_counts(findings(spark, sf).withColumn(
        "unverified", (F.col("source") == "access") & (F.col("confidence") <= 0.3)))


@query("report_counters", """
SELECT scan_id, count(*) FILTER (state <> 'dismissed') AS open,
  count(*) FILTER (state = 'confirmed') AS confirmed, count(*) FILTER (state = 'needs_info') AS needs_review,
  count(*) FILTER (state = 'dismissed') AS dismissed, CAST(0 AS BIGINT) AS live_confirmed
FROM v_findings GROUP BY 1""")
def report_counters(spark, sf):
    return rollups.report_counters(findings(spark, sf))


# project-wide groups are larger than a scan
@query("report_findings", f"""
SELECT source, finding_id, position FROM (SELECT source, finding_id, row_number() OVER (
  PARTITION BY source ORDER BY {RANK}, CASE WHEN state = 'confirmed' THEN 0 ELSE 1 END, finding_id) AS position
  FROM v_findings WHERE state <> 'dismissed')""")
def report_findings(spark, sf):
    return rollups.report_findings(findings(spark, sf), ["source"]).select(
        "source", "finding_id", "position")


@query("report_dismissed", """
SELECT source, finding_id, position FROM (SELECT source, finding_id, row_number() OVER (
  PARTITION BY source ORDER BY finding_id) AS position FROM v_findings
  WHERE state = 'dismissed')""")
def report_dismissed(spark, sf):
    return rollups.report_dismissed(findings(spark, sf), ["source"]).select(
        "source", "finding_id", "position")


SEVERITY_WEIGHT = ("CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 "
                   "WHEN 'low' THEN 1 ELSE 0 END")


@query("verification_queue", f"""
SELECT source, finding_id, rn AS position, 'queued' AS verification FROM (
  SELECT source, finding_id, row_number() OVER (PARTITION BY source ORDER BY {SEVERITY_WEIGHT} DESC,
    confidence DESC, finding_id) AS rn FROM v_findings
  WHERE state <> 'dismissed' AND severity IN ('critical','high','medium'))""")
def verification_queue(spark, sf):
    return rollups.verification_queue(findings(spark, sf), ["source"]).select(
        "source", "finding_id", "position", "verification")


@query("triage_queue", f"""
SELECT source, finding_id, rn AS position FROM (
  SELECT source, finding_id, row_number() OVER (PARTITION BY source ORDER BY {SEVERITY_WEIGHT} DESC,
    finding_id) AS rn FROM v_findings WHERE source IN ('semgrep','sonarqube'))""")
def triage_queue(spark, sf):
    hits = findings(spark, sf).where(F.col("source").isin("semgrep", "sonarqube"))
    return rollups.triage_queue(hits, ["source"]).select("source", "finding_id", "position")


@query("findings_by_severity", f"SELECT scan_id, finding_id, {RANK} AS severity_rank FROM v_findings")
def findings_by_severity(spark, sf):
    rows = rollups.sort_by_severity(findings(spark, sf), "finding_id")
    return rows.select("scan_id", "finding_id", labels.severity_rank(F.col("severity"))
                       .alias("severity_rank"))


# ---- candidates -----------------------------------------------------------------------
@query("candidate_dedupe", """
SELECT scan_id, finding_id, file_path, line_start FROM (SELECT *, row_number() OVER (
  PARTITION BY scan_id, file_path, line_start, substring(coalesce(cwe, rule, title, ''), 1, 60)
  ORDER BY CASE WHEN code_snippet IS NULL THEN 1 ELSE 0 END, finding_id) AS rn
  FROM v_findings WHERE source IN ('semgrep','sonarqube')) WHERE rn = 1""")
def candidate_dedupe(spark, sf):
    f = findings(spark, sf)
    both = verdicts.union_candidates(f.where("source = 'semgrep'"), f.where("source = 'sonarqube'"))
    return verdicts.dedupe_candidates(both, order="finding_id").select(
        "scan_id", "finding_id", "file_path", "line_start")


@query("merged_duplicates", """
SELECT scan_id, title, file_path, min(finding_id) AS finding_id, count(*) AS merged_count
FROM v_findings GROUP BY 1, 2, 3""")
def merged_duplicates(spark, sf):
    return verdicts.merge_duplicates(findings(spark, sf).select(
        "scan_id", "title", "file_path", "finding_id", F.col("finding_id").alias("ord"))) \
        .select("scan_id", "title", "file_path", "finding_id", "merged_count")


@query("judge_policy", """
SELECT scan_id, finding_id, merged_count, CASE WHEN state = 'needs_info' THEN state ELSE 'confirmed' END AS state,
  round(CASE WHEN state <> 'needs_info' THEN greatest(confidence, 0.75) ELSE confidence END, 6) AS confidence
FROM (SELECT *, count(*) OVER (PARTITION BY scan_id, title, file_path) AS merged_count,
  row_number() OVER (PARTITION BY scan_id, title, file_path ORDER BY finding_id) AS rn FROM v_findings) WHERE rn = 1""")
def judge_policy(spark, sf):
    f = findings(spark, sf).select("scan_id", "finding_id", "title", "file_path", "state", "confidence")
    return verdicts.judge_policy(f, order="finding_id").select("scan_id", "finding_id", "merged_count", "state",
                                           F.round("confidence", 6).alias("confidence"))


@query("triage_policy", """
SELECT finding_id, CASE WHEN severity IN ('critical','high') THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence,
  coalesce(category, 'static-analysis') AS category,
  CASE WHEN severity IN ('critical','high') THEN 'proposed' ELSE 'dismissed' END AS state,
  'correlated' AS source FROM v_findings WHERE source IN ('semgrep','sonarqube')""")
def triage_policy(spark, sf):
    hits = findings(spark, sf).where(F.col("source").isin("semgrep", "sonarqube"))
    return verdicts.triage_policy(hits).select("finding_id", "confidence", "category", "state",
                                               "source")


@query("candidate_findings", """
SELECT finding_id, title, 'text' AS description, severity, CAST(0.5 AS DOUBLE) AS confidence,
  CASE WHEN source IN ('semgrep','sonarqube','access') THEN source ELSE 'semgrep' END AS source,
  'proposed' AS state FROM v_findings""")
def candidate_findings(spark, sf):
    return verdicts.candidate_findings(findings(spark, sf).withColumn("message", F.lit("text"))
                                       .drop("state", "confidence")).select(
        "finding_id", "title", "description", "severity", "confidence", "source", "state")


@query("stored_candidates", """
SELECT finding_id, source, coalesce(rule, '') AS rule, CASE WHEN code_snippet = 'call_3(x)' THEN NULL
  ELSE code_snippet END AS code_snippet FROM v_findings WHERE source IN ('semgrep','sonarqube')""")
def stored_candidates(spark, sf):
    f = findings(spark, sf).withColumn("code_snippet", F.when(
        F.col("code_snippet") == "call_3(x)", " requires login ").otherwise(F.col("code_snippet")))
    return verdicts.stored_candidates(f).select("finding_id", "source", "rule", "code_snippet")


# ---- matching -------------------------------------------------------------------------
@query("unaddressed_hits", """
WITH h AS (SELECT * FROM v_findings WHERE source IN ('semgrep','sonarqube')),
f AS (SELECT * FROM v_findings WHERE source NOT IN ('semgrep','sonarqube'))
SELECT scan_id, finding_id FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.scan_id = h.scan_id
  AND f.file_path = h.file_path AND (h.line_start IS NULL OR abs(h.line_start - coalesce(f.line_start, 0)) <= 3))""")
def unaddressed_hits(spark, sf):
    f = findings(spark, sf)
    static = F.col("source").isin("semgrep", "sonarqube")
    return matching.unaddressed_hits(f.where(static), f.where(~static)).select(
        "scan_id", "finding_id")


AGREE = """
WITH p AS (SELECT a.scan_id, a.finding_id, b.reviewed_by AS who FROM v_findings a JOIN v_findings b
  ON a.scan_id = b.scan_id AND a.file_path = b.file_path AND (a.finding_id = b.finding_id OR (
    (a.line_start IS NULL OR b.line_start IS NULL OR abs(a.line_start - b.line_start) <= 3)
    AND CASE WHEN a.cwe IS NOT NULL AND b.cwe IS NOT NULL THEN a.cwe = b.cwe
      ELSE len(list_intersect(regexp_extract_all(lower(a.title), '[a-z]{4,}'),
                              regexp_extract_all(lower(b.title), '[a-z]{4,}'))) > 0
        OR coalesce(a.category = b.category, FALSE) END))),
c AS (SELECT scan_id, finding_id, CAST(count(DISTINCT who) AS INT) AS agreement FROM p GROUP BY 1, 2)"""


#: What agreement reads of a finding.
ISSUE = ("scan_id", "finding_id", "file_path", "line_start", "cwe", "title", "category", "reviewed_by")


@query("agreement", AGREE + " SELECT scan_id, finding_id, agreement FROM c")
def agreement(spark, sf):
    return matching.reviewer_agreement(findings(spark, sf).select(*ISSUE), 3).select(
        "scan_id", "finding_id", "agreement")


@query("agreement_histogram", AGREE + """
SELECT concat(agreement, '/3') AS agreement, count(*) AS n FROM c GROUP BY 1""")
def agreement_histogram(spark, sf):
    rows = findings(spark, sf).select(*[n for n in ISSUE if n != "finding_id"])
    return matching.agreement_histogram(matching.reviewer_agreement(rows, 3))


@query("carry_meta", """
WITH j AS (SELECT * FROM v_findings WHERE source IN ('ai','correlated')),
i AS (SELECT * FROM v_findings WHERE source NOT IN ('ai','correlated')),
m AS (SELECT j.scan_id, j.finding_id, i.rule, i.endpoint, i.source, row_number() OVER (PARTITION BY j.scan_id, j.finding_id
  ORDER BY CASE WHEN i.title = j.title THEN 0 ELSE 1 END,
           CASE WHEN i.title = j.title THEN i.finding_id END DESC, i.finding_id) AS rn
  FROM j JOIN i ON i.scan_id = j.scan_id AND i.file_path = j.file_path
    AND (i.line_start IS NULL OR j.line_start IS NULL OR abs(i.line_start - j.line_start) <= 3))
SELECT j.scan_id, j.finding_id, coalesce(j.rule, m.rule) AS rule, coalesce(j.endpoint, m.endpoint) AS endpoint,
  CASE WHEN m.source = 'access' THEN 'access' ELSE j.source END AS source
FROM j LEFT JOIN m ON m.scan_id = j.scan_id AND m.finding_id = j.finding_id AND m.rn = 1""")
def carry_meta(spark, sf):
    f = findings(spark, sf)
    judged = F.col("source").isin("ai", "correlated")
    return matching.carry_metadata(f.where(judged), f.where(~judged), ["rule", "endpoint"],
                                   order="finding_id").select(
        "scan_id", "finding_id", "rule", "endpoint", "source")


VIEWS["v_asked"] = """
SELECT scan_id, source AS chunk, finding_id AS id, file_path, line_start,
  row_number() OVER (PARTITION BY scan_id, source ORDER BY finding_id) - 1 AS ord FROM v_findings"""
VIEWS["v_answers"] = """
SELECT scan_id, chunk, CASE WHEN scan_id % 3 = 0 THEN id ELSE NULL END AS id, ord AS n,
  CASE WHEN scan_id % 3 = 1 THEN file_path END AS file_path,
  CASE WHEN scan_id % 3 = 1 THEN line_start END AS line_start, concat('v', ord) AS verdict
FROM v_asked WHERE scan_id % 5 <> 0 OR ord % 2 = 0"""


@query("attach_verdicts", """
WITH k AS (SELECT * FROM v_answers WHERE id IS NOT NULL), l AS (SELECT * FROM v_answers WHERE id IS NULL),
loc AS (SELECT scan_id, chunk, file_path, line_start, max_by(verdict, n) AS v FROM l GROUP BY ALL),
q AS (SELECT scan_id, chunk, count(*) AS asked FROM v_asked GROUP BY ALL),
g AS (SELECT scan_id, chunk, count(*) AS got, count(id) AS ids FROM v_answers GROUP BY ALL)
SELECT a.scan_id, a.id, coalesce(k.verdict, loc.v, CASE WHEN q.asked = g.got AND g.ids = 0 THEN p.verdict END) AS verdict
FROM v_asked a LEFT JOIN k ON k.scan_id = a.scan_id AND k.chunk = a.chunk AND k.id = a.id
LEFT JOIN loc ON loc.scan_id = a.scan_id AND loc.chunk = a.chunk
  AND loc.file_path IS NOT DISTINCT FROM a.file_path AND loc.line_start IS NOT DISTINCT FROM a.line_start
LEFT JOIN l p ON p.scan_id = a.scan_id AND p.chunk = a.chunk AND p.n = a.ord
LEFT JOIN q ON q.scan_id = a.scan_id AND q.chunk = a.chunk
LEFT JOIN g ON g.scan_id = a.scan_id AND g.chunk = a.chunk""")
def attach_verdicts(spark, sf):
    return matching.attach_verdicts(view(spark, sf, "v_asked"), view(spark, sf, "v_answers")) \
        .select("scan_id", "id", "verdict")


# ---- verdicts ----------------------------------------------------------------------------
VERDICT_OUT = ("finding_id", "state", "severity", "severity_original", "verification",
               "human_question")


# What verifiers said about each finding: names and numbers as models write them, none for every fifth part.
VIEWS["v_verdicts"] = """
SELECT finding_id, CASE p % 5 WHEN 0 THEN 'False Positive' WHEN 1 THEN 'true-positive' WHEN 2 THEN 'uncertain' ELSE 'no idea' END AS verdict,
  CASE s % 4 WHEN 0 THEN '0.9' WHEN 1 THEN '1.7' WHEN 2 THEN 'high' END AS confidence, concat('reason ', p % 11) AS reasoning,
  CASE n % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' ELSE 'odd' END AS severity, CASE WHEN s % 3 = 0 THEN concat('ask ', s) END AS human_question
FROM (SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS finding_id, l_partkey AS p, l_suppkey AS s, l_linenumber AS n
  FROM @lineitem WHERE l_partkey % 5 <> 4)"""


@query("verdict_apply", """
WITH v AS (SELECT *, CASE verdict WHEN 'False Positive' THEN 'false_positive' WHEN 'true-positive' THEN 'true_positive' ELSE 'uncertain' END AS name,
  CASE confidence WHEN '0.9' THEN 0.9 WHEN '1.7' THEN 1.0 END AS conf, lower(severity) AS sev FROM v_verdicts),
j AS (SELECT f.*, v.name, v.conf, v.sev, v.reasoning, v.human_question AS ask, coalesce(v.sev IN ('high', 'low') AND v.sev <> f.severity, FALSE) AS moved,
  CASE WHEN f.confidence = 0 THEN 1.0 ELSE f.confidence END AS old FROM v_findings f LEFT JOIN v USING (finding_id))
SELECT finding_id, CASE name WHEN 'false_positive' THEN 'dismissed' WHEN 'true_positive' THEN 'confirmed' WHEN 'uncertain' THEN 'needs_info' ELSE state END AS state,
  CASE WHEN moved THEN sev ELSE severity END AS severity, CASE WHEN moved THEN severity END AS severity_original, coalesce(name, 'not_verified') AS verification,
  CASE WHEN name = 'uncertain' THEN coalesce(ask, human_question, reasoning) ELSE human_question END AS human_question,
  CASE WHEN name = 'false_positive' THEN concat('Verifier: ', reasoning) ELSE triage_note END AS triage_note,
  round(CASE name WHEN 'false_positive' THEN least(coalesce(conf, 0.2), old) WHEN 'true_positive' THEN coalesce(conf, confidence)
    WHEN 'uncertain' THEN least(coalesce(conf, 0.5), old) ELSE confidence END, 6) AS confidence FROM j""")
def verdict_apply(spark, sf):
    """All three verdicts, severities that change, and findings without a verdict."""
    return verdicts.apply_verdicts(findings(spark, sf), view(spark, sf, "v_verdicts")).select(
        *VERDICT_OUT, "triage_note", F.round("confidence", 6).alias("confidence"))


@query("storable_findings", """
SELECT finding_id, coalesce(nullif(title, ''), 'Untitled finding') AS title, severity, CAST(line_start AS INT) AS line_start FROM (
  SELECT finding_id, CASE line_end % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE title END AS title, severity, line_start FROM v_findings)""")
def storable_findings(spark, sf):
    """Findings as a table takes them: lines as written by models become numbers or null."""
    rows = findings(spark, sf).withColumns({
        "title": F.when(F.col("line_end") % 3 == 0, "").when(F.col("line_end") % 3 == 1, F.lit(None)).otherwise(F.col("title")),
        "line_start": F.col("line_start").cast("string"), "owasp": F.lit(None).cast("string")})
    return verdicts.storable_findings(rows).select("finding_id", "title", "severity", "line_start")


VIEWS["v_decisions"] = """
SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS finding_id,
  o_orderdate AS triaged_at, l_suppkey AS seq, concat('note ', l_tax) AS triage_note,
  concat('user', l_partkey % 10) AS triaged_by,
  CASE WHEN l_tax < 0.03 THEN 'confirmed' ELSE 'dismissed' END AS state
FROM @lineitem JOIN @orders ON o_orderkey = l_orderkey WHERE l_tax < 0.06"""


@query("human_triage", """
SELECT f.finding_id, coalesce(d.state, f.state) AS state, d.triaged_by
FROM v_findings f LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY triaged_at DESC, seq DESC, state DESC,
    triage_note DESC, triaged_by DESC) AS rn FROM v_decisions) d ON d.finding_id = f.finding_id AND d.rn = 1""")
def human_triage(spark, sf):
    return verdicts.apply_triage(findings(spark, sf), view(spark, sf, "v_decisions")).select(
        "finding_id", "state", "triaged_by")


@query("scan_status", """
SELECT scan_id, CASE WHEN bool_or(state = 'needs_info') THEN 'needs_review' ELSE 'completed' END AS status
FROM v_findings GROUP BY 1""")
def scan_status(spark, sf):
    return verdicts.scan_status(findings(spark, sf))


@query("normalized_findings", """
SELECT finding_id, severity, CASE WHEN state = 'confirmed' AND line_start < 5 THEN 'proposed' ELSE state END AS state,
  round(CASE WHEN state = 'confirmed' AND line_start < 5 THEN least(0.4, confidence) ELSE confidence END, 6) AS confidence,
  source FROM v_findings""")
def normalized_findings(spark, sf):
    f = findings(spark, sf)
    raw = f.withColumns({
        "severity": F.upper("severity"), "description": F.lit(None).cast("string"),
        "file_path": F.when(F.col("line_start") < 5, None).otherwise(F.col("file_path")),
        "confidence": F.col("confidence").cast("string"), "triaged_by": F.lit("")})
    return verdicts.normalize_findings(raw).select(
        "finding_id", "severity", "state", F.round("confidence", 6).alias("confidence"), "source")


@query("unverified_flags", """
SELECT finding_id, round(least(CASE WHEN confidence = 0 THEN 0.3 ELSE confidence END, 0.3), 6) AS confidence
FROM v_findings WHERE source = 'access'""")
def unverified_flags(spark, sf):
    from auditspan.operators.access_flags import mark_unverified
    return mark_unverified(findings(spark, sf).where("source = 'access'")).select(
        "finding_id", F.round("confidence", 6).alias("confidence"))


# ---- tables ----------------------------------------------------------------------------------
@query("swap_findings", """
SELECT scan_id, finding_id, source FROM v_findings WHERE NOT (source IN ('ai','correlated','access') AND scan_id % 2 = 0)
UNION ALL SELECT scan_id, concat(finding_id, '-n'), 'ai' FROM v_findings WHERE scan_id % 2 = 0 AND source = 'dast'
UNION ALL SELECT f.scan_id, f.finding_id, f.source FROM v_findings f WHERE f.scan_id % 2 = 0
  AND f.source IN ('ai','correlated','access') AND NOT EXISTS (SELECT 1 FROM v_findings d
    WHERE d.scan_id = f.scan_id AND d.source = 'dast')""")
def swap_findings(spark, sf):
    f = findings(spark, sf).select("scan_id", "finding_id", "source")
    new = f.where("source = 'dast' and scan_id % 2 = 0").select(
        "scan_id", F.concat("finding_id", F.lit("-n")).alias("finding_id"),
        F.lit("ai").alias("source"))
    return replace_sources(f, new, ["ai", "correlated", "access"])


@query("cascade_closure", """
SELECT 'projects' AS kind, count(*) AS gone FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'scans', count(*) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'artifacts', count(*) FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)
UNION ALL SELECT 'findings', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def cascade_closure(spark, sf):
    from functools import reduce
    from auditspan.operators.lifecycle import cascade
    clients = table(spark, sf, "nation").where("n_regionkey = 1").select(
        F.col("n_nationkey").alias("client_id"))
    projects = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("client_id"))
    artifacts = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("project_id"), F.col("l_suppkey").alias("artifact_id")).distinct()
    gone = cascade(clients, projects, artifacts, scans(spark, sf),
                   {"findings": findings(spark, sf).select("scan_id", "finding_id")})
    return reduce(lambda a, b: a.unionByName(b), [
        gone[k].select(F.lit(k).alias("kind")).groupBy("kind").agg(
            F.count(F.lit(1)).alias("gone")) for k in ("projects", "artifacts", "scans", "findings")])


# ---- conversations: token usage and history ----------------------------------------------------
CALLS = ("SELECT conv_id AS scan_id, CASE role WHEN 'user' THEN 'small' ELSE 'large' END AS model, "
         "length(text) AS prompt_tokens, turn AS completion_tokens FROM @conversations")


@query("token_usage", """
SELECT scan_id, coalesce(model, '(total)') AS model, CAST(sum(p) AS BIGINT) AS prompt_tokens,
  CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens, count(*) AS calls
FROM (SELECT conv_id AS scan_id, CASE role WHEN 'user' THEN 'small' ELSE 'large' END AS model,
  length(text) AS p, turn AS c FROM conversations) GROUP BY GROUPING SETS ((scan_id, model), (scan_id))""")
def token_usage(spark, sf):
    return rollups.token_usage(spark_sql(spark, sf, CALLS))


@query("recent_messages", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
WHERE b <= 10""")
def recent_messages(spark, sf):
    return rollups.recent(table(spark, sf, "conversations").select("conv_id", "turn"),
                          ["conv_id"], F.col("turn")).select("conv_id", "turn", "position")


@query("compact_counts", """
SELECT o_orderkey AS k, CASE WHEN n >= 1000000 THEN concat((n + 5000) // 1000000, '.', lpad(CAST(((n + 5000) // 10000) % 100 AS VARCHAR), 2, '0'), 'M')
  WHEN n >= 1000 THEN concat((n + 50) // 1000, '.', ((n + 50) // 100) % 10, 'K') ELSE CAST(n AS VARCHAR) END AS shown
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 7) AS n FROM orders)""")
def compact_counts(spark, sf):
    n = F.floor("o_totalprice").cast("bigint") * (1 + F.col("o_orderkey") % 7)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"),
                                             text.compact_count(n).alias("shown"))


@query("finding_payloads", """
SELECT finding_id, concat('{', array_to_string(list_filter([concat('"severity":"', severity, '"'), CASE WHEN cwe IS NOT NULL THEN concat('"cwe":"', cwe, '"') END,
  CASE WHEN line_start IS NOT NULL THEN concat('"line_start":', line_start) END, concat('"source":"', source, '"')], lambda x: x IS NOT NULL), ','), '}') AS payload
FROM v_findings""")
def finding_payloads(spark, sf):
    return verdicts.payloads(findings(spark, sf), ["finding_id"],
                             ("severity", "cwe", "line_start", "absent", "source"))
