"""The compositions as queries: a whole review and a live check with what was said about them."""

from pyspark.sql import functions as F

from auditspan.operators.access_map import endpoint_id
from auditspan.operators.ordered import pin
from auditspan.plans.live import run_live_review
from auditspan.plans.review import Answers, hit_id, run_review
from auditspan.plans.stages import Checks, ReviewOptions

from .access import FLAGS, RESOLVED, api_files
from .base import VIEWS, query, view
from .live import VERDICT

_DEF = "concat('async def h', k, '(', CASE WHEN has_user THEN 'current_user = Depends(get_current_user)' ELSE 'body: dict' END, '):')"
# Every fourth route has a finding that quotes its handler; some cite a file that is not there.
VIEWS["v_rev_found"] = f"""
SELECT artifact_id, concat('r', k) AS finding_id, k, CASE WHEN k % 40 = 4 THEN 'gone.py' ELSE file_path END AS file_path, CAST(line + 1 AS INT) AS line_start,
  {_DEF} AS code_snippet, concat('Finding ', k) AS title, CASE k % 8 WHEN 0 THEN 'high' ELSE 'low' END AS severity, 'proposed' AS state,
  CAST(0.6 AS DOUBLE) AS confidence, 'ai' AS source FROM v_api_parts WHERE k % 4 = 0"""
# Scanner hits in handlers, and what triage said about two thirds of them.
VIEWS["v_rev_hits"] = """
SELECT artifact_id, k, file_path, CAST(line + 2 AS INT) AS line_start, 'db.raw' AS rule, 'Raw query' AS title, CASE k % 2 WHEN 0 THEN 'high' ELSE 'medium' END AS severity,
  CASE k % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'False positive' END AS verdict FROM v_api_parts WHERE size % 6 = 0"""
# The judge merged some findings into others and confirmed some; verifiers spoke about three of five.
VIEWS["v_rev_judged"] = """
SELECT artifact_id, finding_id, CASE k % 12 WHEN 4 THEN 'Confirmed' END AS state, CASE k % 12 WHEN 4 THEN '0.9' END AS confidence,
  CASE k % 12 WHEN 0 THEN concat('r', k - 4) END AS merged_into FROM v_rev_found WHERE k % 12 <> 8"""
VIEWS["v_rev_verdicts"] = """
SELECT artifact_id, finding_id, CASE k % 5 WHEN 0 THEN 'false positive' WHEN 1 THEN 'true_positive' ELSE 'unclear' END AS verdict, '0.7' AS confidence,
  'because' AS reasoning, CASE k % 5 WHEN 1 THEN 'critical' END AS severity, CAST(NULL AS VARCHAR(10)) AS human_question FROM v_rev_found WHERE k % 5 < 3"""
REVIEW = RESOLVED.replace("CASE WHEN k % 5 = 0 THEN 'confirmed' WHEN k % 5 = 1 THEN 'uncertain' WHEN implied", "CASE WHEN implied") + """,
a AS (SELECT f.artifact_id, f.severity, f.title, v.verdict AS v, j.state AS js, j.merged_into AS jm, f.file_path = 'gone.py' AS gone, v.severity AS vs
  FROM v_rev_found f LEFT JOIN v_rev_judged j USING (artifact_id, finding_id) LEFT JOIN v_rev_verdicts v USING (artifact_id, finding_id)),
open_hits AS (SELECT h.* FROM v_rev_hits h WHERE NOT EXISTS (SELECT 1 FROM v_rev_found f WHERE f.artifact_id = h.artifact_id AND f.file_path = h.file_path
  AND abs(f.line_start - h.line_start) <= 3)),
every AS (SELECT artifact_id, 'ai' AS source, coalesce(vs, severity) AS severity, CASE v WHEN 'false positive' THEN 'dismissed' WHEN 'true_positive' THEN 'confirmed'
    WHEN 'unclear' THEN 'needs_info' ELSE CASE WHEN jm IS NOT NULL THEN 'dismissed' WHEN js IS NOT NULL THEN 'confirmed' WHEN gone THEN 'dismissed' ELSE 'proposed' END END AS state FROM a
  UNION ALL SELECT artifact_id, 'correlated', severity, CASE verdict WHEN 'true_positive' THEN 'proposed' ELSE 'dismissed' END FROM open_hits WHERE verdict IS NOT NULL
  UNION ALL SELECT artifact_id, 'access', severity, 'proposed' FROM z WHERE outcome = 'unverified'
  UNION ALL SELECT artifact_id, 'access', severity, state FROM v_api_found)"""


def review(spark, sf):
    eps = view(spark, sf, "v_api_verdicts").join(
        view(spark, sf, "v_api_parts").select("artifact_id", "file_path", "line", "method", "path"), ["artifact_id", "file_path", "line"])
    said = eps.withColumn("framework", F.lit("fastapi")).withColumn("endpoint_id", endpoint_id()).select(
        "artifact_id", "endpoint_id", "authn", "authz", "risk", "notes")
    hits = view(spark, sf, "v_rev_hits")
    triage = hits.where("verdict IS NOT NULL").select(
        "artifact_id", hit_id().alias("hit_id"), "verdict", F.lit(None).cast("string").alias("severity"), F.lit("0.7").alias("confidence"),
        F.lit("seen").alias("reasoning"))
    candidates = hits.select("artifact_id", F.lit("semgrep").alias("source"), "rule", "title", F.lit("raw").alias("message"), "severity",
                             *[F.lit(None).cast("string").alias(c) for c in ("cwe", "owasp", "category")], "file_path", "line_start",
                             F.col("line_start").alias("line_end"), F.lit(None).cast("string").alias("code_snippet"))
    found = view(spark, sf, "v_api_found").withColumn("source", F.lit("access"))
    answers = Answers(triage=triage, endpoints=said, access_findings=found, judged=view(spark, sf, "v_rev_judged"),
                      verdicts=view(spark, sf, "v_rev_verdicts"))
    return run_review(pin(api_files(spark, sf)), view(spark, sf, "v_rev_found"), ReviewOptions(scanners=frozenset({"ai"})), candidates, answers)


@query("review_states", REVIEW + " SELECT artifact_id, source, severity, state, count(*) AS n FROM every GROUP BY 1, 2, 3, 4")
def review_states(spark, sf):
    """Findings of reviewers, triage, access flags and access review, after judge and verifiers."""
    return review(spark, sf).findings.groupBy("artifact_id", "source", "severity", "state").agg(F.count(F.lit(1)).alias("n"))


@query("review_summary", REVIEW + """
SELECT artifact_id, count(*) AS total, count(*) FILTER (state = 'dismissed') AS dismissed, count(*) FILTER (state = 'needs_info') AS needs_review,
  count(*) FILTER (state <> 'dismissed' AND severity = 'critical') AS n_critical, count(*) FILTER (state <> 'dismissed' AND severity = 'high') AS n_high,
  count(*) FILTER (state <> 'dismissed' AND severity = 'medium') AS n_medium, count(*) FILTER (state <> 'dismissed' AND severity = 'low') AS n_low,
  count(*) FILTER (state <> 'dismissed' AND severity = 'info') AS n_info,
  round(100 * (1 - 1 / (1 + sum(CASE WHEN state = 'dismissed' THEN 0.0 ELSE CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0
    WHEN 'low' THEN 1.0 ELSE 0.2 END END::DOUBLE) / 25)), 1) AS risk_score FROM every GROUP BY 1""")
def review_summary(spark, sf):
    return review(spark, sf).summary


@query("review_unaddressed", REVIEW + " SELECT artifact_id, file_path, line_start FROM open_hits WHERE verdict IS NULL")
def review_unaddressed(spark, sf):
    return review(spark, sf).unaddressed.select("artifact_id", "file_path", "line_start")


@query("static_review", FLAGS + """,
hits AS (SELECT artifact_id, 'semgrep' AS source, severity, 'proposed' AS state FROM v_rev_hits),
raised AS (SELECT artifact_id, 'access' AS source, severity, CASE WHEN rule = 'access.auth-not-located' THEN 'needs_info' ELSE 'proposed' END AS state FROM flags),
found AS (SELECT artifact_id, source, severity, CASE WHEN file_path = 'gone.py' THEN 'dismissed' ELSE state END AS state FROM v_rev_found)
SELECT artifact_id, source, severity, state, count(*) AS n FROM (SELECT * FROM hits UNION ALL SELECT * FROM raised UNION ALL SELECT * FROM found) GROUP BY 1, 2, 3, 4""")
def static_review(spark, sf):
    """The finding table of a review that nobody answered: candidates, unverified flags, checked findings."""
    hits = view(spark, sf, "v_rev_hits")
    candidates = hits.select("artifact_id", F.lit("semgrep").alias("source"), "rule", "title", F.lit("raw").alias("message"), "severity",
                             *[F.lit(None).cast("string").alias(c) for c in ("cwe", "owasp", "category")], "file_path", "line_start",
                             F.col("line_start").alias("line_end"), F.lit(None).cast("string").alias("code_snippet"))
    done = run_review(pin(api_files(spark, sf)), view(spark, sf, "v_rev_found"), ReviewOptions(scanners=frozenset({"ai"}), checks=Checks(verify=False)),
                      candidates)
    return done.stored.groupBy("artifact_id", "source", "severity", "state").agg(F.count(F.lit(1)).alias("n"))


# ---- live check ------------------------------------------------------------------------------------
VIEWS["v_live_findings"] = """
SELECT o_custkey AS scan_id, o_orderkey AS finding_id, CASE WHEN o_orderkey % 11 = 0 THEN 'ai' ELSE 'access' END AS source,
  CASE WHEN o_orderkey % 7 = 0 THEN 'dismissed' ELSE 'proposed' END AS state, CAST((o_orderkey % 10) / 10.0 AS DOUBLE) AS confidence,
  CASE o_orderkey % 3 WHEN 0 THEN 'access.missing-authn' WHEN 1 THEN 'access.inconsistent-authz' ELSE 'access.idor' END AS rule, CAST(NULL AS VARCHAR(10)) AS cwe,
  CASE WHEN o_orderkey % 13 > 1 THEN concat('ANY /', CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'b/x' ELSE 'c' END, '/', o_orderkey % 50) END AS endpoint,
  CASE WHEN o_orderkey % 13 = 0 THEN concat('e', o_orderkey % 5) END AS endpoint_id, CAST(NULL AS VARCHAR(10)) AS triage_note FROM @orders"""
VIEWS["v_live_endpoints"] = """
SELECT c_custkey AS scan_id, concat('e', n) AS endpoint_id, 'ALL' AS method, concat('/b/e', n) AS path
FROM @customer CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2)"""
LIVE = VERDICT + """,
q AS (SELECT f.* FROM v_live_findings f WHERE source = 'access' AND state <> 'dismissed' AND scan_id % 5 <> 0 AND (endpoint IS NULL OR scan_id % 2 = 1
  OR split_part(endpoint, ' ', 2) LIKE '/b%' AND NOT split_part(endpoint, ' ', 2) LIKE '/b/x%')),
l AS (SELECT q.finding_id, q.scan_id, CASE finding_id % 3 WHEN 0 THEN 'missing_authn' WHEN 1 THEN 'bfla' ELSE 'idor' END AS kind,
  coalesce(q.endpoint, e.method || ' ' || e.path) AS label FROM q LEFT JOIN v_live_endpoints e ON e.scan_id = q.scan_id AND e.endpoint_id = q.endpoint_id),
w AS (SELECT l.*, v.verdict FROM l LEFT JOIN v ON v.finding_id = l.finding_id AND l.label IS NOT NULL)"""


def live(spark, sf):
    runs = view(spark, sf, "v_live_findings").select("scan_id").distinct().select(
        "scan_id", F.when(F.col("scan_id") % 2 == 0, F.array(F.lit("/b"))).otherwise(F.array().cast("array<string>")).alias("include_paths"),
        F.when(F.col("scan_id") % 2 == 0, F.array(F.lit("/b/x"))).otherwise(F.array().cast("array<string>")).alias("exclude_paths"),
        (F.col("scan_id") % 5 != 0).alias("access_control"))
    endpoints = view(spark, sf, "v_live_endpoints").withColumn("id_params", F.array(F.lit("id")))
    return run_live_review(view(spark, sf, "v_live_findings"), endpoints, runs, view(spark, sf, "v_probes"))


@query("live_review", LIVE + """
SELECT f.scan_id, f.finding_id, CASE w.verdict WHEN 'confirmed_vuln' THEN 'confirmed' WHEN 'enforced' THEN 'dismissed' ELSE f.state END AS state,
  round(CASE w.verdict WHEN 'confirmed_vuln' THEN greatest(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END, 0.9)
   WHEN 'enforced' THEN least(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END, 0.2) ELSE confidence END, 6) AS confidence, w.verdict AS live_verdict
FROM v_live_findings f LEFT JOIN w USING (finding_id)""")
def live_review(spark, sf):
    return live(spark, sf).findings.select("scan_id", "finding_id", "state", F.round("confidence", 6).alias("confidence"), "live_verdict")


@query("live_requests", LIVE + """
SELECT scan_id, finding_id, kind, CASE split_part(label, ' ', 1) WHEN 'ANY' THEN 'GET' WHEN 'ALL' THEN 'GET' ELSE split_part(label, ' ', 1) END AS method,
  split_part(label, ' ', 2) AS path FROM w WHERE label IS NOT NULL""")
def live_requests(spark, sf):
    return live(spark, sf).requests.select("scan_id", "finding_id", "kind", "method", "path")


@query("live_outcomes", LIVE + """
SELECT scan_id, CASE coalesce(verdict, 'untestable') WHEN 'confirmed_vuln' THEN 'confirmed' ELSE coalesce(verdict, 'untestable') END AS outcome, count(*) AS n FROM w GROUP BY 1, 2""")
def live_outcomes(spark, sf):
    return live(spark, sf).counts
