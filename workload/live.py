"""Queries over recorded responses, request logs and the event log."""

from pyspark.sql import functions as F

from auditspan.functions import fixed, labels, paths, routes as rx, text
from auditspan.operators import responses, rollups, verdicts
from auditspan.streaming import control, events as ev

from .base import VIEWS, query, spark_sql, table, view

# ---- recorded responses: four requests per finding, one kind per finding --------------------
VIEWS["v_probes"] = """
SELECT finding_id, CASE finding_id % 3 WHEN 0 THEN 'missing_authn' WHEN 1 THEN 'bfla' ELSE 'idor' END AS kind,
  role, CASE WHEN event_id % 2 = 0 THEN 'userB' ELSE 'userC' END AS owner, concat('/obj/', event_id % 2) AS target,
  finding_id % 3 = 2 AND event_id % 4 >= 2 AS baseline, CAST(status AS INT) AS status, body_hash,
  CASE WHEN status = 500 AND event_id % 5 = 0 THEN 'timeout' END AS error FROM v_responses"""
VERDICT = """
WITH a AS (SELECT *, status BETWEEN 200 AND 299 AND error IS NULL AS ok, status IN (401, 403) AS no FROM v_probes),
m AS (SELECT DISTINCT x.finding_id FROM a x JOIN a b ON b.finding_id = x.finding_id AND b.target = x.target AND b.owner = x.owner
  AND b.body_hash = x.body_hash WHERE x.kind = 'idor' AND NOT x.baseline AND b.baseline AND x.ok AND b.status BETWEEN 200 AND 299),
g AS (SELECT finding_id, kind, bool_or(ok) AS ok, bool_or(no) AS any_no, bool_and(no) AS all_no, bool_or(error IS NOT NULL) AS err,
  count(*) AS requests FROM a WHERE NOT baseline GROUP BY 1, 2),
v AS (SELECT g.finding_id, kind, requests, CASE kind
  WHEN 'missing_authn' THEN CASE WHEN err THEN 'inconclusive' WHEN ok THEN 'confirmed_vuln' WHEN any_no THEN 'enforced' ELSE 'inconclusive' END
  WHEN 'bfla' THEN CASE WHEN ok THEN 'confirmed_vuln' WHEN any_no THEN 'enforced' ELSE 'inconclusive' END
  ELSE CASE WHEN m.finding_id IS NOT NULL THEN 'confirmed_vuln' WHEN ok THEN 'inconclusive' WHEN all_no THEN 'enforced' ELSE 'inconclusive' END END AS verdict
  FROM g LEFT JOIN m USING (finding_id))"""


def probes(spark, sf):
    return view(spark, sf, "v_probes")


@query("response_verdicts", VERDICT + " SELECT * FROM v")
def response_verdicts(spark, sf):
    return responses.response_verdicts(probes(spark, sf)).drop("reason")


@query("live_counts", VERDICT + """
SELECT kind, CASE verdict WHEN 'confirmed_vuln' THEN 'confirmed' ELSE verdict END AS outcome, count(*) AS n FROM v GROUP BY 1, 2""")
def live_counts(spark, sf):
    return responses.outcome_counts(responses.response_verdicts(probes(spark, sf)), ["kind"])


@query("live_verdict_apply", VERDICT + """,
f AS (SELECT o_orderkey AS finding_id, 'proposed' AS state, (o_orderkey % 10) / 10 AS confidence FROM orders)
SELECT f.finding_id, CASE v.verdict WHEN 'confirmed_vuln' THEN 'confirmed' WHEN 'enforced' THEN 'dismissed' ELSE state END AS state,
  round(CASE v.verdict WHEN 'confirmed_vuln' THEN greatest(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END, 0.9)
   WHEN 'enforced' THEN least(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END, 0.2) ELSE confidence END, 6) AS confidence
FROM f LEFT JOIN v USING (finding_id)""")
def live_verdict_apply(spark, sf):
    f = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("finding_id"), F.lit("proposed").alias("state"),
        ((F.col("o_orderkey") % 10) / 10).alias("confidence"),
        F.lit(None).cast("string").alias("triage_note"))
    v = responses.response_verdicts(probes(spark, sf))
    return verdicts.apply_live_verdicts(f, v).select(
        "finding_id", "state", F.round("confidence", 6).alias("confidence"))


@query("probe_kinds", """
SELECT finding_id, CASE WHEN rule = 'access.missing-authn' OR cwe = 'CWE-306' THEN 'missing_authn'
  WHEN rule = 'access.idor' OR cwe = 'CWE-639' THEN 'idor' WHEN rule = 'access.inconsistent-authz' OR cwe = 'CWE-862' THEN 'bfla' END AS kind
FROM (SELECT l_orderkey * 10 + l_linenumber AS finding_id, CASE l_partkey % 4 WHEN 0 THEN 'access.missing-authn' WHEN 1 THEN 'access.idor'
  WHEN 2 THEN 'access.inconsistent-authz' END AS rule, CASE l_suppkey % 4 WHEN 0 THEN 'CWE-306' WHEN 1 THEN 'CWE-639' WHEN 2 THEN 'CWE-862' END AS cwe FROM lineitem)""")
def probe_kinds(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"),
        text.lookup(F.col("l_partkey") % 4, {0: "access.missing-authn", 1: "access.idor",
                                             2: "access.inconsistent-authz"}).alias("rule"),
        text.lookup(F.col("l_suppkey") % 4, {0: "CWE-306: a", 1: "CWE-639 ", 2: "CWE-862"})
        .alias("cwe"))
    return responses.classify_findings(rows).select("finding_id", "kind")


# ---- seeds --------------------------------------------------------------------------------------
VIEWS["v_seeds"] = """
SELECT o_custkey % 50 AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'harvested' ELSE 'pinned' END AS layer,
  concat('role', o_custkey % 4) AS role, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('/c', o_orderkey % 5) END AS collection,
  concat('p', o_orderkey % 2) AS param, min(o_orderkey) AS v FROM @orders GROUP BY 1, 2, 3, 4, 5"""
SEEDS = """
WITH t AS (SELECT DISTINCT user_id % 50 AS run_id, concat('/c', event_id % 7) AS collection FROM events),
s AS (SELECT run_id, collection, role, param, v, CASE layer WHEN 'harvested' THEN 1 ELSE 2 END AS l FROM v_seeds JOIN t USING (run_id, collection)
  UNION ALL SELECT t.run_id, t.collection, role, param, v, 0 FROM v_seeds s JOIN t ON t.run_id = s.run_id WHERE s.collection IS NULL),
r AS (SELECT run_id, collection, role, param, arg_max(v, l) AS v FROM s GROUP BY 1, 2, 3, 4)"""


def seeds(spark, sf):
    rows = view(spark, sf, "v_seeds").withColumn("ids", F.array(F.col("v").cast("string")))
    targets = table(spark, sf, "events").select(
        (F.col("user_id") % 50).alias("run_id"),
        F.concat(F.lit("/c"), F.col("event_id") % 7).alias("collection"))
    return responses.resolve_seeds(rows, targets)


@query("seed_layers", SEEDS + " SELECT run_id, collection, role, param, v FROM r")
def seed_layers(spark, sf):
    return seeds(spark, sf).select("run_id", "collection", "role", "param",
                                   F.element_at("ids", 1).cast("bigint").alias("v"))


@query("cross_role_probes", SEEDS + """,
f AS (SELECT event_id AS finding_id, user_id % 50 AS run_id, concat('/c', event_id % 7) AS collection, concat('/c', event_id % 7, '/{p0}') AS path FROM events),
o AS (SELECT run_id, collection, role AS owner, v FROM r WHERE param = 'p0')
SELECT f.run_id, finding_id, actor, owner, concat(f.collection, '/', v) AS target FROM f JOIN o ON o.run_id = f.run_id AND o.collection = f.collection
JOIN (SELECT 'role0' AS actor UNION ALL SELECT 'role1' UNION ALL SELECT 'role2') a ON actor <> owner""")
def cross_role_probes(spark, sf):
    e = table(spark, sf, "events")
    path = F.concat(F.lit("/c"), F.col("event_id") % 7, F.lit("/{p0}"))
    found = e.select(F.col("event_id").alias("finding_id"), (F.col("user_id") % 50).alias("run_id"),
                     path.alias("path"), F.lit("GET").alias("method"),
                     F.array(F.lit("p0")).alias("id_params"))
    actors = e.select((F.col("user_id") % 50).alias("run_id")).distinct().select(
        "run_id", F.explode(F.array(*[F.lit(f"role{i}") for i in range(3)])).alias("role"))
    return responses.cross_role_probes(seeds(spark, sf), actors, found).select(
        "run_id", "finding_id", "actor", "owner", "target")


@query("harvested_ids", """
WITH b AS (SELECT user_id, unnest([concat('{"p":0,"v":', event_id, '}'), concat('{"p":1,"v":', event_id + 1, '}')]) AS j, event_id FROM events),
i AS (SELECT DISTINCT user_id % 2000 AS run_id, CAST(json_extract(j, '$.v') AS VARCHAR) AS id FROM b)
SELECT run_id, id FROM i""")
def harvested_ids(spark, sf):
    """Ids inside nested JSON bodies; every event yields a body with two ids."""
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(
        F.lit("x").alias("name"), F.array(F.struct(
            F.col("event_id").alias("user_id"),
            F.struct((F.col("event_id") + 1).alias("itemId")).alias("inner"))).alias("rows")))
    return responses.harvested_ids(e.select(F.col("user_id").alias("run_id"),
                                            body.alias("body")),
                                   ["run_id"], cap=1_000_000).select("run_id", "id")


# ---- scope ----------------------------------------------------------------------------------------
@query("host_scope", """
SELECT page_id, host, host LIKE '%.example.com' AND page_id % 2 = 0 OR host = 'extra.test' AS permitted FROM (
  SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host FROM pages)""")
def host_scope(spark, sf):
    log = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 2).alias("run_id"), "url")
    hosts = log.where("run_id = 0").where(paths.host_of(F.col("url")).endswith(".example.com"))
    # one target per even page: its URL is the base, with ports and bare hosts declared
    targets = hosts.select("run_id", F.col("url").alias("base_url"), F.array(
        F.lit("https://extra.test:8443/x"), F.concat(paths.host_of(F.col("url")), F.lit(":80/p")))
        .alias("allowed_hosts"))
    distinct = targets.withColumn("h", paths.host_of(F.col("base_url"))).dropDuplicates(
        ["run_id", "h"]).groupBy("run_id").agg(
        F.min("base_url").alias("base_url"), F.flatten(F.collect_set("allowed_hosts"))
        .alias("allowed_hosts"))
    return responses.permitted_requests(log, distinct).select("page_id", "host", "permitted")


@query("path_scope", """
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, (path LIKE '/en%' OR path LIKE '/fr/1%') AND NOT path LIKE '/en/2%' AS inside FROM u""")
def path_scope(spark, sf):
    p = paths.url_path(F.col("url"))
    inc = F.array(F.lit("/en"), F.lit("/fr/1"), F.lit(""))
    return table(spark, sf, "pages").select("page_id", p.alias("path")).withColumn(
        "inside", paths.in_prefix_scope(F.col("path"), inc, F.array(F.lit("/en/2"))))


@query("run_plan", """
WITH e AS (SELECT o_custkey AS scan_id, concat('/', CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'b/x' END, '/', o_orderkey % 20) AS path,
  o_orderkey % 2 = 0 AS has_id FROM orders),
f AS (SELECT o_custkey AS scan_id, concat('/', CASE l_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'b/x' END) AS path,
  CASE l_suppkey % 3 WHEN 0 THEN 'missing_authn' WHEN 1 THEN 'idor' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'),
ie AS (SELECT scan_id, count(*) AS n, count(*) FILTER (has_id) AS ids, count(DISTINCT CASE WHEN has_id THEN path END) AS idp FROM e WHERE path LIKE '/b%' AND NOT path LIKE '/b/x%' GROUP BY 1),
jf AS (SELECT scan_id, count(*) AS n, count(*) FILTER (kind = 'missing_authn') AS a, count(*) FILTER (kind = 'idor') AS i FROM f WHERE path LIKE '/b%' AND NOT path LIKE '/b/x%' GROUP BY 1)
SELECT c_custkey AS scan_id, coalesce(ie.n, 0) AS endpoints_in_scope, coalesce(jf.n, 0) AS findings_to_confirm,
  coalesce(a, 0) AS n_missing_authn, coalesce(i, 0) AS n_idor, CAST(0 AS BIGINT) AS n_bfla,
  coalesce(jf.n, 0) * 2 + coalesce(idp, 0) + CASE WHEN c_custkey % 2 = 0 THEN 1 + coalesce(ie.n, 0) + coalesce(ids, 0) * 6 ELSE 0 END AS estimated_requests
FROM customer LEFT JOIN ie ON ie.scan_id = c_custkey LEFT JOIN jf ON jf.scan_id = c_custkey""")
def run_plan(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda c: text.lookup(c % 3, {0: "a", 1: "b"}, "b/x")
    eps = o.select(F.col("o_custkey").alias("scan_id"), F.concat(
        F.lit("/"), part(F.col("o_orderkey")), F.lit("/"), F.col("o_orderkey") % 20).alias("path"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("id"))).otherwise(
            F.array().cast("array<string>")).alias("id_params"))
    found = table(spark, sf, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("scan_id"), F.lit("access").alias("source"),
        F.when(F.col("l_returnflag") == "R", "dismissed").otherwise("proposed").alias("state"),
        F.concat(F.lit("GET /"), part(F.col("l_partkey"))).alias("endpoint"),
        text.lookup(F.col("l_suppkey") % 3, {0: "CWE-306", 1: "CWE-639"}).alias("cwe"),
        F.lit(None).cast("string").alias("rule"))
    runs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("scan_id"), F.array(F.lit("/b")).alias("include_paths"),
        F.array(F.lit("/b/x")).alias("exclude_paths"), F.lit(True).alias("access_control"),
        (F.col("c_custkey") % 2 == 0).alias("active_scan"))
    return responses.run_plan(eps, found, runs)


# ---- request log --------------------------------------------------------------------------------------
LOG = """SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'login' ELSE concat('access:', event_type) END AS purpose,
  CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'head' END AS method,
  concat('http://app.test/', CASE event_id % 4 WHEN 0 THEN 'admin/' ELSE 'shop/' END, event_id % 10, '?q=1') AS url FROM @events"""
VIEWS["v_log"] = LOG


@query("rate_audit", """
SELECT run_id, seq, row_number() OVER w AS request_no, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us,
  coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000, FALSE) AS too_fast, row_number() OVER w > 60 AS over_cap
FROM v_log WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)""")
def rate_audit(spark, sf):
    return responses.rate_audit(view(spark, sf, "v_log"), max_rps=1 / 3600, cap=60).select(
        "run_id", "seq", "request_no", "gap_us", "too_fast", "over_cap")


@query("requests_by_purpose", "SELECT run_id, purpose, count(*) AS requests FROM v_log GROUP BY 1, 2")
def requests_by_purpose(spark, sf):
    return responses.requests_by_purpose(view(spark, sf, "v_log"))


VIEWS["v_patches"] = """
SELECT o_custkey % 200 AS run_id, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'running' WHEN 2 THEN 'bogus' END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN 'all' WHEN 1 THEN 'mutating' WHEN 2 THEN 'off' WHEN 3 THEN 'x' END AS intercept,
  CASE WHEN o_orderkey % 301 = 0 THEN FALSE WHEN o_orderkey % 2 = 0 THEN TRUE END AS allow_mutating,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100000 END AS max_rps, CAST(3 AS DOUBLE) AS ceiling,
  CASE WHEN o_orderkey % 97 = 0 THEN '/admin' WHEN o_orderkey % 89 = 0 THEN '/shop/3' END AS excluded FROM @orders"""
CONTROL = """
WITH c AS (SELECT run_id, coalesce(max_by(status, seq) FILTER (status IN ('paused','running','canceled')), 'running') AS status,
  coalesce(max_by(intercept, seq) FILTER (intercept IN ('off','mutating','all')), 'off') AS intercept,
  bool_and(coalesce(allow_mutating, TRUE)) AS allow_mutating, max_by(least(max_rps, ceiling), seq) FILTER (max_rps > 0) AS max_rps,
  coalesce(string_agg(DISTINCT excluded, ',' ORDER BY excluded), '') AS excluded FROM v_patches GROUP BY 1)"""


def control_table(spark, sf):
    p = view(spark, sf, "v_patches").withColumn("exclude_paths", F.when(
        F.col("excluded").isNotNull(), F.array("excluded")))
    return control.control_state(p)


@query("control_state", CONTROL + " SELECT run_id, status, intercept, allow_mutating, round(max_rps, 6) AS max_rps, excluded FROM c")
def control_state(spark, sf):
    return control_table(spark, sf).select(
        "run_id", "status", "intercept", "allow_mutating", F.round("max_rps", 6).alias("max_rps"),
        F.array_join("exclude_paths", ",").alias("excluded"))


@query("gate_audit", CONTROL + """
SELECT l.run_id, l.seq, CASE WHEN purpose = 'login' THEN 'send' WHEN contains(excluded, '/admin') AND url LIKE '%/admin/%' THEN 'skip'
  WHEN contains(excluded, '/shop/3') AND url LIKE '%/shop/3%' THEN 'skip' WHEN method = 'POST' AND NOT coalesce(allow_mutating, TRUE) THEN 'skip'
  WHEN intercept = 'all' OR (intercept = 'mutating' AND method = 'POST') THEN 'hold' ELSE 'send' END AS decision
FROM v_log l LEFT JOIN c USING (run_id)""")
def gate_audit(spark, sf):
    return control.gate_decisions(view(spark, sf, "v_log"), control_table(spark, sf)).select(
        "run_id", "seq", "decision")


HELD = """h AS (SELECT user_id AS run_id, event_id AS seq, ts AS held_at FROM @events WHERE event_type <> 'purchase'),
d AS (SELECT user_id AS run_id, event_id AS seq, ts + INTERVAL 1 SECOND * CAST(value * 60 AS INT) AS decided_at,
  CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'skip' ELSE 'allow_rest' END AS verdict FROM @events WHERE event_id % 4 <> 0)"""


def held(spark, sf):
    e = table(spark, sf, "events")
    h = e.where("event_type <> 'purchase'").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("held_at"))
    d = e.where("event_id % 4 <> 0").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        (F.col("ts") + F.make_interval(secs=F.rint(F.col("value") * 60))).alias("decided_at"),
        text.lookup(F.col("event_id") % 3, {0: "allow", 1: "skip"}, "allow_rest").alias("verdict"))
    return h, d


@query("hold_decision", f"WITH {HELD} " + """
SELECT h.run_id, h.seq, CASE WHEN verdict IN ('allow','allow_rest') THEN 'send' ELSE 'skip' END AS outcome, verdict IS NULL AS timed_out
FROM h LEFT JOIN d ON d.run_id = h.run_id AND d.seq = h.seq AND decided_at BETWEEN held_at AND held_at + INTERVAL 900 SECOND""")
def hold_decision(spark, sf):
    return control.held_outcomes(*held(spark, sf)).select("run_id", "seq", "outcome", "timed_out")


@query("pending_requests", f"WITH {HELD} SELECT h.run_id, h.seq FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = h.run_id AND d.seq = h.seq)")
def pending_requests(spark, sf):
    return control.pending_requests(*held(spark, sf)).select("run_id", "seq")


# ---- passive checks over stored pages ------------------------------------------------------------------
@query("passive_findings", """
WITH p AS (SELECT *, page_id % 3 AS h, page_id % 4 AS c, page_id % 5 AS e, CASE WHEN page_id % 2 = 0 THEN 'https://x' ELSE 'http://x' END AS base FROM pages)
SELECT page_id AS run_id, rule, detail FROM (
  SELECT page_id, 'dast.missing-headers' AS rule, concat(CASE WHEN h = 0 THEN 'Content-Security-Policy, ' ELSE '' END,
    'X-Content-Type-Options (nosniff), X-Frame-Options, Referrer-Policy', CASE WHEN page_id % 2 = 0 THEN ', Strict-Transport-Security' ELSE '' END) AS detail FROM p
  UNION ALL SELECT page_id, 'dast.cookie-flags', 'HttpOnly/SameSite' FROM p WHERE c = 0
  UNION ALL SELECT page_id, 'dast.error-disclosure', concat(trim(right(concat(html, ' '), 60), E' \\t\\n\\r'), ' Exception in thread') FROM p WHERE e = 0
  UNION ALL SELECT page_id, 'dast.database-error', 'SQLSTATE' FROM p WHERE e = 1)""")
def passive_findings(spark, sf):
    pid = F.col("page_id")
    h = F.map_from_entries(F.array_compact(F.array(
        F.when(pid % 3 != 0, F.struct(F.lit("Content-Security-Policy"), F.lit("self"))),
        F.when(pid % 4 == 0, F.struct(F.lit("Set-Cookie"), F.lit("a=1; Secure"))),
        F.struct(F.lit("Server"), F.lit("x")))))
    mark = text.lookup(pid % 5, {0: " Exception in thread", 1: " SQLSTATE[42000]"}, "")
    rows = table(spark, sf, "pages").select(
        pid.alias("run_id"), "url", F.when(pid % 2 == 0, "https://x").otherwise("http://x")
        .alias("base_url"), F.lit(500).alias("status"), h.alias("headers"),
        F.concat("html", mark).alias("body"))
    return responses.passive_findings(rows).select("run_id", "rule", "detail")


@query("redacted_headers", """
SELECT page_id, concat('a=', url, ';Authorization=<redacted>;COOKIE=<redacted>;x-page=', page_id) AS headers FROM pages""")
def redacted_headers(spark, sf):
    h = text.redact_headers(F.map_from_arrays(F.array(*[F.lit(k) for k in ("a", "Authorization", "COOKIE", "x-page")]),
                                              F.array(F.col("url"), F.col("html"), F.lit("s=1"), F.col("page_id").cast("string"))))
    shown = F.transform(F.map_entries(h), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "pages").select("page_id", F.array_join(shown, ";").alias("headers"))


# ---- run policies ---------------------------------------------------------------------------------------
@query("run_modes", """
SELECT c_custkey AS target_id, CASE WHEN c_custkey % 3 = 0 THEN 'active_scan' WHEN c_custkey % 3 = 1 THEN 'access_control' ELSE 'access_control,active_scan' END AS checks,
  c_custkey % 4 = 0 AS require_approval FROM customer""")
def run_modes(spark, sf):
    return responses.normalize_modes(targets(spark, sf)).select(
        "target_id", F.array_join("allowed_checks", ",").alias("checks"), "require_approval")


def targets(spark, sf):
    k = F.col("c_custkey")
    s = lambda *v: F.array(*[F.lit(x) for x in v])
    return table(spark, sf, "customer").select(
        k.alias("target_id"), F.lit(None).cast("boolean").alias("auto_run"),
        F.lit(None).cast("boolean").alias("auto_run_active"),
        F.when(k % 4 == 0, True).alias("require_approval"),
        F.when(k % 3 == 0, s("active_scan", "bogus")).when(k % 3 == 1, s("bogus"))
        .otherwise(s("access_control", "active_scan")).alias("allowed_checks"))


@query("run_decisions", """
WITH q AS (SELECT o_orderkey AS seq, o_orderkey % 3000 AS scan_id, o_custkey AS target_id, o_orderkey % 5 = 0 AS active FROM orders),
b AS (SELECT DISTINCT o_orderkey % 3000 AS scan_id FROM orders WHERE o_orderkey % 3000 % 17 = 0),
r AS (SELECT q.*, active AND target_id % 3 = 1 AS refused, b.scan_id IS NOT NULL AS busy FROM q LEFT JOIN b USING (scan_id)),
f AS (SELECT scan_id, min(seq) AS first FROM r WHERE NOT refused AND NOT busy GROUP BY 1)
SELECT seq, CASE WHEN refused THEN 'refused' WHEN busy OR seq > first THEN 'already_active' WHEN target_id % 4 = 0 THEN 'pending_approval' ELSE 'queued' END AS decision
FROM r LEFT JOIN f USING (scan_id)""")
def run_decisions(spark, sf):
    o = table(spark, sf, "orders")
    req = o.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3000).alias("scan_id"),
                   F.col("o_custkey").alias("target_id"),
                   (F.col("o_orderkey") % 5 == 0).alias("active_scan"), F.lit("bad").alias("intercept"))
    runs = o.select((F.col("o_orderkey") % 3000).alias("scan_id")).distinct().select(
        "scan_id", F.when(F.col("scan_id") % 17 == 0, "running").otherwise("completed").alias("status"))
    return responses.decide_runs(req, targets(spark, sf), runs).select("seq", "decision")


@query("new_dynamic", """
WITH f AS (SELECT scan_id, title, endpoint, min(finding_id) AS finding_id FROM v_findings WHERE source IN ('dast','access') AND scan_id % 2 = 0 GROUP BY 1, 2, 3)
SELECT f.scan_id, f.title, f.endpoint, f.finding_id FROM f WHERE NOT EXISTS (SELECT 1 FROM v_findings s WHERE s.source IN ('semgrep','ai')
  AND s.scan_id = f.scan_id AND s.title IS NOT DISTINCT FROM f.title AND s.endpoint IS NOT DISTINCT FROM f.endpoint)""")
def new_dynamic(spark, sf):
    f = view(spark, sf, "v_findings")
    found = f.where("source in ('dast', 'access') and scan_id % 2 = 0").select(
        "scan_id", "title", "endpoint", "finding_id", F.col("finding_id").alias("ord"))
    stored = f.where("source in ('semgrep', 'ai')").select("scan_id", "title", "endpoint")
    return responses.new_dynamic_findings(found, stored).select("scan_id", "title", "endpoint",
                                                                "finding_id")


# Routes of a scan, by the parts it names; findings point at them by id, by label, or at nothing.
VIEWS["v_scan_routes"] = """
SELECT DISTINCT l_orderkey AS scan_id, concat('e', l_partkey % 30) AS endpoint_id, CASE l_partkey % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method,
  concat('/r', l_partkey % 30, CASE l_partkey % 2 WHEN 0 THEN '/{id}' ELSE '' END) AS path, CASE l_partkey % 2 WHEN 0 THEN 'id' END AS param
FROM @lineitem WHERE l_linenumber % 3 <> 0"""


@query("finding_requests", """
WITH f AS (SELECT v.*, CASE WHEN line_start % 2 = 0 THEN concat('e', line_end % 30) END AS endpoint_id FROM v_findings v),
j AS (SELECT f.finding_id, coalesce(f.endpoint, concat_ws(' ', r.method, r.path)) AS label, r.param FROM f LEFT JOIN v_scan_routes r
  ON r.scan_id = f.scan_id AND r.endpoint_id = f.endpoint_id)
SELECT finding_id, CASE upper(split_part(label, ' ', 1)) WHEN 'ANY' THEN 'GET' ELSE upper(split_part(label, ' ', 1)) END AS method,
  split_part(label, ' ', 2) AS path, coalesce(param, '') AS id_params FROM j WHERE label <> ''""")
def finding_requests(spark, sf):
    f = view(spark, sf, "v_findings").withColumn("endpoint_id", F.when(
        F.col("line_start") % 2 == 0, F.concat(F.lit("e"), F.col("line_end") % 30)))
    eps = view(spark, sf, "v_scan_routes").withColumn("id_params", F.array_compact(F.array("param"))).drop("param")
    return responses.finding_requests(f, eps).select("finding_id", "method", "path", F.array_join("id_params", ",").alias("id_params"))


# ---- event log ----------------------------------------------------------------------------------------
def events(spark, sf):
    return view(spark, sf, "v_events")


VIEWS["v_feed"] = """
SELECT scan_id, seq, ts, CASE WHEN type = 'failed' AND event_id % 9 <> 0 THEN 'stage' ELSE type END AS type, stage,
  CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'done' END AS state,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INT) END AS done, CAST(100 AS INT) AS total,
  CASE WHEN type = 'status' THEN concat('s', event_id % 4) END AS status,
  CASE WHEN type = 'log' AND event_id % 5 = 0 THEN 'paused' WHEN type = 'log' AND event_id % 5 = 1 THEN 'resume' END AS control,
  CASE WHEN type = 'log' AND event_id % 5 = 2 THEN event_id END AS tokens, concat('t', event_id % 7, ' ') AS text FROM v_events"""


def feed(spark, sf):
    return view(spark, sf, "v_feed")


@query("event_sequence", "SELECT event_id, scan_id, seq FROM v_events")
def event_sequence(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("scan_id"), "ts")
    return ev.sequenced(e).select("event_id", "scan_id", "seq")


@query("persisted_events", "SELECT event_id FROM v_events WHERE type <> 'token'")
def persisted_events(spark, sf):
    return ev.persisted(events(spark, sf)).select("event_id")


@query("retained_events", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY scan_id ORDER BY seq DESC) AS b FROM v_events) WHERE b <= 50""")
def retained_events(spark, sf):
    return ev.retained(events(spark, sf), n=50).select("event_id")


@query("terminal_cut", """
SELECT e.scan_id, e.seq, e.type FROM v_feed e LEFT JOIN (SELECT scan_id, min(seq) AS s FROM v_feed
  WHERE type IN ('done','failed','canceled') GROUP BY 1) t USING (scan_id) WHERE s IS NULL OR seq <= s""")
def terminal_cut(spark, sf):
    return ev.until_terminal(feed(spark, sf)).select("scan_id", "seq", "type")


@query("stage_board", """
SELECT scan_id, stage, CASE WHEN coalesce(state, 'pending') IN ('pending','running') THEN 'skipped' ELSE state END AS state, done, total FROM (
  SELECT scan_id, stage, max_by(state, seq) FILTER (state IS NOT NULL) AS state, max_by(done, seq) FILTER (done IS NOT NULL) AS done,
    max_by(total, seq) AS total FROM v_feed GROUP BY 1, 2)""")
def stage_board(spark, sf):
    return ev.stage_board(feed(spark, sf)).drop("stage_order")


@query("stage_progress", "SELECT scan_id, stage, max(done) AS done, max(total) AS total FROM v_feed GROUP BY 1, 2")
def stage_progress(spark, sf):
    return ev.stage_progress(feed(spark, sf))


@query("live_status", """
SELECT scan_id, max_by(CASE WHEN type = 'failed' THEN 'failed' ELSE status END, seq) FILTER (type IN ('failed','status')) AS status,
  coalesce(max_by(CASE WHEN type = 'failed' OR control = 'resume' THEN FALSE ELSE TRUE END, seq) FILTER (type = 'failed' OR control IS NOT NULL), FALSE) AS paused,
  max_by(tokens, seq) FILTER (tokens IS NOT NULL) AS tokens FROM v_feed GROUP BY 1""")
def live_status(spark, sf):
    f = feed(spark, sf).withColumn("type", F.when(F.col("control").isNotNull(), "control").when(
        F.col("tokens").isNotNull(), "tokens").otherwise(F.col("type")))
    return ev.live_status(f)


@query("narration", """
SELECT conv_id AS scan_id, turn // 2 AS chunk, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""")
def narration(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("scan_id"),
                                                 F.col("turn").alias("seq"), "text")
    return ev.narration(t, chunk=2)


# ---- work units -----------------------------------------------------------------------------------------
VIEWS["v_units"] = """
SELECT user_id AS scan_id, CASE event_type WHEN 'error' THEN 'inputs' WHEN 'click' THEN 'review' ELSE 'verify' END AS phase,
  concat('k', event_id % 40) AS chunk_key, ts AS finished_at, event_id % 3 <> 0 OR user_id % 5 = 0 AS failed, event_id FROM @events"""


@query("completed_units", """
SELECT scan_id, phase, count(*) AS completed, bool_or(bool_or(phase <> 'inputs')) OVER (PARTITION BY scan_id) AS resumable
FROM v_units GROUP BY 1, 2""")
def completed_units(spark, sf):
    return rollups.completed_units(view(spark, sf, "v_units"))


@query("resume_units", """
WITH p AS (SELECT DISTINCT user_id AS scan_id, 'review' AS phase, concat('k', event_id % 40) AS chunk_key FROM events)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM v_units u WHERE u.scan_id = p.scan_id AND u.phase = p.phase AND u.chunk_key = p.chunk_key)""")
def resume_units(spark, sf):
    planned = table(spark, sf, "events").select(
        F.col("user_id").alias("scan_id"), F.lit("review").alias("phase"),
        F.concat(F.lit("k"), F.col("event_id") % 40).alias("chunk_key")).distinct()
    return rollups.remaining_units(planned, view(spark, sf, "v_units"))


@query("review_health", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY finished_at, chunk_key) AS n FROM v_units)
SELECT scan_id, count(*) AS units, count(*) FILTER (failed) AS failed_units,
  bool_and(failed) FILTER (n <= 8) AND count(*) >= 8 AS stop_early FROM r GROUP BY 1""")
def review_health(spark, sf):
    return rollups.review_health(view(spark, sf, "v_units"))


@query("unreviewed_files", """
SELECT artifact_id, path, count(DISTINCT reviewer) AS reviewers_failed FROM (SELECT event_id % 20 AS artifact_id, concat('f', event_id % 700) AS path,
  user_id % 3 AS reviewer FROM events WHERE event_type <> 'click') GROUP BY 1, 2 HAVING count(DISTINCT reviewer) = 3""")
def unreviewed_files(spark, sf):
    f = table(spark, sf, "events").where("event_type <> 'click'").select(
        (F.col("event_id") % 20).alias("artifact_id"),
        F.concat(F.lit("f"), F.col("event_id") % 700).alias("path"),
        (F.col("user_id") % 3).alias("reviewer"))
    return rollups.unreviewed_files(f, 3)


@query("merged_counters", """
SELECT type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT type, count(*) AS n FROM v_events GROUP BY 1
  UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'log' ELSE 'other' END, count(*) FROM lineitem GROUP BY 1) GROUP BY 1""")
def merged_counters(spark, sf):
    a = events(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "lineitem").groupBy(F.when(
        F.col("l_returnflag") == "R", "log").otherwise("other").alias("type")).agg(
        F.count(F.lit(1)).alias("n"))
    return rollups.merge_counters(a, b, by=["type"])
