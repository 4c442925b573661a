"""Queries over scanner documents, exports and reports."""

from pyspark.sql import functions as F

from auditspan.operators import lifecycle, rollups
from auditspan.sources import results, sinks

from .base import VIEWS, query, table, view
from .findings import findings

# ---- scanner documents: one JSON document per scan line ------------------------------------------
c = F.col


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("scan_id"), c("l_linenumber").cast("int").alias("n"),
        c("l_partkey").alias("p"), c("l_suppkey").alias("s"),
        c("l_quantity").cast("int").alias("q"))


@query("sast_results", """
SELECT l_orderkey AS scan_id, concat('rule.', l_partkey % 9) AS rule,
  CASE l_suppkey % 3 WHEN 0 THEN 'first line' ELSE concat('rule.', l_partkey % 9) END AS title,
  CASE l_partkey % 3 WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
  CASE l_suppkey % 2 WHEN 0 THEN concat('CWE-', l_suppkey % 7) ELSE 'CWE-1: one' END AS cwe,
  concat('src/f', l_partkey % 5, '.py') AS file_path, CAST(l_quantity AS INT) AS line_start,
  CASE l_linenumber % 2 WHEN 0 THEN '' ELSE concat('x = ', l_partkey) END AS code_snippet
FROM lineitem WHERE l_partkey % 3 <> 0""")
def sast_results(spark, sf):
    meta = F.struct(
        F.when(c("s") % 2 == 0, F.to_json(F.array(F.concat(F.lit("CWE-"), c("s") % 7), F.lit("z"))))
        .alias("cwe"), F.when(c("s") % 2 == 1, "CWE-1: one").alias("cwe1"),
        F.when(c("s") % 3 == 0, "first line\nsecond").alias("shortDescription"))
    row = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("rule."), c("p") % 9).alias("check_id"),
        F.concat(F.lit("./src/f"), c("p") % 5, F.lit(".py")).alias("path"),
        F.struct(c("q").alias("line")).alias("start"), F.struct(c("q").alias("line")).alias("end"),
        F.struct(F.when(c("n") % 2 == 0, " requires login\n").otherwise(
            F.concat(F.lit("x = "), c("p"))).alias("lines"), F.lit("m").alias("message"),
            F.when(c("p") % 3 == 0, "INFO").when(c("p") % 3 == 1, "WARNING").otherwise("ERROR")
            .alias("severity"), meta.alias("metadata")).alias("extra"))).alias("results")))
    # a list stays a JSON list, a plain CWE a JSON string
    docs = _lines(spark, sf).select("scan_id", F.replace(F.regexp_replace(
        row, r'"cwe":"(\[.*?\])"', '"cwe":$1'), F.lit('"cwe1"'), F.lit('"cwe"')).alias("json"))
    docs = docs.withColumn("json", F.regexp_replace("json", r'\\"', '"'))
    return results.sast_candidates(docs).select(
        "scan_id", "rule", "title", "severity", "cwe", "file_path", "line_start", "code_snippet")


@query("quality_issues", """
SELECT l_orderkey AS scan_id, concat('r', l_partkey % 9) AS rule, CASE l_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS severity,
  CASE WHEN l_suppkey % 2 = 0 THEN concat('CWE-', l_suppkey) END AS cwe, CASE WHEN l_suppkey % 3 = 0 THEN 'A3' END AS owasp,
  CASE l_linenumber % 2 WHEN 0 THEN 'vulnerability' ELSE 'code_smell' END AS category,
  CASE l_partkey % 2 WHEN 0 THEN concat('a:b/', l_partkey, '.java') ELSE concat(l_partkey, '.java') END AS file_path, CAST(l_quantity AS INT) AS line_start
FROM lineitem""")
def quality_issues(spark, sf):
    tags = F.array_compact(F.array(
        F.lit("bug"), F.when(c("s") % 2 == 0, F.concat(F.lit("CWE-"), c("s"))),
        F.when(c("s") % 3 == 0, "owasp-a3")))
    row = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("r"), c("p") % 9).alias("rule"), F.lit("msg").alias("message"),
        F.when(c("p") % 4 == 0, "BLOCKER").when(c("p") % 4 == 1, "CRITICAL").when(
            c("p") % 4 == 2, "MINOR").alias("severity"),
        F.concat(F.when(c("p") % 2 == 0, "key:a:b/").otherwise(""), c("p"), F.lit(".java"))
        .alias("component"), c("q").alias("line"),
        F.when(c("n") % 2 == 0, "VULNERABILITY").alias("type"), tags.alias("tags")))
        .alias("issues")))
    docs = _lines(spark, sf).select("scan_id", row.alias("json"))
    return results.quality_candidates(docs).select(
        "scan_id", "rule", "severity", "cwe", "owasp", "category", "file_path", "line_start")


@query("hotspots", """
SELECT l_orderkey AS scan_id, CASE l_partkey % 2 WHEN 0 THEN concat('rk', l_partkey) ELSE concat('k', l_partkey) END AS rule,
  CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, 'security_hotspot' AS category,
  CASE l_linenumber % 2 WHEN 0 THEN 'look here' ELSE 'Security Hotspot' END AS title, 'x.py' AS file_path FROM lineitem""")
def hotspots(spark, sf):
    row = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("k"), c("p")).alias("key"),
        F.when(c("p") % 2 == 0, F.concat(F.lit("rk"), c("p"))).alias("ruleKey"),
        F.lit("proj:x.py").alias("component"), F.when(c("n") % 2 == 0, "look here").alias("message"),
        F.when(c("s") % 3 == 0, "HIGH").when(c("s") % 3 == 1, "LOW").alias("vulnerabilityProbability"),
        c("q").alias("line"))).alias("hotspots")))
    docs = _lines(spark, sf).select("scan_id", row.alias("json"))
    return results.hotspot_candidates(docs).select("scan_id", "rule", "severity", "category",
                                                   "title", "file_path")


@query("tool_results", """
SELECT l_orderkey AS scan_id, 'tool' AS source, concat('r', l_partkey % 5) AS rule, 'T' AS title, CASE l_suppkey % 2 WHEN 0 THEN 'high' ELSE 'medium' END AS severity,
  'sast' AS category, concat('f', l_partkey) AS file_path, CAST(l_quantity AS INT) AS line_start FROM lineitem""")
def tool_results(spark, sf):
    a = F.struct(F.concat(F.lit("r"), c("p") % 5).alias("rule"), F.lit("T").alias("title"),
                 F.when(c("s") % 2 == 0, "HIGH").alias("severity"),
                 F.concat(F.lit("f"), c("p")).alias("file_path"), c("q").alias("line_start"))
    b = F.struct(F.concat(F.lit("r"), c("p") % 5).alias("check_id"), F.lit("T").alias("message"),
                 F.when(c("s") % 2 == 0, "HIGH").alias("severity"),
                 F.concat(F.lit("f"), c("p")).alias("path"), c("q").alias("line"))
    doc = F.when(c("n") % 2 == 0, F.to_json(F.struct(F.array(a).alias("findings")))).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.lit("json").alias("type"), F.struct(
            F.array(b).alias("findings")).alias("json"))).alias("content"))))
    docs = _lines(spark, sf).select("scan_id", doc.alias("json"))
    return results.tool_candidates(docs, "tool", "sast").select(
        "scan_id", "source", "rule", "title", "severity", "category", "file_path", "line_start")


@query("dynamic_issues", """
SELECT page_id AS scan_id, CASE page_id % 3 WHEN 0 THEN concat('n', page_id) ELSE 'Issue' END AS title, CASE page_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
  CASE page_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence, CASE page_id % 2 WHEN 0 THEN 'CWE-79' ELSE 'CWE-1' END AS cwe, url AS endpoint,
  md5(left(trim(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), E' \\t\\n\\r'), 4000)) AS description_hash, 'proof' AS code_snippet FROM pages""")
def dynamic_issues(spark, sf):
    k = c("page_id")
    issue = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("n"), k)).alias("name"),
        F.when(k % 4 == 0, "Information").when(k % 4 == 1, "HIGH").alias("severity"),
        F.when(k % 3 == 0, "Certain").when(k % 3 == 1, "firm").alias("confidence"),
        F.when(k % 2 == 0, c("url")).alias("url"), c("url").alias("origin"),
        c("html").alias("issue_detail"), F.lit("  ").alias("evidence"), F.lit("proof").alias("proof"),
        F.when(k % 2 == 0, "CWE-79").alias("cwe"),
        F.lit("CWE-1").alias("vulnerability_classifications"))
    doc = F.to_json(F.struct(F.array(issue).alias("scan_issues")))
    docs = table(spark, sf, "pages").select(k.alias("scan_id"), doc.alias("json"))
    return results.dynamic_findings(docs).select(
        "scan_id", "title", "severity", "confidence", "cwe", "endpoint",
        F.md5(c("description").cast("binary")).alias("description_hash"), "code_snippet")


# ---- exports --------------------------------------------------------------------------------------------
SARIF = """
WITH r AS (SELECT scan_id, coalesce(cwe, replace(lower(title), ' ', '-')) AS rule_id, min(finding_id) AS first FROM v_findings GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY first) - 1 AS rule_index FROM r)"""


@query("sarif_rules", SARIF + " SELECT scan_id, rule_id, rule_index FROM i")
def sarif_rules(spark, sf):
    return sinks.sarif_rules(findings(spark, sf)).select("scan_id", "rule_id", "rule_index")


@query("sarif_results", SARIF + """
SELECT f.scan_id, f.finding_id, i.rule_id, i.rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level
FROM v_findings f JOIN i ON i.scan_id = f.scan_id AND i.rule_id = coalesce(cwe, replace(lower(title), ' ', '-'))""")
def sarif_results(spark, sf):
    f = findings(spark, sf)
    return sinks.sarif_results(f, sinks.sarif_rules(f)).select(
        "scan_id", "finding_id", "rule_id", "rule_index", "level")


# a document's text, piece by piece; no title holds a quote
_HEAD = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0",'
         '"runs":[{"tool":{"driver":{"name":"auditspan","version":"1.0.0","rules":[')
SARIF_TEXT = SARIF + f""",
t AS (SELECT i.*, f.title FROM i JOIN (SELECT scan_id, finding_id, min(title) AS title FROM v_findings GROUP BY 1, 2) f ON f.scan_id = i.scan_id AND f.finding_id = i.first),
s AS (SELECT scan_id, min(finding_id) AS first FROM v_findings GROUP BY 1)
SELECT scan_id, 0 AS section, '' AS ord, '{_HEAD}' AS text FROM s
UNION ALL SELECT scan_id, 1, lpad(CAST(rule_index AS VARCHAR), 12, '0'), concat(CASE WHEN rule_index > 0 THEN ',' ELSE '' END,
  '{{"id":"', rule_id, '","shortDescription":{{"text":"', title, '"}}}}') FROM t
UNION ALL SELECT scan_id, 2, '', ']}}}},"results":[' FROM s
UNION ALL SELECT f.scan_id, 3, f.finding_id, concat(CASE WHEN f.finding_id > s.first THEN ',' ELSE '' END, '{{"ruleId":"', i.rule_id, '","ruleIndex":', i.rule_index,
  ',"level":"', CASE f.severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END,
  '","message":{{"text":"', f.title, '"}},"properties":{{"severity":"', f.severity, '","confidence":', CAST(CAST(f.confidence AS DOUBLE) AS VARCHAR),
  ',"state":"', f.state, '","source":"', f.source, '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', f.file_path, '"}}',
  CASE WHEN f.line_start IS NULL THEN '' ELSE concat(',"region":{{"startLine":', f.line_start, ',"endLine":', f.line_end, '}}') END, '}}}}]}}')
  FROM v_findings f JOIN s USING (scan_id) JOIN i ON i.scan_id = f.scan_id AND i.rule_id = coalesce(cwe, replace(lower(f.title), ' ', '-'))
UNION ALL SELECT scan_id, 4, '', ']}}]}}' FROM s"""


@query("sarif_fragments", SARIF_TEXT)
def sarif_fragments(spark, sf):
    """Text fragments of one SARIF document per scan (also parsed in the tests)."""
    return sinks.sarif_fragments(findings(spark, sf).withColumn("confidence", c("confidence").cast("double")))


@query("findings_csv", """
SELECT scan_id, title, severity, state, source, coalesce(cwe, '') AS cwe, coalesce(category, '') AS category, file_path,
  coalesce(CAST(line_start AS VARCHAR), '') AS line_start, coalesce(code_snippet, '') AS code_snippet, '' AS remediation FROM v_findings WHERE state <> 'dismissed'""")
def findings_csv(spark, sf):
    return sinks.findings_csv(findings(spark, sf)).select(
        "scan_id", "title", "severity", "state", "source", "cwe", "category", "file_path",
        "line_start", "code_snippet", "remediation")


@query("issue_rows", """
SELECT scan_id, CAST(CAST(concat('0x', left(md5(finding_id), 12)) AS BIGINT) AS VARCHAR) AS "serialNumber", coalesce(cwe, '134217728') AS type,
  concat(file_path, CASE WHEN line_start IS NULL THEN '' ELSE concat(':', line_start) END) AS location,
  CASE severity WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Information' END AS severity,
  CASE WHEN confidence > 0.8 THEN 'Certain' WHEN confidence > 0.5 THEN 'Firm' ELSE 'Tentative' END AS confidence,
  concat_ws(concat(chr(10), chr(10)), concat('Code:', chr(10), nullif(code_snippet, '')) || CASE WHEN code_snippet IS NULL THEN NULL ELSE '' END,
    'CWE: ' || cwe) AS "issueDetail" FROM v_findings WHERE state <> 'dismissed'""")
def issue_rows(spark, sf):
    return sinks.issue_rows(findings(spark, sf)).select(
        "scan_id", "serialNumber", "type", "location", "severity", "confidence", "issueDetail")


# ---- coverage and targeted review --------------------------------------------------------------------------
COUNTERS = """
SELECT o_orderkey AS scan_id, 100 AS files_total, 90 + o_orderkey % 11 AS files_loaded, o_orderkey % 3 AS files_unreviewed,
  50 AS static_candidates, o_orderkey % 40 AS candidates_addressed, o_orderkey % 10 AS candidates_triaged, o_orderkey % 2 AS candidates_over_cap,
  0 AS candidates_missing, 5 AS second_look_files, o_orderkey % 4 AS second_look_findings, o_orderkey % 9 AS true_positive, 1 AS false_positive,
  2 AS uncertain, 0 AS verify_over_cap, o_orderkey % 5 AS not_verified, 20 AS endpoints_total, 18 + o_orderkey % 3 AS endpoints_assessed FROM @orders"""
VIEWS["v_counters"] = COUNTERS


@query("coverage_report", """
SELECT scan_id, concat(files_loaded - files_unreviewed, '/', files_total) AS files_reviewed,
  concat(candidates_addressed + candidates_triaged, '/', static_candidates) AS hits_with_verdict,
  concat(second_look_files, ' (', second_look_findings, ' new)') AS second_look,
  concat(endpoints_assessed, '/', endpoints_total) AS endpoints_assessed,
  CAST((files_unreviewed > 0) AS INT) + CAST((files_total > files_loaded) AS INT) + CAST((candidates_over_cap > 0) AS INT)
   + CAST((not_verified > 0) AS INT) + CAST((endpoints_total > endpoints_assessed) AS INT) AS n_gaps FROM v_counters""")
def coverage_report(spark, sf):
    return rollups.coverage_report(view(spark, sf, "v_counters")).select(
        "scan_id", "files_reviewed", "hits_with_verdict", "second_look", "endpoints_assessed",
        F.size("gaps").alias("n_gaps"))


@query("targeted_files", """
WITH f AS (SELECT doc_id, artifact_id, path FROM v_files), m AS (SELECT artifact_id, path FROM f WHERE doc_id % 7 = 0 AND artifact_id <> 'src3')
SELECT doc_id FROM f WHERE EXISTS (SELECT 1 FROM m WHERE m.artifact_id = f.artifact_id AND m.path = f.path)
  OR NOT EXISTS (SELECT 1 FROM m WHERE m.artifact_id = f.artifact_id)""")
def targeted_files(spark, sf):
    files = view(spark, sf, "v_files").select("doc_id", "artifact_id", "path")
    named = files.where("doc_id % 7 = 0 and artifact_id <> 'src3'")
    cands = named.where("doc_id % 2 = 0").select("artifact_id", c("path").alias("file_path"))
    eps = named.where("doc_id % 2 = 1").select(
        "artifact_id", F.lit(None).cast("string").alias("file_path"), c("path").alias("handler_file"))
    return lifecycle.targeted_files(files, cands, eps).select("doc_id")
