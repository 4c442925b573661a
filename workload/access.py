"""Queries over routes: extraction, access map, flags, exports."""

from pyspark.sql import functions as F

from auditspan.functions import fixed, routes as rx
from auditspan.operators import access_flags, access_map, packing, rollups, routes, verdicts
from auditspan.operators.ordered import pin
from auditspan.sources import sinks

from .base import VIEWS, query, quoted, view
from .corpus import code

# One FastAPI route of four lines per part, 40 routes a file, 200 parts an artifact.
# In every second artifact few routes carry a visible login.
VIEWS["v_api_parts"] = """
SELECT k, concat('art', CAST(floor(k / 200) AS BIGINT)) AS artifact_id, concat('svc', CAST(floor(k / 40) AS BIGINT), '/api.py') AS file_path,
  4 * (row_number() OVER (PARTITION BY CAST(floor(k / 40) AS BIGINT) ORDER BY k) - 1) + 1 AS line,
  verb, upper(verb) AS method, concat('/', stem, CASE size % 3 WHEN 0 THEN '/{id}' WHEN 1 THEN '/{item_uuid}' ELSE '' END) AS path,
  concat('/', stem) AS resource, size,
  CASE WHEN CAST(floor(k / 200) AS BIGINT) % 2 = 0 THEN size % 4 < 2 ELSE size % 8 < 1 END AS has_user, size % 7 = 0 AS owned
FROM v_code_parts"""
VIEWS["v_api_lines"] = """
SELECT artifact_id, file_path AS path, line + n AS line_no, CASE n WHEN 0 THEN concat('@router.', verb, '("', path, '")')
  WHEN 1 THEN concat('async def h', k, '(', CASE WHEN has_user THEN 'current_user = Depends(get_current_user)' ELSE 'body: dict' END, '):')
  WHEN 2 THEN CASE WHEN owned THEN '    return q.filter(Item.user_id == current_user.id)' ELSE '    return db.get(Item, id)' END
  ELSE '' END AS text
FROM v_api_parts CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"""
# What the map must say about each route, straight from the parts.
VIEWS["v_api_facts"] = """
SELECT *, CASE WHEN has_user OR owned THEN 'route' ELSE 'none' END AS scope,
  method <> 'GET' AS changing, size % 5 = 0 AS priv, size % 5 = 1 AS public,
  CASE size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'uuid' END AS kind, concat(method, ' ', path) AS endpoint
FROM v_api_parts"""
VIEWS["v_api_risk"] = """
SELECT *, CASE WHEN scope = 'none' AND NOT public AND (changing OR priv) THEN 'high' WHEN priv THEN 'high'
  WHEN (scope = 'none' AND NOT public AND priv) OR (kind = 'unknown' AND NOT owned AND NOT public) THEN 'medium'
  ELSE 'low' END AS heuristic_risk FROM v_api_facts"""

def api_files(spark, sf):
    """Derived API files; a file holds at most 160 lines."""
    return view(spark, sf, "v_api_lines").groupBy("artifact_id", "path").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(
            "line_no", "text"))), lambda x: x["text"])).alias("content"))


def fresh_map(spark, sf):
    files = pin(api_files(spark, sf))  # a corpus is a stored table
    found = pin(routes.extract_routes(files))
    return access_map.access_map(found, files, access_map.global_context(files))


def endpoints(spark, sf):
    """The map as a stored table, for queries that read it more than once."""
    return pin(fresh_map(spark, sf))


# ---- extraction -----------------------------------------------------------------------------
def _one(pattern, method, path, handler="NULL", when="TRUE"):
    return pattern, method, path, handler, when


def _x(p, g):
    return f"nullif(regexp_extract(text, {quoted(p)}, {g}), '')"


_BELOW = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(lead(text, {i}) OVER w, {quoted(fixed.FUNCTION_BELOW)}, 1), '')"
    for i in range(1, 5)) + ")"
_HINTS = ("CAST(coalesce(sum(len(regexp_extract_all(text, " + quoted(fixed.ROUTE_AUTH_HINT) + "))) OVER "
          "(PARTITION BY artifact_id, path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS INT)")
_PATS = {
    ".py": [("fastapi", fixed.FASTAPI_ROUTE, f"upper({_x(fixed.FASTAPI_ROUTE, 1)})", _x(fixed.FASTAPI_ROUTE, 2), "below")],
    "_web.py": [("flask", fixed.FLASK_ROUTE, None, _x(fixed.FLASK_ROUTE, 1), "below")],
    ".js": [("express", fixed.EXPRESS_ROUTE, f"upper({_x(fixed.EXPRESS_ROUTE, 1)})", _x(fixed.EXPRESS_ROUTE, 2), _x(fixed.EXPRESS_ROUTE, 3))],
    ".java": [("spring", fixed.SPRING_MAPPING, f"upper({_x(fixed.SPRING_MAPPING, 1)})", _x(fixed.SPRING_MAPPING, 2), "below")],
    ".go": [("gin", fixed.GIN_ROUTE, f"upper({_x(fixed.GIN_ROUTE, 1)})", _x(fixed.GIN_ROUTE, 2), _x(fixed.GIN_ROUTE, 3))],
    ".php": [("laravel", fixed.LARAVEL_ROUTE, f"upper({_x(fixed.LARAVEL_ROUTE, 1)})", _x(fixed.LARAVEL_ROUTE, 2),
              f"concat({_x(fixed.LARAVEL_ROUTE, 3)}, '@', {_x(fixed.LARAVEL_ROUTE, 4)})")],
    ".rb": [("rails", fixed.RAILS_VERB, f"upper({_x(fixed.RAILS_VERB, 1)})", _x(fixed.RAILS_VERB, 2), _x(fixed.RAILS_VERB, 3))],
    ".cs": [("aspnet", fixed.ASPNET_HTTP, f"upper({_x(fixed.ASPNET_HTTP, 1)})", _x(fixed.ASPNET_HTTP, 2), "below")],
}


def _extract_sql():
    parts = []
    for ext, pats in _PATS.items():
        for fw, pat, method, path, handler in pats:
            m = "unnest(['GET', 'POST'])" if method is None else method
            parts.append(f"SELECT artifact_id, path AS file_path, line_no - lo + 1 AS line, '{fw}' AS framework, {m} AS method, "
                         f"{path} AS path, {handler} AS handler, hints AS n_hints FROM x WHERE path LIKE '%mod{ext.replace('_', '!_')}' ESCAPE '!' "
                         f"AND regexp_matches(text, {quoted(pat)})")
    return f"""
WITH x AS (SELECT *, min(line_no) OVER (PARTITION BY artifact_id, path) AS lo, {_BELOW} AS below, {_HINTS} AS hints
  FROM v_code_lines WINDOW w AS (PARTITION BY artifact_id, path ORDER BY line_no))
""" + "\nUNION ALL ".join(parts)


@query("endpoint_extract", _extract_sql())
def endpoint_extract(spark, sf):
    return routes.extract_routes(code(spark, sf)).select(
        "artifact_id", "file_path", "line", "framework", "method", "path", "handler",
        F.size("auth_hints").alias("n_hints"))


# ---- the map ----------------------------------------------------------------------------------
@query("endpoint_map", """
SELECT artifact_id, file_path, line, method, path, scope AS auth_scope, kind AS id_kind, changing AS state_changing,
  priv AS sensitive, priv AS privileged, public AS likely_public, heuristic_risk, resource,
  line + 1 AS handler_line, line AS handler_start, line + 2 AS handler_end,
  CASE WHEN has_user THEN 2 WHEN owned THEN 1 ELSE 0 END AS n_auth, CASE WHEN owned THEN 2 ELSE 0 END AS n_owner
FROM v_api_risk""")
def endpoint_map(spark, sf):
    return fresh_map(spark, sf).select(
        "artifact_id", "file_path", "line", "method", "path", "auth_scope", "id_kind",
        "state_changing", "sensitive", "privileged", "likely_public", "heuristic_risk",
        "resource", "handler_line", "handler_start", "handler_end",
        F.size("route_auth").alias("n_auth"), F.size("ownership_hints").alias("n_owner"))


FLAGS = """
WITH fam AS (SELECT artifact_id, resource, count(*) FILTER (scope = 'route') AS prot FROM v_api_facts GROUP BY 1, 2),
sys AS (SELECT artifact_id, count(*) FILTER (NOT public) AS np, count(*) FILTER (NOT public AND scope = 'none') AS lost,
  count(*) FILTER (NOT public) >= 15 AND count(*) FILTER (NOT public AND scope = 'none') / count(*) FILTER (NOT public) >= 0.6 AS systemic
  FROM v_api_facts GROUP BY 1),
e AS (SELECT f.*, s.systemic, NOT s.systemic AND scope = 'none' AND NOT public AND prot > 0 AS sib
  FROM v_api_facts f JOIN fam USING (artifact_id, resource) JOIN sys s USING (artifact_id)),
r AS (SELECT *, 1 AS o, 'access.inconsistent-authn' AS rule, CASE WHEN changing OR priv THEN 'high' ELSE 'medium' END AS severity, 0.5 AS confidence FROM e WHERE sib
  UNION ALL SELECT *, 2, 'access.missing-authn', CASE WHEN changing AND priv THEN 'high' ELSE 'medium' END, 0.35 FROM e
    WHERE NOT public AND scope = 'none' AND NOT systemic AND NOT sib AND (changing OR priv)
  UNION ALL SELECT *, 3, 'access.privileged-no-role', 'high', 0.35 FROM e WHERE NOT public AND priv
  UNION ALL SELECT *, 4, 'access.idor', CASE WHEN kind = 'uuid' THEN 'low' WHEN changing THEN 'high' ELSE 'medium' END,
    CASE WHEN kind = 'uuid' THEN 0.2 ELSE 0.3 END FROM e WHERE NOT public AND kind IS NOT NULL AND NOT owned AND NOT (kind = 'uuid' AND NOT changing)),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM r),
flags AS (SELECT artifact_id, k, endpoint, rule, severity, CAST(confidence AS DOUBLE) AS confidence, 0 AS n_affected FROM t WHERE rn <= 2
  UNION ALL SELECT artifact_id, NULL, NULL, 'access.auth-not-located', 'medium', 0.3, CAST(least(lost, 200) AS INT) FROM sys WHERE systemic)"""


@query("access_flags", FLAGS + " SELECT * EXCLUDE (k) FROM flags")
def flags(spark, sf):
    return access_flags.access_flags(endpoints(spark, sf)).select(
        "artifact_id", "endpoint", "rule", "severity", "confidence",
        F.size("affected_endpoints").alias("n_affected"))


@query("access_stats", """
SELECT artifact_id, count(*) AS endpoints, CAST(0 AS BIGINT) AS scope_public, count(*) FILTER (scope = 'route') AS scope_route,
  CAST(0 AS BIGINT) AS scope_file, CAST(0 AS BIGINT) AS scope_global, count(*) FILTER (scope = 'none') AS scope_none,
  count(*) FILTER (changing) AS state_changing, count(kind) AS with_id_params, count(*) FILTER (priv) AS privileged
FROM v_api_facts GROUP BY 1""")
def access_stats(spark, sf):
    return access_map.access_stats(fresh_map(spark, sf))


@query("auth_mechanisms", """
WITH m AS (SELECT artifact_id, 'current_user' AS mechanism FROM v_api_facts WHERE has_user OR owned
  UNION ALL SELECT artifact_id, 'get_current_user' FROM v_api_facts WHERE has_user),
c AS (SELECT artifact_id, mechanism, count(*) AS uses FROM m GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY uses DESC, mechanism) AS rn FROM c""")
def auth_mechanisms(spark, sf):
    return access_map.auth_mechanisms(fresh_map(spark, sf))


@query("sibling_groups", """
SELECT artifact_id, resource, count(*) FILTER (scope = 'route') AS protected,
  count(*) FILTER (scope = 'none' AND NOT public) AS exposed,
  left(array_to_string(list_sort(list(DISTINCT endpoint) FILTER (scope = 'route')), ', '), 300) AS protected_peers
FROM v_api_facts GROUP BY 1, 2""")
def sibling_groups(spark, sf):
    return access_flags.sibling_groups(endpoints(spark, sf)).drop("roled", "roled_peers")


@query("systemic_auth", """
SELECT artifact_id, count(*) FILTER (NOT public) AS non_public, count(*) FILTER (NOT public AND scope = 'none') AS unlocated,
  count(*) FILTER (NOT public) >= 15 AND count(*) FILTER (NOT public AND scope = 'none') / count(*) FILTER (NOT public) >= 0.6 AS systemic
FROM v_api_facts GROUP BY 1""")
def systemic_auth(spark, sf):
    return access_flags.systemic_condition(endpoints(spark, sf))


@query("unauthenticated_routes", "SELECT artifact_id, file_path, line FROM v_api_facts WHERE scope = 'none'")
def unauthenticated_routes(spark, sf):
    return access_map.unauthenticated(fresh_map(spark, sf)).select("artifact_id", "file_path",
                                                                   "line")


@query("routes_by_file", """
SELECT artifact_id, file_path, line, method, path, rn FROM (SELECT *, row_number() OVER (
  PARTITION BY artifact_id, file_path ORDER BY line) AS rn FROM v_api_facts)""")
def routes_by_file(spark, sf):
    return access_map.routes_by_file(endpoints(spark, sf)).drop("auth_scope")


@query("endpoint_ids", """
SELECT artifact_id, file_path, line, concat('e', row_number() OVER (PARTITION BY artifact_id ORDER BY file_path, line) - 1) AS endpoint_id
FROM v_api_facts""")
def endpoint_ids(spark, sf):
    return access_map.with_endpoint_ids(endpoints(spark, sf).drop("endpoint_id")).select(
        "artifact_id", "file_path", "line", "endpoint_id")


@query("endpoint_batches", """
WITH RECURSIVE o AS (SELECT artifact_id, file_path, line, row_number() OVER (PARTITION BY artifact_id ORDER BY file_path, line) AS n FROM v_api_facts),
p AS (SELECT artifact_id, file_path, line, n, 1 AS size, CAST(0 AS BIGINT) AS batch FROM o WHERE n = 1
  UNION ALL SELECT o.artifact_id, o.file_path, o.line, o.n,
    CASE WHEN p.size >= 30 OR (p.size >= 15 AND o.file_path <> p.file_path) THEN 1 ELSE p.size + 1 END,
    CASE WHEN p.size >= 30 OR (p.size >= 15 AND o.file_path <> p.file_path) THEN p.batch + 1 ELSE p.batch END
  FROM p JOIN o ON o.artifact_id = p.artifact_id AND o.n = p.n + 1)
SELECT artifact_id, file_path, line, batch FROM p""")
def endpoint_batches(spark, sf):
    eps = endpoints(spark, sf)
    placed = packing.endpoint_batches(eps, per=30)
    return placed.join(eps.select("artifact_id", "endpoint_id", "file_path", "line"),
                       ["artifact_id", "endpoint_id"]).select(
        "artifact_id", "file_path", "line", "batch")


# a setup line per part, one artifact per 500 parts, so that the cap of 200 bites
VIEWS["v_setup_lines"] = """
SELECT concat('art', CAST(floor(k / 500) AS BIGINT)) AS artifact_id, concat('boot', CAST(floor(k / 40) AS BIGINT), '.py') AS path,
  k % 40 + 1 AS line_no, CASE k % 3 WHEN 0 THEN concat('app = FastAPI(title="s', k, '", dependencies=[Depends(login)])')
    WHEN 1 THEN concat('http.permitAll("/p', k, '")') ELSE concat('x', k, ' = FastAPI()') END AS text FROM v_code_parts"""


@query("global_context", """
SELECT artifact_id, file_path, line, enforces FROM (SELECT artifact_id, path AS file_path, CAST(line_no - lo + 1 AS INT) AS line,
  contains(text, 'dependencies') AS enforces FROM (
  SELECT artifact_id, path, line_no, min(line_no) OVER (PARTITION BY artifact_id, path) AS lo, text FROM v_setup_lines) WHERE regexp_matches(text, '(?i)fastapi\\(.{0,160}dependencies|permitall'))""")
def global_context(spark, sf):
    files = view(spark, sf, "v_setup_lines").groupBy("artifact_id", "path").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(
            "line_no", "text"))), lambda x: x["text"])).alias("content"))
    return access_map.global_context(files).select("artifact_id", "file_path", "line", "enforces")


# ---- verdicts on endpoints and flags --------------------------------------------------------------
# What reviewers said about each route: valid, oddly written, unknown and missing values; none for every sixth route.
VIEWS["v_api_verdicts"] = """
SELECT artifact_id, file_path, line, k, CASE k % 6 WHEN 0 THEN 'required' WHEN 1 THEN 'Public' WHEN 2 THEN 'none' WHEN 3 THEN 'odd' END AS authn,
  CASE size % 5 WHEN 0 THEN 'role' WHEN 1 THEN 'Ownership' WHEN 2 THEN 'tenant' WHEN 3 THEN 'none' ELSE 'strange' END AS authz,
  CASE k % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 3 THEN 'bad' END AS risk, concat('seen ', k) AS notes
FROM v_api_parts WHERE k % 6 <> 5"""
VIEWS["v_api_reviewed"] = """
SELECT *, CASE k % 6 WHEN 0 THEN 'required' WHEN 1 THEN 'public' WHEN 2 THEN 'none' WHEN 5 THEN 'unassessed' ELSE 'unclear' END AS authn,
  CASE WHEN k % 6 <> 5 THEN CASE size % 5 WHEN 0 THEN 'role' WHEN 1 THEN 'ownership' WHEN 2 THEN 'tenant' WHEN 3 THEN 'none' ELSE 'unclear' END END AS authz,
  CASE WHEN k % 6 <> 5 THEN CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN heuristic_risk ELSE 'low' END END AS risk,
  CASE WHEN k % 6 <> 5 THEN concat('seen ', k) END AS notes FROM v_api_risk"""
# What reviewers found on routes, named by label with another parameter name.
VIEWS["v_api_found"] = """
SELECT artifact_id, concat('found', k) AS finding_id, concat(lower(method), ' ', replace(path, '{id}', '{other}')) AS endpoint, 'proposed' AS state,
  concat('Finding ', k) AS title, CASE k % 3 WHEN 0 THEN 'CWE-306' WHEN 1 THEN 'CWE-639: object' ELSE 'CWE-285' END AS cwe,
  CASE k % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity FROM v_api_parts WHERE k % 7 = 0"""


def reviewed(spark, sf, eps):
    """Endpoints with the verdicts of the table."""
    told = view(spark, sf, "v_api_verdicts").join(eps.select("artifact_id", "file_path", "line", "endpoint_id"),
                                                  ["artifact_id", "file_path", "line"])
    return access_flags.apply_endpoint_verdicts(eps, told)


VIEWS["v_api_policy"] = """
SELECT *, CASE WHEN scope = 'route' THEN 'required' WHEN public THEN 'public' ELSE 'none' END AS authn,
  CASE WHEN owned THEN 'ownership' ELSE 'unclear' END AS authz,
  CASE WHEN scope = 'none' AND changing AND NOT public THEN 'high' ELSE 'low' END AS risk FROM v_api_risk"""


@query("endpoint_policy", "SELECT artifact_id, file_path, line, authn, authz, risk FROM v_api_policy")
def endpoint_policy(spark, sf):
    eps = endpoints(spark, sf)
    return access_flags.apply_endpoint_verdicts(eps, verdicts.endpoint_policy(eps)).select(
        "artifact_id", "file_path", "line", "authn", "authz", "risk")


@query("endpoint_policy_findings", """
SELECT artifact_id, endpoint, CASE WHEN scope = 'none' AND changing THEN 'CWE-306' ELSE 'CWE-639' END AS cwe,
  CASE WHEN scope = 'none' AND changing THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN scope = 'none' AND changing THEN 'proposed' ELSE 'needs_info' END AS state, line AS line_start
FROM v_api_facts WHERE NOT public AND ((scope = 'none' AND changing) OR (kind IS NOT NULL AND NOT owned))""")
def endpoint_policy_findings(spark, sf):
    return verdicts.endpoint_policy_findings(fresh_map(spark, sf)).select(
        "artifact_id", "endpoint", "cwe", "severity", "state", "line_start")


@query("endpoint_verdicts", "SELECT artifact_id, file_path, line, authn, authz, risk, notes FROM v_api_reviewed")
def endpoint_verdicts(spark, sf):
    """Verdicts of reviewers, invalid and missing values included."""
    return reviewed(spark, sf, endpoints(spark, sf)).select("artifact_id", "file_path", "line", "authn", "authz", "risk", "notes")


RESOLVED = FLAGS + """,
fnd AS (SELECT DISTINCT artifact_id, concat(upper(split_part(endpoint, ' ', 1)), ' ', lower(regexp_replace(split_part(endpoint, ' ', 2), '\\{[^}/]+\\}', '{}', 'g'))) AS ep,
  regexp_extract(cwe, '\\d+') AS num FROM v_api_found),
x AS (SELECT f.*, p.authn, p.authz, p.risk, concat(p.method, ' ', lower(regexp_replace(p.path, '\\{[^}/]+\\}', '{}', 'g'))) AS ep,
  CASE rule WHEN 'access.missing-authn' THEN '306' WHEN 'access.inconsistent-authn' THEN '862' WHEN 'access.idor' THEN '639'
    WHEN 'access.privileged-no-role' THEN '285' ELSE '306' END AS num FROM flags f LEFT JOIN v_api_reviewed p ON p.k = f.k),
y AS (SELECT x.*, coalesce(authn, 'unassessed') <> 'unassessed' AND coalesce(CASE WHEN rule IN ('access.missing-authn','access.inconsistent-authn') THEN authn IN ('required','public')
    WHEN rule = 'access.privileged-no-role' THEN authz = 'role' WHEN rule = 'access.idor' THEN authz IN ('ownership','role','tenant')
    ELSE risk = 'low' END, FALSE) AS implied, EXISTS (SELECT 1 FROM fnd WHERE fnd.artifact_id = x.artifact_id AND fnd.ep = x.ep AND fnd.num = x.num) AS dup FROM x),
z AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'confirmed' WHEN k % 5 = 1 THEN 'uncertain' WHEN implied THEN 'rejected' WHEN dup THEN 'duplicate' ELSE 'unverified' END AS outcome FROM y)"""


def resolved(spark, sf):
    eps = endpoints(spark, sf)
    raised = pin(access_flags.access_flags(eps))
    k = F.regexp_extract("code_snippet", r"def h(\d+)", 1).try_cast("int")
    spoken = raised.where("endpoint_id is not null").withColumn("k", k).where(
        F.col("k") % 5 < 2).select(
        "artifact_id", "flag_id", F.when(F.col("k") % 5 == 0, "Confirmed").otherwise("uncertain")
        .alias("verdict"), F.lit("because").alias("reason"),
        F.lit(None).cast("string").alias("severity"))
    return access_flags.resolve_flags(raised, reviewed(spark, sf, eps), view(spark, sf, "v_api_found"), spoken)


@query("flag_resolution", RESOLVED + """
SELECT artifact_id, endpoint, rule, outcome, CASE outcome WHEN 'confirmed' THEN greatest(confidence, 0.65)
  WHEN 'unverified' THEN least(confidence, 0.2) ELSE confidence END::DOUBLE AS confidence FROM z""")
def flag_resolution(spark, sf):
    return resolved(spark, sf).select("artifact_id", "endpoint", "rule", "outcome", "confidence")


@query("flag_outcomes", RESOLVED + " SELECT artifact_id, outcome, count(*) AS n FROM z GROUP BY 1, 2")
def flag_outcomes(spark, sf):
    return access_flags.flag_outcomes(resolved(spark, sf))


_N = ", ".join([f"count(*) FILTER (authn = '{a}') AS authn_{a}" for a in (*fixed.AUTHN_VALUES, "unassessed")]
               + [f"count(*) FILTER (risk = '{r}') AS risk_{r}" for r in fixed.RISK_VALUES])


@query("review_stats", f"SELECT artifact_id, count(*) AS endpoints, count(*) FILTER (authn <> 'unassessed') AS assessed, {_N} FROM v_api_reviewed GROUP BY 1")
def review_stats(spark, sf):
    return access_flags.review_stats(reviewed(spark, sf, endpoints(spark, sf)))


# ---- exports -----------------------------------------------------------------------------------------
@query("access_matrix", """
SELECT artifact_id, method, path, authn, coalesce(authz, '') AS authz, coalesce(risk, '') AS risk, scope AS auth_scope, heuristic_risk, file_path, CAST(line AS VARCHAR) AS line,
  'def' AS handler, file_path AS handler_file, CAST(line + 1 AS VARCHAR) AS handler_line, coalesce(notes, '') AS notes,
  CASE WHEN has_user THEN 'current_user; get_current_user' WHEN owned THEN 'current_user' ELSE '' END AS route_auth,
  '' AS file_auth, '' AS role_hints, CASE WHEN owned THEN 'filter(Item.user; == current_user' ELSE '' END AS ownership_hints
FROM v_api_reviewed""")
def access_matrix(spark, sf):
    return sinks.access_matrix(reviewed(spark, sf, endpoints(spark, sf)), ["artifact_id"])


@query("endpoint_lines", "SELECT artifact_id, endpoint AS line FROM v_api_facts")
def endpoint_lines(spark, sf):
    return sinks.endpoint_lines(fresh_map(spark, sf), ["artifact_id"])


@query("report_matrix", """
SELECT artifact_id, method, path, risk, position FROM (SELECT artifact_id, method, path, coalesce(risk, heuristic_risk) AS risk, row_number() OVER (PARTITION BY artifact_id ORDER BY
  CASE coalesce(risk, heuristic_risk) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, path, method) AS position FROM v_api_reviewed)""")
def report_matrix(spark, sf):
    return rollups.report_matrix(reviewed(spark, sf, endpoints(spark, sf))).select(
        "artifact_id", "method", "path", "risk", "position")


def _operations(where="TRUE"):
    """The last route in order of risk, file and line of each path and verb; risk beyond a floor."""
    return f"""
SELECT artifact_id, template, verb, arg_max(file_path, r) AS file_path, arg_max(line, r) AS line, arg_max(risk, r) AS risk FROM (
  SELECT artifact_id, path AS template, verb, file_path, line, shown AS risk,
    row_number() OVER (PARTITION BY artifact_id, path, verb ORDER BY CASE shown WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file_path, line) AS r
  FROM (SELECT *, coalesce(risk, heuristic_risk) AS shown FROM v_api_reviewed) WHERE {where}) GROUP BY 1, 2, 3"""


@query("openapi_operations", _operations())
def openapi_operations(spark, sf):
    return sinks.openapi_operations(reviewed(spark, sf, endpoints(spark, sf)), keys=["artifact_id"]).select(
        "artifact_id", "template", "verb", "file_path", "line", F.col("_risk").alias("risk"))


@query("risky_operations", _operations("shown IN ('high', 'medium')"))
def risky_operations(spark, sf):
    """Only operations of medium risk or more."""
    return sinks.openapi_operations(reviewed(spark, sf, endpoints(spark, sf)), "medium", ["artifact_id"]).select(
        "artifact_id", "template", "verb", "file_path", "line", F.col("_risk").alias("risk"))


@query("test_notes", """
SELECT artifact_id, file_path, line, concat_ws(' | ', CASE WHEN authn <> 'public' AND NOT public THEN 'Call without a session: 401/403 expected (authentication).' END,
  CASE WHEN kind IS NOT NULL THEN concat('As user A request an object of user B (', CASE kind WHEN 'uuid' THEN 'item_uuid' ELSE 'id' END, '): 403/404 expected (IDOR).') END,
  CASE WHEN priv OR coalesce(authz, '') IN ('none', 'unclear') THEN 'Call with a low-privilege session: 403 expected (function-level access).' END,
  CASE WHEN changing THEN 'Add privileged fields to the body: they must be ignored (mass assignment).' END) AS notes FROM v_api_reviewed""")
def test_notes(spark, sf):
    return reviewed(spark, sf, endpoints(spark, sf)).select(
        "artifact_id", "file_path", "line", F.array_join(rx.test_notes(), " | ").alias("notes"))


@query("related_findings", """
SELECT p.artifact_id, p.file_path, p.line, concat('[', f.severity, '] ', f.title) AS related
FROM v_api_facts p JOIN v_api_found f ON f.artifact_id = p.artifact_id AND upper(f.endpoint) = upper(p.endpoint)""")
def related_findings(spark, sf):
    eps = endpoints(spark, sf)
    rel = sinks.related_findings(eps, view(spark, sf, "v_api_found"), ["artifact_id"])
    return rel.join(eps.select("artifact_id", "endpoint_id", "file_path", "line"),
                    ["artifact_id", "endpoint_id"]).select(
        "artifact_id", "file_path", "line", "related")


_START = ('{"openapi":"3.0.3","info":{"title":"Endpoints of a scan","version":"1.0"},"servers":[{"url":"https://target.example"}],'
          '"tags":[{"name":"risk-high"},{"name":"risk-medium"},{"name":"risk-low"},{"name":"has-findings"}],"paths":{')
_END = ('},"components":{"securitySchemes":{"bearerAuth":{"type":"http","scheme":"bearer"},'
        '"cookieAuth":{"type":"apiKey","in":"cookie","name":"session"}}}}')
_NL = "chr(92) || 'n'"  # a line break inside a JSON string
OPENAPI_TEXT = f"""
WITH w AS (SELECT *, coalesce(risk, heuristic_risk) AS shown, row_number() OVER (PARTITION BY artifact_id, path, verb ORDER BY
    CASE coalesce(risk, heuristic_risk) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END DESC, file_path DESC, line DESC) AS back FROM v_api_reviewed),
r AS (SELECT w.k, f.finding_id, concat('[', f.severity, '] ', f.title) AS related FROM w JOIN v_api_found f
  ON f.artifact_id = w.artifact_id AND upper(f.endpoint) = upper(w.endpoint) WHERE back = 1),
g AS (SELECT k, count(*) AS n, min(finding_id) AS first, string_agg(concat({_NL}, '- ', related), '' ORDER BY finding_id) AS quoted FROM r GROUP BY 1),
o AS (SELECT w.*, g.n, g.first, g.quoted, concat('"', CASE kind WHEN 'uuid' THEN 'item_uuid' ELSE 'id' END, '"') AS param,
    concat('e', left(md5(concat_ws('|', file_path, line, method, path, 'fastapi')), 16)) AS endpoint_id,
    list_filter([CASE WHEN authn <> 'public' AND NOT public THEN 'Call without a session: 401/403 expected (authentication).' END,
      CASE WHEN kind IS NOT NULL THEN concat('As user A request an object of user B (', CASE kind WHEN 'uuid' THEN 'item_uuid' ELSE 'id' END, '): 403/404 expected (IDOR).') END,
      CASE WHEN priv OR coalesce(authz, '') IN ('none', 'unclear') THEN 'Call with a low-privilege session: 403 expected (function-level access).' END,
      CASE WHEN changing THEN 'Add privileged fields to the body: they must be ignored (mass assignment).' END], lambda x: x IS NOT NULL) AS tests
  FROM w LEFT JOIN g USING (k) WHERE back = 1),
p AS (SELECT artifact_id, min(path) AS first FROM o GROUP BY 1), v AS (SELECT artifact_id, path, min(verb) AS first FROM o GROUP BY 1, 2),
b AS (SELECT o.*, concat('{{"operationId":"', verb, '_', endpoint_id, '","summary":"[', upper(shown), '] def","description":"Handler: ', file_path, ':', line + 1,
    {_NL}, 'Auth: authn=', authn, ' authz=', coalesce(authz, 'unassessed'), ' risk=', shown, CASE WHEN notes IS NULL THEN '' ELSE concat({_NL}, 'Notes: ', notes) END,
    CASE WHEN n > 0 THEN concat({_NL}, 'Related findings:', quoted, CASE WHEN n > 50 THEN concat({_NL}, '- ... (all in x-related-findings)') ELSE '' END) ELSE '' END,
    CASE WHEN len(tests) > 0 THEN concat({_NL}, 'BAC tests:', array_to_string(list_transform(tests, lambda t: concat({_NL}, '- ', t)), '')) ELSE '' END,
    '","tags":["risk-', shown, '"', CASE WHEN n > 0 THEN ',"has-findings"' ELSE '' END, '],"parameters":[',
    CASE WHEN kind IS NULL THEN '' ELSE concat('{{"name":', param, ',"in":"path","required":true,"schema":{{"type":"string"}},"example":"1"}}') END,
    '],"x-access":{{"authn":"', authn, '"', CASE WHEN authz IS NULL THEN '' ELSE concat(',"authz":"', authz, '","risk":"', risk, '"') END, ',"auth_scope":"', scope,
    '","heuristic_risk":"', heuristic_risk, '","role_hints":[],"ownership_hints":[', CASE WHEN owned THEN '"filter(Item.user","== current_user"' ELSE '' END, '],"id_params":[',
    CASE WHEN kind IS NULL THEN '' ELSE param END, ']', CASE WHEN kind IS NULL THEN '' ELSE concat(',"id_kind":"', kind, '"') END, ',"privileged":', priv, ',"state_changing":', changing,
    '}},"x-bac-tests":[', array_to_string(list_transform(tests, lambda t: concat('"', t, '"')), ','),
    '],"responses":{{"200":{{"description":"OK"}},"401":{{"description":"Unauthenticated"}},"403":{{"description":"Forbidden"}}}},"security":',
    CASE WHEN authn = 'public' THEN '[]' ELSE '[{{"bearerAuth":[]}},{{"cookieAuth":[]}}]' END,
    CASE WHEN verb IN ('post', 'put', 'patch') THEN ',"requestBody":{{"required":false,"content":{{"application/json":{{"schema":{{"type":"object"}},"example":{{}}}}}}}}' ELSE '' END,
    ',"x-related-findings":[') AS body FROM o)
SELECT artifact_id, 0 AS s1, '' AS s2, '' AS s3, '' AS s4, '{_START}' AS text FROM p
UNION ALL SELECT artifact_id, 1, path, '', '', concat(CASE WHEN path = p.first THEN '' ELSE ',' END, '"', path, '":{{') FROM v JOIN p USING (artifact_id)
UNION ALL SELECT b.artifact_id, 1, b.path, verb, '', concat(CASE WHEN verb = v.first THEN '' ELSE ',' END, '"', verb, '":', body) FROM b JOIN v USING (artifact_id, path)
UNION ALL SELECT o.artifact_id, 1, o.path, verb, concat('1', r.finding_id), concat(CASE WHEN r.finding_id = o.first THEN '' ELSE ',' END, '"', related, '"') FROM r JOIN o USING (k)
UNION ALL SELECT artifact_id, 1, path, verb, '2', ']}}' FROM o
UNION ALL SELECT artifact_id, 1, path, '~', '', '}}' FROM v
UNION ALL SELECT artifact_id, 2, '', '', '', '{_END}' FROM p"""


@query("openapi_fragments", OPENAPI_TEXT)
def openapi_fragments(spark, sf):
    """Text fragments of one OpenAPI document per artifact (also parsed in the tests)."""
    eps = reviewed(spark, sf, endpoints(spark, sf))
    return sinks.openapi_fragments(eps, view(spark, sf, "v_api_found"), ["artifact_id"])


@query("route_labels", """
SELECT artifact_id, file_path, line, concat(method, ' ', lower(regexp_replace(path, '\\{[^}/]+\\}', '{}', 'g'))) AS label,
  resource AS family, path AS template, replace(replace(path, '{id}', '1'), '{item_uuid}', '1') AS filled,
  resource AS collection, CASE size % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'item_uuid' ELSE '' END AS params FROM v_api_facts""")
def route_labels(spark, sf):
    c = F.col
    return endpoints(spark, sf).select(
        "artifact_id", "file_path", "line",
        rx.normal_label(rx.route_label(c("method"), c("path"))).alias("label"),
        rx.resource_family(c("path")).alias("family"), rx.template_path(c("path")).alias("template"),
        rx.fill_path(c("path")).alias("filled"), rx.collection_path(c("path")).alias("collection"),
        F.array_join(rx.path_params(c("path")), ",").alias("params"))


# ---- endpoints and findings by label ------------------------------------------------------------
VIEWS["v_named"] = """
SELECT concat('art', l_orderkey % 10) AS artifact_id, concat('n', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS finding_id,
  concat(CASE l_partkey % 2 WHEN 0 THEN 'get' ELSE ' Delete' END, '  /res', l_partkey % 40, CASE l_suppkey % 2 WHEN 0 THEN '/{id}' ELSE '' END) AS endpoint,
  concat(CASE l_partkey % 2 WHEN 0 THEN 'GET' ELSE 'DELETE' END, ' /RES', l_partkey % 40, CASE l_suppkey % 2 WHEN 0 THEN '/{ID}' ELSE '' END) AS label,
  CASE WHEN l_returnflag = 'R' THEN 'dismissed' ELSE 'proposed' END AS state, l_linenumber = 1 AS unverified FROM @lineitem"""


@query("endpoints_with_findings", """
SELECT artifact_id, file_path, line FROM v_api_facts a WHERE EXISTS (SELECT 1 FROM v_named n WHERE n.artifact_id = a.artifact_id
  AND n.label = upper(a.endpoint) AND n.state <> 'dismissed' AND NOT n.unverified)""")
def endpoints_with_findings(spark, sf):
    return access_map.endpoints_with_findings(fresh_map(spark, sf), view(spark, sf, "v_named")) \
        .select("artifact_id", "file_path", "line")


@query("endpoint_of_findings", """
WITH k AS (SELECT artifact_id, upper(endpoint) AS label, arg_min(path, file_path || lpad(CAST(line AS VARCHAR), 6, '0')) AS path FROM v_api_facts GROUP BY 1, 2)
SELECT n.finding_id, split_part(n.label, ' ', 1) AS method, coalesce(k.path, split_part(n.label, ' ', 2)) AS path
FROM v_named n LEFT JOIN k ON k.artifact_id = n.artifact_id AND k.label = n.label""")
def endpoint_of_findings(spark, sf):
    return access_map.endpoint_of_findings(view(spark, sf, "v_named"), endpoints(spark, sf)) \
        .select("finding_id", "method", "path")


@query("routes_by_risk", "SELECT artifact_id, file_path, line, risk FROM v_api_reviewed")
def routes_by_risk(spark, sf):
    return access_map.sort_by_risk(reviewed(spark, sf, endpoints(spark, sf))).select("artifact_id", "file_path",
                                                                                     "line", "risk")
