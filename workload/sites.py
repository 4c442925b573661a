"""Queries over route tables of eight frameworks whose handlers, logins and roles live in different
places: other files, the class, the file, the line itself."""

from pyspark.sql import functions as F

from auditspan.operators import access_flags, access_map, routes
from auditspan.operators.ordered import pin

from .base import VIEWS, query, view

# 20 parts a site, eight frameworks in turn; r counts the parts of a site from 1.
VIEWS["v_site_parts"] = """
SELECT p_partkey AS k, CAST(floor(p_partkey / 20) AS BIGINT) AS s, CAST(floor(p_partkey / 20) AS BIGINT) % 8 AS kind, p_size AS size,
  concat('art', CAST(floor(p_partkey / 320) AS BIGINT)) AS artifact_id,
  CAST(row_number() OVER (PARTITION BY CAST(floor(p_partkey / 20) AS BIGINT) ORDER BY p_partkey) AS INT) AS r
FROM @part"""
# controllers of ten parts each
VIEWS["v_site_classes"] = """
SELECT artifact_id, s, CASE WHEN r > 10 THEN 1 ELSE 0 END AS c, CASE WHEN r > 10 THEN 34 ELSE 0 END AS base, count(*) AS n
FROM v_site_parts WHERE kind = 2 GROUP BY 1, 2, 3, 4"""
_RAILS = "concat('app', s, '/controllers/c', s, '_controller.rb')"
_NEST = "concat('src', s, '/box.controller.ts')"
#: (kind, path, line, text) of every line
_LINES = [
    (0, "concat('shop', s, '/urls.py')", "r", "concat('    path(''items', k, '/<int:pk>/'', views.item', k, '),')"),
    (0, "concat('shop', s, '/views.py')", "4 * r - 3", "CASE WHEN size % 2 = 0 THEN '@login_required' ELSE '@csrf_exempt' END"),
    (0, "concat('shop', s, '/views.py')", "4 * r - 2", "concat('def item', k, '(request, pk):')"),
    (0, "concat('shop', s, '/views.py')", "4 * r - 1", "'    return 1'"),
    (0, "concat('shop', s, '/views.py')", "4 * r", "''"),
    (1, "concat('config', s, '/routes.rb')", "r", "CASE WHEN r % 5 = 0 THEN concat('  resources :c', s) "
     "ELSE concat('  get ''/go', k, ''', to: ''c', s, '#act', k, '''') END"),
    (1, _RAILS, "3 * r", "concat('  def act', k)"), (1, _RAILS, "3 * r + 1", "'    render'"), (1, _RAILS, "3 * r + 2", "'  end'"),
    (2, _NEST, "CASE WHEN r > 10 THEN 34 ELSE 0 END + 3 * ((r - 1) % 10) + 4", "concat('  @Get(''i', k, '/:id'')')"),
    (2, _NEST, "CASE WHEN r > 10 THEN 34 ELSE 0 END + 3 * ((r - 1) % 10) + 5", "concat('  find', k, '(@Param(''id'') id: string) {')"),
    (2, _NEST, "CASE WHEN r > 10 THEN 34 ELSE 0 END + 3 * ((r - 1) % 10) + 6", "'  }'"),
    (3, "concat('app/r', k, '/route.ts')", "1", "'export async function GET(req) {'"),
    (3, "concat('app/r', k, '/route.ts')", "2", "'  return 1;'"), (3, "concat('app/r', k, '/route.ts')", "3", "'}'"),
    (3, "concat('app/r', k, '/route.ts')", "4", "CASE WHEN size % 2 = 0 THEN '' ELSE 'export async function DELETE(req) {' END"),
    (3, "concat('app/r', k, '/route.ts')", "5", "CASE WHEN size % 2 = 0 THEN '' ELSE '  requireRole(''keeper'');' END"),
    (3, "concat('app/r', k, '/route.ts')", "6", "CASE WHEN size % 2 = 0 THEN '' ELSE '}' END"),
    (4, "concat('srv', s, '/main.go')", "3 * r - 2", "concat('http.HandleFunc(\"/h', k, '\", serve', k, ')')"),
    (4, "concat('srv', s, '/main.go')", "3 * r - 1", "concat('func serve', k, '(w http.ResponseWriter) {')"),
    (4, "concat('srv', s, '/main.go')", "3 * r", "'}'"),
    (5, "concat('web', s, '/Api.cs')", "3 * r - 2", "concat('[Route(\"api/r', k, '\")]')"),
    (5, "concat('web', s, '/Api.cs')", "3 * r - 1", "concat('app.MapGet(\"/m', k, '\", List', k, ');')"),
    (5, "concat('web', s, '/Api.cs')", "3 * r", "''"),
    (6, "concat('f', s, '/server.js')", "6 * r - 5", "'fastify.route({'"), (6, "concat('f', s, '/server.js')", "6 * r - 4", "'  method: ''DELETE'','"),
    (6, "concat('f', s, '/server.js')", "6 * r - 3", "concat('  url: ''/q', k, '/:id'',')"),
    (6, "concat('f', s, '/server.js')", "6 * r - 2", "concat('  handler: purge', k, ',')"),
    (6, "concat('f', s, '/server.js')", "6 * r - 1", "'});'"), (6, "concat('f', s, '/server.js')", "6 * r", "''"),
    (7, "concat('e', s, '/app.js')", "r", "concat('router.post(''/acc', s, '/:k', k, ''', ', CASE size % 3 WHEN 0 THEN 'requireAuth, requireRole(''keeper''), ' "
     "WHEN 1 THEN 'requireAuth, ' ELSE '' END, 'show', k, ');')"),
]
VIEWS["v_site_lines"] = "\nUNION ALL ".join(
    f"SELECT artifact_id, {path} AS path, CAST({line} AS INT) AS line_no, {text} AS text FROM v_site_parts WHERE kind = {kind}"
    for kind, path, line, text in _LINES) + f"""
UNION ALL SELECT DISTINCT artifact_id, {_RAILS}, 1, concat('class C', s, 'Controller') FROM v_site_parts WHERE kind = 1
UNION ALL SELECT DISTINCT artifact_id, {_RAILS}, 2, CASE WHEN s % 16 = 1 THEN '  before_action :authenticate_user' ELSE '  # open' END FROM v_site_parts WHERE kind = 1
UNION ALL SELECT artifact_id, {_NEST}, base + 1, concat('@Controller(''b', s, 'x', c, ''')') FROM v_site_classes
UNION ALL SELECT artifact_id, {_NEST}, base + 2, CASE WHEN c = 0 THEN '@UseGuards(Crew)' ELSE '// plain' END FROM v_site_classes
UNION ALL SELECT artifact_id, {_NEST}, base + 3, concat('export class B', s, 'x', c, ' {{') FROM v_site_classes
UNION ALL SELECT artifact_id, {_NEST}, CAST(base + 4 + 3 * n AS INT), '}}' FROM v_site_classes"""
_LINE = "CAST(CASE WHEN r > 10 THEN 34 ELSE 0 END + 3 * ((r - 1) % 10) + 4 AS INT)"
#: framework, method, path, file, line, handler, handler file, handler line, start, end, scope, roles, public markers, file logins, id kind, condition
_ROUTES = [
    ("django", "'ANY'", "concat('/items', k, '/<int:pk>/')", "concat('shop', s, '/urls.py')", "r", "concat('views.item', k)",
     "concat('shop', s, '/views.py')", "4 * r - 2", "4 * r - 3", "4 * r - 1", "CASE WHEN size % 2 = 0 THEN 'route' ELSE 'public' END",
     "0", "size % 2", "0", "'numeric'", "kind = 0"),
    ("rails", "'GET'", "concat('/go', k)", "concat('config', s, '/routes.rb')", "r", "concat('c', s, '#act', k)", _RAILS, "3 * r",
     "CASE WHEN r = 1 AND s % 16 <> 1 THEN 2 ELSE 3 * r END", "3 * r + 2", "CASE WHEN s % 16 = 1 THEN 'file' ELSE 'none' END",
     "0", "0", "CASE WHEN s % 16 = 1 THEN 1 ELSE 0 END", "NULL", "kind = 1 AND r % 5 <> 0"),
    ("rails", "'ANY'", "concat('/c', s)", "concat('config', s, '/routes.rb')", "r", "concat('c', s)", _RAILS, "3",
     "CASE WHEN s % 16 <> 1 THEN 2 ELSE 3 END", "5", "CASE WHEN s % 16 = 1 THEN 'file' ELSE 'none' END",
     "0", "0", "CASE WHEN s % 16 = 1 THEN 1 ELSE 0 END", "NULL", "kind = 1 AND r % 5 = 0"),
    ("nestjs", "'GET'", "concat('/b', s, CASE WHEN r > 10 THEN 'x1' ELSE 'x0' END, '/i', k, '/:id')", _NEST, _LINE, "concat('find', k)",
     _NEST, _LINE, _LINE, f"{_LINE} + 2", "CASE WHEN r > 10 THEN 'none' ELSE 'file' END", "0", "0", "CASE WHEN r > 10 THEN 0 ELSE 1 END",
     "'unknown'", "kind = 2"),
    ("nextjs", "'GET'", "concat('/r', k)", "concat('app/r', k, '/route.ts')", "1", "'GET'", "concat('app/r', k, '/route.ts')", "1", "1", "3",
     "'none'", "0", "0", "0", "NULL", "kind = 3"),
    ("nextjs", "'DELETE'", "concat('/r', k)", "concat('app/r', k, '/route.ts')", "4", "'DELETE'", "concat('app/r', k, '/route.ts')", "4", "4", "6",
     "'route'", "1", "0", "0", "NULL", "kind = 3 AND size % 2 = 1"),
    ("go-net-http", "'ANY'", "concat('/h', k)", "concat('srv', s, '/main.go')", "3 * r - 2", "concat('serve', k)", "concat('srv', s, '/main.go')",
     "3 * r - 1", "3 * r - 2", "3 * r", "'none'", "0", "0", "0", "NULL", "kind = 4"),
    ("aspnet", "'ANY'", "concat('api/r', k)", "concat('web', s, '/Api.cs')", "3 * r - 2", "NULL", "concat('web', s, '/Api.cs')", "3 * r - 2",
     "3 * r - 2", "3 * r - 2", "'none'", "0", "0", "0", "NULL", "kind = 5"),
    ("aspnet", "'GET'", "concat('/m', k)", "concat('web', s, '/Api.cs')", "3 * r - 1", "concat('List', k)", "concat('web', s, '/Api.cs')", "3 * r - 1",
     "3 * r - 2", "3 * r - 1", "'none'", "0", "0", "0", "NULL", "kind = 5"),
    ("fastify", "'DELETE'", "concat('/q', k, '/:id')", "concat('f', s, '/server.js')", "6 * r - 5", "NULL", "concat('f', s, '/server.js')", "6 * r - 5",
     "6 * r - 5", "6 * r - 1", "'none'", "0", "0", "0", "'unknown'", "kind = 6"),
    ("express", "'POST'", "concat('/acc', s, '/:k', k)", "concat('e', s, '/app.js')", "r", "CASE WHEN size % 3 < 2 THEN 'requireAuth' ELSE concat('show', k) END",
     "concat('e', s, '/app.js')", "r", "r", "r", "CASE WHEN size % 3 < 2 THEN 'route' ELSE 'none' END", "CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END",
     "0", "0", "NULL", "kind = 7"),
]
_NAMES = ("framework method path file_path line handler handler_file handler_line handler_start handler_end auth_scope n_roles n_public "
          "n_file id_kind").split()
_INTS = {"line", "handler_line", "handler_start", "handler_end", "n_roles", "n_public", "n_file"}
VIEWS["v_site_facts"] = "\nUNION ALL ".join(
    "SELECT artifact_id, " + ", ".join(
        f"CAST({v} AS INT) AS {n}" if n in _INTS else f"CAST({v} AS VARCHAR(80)) AS {n}"
        for n, v in zip(_NAMES, (f"'{row[0]}'", *row[1:-1]), strict=True)) + f" FROM v_site_parts WHERE {row[-1]}" for row in _ROUTES)


def site_files(spark, sf):
    """Derived files of whole sites; a file holds at most 120 lines."""
    return view(spark, sf, "v_site_lines").groupBy("artifact_id", "path").agg(F.concat_ws("\n", F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])).alias("content"))


def site_map(spark, sf):
    files = pin(site_files(spark, sf))  # a corpus is a stored table
    return access_map.access_map(pin(routes.extract_routes(files)), files)


@query("site_routes", "SELECT artifact_id, framework, method, path, file_path, line, handler FROM v_site_facts")
def site_routes(spark, sf):
    return routes.extract_routes(site_files(spark, sf)).select(
        "artifact_id", "framework", "method", "path", "file_path", "line", "handler")


@query("site_map", "SELECT * FROM v_site_facts")
def mapped_sites(spark, sf):
    """Handlers in other files, class and file logins, roles and public markers."""
    return site_map(spark, sf).select(
        "artifact_id", "framework", "method", "path", "file_path", "line", "handler", "handler_file", "handler_line",
        "handler_start", "handler_end", "auth_scope", F.size("role_hints").alias("n_roles"),
        F.size("public_markers").alias("n_public"), F.size("file_auth").alias("n_file"), "id_kind")


VIEWS["v_site_family"] = r"""
SELECT *, concat(method, ' ', path) AS endpoint, method IN ('POST', 'PUT', 'PATCH', 'DELETE') AS changing,
  regexp_replace(path, '(/:\w+|/<int:\w+>/)$', '') AS resource, auth_scope IN ('route', 'file') AS prot FROM v_site_facts"""
_GROUPS = """
g AS (SELECT artifact_id, resource, count(*) FILTER (prot) AS protected, count(*) FILTER (auth_scope IN ('none', 'public')) AS exposed,
  count(*) FILTER (prot AND n_roles > 0) AS roled,
  left(array_to_string(list_sort(list(DISTINCT endpoint) FILTER (prot)), ', '), 300) AS protected_peers,
  left(array_to_string(list_sort(list(DISTINCT endpoint) FILTER (prot AND n_roles > 0)), ', '), 300) AS roled_peers
  FROM v_site_family GROUP BY 1, 2),
sys AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (auth_scope = 'none') AS lost,
  count(*) >= 15 AND count(*) FILTER (auth_scope = 'none') / count(*) >= 0.6 AS systemic FROM v_site_family GROUP BY 1)"""


@query("site_siblings", "WITH " + _GROUPS + " SELECT * FROM g")
def site_siblings(spark, sf):
    return access_flags.sibling_groups(pin(site_map(spark, sf)))


@query("site_flags", "WITH " + _GROUPS + """,
e AS (SELECT f.*, s.systemic, g.protected, g.roled FROM v_site_family f JOIN g USING (artifact_id, resource) JOIN sys s USING (artifact_id)),
q AS (SELECT *, NOT systemic AND auth_scope IN ('none', 'public') AND protected > 0 AS lacks, prot AND n_roles = 0 AND changing AND roled > 0 AS unroled FROM e),
f AS (SELECT artifact_id, endpoint, 'access.inconsistent-authn' AS rule, CASE WHEN changing THEN 'high' ELSE 'medium' END AS severity, 0.5 AS confidence,
    handler_file, handler_line FROM q WHERE lacks
  UNION ALL SELECT artifact_id, endpoint, 'access.inconsistent-authz', 'medium', 0.4, handler_file, handler_line FROM q WHERE unroled
  UNION ALL SELECT artifact_id, endpoint, 'access.missing-authn', 'medium', 0.35, handler_file, handler_line FROM q
    WHERE (auth_scope = 'public' OR auth_scope = 'none' AND NOT systemic) AND NOT lacks AND NOT unroled AND changing
  UNION ALL SELECT artifact_id, endpoint, 'access.idor', CASE WHEN changing THEN 'high' ELSE 'medium' END, CASE WHEN id_kind = 'numeric' THEN 0.4 ELSE 0.3 END,
    handler_file, handler_line FROM q WHERE id_kind IS NOT NULL AND n_roles = 0
  UNION ALL SELECT artifact_id, NULL, 'access.auth-not-located', 'medium', 0.3, arg_min(handler_file, file_path || lpad(CAST(line AS VARCHAR), 6, '0')),
    arg_min(handler_line, file_path || lpad(CAST(line AS VARCHAR), 6, '0')) FROM q WHERE systemic AND auth_scope = 'none' GROUP BY 1)
SELECT artifact_id, endpoint, rule, severity, CAST(confidence AS DOUBLE) AS confidence, handler_file AS file_path, handler_line AS line_start, handler_line AS line_end,
  concat('h', row_number() OVER (PARTITION BY artifact_id ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, confidence DESC, handler_file, handler_line,
    endpoint NULLS LAST, rule) - 1) AS flag_id FROM f""")
def site_flags(spark, sf):
    """All five rules with their order and ids."""
    return access_flags.access_flags(pin(site_map(spark, sf))).select(
        "artifact_id", "endpoint", "rule", "severity", "confidence", "file_path", "line_start", "line_end", "flag_id")


@query("sibling_peers", "SELECT artifact_id, resource, endpoint, max(n_roles) > 0 AS roled FROM v_site_family WHERE prot GROUP BY 1, 2, 3")
def sibling_peers(spark, sf):
    return access_flags.sibling_peers(site_map(spark, sf))


@query("unlocated_routes", "WITH " + _GROUPS + """
SELECT f.artifact_id, f.endpoint, f.file_path, f.line FROM v_site_family f JOIN sys USING (artifact_id) WHERE systemic AND auth_scope = 'none'""")
def unlocated_routes(spark, sf):
    return access_flags.unlocated_routes(pin(site_map(spark, sf))).drop("endpoint_id")
