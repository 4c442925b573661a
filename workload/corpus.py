"""Queries over file contents: index, lines, rules, sinks, evidence, windows."""

from pyspark.sql import functions as F

from auditspan.functions import fixed, labels, paths, text
from auditspan.operators import corpus, evidence, packing, rollups
from auditspan.operators.lifecycle import guard_members
from auditspan.sources.rules import built_in_rules, executable

from .base import VIEWS, query, quoted, spark_sql, table, view

BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[ \t\n\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def lines_sql(c):
    parts = f"regexp_split_to_array({c}, '{BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


# one row per line of every document
DOC_LINES = f"""
SELECT artifact_id, path, unnest({lines_sql('content')}) AS text,
  unnest(range(1, len({lines_sql('content')}) + 1)) AS line_no FROM v_files"""


def collapse_sql(c):
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"



# Files of code derived from the whole part table: 40 parts a file, eight languages.
VIEWS["v_code_parts"] = """
SELECT p_partkey AS k, CAST(floor(p_partkey / 40) AS BIGINT) AS b, p_partkey % 40 AS i,
  CAST(floor(p_partkey / 40) AS BIGINT) % 8 AS lang, CAST(floor(p_partkey / 1000) AS BIGINT) AS art,
  CASE p_partkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'post' WHEN 2 THEN 'delete' ELSE 'put' END AS verb,
  CASE p_partkey % 4 WHEN 0 THEN 'Get' WHEN 1 THEN 'Post' WHEN 2 THEN 'Delete' ELSE 'Put' END AS cap,
  concat(CASE p_size % 5 WHEN 0 THEN 'admin/' WHEN 1 THEN 'health/' ELSE '' END, 'res', p_partkey % 25) AS stem,
  p_size AS size,
  CASE p_retailprice > 1000 WHEN TRUE THEN 'os.system(cmd)' ELSE 'cur.execute(q)' END AS sink
FROM @part"""
VIEWS["v_code_lines"] = """
SELECT concat('art', art) AS artifact_id,
  concat('svc', b, '/mod', CASE lang WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.go'
    WHEN 4 THEN '.php' WHEN 5 THEN '.rb' WHEN 6 THEN '.cs' ELSE '_web.py' END) AS path,
  i * 4 + n + 1 AS line_no,
  CASE n WHEN 0 THEN CASE lang
    WHEN 0 THEN concat('@router.', verb, '("/', stem, CASE size % 3 WHEN 0 THEN '/{id}' WHEN 1 THEN '/{item_uuid}' ELSE '' END, '")')
    WHEN 1 THEN concat('router.', verb, '(''/', stem, '/:id'', requireAuth, show', k, ');')
    WHEN 2 THEN concat('@', cap, 'Mapping("/', stem, '/{id}")')
    WHEN 3 THEN concat('r.', upper(verb), '("/', stem, '/:id", serve', k, ')')
    WHEN 4 THEN concat('Route::', verb, '(''/', stem, '/{id}'', ''C', k, '@show'');')
    WHEN 5 THEN concat('  ', verb, ' ''/', stem, '/:id'', to: ''c', k, '#show''')
    WHEN 6 THEN concat('[Http', cap, '("', stem, '/{id}")]')
    ELSE concat('@bp.route("/', stem, '/<int:id>", methods=["GET", "POST"])') END
  WHEN 1 THEN CASE lang WHEN 0 THEN concat('async def h', k, '(', CASE WHEN size % 4 < 2 THEN 'current_user = Depends(get_current_user)' ELSE 'body: dict' END, '):')
    WHEN 2 THEN concat('public Item find', k, '(Long id) {') WHEN 6 THEN concat('public IActionResult Act', k, '(int id) {')
    WHEN 7 THEN concat('def view', k, '(id):') ELSE concat('// see helper', k, '(x)') END
  WHEN 2 THEN CASE WHEN size % 7 = 0 THEN '    return q.filter(Item.user_id == current_user.id)' ELSE concat('    ', sink, ' + helper', k % 90, '(id)') END
  ELSE CASE WHEN lang IN (2, 6) THEN '}' ELSE '' END END AS text
FROM v_code_parts CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"""


def docs(spark, sf):
    return view(spark, sf, "v_files")


def code(spark, sf):
    """Derived code files with their content; a file holds at most 160 lines."""
    return view(spark, sf, "v_code_lines").groupBy("artifact_id", "path").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(
            "line_no", "text"))), lambda x: x["text"])).alias("content"))


# ---- file index -------------------------------------------------------------------------
def _like(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_PAD = "concat('/', lower(path), '/')"
_NAME = "lower(regexp_extract(path, '[^/]*$'))"
_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.].*?(\.[^.]*)$', 1))"
_LANG = "CASE " + _EXT + " " + " ".join(
    f"WHEN '{e}' THEN '{v}'" for e, v in fixed.LANGUAGE_BY_EXTENSION.items()) + " END"
_GEN = "(" + _NAME + " IN (" + ", ".join(f"'{n}'" for n in fixed.GENERATED_NAMES) + ") OR " + \
    " OR ".join(f"ends_with({_NAME}, '{s}')" for s in fixed.GENERATED_SUFFIXES) + ")"
INDEX = f"""
WITH x AS (SELECT artifact_id, path, size_bytes, content, {_LANG} AS language,
  {_like(_PAD, fixed.VENDOR_MARKERS)} AS is_vendored, {_like(_PAD, fixed.NOISE_MARKERS)} AS is_noise,
  {_GEN} AS is_generated FROM v_files
  WHERE NOT regexp_matches(path, '(^|/)({"|".join(d.replace(".", "[.]") for d in fixed.PRUNE_DIRS)})/')),
i AS (SELECT *, NOT is_vendored AND NOT is_noise AND NOT is_generated AND language IS NOT NULL
  AND size_bytes <= 1048576 AND NOT contains(left(content, 8192), chr(0)) AS included FROM x)"""


@query("file_index", INDEX + """
SELECT artifact_id, path, language, is_vendored, is_noise, is_generated, included,
  CASE WHEN included THEN sha256(content) END AS sha256 FROM i""")
def file_index(spark, sf):
    return corpus.file_index(docs(spark, sf)).select(
        "artifact_id", "path", "language", "is_vendored", "is_noise", "is_generated",
        "included", "sha256")


@query("artifact_totals", INDEX + """
SELECT artifact_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS file_count,
  count(*) FILTER (included) AS analyzable_count FROM i GROUP BY 1""")
def artifact_totals(spark, sf):
    return corpus.artifact_totals(corpus.file_index(docs(spark, sf)))


@query("dir_rollup", """
WITH d AS (SELECT artifact_id, path, doc_id, unnest(['', split_part(path, '/', 1),
  concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) AS directory FROM v_files)
SELECT artifact_id, directory, count(*) AS files, count(*) FILTER (doc_id % 2 = 0) AS selected,
  CASE WHEN count(*) FILTER (doc_id % 2 = 0) = 0 THEN 'unchecked'
       WHEN count(*) FILTER (doc_id % 2 = 0) = count(*) THEN 'checked' ELSE 'partial' END AS check_state
FROM d GROUP BY 1, 2""")
def dir_rollup(spark, sf):
    return corpus.directory_rollup(docs(spark, sf), F.col("doc_id") % 2 == 0)


@query("dir_children", """
SELECT DISTINCT artifact_id, directory, name, is_file FROM (
  SELECT artifact_id, '' AS directory, split_part(path, '/', 1) AS name, 0 AS is_file FROM v_files
  UNION ALL SELECT artifact_id, split_part(path, '/', 1), split_part(path, '/', 2), 0 FROM v_files
  UNION ALL SELECT artifact_id, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), split_part(path, '/', 3), 1 FROM v_files)""")
def dir_children(spark, sf):
    return corpus.directory_children(docs(spark, sf))


@query("path_selection", """
SELECT artifact_id, path FROM v_files WHERE path LIKE 'pkg/%' OR path LIKE 'app/core/%'""")
def path_selection(spark, sf):
    rows = docs(spark, sf).withColumn("included", F.lit(True))
    return corpus.select_files(rows, ["pkg/", "app/core", "vendor/li"]).select(
        "artifact_id", "path")


@query("file_listing", """
SELECT artifact_id, path FROM v_files""")
def file_listing(spark, sf):
    return corpus.list_files(docs(spark, sf)).select("artifact_id", "path")


@query("numbered_lines", f"WITH l AS ({DOC_LINES}) SELECT artifact_id, path, line_no, text FROM l")
def numbered_lines(spark, sf):
    return corpus.numbered_lines(docs(spark, sf))


# ---- rules and sinks -----------------------------------------------------------------------
RULES = executable(built_in_rules())


def _rule_hits_sql(lines, files, lang):
    parts = []
    for r in RULES:
        langs = "TRUE" if "generic" in r.languages else \
            f"{lang} IN ({', '.join(repr(x) for x in r.languages)})"
        if r.multiline:
            parts.append(f"SELECT artifact_id, path, len(string_split(regexp_extract(content, '(?s)^(.*?)(?:{r.pattern})', 1), chr(10))) AS line_no, "
                         f"'{r.rule_id}' AS rule FROM {files} WHERE {langs} AND regexp_matches(content, {quoted(r.pattern)})")
        else:
            parts.append(f"SELECT artifact_id, path, line_no, '{r.rule_id}' AS rule FROM {lines} "
                         f"WHERE {langs} AND regexp_matches(text, {quoted(r.pattern)})")
    return "\nUNION ALL ".join(parts)


@query("rule_hits", f"WITH l AS ({DOC_LINES}) " + _rule_hits_sql("l", "v_files", _LANG))
def rule_hits(spark, sf):
    return corpus.rule_hits(docs(spark, sf), RULES).drop("matched")


# every part as a configuration line of one of 14 kinds
SECRETS = """
SELECT artifact_id, path, line_no, CASE k % 15
  WHEN 0 THEN concat('key = AKIA', upper(substring(md5(concat('a', k)), 1, 16)))
  WHEN 1 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 2 THEN concat('Authorization: Bearer ', md5(concat('b', k)))
  WHEN 3 THEN concat('password = "', substring(md5(concat('c', k)), 1, 9), '"') WHEN 4 THEN 'db.Query(a + b + c)'
  WHEN 5 THEN 'curl 169.254.169.254/latest' WHEN 6 THEN 'Transfer-Encoding: chunked'
  WHEN 7 THEN concat('GET /x?a=1&token=', k) WHEN 8 THEN 'user = "guest"'
  WHEN 9 THEN 'management.endpoints.web.exposure.include=*' WHEN 10 THEN '"type": "service_account"'
  WHEN 11 THEN 'docker run -v /var/run/docker.sock:/s' WHEN 12 THEN '  - /var/run/docker.sock'
  ELSE concat('plain line ', k) END AS text
FROM (SELECT p_partkey AS k, concat('art', CAST(floor(p_partkey / 1000) AS BIGINT)) AS artifact_id,
  concat('cfg', CAST(floor(p_partkey / 50) AS BIGINT), CASE CAST(floor(p_partkey / 50) AS BIGINT) % 3
    WHEN 0 THEN '.go' WHEN 1 THEN '.yml' ELSE '.txt' END) AS path, p_partkey % 50 + 1 AS line_no FROM @part)"""
VIEWS["v_config_lines"] = SECRETS
VIEWS["v_config_files"] = """
SELECT DISTINCT artifact_id, path FROM v_config_lines"""


@query("config_rule_hits", "WITH f AS (SELECT artifact_id, path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM v_config_lines GROUP BY ALL) "
       + _rule_hits_sql("v_config_lines", "f", _LANG))
def config_rule_hits(spark, sf):
    files = view(spark, sf, "v_config_lines").groupBy("artifact_id", "path").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(
            "line_no", "text"))), lambda x: x["text"])).alias("content"))
    hits = corpus.rule_hits(files, RULES).drop("matched")
    # files whose first part is missing start later than line 1
    first = view(spark, sf, "v_config_lines").groupBy("artifact_id", "path").agg(
        F.min("line_no").alias("_first"))
    return hits.join(first, ["artifact_id", "path"]).select(
        "artifact_id", "path", (F.col("line_no") + F.col("_first") - 1).alias("line_no"), "rule")


_SINK = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN '{c}'"
                           for c, _, p in fixed.SINKS) + " END"
_SINK_W = "CASE sink_class " + " ".join(f"WHEN '{c}' THEN {w}" for c, w, _ in fixed.SINKS) + " END"
SINK_LINES = f"""
WITH s AS (SELECT artifact_id, path, line_no, {_SINK} AS sink_class FROM v_code_lines
  WHERE NOT regexp_matches(path, {quoted(fixed.TEST_PATH)}) AND length(text) <= 400
  AND NOT regexp_matches(text, '^\\s*(#|//|\\*|/\\*|--)')),
h AS (SELECT *, {_SINK_W} AS weight FROM s WHERE sink_class IS NOT NULL)"""
# a file whose first parts are absent starts later: line numbers are relative to it
_FIRST = ("FROM h JOIN (SELECT artifact_id, path, min(line_no) AS f FROM v_code_lines GROUP BY ALL) "
          "USING (artifact_id, path)")


@query("sink_lines", SINK_LINES + f"""
SELECT artifact_id, path, line_no - f + 1 AS line_no, sink_class, weight {_FIRST}""")
def sink_lines(spark, sf):
    return corpus.sink_lines(code(spark, sf)).drop("sink")


@query("sink_scores", SINK_LINES + """
SELECT artifact_id, path, CAST(sum(weight) AS BIGINT) AS score, count(*) AS sink_lines FROM h GROUP BY 1, 2""")
def sink_scores(spark, sf):
    return corpus.sink_scores(corpus.sink_lines(code(spark, sf)))


@query("sink_hints", SINK_LINES + f"""
SELECT artifact_id, path, line_no, rn FROM (SELECT artifact_id, path, line_no - f + 1 AS line_no,
  row_number() OVER (PARTITION BY artifact_id, path ORDER BY line_no) AS rn {_FIRST}) WHERE rn <= 25""")
def sink_hints(spark, sf):
    return corpus.sink_hints(corpus.sink_lines(code(spark, sf))).select(
        "artifact_id", "path", "line_no", "rn")


@query("second_look", SINK_LINES + """,
sc AS (SELECT artifact_id, path, sum(weight) AS score FROM h GROUP BY 1, 2),
c AS (SELECT *, contains(path, '1') AS unreviewed FROM sc WHERE NOT path LIKE '%.go')
SELECT artifact_id, path, CASE WHEN rn <= 3 THEN rn END AS position FROM (SELECT *, row_number() OVER (
  PARTITION BY artifact_id ORDER BY CASE WHEN unreviewed THEN 1 ELSE 0 END DESC, score DESC, path) AS rn FROM c)""")
def second_look(spark, sf):
    files = code(spark, sf)
    scores = corpus.sink_scores(corpus.sink_lines(files))
    found = files.where(F.col("path").endswith(".go")).select(
        "artifact_id", F.col("path").alias("file_path"))
    from auditspan.operators.matching import silent_sink_files
    rows = silent_sink_files(scores, found).withColumn("unreviewed", F.col("path").contains("1"))
    return rollups.second_look_queue(rows, cap=3).select("artifact_id", "path", "position")


# ---- evidence ----------------------------------------------------------------------------------
# Every document is cited once: by its path, with a lost prefix, by base name under
# another directory, or by a name nobody has; with a line of its own, of its
# neighbour, a made-up one, or none.
CITED = """
SELECT artifact_id, doc_id, concat('f', doc_id) AS finding_id,
  CASE doc_id % 6 WHEN 0 THEN concat('./', path) WHEN 1 THEN split_part(path, '/', 3)
    WHEN 2 THEN concat('old/place/', split_part(path, '/', 3)) WHEN 3 THEN concat('gone/', path, 'x')
    ELSE path END AS file_path,
  CAST(CASE doc_id % 7 WHEN 6 THEN 400 ELSE doc_id % 5 END AS INT) AS line_start,
  CAST(CASE doc_id % 7 WHEN 6 THEN 402 ELSE doc_id % 5 + doc_id % 3 END AS INT) AS line_end,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'this line is in no file at all' END AS fixed_snippet,
  doc_id % 4 AS kind, CASE doc_id % 3 WHEN 0 THEN 'confirmed' ELSE 'proposed' END AS state,
  CAST(0.9 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR(10)) AS triage_note, path
FROM v_files"""
VIEWS["v_cited"] = CITED


def cited(spark, sf):
    rows = view(spark, sf, "v_cited").join(docs(spark, sf).select(
        "artifact_id", "path", text.lines_of(F.col("content")).alias("_l")),
        ["artifact_id", "path"])
    own = F.try_element_at("_l", F.when(F.col("kind") == 2, F.size("_l")).otherwise(1))
    return rows.withColumn("code_snippet", F.coalesce("fixed_snippet", F.when(
        F.col("kind") >= 2, own))).drop("_l", "path", "fixed_snippet", "kind", "doc_id")


EVIDENCE = f"""
WITH ln AS (SELECT artifact_id, path, line_no, {collapse_sql('text')} AS t FROM ({DOC_LINES})),
n AS (SELECT artifact_id, path, max(line_no) AS n FROM ln GROUP BY 1, 2),
c AS (SELECT v.*, CASE WHEN doc_id % 6 = 3 THEN NULL ELSE v.path END AS resolved, coalesce(fixed_snippet,
  CASE WHEN kind >= 2 THEN (SELECT t FROM ln WHERE ln.artifact_id = v.artifact_id AND ln.path = v.path
    AND ln.line_no = CASE WHEN kind = 2 THEN n.n ELSE 1 END) END) AS snip, n.n
  FROM v_cited v JOIN n ON n.artifact_id = v.artifact_id AND n.path = v.path),
p AS (SELECT *, trim(regexp_replace(snip, '^\\s*\\d+\\s*[:|]\\s?', '')) AS probe0 FROM c),
q AS (SELECT *, CASE WHEN length(probe0) >= 8 AND NOT contains(probe0, '...') AND NOT contains(probe0, '…')
  AND NOT regexp_full_match(probe0, '[^\\pL\\pN]+') THEN probe0 END AS probe FROM p),
h AS (SELECT q.finding_id, ln.line_no AS h FROM q JOIN ln ON ln.artifact_id = q.artifact_id
  AND ln.path = q.resolved AND contains(ln.t, q.probe)),
g AS (SELECT q.finding_id, bool_or(h BETWEEN line_start - 6 AND greatest(line_end, line_start) + 6) AS near,
  arg_min(h, abs(h - line_start) * 1000000 + h) AS nearest FROM q JOIN h USING (finding_id) GROUP BY 1),
e AS (SELECT q.*, g.nearest, CASE WHEN resolved IS NULL THEN 'file_missing' WHEN g.near THEN 'verified'
  WHEN g.nearest IS NOT NULL THEN 'relocated'
  WHEN line_start BETWEEN 1 AND n THEN CASE WHEN probe IS NOT NULL THEN 'snippet_mismatch' ELSE 'location_only' END
  ELSE 'line_out_of_range' END AS evidence_status FROM q LEFT JOIN g USING (finding_id))"""


@query("evidence_check", EVIDENCE + """
SELECT finding_id, coalesce(resolved, file_path) AS file_path, evidence_status,
  CASE WHEN evidence_status = 'relocated' THEN nearest ELSE line_start END AS line_start,
  CASE evidence_status WHEN 'file_missing' THEN 0.1 WHEN 'snippet_mismatch' THEN 0.5 WHEN 'line_out_of_range' THEN 0.25 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN evidence_status = 'file_missing' THEN 'dismissed' WHEN evidence_status = 'line_out_of_range' THEN 'proposed' ELSE state END AS state
FROM e""")
def evidence_check(spark, sf):
    return evidence.check_evidence(cited(spark, sf), docs(spark, sf)).select(
        "finding_id", "file_path", "evidence_status", "line_start", "confidence", "state")


@query("evidence_stats", EVIDENCE + " SELECT evidence_status, count(*) AS n FROM e GROUP BY 1")
def evidence_stats(spark, sf):
    return evidence.evidence_histogram(evidence.check_evidence(
        cited(spark, sf), docs(spark, sf)))


@query("citation_paths", """
SELECT artifact_id, file_path, CASE WHEN doc_id % 6 = 3 THEN NULL ELSE path END AS resolved FROM v_cited""")
def citation_paths(spark, sf):
    return evidence.resolve_citations(view(spark, sf, "v_cited"), docs(spark, sf))


@query("stored_path_repair", """
SELECT artifact_id, finding_id, CASE doc_id % 6 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE path END AS repaired
FROM v_cited""")
def stored_path_repair(spark, sf):
    return evidence.repair_stored_paths(view(spark, sf, "v_cited"), docs(spark, sf)).select(
        "artifact_id", "finding_id", "repaired")


@query("benchmark_quotes", f"""
WITH ln AS (SELECT artifact_id, path, line_no, {collapse_sql('text')} AS t FROM ({DOC_LINES})),
b AS (SELECT item_id, unnest({lines_sql('text')}) AS raw FROM benchmark),
q AS (SELECT DISTINCT item_id, {collapse_sql('raw')} AS t FROM b)
SELECT q.item_id, ln.artifact_id, ln.path, count(DISTINCT q.t) AS shared_lines FROM q JOIN ln ON ln.t = q.t
WHERE length(q.t) >= 8 GROUP BY 1, 2, 3""")
def benchmark_quotes(spark, sf):
    """Documents that hold whole lines of a benchmark text (equality, not search)."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.explode(
        text.lines_of(F.col("text"))).alias("t")).select(
        "item_id", text.collapse(F.col("t")).alias("t")).where(F.length("t") >= 8).distinct()
    # documents come in few files: texts are dealt anew before their lines are compared
    lines = docs(spark, sf).select("artifact_id", "path", "content").repartition("artifact_id", "path").select(
        "artifact_id", "path", text.lines_of(F.col("content")).alias("lines")).select(
        "artifact_id", "path", F.explode(F.transform("lines", text.collapse)).alias("t"))
    return quotes.join(lines, "t").distinct().groupBy("item_id", "artifact_id", "path").agg(
        F.count(F.lit(1)).alias("shared_lines"))


# ---- windows, excerpts, symbols ---------------------------------------------------------------
@query("code_windows", f"""
WITH ln AS ({DOC_LINES})
SELECT v.finding_id, string_agg(CASE WHEN line_no IS NOT NULL THEN concat(line_no, ': ', text) END, chr(10) ORDER BY line_no) AS source_context
FROM v_cited v LEFT JOIN ln ON ln.artifact_id = v.artifact_id AND ln.path = v.file_path
  AND line_no BETWEEN greatest(CASE WHEN line_start = 0 THEN 1 ELSE line_start END - 2, 1)
  AND CASE WHEN line_end = 0 THEN CASE WHEN line_start = 0 THEN 1 ELSE line_start END ELSE line_end END + 2 GROUP BY 1""")
def code_windows(spark, sf):
    rows = view(spark, sf, "v_cited").withColumn("code_snippet", F.lit(None).cast("string"))
    return corpus.code_windows(rows, docs(spark, sf), radius=2).select(
        "finding_id", "source_context")


@query("merged_ranges", """
WITH r AS (SELECT concat('f', l_partkey % 500) AS path, CAST(l_quantity * 7 AS INT) AS lo,
  CAST(l_quantity * 7 AS INT) + l_linenumber AS hi FROM lineitem),
o AS (SELECT *, max(hi) OVER (PARTITION BY path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR lo > m + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY lo, hi
  ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT path, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY path, g""")
def merged_ranges(spark, sf):
    from auditspan.operators.ordered import merge_ranges
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_partkey") % 500).alias("path"),
        (F.col("l_quantity") * 7).cast("int").alias("lo"),
        ((F.col("l_quantity") * 7).cast("int") + F.col("l_linenumber")).alias("hi"))
    return merge_ranges(rows, ["path"])


SYMBOL = """
WITH d AS (SELECT artifact_id, path, line_no, nullif(coalesce(
  nullif(regexp_extract(text, '^\\s*(?:export\\s+)?(?:async\\s+)?(?:def|function|func|fun)\\s+(?:\\([^)]*\\)\\s*)?(\\w+)', 1), ''),
  regexp_extract(text, '^\\s*(?:(?:public|private|protected|internal|static|final|override|virtual|async|synchronized)\\s+)+[\\w<>\\[\\],?.]+\\s+(\\w+)\\s*\\(', 1)), '') AS name
  FROM v_code_lines)"""


@query("enclosing_symbols", SYMBOL + """,
f AS (SELECT artifact_id, path, line_no FROM v_code_lines
  QUALIFY NOT (text = '' AND line_no = max(line_no) OVER (PARTITION BY artifact_id, path))),
b AS (SELECT artifact_id, path, min(line_no) AS lo FROM v_code_lines GROUP BY 1, 2)
SELECT f.artifact_id, f.path AS file_path, f.line_no - b.lo + 1 AS line_start, (SELECT CASE WHEN length(arg_max(d.name, d.line_no)) >= 4
  THEN arg_max(d.name, d.line_no) END FROM d WHERE d.artifact_id = f.artifact_id AND d.path = f.path AND d.name IS NOT NULL
  AND d.line_no <= f.line_no AND d.line_no > f.line_no - 199) AS symbol
FROM f JOIN b USING (artifact_id, path)""")
def enclosing_symbols(spark, sf):
    files = code(spark, sf)
    spots = corpus.numbered_lines(files).select(
        "artifact_id", F.col("path").alias("file_path"), F.col("line_no").alias("line_start"))
    return corpus.enclosing_symbols(spots, files)


@query("call_sites", SYMBOL + """,
b AS (SELECT artifact_id, path, min(line_no) AS lo FROM v_code_lines GROUP BY 1, 2),
s AS (SELECT DISTINCT artifact_id, concat('helper', k % 90) AS symbol FROM v_code_parts
  JOIN (SELECT DISTINCT artifact_id FROM v_code_lines) ON artifact_id = concat('art', art)),
t AS (SELECT l.artifact_id, l.path, l.line_no, unnest(regexp_extract_all(l.text, '\\b(\\w+)\\s*\\(', 1)) AS symbol
  FROM v_code_lines l JOIN d ON d.artifact_id = l.artifact_id AND d.path = l.path AND d.line_no = l.line_no AND d.name IS NULL),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.artifact_id, t.symbol ORDER BY t.path, t.line_no) AS rn
  FROM t JOIN s ON s.artifact_id = t.artifact_id AND s.symbol = t.symbol)
SELECT r.artifact_id, r.symbol, r.path, r.line_no - lo + 1 AS line_no, r.rn FROM r JOIN b USING (artifact_id, path)""")
def call_sites(spark, sf):
    symbols = view(spark, sf, "v_code_parts").select(
        F.concat(F.lit("art"), "art").alias("artifact_id"),
        F.concat(F.lit("helper"), F.col("k") % 90).alias("symbol"))
    return corpus.call_sites(code(spark, sf), symbols).select(
        "artifact_id", "symbol", "path", "line_no", "rn")


@query("code_excerpts", """
WITH b AS (SELECT artifact_id, path, min(line_no) AS lo, max(line_no) AS hi FROM v_code_lines GROUP BY 1, 2),
x AS (SELECT artifact_id, path, CAST(line_no - lo + 1 AS INT) AS n, text, CAST(hi - lo + 1 AS INT) AS total FROM v_code_lines JOIN b USING (artifact_id, path)),
k AS (SELECT a.artifact_id, a.path, a.n, a.text FROM x a WHERE EXISTS (SELECT 1 FROM x e WHERE e.artifact_id = a.artifact_id
  AND e.path = a.path AND e.n % 20 = 1 AND (a.n BETWEEN e.n - 3 AND e.n + 3 OR a.n BETWEEN e.n - 2 AND e.n + 3))),
-- ranges reach n-3..n+3 around every 20th line and never touch
g AS (SELECT *, CAST(round((n - 1) / 20.0) AS INT) AS grp FROM k),
s AS (SELECT artifact_id, path, grp, string_agg(concat(n, ': ', text), chr(10) ORDER BY n) AS part FROM g GROUP BY 1, 2, 3)
SELECT artifact_id, path AS file_path, string_agg(part, concat(chr(10), '...', chr(10)) ORDER BY grp)[:40000] AS excerpt FROM s GROUP BY 1, 2""")
def code_excerpts(spark, sf):
    files = code(spark, sf)
    eps = corpus.numbered_lines(files).where(F.col("line_no") % 20 == 1).select(
        "artifact_id", F.col("path").alias("file_path"), F.col("line_no").alias("line"),
        F.col("path").alias("handler_file"), F.col("line_no").alias("handler_start"),
        (F.col("line_no") + 2).alias("handler_end"))
    return corpus.excerpts(corpus.excerpt_ranges(eps), files)


# ---- packing -----------------------------------------------------------------------------------
JSON_LEN = (r"(2 + length(content) + length(regexp_replace(content, '[^\x22\\\n\r\t\x08\x0C]', '', 'g')) "
            r"+ 5 * length(regexp_replace(content, '[\x08\x09\x0A\x0C\x0D\x20-\x7E]', '', 'g')) "
            r"+ 6 * length(regexp_replace(content, '[\x{0}-\x{FFFF}]', '', 'g')))")
TOKENS = f"SELECT artifact_id, path, CAST(floor({JSON_LEN} / 3.0) AS BIGINT) AS tokens FROM v_files"


@query("file_tokens", TOKENS)
def file_tokens(spark, sf):
    return packing.file_tokens(docs(spark, sf))


@query("batch_pack", f"""
WITH RECURSIVE t AS ({TOKENS}),
o AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY path) AS n FROM t),
p AS (SELECT artifact_id, path, tokens, n, tokens AS used, CAST(0 AS BIGINT) AS batch FROM o WHERE n = 1
  UNION ALL SELECT o.artifact_id, o.path, o.tokens, o.n,
    CASE WHEN p.used + o.tokens > 4000 THEN o.tokens ELSE p.used + o.tokens END,
    CASE WHEN p.used + o.tokens > 4000 THEN p.batch + 1 ELSE p.batch END
  FROM p JOIN o ON o.artifact_id = p.artifact_id AND o.n = p.n + 1)
SELECT artifact_id, path, batch FROM p""")
def batch_pack(spark, sf):
    return packing.pack_batches(packing.file_tokens(docs(spark, sf)), 4000).select(
        "artifact_id", "path", "batch")


@query("batch_halves", f"""
WITH b AS (SELECT artifact_id, path, row_number() OVER (PARTITION BY artifact_id ORDER BY path) AS n FROM v_files),
c AS (SELECT artifact_id, path, (n - 1) // 7 AS batch, row_number() OVER (PARTITION BY artifact_id, (n - 1) // 7 ORDER BY path) AS k,
  count(*) OVER (PARTITION BY artifact_id, (n - 1) // 7) AS m FROM b)
SELECT artifact_id, path, batch, CASE WHEN k <= m // 2 THEN 'a' ELSE 'b' END AS half FROM c""")
def batch_halves(spark, sf):
    chunks = packing.fixed_chunks(docs(spark, sf).select("artifact_id", "path"), 7,
                                  ["artifact_id"], ["path"])
    return packing.split_by_file(chunks.select("artifact_id", "path",
                                               F.col("chunk").alias("batch")))


@query("fixed_chunks", """
SELECT scan_id, finding_id, (n - 1) // 20 AS chunk, (n - 1) % 20 AS ord FROM (SELECT source AS scan_id, finding_id,
  row_number() OVER (PARTITION BY source ORDER BY finding_id) AS n FROM v_findings)""")
def fixed_chunks(spark, sf):
    rows = view(spark, sf, "v_findings").select(F.col("source").alias("scan_id"), "finding_id")
    return packing.fixed_chunks(rows, 20, ["scan_id"], ["finding_id"])


@query("line_halves", f"""
WITH n AS (SELECT artifact_id, path, len({lines_sql('content')}) AS n FROM v_files)
SELECT artifact_id, path, unnest(['a', 'b']) AS half, unnest([0, CAST(n // 2 AS INT)]) AS line_offset,
  unnest([n // 2, n - n // 2]) AS n_lines FROM n WHERE n > 1""")
def line_halves(spark, sf):
    return packing.split_by_lines(docs(spark, sf)).select(
        "artifact_id", "path", "half", "line_offset", F.size("lines").alias("n_lines"))


@query("shifted_hits", """
SELECT finding_id, CASE WHEN coalesce(line_start, 1) <= 25 THEN 'a' ELSE 'b' END AS half,
  CASE WHEN coalesce(line_start, 1) <= 25 THEN line_start ELSE greatest(1, line_start - 25) END AS line_start FROM v_findings""")
def shifted_hits(spark, sf):
    return packing.shift_lines(view(spark, sf, "v_findings"), F.lit(25)).select(
        "finding_id", "half", "line_start")


@query("archive_guard", """
WITH m AS (SELECT source AS archive, doc_id AS ord, n_chars AS size,
  CASE doc_id % 11 WHEN 0 THEN '../up' WHEN 1 THEN 'a/../../b' ELSE concat('dir/', doc_id) END AS member,
  CASE doc_id % 13 WHEN 0 THEN 'link' ELSE 'file' END AS kind FROM documents),
r AS (SELECT *, count(*) OVER w AS n, sum(size) OVER w AS total FROM m WHERE kind = 'file'
  WINDOW w AS (PARTITION BY archive ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT archive, ord, n, CAST(total AS BIGINT) AS total_bytes, CASE WHEN n > 40 THEN 'file count' WHEN total > 60000 THEN 'extracted size'
  WHEN ord % 11 < 2 THEN 'path escape' END AS violation FROM r""")
def archive_guard(spark, sf):
    members = spark_sql(spark, sf, """
SELECT source AS archive, doc_id AS ord, n_chars AS size,
  CASE doc_id % 11 WHEN 0 THEN '../up' WHEN 1 THEN 'a/../../b' ELSE concat('dir/', doc_id) END AS member,
  CASE doc_id % 13 WHEN 0 THEN 'link' ELSE 'file' END AS kind FROM @documents""")
    return guard_members(members, max_files=40, max_bytes=60_000).select(
        "archive", "ord", "n", "total_bytes", "violation")


# ---- text helpers over whole texts ----------------------------------------------------------------
CAUSE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(m, '{w}')" for w in words) + f" THEN '{cause}'"
    for cause, _, words in fixed.ERROR_CAUSES) + " ELSE 'unknown' END"


@query("error_causes", f"SELECT doc_id, {CAUSE} AS cause FROM (SELECT doc_id, lower(text) AS m FROM documents)")
def error_causes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.error_cause(F.col("text"))
                                                .alias("cause"))


@query("context_budgets", """
WITH m AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'gpt-5-x' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'o3-mini'
  WHEN 3 THEN 'local' ELSE 'my-codex' END AS model, o_orderkey % 2 = 0 AS reasoning,
  CASE WHEN o_orderkey % 3 = 0 THEN 32000 END AS stated FROM orders),
w AS (SELECT *, CASE WHEN model LIKE '%gpt-5%' THEN 272000 WHEN model LIKE '%gpt-4o%' THEN 128000 WHEN model LIKE '%codex%' THEN 272000
  WHEN model LIKE '%o3%' THEN 200000 ELSE 128000 END AS ctx, CASE WHEN reasoning THEN 80000 ELSE 16000 END AS reserve FROM m)
SELECT k, ctx AS context_window, CAST(CASE WHEN stated IS NOT NULL THEN greatest(stated - least(reserve, stated // 4) - 3000, 2000)
  ELSE greatest(ctx - reserve - 3000, 20000) END AS BIGINT) AS budget FROM w""")
def context_budgets(spark, sf):
    k = F.col("k")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select(
        "k", text.lookup(k % 5, {0: "gpt-5-x", 1: "gpt-4o", 2: "o3-mini", 3: "local"},
                         "my-codex").alias("model"))
    window = text.context_window(F.col("model"))
    return rows.select("k", window.alias("context_window"), text.batch_budget(
        window, k % 2 == 0, F.when(k % 3 == 0, 32000)).alias("budget"))


@query("body_hashes", """
SELECT page_id, left(sha256(html), 16) AS body_hash, length(html) AS n FROM pages""")
def body_hashes(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.body_hash(F.col("html")).alias("body_hash"), F.length("html").alias("n"))


@query("html_stripped", """
SELECT page_id, md5(trim(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), E' \\t\\n\\r')) AS plain_hash,
  md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_hash
FROM pages""")
def html_stripped(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("plain_hash"),
        F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped_hash"))


@query("model_answers", """
SELECT scan_id, 'T' AS title, CAST(n AS VARCHAR) AS line_start FROM (SELECT doc_id AS scan_id, n_chars AS n FROM documents) WHERE scan_id % 4 <> 3""")
def model_answers(spark, sf):
    """Findings recovered from chatty answers around every document's text."""
    from auditspan.sources.results import model_answers as parse
    doc = F.to_json(F.struct(F.array(F.struct(
        F.lit("T").alias("title"), F.col("n_chars").alias("line_start"),
        F.col("text").alias("description"))).alias("findings")))
    answer = (F.when(F.col("doc_id") % 4 == 0, doc)
              .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<think>a {b} c</think>\n"), doc))
              .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Here: "), doc, F.lit(" done.")))
              .otherwise(F.lit("no answer")))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("scan_id"),
                                                answer.alias("answer"))
    return parse(rows).select("scan_id", "title", "line_start")


@query("test_paths", f"""
SELECT doc_id, regexp_matches(path, {quoted(fixed.TEST_PATH)}) AS is_test FROM v_files""")
def test_paths(spark, sf):
    return docs(spark, sf).select("doc_id", paths.is_test_path(F.col("path")).alias("is_test"))


@query("client_slugs", """
SELECT n_nationkey AS id, left(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-'), 120) AS slug FROM nation
UNION ALL SELECT c_custkey + 1000, left(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 120) FROM customer""")
def client_slugs(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"),
                                          text.slug(F.col("n_name")).alias("slug"))
    return n.unionByName(table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000).alias("id"), text.slug(F.col("c_name")).alias("slug")))


@query("finding_labels", """
SELECT finding_id, lower(trim(coalesce(cwe, category, title))) AS group_key,
  coalesce(regexp_extract(cwe, '\\d+'), '') AS cwe_number,
  coalesce(cwe, replace(lower(title), ' ', '-')) AS sarif_rule,
  CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS sarif_level,
  CASE WHEN confidence > 0.8 THEN 'Certain' WHEN confidence > 0.5 THEN 'Firm' ELSE 'Tentative' END AS confidence_band,
  CAST(concat('0x', left(md5(finding_id), 12)) AS BIGINT) AS serial
FROM v_findings""")
def finding_labels(spark, sf):
    c = F.col
    return view(spark, sf, "v_findings").select(
        "finding_id", labels.group_key(c("cwe"), c("category"), c("title")).alias("group_key"),
        labels.cwe_number(c("cwe")).alias("cwe_number"),
        labels.sarif_rule_id(c("cwe"), c("title")).alias("sarif_rule"),
        labels.sarif_level(c("severity")).alias("sarif_level"),
        labels.issue_confidence(c("confidence")).alias("confidence_band"),
        labels.serial_number(c("finding_id")).cast("bigint").alias("serial"))
