"""Queries over the block table and the symbol index."""

from pyspark.sql import functions as F

from auditspan.operators import blocks

from .base import VIEWS, query, view
from .corpus import SYMBOL, code

# Eight lines of nested code per part, 20 parts a file, four languages. p is where a part starts.
VIEWS["v_box_parts"] = """
SELECT p_partkey AS k, concat('art', CAST(floor(p_partkey / 1000) AS BIGINT)) AS artifact_id, CAST(floor(p_partkey / 20) AS BIGINT) % 4 AS lang,
  concat('lib', CAST(floor(p_partkey / 20) AS BIGINT), '/box', CASE CAST(floor(p_partkey / 20) AS BIGINT) % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java'
    WHEN 2 THEN '.rb' ELSE '.js' END) AS path,
  CAST(8 * (row_number() OVER (PARTITION BY CAST(floor(p_partkey / 20) AS BIGINT) ORDER BY p_partkey) - 1) AS INT) AS p,
  p_partkey = max(p_partkey) OVER (PARTITION BY CAST(floor(p_partkey / 20) AS BIGINT)) AS last
FROM @part"""
_TEXT = {
    0: ["concat('class Box', k, '(LoginRequiredMixin):')", "concat('    # note ', k)", "'    @cached'",
        "concat('    def open', k, '(self, box_id):')", "'        if box_id:'", "'            return ['", "'    ]'", "''"],
    1: ["'@Secured(\"KEEPER\")'", "concat('public class Box', k, ' {')", "'  // note'", "'  @Override'",
        "concat('  public String open', k, '(Long boxId) {')", "'    if (x) { y(); }'", "'  }'", "'}'"],
    2: ["concat('class Box', k)", "'  before_action :auth_user'", "'  # note'", "concat('  def open', k, '(box)')",
        "'    if box'", "'    end'", "'  end'", "'end'"],
    3: ["concat('export class Box', k, ' {')", "'  /* note */'", "concat('  async function open', k, '(req) {')",
        "'    return { a: 1 };'", "'  }'", "'}'", "concat('const show', k, ' = (req) => reply(req);')", "''"],
}
VIEWS["v_box_lines"] = "SELECT artifact_id, path, p + n AS line_no, CASE lang * 10 + n " + " ".join(
    f"WHEN {lang * 10 + n} THEN {t}" for lang, texts in _TEXT.items() for n, t in enumerate(texts, 1)) + \
    " END AS text FROM v_box_parts CROSS JOIN (" + " UNION ALL ".join(f"SELECT {n} AS n" for n in range(1, 9)) + ")"
# (kind, name, line, lo, hi, open ended in the last part, depth) from the start of a part
_BLOCKS = {
    0: [("class", "concat('Box', k)", 1, 1, 7, False, 0), ("def", "concat('open', k)", 4, 2, 7, False, 1),
        ("scope", "concat('open', k)", 4, 4, 11, True, 0), ("guard", "'LoginRequiredMixin'", 1, 2, None, True, 0)],
    1: [("class", "concat('Box', k)", 2, 1, 8, False, 0), ("def", "concat('open', k)", 5, 3, 7, False, 1),
        ("scope", "concat('open', k)", 5, 5, 12, True, 0), ("guard", "'@Secured'", 1, 2, 9, True, 0)],
    2: [("class", "concat('Box', k)", 1, 1, 8, False, 0), ("def", "concat('open', k)", 4, 3, 7, False, 1),
        ("scope", "concat('open', k)", 4, 4, 11, True, 0), ("guard", "'before_action :auth_user'", 2, 3, None, True, 0)],
    3: [("class", "concat('Box', k)", 1, 1, 6, False, 0), ("def", "concat('open', k)", 3, 2, 5, False, 1),
        ("scope", "concat('open', k)", 3, 3, 6, False, 0), ("def", "concat('show', k)", 7, 7, 7, False, 0),
        ("scope", "concat('show', k)", 7, 7, 10, True, 0)],
}


def _facts():
    parts = []
    for lang, rows in _BLOCKS.items():
        for kind, name, line, lo, hi, opens, depth in rows:
            end = "CAST(NULL AS INT)" if hi is None else f"CASE WHEN last THEN NULL ELSE p + {hi} END" if opens else f"p + {hi}"
            parts.append(f"SELECT artifact_id, path, '{kind}' AS kind, {name} AS name, p + {line} AS line, p + {lo} AS lo, "
                         f"{end} AS hi, {depth} AS depth FROM v_box_parts WHERE lang = {lang}")
    return "\nUNION ALL ".join(parts)


VIEWS["v_box_blocks"] = _facts()


def boxes(spark, sf):
    """Derived files of nested code; a file holds at most 160 lines."""
    return view(spark, sf, "v_box_lines").groupBy("artifact_id", "path").agg(F.concat_ws("\n", F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])).alias("content"))


@query("code_blocks", "SELECT * FROM v_box_blocks")
def code_blocks(spark, sf):
    return blocks.code_blocks(boxes(spark, sf), kinds=("def", "class", "scope", "guard"))


# lines 1 and 4 of every part, three lines of reach below and one above
_ASKED = {0: [(1, 1, 4), (4, 3, 7)], 1: [(1, 1, 4), (4, 3, 7)], 2: [(1, 1, 4), (4, 3, 7)], 3: [(1, 1, 4), (4, 4, 4)]}


@query("asked_blocks", "\nUNION ALL ".join(
    f"SELECT b.artifact_id, b.path, b.p + {line} AS line, b.p + {lo} AS lo, b.p + {hi} AS hi, trim(l.text) AS name FROM v_box_parts b "
    f"JOIN v_box_lines l ON l.artifact_id = b.artifact_id AND l.path = b.path AND l.line_no = b.p + {line} WHERE b.lang = {lang}"
    for lang, rows in _ASKED.items() for line, lo, hi in rows))
def asked_blocks(spark, sf):
    parts = view(spark, sf, "v_box_parts")
    lines = parts.select("artifact_id", "path", F.explode(F.array(F.col("p") + 1, F.col("p") + 4)).alias("line"))
    return blocks.code_blocks(boxes(spark, sf), kinds=("asked",), asked=lines, reach=3, lead=1).select(
        "artifact_id", "path", "line", "lo", "hi", "name")


@query("covering_blocks", """
SELECT l.artifact_id, l.path, CAST(l.line_no AS INT) AS line, b.line AS block_line, b.name FROM v_box_lines l JOIN v_box_blocks b
  ON b.artifact_id = l.artifact_id AND b.path = l.path AND b.lo <= l.line_no AND (b.hi IS NULL OR l.line_no <= b.hi)""")
def covering_blocks(spark, sf):
    """Every line with every block that holds it."""
    lines = view(spark, sf, "v_box_lines").select("artifact_id", "path", F.col("line_no").cast("int").alias("line"))
    return blocks.stabbed(lines, blocks.code_blocks(boxes(spark, sf), kinds=("def", "class", "scope", "guard")))


_WORDS = ("(?:\\bdef|\\bfunction|\\bfunc|\\bclass|\\bpublic|\\bprivate|\\bprotected|\\basync|\\bconst|\\blet|\\bvar)"
          "\\s+((?:[\\w<>\\[\\],?]+\\s+)*[\\w<>\\[\\],?]*)")
INDEX = SYMBOL + f""",
b AS (SELECT artifact_id, path, min(line_no) AS lo FROM v_code_lines GROUP BY 1, 2),
l AS (SELECT c.artifact_id, c.path, c.line_no, CAST(c.line_no - b.lo + 1 AS INT) AS line, c.text, d.name FROM v_code_lines c
  JOIN b USING (artifact_id, path) JOIN d ON d.artifact_id = c.artifact_id AND d.path = c.path AND d.line_no = c.line_no),
w AS (SELECT artifact_id, path, line, list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '{_WORDS}', 1),
  lambda x: regexp_split_to_array(trim(x), '\\s+'))), lambda x: regexp_extract(x, '^\\w+')), lambda x: x <> '') AS names FROM l),
c AS (SELECT artifact_id, path, line, regexp_extract_all(text, '\\b(\\w+)\\s*\\(', 1) AS names FROM l WHERE name IS NULL),
x AS (SELECT artifact_id, name AS symbol, path, line, 'def' AS kind, CAST(0 AS INT) AS nth FROM l WHERE name IS NOT NULL
  UNION ALL SELECT artifact_id, unnest(names), path, line, 'word', CAST(generate_subscripts(names, 1) - 1 AS INT) FROM w
  UNION ALL SELECT artifact_id, unnest(names), path, line, 'call', CAST(generate_subscripts(names, 1) - 1 AS INT) FROM c
  UNION ALL SELECT artifact_id, regexp_extract(text, '^\\s*def\\s+(\\w+)', 1), path, line, 'method', 0 FROM l WHERE regexp_matches(text, '^\\s*def\\s+\\w'))"""


@query("symbol_index", INDEX + " SELECT * FROM x")
def symbol_index(spark, sf):
    return blocks.symbol_index(code(spark, sf))


@query("symbol_counts", INDEX + """
SELECT artifact_id, symbol, kind, count(*) AS uses, count(DISTINCT path) AS files FROM x GROUP BY 1, 2, 3""")
def symbol_counts(spark, sf):
    return blocks.symbol_counts(blocks.symbol_index(code(spark, sf)))
