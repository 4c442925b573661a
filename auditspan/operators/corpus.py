"""File index, numbered lines, rule and sink hits, definitions and code windows.

A file is one row, capped in size before its content is touched, so work inside
a file uses array expressions on that row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels, paths, text
from ..functions.text import uni
from .blocks import code_blocks, line_windows, stabbed, symbol_index
from .ordered import merge_ranges, ordered_position, top_n

DOC = ("artifact_id",)


# ---- file index (S1 filters, P1-P8, D12) --------------------------------
def file_index(files: DataFrame, cap: int = fixed.MAX_REVIEW_BYTES,
               prune: bool = True) -> DataFrame:
    """Classify every walked file. Needs path, size_bytes, content (binary)."""
    path, size = F.col("path"), F.col("size_bytes")
    walked = files.where(~paths.is_pruned(path)) if prune else files
    content = F.col("content").cast("binary")
    flagged = walked.withColumn("is_binary", paths.is_binary(content))
    included = paths.is_included(path, size, F.col("is_binary"), cap)
    return flagged.select(
        *[c for c in files.columns if c != "content"],
        paths.language(path).alias("language"), "is_binary",
        paths.is_vendored(path).alias("is_vendored"),
        paths.is_noise(path).alias("is_noise"),
        paths.is_generated(path).alias("is_generated"),
        included.alias("included"),
        F.when(included, F.sha2(content, 256)).alias("sha256"))


def artifact_totals(index: DataFrame, keys=DOC) -> DataFrame:
    return index.groupBy(*keys).agg(
        F.sum("size_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"),
        F.count_if("included").alias("analyzable_count"))


def directory_rollup(index: DataFrame, selected: Column, keys=DOC) -> DataFrame:
    """Every ancestor directory with its descendant and selected-file counts."""
    rows = index.select(*keys, selected.alias("_sel"),
                        F.explode(paths.ancestors(F.col("path"))).alias("directory"))
    out = rows.groupBy(*keys, "directory").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("_sel").alias("selected"))
    return out.withColumn("check_state", F.when(F.col("selected") == 0, "unchecked")
                          .when(F.col("selected") == F.col("files"), "checked")
                          .otherwise("partial"))


def directory_children(index: DataFrame, keys=DOC) -> DataFrame:
    """One row per (directory, child), directories before files, then by name."""
    parts = F.split("path", "/")
    steps = F.transform(parts, lambda seg, i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory"),
        seg.alias("name"), (i == F.size(parts) - 1).cast("int").alias("is_file")))
    rows = index.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.*").distinct()
    return rows.orderBy(*keys, "directory", "is_file", "name")


def select_files(index: DataFrame, selections: list[str] | None = None,
                 included_only: bool = True) -> DataFrame:
    out = index.where("included") if included_only else index
    return out.where(paths.in_selection(F.col("path"), selections)) if selections else out


def list_files(index: DataFrame, included_only: bool = False, limit: int | None = None,
               keys=("artifact_id",)):
    """Listing in path order (S13/O11), of all files or of the first *limit* of each
    artifact."""
    rows = index.where("included") if included_only else index
    if limit is not None:
        rows = top_n(rows, list(keys), [F.col("path")], limit, "_place").drop("_place")
    return rows.orderBy(*keys, "path")


# ---- lines (S3) ----------------------------------------------------------
def numbered_lines(files: DataFrame, keep=("artifact_id", "path")) -> DataFrame:
    return files.select(*keep, F.posexplode(text.lines_of(F.col("content"))).alias(
        "_pos", "text")).select(*keep, (F.col("_pos") + 1).alias("line_no"), "text")


# ---- detection rules (T1) -------------------------------------------------
def rule_hits(files: DataFrame, rules, keep=("artifact_id", "path"),
              language: Column | None = None) -> DataFrame:
    """One row per (line, rule). Rules are literals of the plan, so every pattern
    is compiled once; literal tests skip whole files, then lines, before a pattern
    is tried."""
    lang = paths.language(F.col("path")) if language is None else language
    base = files.select(*keep, "content", lang.alias("_lang"))
    line_rules = [r for r in rules if r.pattern and not r.multiline]
    block_rules = [r for r in rules if r.pattern and r.multiline]
    parts = []
    if line_rules:
        lines = (base.where(_possible(F.col("content"), line_rules))
                 .select(*keep, "_lang", F.posexplode(text.lines_of(F.col("content")))
                         .alias("_pos", "text"))
                 .where(_possible(F.col("text"), line_rules)))
        hits = F.array_compact(F.array(*[
            F.when(_applies(r) & _possible(F.col("text"), [r])
                   & F.col("text").rlike(r.pattern), F.struct(
                F.lit(r.rule_id).alias("rule"),
                F.substring(F.regexp_extract("text", r.pattern, 0), 1, 200)
                .alias("matched"))) for r in line_rules]))
        parts.append(lines.select(*keep, (F.col("_pos") + 1).alias("line_no"),
                                  F.explode(hits).alias("h"))
                     .select(*keep, "line_no", "h.rule", "h.matched"))
    for r in block_rules:
        found = base.where(_applies(r) & _possible(F.col("content"), [r])
                           & F.col("content").rlike(r.pattern))
        rows = F.arrays_zip(
            _match_lines(F.col("content"), r.pattern).alias("n"),
            F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0)).alias("m"))
        parts.append(found.select(*keep, F.explode(rows).alias("h")).select(
            *keep, F.col("h.n").alias("line_no"), F.lit(r.rule_id).alias("rule"),
            F.substring(F.col("h.m"), 1, 200).alias("matched")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _possible(content: Column, rules) -> Column:
    """Cheap literal test ahead of the patterns; a rule without needles may match.
    The one-element array binds the lower-cased text once for all needles."""
    words = sorted({n for r in rules for n in r.needles})
    if not all(r.needles for r in rules):
        return F.lit(True)
    return F.exists(F.array(F.lower(content)), lambda low: text.contains_any(low, words))


def _applies(rule) -> Column:
    if "generic" in rule.languages:
        return F.lit(True)
    return F.coalesce(F.col("_lang").isin(*rule.languages), F.lit(False))


#: Stands in front of a match; no character of a text.
_MARK, _NOT_MARK = "\uffff", "\ufffe"


def _match_lines(content: Column, pattern: str) -> Column:
    """1-based line of every match of a multi-line pattern, in one pass: matches are
    marked where they begin, and each line counts for every mark it holds."""
    marked = F.regexp_replace(F.replace(content, F.lit(_MARK), F.lit(_NOT_MARK)), F.lit(pattern), F.lit(_MARK + "$0"))
    return F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: F.array_repeat(
        i + 1, F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit(""))))))


def rule_candidates(hits: DataFrame, rules, keep=("artifact_id", "path")) -> DataFrame:
    """Rule hits in the scanner-candidate layout."""
    meta = F.col("rule")
    pick = lambda f: text.lookup(meta, {r.rule_id: f(r) for r in rules if r.pattern})
    return hits.select(
        *[k for k in keep if k != "path"], F.lit("semgrep").alias("source"), "rule",
        F.col("rule").alias("title"), pick(lambda r: r.message).alias("message"),
        pick(lambda r: fixed.SAST_SEVERITY[r.severity]).alias("severity"),
        pick(lambda r: r.cwe).alias("cwe"), pick(lambda r: r.owasp).alias("owasp"),
        pick(lambda r: r.category).alias("category"), F.col("path").alias("file_path"),
        F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
        F.col("matched").alias("code_snippet"))


# ---- sinks (T2, D10, P9, P10) --------------------------------------------
def sink_lines(files: DataFrame, keep=("artifact_id", "path")) -> DataFrame:
    """Lines of non-test files holding a dangerous sink; first class wins."""
    t = F.col("text")
    pats = [(cls, weight, uni(p)) for cls, weight, p in fixed.SINKS]
    gate = "|".join(f"(?:{p})" for _, _, p in pats)
    lines = (files.where(~paths.is_test_path(F.col("path")) & F.col("content").rlike(gate))
             .select(*keep, F.posexplode(text.lines_of(F.col("content")))
                     .alias("_pos", "text"))
             .where((F.length(t) <= 400) & t.rlike(gate)
                    & ~t.rlike(uni(fixed.COMMENT_LINE))))
    hit = F.coalesce(*[F.when(t.rlike(p), F.struct(
        F.lit(cls).alias("sink_class"), F.lit(weight).alias("weight"),
        F.substring(F.regexp_extract(t, p, 0), 1, 60).alias("sink")))
        for cls, weight, p in pats])
    return lines.select(*keep, (F.col("_pos") + 1).alias("line_no"), hit.alias("h")) \
        .where(F.col("h").isNotNull()).select(*keep, "line_no", "h.*")


def sink_scores(sinks: DataFrame, keep=("artifact_id", "path")) -> DataFrame:
    return sinks.groupBy(*keep).agg(F.sum("weight").alias("score"),
                                    F.count(F.lit(1)).alias("sink_lines"))


def sink_hints(sinks: DataFrame, keep=("artifact_id", "path"),
               n: int = fixed.HINTS_PER_FILE) -> DataFrame:
    """The first 25 sink lines of every file."""
    return top_n(sinks, keep, [F.col("line_no")], n, salts=1)


# ---- definitions and call sites (J13, J14) --------------------------------
def enclosing_symbols(findings: DataFrame, files: DataFrame, keys=DOC,
                      reach: int = 200) -> DataFrame:
    """Name of the nearest definition at or above each finding, NULL when it is
    generic, short, or more than *reach* lines away. Distinct lines are looked up in the
    block table; findings only meet the names."""
    rows = findings.withColumn("_line", F.coalesce(F.nullif(F.col("line_start"), F.lit(0)), F.lit(1)))
    asked = rows.select(*keys, F.col("file_path").alias("path"), F.col("_line").alias("line")).distinct()
    cited = files.join(asked.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")
    name = F.col("name")
    usable = ((F.length(name) >= 4) & ~F.lower(name).isin(*fixed.GENERIC_NAMES)
              & (F.col("block_line") > F.col("line") - reach + 1))
    named = stabbed(asked, code_blocks(cited, keys, ("scope",)), keys).where(usable).select(
        *keys, F.col("path").alias("file_path"), F.col("line").alias("_line"), F.col("name").alias("symbol"))
    return rows.join(named, [*keys, "file_path", "_line"], "left").select(*[F.col(c) for c in findings.columns], "symbol")


def call_sites(files: DataFrame, symbols: DataFrame, keys=DOC,
               per_symbol: int | None = None, chars: int | None = None) -> DataFrame:
    """Call sites of each symbol with context (-4/+2 lines), all of them or the first
    *per_symbol*, numbered in order of path and line.

    Calls come from the symbol index and meet the symbols by equality; a symbol that a third of all
    files call is split by its sites, as positions come from a range partitioning. Contexts are cut beside their files.
    """
    calls = symbol_index(files, keys, ("call",)).select(*keys, "symbol", "path", F.col("line").alias("line_no"), "nth")
    wanted = symbols.select(*keys, "symbol").where("symbol is not null").distinct()
    hits = calls.join(wanted, [*keys, "symbol"], "left_semi")
    order = [F.col("path"), F.col("line_no"), F.col("nth")]
    if per_symbol is None:
        hits = ordered_position(hits, [*keys, "symbol"], order, "rn").withColumn("rn", (F.col("rn") + 1).cast("int"))
    else:
        hits = top_n(hits, [*keys, "symbol"], order, per_symbol)
    hits = hits.withColumns({"_lo": F.greatest(F.col("line_no") - 4, F.lit(1)), "_hi": F.col("line_no") + 2})
    cut = line_windows(hits.select(*keys, "path", F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).distinct(), files, keys)
    around = cut.select(*keys, "path", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                        text.numbered(F.col("lines"), F.col("lo"), chars).alias("context"))
    return hits.join(around, [*keys, "path", "_lo", "_hi"]).select(
        *keys, "symbol", "path", "line_no", "rn", "context")


# ---- code windows (J27, H40) and excerpts (J28, W5) -----------------------
def code_windows(findings: DataFrame, files: DataFrame, keys=DOC, radius: int = 25,
                 cap: int | None = None) -> DataFrame:
    """Numbered source around each finding, the stored snippet when unavailable; whole or
    the first *cap* characters. Equal windows are cut once, beside their file."""
    start = F.coalesce(F.nullif(F.col("line_start"), F.lit(0)), F.lit(1))
    end = F.coalesce(F.nullif(F.col("line_end"), F.lit(0)), start)
    rows = findings.withColumns({"_lo": F.greatest(start - radius, F.lit(1)), "_hi": end + radius})
    asked = rows.select(*keys, F.col("file_path").alias("path"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).distinct()
    code = F.when(F.size("lines") > 0, text.numbered(F.col("lines"), F.col("lo"), cap))
    cut = line_windows(asked, files, keys).select(
        *keys, F.col("path").alias("file_path"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n_lines", code.alias("_code"))
    return rows.join(cut, [*keys, "file_path", "_lo", "_hi"], "left").select(
        *[rows[c] for c in findings.columns],
        F.coalesce(F.col("n_lines") > 0, F.lit(False)).alias("available"),
        F.col("_lo").alias("window_start"),
        F.coalesce("_code", F.col("code_snippet")).alias("source_context"))


def excerpt_ranges(endpoints: DataFrame, keys=DOC) -> DataFrame:
    """Line ranges worth showing for endpoints, merged per file."""
    line = F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(1))
    lo = F.coalesce(F.nullif(F.col("handler_start"), F.lit(0)), line)
    hi = F.coalesce(F.nullif(F.col("handler_end"), F.lit(0)), lo + 40)
    handler = F.coalesce(labels.truthy(F.col("handler_file")), F.col("file_path"))
    rows = endpoints.select(*keys, F.explode(F.array(
        F.struct(F.col("file_path").alias("path"),
                 F.greatest(line - 3, F.lit(1)).alias("lo"), (line + 3).alias("hi")),
        F.struct(handler.alias("path"), F.greatest(lo - 2, F.lit(1)).alias("lo"),
                 (hi + 1).alias("hi")))).alias("r")).select(*keys, "r.*")
    return merge_ranges(rows.where(labels.truthy(F.col("path")).isNotNull()),
                        [*keys, "path"])


def excerpts(ranges: DataFrame, files: DataFrame, keys=DOC, cap: int = 40_000) -> DataFrame:
    """Numbered excerpt per file; the ranges of one file are bounded by its lines."""
    per_file = ranges.groupBy(*keys, "path").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_r"))
    joined = per_file.join(files.select(*keys, "path", "content"), [*keys, "path"])
    lines = text.lines_of(F.col("content"))
    with_lines = joined.withColumn("_lines", lines)
    blocks = F.transform("_r", lambda r: text.numbered(
        text.line_window(F.col("_lines"), r["lo"], r["hi"]), r["lo"]))
    return with_lines.where(F.size("_lines") > 0).select(
        *keys, F.col("path").alias("file_path"),
        F.substring(F.array_join(blocks, "\n...\n"), 1, cap).alias("excerpt"))
