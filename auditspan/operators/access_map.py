"""Access-control map: every route with its handler, hints, scope and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths, routes, text
from ..functions.labels import truthy
from ..functions.text import any_of, strip, uni
from .blocks import DEFINITION_KEYWORDS, LEAD, REACH, defined_words, route_places, symbol_index
from .ordered import few, ordered_position, pin, top_n

DOC = ("artifact_id",)

# ---- app-wide context (T16) -----------------------------------------------
def global_context(files: DataFrame, keys=DOC, cap: int | None = None):
    """Security-configuration lines, all or the first *cap* per artifact."""
    c = F.col("content")
    chosen = files.where(
        paths.extension(F.col("path")).isin(*fixed.ACCESS_SOURCE_EXTENSIONS)
        & (F.octet_length(c) <= fixed.MAX_ROUTE_FILE_BYTES)
        & (F.instr(F.substring(c, 1, 1024), "\x00") == 0)
        & text.contains_any(c, fixed.GLOBAL_INDICATORS))
    lines = chosen.select(*keys, F.col("path").alias("file_path"), F.posexplode(
        text.lines_of(c)).alias("_pos", "_text")).where(
        F.col("_text").rlike(any_of(fixed.GLOBAL_LINE)))
    rows = lines.select(
        *keys, "file_path", (F.col("_pos") + 1).alias("line"),
        strip(F.col("_text")).alias("text"),
        F.col("_text").rlike(any_of(fixed.GLOBAL_ENFORCE)).alias("enforces"))
    if cap is None:
        return rows
    return top_n(rows, keys, [F.col("file_path"), F.col("line")], cap)


# ---- handlers in other files (J16) -------------------------------------------
def _handler_keys() -> tuple[Column, Column, Column]:
    """(framework, file key, symbol) of routes whose handler lives elsewhere."""
    h, fw = F.col("handler"), F.lower("framework")
    rails = F.split_part(h, F.lit("#"), F.lit(1))
    rails_symbol = F.when(h.contains("#"), F.split_part(h, F.lit("#"), F.lit(2)))
    django = F.element_at(F.split(F.replace(h, F.lit(".as_view"), F.lit("")), r"\."), -1)
    key = (F.when(fw == "rails", rails)
           .when((fw == "laravel") & h.contains("@"), F.split_part(h, F.lit("@"), F.lit(1)))
           .when(fw == "django", paths.dirname(F.col("file_path"))))
    symbol = (F.when(fw == "rails", rails_symbol)
              .when(fw == "laravel", F.split_part(h, F.lit("@"), F.lit(2)))
              .when(fw == "django", django))
    return fw, key, symbol


def remote_handlers(endpoints: DataFrame, files: DataFrame, keys=DOC) -> DataFrame:
    """(keys, framework, file key, symbol) → (handler_file, handler_line).

    Candidate files follow each framework's convention and are joined on a derived key; the
    first one by path that defines the symbol wins, however many there are. Only candidates are indexed.
    """
    keys = list(keys)
    fw, key, symbol = _handler_keys()
    asked = endpoints.select(*keys, fw.alias("_fw"), key.alias("_key"),
                             symbol.alias("_symbol")).where(
        F.col("_key").isNotNull() & (F.col("_symbol").isNull()
                                     | F.col("_symbol").rlike(uni(r"^\w+$")))
    ).where((F.col("_fw") == "rails") | F.col("_symbol").isNotNull()).distinct()
    p = F.col("path")
    where = F.array_compact(F.array(
        F.when(p.rlike(r"controllers/\w+_controller\.rb$"), F.struct(
            F.lit("rails").alias("_fw"), F.regexp_extract(
                p, r"controllers/(\w+)_controller\.rb$", 1).alias("_key"))),
        F.when(p.endswith(".php"), F.struct(
            F.lit("laravel").alias("_fw"),
            F.regexp_replace(paths.basename(p), r"\.php$", "").alias("_key"))),
        F.when(p.endswith(".py") & (p.contains("views") | p.contains("api")), F.struct(
            F.lit("django").alias("_fw"), paths.dirname(p).alias("_key"))),
        F.when(p.endswith(".py") & (paths.basename(paths.dirname(p)) == "views"), F.struct(
            F.lit("django").alias("_fw"),
            paths.dirname(paths.dirname(p)).alias("_key")))))
    located = files.select(*keys, "path", F.explode(where).alias("w")).select(
        *keys, "path", "w.*").join(asked.select(*keys, "_fw", "_key").distinct(),
                                   [*keys, "_fw", "_key"], "left_semi")
    candidates = files.join(located.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")
    index = symbol_index(candidates, keys, ("word", "method")).withColumnRenamed("symbol", "_symbol")
    fits = F.when(F.col("_fw") == "rails", F.col("kind") == "method").otherwise(F.col("kind") == "word")
    defs = located.join(index, [*keys, "path"]).where(fits)
    first = F.min(F.struct("path", "line"))
    by_name = defs.groupBy(*keys, "_fw", "_key", "_symbol").agg(first.alias("_at"))
    by_file = defs.where("_fw = 'rails'").groupBy(*keys, "_fw", "_key").agg(
        first.alias("_at")).withColumn("_symbol", F.lit(None).cast("string"))
    named = asked.where("_symbol is not null").join(
        by_name, [*keys, "_fw", "_key", "_symbol"])
    unnamed = asked.where("_symbol is null").drop("_symbol").join(
        by_file, [*keys, "_fw", "_key"])
    return named.unionByName(unnamed).select(
        *keys, "_fw", "_key", "_symbol", F.col("_at.path").alias("_hfile"),
        F.col("_at.line").alias("_hline"))


def endpoint_id() -> Column:
    """Identity of a route: its place, method, path and framework."""
    return F.concat(F.lit("e"), F.substring(F.md5(F.concat_ws(
        "|", "file_path", "line", "method", "path", "framework").cast("binary")), 1, 16))


# ---- enrichment ----------------------------------------------------------------
def with_endpoint_ids(endpoints: DataFrame, keys=DOC) -> DataFrame:
    """Sequential ids e0, e1, ... per artifact in file and line order."""
    placed = ordered_position(endpoints, keys, ["file_path", "line", "method", "path"], "_i")
    return placed.withColumn("endpoint_id", F.concat(F.lit("e"), F.col("_i"))).drop("_i")


def access_map(endpoints: DataFrame, files: DataFrame, context: DataFrame | None = None,
               keys=DOC, reach: int | None = REACH, lead: int | None = LEAD) -> DataFrame:
    """Endpoints with handler location, hints, scope, id parameters and risk.

    The routes of a file meet it in one row, where it is told where their handlers start and end (*reach* lines below
    and *lead* above at most), which logins cover them and what they say; a handler in another file is found by the
    symbol index and looked at beside that file. *endpoints* is read several times: pass a stored table.
    """
    keys = list(keys)
    c = F.col
    eps = endpoints
    if "endpoint_id" not in eps.columns:
        eps = eps.withColumn("endpoint_id", endpoint_id())
    eps = eps.withColumns({
        "method": F.upper(F.coalesce("method", F.lit("ANY"))),
        "path": F.coalesce("path", F.lit("/")), "line": F.coalesce("line", F.lit(1))})
    routed = _placed(_handler_spots(eps, files, keys), files, keys, reach, lead)
    if not _elsewhere(eps).isEmpty():
        routed = pin(routed)
        routed = routed.where("NOT _far").unionByName(_with_remote(routed.where("_far"), files, keys, reach, lead))
    enriched = routed.select(*eps.columns, "handler_file", "handler_line", "handler_start", "handler_end", "route_source",
                             "handler_source", "file_auth", F.coalesce("_htext", F.lit("")).alias("_htext"), "_rtext")
    if context is None:
        flagged = enriched.withColumn("_enforced", F.lit(False))
    else:
        on_scan = few(pin(context.where("enforces").select(*keys).distinct().withColumn("_enforced", F.lit(True))))
        flagged = enriched.join(on_scan, keys, "left").withColumn(
            "_enforced", F.coalesce("_enforced", F.lit(False)))
    return _derive(flagged, keys)


def _elsewhere(eps: DataFrame) -> DataFrame:
    """Routes of frameworks whose handlers live in other files."""
    return eps.where(F.coalesce(F.lower("framework").isin("rails", "laravel", "django"), F.lit(False)))


def _handler_spots(eps: DataFrame, files: DataFrame, keys) -> DataFrame:
    """Routes with the place of a handler in another file (_hfile, _hline), which a convention gives, or
    with the name (_name) to look for below the route."""
    c = F.col
    name = F.element_at(F.split(F.coalesce("handler", F.lit("")), r"\."), -1)
    there = _elsewhere(eps)
    here = eps.where(~F.coalesce(F.lower("framework").isin("rails", "laravel", "django"), F.lit(False))).select(
        "*", F.lit(None).cast("string").alias("_hfile"), F.lit(None).cast("int").alias("_hline"),
        F.when(name.rlike(uni(r"^\w+$")), name).alias("_name"))
    if there.isEmpty():
        return here
    fw, key, symbol = _handler_keys()
    tagged = there.withColumns({"_fw": fw, "_key": key, "_symbol": symbol}).alias("e")
    on = F.lit(True)
    for k in (*keys, "_fw", "_key", "_symbol"):
        on = on & c(f"e.{k}").eqNullSafe(c(f"r.{k}"))
    return here.unionByName(tagged.join(remote_handlers(there, files, keys).alias("r"), on, "left").select(
        *[c(f"e.{n}").alias(n) for n in eps.columns], "r._hfile", c("r._hline").cast("int").alias("_hline"),
        F.lit(None).cast("string").alias("_name")))


def _placed(spots: DataFrame, files: DataFrame, keys, reach: int | None, lead: int | None) -> DataFrame:
    """Routes beside their file, once a file: the handler's line (the definition of its name within the next eight lines,
    else the route), where it starts and ends, the logins that cover the route, and its text. Of a handler elsewhere only
    the route's own side is told. In its file a handler stops above the next route."""
    c = F.col
    carried = [n for n in spots.columns if n not in (*keys, "file_path", "_name")]
    nested = spots.groupBy(*keys, c("file_path").alias("path")).agg(F.collect_list(F.struct(*carried, "_name")).alias("_routes"))
    rows = files.select(*keys, "path", "content").where("content IS NOT NULL").join(nested, [*keys, "path"]).withColumn(
        "_lines", text.lines_of(c("content")))

    def defined(r):
        def names(i):
            t = F.get("_lines", r["line"].cast("int") - 1 + i)
            return t.contains(r["_name"]) & text.contains_any(t, DEFINITION_KEYWORDS) & F.array_contains(defined_words(t), r["_name"])
        return F.when(r["_name"].isNotNull(), r["line"] + F.get(F.filter(F.sequence(F.lit(0), F.lit(8)), names), F.lit(0)))
    rows = rows.select(*keys, "path", "content", "_routes", F.transform("_routes", lambda r: F.struct(
        r["line"].cast("int").alias("line"), F.coalesce(r["_hline"], defined(r), r["line"]).cast("int").alias("at"),
        F.coalesce(r["_hfile"] != c("path"), F.lit(False)).alias("far"))).alias("_asked"))
    return route_places(rows, keys, "_routes", reach, lead).select(
        *keys, c("path").alias("file_path"), *[f"_routes.{n}" for n in carried],
        F.coalesce("_routes._hfile", "path").alias("handler_file"), c("at").alias("handler_line"), c("lo").alias("handler_start"),
        c("hi").alias("handler_end"), c("source").alias("route_source"), c("there").alias("handler_source"),
        c("hints").alias("file_auth"), c("body").alias("_htext"), F.coalesce("top", F.lit("")).alias("_rtext"), c("far").alias("_far"))


def _with_remote(placed: DataFrame, files: DataFrame, keys, reach: int | None, lead: int | None) -> DataFrame:
    """Routes whose handler lives in another file with what that file says about it."""
    c = F.col
    nested = placed.groupBy(*keys, c("handler_file").alias("path")).agg(F.collect_set(F.struct(
        c("handler_line").alias("line"), c("handler_line").alias("at"), F.lit(False).alias("far"))).alias("_asked"))
    rows = files.select(*keys, "path", "content").where("content IS NOT NULL").join(nested, [*keys, "path"])
    there = route_places(rows, keys, None, reach, lead, bounded=False).select(
        *keys, c("path").alias("handler_file"), c("at").alias("handler_line"), "lo", "hi", c("there").alias("_source"),
        c("hints").alias("_theirs"), "body")
    none = F.array().cast("array<string>")
    return placed.join(there, [*keys, "handler_file", "handler_line"], "left").withColumns({
        "handler_start": c("lo"), "handler_end": c("hi"), "handler_source": c("_source"), "_htext": c("body"),
        "file_auth": F.array_union("file_auth", F.coalesce("_theirs", none))}).select(*placed.columns)


def _derive(df: DataFrame, keys) -> DataFrame:
    c = F.col
    both = F.concat(c("_rtext"), F.lit("\n"), c("_htext"))
    rows = df.withColumn("_both", both).withColumns({
        "route_auth": text.matches(c("_both"), any_of(fixed.AUTHN_HINTS)),
        "public_markers": text.matches(c("_both"), any_of(fixed.PUBLIC_HINTS)),
        "role_hints": text.matches(c("_both"), any_of(fixed.ROLE_HINTS)),
        "ownership_hints": text.matches(c("_htext"), any_of(fixed.OWNERSHIP_HINTS)),
        "path_params": routes.path_params(c("path")),
        "state_changing": routes.is_state_changing(c("method")),
        "sensitive": routes.is_sensitive(c("path"), c("handler")),
        "privileged": routes.is_privileged(c("path"), c("handler")),
        "resource": routes.resource_family(c("path"))})
    rows = rows.withColumn("id_params", F.filter("path_params", routes.is_id_param))
    rows = rows.withColumns({
        "auth_scope": routes.auth_scope(c("public_markers"), c("route_auth"),
                                        c("file_auth"), c("_enforced")),
        "id_kind": routes.id_kind(c("id_params"), c("path"), c("_both")),
        "likely_public": routes.is_likely_public(c("path"), c("privileged"))})
    route_source = F.coalesce("route_source", F.lit(""))
    hints = F.concat(F.coalesce("auth_hints", F.array().cast("array<string>")),
                     c("route_auth"), c("file_auth"))
    return rows.select(
        *keys, "endpoint_id", "method", "path", "file_path", "line", "framework", "handler",
        F.array_distinct(F.filter(hints, lambda h: h != "")).alias("auth_hints"),
        "route_auth", "file_auth", "public_markers", "role_hints", "ownership_hints",
        "auth_scope", "path_params", "id_params", "id_kind", "state_changing", "sensitive",
        "privileged", "likely_public", routes.heuristic_risk().alias("heuristic_risk"),
        "resource", "handler_file", "handler_line", "handler_start", "handler_end",
        route_source.alias("route_source"),
        F.coalesce("handler_source", route_source).alias("handler_source"))


# ---- statistics over the map (D5, D6) --------------------------------------------
def access_stats(mapped: DataFrame, keys=DOC) -> DataFrame:
    n = lambda s: F.count_if(F.col("auth_scope") == s).alias(f"scope_{s}")
    return mapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("endpoints"),
        *[n(s) for s in ("public", "route", "file", "global", "none")],
        F.count_if("state_changing").alias("state_changing"),
        F.count_if(F.size("id_params") > 0).alias("with_id_params"),
        F.count_if("privileged").alias("privileged"))


def auth_mechanisms(mapped: DataFrame, keys=DOC, n: int | None = None) -> DataFrame:
    """Auth hints by frequency, equal counts in alphabetical order, all or the first *n*."""
    counted = mapped.select(*keys, F.explode(F.concat("route_auth", "file_auth")).alias("h")) \
        .groupBy(*keys, F.lower("h").alias("mechanism")).agg(F.count(F.lit(1)).alias("uses"))
    return _ranked(counted, keys, [F.desc("uses"), F.col("mechanism")], n)


def _ranked(rows: DataFrame, keys, order, n: int | None) -> DataFrame:
    """Rows numbered from 1 in *rn*, all or the first *n*."""
    if n is not None:
        return top_n(rows, keys, order, n)
    return ordered_position(rows, keys, order, "rn").withColumn("rn", (F.col("rn") + 1).cast("int"))


def unauthenticated(mapped: DataFrame) -> DataFrame:
    authn = F.col("authn") if "authn" in mapped.columns else F.lit(None).cast("string")
    return mapped.where(routes.is_unauthenticated(authn, F.col("auth_scope"),
                                                  F.col("auth_hints")))


def routes_by_file(mapped: DataFrame, keys=DOC, n: int | None = None) -> DataFrame:
    """Routes per handler file in order, all or the first *n*."""
    rows = mapped.withColumn("_f", F.coalesce(truthy(F.col("handler_file")), "file_path"))
    return _ranked(rows.select(*keys, F.col("_f").alias("file_path"), "line", "method", "path", "auth_scope"),
                   [*keys, "file_path"], [F.col("line"), F.col("method"), F.col("path")], n)


# ---- endpoints and findings by label (J11, P17, O8) ----------------------------------
def _upper_label() -> Column:
    return F.upper(F.concat_ws(" ", F.coalesce("method", F.lit("GET")), "path"))


def endpoints_with_findings(mapped: DataFrame, findings: DataFrame, keys=DOC) -> DataFrame:
    """Endpoints some open, verified finding names."""
    named = findings.where((F.col("state") != "dismissed")
                           & ~F.coalesce("unverified", F.lit(False))
                           & truthy(F.col("endpoint")).isNotNull()).select(
        *keys, routes.join_label(F.col("endpoint")).alias("_label")).distinct()
    return mapped.withColumn("_label", routes.join_label(_upper_label())).join(
        named, [*keys, "_label"], "left_semi").select(*mapped.columns)


def endpoint_of_findings(findings: DataFrame, mapped: DataFrame, keys=DOC) -> DataFrame:
    """The endpoint a finding's label names: method, path, id_params; a label nobody
    declares is taken apart instead."""
    keys, c = list(keys), F.col
    known = mapped.groupBy(*keys, _upper_label().alias("_label")).agg(F.min_by(
        F.struct("method", "path", "id_params"), F.struct("file_path", "line")).alias("_e"))
    label = routes.join_label(c("endpoint"))
    rows = findings.where(truthy(c("endpoint")).isNotNull()).withColumn("_label", label).join(
        known, [*keys, "_label"], "left")
    at = F.locate(" ", c("_label"))
    head = F.when(at > 0, F.substring_index("_label", " ", 1)).otherwise(c("_label"))
    tail = truthy(F.when(at > 0, F.substr(c("_label"), at + 1)))
    return rows.select(
        *[c(n) for n in findings.columns],
        F.coalesce("_e.method", truthy(head), F.lit("GET")).alias("method"),
        F.coalesce(c("_e.path"), tail, c("endpoint")).alias("path"),
        F.coalesce("_e.id_params", F.array().cast("array<string>")).alias("id_params"))


def sort_by_risk(endpoints: DataFrame, keys=DOC) -> DataFrame:
    """Riskiest first, then by path."""
    from ..functions.labels import risk_rank
    risk = routes.effective_risk(F.col("risk"), F.col("heuristic_risk"))
    return endpoints.orderBy(*keys, risk_rank(risk), F.coalesce("path", F.lit("")))
