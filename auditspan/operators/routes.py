"""HTTP route extraction from source files (eight languages, one pass)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths, text
from ..functions.text import blank_to_null, extract, strip, uni

DOC = ("artifact_id",)

GATES = {
    "python": (fixed.FASTAPI_ROUTE, fixed.FLASK_ROUTE, fixed.DJANGO_ROUTE),
    "javascript": (fixed.NEST_METHOD, fixed.FASTIFY_BLOCK, fixed.EXPRESS_ROUTE),
    "typescript": (fixed.NEST_METHOD, fixed.FASTIFY_BLOCK, fixed.EXPRESS_ROUTE),
    "java": (fixed.SPRING_MAPPING,),
    "csharp": (fixed.ASPNET_HTTP, fixed.ASPNET_ROUTE, fixed.ASPNET_MAP),
    "go": (fixed.GO_HANDLE, fixed.GIN_ROUTE),
    "ruby": (fixed.RAILS_VERB, fixed.RAILS_RESOURCES),
    "php": (fixed.LARAVEL_ROUTE,),
}


def candidate_files(files: DataFrame, keep=("artifact_id", "path")) -> DataFrame:
    """Readable source files that can hold a route: size, language and indicator
    checks come before any line is cut (S4, P2, P3, P19)."""
    c = F.col("content")
    lang = paths.route_language(F.col("path"))
    size = F.octet_length(c)
    rows = files.where(lang.isNotNull() & ~paths.is_pruned(F.col("path"),
                                                           fixed.ROUTE_SKIP_DIRS)
                       & (size <= fixed.MAX_ROUTE_FILE_BYTES)
                       & (F.instr(F.substring(c, 1, 1024), "\x00") == 0))
    indicated = reduce(lambda a, b: a | b, [
        (lang == name) & text.contains_any(c, words)
        for name, words in fixed.ROUTE_INDICATORS.items()])
    return rows.where((size <= 512) | indicated).select(*keep, lang.alias("_lang"), "content")


def _below(pos: Column) -> Column:
    """Function-like name in the next four lines."""
    names = F.transform(F.slice("_lines", pos + 2, 4),
                        lambda t: F.regexp_extract(t, uni(fixed.FUNCTION_BELOW), 1))
    return F.try_element_at(F.filter(names, lambda x: x != ""), F.lit(1))


def _method_below(pos: Column) -> Column:
    """Class-method name under a decorator stack, seven lines at most."""
    rows = F.filter(F.transform(F.slice("_lines", pos + 2, 7), strip),
                    lambda t: (t != "") & ~t.startswith("@"))
    return F.regexp_extract(F.try_element_at(rows, F.lit(1)), uni(fixed.CLASS_METHOD), 1)


def _hints_above(pos: Column) -> Column:
    """Auth words in the five lines before a route."""
    before = text.line_window(F.col("_lines"), pos - 4, pos)
    return F.flatten(F.transform(before, lambda t: F.regexp_extract_all(
        t, F.lit(fixed.ROUTE_AUTH_HINT), F.lit(0))))


def _or(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def _route(method, path, framework, handler) -> Column:
    def s(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(s(method).alias("method"), s(path).alias("path"),
                    s(framework).alias("framework"), s(handler).alias("handler"))


def _routes(pos: Column) -> Column:
    """Array of routes a line declares: the first matching pattern of the file's
    language wins (T3-T13, T15)."""
    t, lang = F.col("text"), F.col("_lang")

    def g(pattern, group):
        return F.regexp_extract(t, uni(pattern), group)

    def hit(pattern):
        return t.rlike(uni(pattern))

    flask_methods = F.transform(
        F.split(g(fixed.FLASK_ROUTE, 2), ","),
        lambda m: F.upper(F.btrim(strip(m), F.lit("'\""))))
    flask = F.transform(F.when(g(fixed.FLASK_ROUTE, 2) != "", flask_methods).otherwise(
                            F.array(F.lit("GET"))), lambda m: _route(m, g(fixed.FLASK_ROUTE, 1), "flask", _below(pos)))
    django = g(fixed.DJANGO_ROUTE, 1)
    sub = F.btrim(g(fixed.NEST_METHOD, 2), F.lit("/"))
    nest = F.concat(F.lit("/"), F.array_join(F.filter(
        F.array("_prefix", sub), lambda x: x != ""), "/"))
    verb = g(fixed.NEST_METHOD, 1)
    block = F.array_join(F.slice("_lines", pos + 1, 12), "\n")
    block_url = F.regexp_extract(block, uni(fixed.BLOCK_URL), 1)
    block_method = _or(F.upper(F.regexp_extract(block, uni(fixed.BLOCK_METHOD), 1)), "ANY")
    express = F.upper(g(fixed.EXPRESS_ROUTE, 1))
    spring = F.upper(g(fixed.SPRING_MAPPING, 1))
    laravel = F.upper(g(fixed.LARAVEL_ROUTE, 1))
    controller, action = g(fixed.LARAVEL_ROUTE, 3), g(fixed.LARAVEL_ROUTE, 4)
    one = F.array
    script = lang.isin("javascript", "typescript")
    return (
        F.when(lang == "python", F.when(hit(fixed.FASTAPI_ROUTE), one(_route(
            F.upper(g(fixed.FASTAPI_ROUTE, 1)), g(fixed.FASTAPI_ROUTE, 2), "fastapi",
            _below(pos)))).when(hit(fixed.FLASK_ROUTE), flask).when(
            hit(fixed.DJANGO_ROUTE), one(_route(
                "ANY", F.when(django.startswith("/"), django).otherwise(
                    F.concat(F.lit("/"), django)), "django", g(fixed.DJANGO_ROUTE, 2)))))
        .when(script, F.when(hit(fixed.NEST_CONTROLLER), F.lit(None)).when(
            hit(fixed.NEST_METHOD), one(_route(
                F.when(verb == "All", "ANY").otherwise(F.upper(verb)), nest, "nestjs",
                _method_below(pos)))).when(
            hit(fixed.FASTIFY_BLOCK) & (block_url != ""), one(_route(
                block_method, block_url, "fastify", F.lit(None)))).when(
            hit(fixed.EXPRESS_ROUTE), one(_route(
                F.when(express == "ALL", "ANY").otherwise(express),
                g(fixed.EXPRESS_ROUTE, 2),
                F.when(t.contains("fastify."), "fastify").otherwise("express"),
                g(fixed.EXPRESS_ROUTE, 3)))))
        .when(lang == "java", F.when(hit(fixed.SPRING_MAPPING), one(_route(
            F.when(spring == "REQUEST", "ANY").otherwise(spring),
            _or(g(fixed.SPRING_MAPPING, 2), "/"), "spring", _below(pos)))))
        .when(lang == "csharp", F.when(hit(fixed.ASPNET_HTTP), one(_route(
            F.upper(g(fixed.ASPNET_HTTP, 1)), _or(g(fixed.ASPNET_HTTP, 2), "/"),
            "aspnet", _below(pos)))).when(hit(fixed.ASPNET_ROUTE), one(_route(
                "ANY", g(fixed.ASPNET_ROUTE, 1), "aspnet", F.lit(None)))).when(
            hit(fixed.ASPNET_MAP), one(_route(
                F.upper(g(fixed.ASPNET_MAP, 1)), g(fixed.ASPNET_MAP, 2), "aspnet",
                g(fixed.ASPNET_MAP, 3)))))
        .when(lang == "go", F.when(hit(fixed.GO_HANDLE), one(_route(
            "ANY", g(fixed.GO_HANDLE, 1), "go-net-http", g(fixed.GO_HANDLE, 2)))).when(
            hit(fixed.GIN_ROUTE), one(_route(
                F.upper(g(fixed.GIN_ROUTE, 1)), g(fixed.GIN_ROUTE, 2), "gin",
                g(fixed.GIN_ROUTE, 3)))))
        .when(lang == "ruby", F.when(hit(fixed.RAILS_VERB), one(_route(
            F.upper(g(fixed.RAILS_VERB, 1)), g(fixed.RAILS_VERB, 2), "rails",
            g(fixed.RAILS_VERB, 3)))).when(hit(fixed.RAILS_RESOURCES), one(_route(
                "ANY", F.concat(F.lit("/"), g(fixed.RAILS_RESOURCES, 1)), "rails",
                g(fixed.RAILS_RESOURCES, 1)))))
        .when(lang == "php", F.when(hit(fixed.LARAVEL_ROUTE), one(_route(
            F.when(laravel.isin("MATCH", "ANY"), "ANY").otherwise(laravel),
            g(fixed.LARAVEL_ROUTE, 2), "laravel",
            F.when((controller != "") & (action != ""),
                   F.concat(controller, F.lit("@"), action)))))))


def _remove_first(c: Column, needle: str) -> Column:
    at = F.locate(needle, c)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1),
                                   F.substr(c, at + len(needle)))).otherwise(c)


def _file_routes(files: DataFrame, keep) -> DataFrame:
    """Routes declared by the place of a file."""
    path = F.col("path")
    rooted = F.concat(F.lit("/"), path)
    braces = lambda c: F.regexp_replace(c, r"\[([^\]]+)\]", "{$1}")
    app_path = braces(_remove_first(F.regexp_replace(rooted, r"/route\.[jt]sx?$", ""), "app/"))
    page = _remove_first(F.regexp_replace(rooted, r"\.[jt]sx?$", ""), "pages/")
    page = F.regexp_replace(page, "/index$", "")
    page_path = braces(F.coalesce(blank_to_null(page), F.lit("/")))
    rows = files.where(F.col("_lang").isin("javascript", "typescript")
                       & path.rlike(fixed.NEXT_ROUTE_FILE)).withColumn(
        "_lines", text.lines_of(F.col("content")))
    exports = F.filter(F.transform("_lines", lambda t, i: F.struct(
        i.alias("pos"), extract(t, uni(fixed.NEXT_EXPORT), 1).alias("verb"))),
        lambda x: x["verb"].isNotNull())
    tagged = rows.withColumn("_exports", exports)
    by_verb = tagged.select(*keep, "_lines", F.explode("_exports").alias("x")).select(
        *keep, F.col("x.verb").alias("method"), app_path.alias("route"),
        (F.col("x.pos") + 1).alias("line"), F.col("x.verb").alias("handler"),
        _hints_above(F.col("x.pos")).alias("auth_hints"))
    by_file = tagged.where((F.size("_exports") == 0) & path.contains("pages/api/")).select(
        *keep, F.lit("ANY").alias("method"), page_path.alias("route"),
        F.lit(1).alias("line"), paths.basename(path).alias("handler"),
        F.array().cast("array<string>").alias("auth_hints"))
    return by_verb.unionByName(by_file).withColumn("framework", F.lit("nextjs"))


def extract_routes(files: DataFrame, keep=("artifact_id", "path")) -> DataFrame:
    """Endpoints of every source file: method, path, file_path, line, framework,
    handler, auth_hints plus the key columns.

    Lines are exploded next to their file's line array and filtered in the same
    stage, so only lines that declare a route are ever materialised.
    """
    keep = list(keep)
    keys = [k for k in keep if k != "path"]
    chosen = candidate_files(files, keep)
    lines = chosen.withColumn("_lines", text.lines_of(F.col("content"))).drop("content")
    controllers = F.filter(F.transform("_lines", lambda t, i: F.when(
        t.contains("@Controller("), F.struct(i.alias("pos"), F.btrim(F.regexp_extract(
            t, uni(fixed.NEST_CONTROLLER), 1), F.lit("/")).alias("prefix")))),
        lambda x: x.isNotNull())
    lines = lines.withColumn("_controllers", F.when(
        F.col("_lang").isin("javascript", "typescript"), controllers))
    gate = reduce(lambda a, b: a | b, [
        (F.col("_lang") == lang) & F.col("text").rlike(
            "|".join(f"(?:{uni(p)})" for p in pats)) for lang, pats in GATES.items()])
    shown = lines.select(*keep, "_lang", "_lines", "_controllers",
                         F.posexplode("_lines").alias("_pos", "text")).where(gate)
    prefix = F.coalesce(F.try_element_at(F.filter(
        "_controllers", lambda c: c["pos"] < F.col("_pos")), F.lit(-1))["prefix"], F.lit(""))
    found = shown.withColumn("_prefix", prefix).select(
        *keep, "_lines", "_pos", F.explode(_routes(F.col("_pos"))).alias("r"))
    declared = found.select(
        *keys, F.col("r.method").alias("method"), F.col("r.path").alias("path"),
        F.col("path").alias("file_path"), (F.col("_pos") + 1).alias("line"),
        F.col("r.framework").alias("framework"), blank_to_null(F.col("r.handler")).alias("handler"),
        _hints_above(F.col("_pos")).alias("auth_hints"))
    placed = _file_routes(chosen, keep).select(
        *keys, "method", F.col("route").alias("path"), F.col("path").alias("file_path"),
        "line", "framework", "handler", "auth_hints")
    return declared.unionByName(placed)
