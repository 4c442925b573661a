"""Expressions over HTTP routes: labels, parameters, families, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .labels import risk_rank, truthy
from .text import any_of, blank_to_null, strip, uni


def method_name(raw: Column) -> Column:
    return F.upper(raw)


def route_label(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, path)


def join_label(label: Column) -> Column:
    """Upper-cased label with single blanks: the key endpoints and findings share."""
    return F.upper(strip(F.regexp_replace(label, r"\s+", " ")))


def normal_label(label: Column) -> Column:
    """'get /users/:id' and 'GET /users/{user_id}/' compare equal."""
    s = strip(F.regexp_replace(F.coalesce(label, F.lit("")), uni(r"\s+"), " "))
    has_path = F.locate(" ", s) > 0
    method = F.when(has_path, F.upper(F.substring_index(s, " ", 1))).otherwise("")
    path = F.when(has_path, F.substr(s, F.locate(" ", s) + 1)).otherwise(s)
    path = F.rtrim(F.regexp_replace(path, uni(fixed.LABEL_PARAM), "{}"), F.lit("/"))
    path = F.lower(F.coalesce(blank_to_null(path), F.lit("/")))
    return F.when(s == "", "").otherwise(F.btrim(F.concat(method, F.lit(" "), path)))


def _param_name(match: Column, pattern: str) -> Column:
    # only one of the five groups takes part in a match, the others are ''
    return F.concat(*[F.regexp_extract(match, pattern, i) for i in range(1, 6)])


def path_params(path: Column) -> Column:
    found = F.regexp_extract_all(path, F.lit(uni(fixed.PATH_PARAM)), F.lit(0))
    return F.transform(found, lambda m: F.split_part(
        _param_name(m, uni(fixed.PATH_PARAM)), F.lit(":"), F.lit(1)))


def is_id_param(name: Column) -> Column:
    return F.lower(name).rlike(r"^(id|pk|uuid|guid|slug|number|no)$|id$|_uuid$|_pk$")


def id_params(path: Column) -> Column:
    return F.filter(path_params(path), is_id_param)


def id_kind(params: Column, path: Column, text: Column) -> Column:
    """numeric, unknown or uuid: the most guessable of the id parameters."""
    uuid, numeric = any_of(fixed.UUID_HINTS), any_of(fixed.NUMERIC_HINTS)
    by_text = (F.when(path.rlike(uuid) | text.rlike(uuid), "uuid")
               .when(path.rlike(numeric) | text.rlike(numeric), "numeric")
               .otherwise("unknown"))
    kinds = F.transform(F.transform(params, F.lower), lambda p: F.when(
        p.contains("slug"), "unknown").when(
        p.rlike("uuid|guid|token|hash"), "uuid").otherwise(by_text))
    return (F.when(F.array_contains(kinds, "numeric"), "numeric")
            .when(F.array_contains(kinds, "unknown"), "unknown")
            .when(F.size(kinds) > 0, "uuid"))


def resource_family(path: Column) -> Column:
    """Parameters normalised and trailing ones dropped."""
    p = F.rtrim(F.regexp_replace(F.lower(path), uni(fixed.PATH_PARAM), ":p"), F.lit("/"))
    p = F.coalesce(blank_to_null(p), F.lit("/"))
    return F.regexp_replace(p, r"^([^/]*/[^/]*(?:/.*?)??)(?:/:p)+$", "$1")


def template_path(path: Column) -> Column:
    """Any framework's parameter syntax as ``{name}``."""
    p = F.regexp_replace(F.coalesce(truthy(path), F.lit("/")), uni(fixed.TEMPLATE_PARAM),
                         r"{$1$2$3$4$5}")
    p = F.translate(p, "^$", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def template_params(path: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(path, F.lit("/")),
                                 F.lit(uni(fixed.TEMPLATE_PARAM)), F.lit(0))
    return F.array_distinct(F.transform(
        found, lambda m: _param_name(m, uni(fixed.TEMPLATE_PARAM))))


def collection_path(path: Column) -> Column:
    """List path of an item path: the trailing parameter segment dropped."""
    segs = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    kept = F.when(F.element_at(segs, -1).rlike(uni(fixed.SEGMENT_PARAM)),
                  F.slice(segs, F.lit(1), F.size(segs) - 1)).otherwise(segs)
    return F.when(F.size(segs) > 0, F.concat(F.lit("/"), F.array_join(kept, "/")))


def fill_path(path: Column, values: Column | None = None) -> Column:
    """Placeholders replaced from a map, '1' where the map has no value."""
    p = F.coalesce(truthy(path), F.lit("/"))
    pieces = F.split(p, r"\{[^}/]+\}", -1)
    names = F.regexp_extract_all(p, F.lit(r"\{([^}/]+)\}"), F.lit(1))
    if values is None:
        filled = F.transform(names, lambda _: F.lit("1"))
    else:
        filled = F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n),
                                                         F.lit("1")))
    out = F.array_join(F.zip_with(
        pieces, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def is_sensitive(path: Column, handler: Column) -> Column:
    return F.concat_ws(" ", path, F.coalesce(handler, F.lit(""))).rlike(
        fixed.SENSITIVE_WORDS)


def is_privileged(path: Column, handler: Column) -> Column:
    return path.rlike(uni(fixed.PRIVILEGED_PATH)) | F.coalesce(
        handler, F.lit("")).rlike(fixed.PRIVILEGED_HANDLER)


def is_likely_public(path: Column, privileged: Column) -> Column:
    return path.rlike(uni(fixed.PUBLIC_PATH)) & ~privileged


def is_state_changing(method: Column) -> Column:
    return method.isin(*fixed.STATE_CHANGING_METHODS)


def auth_scope(public_markers, route_auth, file_auth, global_enforced) -> Column:
    return (F.when((F.size(public_markers) > 0) & (F.size(route_auth) == 0), "public")
            .when(F.size(route_auth) > 0, "route").when(F.size(file_auth) > 0, "file")
            .when(global_enforced, "global").otherwise("none"))


def heuristic_risk() -> Column:
    """Risk of an enriched endpoint row (reads the columns of the access map)."""
    c = F.col
    unauth = c("auth_scope").isin("none", "public") & ~c("likely_public")
    guessable = (F.size("id_params") > 0) & ~(F.coalesce(c("id_kind"), F.lit("")) == "uuid") \
        & (F.size("ownership_hints") == 0) & ~c("likely_public")
    return (F.when(unauth & (c("state_changing") | c("privileged")), "high")
            .when(c("privileged") & (F.size("role_hints") == 0) & ~c("likely_public"), "high")
            .when((unauth & c("sensitive")) | guessable, "medium").otherwise("low"))


def effective_risk(risk: Column, heuristic: Column) -> Column:
    return F.coalesce(truthy(risk), truthy(heuristic), F.lit("low"))


def at_least_risk(risk: Column, heuristic: Column, floor: str) -> Column:
    cutoff = fixed.RISK_VALUES.index(floor) if floor in fixed.RISK_VALUES else 2
    return risk_rank(effective_risk(risk, heuristic)) <= cutoff


def is_unauthenticated(authn: Column, scope: Column, hints: Column) -> Column:
    """Verdict if there is one, else the map's scope, else absence of hints."""
    return (F.when(truthy(authn).isNotNull(), authn == "none")
            .when(truthy(scope).isNotNull(), scope == "none")
            .otherwise(F.coalesce(F.size(hints), F.lit(0)) <= 0))


def implied_rejection(rule: Column, authn: Column, authz: Column, risk: Column) -> Column:
    """The endpoint verdict already answers the heuristic flag."""
    rule = F.coalesce(rule, F.lit(""))
    out = (F.when(rule.isin("access.missing-authn", "access.inconsistent-authn"),
                  authn.isin("required", "public"))
           .when(rule.isin("access.privileged-no-role", "access.inconsistent-authz"),
                 authz == "role")
           .when(rule == "access.idor", authz.isin("ownership", "tenant", "role"))
           .otherwise(risk == "low"))
    return F.coalesce(out, F.lit(False))


def test_notes() -> Column:
    """What to try on an endpoint (reads the columns of the reviewed map)."""
    c = F.col
    authn = F.coalesce(truthy(c("authn")), truthy(c("auth_scope")), F.lit(""))
    return F.array_compact(F.array(
        F.when((authn != "public") & ~c("likely_public"),
               "Call without a session: 401/403 expected (authentication)."),
        F.when(F.size("id_params") > 0, F.concat(
            F.lit("As user A request an object of user B ("),
            F.array_join("id_params", ", "),
            F.lit("): 403/404 expected (IDOR)."))),
        F.when(c("privileged") | F.coalesce(c("authz").isin("none", "unclear"), F.lit(False)),
               "Call with a low-privilege session: 403 expected (function-level access)."),
        F.when(c("state_changing"),
               "Add privileged fields to the body: they must be ignored (mass assignment).")))
