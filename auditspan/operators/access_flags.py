"""Heuristic access-control flags and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, labels, routes
from .ordered import crowded_groups, few, ordered_position, pin, split_crowded, top_n

DOC = ("artifact_id",)
OWASP = "A01:2021 - Broken Access Control"
# A peer list quoted in a text stops at 300 characters, so more labels cannot show; all
# peers are rows of sibling_peers().
PEER_LABELS, PEER_CHARS = 100, 300
# Routes that the one flag of a whole artifact lists; all are rows of unlocated_routes().
AFFECTED = 200
#: Routes of an artifact whose flags are made in windows of the artifact; those of more are placed by range.
FEW_ROUTES = 20_000
REMEDIATION = {
    "access.inconsistent-authn": "Give the route the login check of its siblings, best on the router or controller they share.",
    "access.inconsistent-authz": "Ask for the role that the sibling routes ask for.",
    "access.missing-authn": "Ask for a login, or write down why the route is open to everyone.",
    "access.privileged-no-role": "Let only the administrative role reach the route.",
    "access.idor": "Look the object up together with its owner, or check a policy for the object first.",
    "access.auth-not-located": "Find the layer that checks logins and confirm that it covers every route that is not public.",
}


def _label() -> Column:
    return routes.route_label(F.col("method"), F.col("path"))


def _protected() -> Column:
    return F.col("auth_scope").isin("route", "file")


def _exposed() -> Column:
    return F.col("auth_scope").isin("none", "public")


def _peers(eps: DataFrame, keys, name: str) -> DataFrame:
    """Sorted distinct labels of a resource family, cut at 300 characters."""
    shown = top_n(eps.select(*keys, "resource", _label().alias("_l")).distinct(),
                  [*keys, "resource"], [F.col("_l")], PEER_LABELS)
    return shown.groupBy(*keys, "resource").agg(F.substring(F.array_join(
        F.array_sort(F.collect_list("_l")), ", "), 1, PEER_CHARS).alias(name))


def sibling_groups(eps: DataFrame, keys=DOC) -> DataFrame:
    """What a resource family's routes have in common (J17), as aggregates."""
    roled = F.size("role_hints") > 0
    fam = eps.groupBy(*keys, "resource").agg(
        F.count_if(_protected()).alias("protected"),
        F.count_if(_exposed() & ~F.col("likely_public")).alias("exposed"),
        F.count_if(_protected() & roled).alias("roled"))
    guards = _peers(eps.where(_protected()), keys, "protected_peers")
    roles = _peers(eps.where(_protected() & roled), keys, "roled_peers")
    on = [*keys, "resource"]
    return fam.join(guards, on, "left").join(roles, on, "left")


def _small_groups(eps: DataFrame, keys) -> DataFrame:
    """The same, in one aggregation, of artifacts with few routes."""
    roled, c = F.size("role_hints") > 0, F.col
    fam = eps.groupBy(*keys, "resource").agg(
        F.count_if(_protected()).alias("protected"),
        F.count_if(_exposed() & ~c("likely_public")).alias("exposed"),
        F.count_if(_protected() & roled).alias("roled"),
        F.collect_set(F.when(_protected(), _label())).alias("_guards"),
        F.collect_set(F.when(_protected() & roled, _label())).alias("_roles"))

    def shown(n, labels_):
        return F.when(c(n) > 0, F.substring(F.array_join(F.slice(F.array_sort(labels_), 1, PEER_LABELS), ", "), 1, PEER_CHARS))
    return fam.select(*keys, "resource", "protected", "exposed", "roled", shown("protected", "_guards").alias("protected_peers"),
                      shown("roled", "_roles").alias("roled_peers"))


def sibling_peers(eps: DataFrame, keys=DOC) -> DataFrame:
    """Every protected route of a resource family and whether it checks a role."""
    return eps.where(_protected()).groupBy(*keys, "resource", _label().alias("endpoint")).agg(
        F.bool_or(F.size("role_hints") > 0).alias("roled"))


def unlocated_routes(eps: DataFrame, keys=DOC) -> DataFrame:
    """Routes behind the flag of a whole artifact: not public, and without any login found."""
    lost = eps.where(~F.col("likely_public") & (F.col("auth_scope") == "none"))
    return lost.join(systemic_condition(eps, keys).where("systemic"), list(keys)).select(
        *keys, "endpoint_id", _label().alias("endpoint"), "file_path", "line")


def systemic_condition(eps: DataFrame, keys=DOC) -> DataFrame:
    """Artifacts where no authentication could be located for most routes."""
    public = F.col("likely_public")
    n = eps.groupBy(*keys).agg(
        F.count_if(~public).alias("non_public"),
        F.count_if(~public & (F.col("auth_scope") == "none")).alias("unlocated"))
    return n.withColumn("systemic", (F.col("non_public") >= 15) & (
        F.col("unlocated") / F.col("non_public") >= 0.6))


def _flag(rule, title, description, severity, confidence, cwe) -> Column:
    def s(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule).alias("rule"), s(title).alias("title"),
        s(description).alias("description"), s(severity).alias("severity"),
        s(confidence).cast("double").alias("confidence"), F.lit(cwe).alias("cwe"),
        F.lit(REMEDIATION[rule]).alias("remediation"))


def access_flags(eps: DataFrame, context: DataFrame | None = None, keys=DOC,
                 cap: int | None = None, per_route: int | None = 2) -> DataFrame:
    """Per-route flags (the first two that apply, or all with ``per_route=None``), one
    systemic flag where it applies, the most severe first, all or *cap* per artifact,
    numbered h0, h1, ... (M6, W4, O6).

    Every rule reads the route plus two small summaries (its family and its
    artifact), so a route's flags come out of one row without windows. *eps* is
    read by several branches: pass a stored table or a pinned map. Up to FEW_ROUTES
    routes of an artifact are numbered in a window of it.
    """
    keys = list(keys)
    seen = None if context is None else few(pin(context.select(*keys).distinct().withColumn("_ctx", F.lit(True))))
    crowded = crowded_groups(eps, keys, FEW_ROUTES)
    if crowded is None:
        return _flags(eps, seen, keys, cap, per_route, True)
    rest, many = split_crowded(eps, keys, crowded)
    return _flags(rest, seen, keys, cap, per_route, True).unionByName(_flags(many, seen, keys, cap, per_route, False))


def _flags(eps: DataFrame, seen: DataFrame | None, keys, cap: int | None, per_route: int | None, small: bool) -> DataFrame:
    c, label = F.col, _label()
    condition = few(pin(systemic_condition(eps, keys)))
    rows = eps.join(_small_groups(eps, keys) if small else sibling_groups(eps, keys), [*keys, "resource"]).join(
        condition, keys)
    if seen is not None:
        rows = rows.join(seen, keys, "left")
        note = F.when(c("_ctx"), " A global security configuration exists; check whether "
                                 "it covers this route.").otherwise("")
    else:
        note = F.lit("")
    changing, priv, public = c("state_changing"), c("privileged"), c("likely_public")
    no_role = F.size("role_hints") == 0
    siblings = F.when(~c("systemic") & _exposed() & ~public & (c("protected") > 0), _flag(
        "access.inconsistent-authn",
        F.concat(F.lit("Inconsistent access control: "), label,
                 F.lit(" lacks the authentication its sibling routes enforce")),
        F.concat(F.lit("Routes of the same resource require authentication ("),
                 c("protected_peers"), F.lit("), this one shows none.")),
        F.when(changing | priv, "high").otherwise("medium"), 0.5, "CWE-862")).when(
        _protected() & no_role & (changing | priv) & (c("roled") > 0), _flag(
            "access.inconsistent-authz",
            F.concat(F.lit("Inconsistent authorisation: "), label,
                     F.lit(" has no role check while sibling routes do")),
            F.concat(F.lit("Sibling routes check roles ("), c("roled_peers"),
                     F.lit("), this one only needs a login.")),
            F.when(priv, "high").otherwise("medium"), 0.4, "CWE-863"))
    rows = rows.withColumn("_sib", siblings)
    open_route = _exposed() & ~(c("systemic") & (c("auth_scope") == "none"))
    why = F.when(c("auth_scope") == "public", F.concat(
        F.lit("explicitly anonymous ("), F.array_join("public_markers", ", "), F.lit(")"))) \
        .otherwise("without authentication at route, controller or global level")
    missing = F.when(
        ~public & open_route & c("_sib").isNull() & (changing | c("sensitive") | priv), _flag(
            "access.missing-authn",
            F.concat(F.lit("Endpoint without authentication: "), label),
            F.concat(label, F.lit(" is "), why, F.lit("."), note),
            F.when(changing & (c("sensitive") | priv), "high").otherwise("medium"),
            0.35, "CWE-306"))
    role = F.when(~public & priv & no_role, _flag(
        "access.privileged-no-role",
        F.concat(F.lit("Privileged endpoint without a role check: "), label),
        F.concat(label, F.lit(" looks administrative but shows no role check.")),
        "high", 0.35, "CWE-285"))
    kind = F.coalesce(c("id_kind"), F.lit(""))
    unowned = (~public & (F.size("id_params") > 0) & (F.size("ownership_hints") == 0)
               & no_role & ~((kind == "uuid") & ~changing))
    idor = F.when(unowned, _flag(
        "access.idor",
        F.concat(F.lit("Possible IDOR / missing object-level authorisation: "), label),
        F.concat(label, F.lit(" takes an object id ("), F.array_join("id_params", ", "),
                 F.lit(") without an ownership check."),
                 F.when(kind == "uuid", " The id is a UUID and hard to guess.").when(
                     kind == "numeric", " The id is numeric and enumerable.").otherwise("")),
        F.when(kind == "uuid", "low").when(changing, "high").otherwise("medium"),
        F.when(kind == "uuid", 0.2).when(kind == "numeric", 0.4).otherwise(0.3), "CWE-639"))
    raised = F.array_compact(F.array("_sib", missing, role, idor))
    each = rows.select(
        *keys, "endpoint_id", label.alias("endpoint"), "handler_file", "handler_line",
        "handler_source", "id_kind", F.posexplode(
            raised if per_route is None else F.slice(raised, 1, per_route)).alias("_nth", "f"))
    flags = each.select(
        *keys, "endpoint_id", "endpoint", "f.*", F.lit("proposed").alias("state"),
        c("handler_file").alias("file_path"), c("handler_line").alias("line_start"),
        c("handler_line").alias("line_end"), c("handler_source").alias("code_snippet"),
        F.when(c("f.rule") == "access.idor", c("id_kind")).alias("id_kind"),
        F.lit(None).cast("string").alias("human_question"),
        F.array().cast("array<string>").alias("affected_endpoints"))
    out = flags.unionByName(_systemic_flags(eps, condition, keys))
    out = out.withColumns({"owasp": F.lit(OWASP), "category": F.lit("access-control"),
                           "source": F.lit("access"), "origin": F.lit("heuristic")})
    order = [labels.severity_rank(c("severity")), F.desc("confidence"),
             F.asc_nulls_last("file_path"), "line_start", F.asc_nulls_last("endpoint"),
             "rule", F.asc_nulls_last("endpoint_id")]
    if cap is not None:
        placed = top_n(out, keys, order, cap, "_n").withColumn("_n", c("_n") - 1)
    elif small:
        placed = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    else:
        placed = ordered_position(out, keys, order, "_n")
    return placed.withColumn("flag_id", F.concat(F.lit("h"), c("_n"))).drop("_n")


def _systemic_flags(eps: DataFrame, condition: DataFrame, keys) -> DataFrame:
    c = F.col
    lost = eps.where(~c("likely_public") & (c("auth_scope") == "none")).join(condition.where("systemic"), keys)
    order = [c("file_path"), c("line"), c("method"), c("path")]
    first = top_n(lost.select(*keys, "unlocated", "non_public", "file_path", "line", "method",
                              "path", "handler_file", "handler_line", "handler_source",
                              _label().alias("_l")), keys, order, AFFECTED)
    one = first.groupBy(*keys, "unlocated", "non_public").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "_l"))),
                    lambda x: x["_l"]).alias("affected_endpoints"),
        F.min_by(F.struct("handler_file", "handler_line", "handler_source"), "rn").alias("a"))
    return one.select(
        *keys, F.lit(None).cast("string").alias("endpoint_id"),
        F.lit(None).cast("string").alias("endpoint"),
        F.lit("access.auth-not-located").alias("rule"),
        F.format_string("Authentication mechanism not located for %d of %d routes",
                        "unlocated", "non_public").alias("title"),
        F.concat(F.lit("No authentication was found for most routes, e.g. "),
                 F.array_join(F.slice("affected_endpoints", 1, 12), ", "),
                 F.lit(". It is probably enforced outside the recognised patterns."))
        .alias("description"),
        F.lit("medium").alias("severity"), F.lit(0.3).alias("confidence"),
        F.lit("CWE-306").alias("cwe"), F.lit(REMEDIATION["access.auth-not-located"]).alias("remediation"),
        F.lit("needs_info").alias("state"),
        c("a.handler_file").alias("file_path"), c("a.handler_line").alias("line_start"),
        c("a.handler_line").alias("line_end"),
        c("a.handler_source").alias("code_snippet"),
        F.lit(None).cast("string").alias("id_kind"),
        F.lit("Where is authentication enforced for these routes?").alias("human_question"),
        "affected_endpoints")


# ---- endpoint verdicts (M13) and flag resolution (J9, M3, D7, D21) --------------
def apply_endpoint_verdicts(mapped: DataFrame, verdicts: DataFrame, keys=DOC) -> DataFrame:
    """Endpoint rows with a sanitised verdict, ``unassessed`` when there is none."""
    v = verdicts.select(*keys, "endpoint_id", F.struct("authn", "authz", "risk", "notes")
                        .alias("_v"))
    got = F.col("_v").isNotNull()
    risk = F.coalesce(F.col("_v.risk"), labels.truthy(F.col("heuristic_risk")), F.lit("low"))
    return mapped.join(v, [*keys, "endpoint_id"], "left").select(
        *[F.col(n) for n in mapped.columns],
        F.when(got, labels.choose(F.coalesce(F.col("_v.authn"), F.lit("unclear")),
                                  fixed.AUTHN_VALUES, "unclear"))
        .otherwise("unassessed").alias("authn"),
        F.when(got, labels.choose(F.coalesce(F.col("_v.authz"), F.lit("unclear")),
                                  fixed.AUTHZ_VALUES, "unclear")).alias("authz"),
        F.when(got, labels.choose(risk, fixed.RISK_VALUES, "low")).alias("risk"),
        F.when(got, F.coalesce(F.col("_v.notes"), F.lit(""))).alias("notes"))


def resolve_flags(flags: DataFrame, assessed: DataFrame, findings: DataFrame,
                  verdicts: DataFrame, keys=DOC) -> DataFrame:
    """Outcome of every heuristic flag: explicit verdict, else implied by the
    endpoint's verdict, else duplicate of a finding, else pending."""
    keys, c = list(keys), F.col
    v = verdicts.groupBy(*keys, "flag_id").agg(F.max(F.struct(
        F.lower("verdict").alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.lower("severity").alias("severity"))).alias("_v"))
    eps = assessed.select(*keys, "endpoint_id", c("authn").alias("_authn"),
                          c("authz").alias("_authz"), c("risk").alias("_risk"))
    known = findings.select(
        *keys, routes.normal_label(c("endpoint")).alias("_ep"),
        labels.cwe_number(c("cwe")).alias("_cwe")).distinct().withColumn("_dup", F.lit(True))
    rows = flags.withColumn("_ep", routes.normal_label(c("endpoint"))) \
        .withColumn("_cwe", labels.cwe_number(c("cwe"))) \
        .join(v, [*keys, "flag_id"], "left").join(eps, [*keys, "endpoint_id"], "left") \
        .join(known, [*keys, "_ep", "_cwe"], "left")
    implied = (F.coalesce("_authn", F.lit("unassessed")) != "unassessed") \
        & routes.implied_rejection(c("rule"), c("_authn"), c("_authz"), c("_risk"))
    verdict = c("_v.verdict")
    outcome = (F.when(verdict == "duplicate", "duplicate")
               .when(verdict.isin("rejected", "false_positive", "dismissed"), "rejected")
               .when(verdict.isin("confirmed", "true_positive"), "confirmed")
               .when(verdict.isin("uncertain", "needs_info"), "uncertain")
               .when(c("_v").isNotNull(), "unverified").when(implied, "rejected")
               .when(c("_dup"), "duplicate").otherwise("unverified"))
    rows = rows.withColumn("outcome", outcome).withColumn(
        "implicit", c("_v").isNull() & (c("outcome") == "rejected"))
    reason = labels.truthy(c("_v.reason"))
    o, conf = c("outcome"), F.coalesce("confidence", F.lit(0.3))
    fresh = {
        "confidence": F.when(o == "confirmed", F.greatest(conf, F.lit(0.65))).when(
            o == "unverified", F.least(conf, F.lit(0.2))).otherwise(c("confidence")),
        "state": F.when(o.isin("confirmed", "unverified"), "proposed").when(
            o == "uncertain", "needs_info").otherwise(c("state")),
        "severity": F.when((o == "confirmed") & c("_v.severity").isin(*fixed.SEVERITIES),
                           c("_v.severity")).otherwise(c("severity")),
        "human_question": F.when(o == "uncertain", F.coalesce(reason, "human_question"))
        .otherwise(c("human_question")),
    }
    return rows.select(
        *[fresh.get(n, c(n)).alias(n) for n in flags.columns], "outcome", "implicit",
        F.when(o == "confirmed", F.concat(F.lit("Access review confirmed: "), reason)).when(
            o == "unverified", "Heuristic flag without a verdict; review manually.")
        .alias("triage_note"))


def surviving_flags(resolved: DataFrame) -> DataFrame:
    """Rejected and duplicate flags never become findings."""
    return resolved.where(~F.col("outcome").isin("rejected", "duplicate"))


def flag_outcomes(resolved: DataFrame, keys=DOC) -> DataFrame:
    return resolved.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))


def review_stats(assessed: DataFrame, keys=DOC) -> DataFrame:
    n = lambda col, v: F.count_if(F.col(col) == v).alias(f"{col}_{v}")
    return assessed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("endpoints"),
        F.count_if(F.col("authn") != "unassessed").alias("assessed"),
        *[n("authn", a) for a in (*fixed.AUTHN_VALUES, "unassessed")],
        *[n("risk", r) for r in fixed.RISK_VALUES])


def mark_unverified(flags: DataFrame, ceiling: float = 0.3) -> DataFrame:
    """Flags kept without a review: low confidence and a note (M8)."""
    return flags.withColumns({
        "confidence": F.least(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.3)),
                              F.lit(ceiling)),
        "unverified": F.lit(True),
        "triage_note": F.coalesce(labels.truthy(F.col("triage_note")), F.lit(
            "Heuristic access-control flag, not verified by a review."))})
