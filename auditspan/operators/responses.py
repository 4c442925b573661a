"""Verdicts from recorded HTTP responses, seeds, scope and request audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels, paths, routes, text
from ..functions.labels import truthy
from .ordered import previous_value, running_totals


# ---- recorded-response verdicts (M4, J23, H16, H37) -----------------------------
def response_verdicts(responses: DataFrame, keys=("finding_id",)) -> DataFrame:
    """Verdict of every finding from its recorded responses.

    Needs kind (missing_authn, bfla, idor), role, status, error, body_hash, and
    for idor owner, target, baseline. Set-based: one aggregation per finding, plus
    an equality semi join for "same body as the owner's own response".
    """
    keys, c = list(keys), F.col
    ok = labels.is_success(c("status")) & truthy(c("error")).isNull()
    own = responses.where("kind = 'idor' and baseline").where(
        labels.is_success(c("status")) & truthy(c("body_hash")).isNotNull()).select(
        *keys, "target", "owner", "body_hash").distinct()
    attackers = responses.where("kind = 'idor' and not coalesce(baseline, false)")
    copied = attackers.where(ok).join(own, [*keys, "target", "owner", "body_hash"],
                                      "left_semi").select(*keys).distinct() \
        .withColumn("_copied", F.lit(True))
    rows = responses.where(~F.coalesce("baseline", F.lit(False)))
    facts = rows.groupBy(*keys, "kind").agg(
        F.bool_or(ok).alias("_ok"), F.bool_or(labels.is_denied(c("status"))).alias("_any_no"),
        F.bool_and(labels.is_denied(c("status"))).alias("_all_no"),
        F.bool_or(truthy(c("error")).isNotNull()).alias("_error"),
        F.count(F.lit(1)).alias("requests"))
    joined = facts.join(copied, keys, "left")
    verdict = (F.when(c("kind") == "missing_authn", F.when(c("_error"), "inconclusive")
                      .when(c("_ok"), "confirmed_vuln").when(c("_any_no"), "enforced")
                      .otherwise("inconclusive"))
               .when(c("kind") == "bfla", F.when(c("_ok"), "confirmed_vuln")
                     .when(c("_any_no"), "enforced").otherwise("inconclusive"))
               .when(c("kind") == "idor", F.when(c("_copied"), "confirmed_vuln")
                     .when(c("_ok"), "inconclusive").when(c("_all_no"), "enforced")
                     .otherwise("inconclusive")))
    reason = (F.when(c("verdict") == "confirmed_vuln", F.when(
        c("kind") == "missing_authn", "anonymous request succeeded").when(
        c("kind") == "bfla", "a low-privilege role reached a privileged route")
        .otherwise("another role's object retrieved, identical body"))
        .when(c("verdict") == "enforced", "denied (401/403)")
        .otherwise("no clear allow or deny signal"))
    return joined.select(*keys, "kind", verdict.alias("verdict"), "requests").withColumn(
        "reason", reason)


def classify_findings(findings: DataFrame) -> DataFrame:
    """Findings with the probe that answers them, NULL when not live-testable."""
    return findings.withColumn("kind", labels.probe_kind(F.col("rule"), F.col("cwe")))


def finding_requests(findings: DataFrame, endpoints: DataFrame, keys=("scan_id",)):
    """Finding with the method and path to replay and its endpoint's id params."""
    keys, c = list(keys), F.col
    eps = endpoints.select(*keys, "endpoint_id", c("method").alias("_m"),
                           c("path").alias("_p"), "id_params")
    rows = findings.join(eps, [*keys, "endpoint_id"], "left")
    label = F.coalesce(truthy(c("endpoint")), F.concat_ws(" ", "_m", "_p"))
    verb = F.upper(F.split_part(label, F.lit(" "), F.lit(1)))
    at = F.locate(" ", label)
    path = F.when(at > 0, F.substr(label, at + 1)).otherwise("")
    return rows.select(
        *[c(x) for x in findings.columns],
        F.when(verb.isin("ANY", "ALL"), "GET").otherwise(verb).alias("method"),
        path.alias("path"), F.coalesce("id_params", F.array().cast("array<string>"))
        .alias("id_params"), labels.probe_kind(c("rule"), c("cwe")).alias("kind")) \
        .where(label != "")


def outcome_counts(verdicts: DataFrame, keys=()) -> DataFrame:
    """confirmed / enforced / inconclusive / untestable per group."""
    name = F.coalesce(F.when(F.col("verdict") == "confirmed_vuln", "confirmed")
                      .otherwise(F.col("verdict")), F.lit("untestable"))
    return verdicts.groupBy(*keys, name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def requests_by_purpose(log: DataFrame, keys=("run_id",)) -> DataFrame:
    return log.groupBy(*keys, "purpose").agg(F.count(F.lit(1)).alias("requests"))


# ---- seeds (J22, J24, T27) ---------------------------------------------------------
SEED_LAYERS = {"operator": 0, "harvested": 1, "pinned": 2}


def resolve_seeds(seeds: DataFrame, targets: DataFrame, keys=("run_id",)) -> DataFrame:
    """Seed values usable per (collection, role, param).

    seeds: keys, layer, role, collection (NULL for flat operator seeds), param,
    ids. Per role and param a pinned operator seed beats a harvested one, which
    beats the flat fallback; flat seeds apply to every collection.
    """
    keys, c = list(keys), F.col
    layer = text.lookup(c("layer"), SEED_LAYERS, 0)
    ranked = seeds.groupBy(*keys, "role", "collection", "param").agg(
        F.max_by(F.struct("ids"), layer).alias("_v"), F.max(layer).alias("_l"))
    wanted = targets.select(*keys, "collection").distinct()
    placed = ranked.where("collection is not null").join(wanted, [*keys, "collection"])
    flat = ranked.where("collection is null").drop("collection")
    spread = flat.join(wanted, keys)
    both = placed.select(*keys, "collection", "role", "param", "_v", "_l").unionByName(
        spread.select(*keys, "collection", "role", "param", "_v", "_l"))
    return both.groupBy(*keys, "collection", "role", "param").agg(
        F.max_by("_v", "_l").alias("_v")).select(
        *keys, "collection", "role", "param", c("_v.ids").alias("ids"))


def cross_role_probes(seeds: DataFrame, actors: DataFrame, findings: DataFrame,
                      keys=("run_id",)) -> DataFrame:
    """Requests an object-level check needs: every actor against objects of every
    *other* role. Roles are the few test accounts of a target, so the pairing
    grows with findings, not with rows per role."""
    keys, c = list(keys), F.col
    owned = seeds.groupBy(*keys, "collection", c("role").alias("owner")).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "param", F.element_at("ids", 1).alias("id")))).alias("_values"))
    rows = findings.withColumn("collection", routes.collection_path(c("path"))).join(
        owned, [*keys, "collection"])
    usable = rows.where(F.arrays_overlap("id_params", F.map_keys("_values")))
    pairs = usable.join(actors.select(*keys, c("role").alias("actor")), keys).where(
        c("actor") != c("owner"))
    only = F.map_filter("_values", lambda k, _: F.array_contains(c("id_params"), k))
    return pairs.select(*keys, "finding_id", "actor", "owner", "method",
                        routes.fill_path(c("path"), only).alias("target"))


def harvested_ids(bodies: DataFrame, keys=("run_id", "role", "collection"), depth: int = 7,
                  per_list: int = 50, cap: int = 20) -> DataFrame:
    """Identifier values of stored JSON bodies, the first *cap* distinct per group.

    A body is unfolded level by level (objects by key, lists up to 50 items);
    values keep the order a depth-first walk meets them in.
    """
    keys, c = list(keys), F.col
    level = bodies.select(*keys, F.array(F.lit(0)).alias("_at"),
                          F.try_parse_json(c("body")).alias("_v")).where("_v is not null")
    level = level.withColumn("_at", F.array().cast("array<int>"))
    found = None
    for _ in range(depth):
        opened = level.lateralJoin(level.sparkSession.tvf.variant_explode(
            F.col("_v").outer())).where(c("key").isNotNull() | (c("pos") < per_list)).select(
            *keys, "_at", c("pos").alias("_pos"), c("key").alias("_key"),
            c("value").alias("_val"))
        kind = F.expr("schema_of_variant(_val)")
        at = F.concat("_at", F.array(c("_pos")))
        # whole numbers beyond 64 bits are decimals of 19 to 38 digits
        scalar = kind.isin("STRING", "BIGINT", "BOOLEAN") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
        named = c("_key").isNotNull() & c("_key").rlike(fixed.ID_KEY) & scalar
        value = F.when(kind == "BOOLEAN", F.initcap(F.expr("cast(_val as string)"))) \
            .otherwise(F.expr("cast(_val as string)"))
        hits = opened.where(named).select(*keys, at.alias("_at"), value.alias("id"))
        found = hits if found is None else found.unionByName(hits)
        level = opened.where(~named & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))) \
            .select(*keys, at.alias("_at"), c("_val").alias("_v"))
    from .ordered import top_n
    firsts = found.groupBy(*keys, "id").agg(F.min("_at").alias("_at"))
    return top_n(firsts, keys, [c("_at"), c("id")], cap, "position").drop("_at")


# ---- dynamic findings (J21) ------------------------------------------------------------
def new_dynamic_findings(found: DataFrame, stored: DataFrame, keys=("scan_id",),
                         order: str = "ord") -> DataFrame:
    """First row per (title, endpoint) that is not stored yet (null-safe)."""
    keys = list(keys)
    rest = [c for c in found.columns if c not in (*keys, "title", "endpoint")]
    firsts = found.groupBy(*keys, "title", "endpoint").agg(
        F.min_by(F.struct(*rest), order).alias("_r")).select(
        *keys, "title", "endpoint", "_r.*")
    f, s = firsts.alias("f"), stored.alias("s")
    on = F.lit(True)
    for k in (*keys, "title", "endpoint"):
        on = on & F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
    return f.join(s, on, "left_anti")


# ---- scope and plans (P12, P18, D14) ------------------------------------------------------
def permitted_requests(log: DataFrame, targets: DataFrame, keys=("run_id",)) -> DataFrame:
    """Requests with their host and whether the run's allow-list covers it."""
    hosts = targets.select(*keys, F.explode(paths.allowed_hosts(
        F.col("base_url"), F.col("allowed_hosts"))).alias("host")) \
        .withColumn("_ok", F.lit(True))
    return log.withColumn("host", paths.host_of(F.col("url"))).join(
        hosts, [*keys, "host"], "left").withColumn(
        "permitted", F.coalesce("_ok", F.lit(False))).drop("_ok")


def run_plan(endpoints: DataFrame, findings: DataFrame, runs: DataFrame,
             keys=("scan_id",)) -> DataFrame:
    """Dry-run budget per scan: endpoints and findings in scope, probes, requests.

    runs: keys, include_paths, exclude_paths, access_control, active_scan.
    """
    keys, c = list(keys), F.col
    inside = lambda p: paths.in_prefix_scope(
        p, c("include_paths"), c("exclude_paths"))
    eps = endpoints.join(runs, keys).where(inside(c("path")))
    n_eps = eps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("endpoints_in_scope"),
        F.count_if(F.size("id_params") > 0).alias("_ids"),
        F.count_distinct(F.when(F.size("id_params") > 0, c("path"))).alias("_id_paths"))
    at = F.locate(" ", F.coalesce("endpoint", F.lit("")))
    path = F.when(at > 0, F.substr(c("endpoint"), at + 1)).otherwise("")
    fs = findings.where((c("source") == "access") & labels.is_open(c("state"))).join(
        runs, keys).where(inside(path)).withColumn(
        "_kind", labels.probe_kind(c("rule"), c("cwe")))
    n_fs = fs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings_to_confirm"),
        *[F.count_if(c("_kind") == k).alias(f"n_{k}") for k in fixed.PROBE_RULES])
    rows = runs.join(n_eps, keys, "left").join(n_fs, keys, "left")
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    access = F.when(c("access_control"), z("findings_to_confirm") * 2 + z("_id_paths"))
    active = F.when(c("active_scan"), 1 + z("endpoints_in_scope") + z("_ids") * 6)
    return rows.select(
        *keys, z("endpoints_in_scope").alias("endpoints_in_scope"),
        z("findings_to_confirm").alias("findings_to_confirm"),
        *[F.when(c("access_control"), z(f"n_{k}")).otherwise(0).alias(f"n_{k}")
          for k in fixed.PROBE_RULES],
        (F.coalesce(access, F.lit(0)) + F.coalesce(active, F.lit(0)))
        .alias("estimated_requests"))


# ---- audits of the request log (W19) ----------------------------------------------------------
def rate_audit(log: DataFrame, keys=("run_id",), order=("ts", "seq"),
               max_rps: float = fixed.DEFAULT_MAX_RPS,
               cap: int = fixed.MAX_REQUESTS_PER_RUN, block: Column | None = None):
    """Each request with its gap to the one before, its number, and violations."""
    block = F.date_trunc("hour", "ts") if block is None else block
    order = list(order)
    gaps = previous_value(log, keys, order, block, F.col("ts"), "_before")
    rows = running_totals(gaps, keys, order, block, request_no=F.lit(1))
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.col("_before"))
    return rows.withColumn("gap_us", gap).withColumn(
        "too_fast", F.coalesce(F.col("gap_us") < int(1e6 / max_rps), F.lit(False))) \
        .withColumn("over_cap", F.col("request_no") > cap).drop("_before")


# ---- passive checks over stored responses (T23-T26) -----------------------------------------
def passive_findings(responses: DataFrame, keys=("run_id",)) -> DataFrame:
    """Missing headers, weak cookies, leaked errors and database errors.

    responses: keys, base_url, url, status, headers map, body.
    """
    c = F.col
    low = F.transform_keys("headers", lambda k, _: F.lower(k))
    missing = text.missing_headers(c("_h"), c("base_url"))
    flags = text.missing_cookie_flags(F.try_element_at(c("_h"), F.lit("set-cookie")))
    leak = text.error_disclosure(c("status"), c("body"))
    issue = lambda rule, sev, cwe, detail: F.struct(
        F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), F.lit(cwe).alias("cwe"),
        detail.alias("detail"))
    found = F.array_compact(F.array(
        F.when(F.size(missing) > 0, issue("dast.missing-headers", "low", "CWE-693",
                                          F.array_join(missing, ", "))),
        F.when(F.size(flags) > 0, issue("dast.cookie-flags", "low", "CWE-614",
                                        F.array_join(flags, "/"))),
        F.when(leak.isNotNull(), issue("dast.error-disclosure", "medium", "CWE-209", leak)),
        F.when(text.database_error(c("body")), issue(
            "dast.database-error", "high", "CWE-89",
            text.extract(c("body"), fixed.DATABASE_ERROR, 1)))))
    return responses.withColumn("_h", low).select(
        *keys, "url", F.explode(found).alias("f")).select(*keys, "url", "f.*")


# ---- run policies (M16, M17) -------------------------------------------------------------------
def normalize_modes(targets: DataFrame) -> DataFrame:
    """Run policy per target with defaults: unknown checks dropped, empty list
    back to access_control."""
    c = F.col
    kept = F.filter(F.coalesce("allowed_checks", F.array().cast("array<string>")),
                    lambda x: x.isin(*fixed.ALLOWED_CHECKS))
    flag = lambda n: F.coalesce(c(n), F.lit(False)).alias(n)
    given = c("allowed_checks").isNotNull() & (F.size(kept) > 0)
    rest = [x for x in targets.columns if x not in
            ("auto_run", "auto_run_active", "require_approval", "allowed_checks")]
    return targets.select(
        *rest, flag("auto_run"), flag("auto_run_active"), flag("require_approval"),
        F.when(given, kept).otherwise(F.array(F.lit("access_control"))).alias("allowed_checks"))


def decide_runs(requests: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """What becomes of run requests: refused, already_active, pending or queued.

    Of several requests for one scan only the first (by seq) can be admitted.
    """
    c = F.col
    modes = normalize_modes(targets).select("target_id", "require_approval",
                                            "allowed_checks")
    active = runs.where(c("status").isin(*fixed.ACTIVE_RUN_STATES)).select(
        "scan_id").distinct().withColumn("_busy", F.lit(True))
    rows = requests.join(modes, "target_id").join(active, "scan_id", "left")
    refused = c("active_scan") & ~F.array_contains("allowed_checks", "active_scan")
    rows = rows.withColumn("_refused", refused)
    first = rows.where(~c("_refused") & c("_busy").isNull()).groupBy("scan_id").agg(
        F.min("seq").alias("_first"))
    out = rows.join(first, "scan_id", "left")
    decision = (F.when(c("_refused"), "refused")
                .when(c("_busy") | (c("seq") > c("_first")), "already_active")
                .when(c("require_approval"), "pending_approval").otherwise("queued"))
    intercept = F.when(c("intercept").isin("off", "mutating", "all"), c("intercept")) \
        .otherwise("off")
    return out.select(
        *[intercept.alias(x) if x == "intercept" else c(x) for x in requests.columns],
        decision.alias("decision"))
