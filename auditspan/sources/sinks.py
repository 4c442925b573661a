"""Exports: flat tables, text lists, XML, and JSON documents in fragments.

A document of one scan can be larger than a task should hold. SARIF and OpenAPI
are therefore produced as ordered text fragments, one row each, whose
concatenation is the document; rows are range-partitioned on write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, labels, routes
from ..functions.labels import truthy
from ..operators.ordered import crowded_groups, ordered_position, split_crowded, top_n

SCAN = ("scan_id",)


# ---- flat exports (S16, S17, S20) ------------------------------------------------
def findings_csv(findings: DataFrame, keys=SCAN) -> DataFrame:
    """Non-dismissed findings, the 19 export columns, NULL as empty text."""
    rows = findings.where(labels.is_open(F.col("state")))
    have = set(findings.columns)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have \
        else F.lit("")
    return rows.select(*keys, *[cell(c).alias(c) for c in fixed.CSV_COLUMNS])


def access_matrix(endpoints: DataFrame, keys=SCAN) -> DataFrame:
    """Endpoint matrix, list cells joined with '; '."""
    types = dict(endpoints.dtypes)

    def cell(c):
        if c not in types:
            return F.lit("").alias(c)
        value = F.array_join(c, "; ") if types[c].startswith("array") \
            else F.col(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)
    return endpoints.select(*keys, *[cell(c) for c in fixed.MATRIX_COLUMNS])


def endpoint_lines(endpoints: DataFrame, keys=SCAN) -> DataFrame:
    return endpoints.select(*keys, F.concat_ws(
        " ", F.coalesce("method", F.lit("ANY")), F.coalesce("path", F.lit("/"))).alias("line"))


def write_csv(df: DataFrame, path: str, keys=SCAN) -> None:
    df.write.mode("overwrite").partitionBy(*keys).option("header", True) \
        .option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, keys=SCAN) -> None:
    df.write.mode("overwrite").partitionBy(*keys).text(path)


# ---- issue XML (S19) -----------------------------------------------------------------
def issue_rows(findings: DataFrame, keys=SCAN) -> DataFrame:
    """Rows of the issue XML; one column per element."""
    c, have = F.col, set(findings.columns)
    get = lambda n: truthy(c(n)) if n in have else F.lit(None).cast("string")
    part = lambda head, n: F.concat(F.lit(head), get(n))
    detail = F.concat_ws(
        "\n\n", part("Where to look:\n", "where_to_look"),
        part("Attack scenario:\n", "attack_scenario"),
        part("Proof of concept:\n", "proof_of_concept"), part("Risk:\n", "risk"),
        part("Code:\n", "code_snippet"), part("CWE: ", "cwe"), part("OWASP: ", "owasp"))
    place = F.concat_ws(":", get("file_path"), c("line_start").cast("string"))
    return findings.where(labels.is_open(c("state"))).select(
        *keys, labels.serial_number(c("finding_id")).alias("serialNumber"),
        F.coalesce(get("cwe"), F.lit("134217728")).alias("type"), c("title").alias("name"),
        F.lit("target").alias("host"), F.coalesce(get("file_path"), F.lit("/")).alias("path"),
        F.coalesce(truthy(place), F.lit("/")).alias("location"),
        labels.issue_severity(c("severity")).alias("severity"),
        labels.issue_confidence(c("confidence")).alias("confidence"),
        F.coalesce(get("description"), F.lit("")).alias("issueBackground"),
        F.coalesce(get("remediation"), F.lit("")).alias("remediationBackground"),
        detail.alias("issueDetail"))


def write_issue_xml(rows: DataFrame, path: str, keys=SCAN) -> None:
    """Writes issues as XML; the keys become attributes of each issue, so that scans stay apart."""
    rows.withColumnsRenamed({k: f"_{k}" for k in keys}).write.mode("overwrite").format("xml").option("rootTag", "issues") \
        .option("rowTag", "issue").save(path)


# ---- JSON fragments --------------------------------------------------------------------
def json_string(c: Column) -> Column:
    """The text between the quotes of a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)


def _comma(first: Column) -> Column:
    return F.when(first, "").otherwise(",")


def sarif_rules(findings: DataFrame, keys=SCAN) -> DataFrame:
    """Distinct rules with the index of their first appearance."""
    keys = list(keys)
    desc = F.col("description") if "description" in findings.columns \
        else F.lit(None).cast("string")
    fix = F.col("remediation") if "remediation" in findings.columns \
        else F.lit(None).cast("string")
    first = findings.groupBy(*keys, labels.sarif_rule_id(
        F.col("cwe"), F.col("title")).alias("rule_id")).agg(
        F.min("finding_id").alias("_first"), F.min_by(F.struct(
            "title", desc.alias("description"), fix.alias("remediation")), "finding_id")
        .alias("_f"))
    return ordered_position(first, keys, ["_first"], "rule_index").select(
        *keys, "rule_id", "rule_index", "_f.*")


def sarif_results(findings: DataFrame, rules: DataFrame, keys=SCAN) -> DataFrame:
    """One result per finding with its rule index and level."""
    keys = list(keys)
    rows = findings.withColumn("rule_id", labels.sarif_rule_id(F.col("cwe"), F.col("title")))
    return rows.join(rules.select(*keys, "rule_id", "rule_index"), [*keys, "rule_id"]) \
        .withColumn("level", labels.sarif_level(F.col("severity")))


#: Findings of a scan whose document is made in windows of the scan; the rules of more are numbered by range.
FEW_FINDINGS = 20_000


def sarif_fragments(findings: DataFrame, keys=SCAN, tool: str = "auditspan") -> DataFrame:
    """(keys, section, ord, text) whose ordered concatenation is SARIF 2.1.0."""
    keys, c = list(keys), F.col
    have = set(findings.columns)
    message = F.coalesce(truthy(c("description")) if "description" in have
                         else F.lit(None).cast("string"), c("title"))
    # a rule is told by its least finding
    told = {n: F.when(c("finding_id").isNotNull(), c(n) if n in have else F.lit(None).cast("string"))
            for n in ("title", "description", "remediation")}
    help_ = F.when(truthy(told["remediation"]).isNotNull(), F.struct(
        told["remediation"].alias("text"), told["remediation"].alias("markdown")))
    rule_json = F.to_json(F.struct(
        c("rule_id").alias("id"), F.struct(told["title"].alias("text")).alias("shortDescription"),
        F.when(truthy(told["description"]).isNotNull(), F.struct(
            told["description"].alias("text"))).alias("fullDescription"), help_.alias("help")))
    region = F.when(c("line_start").isNotNull(), F.struct(
        c("line_start").alias("startLine"),
        (c("line_end") if "line_end" in have else F.lit(None).cast("int")).alias("endLine")))
    places = F.when(truthy(c("file_path")).isNotNull(), F.array(F.struct(F.struct(
        F.struct(c("file_path").alias("uri")).alias("artifactLocation"),
        region.alias("region")).alias("physicalLocation"))))
    extra = [c(k) for k in ("where_to_look", "attack_scenario", "proof_of_concept", "risk",
                            "recommendation") if k in have]
    result_json = F.to_json(F.struct(
        c("rule_id").alias("ruleId"), c("rule_index").alias("ruleIndex"), "level",
        F.struct(message.alias("text")).alias("message"),
        F.struct("severity", "confidence", "state", "source", *extra).alias("properties"),
        places.alias("locations")))
    none = F.lit("")
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0",'
            f'"runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"1.0.0","rules":[')
    rule = F.struct(F.lit(1).alias("section"), F.lpad(c("rule_index").cast("string"), 12, "0").alias("ord"),
                    F.concat(_comma(c("rule_index") == 0), rule_json).alias("text"))
    result = F.struct(F.lit(3).alias("section"), c("finding_id").alias("ord"),
                      F.concat(_comma(c("finding_id") == c("_lead")), result_json).alias("text"))
    fixed_parts = [F.struct(F.lit(n).alias("section"), none.alias("ord"), F.lit(text).alias("text"))
                   for n, text in ((0, head), (2, ']}},"results":['), (4, "]}]}"))]

    def by_scan(rows):
        """Every finding exchanged once: rules, their numbers and the first finding are windows of the scan."""
        rows = rows.withColumns({"rule_id": labels.sarif_rule_id(c("cwe"), c("title")), "level": labels.sarif_level(c("severity"))})
        same_rule = Window.partitionBy(*keys, "rule_id").orderBy(F.asc_nulls_last("finding_id"))
        scan = Window.partitionBy(*keys)
        placed = rows.repartition(*keys).withColumns({"_first": F.first("finding_id").over(same_rule), "_nth": F.row_number().over(same_rule)}) \
            .withColumns({"rule_index": (F.dense_rank().over(scan.orderBy("_first", "rule_id")) - 1).cast("bigint"),
                          "_lead": F.min("finding_id").over(scan)})
        opens = (c("_nth") == 1) & (c("rule_index") == 0)
        named = c("rule_id").isNotNull()
        for k in keys:
            named = named & c(k).isNotNull()
        each = F.array_compact(F.array(*[F.when(opens, part) for part in fixed_parts], F.when(c("_nth") == 1, rule), F.when(named, result)))
        return placed.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*")

    def by_range(rows):
        rules = sarif_rules(rows, keys)
        scans = rows.groupBy(*keys).agg(F.min("finding_id").alias("_lead"))
        firsts = sarif_results(rows, rules, keys).join(scans, keys)
        parts = [scans.select(*keys, F.explode(F.array(*fixed_parts)).alias("_x")),
                 rules.withColumn("finding_id", none).select(*keys, rule.alias("_x")), firsts.select(*keys, result.alias("_x"))]
        return reduce(lambda a, b: a.unionByName(b), [p.select(*keys, "_x.*") for p in parts])

    crowded = crowded_groups(findings, keys, FEW_FINDINGS)
    if crowded is None:
        return by_scan(findings)
    few, many = split_crowded(findings, keys, crowded)
    return by_scan(few).unionByName(by_range(many))


def write_fragments(fragments: DataFrame, path: str, keys=SCAN) -> None:
    """Text files that concatenate, in file order, to one document per key."""
    order = [*keys, *[c for c in fragments.columns if c not in (*keys, "text")]]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select(*keys, "text").write.mode("overwrite").partitionBy(*keys).text(path)


# ---- OpenAPI (S21, J10, D25, H13, H35) -------------------------------------------------
def related_findings(endpoints: DataFrame, findings: DataFrame, keys=SCAN) -> DataFrame:
    """Open findings per endpoint label, one row each."""
    keys = list(keys)
    notes = findings.where(labels.is_open(F.col("state"))
                           & truthy(F.col("endpoint")).isNotNull()).select(
        *keys, routes.join_label(F.col("endpoint")).alias("_label"), "finding_id",
        F.format_string("[%s] %s", "severity", "title").alias("related"))
    eps = endpoints.withColumn("_label", F.upper(F.concat_ws(" ", "method", "path")))
    return eps.select(*keys, "endpoint_id", "_label").join(notes, [*keys, "_label"]).select(
        *keys, "endpoint_id", "finding_id", "related")


def openapi_operations(endpoints: DataFrame, min_risk: str = "low", keys=SCAN) -> DataFrame:
    """One row per (template path, verb); among routes that share both, the last in
    risk order wins. ANY routes show as get and post."""
    keys, c = list(keys), F.col
    risk = routes.effective_risk(c("risk"), c("heuristic_risk"))
    verb = F.upper(F.coalesce("method", F.lit("ANY")))
    verbs = F.when(verb.isin("ANY", "ALL"), F.array(F.lit("get"), F.lit("post"))) \
        .otherwise(F.array(F.lower(verb)))
    rows = endpoints.where(routes.at_least_risk(c("risk"), c("heuristic_risk"), min_risk))
    rest = [n for n in endpoints.columns if n not in keys]
    wide = rows.select(*keys, routes.template_path(c("path")).alias("template"),
                       verbs.alias("_verbs"), F.struct(
                           *rest, risk.alias("_risk"),
                           routes.template_params(c("path")).alias("params"),
                           routes.test_notes().alias("tests")).alias("ep")) \
        .select(*keys, "template", F.explode("_verbs").alias("verb"), "ep")
    return wide.groupBy(*keys, "template", "verb").agg(F.max_by("ep", F.struct(
        labels.risk_rank(c("ep._risk")), c("ep.file_path"), c("ep.line"),
        c("ep.endpoint_id"))).alias("ep")).select(*keys, "template", "verb", "ep.*")


def openapi_fragments(endpoints: DataFrame, findings: DataFrame, keys=SCAN,
                      base_url: str = "https://target.example", min_risk: str = "low",
                      quoted_findings: int = 50):
    """(keys, s1, s2, s3, s4, text) concatenating to an OpenAPI 3 document per scan.

    An operation's description quotes its first findings; the whole list, however
    long, follows row by row as ``x-related-findings``.
    """
    keys, c = list(keys), F.col
    at = [*keys, "endpoint_id"]
    ops = openapi_operations(endpoints, min_risk, keys)
    related = related_findings(endpoints, findings, keys)
    quoted = top_n(related, at, [c("finding_id")], quoted_findings).groupBy(*at).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_id", "related"))),
                                 lambda x: F.concat(F.lit("\n- "), x["related"])), "")
        .alias("_quoted"))
    totals = related.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"),
                                      F.min("finding_id").alias("_f0"))
    ops = ops.join(quoted, at, "left").join(totals, at, "left")
    first_path = ops.groupBy(*keys).agg(F.min("template").alias("_p0"))
    first_verb = ops.groupBy(*keys, "template").agg(F.min("verb").alias("_v0"))
    o = ops.join(first_path, keys).join(first_verb, [*keys, "template"])
    risk = c("_risk")
    authn = F.coalesce(truthy(c("authn")), c("auth_scope"))
    public = (c("authn") == "public") | (truthy(c("authn")).isNull()
                                         & c("auth_scope").isin("none", "public"))
    notes = F.when(truthy(c("notes")).isNotNull(), F.concat(F.lit("\nNotes: "), c("notes")))
    more = F.when(c("_n") > quoted_findings, "\n- ... (all in x-related-findings)").otherwise("")
    steps = F.when(F.size("tests") > 0, F.concat(F.lit("\nBAC tests:"), F.array_join(
        F.transform("tests", lambda t: F.concat(F.lit("\n- "), t)), ""))).otherwise("")
    description = F.concat(
        F.lit("Handler: "), F.coalesce(truthy(c("handler_file")), c("file_path"), F.lit("")),
        F.lit(":"), F.coalesce("handler_line", "line").cast("string"), F.lit("\nAuth: authn="),
        F.coalesce(authn, F.lit("")), F.lit(" authz="),
        F.coalesce(truthy(c("authz")), F.lit("unassessed")), F.lit(" risk="), risk,
        F.coalesce(notes, F.lit("")),
        F.coalesce(F.concat(F.lit("\nRelated findings:"), c("_quoted"), more), F.lit("")), steps)
    tags = F.concat(F.array(F.concat(F.lit("risk-"), risk)),
                    F.when(c("_n") > 0, F.array(F.lit("has-findings"))).otherwise(
                        F.array().cast("array<string>")))
    text_type = F.create_map(F.lit("type"), F.lit("string"))
    params = F.transform("params", lambda p: F.struct(
        p.alias("name"), F.lit("path").alias("in"), F.lit(True).alias("required"),
        text_type.alias("schema"), F.lit("1").alias("example")))
    access = F.struct(*[c(k) for k in (
        "authn", "authz", "risk", "auth_scope", "heuristic_risk", "role_hints",
        "ownership_hints", "id_params", "id_kind", "privileged", "state_changing")])
    body = F.to_json(F.struct(
        F.concat_ws("_", "verb", "endpoint_id").alias("operationId"),
        F.concat(F.lit("["), F.upper(risk), F.lit("] "),
                 F.coalesce(truthy(c("handler")), c("template"))).alias("summary"),
        description.alias("description"), tags.alias("tags"), params.alias("parameters"),
        access.alias("x-access"), c("tests").alias("x-bac-tests")))
    answers = (',"responses":{"200":{"description":"OK"},"401":{"description":'
               '"Unauthenticated"},"403":{"description":"Forbidden"}},"security":')
    operation = F.concat(
        F.regexp_replace(body, r"\}$", ""), F.lit(answers),
        F.when(public, "[]").otherwise('[{"bearerAuth":[]},{"cookieAuth":[]}]'),
        F.when(c("verb").isin("post", "put", "patch"), F.lit(
            ',"requestBody":{"required":false,"content":{"application/json":'
            '{"schema":{"type":"object"},"example":{}}}}')).otherwise(""),
        F.lit(',"x-related-findings":['))
    name = lambda x: F.concat(F.lit('"'), json_string(x), F.lit('"'))

    def row(df, s1, s2, s3, s4, value):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return df.select(*keys, F.lit(s1).alias("s1"), lit(s2).alias("s2"),
                         lit(s3).alias("s3"), lit(s4).alias("s4"), value.alias("text"))
    scans = endpoints.select(*keys).distinct()
    paths_ = first_verb.join(first_path, keys)
    start = ('{"openapi":"3.0.3","info":{"title":"Endpoints of a scan","version":"1.0"},'
             f'"servers":[{{"url":"{base_url.rstrip("/")}"}}],"tags":[{{"name":"risk-high"}},'
             '{"name":"risk-medium"},{"name":"risk-low"},{"name":"has-findings"}],"paths":{')
    end = ('},"components":{"securitySchemes":{"bearerAuth":{"type":"http","scheme":"bearer"},'
           '"cookieAuth":{"type":"apiKey","in":"cookie","name":"session"}}}}')
    listed = related.join(ops.select(*at, "template", "verb", "_f0"), at)
    return (row(scans, 0, "", "", "", F.lit(start))
            .unionByName(row(paths_, 1, c("template"), "", "", F.concat(
                _comma(c("template") == c("_p0")), name(c("template")), F.lit(":{"))))
            .unionByName(row(o, 1, c("template"), c("verb"), "", F.concat(
                _comma(c("verb") == c("_v0")), name(c("verb")), F.lit(":"), operation)))
            .unionByName(row(listed, 1, c("template"), c("verb"),
                             F.concat(F.lit("1"), c("finding_id")), F.concat(
                _comma(c("finding_id") == c("_f0")), name(c("related")))))
            .unionByName(row(o, 1, c("template"), c("verb"), "2", F.lit("]}")))
            .unionByName(row(paths_, 1, c("template"), "~", "", F.lit("}")))
            .unionByName(row(scans, 2, "", "", "", F.lit(end))))


# ---- finding table (S23, S24) --------------------------------------------------------------
def append_findings(findings: DataFrame, table: str) -> None:
    findings.write.mode("append").partitionBy("source").parquet(table)


def write_swapped(table_after: DataFrame, path: str) -> None:
    """Store the outcome of ``replace_sources`` as a new version of the table; the
    old version stays readable until the new one is complete."""
    table_after.write.mode("errorifexists").partitionBy("source").parquet(path)
