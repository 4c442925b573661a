"""Scanner result documents as candidates or findings.

Every function takes a DataFrame with one JSON document per row in ``json``
(plus key columns) and explodes it with a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths, text
from ..functions.labels import truthy
from ..functions.text import lookup, strip_html

SCAN = ("scan_id",)
_SAST = ("results array<struct<check_id:string,path:string,start:struct<line:int>,"
         "`end`:struct<line:int>,extra:struct<lines:string,message:string,severity:string,"
         "metadata:struct<cwe:string,owasp:string,category:string,"
         "shortDescription:string>>>>")
_QUALITY = ("issues array<struct<rule:string,severity:string,component:string,message:string,"
            "line:int,type:string,tags:array<string>>>")
_HOTSPOT = ("hotspots array<struct<key:string,ruleKey:string,component:string,"
            "vulnerabilityProbability:string,message:string,line:int>>")
_ITEM = ("struct<rule:string,check_id:string,title:string,message:string,severity:string,"
         "cwe:string,owasp:string,category:string,file_path:string,path:string,"
         "line_start:int,line:int,line_end:int,code_snippet:string>")
_TOOL = (f"findings array<{_ITEM}>,"
         f"content array<struct<type:string,json:struct<findings:array<{_ITEM}>>>>")
_ISSUE = ("struct<name:string,issue_name:string,type:string,severity:string,url:string,"
          "origin:string,issue_detail:string,detail:string,description:string,"
          "confidence:string,cwe:string,vulnerability_classifications:string,"
          "remediation:string,remediation_detail:string,type_index:string,"
          "serial_number:string,evidence:string,request_response:string,proof:string,"
          "request:string>")
_DYNAMIC = (f"issues array<{_ISSUE}>,findings array<{_ISSUE}>,scan_issues array<{_ISSUE}>,"
            f"content array<struct<json:struct<issues:array<{_ISSUE}>,"
            f"findings:array<{_ISSUE}>>>>")


def first_of(value: Column) -> Column:
    """First element when a JSON list was given where a string is expected."""
    return truthy(F.when(value.startswith("["), F.get_json_object(value, "$[0]"))
                  .otherwise(value))


def first_line(c: Column, n: int = 200) -> Column:
    return F.substring(F.split_part(c, F.lit("\n"), F.lit(1)), 1, n)


def sast_candidates(docs: DataFrame, keys=SCAN, floor: str = "WARNING") -> DataFrame:
    """SAST results at or above a severity floor."""
    levels = list(fixed.SAST_LEVELS)
    keep = levels[levels.index(floor):] if floor in levels else levels[1:]
    rows = docs.select(*keys, F.explode(F.from_json("json", _SAST)["results"]).alias("r"))
    sev = F.coalesce("r.extra.severity", F.lit("WARNING"))
    meta = F.col("r.extra.metadata")
    lines = F.coalesce("r.extra.lines", F.lit(""))
    return rows.where(sev.isin(*keep)).select(
        *keys, F.lit("semgrep").alias("source"),
        F.coalesce("r.check_id", F.lit("")).alias("rule"),
        first_line(F.coalesce(truthy(meta["shortDescription"]), "r.check_id", F.lit("")))
        .alias("title"), F.coalesce("r.extra.message", F.lit("")).alias("message"),
        lookup(sev, fixed.SAST_SEVERITY, "medium").alias("severity"),
        first_of(meta["cwe"]).alias("cwe"), first_of(meta["owasp"]).alias("owasp"),
        F.coalesce(meta["category"], F.lit("security")).alias("category"),
        F.regexp_replace(F.coalesce("r.path", F.lit("")), r"^(\./+)+", "").alias("file_path"),
        F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"),
        F.when(text.strip(lines) == "requires login", "").otherwise(lines).alias("code_snippet"))


def with_context(candidates: DataFrame, files: DataFrame, keys=SCAN, radius: int = 3):
    """Replace the matched text by a few numbered lines around it where the file is
    at hand."""
    wanted = candidates.select(*keys, "file_path").distinct()
    sides = files.select(*keys, F.col("path").alias("file_path"), "content").join(
        wanted, [*keys, "file_path"], "left_semi").select(
        *keys, "file_path", text.lines_of(F.col("content")).alias("_l"))
    lo = F.greatest(F.lit(1), F.col("line_start") - radius)
    part = text.line_window(F.col("_l"), lo, F.col("line_start") + radius)
    shown = F.array_join(F.transform(part, lambda t, i: F.concat(
        F.lpad((lo + i).cast("string"), 5, " "), F.lit(" | "),
        F.rtrim(t, F.lit(text.BLANKS)))), "\n")
    usable = (F.col("line_start") > 0) & (F.size("_l") > 0)
    return candidates.join(sides, [*keys, "file_path"], "left").select(
        *[F.coalesce(truthy(F.when(usable, shown)), F.col(c)).alias(c)
          if c == "code_snippet" else F.col(c) for c in candidates.columns])


def _component(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    at = F.locate(":", c)
    return F.when(at > 0, F.substr(c, at + 1)).otherwise(c)


def quality_candidates(docs: DataFrame, keys=SCAN) -> DataFrame:
    """Quality-server issues."""
    rows = docs.select(*keys, F.explode(F.from_json("json", _QUALITY)["issues"]).alias("r"))

    def tag(pattern, group):
        hits = F.transform(F.coalesce("r.tags", F.array().cast("array<string>")),
                           lambda t: F.regexp_extract(t, pattern, group))
        return F.try_element_at(F.filter(hits, lambda x: x != ""), F.lit(1))

    return rows.select(
        *keys, F.lit("sonarqube").alias("source"),
        F.coalesce("r.rule", F.lit("")).alias("rule"),
        first_line(F.coalesce(truthy(F.col("r.message")), "r.rule", F.lit(""))).alias("title"),
        F.coalesce("r.message", F.lit("")).alias("message"),
        lookup(F.coalesce("r.severity", F.lit("MAJOR")), fixed.QUALITY_SEVERITY, "medium")
        .alias("severity"),
        F.concat(F.lit("CWE-"), tag(r"(?i)^cwe-(\d+)", 1)).alias("cwe"),
        F.upper(tag(r"(?i)^owasp-(a\d+)", 1)).alias("owasp"),
        F.lower(F.coalesce("r.type", F.lit("CODE_SMELL"))).alias("category"),
        _component(F.col("r.component")).alias("file_path"),
        F.col("r.line").alias("line_start"), F.col("r.line").alias("line_end"),
        F.lit(None).cast("string").alias("code_snippet"))


def hotspot_candidates(docs: DataFrame, keys=SCAN) -> DataFrame:
    """Security hotspots."""
    rows = docs.select(*keys, F.explode(F.from_json("json", _HOTSPOT)["hotspots"]).alias("r"))
    none = F.lit(None).cast("string")
    return rows.select(
        *keys, F.lit("sonarqube").alias("source"),
        F.coalesce("r.ruleKey", "r.key", F.lit("")).alias("rule"),
        F.substring(F.coalesce(truthy(F.col("r.message")), F.lit("Security Hotspot")), 1, 200)
        .alias("title"), F.coalesce("r.message", F.lit("")).alias("message"),
        lookup(F.coalesce("r.vulnerabilityProbability", F.lit("MEDIUM")),
               fixed.HOTSPOT_SEVERITY, "medium").alias("severity"),
        none.alias("cwe"), none.alias("owasp"), F.lit("security_hotspot").alias("category"),
        _component(F.col("r.component")).alias("file_path"),
        F.col("r.line").alias("line_start"), F.col("r.line").alias("line_end"),
        none.alias("code_snippet"))


def tool_candidates(docs: DataFrame, server: str, kind: str, keys=SCAN) -> DataFrame:
    """Generic tool results: two accepted shapes, alternative key names."""
    d = F.from_json("json", _TOOL)
    block = F.try_element_at(F.filter(d["content"], lambda b: (b["type"] == "json")
                                      & b["json"].isNotNull()), F.lit(1))
    rows = docs.select(*keys, F.explode(F.coalesce(
        d["findings"], block["json"]["findings"])).alias("r"))
    r = lambda n: F.col(f"r.{n}")
    return rows.select(
        *keys, F.lit(server).alias("source"),
        F.coalesce(r("rule"), r("check_id"), F.lit("")).alias("rule"),
        F.substring(F.coalesce(r("title"), r("message"), F.lit("")), 1, 200).alias("title"),
        F.coalesce(r("message"), F.lit("")).alias("message"),
        F.lower(F.coalesce(r("severity"), F.lit("medium"))).alias("severity"),
        r("cwe").alias("cwe"), r("owasp").alias("owasp"),
        F.coalesce(r("category"), F.lit(kind)).alias("category"),
        F.coalesce(r("file_path"), r("path"), F.lit("")).alias("file_path"),
        F.coalesce(r("line_start"), r("line")).alias("line_start"),
        r("line_end").alias("line_end"), r("code_snippet").alias("code_snippet"))


def dynamic_findings(docs: DataFrame, keys=SCAN) -> DataFrame:
    """Dynamic-scanner issues as findings."""
    d = F.from_json("json", _DYNAMIC)
    blocks = F.transform(F.filter(d["content"], lambda b: b["json"].isNotNull()),
                         lambda b: F.coalesce(b["json"]["issues"], b["json"]["findings"]))
    nested = F.try_element_at(F.filter(blocks, lambda x: x.isNotNull()), F.lit(1))
    rows = docs.select(*keys, F.explode(F.coalesce(
        d["issues"], d["findings"], d["scan_issues"], nested)).alias("r"))
    t = lambda *names: F.coalesce(*[truthy(F.col(f"r.{n}")) for n in names])
    url = F.coalesce(t("url", "origin"), F.lit(""))
    shown = F.coalesce(*[F.when(text.strip(F.col(f"r.{n}")) != "", F.col(f"r.{n}")) for n in
                         ("evidence", "request_response", "proof", "request")])
    return rows.select(
        *keys, F.substring(F.coalesce(t("name", "issue_name", "type"), F.lit("Issue")), 1, 300)
        .alias("title"),
        F.substring(strip_html(t("issue_detail", "detail", "description")), 1, 4000)
        .alias("description"),
        lookup(F.lower(F.coalesce("r.severity", F.lit("medium"))), fixed.DYNAMIC_SEVERITY,
               "medium").alias("severity"),
        lookup(F.lower(F.coalesce("r.confidence", F.lit(""))), fixed.DYNAMIC_CONFIDENCE, 0.7)
        .alias("confidence"), F.lit("dast").alias("source"), F.lit("proposed").alias("state"),
        first_of(t("cwe", "vulnerability_classifications")).alias("cwe"),
        F.lit("dynamic").alias("category"),
        truthy(F.substring(strip_html(t("remediation", "remediation_detail")), 1, 2000))
        .alias("remediation"), url.alias("endpoint"),
        F.substring(shown, 1, 1000).alias("code_snippet"),
        t("type_index", "serial_number").alias("rule"))


def model_answers(answers: DataFrame, keys=SCAN) -> DataFrame:
    """Findings inside free-text model answers."""
    body = text.tolerant_json(F.col("answer"))
    schema_ = ("findings array<struct<id:string,title:string,description:string,"
               "severity:string,confidence:string,cwe:string,category:string,"
               "file_path:string,line_start:string,line_end:string,code_snippet:string,"
               "state:string,source:string>>")
    return answers.select(*keys, F.explode(F.from_json(body, schema_)["findings"])
                          .alias("f")).select(*keys, "f.*")


def in_selected_paths(files: DataFrame, selections: list[str]) -> DataFrame:
    return files.where(paths.in_selection(F.col("path"), selections))
