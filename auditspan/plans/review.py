"""A whole static review as one composition of DataFrame operators.

Where the interactive tool asks a model, this plan takes tables of what was said
(:class:`Answers`). What nobody was asked about stays as the deterministic steps left it: hits
stay unaddressed, heuristic flags stay unverified, findings keep their state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..operators import (access_flags, access_map, corpus, evidence, lifecycle, matching,
                         rollups, routes, verdicts)
from ..operators.ordered import pin
from .stages import ReviewOptions

DOC = ["artifact_id"]


@dataclass
class Answers:
    """What reviewers, judges and verifiers said, by artifact_id."""

    #: hit_id, verdict, severity, confidence, reasoning: on hits that no finding addresses
    triage: DataFrame | None = None
    #: findings in files with sinks that had none
    second_look: DataFrame | None = None
    #: endpoint_id, authn, authz, risk, notes
    endpoints: DataFrame | None = None
    #: findings of the access review, with endpoint and cwe
    access_findings: DataFrame | None = None
    #: flag_id, verdict, reason, severity
    flags: DataFrame | None = None
    #: finding_id, state, confidence, merged_into
    judged: DataFrame | None = None
    #: finding_id, verdict, confidence, reasoning, severity, human_question
    verdicts: DataFrame | None = None


@dataclass
class Review:
    files: DataFrame
    candidates: DataFrame
    endpoints: DataFrame | None
    flags: DataFrame | None
    unaddressed: DataFrame | None
    #: findings of reviewers, triage, second look and access review, judged and verified
    findings: DataFrame
    #: these and the scanners' candidates, as the finding table holds them
    stored: DataFrame
    summary: DataFrame


SCANNERS = {}


def scanner(name: str):
    """Register a function (files, options) -> candidates under a name."""
    def register(fn):
        SCANNERS[name] = fn
        return fn
    return register


@scanner("semgrep")
def regex_rules(files: DataFrame, options: ReviewOptions) -> DataFrame:
    from ..sources.rules import built_in_rules, executable
    rules = executable(built_in_rules())
    return corpus.rule_candidates(corpus.rule_hits(files, rules), rules)


def hit_id() -> Column:
    """Identity of a scanner hit: its file, line and rule."""
    return F.concat(F.lit("hit-"), F.substring(F.md5(F.concat_ws(
        "|", F.coalesce("file_path", F.lit("")), F.coalesce(F.col("line_start").cast("string"), F.lit("")),
        F.coalesce("rule", F.lit(""))).cast("binary")), 1, 16))


def triaged_hits(missed: DataFrame, triage: DataFrame, keys=DOC) -> tuple[DataFrame, DataFrame]:
    """Findings of the hits that triage has a verdict for, and the hits without one."""
    c = F.col
    tagged = missed.withColumn("hit_id", hit_id())
    said = triage.select(*keys, "hit_id", F.struct(
        verdicts.verdict_name(c("verdict")).alias("verdict"), labels.clamp01(c("confidence"), None).alias("confidence"),
        F.lower("severity").alias("severity"), F.coalesce("reasoning", F.lit("")).alias("reasoning")).alias("_v"))
    rows = tagged.join(said, [*keys, "hit_id"], "left")
    name = c("_v.verdict")
    found = verdicts.candidate_findings(rows.where("_v IS NOT NULL").drop("hit_id")).withColumns({
        "finding_id": hit_id(), "source": F.lit("correlated"),
        "state": F.when(name == "false_positive", "dismissed").when(name == "uncertain", "needs_info").otherwise("proposed"),
        "severity": F.when(c("_v.severity").isin(*fixed.SEVERITIES), c("_v.severity")).otherwise(c("severity")),
        "confidence": F.coalesce(c("_v.confidence"), c("confidence")),
        "triage_note": F.when(name == "false_positive", c("_v.reasoning"))})
    return found.drop("_v"), rows.where("_v IS NULL").select(*missed.columns)


def judged_findings(findings: DataFrame, judged: DataFrame, keys=DOC) -> DataFrame:
    """States and confidences of the judge; what it merged into another finding is dismissed."""
    c = F.col
    said = judged.select(*keys, "finding_id", F.struct("state", labels.clamp01(c("confidence"), None).alias("confidence"), "merged_into").alias("_j"))
    rows = findings.join(said, [*keys, "finding_id"], "left")
    merged = c("_j.merged_into").isNotNull()
    state = F.lower("_j.state")
    return verdicts._replace(
        rows.select(*[c(n) for n in findings.columns], "_j"),
        state=F.when(merged, "dismissed").when(state.isin(*fixed.STATES), state).otherwise(c("state")),
        confidence=F.coalesce(c("_j.confidence"), c("confidence")),
        triage_note=F.when(merged, F.concat(F.lit("Merged into "), c("_j.merged_into"))).otherwise(c("triage_note"))).drop("_j")


def _as_findings(rows: DataFrame) -> DataFrame:
    """Rows with every column that evidence and normalisation read."""
    wanted = {"finding_id": "string", "title": "string", "description": "string", "severity": "string", "confidence": "double",
              "source": "string", "state": "string", "cwe": "string", "category": "string", "file_path": "string", "line_start": "int",
              "line_end": "int", "code_snippet": "string", "human_question": "string", "triage_note": "string", "triaged_by": "string",
              "endpoint": "string", "rule": "string", "unverified": "boolean"}
    return rows.select("artifact_id", *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted.items()])


def _access(endpoints: DataFrame, flags: DataFrame, answers: Answers):
    """Endpoints with verdicts, flags with outcomes, and the findings that remain of both."""
    named = lambda f: f.withColumn("finding_id", F.concat(F.lit("flag-"), "flag_id"))
    if answers.endpoints is None:
        return endpoints, flags, [named(access_flags.mark_unverified(flags.withColumn("triage_note", F.lit(None).cast("string"))))]
    assessed = access_flags.apply_endpoint_verdicts(endpoints, answers.endpoints, DOC)
    spark = endpoints.sparkSession
    found = answers.access_findings if answers.access_findings is not None else spark.createDataFrame(
        [], "artifact_id string, endpoint string, cwe string")
    spoken = answers.flags if answers.flags is not None else spark.createDataFrame(
        [], "artifact_id string, flag_id string, verdict string, reason string, severity string")
    resolved = pin(access_flags.resolve_flags(flags, assessed, found, spoken, DOC))
    parts = [named(access_flags.surviving_flags(resolved))]
    if answers.access_findings is not None:
        parts.append(found)
    return assessed, resolved, parts


def run_review(files: DataFrame, reviewer_findings: DataFrame,
               options: ReviewOptions | None = None,
               extra_candidates: DataFrame | None = None,
               answers: Answers | None = None) -> Review:
    """files: artifact_id, path, content (text); reviewer_findings: artifact_id,
    finding_id and the finding columns. Keys stay per artifact throughout, so one
    call reviews every artifact of the tables."""
    options, answers = options or ReviewOptions(), answers or Answers()
    scope = files
    if options.selections:
        scope = corpus.select_files(scope.withColumn("included", F.lit(True)),
                                    list(options.selections)).drop("included")
    parts = [fn(scope, options) for name, fn in SCANNERS.items() if name in options.scanners]
    if extra_candidates is not None:
        parts.append(extra_candidates)
    if not parts:
        raise ValueError("a review needs a scanner or extra candidates")
    merged = verdicts.union_candidates(*parts).withColumn("ord", F.struct(
        "file_path", "line_start", "rule"))
    candidates = pin(verdicts.dedupe_candidates(merged, DOC).drop("ord"))
    endpoints = flags = None
    access: list[DataFrame] = []
    if options.checks.access_control:
        found = pin(routes.extract_routes(scope))
        context = pin(access_map.global_context(scope))
        endpoints = pin(access_map.access_map(found, scope, context))
        flags = pin(access_flags.access_flags(endpoints, context))
        if options.targeted:
            scope = lifecycle.targeted_files(scope, candidates, endpoints)
        endpoints, flags, access = _access(endpoints, flags, answers)
    # what reviewers cite is checked against the code before hits are compared with it
    checked = pin(evidence.check_evidence(_as_findings(reviewer_findings), scope, DOC))
    later, missed = [_as_findings(a) for a in access], None
    if options.checks.coverage:
        missed = matching.unaddressed_hits(candidates, checked, DOC)
        if answers.triage is not None:
            hits, missed = triaged_hits(pin(missed), answers.triage)
            later.append(_as_findings(hits))
        if answers.second_look is not None:
            later.append(_as_findings(answers.second_look))
    every = checked
    if later:  # all of them meet the files once
        every = checked.unionByName(evidence.check_evidence(reduce(lambda a, b: a.unionByName(b), later), scope, DOC))
    if answers.judged is not None:
        every = judged_findings(every, answers.judged)
    if options.checks.verify and answers.verdicts is not None:
        every = verdicts.apply_verdicts(every, answers.verdicts, (*DOC, "finding_id"))
    final = pin(verdicts.storable_findings(verdicts.normalize_findings(every)))
    static = verdicts.storable_findings(_as_findings(verdicts.candidate_findings(candidates).withColumn("finding_id", hit_id())))
    return Review(scope, candidates, endpoints, flags, missed, final,
                  static.unionByName(final, allowMissingColumns=True), rollups.scan_summary(final, DOC))
