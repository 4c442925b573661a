"""The live check of access findings as one composition: which findings to replay, what the recorded
answers say, and the findings and counts after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths
from ..functions.labels import truthy
from ..operators import responses, verdicts
from ..operators.ordered import pin

SCAN = ["scan_id"]


@dataclass
class LiveReview:
    #: findings that were to be confirmed, with kind, method, path and id_params where they can be replayed
    requests: DataFrame
    #: all findings with live_verdict, states and confidences
    findings: DataFrame
    #: outcome and number of findings per scan
    counts: DataFrame


def findings_in_scope(findings: DataFrame, runs: DataFrame, keys=SCAN) -> DataFrame:
    """Open access findings of the runs that check access, inside their path filters. Without a label a
    finding is inside.

    runs: keys, include_paths, exclude_paths, access_control.
    """
    at = F.locate(" ", F.coalesce("endpoint", F.lit("")))
    path = F.when(at > 0, F.substr("endpoint", at + 1)).otherwise("")
    inside = truthy(F.col("endpoint")).isNull() | paths.in_prefix_scope(path, F.col("include_paths"), F.col("exclude_paths"))
    return findings.where((F.col("source") == "access") & labels.is_open(F.col("state"))).join(
        runs.where("access_control"), list(keys)).where(inside).select(*[F.col(c) for c in findings.columns])


def run_live_review(findings: DataFrame, endpoints: DataFrame, runs: DataFrame, recorded: DataFrame, keys=SCAN) -> LiveReview:
    """findings: keys, finding_id, source, state, rule, cwe, endpoint, endpoint_id, confidence, triage_note; endpoints: keys,
    endpoint_id, method, path, id_params; recorded: the responses of probes by finding_id (see ``response_verdicts``).

    A finding without a kind, a label or any recorded answer is untestable; only findings in scope change.
    """
    keys = list(keys)
    asked = pin(findings_in_scope(findings, runs, keys))
    replayable = responses.finding_requests(asked, endpoints, keys).where(F.col("kind").isNotNull())
    said = responses.response_verdicts(recorded).select("finding_id", "kind", "verdict", "reason")
    judged = pin(replayable.select(*keys, "finding_id", "kind", "method", "path", "id_params").join(said, ["finding_id", "kind"], "left"))
    after = verdicts.apply_live_verdicts(findings, judged.where("verdict IS NOT NULL").select(*keys, "finding_id", "verdict", "reason"),
                                         (*keys, "finding_id"))
    counts = responses.outcome_counts(asked.select(*keys, "finding_id").join(
        judged.select(*keys, "finding_id", "verdict"), [*keys, "finding_id"], "left"), keys)
    return LiveReview(judged, after, counts)
