"""Snapshot differences between a scan and the scan before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .ordered import pin, previous_value

#: Pairs of scans that may be broadcast, some 40 bytes each.
FEW_PAIRS = 100_000
BRIEF = ("finding_id", "title", "severity", "state", "source", "cwe", "file_path",
         "line_start", "endpoint")


def baseline_scans(scans: DataFrame) -> DataFrame:
    """(scan_id, baseline_id): the latest strictly earlier scan of the project.

    Scans of one instant collapse to their highest id first, and a project's
    history is cut by month, so one busy project never fills a task.
    """
    moments = scans.groupBy("project_id", "created_at").agg(
        F.max("scan_id").alias("_at"))
    chained = previous_value(moments, ["project_id"], ["created_at"],
                             F.date_trunc("month", "created_at"), F.col("_at"),
                             "baseline_id")
    return scans.select("project_id", "created_at", "scan_id").join(
        chained.where("baseline_id is not null").drop("_at"),
        ["project_id", "created_at"]).select("scan_id", "baseline_id")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    c = F.col
    return findings.withColumn("fingerprint", labels.fingerprint(
        c("cwe"), c("rule"), c("category"), c("title"), c("file_path"), c("endpoint")))


def representatives(findings: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Most severe open finding per fingerprint; ties go to the lowest id."""
    best = F.min_by(F.struct(*BRIEF), F.struct(
        labels.severity_rank(F.col("severity")), F.col("finding_id")))
    return with_fingerprint(findings.where(labels.is_open(F.col("state")))) \
        .groupBy(*keys, "fingerprint").agg(best.alias("rep"))


def _roles(pairs: DataFrame) -> DataFrame:
    """(src, scan_id, side): a scan's findings are current (0) for itself and baseline (1) for the scans
    that name it as theirs."""
    return pairs.select(F.explode(F.array(
        F.struct(F.col("scan_id").alias("src"), "scan_id", F.lit(0).alias("side")),
        F.struct(F.col("baseline_id").alias("src"), "scan_id", F.lit(1).alias("side")))).alias("r")).select("r.*")


def scan_diff(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each issue as new, fixed or still_open against the baseline scan.

    Open findings meet the scans they count for, and one aggregation on (scan, fingerprint) picks
    both representatives, so findings and pairs are each read once.
    """
    rows = with_fingerprint(findings.where(labels.is_open(F.col("state")))).select(
        F.col("scan_id").alias("src"), "fingerprint", F.struct(*BRIEF).alias("rep"),
        F.struct(labels.severity_rank(F.col("severity")), F.col("finding_id")).alias("place"))
    best = lambda side: F.min_by("rep", F.when(F.col("side") == side, F.col("place")))
    both = rows.join(_roles(pairs), "src").groupBy("scan_id", "fingerprint").agg(best(0).alias("cur"), best(1).alias("base"))
    return _compared(both)


def _compared(both: DataFrame) -> DataFrame:
    """Status of (scan_id, fingerprint, cur, base)."""
    status = (F.when(F.col("base").isNull(), "new").when(F.col("cur").isNull(), "fixed")
              .otherwise("still_open"))
    changed = F.when(F.col("cur").isNotNull() & F.col("base").isNotNull()
                     & (F.col("cur.severity") != F.col("base.severity")),
                     F.col("base.severity"))
    shown = F.coalesce("cur", "base")
    return both.select("scan_id", "fingerprint", status.alias("status"),
                       *[shown[b].alias(b) for b in BRIEF],
                       changed.alias("severity_changed_from"))


# ---- representatives as a stored table ---------------------------------------------
def store_representatives(findings: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Keeps the representatives of all scans of *findings* as the table *name* under *path*, in
    buckets of (scan_id, fingerprint)."""
    representatives(findings).write.option("path", path).bucketBy(buckets, "scan_id", "fingerprint").sortBy(
        "scan_id", "fingerprint").saveAsTable(name)


def stored_diff(new_findings: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """``scan_diff`` of new scans against stored representatives (pairs: scan_id, baseline_id).

    Only the new side is exchanged: it goes to the buckets of the table, which is read in place. Up to FEW_PAIRS pairs
    reach the table as a broadcast; more are joined like any table. Several new scans may share a baseline.
    """
    stored, pairs = new_findings.sparkSession.table(name), pin(pairs.select("scan_id", "baseline_id"))
    current = representatives(new_findings).withColumnRenamed("scan_id", "new_scan").join(
        pairs.select(F.col("scan_id").alias("new_scan"), F.col("baseline_id").alias("scan_id")), "new_scan")
    arrived = current.groupBy("scan_id", "fingerprint").agg(F.collect_list(F.struct("new_scan", "rep")).alias("arrived"))
    asked = pairs.groupBy(F.col("baseline_id").alias("scan_id")).agg(F.collect_set("scan_id").alias("news"))
    asked = F.broadcast(asked) if pairs.count() <= FEW_PAIRS else asked
    base = stored.join(asked, "scan_id").select("scan_id", "fingerprint", F.col("rep").alias("base"), "news")
    met = base.join(arrived, ["scan_id", "fingerprint"], "full")
    each = met.select("fingerprint", "base", "arrived", F.explode(F.coalesce(
        "news", F.transform("arrived", lambda a: a["new_scan"]))).alias("scan_id"))
    own = F.try_element_at(F.filter("arrived", lambda a: a["new_scan"] == F.col("scan_id")), F.lit(1))
    return _compared(each.select("scan_id", "fingerprint", own["rep"].alias("cur"), "base"))


def diff_counts(diff: DataFrame, pairs: DataFrame) -> DataFrame:
    """new / fixed / still_open per scan; scans without differences show zeros."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = diff.groupBy("scan_id").agg(
        n("new").alias("new"), n("fixed").alias("fixed"), n("still_open").alias("still_open"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return pairs.join(counted, "scan_id", "left").select(
        "scan_id", "baseline_id", zero("new"), zero("fixed"), zero("still_open"))
