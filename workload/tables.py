"""Queries over stored tables: the event log with offsets, versions of findings, stored differences,
archives and narrations."""

import uuid

from pyspark.sql import functions as F

from auditspan import schema
from auditspan.operators import diff
from auditspan.operators.ordered import ensure_checkpoint_dir
from auditspan.sources import eventlog, tree
from auditspan.sources.versions import FindingTable
from auditspan.streaming import events as ev

from .base import VIEWS, query, table, view
from .findings import DIFF, findings, scans
from .live import feed


def folder(spark, name):
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("events_after", "SELECT CAST(scan_id AS VARCHAR) AS scan_id, seq, type, stage FROM v_feed WHERE seq > 20")
def events_after(spark, sf):
    """The whole log, stored in two appends and read again behind number 20 of each scan."""
    log, path = feed(spark, sf), folder(spark, "log")
    eventlog.append_events(log.where("seq <= 10"), path)
    eventlog.append_events(log.where("seq > 10"), path)
    return eventlog.events_after(spark, path, 20).select("scan_id", "seq", "type", "stage")


@query("versioned_findings", """
SELECT scan_id, finding_id, source FROM v_findings WHERE source IN ('semgrep', 'sonarqube') OR source IN ('ai', 'correlated') AND scan_id % 2 = 1
UNION ALL SELECT scan_id, concat(finding_id, '-n'), 'ai' FROM v_findings WHERE scan_id % 2 = 0 AND source = 'dast'
UNION ALL SELECT scan_id, finding_id, source FROM v_findings f WHERE scan_id % 2 = 0 AND source IN ('ai', 'correlated')
  AND NOT EXISTS (SELECT 1 FROM v_findings d WHERE d.scan_id = f.scan_id AND d.source = 'dast')""")
def versioned_findings(spark, sf):
    """Static findings, two batches of a run (one of them retried), and the final swap of every second scan."""
    rows = findings(spark, sf).select(F.col("scan_id").cast("string").alias("scan_id"), "finding_id", "source")
    store = FindingTable(spark, folder(spark, "findings"))
    store.append(rows.where("source IN ('semgrep', 'sonarqube')"))
    for source in ("ai", "correlated", "ai"):
        store.append(rows.where(F.col("source") == source), f"run/{source}")
    store.swap(rows.where("source = 'dast' AND cast(scan_id as bigint) % 2 = 0").select(
        "scan_id", F.concat("finding_id", F.lit("-n")).alias("finding_id"), F.lit("ai").alias("source")), ["ai", "correlated"])
    return store.read().select(F.col("scan_id").cast("long").alias("scan_id"), "finding_id", "source")


@query("stored_diff", DIFF.replace("WHERE b.baseline_id IS NOT NULL", "WHERE b.baseline_id IS NOT NULL AND s.scan_id % 2 = 0 AND b.baseline_id % 2 = 1")
       + " SELECT * FROM d")
def stored_diff(spark, sf):
    """Even scans against the stored representatives of odd ones."""
    f, name = findings(spark, sf), f"reps_{uuid.uuid4().hex}"
    diff.store_representatives(f.where("scan_id % 2 = 1"), name, folder(spark, "reps"), buckets=8)
    pairs = diff.baseline_scans(scans(spark, sf)).where("scan_id % 2 = 0 AND baseline_id % 2 = 1")
    return diff.stored_diff(f.where("scan_id % 2 = 0"), pairs, name).select(
        "scan_id", "fingerprint", "status", "finding_id", "severity", "severity_changed_from")


@query("stored_findings", """
SELECT CAST(scan_id AS VARCHAR) AS scan_id, finding_id, severity FROM v_findings WHERE severity = 'high'""")
def stored_findings(spark, sf):
    """The finding table read again by severity."""
    f, path = findings(spark, sf), folder(spark, "table")
    f.select(*[(F.col(x.name) if x.name in f.columns else F.lit(None)).cast(x.dataType).alias(x.name) for x in schema.FINDING]).write.parquet(path)
    return tree.findings_of(spark, path, severity="high").select("scan_id", "finding_id", "severity")


@query("frozen_inputs", "SELECT doc_id, path FROM v_files WHERE doc_id % 2 = 0")
def frozen_inputs(spark, sf):
    """Inputs frozen for a run that may be resumed."""
    return tree.snapshot(view(spark, sf, "v_files").where("doc_id % 2 = 0").select("doc_id", "path"), folder(spark, "inputs"))


VIEWS["v_packed_files"] = """
SELECT doc_id, concat('in/f', doc_id, CASE doc_id % 5 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.zipper' END) AS path,
  CASE doc_id % 7 WHEN 0 THEN 'PK' WHEN 1 THEN '7z' ELSE 'no' END AS head, text FROM @documents"""


@query("archives", "SELECT doc_id, path FROM v_packed_files WHERE doc_id % 5 < 2 OR head <> 'no'")
def archives(spark, sf):
    """Archives by name or by their first bytes, in front of every whole text."""
    rows = view(spark, sf, "v_packed_files")
    magic = F.when(F.col("head") == "PK", F.unhex(F.lit("504B0304"))).when(F.col("head") == "7z", F.unhex(F.lit("377ABCAF271C"))).otherwise(F.unhex(F.lit("")))
    return tree.archives(rows.withColumn("content", F.concat(magic, F.col("text").cast("binary")))).select("doc_id", "path")


_NARRATION = "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole FROM conversations WHERE text <> '' GROUP BY 1"


@query("narration_pages", f"""
WITH w AS ({_NARRATION}) SELECT conv_id AS scan_id, unnest(range(0, CAST(ceil(length(whole) / 100.0) AS BIGINT))) AS page_no,
  unnest(list_transform(range(0, CAST(ceil(length(whole) / 100.0) AS BIGINT)), lambda p: substring(whole, p * 100 + 1, 100))) AS text FROM w""")
def narration_pages(spark, sf):
    return ev.narration_pages(_turns(spark, sf), page=100, block=2)


@query("narration_slices", f"""
WITH w AS ({_NARRATION}) SELECT conv_id AS scan_id, CAST(conv_id % 90 AS BIGINT) AS first, CAST(conv_id % 90 + 150 AS BIGINT) AS last,
  substring(whole, conv_id % 90 + 1, 151) AS text FROM w WHERE length(whole) > conv_id % 90""")
def narration_slices(spark, sf):
    """A slice of every narration out of its pages."""
    pages = ev.narration_pages(_turns(spark, sf), page=100, block=2)
    k = F.col("scan_id") % 90
    wanted = _turns(spark, sf).select("scan_id").distinct().select("scan_id", k.cast("long").alias("first"), (k + 150).cast("long").alias("last"))
    return ev.narration_slice(pages, wanted, page=100).where("text <> ''")


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("scan_id"), F.col("turn").alias("seq"), "text")
