"""Event log with offsets, documents in few files, versions of a finding table, stored diffs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from auditspan import schema
from auditspan.operators import diff
from auditspan.sources import documents, eventlog, sinks
from auditspan.sources.versions import FindingTable, VersionConflict

T0 = dt.datetime(2024, 1, 1)


def log_rows(spark, scan, numbers):
    return spark.createDataFrame([(scan, n, T0 + dt.timedelta(seconds=n), "log", f"t{n}") for n in numbers],
                                 "scan_id string, seq long, ts timestamp, type string, text string")


def seqs(rows):
    return sorted((r.scan_id, r.seq, r.text, r.ts) for r in rows)


def test_events_after(spark, tmp_path):
    path = str(tmp_path / "log")
    assert eventlog.events_after(spark, path).count() == 0
    eventlog.append_events(log_rows(spark, "a", range(1, 40)).unionByName(log_rows(spark, "b", range(1, 9))), path, slots=3)
    eventlog.append_events(log_rows(spark, "a", range(40, 50)), path, slots=3)
    spark.dataSource.register(eventlog.EventLog)
    read = lambda **o: spark.read.format(eventlog.FORMAT).options(path=path, slots=3, **o).load()
    assert seqs(read(after=30).collect()) == [("a", n, f"t{n}", T0 + dt.timedelta(seconds=n)) for n in range(31, 50)]
    assert [r.seq for r in read(scan_id="b", after=5).orderBy("seq").collect()] == [6, 7, 8]
    assert read().count() == 57 and read(scan_id="nobody").count() == 0


def follow(spark, path, checkpoint, out, after):
    spark.dataSource.register(eventlog.EventLog)
    stream = spark.readStream.format(eventlog.FORMAT).options(path=path, scan_id="a", after=after, slots=3, rows_per_task=4).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    assert query.exception() is None
    return [r.seq for r in spark.read.schema(schema.EVENT).parquet(out).orderBy("seq").collect()]


def test_stream_goes_on_at_its_checkpoint(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / n) for n in ("log", "checkpoint", "out"))
    eventlog.append_events(log_rows(spark, "a", range(1, 21)).unionByName(log_rows(spark, "b", range(1, 5))), path, slots=3)
    assert follow(spark, path, checkpoint, out, 7) == list(range(8, 21))
    assert follow(spark, path, checkpoint, out, 7) == list(range(8, 21))  # nothing new, nothing twice
    eventlog.append_events(log_rows(spark, "a", range(21, 33)), path, slots=3)
    assert follow(spark, path, checkpoint, out, 0) == list(range(8, 33))  # the checkpoint decides, not the option
    with pytest.raises(Exception, match="scan_id"):
        spark.readStream.format(eventlog.FORMAT).options(path=path).load().writeStream.format("noop").start().awaitTermination(60)


# ---- documents -------------------------------------------------------------------------------
FOUND = "scan_id string, finding_id string, title string, description string, severity string, confidence double, state string, source string, cwe string, file_path string, line_start int, line_end int"


def test_documents_in_few_files(spark, rows, tmp_path):
    found = rows(FOUND, *[dict(scan_id=f"s{k % 25:02}", finding_id=f"f{k:03}", title=f'T"{k % 3}', severity="high", confidence=0.5, state="proposed",
                               source="ai", cwe=f"CWE-{k % 4}", file_path="é.py", line_start=k) for k in range(200)])
    path = str(tmp_path / "docs")
    documents.write_documents(sinks.sarif_fragments(found), path, partitions=4)
    index = documents.document_index(spark, path)
    assert len({r.file for r in index.collect()}) <= 4 and index.select("document").distinct().count() == 25
    texts = {}
    for r in sorted(documents.read_documents(index, path).collect(), key=lambda r: (r.document, r.part)):
        texts[r.document] = texts.get(r.document, "") + r.text
    assert len(texts) == 25
    for scan, text in texts.items():
        run = json.loads(text)["runs"][0]
        assert len(run["results"]) == 8
        ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert [ids[r["ruleIndex"]] for r in run["results"]] == [r["ruleId"] for r in run["results"]]
    some = documents.read_documents(index.where("document = 's03'"), path)
    assert "".join(r.text for r in some.orderBy("part").collect()) == texts["s03"]


def test_failed_job_leaves_no_document(spark, tmp_path):
    path = str(tmp_path / "docs")
    good = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "scan_id string, ord int, text string")
    documents.write_documents(good, path)
    bad = spark.range(40).select(F.lit("b").alias("scan_id"), F.col("id").alias("ord"), F.when(
        F.col("id") == 30, F.raise_error(F.lit("torn"))).otherwise("z").alias("text"))
    with pytest.raises(Exception, match="torn"):
        documents.write_documents(bad, path)
    index = documents.document_index(spark, path)
    assert {r.document for r in index.collect()} == {"a"}
    assert documents.read_documents(index, path).first().text == "xy"
    assert documents.document_index(spark, str(tmp_path / "none")).count() == 0


# ---- versions ----------------------------------------------------------------------------------
def found(spark, *rows):
    return spark.createDataFrame(list(rows), "scan_id string, source string, finding_id string")


def ids(df):
    return sorted(r.finding_id for r in df.collect())


def test_versions_of_a_finding_table(spark, tmp_path):
    table = FindingTable(spark, str(tmp_path / "findings"))
    assert table.version() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(found(spark, ("1", "semgrep", "s1"), ("1", "ai", "a1"), ("2", "ai", "a2")), "run/0")
    table.append(found(spark, ("1", "ai", "a3")), "run/1")
    table.append(found(spark, ("1", "ai", "again")), "run/1")  # a retried batch counts once
    assert ids(table.read()) == ["a1", "a2", "a3", "s1"] and table.version() == 2
    table.swap(found(spark, ("1", "ai", "final")), ["ai", "access"])
    assert ids(table.read()) == ["a2", "final", "s1"] and ids(table.read(2)) == ["a1", "a2", "a3", "s1"]
    table.swap(found(spark), ["ai"], spark.createDataFrame([("2",)], "scan_id string"))  # a run that found nothing
    assert ids(table.read()) == ["final", "s1"]
    table.append(found(spark, ("2", "ai", "later")))
    table.compact()
    assert ids(table.read()) == ["final", "later", "s1"] and len(table.manifest()["rows"]) == 1
    table.append(found(spark, ("3", "ai", "new")))
    assert ids(table.read()) == ["final", "later", "new", "s1"]


def test_failed_swap_keeps_the_old_version(spark, tmp_path, monkeypatch):
    table = FindingTable(spark, str(tmp_path / "findings"))
    table.append(found(spark, ("1", "ai", "a1")))
    torn = found(spark, ("1", "ai", "x")).withColumn("finding_id", F.raise_error(F.lit("torn")).cast("string"))
    with pytest.raises(Exception, match="torn"):
        table.swap(torn, ["ai"])
    assert ids(table.read()) == ["a1"] and table.version() == 1
    # another writer publishes first: the swap goes on top of it
    real, once = table._publish, []

    def slower(version, manifest):
        if not once:
            once.append(1)
            FindingTable(spark, str(tmp_path / "findings")).append(found(spark, ("2", "ai", "b1")))
        real(version, manifest)
    monkeypatch.setattr(table, "_publish", slower)
    table.swap(found(spark, ("1", "ai", "a2")), ["ai"])
    assert ids(table.read()) == ["a2", "b1"] and table.version() == 3
    monkeypatch.setattr(table, "_publish", lambda *_: (_ for _ in ()).throw(VersionConflict("held")))
    with pytest.raises(VersionConflict):
        table.append(found(spark, ("9", "ai", "z")))


def test_stream_into_versions(spark, tmp_path):
    table = FindingTable(spark, str(tmp_path / "findings"))
    source = str(tmp_path / "in")
    for k in range(3):
        found(spark, ("1", "ai", f"a{k}")).coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema("scan_id string, source string, finding_id string").option("maxFilesPerTrigger", 1).parquet(source)
    table.append_stream(read, str(tmp_path / "cp")).awaitTermination(120)
    assert ids(table.read()) == ["a0", "a1", "a2"]
    table.append_stream(read, str(tmp_path / "cp")).awaitTermination(120)
    table.swap(found(spark, ("1", "ai", "final")), ["ai"])
    assert ids(table.read()) == ["final"]


# ---- stored diffs ---------------------------------------------------------------------------------
DIFF = "scan_id long, finding_id string, title string, severity string, state string, source string, cwe string, file_path string, line_start int, endpoint string, rule string, category string"


def test_stored_diff(spark, rows, tmp_path):
    f = lambda scan, i, cwe, path, severity="low", state="proposed": dict(
        scan_id=scan, finding_id=f"{scan}-{i}", title="t", severity=severity, state=state, source="ai", cwe=cwe, file_path=path)
    old = rows(DIFF, f(1, 0, "CWE-1", "a"), f(1, 1, "CWE-1", "a", "high"), f(1, 2, "CWE-2", "b"), f(1, 3, "CWE-9", "x", state="dismissed"), f(5, 0, "CWE-5", "e"))
    new = rows(DIFF, f(2, 0, "CWE-1", "a"), f(2, 1, "CWE-3", "c"), f(3, 0, "CWE-2", "b"), f(4, 0, "CWE-4", "d"))
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 7)], "scan_id long, baseline_id long")
    diff.store_representatives(old, "kept_reps", str(tmp_path / "reps"), buckets=4)
    try:
        stored = diff.stored_diff(new, pairs, "kept_reps")
        want = diff.scan_diff(old.unionByName(new), pairs)
        assert sorted(map(str, stored.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        plan = stored._jdf.queryExecution().executedPlan().toString()
        scan = next(k for k, line in enumerate(plan.splitlines()) if "kept_reps" in line and "FileScan" in line)
        lines, depth = plan.splitlines()[:scan + 1], None
        above = []  # the operators between the stored table and the join
        for line in reversed(lines):
            indent = len(line) - len(line.lstrip(" :+-"))
            if depth is None or indent < depth:
                above.append(line)
                depth = indent
            if "SortMergeJoin" in line and "FullOuter" in line:
                break
        assert "FullOuter" in above[-1] and not any("Exchange" in line for line in above)
    finally:
        spark.sql("DROP TABLE kept_reps")
