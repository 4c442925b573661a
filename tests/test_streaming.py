import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from auditspan import schema
from auditspan.sources import tree
from auditspan.streaming import control, events

T0 = dt.datetime(2024, 1, 1)


def event(scan, seq, type_, **k):
    return dict(scan_id=scan, seq=seq, ts=T0 + dt.timedelta(seconds=seq), type=type_, **k)


LOG = [event("a", 1, "stage", stage="ingest", state="running", total=3),
       event("a", 2, "token", text="he"), event("a", 3, "stage", stage="ingest", done=2),
       event("a", 4, "token", text="llo"), event("a", 5, "control", control="paused"),
       event("a", 6, "stage", stage="persist", state="done"),
       event("a", 7, "done", status="completed", tokens=9), event("a", 8, "log"),
       event("b", 1, "status", status="reviewing"), event("b", 2, "stage", stage="ingest")]


@pytest.fixture
def log(rows):
    return rows(schema.EVENT, *LOG)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode) \
        .trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [r.asDict() for r in df.sparkSession.table(name).collect()]


def as_stream(spark, log, tmp_path, parts=3):
    path = str(tmp_path / "log")
    for i in range(parts):  # files arrive in the order of the log
        part = (F.col("seq") - 1) / 3 >= i
        part = part & ((F.col("seq") - 1) / 3 < i + 1) if i < parts - 1 else part
        log.where(part).coalesce(1).write.mode("append").parquet(path)
    return tree.event_stream(spark, path, files_per_batch=1)


def test_batch_folds(log):
    board = {(r.scan_id, r.stage): (r.state, r.done, r.total)
             for r in events.stage_board(log).collect()}
    assert board == {("a", "ingest"): ("skipped", 2, 3), ("a", "persist"): ("done", None, None),
                     ("b", "ingest"): ("skipped", None, None)}
    live = {r.scan_id: (r.status, r.paused, r.tokens) for r in events.live_status(log).collect()}
    assert live == {"a": ("completed", False, 9), "b": ("reviewing", False, None)}
    words = events.narration(log.where("type = 'token'")).first().text
    assert words == "hello"
    assert events.until_terminal(log).where("scan_id = 'a'").count() == 7
    assert events.persisted(log).where("type = 'token'").count() == 0


def test_board_stream_equals_batch(spark, log, tmp_path):
    s = events.stage_board_stream(as_stream(spark, log, tmp_path))
    got = {(r["scan_id"], r["stage"]): r["state"] for r in run(s, "board", "complete")}
    want = {(r.scan_id, r.stage): r.state
            for r in events.stage_board(log, finished=False).collect()}
    assert got == want


def test_duplicates_dropped(spark, log, tmp_path):
    s = events.deduplicated(as_stream(spark, log.unionByName(log), tmp_path))
    assert len(run(s, "dedup")) == len(LOG)


def test_feed_stops_after_terminal_event(spark, log, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state."
                        "RocksDBStateStoreProvider")
    try:
        got = run(events.feed_stream(as_stream(spark, log, tmp_path)), "feed")
    finally:
        spark.conf.unset(key)
    want = {(r.scan_id, r.seq) for r in events.until_terminal(log).collect()}
    assert {(r["scan_id"], r["seq"]) for r in got} == want


def test_append_in_batches(spark, log, tmp_path):
    s = as_stream(spark, log, tmp_path)
    q = events.append_in_batches(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(LOG)


def test_control_only_tightens(rows):
    p = lambda seq, **k: dict(run_id="r", seq=seq, **k)
    spec = ("run_id string, seq long, status string, intercept string, allow_mutating boolean,"
            "max_rps double, exclude_paths array<string>, ceiling double")
    doc = control.control_state(rows(
        spec, p(1, status="running", ceiling=5.0), p(2, max_rps=20.0, ceiling=5.0),
        p(3, max_rps=1.0, ceiling=5.0), p(4, allow_mutating=False), p(5, allow_mutating=True),
        p(6, exclude_paths=["/a"]), p(7, exclude_paths=["/b", "/a"]), p(8, max_rps=-1.0),
        p(9, intercept="nonsense"))).first()
    assert (doc.max_rps, doc.allow_mutating, doc.exclude_paths, doc.intercept) == (
        1.0, False, ["/a", "/b"], "off")


def test_held_requests_batch_and_stream(spark, rows, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    h = rows("run_id string, seq long, held_at timestamp",
             *[dict(run_id="r", seq=i, held_at=at(i)) for i in range(4)],
             dict(run_id="r", seq=99, held_at=at(9000)))
    d = rows("run_id string, seq long, decided_at timestamp, verdict string",
             dict(run_id="r", seq=0, decided_at=at(10), verdict="allow"),
             dict(run_id="r", seq=1, decided_at=at(10), verdict="skip_rest"),
             dict(run_id="r", seq=2, decided_at=at(5000), verdict="allow"),
             dict(run_id="r", seq=98, decided_at=at(9000), verdict="allow"))
    got = {r.seq: (r.outcome, r.timed_out) for r in control.held_outcomes(h, d).collect()}
    assert got == {0: ("send", False), 1: ("skip", False), 2: ("skip", True), 3: ("skip", True),
                   99: ("skip", True)}
    hp, dp = str(tmp_path / "h"), str(tmp_path / "d")
    for df, path, col in ((h, hp, "held_at"), (d, dp, "decided_at")):
        df.repartitionByRange(2, F.col(col)).write.parquet(path)
    read = lambda df, p: spark.readStream.schema(df.schema).option(
        "maxFilesPerTrigger", 1).parquet(p)
    out = run(control.held_outcomes(read(h, hp), read(d, dp)), "held")
    # the last request waits for its watermark; everything before it is settled
    assert {r["seq"]: (r["outcome"], r["timed_out"]) for r in out if r["seq"] != 99} == {
        k: v for k, v in got.items() if k != 99}


def test_added_findings_of_a_review_meet_the_files_once(rows, monkeypatch):
    """Triaged hits, the second look and the access review are looked up in the code together."""
    from auditspan.operators import evidence
    from auditspan.plans.review import Answers, run_review
    from test_access import DEPOT
    calls, check = [], evidence.check_evidence
    monkeypatch.setattr(evidence, "check_evidence", lambda *a, **k: calls.append(1) or check(*a, **k))
    files = rows("artifact_id string, path string, content string", dict(artifact_id="a", path="api.py", content=DEPOT))
    found = rows("artifact_id string, finding_id string, title string, severity string, state string, confidence double, file_path string, "
                 "line_start int, code_snippet string, source string",
                 dict(artifact_id="a", finding_id="1", title="Open move", severity="high", state="proposed", confidence=0.6, file_path="api.py",
                      line_start=8, source="ai"))
    triage = rows("artifact_id string, hit_id string, verdict string, severity string, confidence string, reasoning string")
    second = found.withColumn("finding_id", F.lit("2"))
    done = run_review(files, found, answers=Answers(triage=triage, second_look=second))
    assert len(calls) == 2
    assert {r.evidence_status for r in done.findings.where("finding_id IN ('1', '2')").collect()} == {"location_only"}


def test_whole_review(rows):
    from auditspan.plans.review import Answers, hit_id, run_review
    from test_access import DEPOT
    files = rows("artifact_id string, path string, content string",
                 dict(artifact_id="a", path="api.py", content=DEPOT),
                 dict(artifact_id="a", path="cfg.py", content="token = 'abcdefgh123'\n"))
    layout = StructType([*schema.FINDING, StructField("artifact_id", StringType())])
    found = rows(layout, dict(
        artifact_id="a", finding_id="1", title="Open move", severity="high", state="proposed",
        confidence=0.6, file_path="api.py", line_start=8, source="ai",
        code_snippet='@router.put("/crates/{crate_id}/shelf")'),
        dict(artifact_id="a", finding_id="2", title="Ghost", severity="low", state="confirmed",
             confidence=0.6, file_path="zzz.py", line_start=8, source="ai"))
    r = run_review(files, found)
    state = {x.finding_id: (x.source, x.state) for x in r.findings.collect()}
    assert state["1"] == ("ai", "proposed") and state["2"] == ("ai", "dismissed")  # nobody was asked
    assert {x.unverified for x in r.findings.where("source = 'access'").collect()} == {True}
    assert [x.rule for x in r.unaddressed.collect()] == ["auth.hardcoded-generic-secret"]
    assert r.flags.where("rule = 'access.idor'").count() >= 1
    assert r.stored.where("source = 'semgrep'").count() == 1 and r.summary.first().dismissed == 1

    said = rows("artifact_id string, finding_id string, verdict string, confidence string, reasoning string, severity string, human_question string",
                dict(artifact_id="a", finding_id="1", verdict="true positive", confidence="0.8", severity="critical"))
    triage = r.unaddressed.select("artifact_id", hit_id().alias("hit_id"), F.lit("uncertain").alias("verdict"), F.lit("LOW").alias("severity"),
                                  F.lit("0.3").alias("confidence"), F.lit("odd").alias("reasoning"))
    judged = rows("artifact_id string, finding_id string, state string, confidence string, merged_into string",
                  dict(artifact_id="a", finding_id="2", merged_into="1"))
    told = r.endpoints.select("artifact_id", "endpoint_id", F.lit("required").alias("authn"), F.lit("ownership").alias("authz"),
                              F.lit("low").alias("risk"), F.lit(None).cast("string").alias("notes"))
    more = rows(layout, dict(
        artifact_id="a", finding_id="3", title="Second look", severity="medium", state="proposed", confidence=0.5, file_path="cfg.py",
        line_start=40, source="ai", code_snippet="token = 'abcdefgh123'"))
    full = run_review(files, found, answers=Answers(triage=triage, second_look=more, endpoints=told, judged=judged, verdicts=said))
    rows_ = {x.finding_id: x for x in full.findings.collect()}
    assert (rows_["1"].state, rows_["1"].severity, rows_["1"].severity_original) == ("confirmed", "critical", "high")
    assert rows_["2"].state == "dismissed" and rows_["2"].triage_note == "Merged into 1"
    hit = next(x for x in rows_.values() if x.source == "correlated")
    assert (hit.state, hit.severity, hit.confidence) == ("needs_info", "low", 0.3) and full.unaddressed.count() == 0
    assert rows_["3"].evidence_status == "relocated" and rows_["3"].line_start == 1
    left = {x.rule for x in rows_.values() if x.source == "access"}  # the map's verdicts answer the rest
    assert "access.idor" not in left and "access.missing-authn" not in left


def test_narration_pages(spark, rows):
    texts = ["one ", "", None, "a longer token 😀 ", "x" * 23, "end"]
    tokens = rows("scan_id string, seq long, text string", *[dict(scan_id="a", seq=k, text=t) for k, t in enumerate(texts * 4)],
                  dict(scan_id="b", seq=1, text=None))
    whole = "".join(t or "" for t in texts * 4)
    pages = events.narration_pages(tokens, page=10, block=3)
    got = {r.page_no: r.text for r in pages.collect()}
    assert [got[k] for k in range(len(got))] == [whole[k:k + 10] for k in range(0, len(whole), 10)]
    wanted = rows("scan_id string, first long, last long", dict(scan_id="a", first=7, last=41), dict(scan_id="a", first=0, last=5000))
    cut = {r.first: r.text for r in events.narration_slice(pages, wanted, page=10).collect()}
    assert cut == {7: whole[7:42], 0: whole}
