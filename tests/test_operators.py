import datetime
import json
import random
import re

from pyspark.sql import functions as F

from auditspan.functions import labels
from auditspan.operators import (corpus, diff, evidence, lifecycle, matching, ordered, packing,
                                 responses, rollups, verdicts)
from auditspan.sources import results, rules, sinks

LEDGER = ("import pickle\n\nclass Ledger:\n    def restore(self, blob):\n"
          "        rows = pickle.loads(blob)\n        self.rows = rows\n        return len(rows)\n\n"
          "    def total(self):\n        return eval(self.formula)\n")
FETCH = "import requests\n\n\ndef mirror(url, target):\n    got = requests.get(url, verify=False)\n    target.write(got.content)\n"
FILE = "artifact_id string, path string, content string"
CITED = ("artifact_id string, finding_id string, title string, file_path string,"
         "line_start int, line_end int, state string, confidence double,"
         "code_snippet string, triage_note string")


def code_files(rows):
    return rows(FILE, *[dict(artifact_id="a", path=p, content=c) for p, c in
                        (("books/ledger.py", LEDGER), ("net/fetch.py", FETCH), ("tests/test_ledger.py", LEDGER))])


# ---- evidence ------------------------------------------------------------------------
def test_evidence(rows):
    mk = lambda i, **k: dict(artifact_id="a", finding_id=str(i), **k)
    found = rows(
        CITED,
        mk(1, file_path="net/fetch.py", line_start=5, state="confirmed",
           code_snippet="got = requests.get(url, verify=False)"),
        mk(2, file_path="books/ledger.py", line_start=200, state="confirmed",
           code_snippet="return eval(self.formula)"),
        mk(3, file_path="books/gone.py", line_start=8, state="confirmed", confidence=0.6),
        mk(4, file_path="net/fetch.py", line_start=2, state="confirmed", confidence=0.9,
           code_snippet="os.chmod(target_folder, 0o777)"),
        mk(5, file_path="service/net/fetch.py", line_start=6,
           code_snippet="target.write(got.content)"),
        mk(6, code_snippet="rows = pickle.loads(blob)"),
        mk(7, file_path="books/ledger.py", line_start=31, state="confirmed"),
        mk(8, file_path="net/fetch.py", line_start=4))
    got = {r.finding_id: r for r in evidence.check_evidence(found, code_files(rows)).collect()}
    assert [got[str(i)].evidence_status for i in range(1, 9)] == [
        "verified", "relocated", "file_missing", "snippet_mismatch", "verified", "no_location",
        "line_out_of_range", "location_only"]
    assert got["2"].line_start == 10 and got["2"].evidence_note == "Cited line 200 corrected to 10"
    assert got["3"].state == "dismissed" and got["4"].confidence == 0.5
    assert got["5"].file_path == "net/fetch.py"
    assert got["7"].state == "proposed" and got["7"].confidence == 0.25


def test_citations_take_one_candidate_only(rows):
    known = rows("artifact_id string, path string", *[
        dict(artifact_id="a", path=p) for p in
        ("core/log.py", "web/log.py", "core/only.py", "core/only.py", "deep/web/form.py")],
        dict(artifact_id="b", path="core/other.py"))
    want = {"core/log.py": "core/log.py", "log.py": None, "x/web/log.py": "web/log.py",
            "web/form.py": "deep/web/form.py", "elsewhere/only.py": "core/only.py",
            "core/other.py": None}
    cited = rows("artifact_id string, file_path string", dict(artifact_id="a"), *[
        dict(artifact_id="a", file_path=p) for p in [*want, "log.py"]])
    got = evidence.resolve_citations(cited, known).collect()
    assert {r.file_path: r.resolved for r in got} == want and len(got) == len(want)


def test_same_snippet_in_findings_of_one_file(rows):
    mk = lambda i, **k: dict(artifact_id="a", finding_id=str(i), state="proposed", **k)
    code = "got = requests.get(url, verify=False)"
    found = rows(CITED, mk(1, file_path="net/fetch.py", line_start=5, code_snippet=code),
                 mk(2, file_path="net/fetch.py", line_start=5, code_snippet=code),
                 mk(3, file_path="fetch.py", line_start=900, code_snippet=code),
                 mk(4, file_path="net/fetch.py", line_start=4, code_snippet=""))
    got = {r.finding_id: r for r in evidence.check_evidence(found, code_files(rows)).collect()}
    assert [got[str(i)].evidence_status for i in range(1, 5)] == [
        "verified", "verified", "relocated", "location_only"]
    assert got["3"].file_path == "net/fetch.py"


def test_lines_of_matches_over_several_lines(rows):
    pattern = r"(?s)begin\s*\{.*?end|\bx\s*=\s*\n\s*y"
    texts = ["", "begin {\n a\nend x =\n y\nbegin{end", "no", "$0 \\ begin {end",
             "x = \n\n y\r\nq\uffff begin {\uffff\n\nend\nbegin { end begin {end\n"]
    found = rows("t string", *[dict(t=t) for t in texts]).select(
        "t", corpus._match_lines(F.col("t"), pattern).alias("n")).collect()
    assert {r.t: r.n for r in found} == {
        t: [t.count("\n", 0, m.start()) + 1 for m in re.finditer(pattern, t)] for t in texts}


def test_path_repair(rows):
    known = rows("artifact_id string, path string", dict(artifact_id="a", path="proj/src/a.py"))
    cited = rows("artifact_id string, file_path string", *[
        dict(artifact_id="a", file_path=p) for p in
        ("proj/src/a.py", "../../../app/proj/src/a.py", "../../etc/passwd")])
    got = {r.file_path: r.repaired
           for r in evidence.repair_stored_paths(cited, known).collect()}
    assert list(got.values()).count("proj/src/a.py") == 2 and got["../../etc/passwd"] is None


# ---- diff ------------------------------------------------------------------------------
FINDING = ("scan_id string, finding_id string, title string, severity string, state string,"
           "source string, cwe string, rule string, category string, file_path string,"
           "line_start int, endpoint string")


def test_diff(rows):
    mk = lambda s, i, sev, cwe, path, state="proposed": dict(
        scan_id=s, finding_id=f"{s}{i}", severity=sev, cwe=cwe, file_path=path, state=state,
        title="t")
    found = rows(FINDING, mk("old", 1, "low", "CWE-22", "files/read.go"),
                 mk("old", 2, "high", "CWE-611: entities", "xml/load.go"),
                 mk("old", 3, "medium", "CWE-916", "auth/hash.go"),
                 mk("new", 1, "medium", "CWE-22: traversal", "files/read.go"),
                 mk("new", 2, "medium", "CWE-916", "auth/hash.go"),
                 mk("new", 3, "low", "CWE-601", "web/jump.go"),
                 mk("new", 4, "info", "CWE-1004", "web/jar.go"),
                 mk("new", 5, "high", "CWE-502", "io/unpack.go", "dismissed"))
    scans = rows("scan_id string, project_id string, created_at timestamp", *[
        dict(scan_id=s, project_id="p", created_at=datetime.datetime(2025, m, 9))
        for s, m in (("old", 2), ("new", 3))])
    pairs = diff.baseline_scans(scans)
    changes = diff.scan_diff(found, pairs)
    n = diff.diff_counts(changes, pairs).collect()
    assert [(r.scan_id, r.new, r.fixed, r.still_open) for r in n] == [("new", 2, 1, 2)]
    moved = {r.finding_id: r.severity_changed_from
             for r in changes.where("status = 'still_open'").collect()}
    assert moved == {"new1": "low", "new2": None}
    same = diff.scan_diff(found, rows("scan_id string, baseline_id string",
                                      dict(scan_id="old", baseline_id="old")))
    assert {r.status for r in same.collect()} == {"still_open"}


# ---- matching ----------------------------------------------------------------------------
def test_agreement_and_unaddressed(rows):
    spec = ("scan_id string, finding_id string, title string, cwe string, category string,"
            "file_path string, line_start int, reviewed_by string")
    mk = lambda i, t, cwe, line, who: dict(
        scan_id="s", finding_id=i, title=t, cwe=cwe, file_path="cart/price.rb", line_start=line,
        reviewed_by=who)
    found = rows(spec, mk("p", "Rounding lets totals drop", "CWE-682", 71, "north"),
                 mk("q", "Negative totals accepted", "CWE-682: arithmetic", 74, "south"),
                 mk("r", "Totals rounding", None, 73, "west"),
                 mk("t", "Log forging", "CWE-117", 72, "north"),
                 mk("u", "Rounding lets totals drop", "CWE-682", 120, "south"))
    got = {r.finding_id: r.agreement
           for r in matching.reviewer_agreement(found, 3).collect()}
    assert got == {"p": 3, "q": 3, "r": 3, "t": 1, "u": 1}
    hits = rows("scan_id string, file_path string, line_start int",
                dict(scan_id="s", file_path="cart/price.rb", line_start=118),
                dict(scan_id="s", file_path="cart/price.rb", line_start=95),
                dict(scan_id="s", file_path="cart/tax.rb"),
                dict(scan_id="s", file_path="cart/price.rb"))
    left = {(r.file_path, r.line_start) for r in matching.unaddressed_hits(hits, found).collect()}
    assert left == {("cart/price.rb", 95), ("cart/tax.rb", None)}


def test_agreement_brute_force(rows, spark):
    rnd = random.Random(3)
    data = [dict(scan_id="s", finding_id=str(i), title=rnd.choice(["open port found", "weak hash",
                                                                   "open redirect", None]),
                 cwe=rnd.choice([None, "CWE-1: a", "CWE-1", "CWE-2"]),
                 category=rnd.choice([None, "", "net", "web"]),
                 file_path=rnd.choice(["a", "b"]), line_start=rnd.choice([None, *range(1, 30)]),
                 reviewed_by=rnd.choice([None, "r1", "r2", "r3"])) for i in range(150)]
    spec = ("scan_id string, finding_id string, title string, cwe string, category string,"
            "file_path string, line_start int, reviewed_by string")
    got = {r.finding_id: r.agreement
           for r in matching.reviewer_agreement(rows(spec, *data), 3).collect()}

    def same(a, b):
        la, lb = a["line_start"], b["line_start"]
        if la is not None and lb is not None and abs(la - lb) > 3:
            return False
        if a["cwe"] and b["cwe"]:
            return a["cwe"].split(":")[0] == b["cwe"].split(":")[0]
        words = lambda x: {w for w in (x["title"] or "").split() if len(w) > 3}
        return bool(words(a) & words(b)) or bool(a["category"]) and a["category"] == b["category"]

    for a in data:
        who = {b["reviewed_by"] for b in data if b["file_path"] == a["file_path"]
               and (a is b or same(a, b))} - {None}
        assert got[a["finding_id"]] == max(1, len(who)), a


# ---- ordered helpers ---------------------------------------------------------------------
def test_ordered_helpers_brute_force(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", i, rnd.randrange(9))
            for i in rnd.sample(range(3000), 900)]
    df = spark.createDataFrame(data, "k string, o int, v int").repartition(7)
    want = {}
    for k in {d[0] for d in data}:
        total = 0
        for n, (_, o, v) in enumerate(sorted(d for d in data if d[0] == k)):
            total += v
            want[o] = (n, total)
    block = F.floor(F.col("o") / 100)
    got = ordered.running_totals(df, ["k"], [F.col("o")], block, n=F.lit(1), t=F.col("v"))
    assert {r.o: (r.n - 1, r.t) for r in got.collect()} == want
    pos = ordered.ordered_position(df, ["k"], ["o"])
    assert {r.o: r.pos for r in pos.collect()} == {o: n for o, (n, _) in want.items()}
    top = ordered.top_n(df, ["k"], [F.desc("o")], 3)
    assert {(r.k, r.o) for r in top.collect()} == {
        (k, o) for k in {d[0] for d in data}
        for o in sorted((d[1] for d in data if d[0] == k), reverse=True)[:3]}
    prev = ordered.previous_value(df, ["k"], ["o"], block, F.col("o"), "p")
    for r in prev.collect():
        before = [d[1] for d in data if d[0] == r.k and d[1] < r.o]
        assert r.p == (max(before) if before else None)


# ---- packing -----------------------------------------------------------------------------
def test_pack_batches_across_blocks(spark):
    rnd = random.Random(11)
    data = [("a" if i < 700 else "b", f"p{i:05d}", rnd.choice([0, 1, 5, 30, 70, 140]))
            for i in range(900)]
    df = spark.createDataFrame(data, "artifact_id string, path string, tokens long")
    for block in (16, 1000):
        got = {r.path: r.batch for r in packing.pack_batches(df, 100, block=block).collect()}
        for art in "ab":
            batch, used, started = 0, 0, False
            for _, path, tokens in sorted(d for d in data if d[0] == art):
                if started and used + tokens > 100:
                    batch, used = batch + 1, 0
                used, started = used + tokens, True
                assert got[path] == batch, (block, path)


def test_endpoint_batches_across_blocks(spark):
    rnd = random.Random(2)
    data = [("a", f"e{i:04d}", f"f{i // rnd.choice([5, 9]):03d}", i) for i in range(400)]
    df = spark.createDataFrame(data, "artifact_id string, endpoint_id string, file_path string,"
                                     "line int").withColumn("handler_file", F.col("file_path"))
    want, batch, size, last = {}, 0, 0, None
    for _, eid, f, line in sorted(data, key=lambda d: (d[2], d[3])):
        if size and (size >= 12 or (size >= 6 and f != last)):
            batch, size = batch + 1, 0
        size, last = size + 1, f
        want[eid] = batch
    for block in (7, 5000):
        got = packing.endpoint_batches(df, per=12, block=block).collect()
        assert {r.endpoint_id: r.batch for r in got} == want


def test_split_modes(spark, rows):
    m = spark.createDataFrame([("maximum context length", 0, 3), ("context window", 1, 1),
                               ("context window", 4, 3), ("no parseable JSON", 1, 2),
                               ("no parseable JSON", 1, 1), ("boom", 0, 9)],
                              "m string, d int, n int")
    got = [r.x for r in m.select(packing.split_mode(F.col("m"), F.col("d"), F.col("n"))
                                 .alias("x")).collect()]
    assert got == ["file", "slice", "", "file", "", ""]


# ---- rules and symbols ---------------------------------------------------------------------
def test_rule_pack(spark, rows):
    pack = rules.built_in_rules()
    assert len(pack) == 103 and len({r.category for r in pack}) >= 12
    assert len(rules.executable(pack)) == 14
    assert rules.rules_frame(spark, pack).count() == 103
    yaml = "env:\n  - name: KEY\n    valueFrom:\n      secretKeyRef:\n"
    files = rows(FILE, dict(artifact_id="a", path="k.yml", content="x\n" + yaml + "y\n" + yaml),
                 dict(artifact_id="a", path="m.py", content="token = 'abcdefgh123'\n"))
    got = {(r.path, r.line_no, r.rule)
           for r in corpus.rule_hits(files, rules.executable(pack)).collect()}
    assert got == {("k.yml", 2, "cloud.k8s-secret-env-var"),
                   ("k.yml", 7, "cloud.k8s-secret-env-var"),
                   ("m.py", 1, "auth.hardcoded-generic-secret")}


def test_sinks_and_callers(rows):
    files = code_files(rows).unionByName(rows(FILE, dict(
        artifact_id="a", path="nightly.py",
        content="from books import ledger\n\n\ndef reload_all(box, blobs):\n"
                "    for blob in blobs:\n        box.restore(blob)\n")))
    scores = {r.path: r.score for r in corpus.sink_scores(corpus.sink_lines(files)).collect()}
    assert scores == {"books/ledger.py": 6, "net/fetch.py": 1}  # two code runs, one request
    spots = rows("artifact_id string, file_path string, line_start int",
                 dict(artifact_id="a", file_path="books/ledger.py", line_start=6))
    sym = corpus.enclosing_symbols(spots, files)
    assert sym.first().symbol == "restore"
    site = corpus.call_sites(files, sym).first()
    assert (site.path, site.line_no) == ("nightly.py", 6) and "for blob in blobs" in site.context


# ---- responses -------------------------------------------------------------------------------
RESP = ("finding_id string, kind string, role string, owner string, target string,"
        "baseline boolean, status int, body_hash string, error string")


def test_response_verdicts(rows):
    r = lambda fid, kind, status, **k: dict(
        finding_id=fid, kind=kind, status=status, baseline=k.pop("baseline", False), **k)
    got = {x.finding_id: x.verdict for x in responses.response_verdicts(rows(
        RESP, r("a", "missing_authn", 200), r("b", "missing_authn", 403),
        r("c", "missing_authn", 200, error="x"), r("d", "idor", 403, owner="B", target="u"),
        r("e", "idor", 200, owner="B", target="u", body_hash="h"),
        r("e", "idor", 200, owner="B", target="u", body_hash="h", baseline=True),
        r("f", "idor", 200, owner="B", target="u", body_hash="h"),
        r("f", "idor", 200, owner="B", target="u", body_hash="g", baseline=True),
        r("g", "bfla", 403), r("g", "bfla", 204), r("h", "bfla", 401), r("i", "bfla", 302))
    ).collect()}
    assert got == {"a": "confirmed_vuln", "b": "enforced", "c": "inconclusive", "d": "enforced",
                   "e": "confirmed_vuln", "f": "inconclusive", "g": "confirmed_vuln",
                   "h": "enforced", "i": "inconclusive"}


def test_seeds_do_not_cross(rows):
    s = rows("run_id int, layer string, role string, collection string, param string,"
             "ids array<string>",
             dict(run_id=1, layer="harvested", role="B", collection="/users", param="id", ids=["101"]),
             dict(run_id=1, layer="harvested", role="B", collection="/orders", param="id", ids=["9"]),
             dict(run_id=1, layer="operator", role="B", param="id", ids=["fallback"]),
             dict(run_id=1, layer="pinned", role="B", collection="/pins", param="id", ids=["pin"]),
             dict(run_id=1, layer="harvested", role="B", collection="/pins", param="id", ids=["no"]))
    t = rows("run_id int, collection string", *[dict(run_id=1, collection=c) for c in
                                                ("/users", "/orders", "/invoices", "/pins")])
    got = {r.collection: r.ids[0] for r in responses.resolve_seeds(s, t).collect()}
    assert got == {"/users": "101", "/orders": "9", "/invoices": "fallback", "/pins": "pin"}


def test_harvested_ids(rows):
    body = json.dumps({"items": [{"id": 1, "name": "x"}, {"id": 2, "deep": {"orderId": "o7"}}],
                       "uuid": "u", "flag_id": True, "price_id": 1.5, "long_id": 10 ** 20, "whole_id": 2.0})
    got = responses.harvested_ids(rows(
        "run_id int, role string, collection string, body string",
        dict(run_id=1, role="r", collection="/c", body=body),
        dict(run_id=1, role="r", collection="/d", body="not json"))).collect()
    assert {r.id for r in got} == {"1", "2", "o7", "u", "True", "1" + "0" * 20}


def test_modes(rows):
    spec = ("target_id int, auto_run boolean, auto_run_active boolean, require_approval boolean,"
            "allowed_checks array<string>")
    got = {r.target_id: r for r in responses.normalize_modes(rows(
        spec, dict(target_id=1), dict(target_id=2, allowed_checks=["active_scan", "bogus"],
                                      auto_run=True),
        dict(target_id=3, allowed_checks=[]))).collect()}
    assert got[1].allowed_checks == ["access_control"] and got[1].auto_run is False
    assert got[2].allowed_checks == ["active_scan"] and got[2].auto_run
    assert got[3].allowed_checks == ["access_control"]


# ---- tables --------------------------------------------------------------------------------------
def test_replace_sources_keeps_other_scans(rows):
    spec = "scan_id string, finding_id string, source string"
    old = rows(spec, *[dict(scan_id=s, finding_id=f"{s}{src}", source=src)
                       for s in ("s1", "s2") for src in ("semgrep", "ai")])
    new = rows(spec, dict(scan_id="s1", finding_id="fresh", source="ai"))
    got = {r.finding_id for r in lifecycle.replace_sources(old, new, ["ai", "access"]).collect()}
    assert got == {"s1semgrep", "fresh", "s2semgrep", "s2ai"}


def test_normalisation(rows):
    spec = ("finding_id string, title string, description string, severity string, state string,"
            "source string, confidence string, file_path string, line_start string,"
            "line_end string, triaged_by string")
    got = verdicts.normalize_findings(rows(
        spec, dict(finding_id="1", title="x" * 400, severity="HIGH", state="Confirmed",
                   confidence="7", source="martian", line_start="42"),
        dict(finding_id="2")), "m").collect()
    assert len(got) == 1 and len(got[0].title) == 300 and got[0].severity == "high"
    assert got[0].state == "proposed" and got[0].confidence == 0.4
    assert got[0].source == "ai" and got[0].line_start == 42
    assert got[0].triaged_by == "judge:m"


# ---- documents ---------------------------------------------------------------------------------------
def test_sast_document(rows):
    doc = {"results": [{"check_id": "r.x", "path": "proj/ci.yml", "start": {"line": 5},
                        "end": {"line": 5}, "extra": {
                            "lines": "requires login\n", "message": "m", "severity": "WARNING",
                            "metadata": {"cwe": ["CWE-9", "CWE-10"]}}},
                       {"check_id": "r.y", "path": "./a.py", "start": {"line": 1},
                        "extra": {"severity": "INFO"}}]}
    docs = rows("scan_id string, json string", dict(scan_id="s", json=json.dumps(doc)))
    files = rows("scan_id string, path string, content string", dict(
        scan_id="s", path="proj/ci.yml", content="on: push\njobs:\n  b:\n    steps:\n"
                                                 "      - uses: actions/checkout@v4\n"))
    got = results.with_context(results.sast_candidates(docs), files).collect()
    assert len(got) == 1 and got[0].cwe == "CWE-9" and got[0].severity == "medium"
    assert got[0].code_snippet.splitlines()[-1] == "    5 |       - uses: actions/checkout@v4"
    assert results.sast_candidates(docs, floor="INFO").count() == 2


def test_dynamic_issue(rows):
    doc = {"content": [{"json": {"issues": [{
        "name": "SQL injection", "severity": "High", "confidence": "Certain",
        "url": "http://app.test/x", "issue_detail": "<p>tainted &amp; bad</p>",
        "cwe": ["CWE-89"], "evidence": " ", "proof": "GET /x"}]}}]}
    r = results.dynamic_findings(rows("scan_id string, json string", dict(
        scan_id="s", json=json.dumps(doc)))).first()
    assert (r.severity, r.cwe, r.confidence, r.description, r.code_snippet) == (
        "high", "CWE-89", 0.95, "tainted & bad", "GET /x")


def _document(fragments, tmp_path, name):
    out = str(tmp_path / name)
    sinks.write_fragments(fragments, out)
    import glob
    text = "".join(open(f).read() for f in sorted(glob.glob(out + "/scan_id=s/*.txt")))
    return json.loads(text)


def test_sarif_document(rows, tmp_path):
    spec = FINDING + ", description string, remediation string, confidence double, line_end int"
    mk = lambda i, **k: dict(scan_id="s", finding_id=f"f{i}", title="Bad \"thing\"\n",
                             severity="high", state="proposed", source="ai", confidence=0.5, **k)
    doc = _document(sinks.sarif_fragments(rows(
        spec, mk(1, cwe="CWE-1", file_path="a.py", line_start=3), mk(2, cwe="CWE-1"),
        mk(3, description="why", remediation="fix"))), tmp_path, "sarif")
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CWE-1", "bad-\"thing\"\n"]
    assert [r["ruleIndex"] for r in run["results"]] == [0, 0, 1]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3}
    assert run["results"][2]["message"]["text"] == "why"


EP = ("scan_id string, endpoint_id string, method string, path string, file_path string,"
      "line int, framework string, handler string, handler_file string, handler_line int,"
      "authn string, authz string, risk string, notes string, auth_scope string,"
      "heuristic_risk string, role_hints array<string>, ownership_hints array<string>,"
      "id_params array<string>, id_kind string, privileged boolean, state_changing boolean,"
      "likely_public boolean")


def test_openapi_document(rows, tmp_path):
    base = dict(scan_id="s", file_path="u.js", line=3, framework="express", role_hints=[],
                ownership_hints=[], id_params=[], privileged=False, state_changing=False,
                likely_public=False)
    eps = rows(EP, {**base, **dict(endpoint_id="e0", method="DELETE", path="/users/:id",
                                   handler="del", authn="none", authz="none", risk="high",
                                   id_params=["id"], state_changing=True)},
               {**base, **dict(endpoint_id="e1", method="GET", path="/health", authn="public",
                               authz="none", risk="low")},
               {**base, **dict(endpoint_id="e2", method="ANY", path="/any", risk="medium",
                               authn="required", notes="say \"hi\"")})
    found = rows(FINDING, *[dict(scan_id="s", finding_id=f"f{i}", title=f"T\"{i}", severity="high",
                                 state="proposed", endpoint="delete  /users/:id") for i in (1, 2)])
    spec = _document(sinks.openapi_fragments(eps, found, base_url="https://app.test/"),
                     tmp_path, "oas")
    assert spec["servers"] == [{"url": "https://app.test"}]
    op = spec["paths"]["/users/{id}"]["delete"]
    assert op["tags"] == ["risk-high", "has-findings"] and op["parameters"][0]["name"] == "id"
    assert any("IDOR" in t for t in op["x-bac-tests"])
    assert "Related findings:\n- [high] T\"1\n- [high] T\"2\nBAC tests:" in op["description"]
    assert op["x-related-findings"] == ['[high] T"1', '[high] T"2']
    assert spec["paths"]["/health"]["get"]["security"] == []
    assert set(spec["paths"]["/any"]) == {"get", "post"}
    risky = {r.template for r in sinks.openapi_operations(eps, "medium").collect()}
    assert risky == {"/users/{id}", "/any"}


def test_flat_exports(rows, tmp_path, spark):
    f = rows(FINDING + ", confidence double", dict(
        scan_id="s", finding_id="f", title="a,\"b\"", severity="low", state="proposed",
        source="ai", confidence=0.9), dict(scan_id="s", finding_id="g", state="dismissed"))
    table = sinks.findings_csv(f)
    assert table.columns[1:] == list(__import__("auditspan.functions.fixed", fromlist=["x"])
                                     .CSV_COLUMNS)
    sinks.write_csv(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first().title == "a,\"b\"" and back.count() == 1
    sinks.write_issue_xml(sinks.issue_rows(f), str(tmp_path / "xml"))
    xml = spark.read.format("xml").option("rowTag", "issue").load(str(tmp_path / "xml"))
    assert xml.first().confidence == "Certain" and xml.first().type == 134217728
    assert xml.first()._scan_id == "s"


def test_groups_and_buckets(rows):
    f = rows(FINDING, *[dict(scan_id="s", finding_id=str(i), title="t", severity=s, state="proposed",
                             source=src, cwe=c) for i, (s, src, c) in enumerate(
        [("low", "ai", "CWE-1"), ("high", "correlated", "cwe-1 "), ("info", "dast", None)])])
    g = rollups.issue_groups(f).orderBy("top_rank").collect()
    assert [(r.group_key, r.instances, r.top_severity) for r in g] == [
        ("cwe-1", 2, "high"), ("t", 1, "info")]
    b = {r.bucket: r.n for r in rollups.source_buckets(f).collect()}
    assert b == {"all": 3, "ai": 2, "dast": 1}
    assert labels.risk_band(F.lit(70)) is not None


def test_planned_stages():
    from auditspan.plans.stages import Checks, ReviewOptions, planned_stages
    on = planned_stages(ReviewOptions(scanners=frozenset({"semgrep", "ai"})))
    assert on.index("access_control") < on.index("ai_plan") < on.index("ai_coverage") \
        < on.index("ai_access") < on.index("ai_judge") < on.index("ai_verify")
    off = planned_stages(ReviewOptions(frozenset({"semgrep", "ai"}),
                                       checks=Checks(False, False, False)))
    assert not {"access_control", "ai_coverage", "ai_access", "ai_verify"} & set(off)
    static = planned_stages(ReviewOptions(frozenset({"semgrep"})))
    assert "access_control" in static and "ai_access" not in static


def test_source_tree(spark, tmp_path):
    from auditspan.sources import tree
    for name, data in (("src/a.py", b"x = 1\n"), ("node_modules/b.js", b"y"), ("src/__init__.py", b""),
                       ("src/_private/deep/w.py", b"w = 2\n"), (".env", b"KEY=v\n"),
                       ("src/c.bin", b"\x00\x01"), ("big.py", b"z" * 2000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "src" / "link.py").symlink_to(tmp_path / "src" / "a.py")
    (tmp_path / "loop").symlink_to(tmp_path / "src")
    files = tree.source_tree(spark, str(tmp_path), "art")
    idx = {r.path: r for r in corpus.file_index(files, cap=1000).collect()}
    assert set(idx) == {"src/a.py", "src/__init__.py", "src/_private/deep/w.py", ".env", "src/c.bin", "big.py"}
    assert idx["src/a.py"].included and idx["src/c.bin"].is_binary and not idx["big.py"].included
    text = {r.path: r.content for r in tree.as_text(files).collect()}
    assert text["src/_private/deep/w.py"] == "w = 2\n" and text[".env"] == "KEY=v\n"
    assert text["big.py"] == "z" * 2000 and "src/c.bin" not in text
    capped = tree.source_tree(spark, str(tmp_path), "art", cap=1000).where("path = 'big.py'").first()
    assert capped.content is None and capped.size_bytes == 2000


def test_listing_of_each_artifact(rows):
    index = rows("artifact_id string, path string", *[
        dict(artifact_id=a, path=f"p{k}") for a in "ab" for k in range(3)])
    assert corpus.list_files(index).count() == 6
    got = [(r.artifact_id, r.path) for r in corpus.list_files(index, limit=2).collect()]
    assert got == [("a", "p0"), ("a", "p1"), ("b", "p0"), ("b", "p1")]


def test_queues_keep_every_row(rows):
    found = rows(FINDING, *[dict(scan_id="s", finding_id=f"f{k:04d}", severity="high", state="proposed")
                            for k in range(650)])
    queued = rollups.verification_queue(found.withColumn("confidence", F.lit(0.5)), ["scan_id"])
    assert sorted(r.position for r in queued.collect()) == list(range(1, 651))
    assert queued.where("verification = 'queued'").count() == 650
    assert rollups.report_findings(found, ["scan_id"]).count() == 650
    assert rollups.report_findings(found, ["scan_id"], cap=10).count() == 10
