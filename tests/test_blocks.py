"""The block table, the symbol index, the line index and the packing rounds against plain versions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspan.operators import access_map, blocks, corpus, evidence, packing, routes

FILE = "artifact_id string, path string, content string"
PIECES = {
    ".py": ["def a(x):", "class B:", "    def c(self):", "    async def d(self,", "    ):", "        y = 1", "    z", "", "@deco", "# note",
            "    # inner", ")", "x = {", "}"],
    ".rb": ["def a", "  def b", "class C", "    if x", "    end", "  end", "end", "", "  # note", "puts 1"],
    ".ts": ["class A {", "  run() {", "  }", "}", "call(x);", "", "@Get()", "// note", "if (a) { b(); }", "({", "});", "plain", "  /* c */", "}}"],
}


def plain_end(rows, line, ext, reach):
    """The end of a definition, line by line."""
    n, indent = len(rows), lambda t: len(t) - len(t.lstrip())
    if not n or line > n:
        return min(line, n)
    last = n if reach is None else min(n, line + reach)
    if ext == ".py":
        at = next((k for k in range(line, last + 1) if re.match(r"\s*(async\s+)?(def|class)\s", rows[k - 1])), last)
        end = at
        for k in range(at + 1, last + 1):
            t = rows[k - 1]
            if t.strip():
                if indent(t) <= indent(rows[at - 1]) and t.strip()[0] not in ")]}":
                    break
                end = k
        return end
    if ext == ".rb":
        return next((k for k in range(line + 1, last + 1) if rows[k - 1].strip() == "end" and indent(rows[k - 1]) <= indent(rows[line - 1])), last)
    depth, opened = 0, False
    for k in range(line, last + 1):
        depth += rows[k - 1].count("{") - rows[k - 1].count("}")
        opened |= depth > 0
        if opened and depth <= 0 or not opened and rows[k - 1].rstrip().endswith(";"):
            return k
    return last


def plain_start(rows, line, lead):
    start = line
    while start > 1 and (lead is None or line - start < lead) and rows[start - 2].strip()[:1] in tuple("@[#/*") \
            and rows[start - 2].strip().startswith(("@", "[", "#", "//", "/*", "*")):
        start -= 1
    return start


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_block_ends(data):
    ext = data.draw(st.sampled_from(sorted(PIECES)))
    rows = data.draw(st.lists(st.sampled_from(PIECES[ext]), max_size=30))
    shape = blocks.Lines("\n".join(rows), "dir/file" + ext)
    rows = "\n".join(rows).splitlines()
    for line in range(1, len(rows) + 2):
        for reach in (0, 3, 80, None):
            assert shape.end(line, reach) == plain_end(rows, line, ext, reach)
        for lead in (0, 2, 11, None):
            if line <= len(rows):
                assert shape.start(line, lead) == plain_start(rows, line, lead)


def test_blocks_guards_and_stabs(spark, rows):
    source = "@UseGuards(A)\nexport class A {\n  function go() {\n  }\n}\nclass B {\n}\nrouter.use(auth)\nx\n"
    src = rows(FILE, dict(artifact_id="a", path="m.ts", content=source), dict(artifact_id="a", path="empty.ts", content=""),
               dict(artifact_id="a", path="none.ts"), dict(artifact_id="b", path="long.py", content="def f():\n" + "    x\n" * 500))
    table = blocks.code_blocks(src, kinds=("def", "class", "guard")).collect()
    assert {(r.path, r.kind, r.name, r.line, r.lo, r.hi, r.depth) for r in table} == {
        ("m.ts", "guard", "@UseGuards", 1, 2, 5, 0), ("m.ts", "class", "A", 2, 1, 5, 0), ("m.ts", "def", "go", 3, 3, 4, 1),
        ("m.ts", "class", "B", 6, 6, 7, 0), ("m.ts", "guard", "router.use(auth", 8, 9, None, 0), ("long.py", "def", "f", 1, 1, 501, 0)}
    points = [("a", "m.ts", k) for k in range(1, 12)] + [("b", "long.py", k) for k in (1, 64, 65, 128, 501, 502)]
    asked = spark.createDataFrame(points, "artifact_id string, path string, line int")
    got = {(r.path, r.line, r.name) for r in blocks.stabbed(asked, blocks.code_blocks(src, kinds=("def", "class", "guard"))).collect()}
    assert got == {(p, k, r.name) for _, p, k in points for r in table if r.path == p and r.lo <= k and (r.hi is None or k <= r.hi)}


def test_asked_lines_read_only_their_files(rows):
    src = rows(FILE, dict(artifact_id="a", path="x.py", content="@d\ndef f():\n    return 1\n"), dict(artifact_id="a", path="y.py", content="def g(): 1\n"))
    asked = rows("artifact_id string, path string, line int", dict(artifact_id="a", path="x.py", line=2), dict(artifact_id="a", path="x.py", line=9))
    got = {(r.path, r.line, r.lo, r.hi, r.name) for r in blocks.code_blocks(src, kinds=("asked",), asked=asked).collect()}
    assert got == {("x.py", 2, 1, 3, "def f():"), ("x.py", 9, 9, 3, None)}


def test_all_callers_and_whole_windows(rows):
    """Neither four callers nor 900 or 8,000 characters bound what comes back."""
    callers = [dict(artifact_id="a", path=f"c{k:02}.py", content="\n" * 5 + "wide(" + "x" * 1500 + ")\n" * 1) for k in range(30)]
    src = rows(FILE, dict(artifact_id="a", path="lib.py", content="def wide(x):\n    return x\n"), *callers)
    found = corpus.call_sites(src, rows("artifact_id string, symbol string", dict(artifact_id="a", symbol="wide"))).collect()
    assert [r.rn for r in sorted(found, key=lambda r: r.path)] == list(range(1, 31))
    assert all(len(r.context) > 1500 and r.line_no == 6 for r in found)
    spots = rows("artifact_id string, file_path string, line_start int, line_end int, code_snippet string",
                 dict(artifact_id="a", file_path="big.txt", line_start=1, line_end=900, code_snippet=None),
                 dict(artifact_id="a", file_path="gone.txt", line_start=1, line_end=2, code_snippet="kept"),
                 dict(artifact_id="a", file_path="big.txt", line_start=5000, line_end=None, code_snippet="beyond"))
    big = rows(FILE, dict(artifact_id="a", path="big.txt", content="line of text\n" * 1000))
    got = {r.line_start: r for r in corpus.code_windows(spots, big).where("file_path = 'big.txt'").collect()}
    assert len(got[1].source_context) > 8000 and got[1].source_context.endswith("925: line of text")
    assert got[5000].available and got[5000].source_context == "beyond"
    gone = corpus.code_windows(spots, big).where("file_path = 'gone.txt'").first()
    assert not gone.available and gone.source_context == "kept"


def test_handler_in_the_last_of_many_files(rows):
    """Neither 3 controllers nor 12 files bound the search."""
    src = rows(FILE, dict(artifact_id="a", path="config/routes.rb", content="  get '/r', to: 'pages#home'\n"),
               *[dict(artifact_id="a", path=f"app{k}/controllers/pages_controller.rb", content="class P\n  def other\n  end\nend\n") for k in range(9)],
               dict(artifact_id="a", path="zz/controllers/pages_controller.rb", content="class P\n  def home\n  end\nend\n"),
               dict(artifact_id="a", path="web.php", content="Route::post('/p', 'Page@store');\n"),
               *[dict(artifact_id="a", path=f"m{k:02}/Page.php", content="<?php\n") for k in range(20)],
               dict(artifact_id="a", path="z/Page.php", content="<?php\nfunction store() {\n}\n"))
    by = {r.path: r for r in access_map.access_map(routes.extract_routes(src), src).collect()}
    assert (by["/r"].handler_file, by["/r"].handler_line, by["/r"].handler_end) == ("zz/controllers/pages_controller.rb", 2, 3)
    assert (by["/p"].handler_file, by["/p"].handler_line, by["/p"].handler_end) == ("z/Page.php", 2, 3)


def test_no_file_lines_on_routes(rows):
    src = rows(FILE, dict(artifact_id="a", path="x.py", content="@app.get('/a')\ndef f():\n    return 1\n"))
    eps = routes.extract_routes(src)
    assert "_lines" not in access_map._handler_spots(eps, src, ["artifact_id"]).columns


# ---- line index --------------------------------------------------------------------------------
def test_probe_lines(spark, rows, monkeypatch):
    monkeypatch.setattr(evidence, "PROBES", 7)
    rng = random.Random(2)
    words = ["alpha", "beta", "gämma", "return value", "a b", "☃ snow"]
    text = "\n".join("  ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(200)) + "\r\nlast  line\there"
    lines = [" ".join(t.split()) for t in text.splitlines()]
    probes = sorted({t[a:a + n] for t in lines for a, n in [(rng.randint(0, 9), rng.randint(6, 40))]
                     if len(t[a:a + n]) >= 8 and t[a:a + n] == " ".join(t[a:a + n].split())})[:60] + ["not in the file", "last line here"]
    asked = spark.createDataFrame([("a", "f.txt", f"t{k}", [p, probes[0]]) for k, p in enumerate(probes)] + [("a", "f.txt", "none", []), ("a", "gone", "t", probes)],
                                  "artifact_id string, path string, tag string, probes array<string>")
    src = rows(FILE, dict(artifact_id="a", path="f.txt", content=text))
    got = {r.tag: r for r in evidence.probe_lines(asked, src).collect()}
    assert set(got) == {f"t{k}" for k in range(len(probes))} | {"none"}
    for k, p in enumerate(probes):
        assert got[f"t{k}"].lines == [n for n, t in enumerate(lines, 1) if p in t or probes[0] in t]
    assert got["none"].lines is None and got["none"].n_lines == len(lines)


# ---- packing ------------------------------------------------------------------------------------
def greedy(tokens, limit):
    out, used, batch = [], None, 0
    for t in tokens:
        if used is not None and used + t > limit:
            used, batch = None, batch + 1
        used = (used or 0) + t
        out.append(batch)
    return out


@pytest.mark.parametrize("block, fan", [(4, 2), (3, 5), (50, 32)])
def test_one_artifact_of_most_files(spark, monkeypatch, block, fan):
    """One artifact holds nine tenths of all files; no group holds more than fan summaries."""
    monkeypatch.setattr(packing.entry_states, "__defaults__", (fan,))
    rng = np.random.default_rng(8)
    sizes = {"big": rng.integers(0, 60, 450).tolist(), "one": [500], **{f"s{k}": rng.integers(0, 150, 5).tolist() for k in range(9)}}
    rows = [(a, f"f{k:04}", int(t)) for a, ts in sizes.items() for k, t in enumerate(ts)]
    got = packing.pack_batches(spark.createDataFrame(rows, "artifact_id string, path string, tokens long"), 100, block=block).collect()
    assert {(r.artifact_id, r.path): r.batch for r in got} == {
        (a, f"f{k:04}"): b for a, ts in sizes.items() for k, b in enumerate(greedy(ts, 100))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=6), min_size=1, max_size=7), st.integers(1, 60), st.integers(0, 6))
def test_steps_compose(parts, limit, cut):
    """Composition is associative and equals running the parts one after the other."""
    filling = packing.Filling(limit)
    steps = [filling.step(np.array(p, np.int64)) for p in parts]
    whole = filling.compose(steps)
    cut = min(cut, len(steps) - 1) or len(steps)
    nested = filling.compose([filling.compose(steps[:cut])] + ([filling.compose(steps[cut:])] if steps[cut:] else []))
    for carry in (*range(limit + 1), limit + 1):
        state = (carry, -1)
        for step in steps:
            state = filling.apply(state, step)
        assert filling.apply((carry, -1), whole) == state == filling.apply((carry, -1), nested)
    assert len(whole["marks"]) <= max(len([t for p in parts for t in p]), 1)


@pytest.mark.parametrize("block", [3, 1000])
def test_endpoint_batches_in_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(packing.entry_states, "__defaults__", (2,))
    rng = random.Random(9)
    rows = [("a", f"e{k:03}", f"f{k // rng.choice([3, 20])}", None, k) for k in range(130)] + [("b", "e0", "x", None, 1)]
    df = spark.createDataFrame(rows, "artifact_id string, endpoint_id string, handler_file string, file_path string, line int")
    got = {(r.artifact_id, r.endpoint_id): r.batch for r in packing.endpoint_batches(df, per=10, block=block).collect()}
    want, size, batch, before = {}, 0, 0, None
    for a, e, f, _, line in sorted(rows[:-1], key=lambda r: (r[2], r[4], r[1])):
        if size and (size >= 10 or size >= 5 and f != before):
            size, batch = 0, batch + 1
        size, before = size + 1, f
        want[a, e] = batch
    assert got == {**want, ("b", "e0"): 0}


def test_json_text_length(spark):
    import json
    texts = ["", "plain", 'q"\\\n\r\t\b\f', "\x00\x1f\x7f", "é☃", "😀 a", "tab\tend"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from auditspan.functions import text
    got = [r.n for r in df.select(text.json_text_length(F.col("t")).alias("n")).collect()]
    assert got == [len(json.dumps(t)) for t in texts]
