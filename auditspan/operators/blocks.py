"""Blocks and symbols of code: an interval table and an inverted index per corpus, and the joins
that read them.

A file is scanned once. What comes out are small rows (a block, a symbol), so findings and
routes never carry a file's lines: they ask the tables by line, and text is cut out beside the
file it belongs to.
"""

from __future__ import annotations

import heapq
import re
import sys
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.text import strip, uni

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC = ("artifact_id",)
#: A definition is followed for so many lines at most when a line is asked for, decorators and comments above it for so many.
REACH, LEAD = 80, 11
#: Lines that a bucket of the stabbing join holds; open intervals share one bucket a file.
BUCKET, OPEN = 64, -1
KINDS = ("def", "class", "scope", "guard", "asked")
BLOCK = "kind string, name string, line int, lo int, hi int, depth int"

# A definition keyword followed by the words up to (and including) the name.
DEFINITION_WORDS = uni(
    r"(?:\bdef|\bfunction|\bfunc|\bclass|\bpublic|\bprivate|\bprotected|\basync|\bconst"
    r"|\blet|\bvar)\s+((?:[\w<>\[\],?]+\s+)*[\w<>\[\],?]*)")
DEFINITION_KEYWORDS = ("def", "func", "class", "public", "private", "protected", "async", "const", "let", "var")
METHOD = uni(r"^\s*def\s+(\w+)")
CALL = uni(r"\b(\w+)\s*\(")


# ---- one file, inside a task -----------------------------------------------------------------
class Lines:
    """What the lines of one file say about their blocks, each found in one pass."""

    header = re.compile(r"\s*(async\s+)?(def|class)\s")
    names = [re.compile(p) for p in fixed.DEFINITION_PATTERNS]
    class_line = re.compile(fixed.CLASS_DECLARATION)
    class_name = re.compile(r"class\s+(\w+)")
    file_guard = re.compile("|".join(fixed.FILE_AUTH), re.IGNORECASE)
    class_guard = re.compile(fixed.CLASS_ATTRIBUTE)

    def __init__(self, content: str, path: str):
        self.rows = content.splitlines()
        dot = path.rfind(".")
        self.kind = path[dot:].lower() if dot > path.rfind("/") + 1 else ""
        self.bare = [t.strip() for t in self.rows]
        self.indent = [len(t) - len(t.lstrip()) for t in self.rows]
        self._ends()

    def __len__(self):
        return len(self.rows)

    def _ends(self) -> None:
        """Tables that give the end of a block from any line."""
        n = len(self)
        self.lead = [0] * (n + 1)  # first line of the run of decorators and comments that ends here
        self.solid = [0] * (n + 1)  # last line up to here that is not blank
        for k, s in enumerate(self.bare, 1):
            self.lead[k] = (self.lead[k - 1] or k) if s.startswith(fixed.ANNOTATION_PREFIXES) else 0
            self.solid[k] = k if s else self.solid[k - 1]
        if self.kind == ".py":
            self.headers = [k for k, t in enumerate(self.rows, 1) if self.header.match(t)]
            self.dedent = self._dedents()
        elif self.kind == ".rb":
            self.closing = defaultdict(list)  # lines that are `end`, by indentation
            for k, s in enumerate(self.bare, 1):
                if s == "end":
                    self.closing[self.indent[k - 1]].append(k)
        else:
            self._braces()

    def _dedents(self) -> dict[int, int]:
        """Last line of the definition at each header: the text before the next line that is
        indented no deeper; closing brackets do not end it."""
        heads, end, still = set(self.headers), {}, []
        for k, s in enumerate(self.bare, 1):
            if s and s[0] not in ")]}":
                while still and self.indent[k - 1] <= self.indent[still[-1] - 1]:
                    end[still.pop()] = self.solid[k - 1]
                if k in heads:
                    still.append(k)
        for k in still:
            end[k] = self.solid[-1]
        return end

    def _braces(self) -> None:
        """Lines at which the brace depth rises above a level or falls back to it, and lines that
        end a statement."""
        self.level, self.rises, self.falls, self.stops = [0], defaultdict(list), defaultdict(list), []
        for k, t in enumerate(self.rows, 1):
            before = self.level[-1]
            now = before + t.count("{") - t.count("}")
            for level in range(before, now):
                self.rises[level].append(k)
            for level in range(now, before):
                self.falls[level].append(k)
            if t.rstrip().endswith(";"):
                self.stops.append(k)
            self.level.append(now)

    def start(self, line: int, lead: int | None) -> int:
        """First line of the decorators and comments directly above."""
        first = self.lead[min(line, len(self) + 1) - 1] if line > 0 else 0
        return line if not first else first if lead is None else max(first, line - lead)

    def end(self, line: int, reach: int | None) -> int:
        """Last line of the definition that starts at *line* or, in Python, at the next header."""
        n = len(self)
        if not n or line > n:
            return min(line, n)
        last = n if reach is None else min(n, line + reach)
        if self.kind == ".py":
            at = bisect_left(self.headers, line)
            if at == len(self.headers) or self.headers[at] > last:
                return last
            end = self.dedent[self.headers[at]]
            return end if end <= last else self.solid[last]
        if self.kind == ".rb":
            found = [rows[at] for depth, rows in self.closing.items() if depth <= self.indent[line - 1]
                     and (at := bisect_right(rows, line)) < len(rows)]
            end = min(found, default=last)
        else:
            base = self.level[line - 1]
            rises, falls = self.rises.get(base, []), self.falls.get(base, [])
            opens = rises[at] if (at := bisect_left(rises, line)) < len(rises) else n + 1
            stop = self.stops[at] if (at := bisect_left(self.stops, line)) < len(self.stops) else n + 1
            closes = falls[at] if (at := bisect_right(falls, opens)) < len(falls) else n + 1
            end = stop if stop < opens else closes
        return min(end, last)

    def definitions(self) -> list[tuple[int, str]]:
        out = []
        for k, t in enumerate(self.rows, 1):
            name = next((m[1] for p in self.names if (m := p.search(t)) and m[1]), None)
            if name:
                out.append((k, name))
        return out

    def classes(self) -> list[tuple[int, str]]:
        return [(k, self.class_name.search(t)[1]) for k, t in enumerate(self.rows, 1)
                if "class" in t and self.class_line.search(t)]

    def guards(self):
        """Logins that a file or a class declares for the routes after them: (line, last line, hint),
        without a last line where the file's end is meant."""
        classes = [k for k, _ in self.classes()]
        for k, t in enumerate(self.rows, 1):
            found = self.file_guard.search(t)
            if found:
                yield k, None, found[0].strip()
                continue
            found = self.class_guard.search(t)
            at = bisect_left(classes, k)
            if found and at < len(classes) and classes[at] <= k + 4:
                yield k, classes[at + 1] - 1 if at + 1 < len(classes) else None, found[0].strip()

    def blocks(self, kinds, asked, reach: int | None, lead: int | None):
        """(kind, name, line, lo, hi, depth)."""
        if {"def", "class", "scope"} & set(kinds):
            defs, open_ends = self.definitions(), []
            both = sorted([(k, "class", name) for k, name in self.classes()] + [(k, "def", name) for k, name in defs])
            for k, kind, name in both:
                while open_ends and open_ends[0] < k:
                    heapq.heappop(open_ends)
                hi = self.end(k, None)
                if kind in kinds:
                    yield kind, name, k, self.start(k, None), hi, len(open_ends)
                heapq.heappush(open_ends, hi)
            if "scope" in kinds:
                for at, (k, name) in enumerate(defs):
                    yield "scope", name, k, k, defs[at + 1][0] - 1 if at + 1 < len(defs) else None, 0
        if "guard" in kinds:
            for k, hi, hint in self.guards():
                yield "guard", hint, k, k + 1, hi, 0
        for k in sorted(asked or ()):
            source = self.bare[k - 1] if 0 < k <= len(self) else None
            yield "asked", source, k, self.start(k, lead), self.end(k, reach), 0

    def source(self, line: int) -> str | None:
        return self.bare[line - 1] if 0 < line <= len(self) else None

    def cut(self, lo: int, hi: int) -> str:
        return "\n".join(self.rows[max(lo, 1) - 1:max(hi, 0)])

    def places(self, asked, reach: int | None, lead: int | None, bounded: bool):
        """(lo, hi, source, there, hints, body, top) of each (line, at, far): a route at *line*, its handler at *at*."""
        starts = {k: self.start(k, lead) for k in {a["line"] for a in asked}}
        ordered = sorted(starts)
        following = {k: starts[n] for k, n in zip(ordered, ordered[1:], strict=False)}
        guards = list(self.guards())
        for a in asked:
            line, at, lo, hi, body, there, top = a["line"], a["at"], None, None, None, None, None
            hints = list(dict.fromkeys(hint for k, end, hint in guards if k < line and (end is None or line <= end)))
            if a["far"]:
                top = self.cut(line, line + 2)
            else:
                lo, hi, there = starts[line], self.end(at, reach), self.source(at)
                if bounded:
                    hi = max(min(hi, following.get(line, hi + 1) - 1), line)
                body = self.cut(lo, hi)
            yield lo, hi, self.source(line), there, hints, body, top


# ---- the block table ------------------------------------------------------------------------
def code_blocks(files: DataFrame, keys=DOC, kinds=KINDS, asked: DataFrame | None = None,
                reach: int | None = REACH, lead: int | None = LEAD) -> DataFrame:
    """Blocks of every file in one pass over it: (keys, path, kind, name, line, lo, hi, depth).

    ``def`` and ``class``: a definition with the decorators and comments above it (lo) up to its end by
    the language's rule, and how many of them are open around it (depth). ``scope``: from a definition to the line
    before the next. ``guard``: the lines that a login of the file or a class covers (name: the hint). ``asked``: for each
    line of *asked* (keys, path, line) the block that starts there, within *reach* lines below and *lead* above (None: as
    far as it goes), with the line itself as name. A null *hi* is the end of the file. Only files with an asked line are
    read if nothing else is wanted.
    """
    keys = list(keys)
    rows = files.select(*keys, "path", "content").where("content IS NOT NULL")
    if asked is None:
        rows = rows.withColumn("asked", F.lit(None).cast("array<int>"))
    else:
        nested = asked.groupBy(*keys, "path").agg(F.collect_set(F.col("line").cast("int")).alias("asked"))
        rows = rows.join(nested, [*keys, "path"], "inner" if tuple(kinds) == ("asked",) else "left")
    names = [f.strip().split()[0] for f in BLOCK.split(",")]

    def scan(batches):
        for batch in batches:
            at, columns = [], [[] for _ in names]
            for row, (path, content, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "content", "asked")),
                                                             strict=True)):
                for block in Lines(content, path or "").blocks(kinds, lines, reach, lead):
                    at.append(row)
                    for column, value in zip(columns, block, strict=True):
                        column.append(value)
            spot = pa.array(at, pa.int32())
            kinds_of = [pa.string(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(spot) for c in (*keys, "path")]
                + [pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=[*keys, "path", *names])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, "path"))
    return rows.mapInArrow(scan, f"{kept}, {BLOCK}")


PLACE = "lo int, hi int, source string, there string, hints array<string>, body string, top string"


def route_places(rows: DataFrame, keys=DOC, beside: str | None = None, reach: int | None = REACH, lead: int | None = LEAD,
                 bounded: bool = True) -> DataFrame:
    """Routes and their handlers beside the file: (keys, path, beside, line, at, far, lo, hi, source, there, hints, body, top).

    *rows*: keys, path, content and _asked, an array of (line, at, far), with the array *beside* of equal length. lo and hi:
    lines of the handler at *at*, with its text as body (*bounded*: down to the next route); source and there: the lines
    themselves; hints: logins that cover the route; top: three lines of a route whose handler is *far*, without lines here.
    """
    keys, names = list(keys), [f.strip().split()[0] for f in PLACE.split(",")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    extra = [] if beside is None else [beside]

    def scan(batches):
        for batch in batches:
            at, columns = [], [[] for _ in names]
            for row, (path, content, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "content", "_asked")),
                                                             strict=True)):
                for place in Lines(content, path or "").places(asked, reach, lead, bounded):
                    at.append(row)
                    for column, value in zip(columns, place, strict=True):
                        column.append(value)
            spot = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(spot) for c in (*keys, "path")] + [batch.column(c).flatten() for c in extra]
                + batch.column("_asked").flatten().flatten() + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=[*keys, "path", *extra, "line", "at", "far", *names])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, "path")]
    held = [f"`{c}` {rows.schema[c].dataType.elementType.simpleString()}" for c in extra]
    return rows.mapInArrow(scan, ", ".join([*kept, *held, "line int, at int, far boolean", PLACE]))


def stabbed(points: DataFrame, blocks: DataFrame, keys=DOC) -> DataFrame:
    """*points* (keys, path, line) with every block that holds the line: block_line, name.

    A closed interval stands in the buckets of lines that it touches, an open one in one bucket of
    its own, so an equality finds it; a point asks two buckets.
    """
    keys = list(keys)
    held = blocks.select(*keys, "path", "lo", "hi", F.col("line").alias("block_line"), "name", F.explode(
        F.when(F.col("hi").isNull(), F.array(F.lit(OPEN))).when(
            F.col("hi") >= F.col("lo"), F.sequence(_bucket("lo"), _bucket("hi"))).otherwise(
            F.array().cast("array<int>"))).alias("bucket"))
    asking = points.select(*points.columns, F.explode(F.array(_bucket("line"), F.lit(OPEN))).alias("bucket"))
    inside = (F.col("lo") <= F.col("line")) & F.coalesce(F.col("line") <= F.col("hi"), F.lit(True))
    return asking.join(held, [*keys, "path", "bucket"]).where(inside).select(*points.columns, "block_line", "name")


def _bucket(line: str) -> Column:
    return F.floor(F.col(line) / BUCKET).cast("int")


def line_windows(asked: DataFrame, files: DataFrame, keys=DOC) -> DataFrame:
    """The lines lo .. hi of files for *asked* (keys, path, lo, hi): (keys, path, lo, hi, n_lines, lines).

    Equal windows are cut once, beside the file; a window takes only its own lines along.
    """
    keys = list(keys)
    per_file = asked.groupBy(*keys, "path").agg(F.collect_set(F.struct("lo", "hi")).alias("_windows"))
    cut = files.select(*keys, "path", "content").join(per_file, [*keys, "path"]).select(
        *keys, "path", text.lines_of(F.col("content")).alias("_lines"), F.col("_windows"))
    each = cut.select(*keys, "path", "_lines", F.explode("_windows").alias("_w"))
    return each.select(*keys, "path", "_w.lo", "_w.hi", F.size("_lines").alias("n_lines"),
                       text.line_window(F.col("_lines"), F.col("_w.lo"), F.col("_w.hi")).alias("lines"))


# ---- the symbol index -----------------------------------------------------------------------
def definition_name(line: Column) -> Column:
    return F.coalesce(*[text.extract(line, uni(p), 1) for p in fixed.DEFINITION_PATTERNS])


def defined_words(line: Column) -> Column:
    """Names a definition keyword on this line could introduce."""
    chains = F.regexp_extract_all(line, F.lit(DEFINITION_WORDS), F.lit(1))
    words = F.flatten(F.transform(chains, lambda c: F.split(strip(c), r"\s+")))
    return F.filter(F.transform(words, lambda w: F.regexp_extract(w, uni(r"^\w+"), 0)), lambda w: w != "")


def symbol_index(files: DataFrame, keys=DOC, kinds=("def", "word", "method", "call")) -> DataFrame:
    """Inverted index of names: (keys, symbol, path, line, kind, nth), nth from 0 among the same kind on the line.

    ``def``: the name of a definition; ``word``: any name that a definition keyword on the line could
    introduce; ``method``: a name after ``def``; ``call``: a name before a parenthesis on a line that defines nothing.
    Literal tests skip lines before patterns are tried.
    """
    t = F.col("text")
    lines = files.select(*keys, "path", F.posexplode(text.lines_of(F.col("content"))).alias("_pos", "text")).withColumn(
        "_name", F.when(text.contains_any(t, ("def", "fun", "(", "=>")), definition_name(t)))

    def entries(kind, names):
        return F.transform(names, lambda w, i: F.struct(F.lit(kind).alias("kind"), w.alias("symbol"), i.alias("nth")))
    none = F.array().cast("array<string>")
    found = {
        "def": F.when(F.col("_name").isNotNull(), F.array("_name")).otherwise(none),
        "word": F.when(text.contains_any(t, DEFINITION_KEYWORDS), defined_words(t)).otherwise(none),
        "method": F.when(t.contains("def"), F.array_compact(F.array(text.extract(t, METHOD, 1)))).otherwise(none),
        "call": F.when(t.contains("(") & F.col("_name").isNull(), F.regexp_extract_all(t, F.lit(CALL), F.lit(1))).otherwise(none)}
    each = lines.select(*keys, "path", (F.col("_pos") + 1).alias("line"),
                        F.explode(F.concat(*[entries(k, found[k]) for k in kinds])).alias("e"))
    return each.select(*keys, "e.symbol", "path", "line", "e.kind", "e.nth")


def symbol_counts(index: DataFrame, keys=DOC) -> DataFrame:
    """How often and in how many files each symbol stands, by kind."""
    per_file = index.groupBy(*keys, "symbol", "kind", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(*keys, "symbol", "kind").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("files"))
