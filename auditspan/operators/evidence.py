"""Checking the place a finding cites against the code itself."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.labels import truthy

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC = ("artifact_id",)
#: Bytes of a window of the line index; a probe has at least so many.
WINDOW = 8
#: Probes that meet a file in one row; more are dealt to several rows.
PROBES = 4096


def _suffixes(path):
    """Proper suffixes of a path that start after a slash."""
    parts = F.split(path, "/")
    n = F.size(parts)
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, i, n), "/"))


def _looked_up(kind: str, key, rank: int):
    return F.struct(F.lit(kind).alias("_kind"), key.alias("_k"), F.lit(rank).alias("_rank"))


def resolve_citations(cited: DataFrame, known: DataFrame, keys=DOC) -> DataFrame:
    """(keys, file_path, resolved): cited paths mapped onto known ones.

    A citation is taken as is, else cleaned, else matched when exactly one known
    path is a suffix of it (or the reverse), else when exactly one known path has
    its base name. Known paths become one table of whole paths, suffixes and base
    names with their least and greatest path, so a very common name costs one row
    and never a list of pairs; citations look everything up in one join.
    """
    keys = list(keys)
    path = F.col("path")
    names = known.select(*keys, "path", F.explode(F.concat(
        F.array(F.struct(F.lit("path").alias("_kind"), path.alias("_k")),
                F.struct(F.lit("base").alias("_kind"), paths.basename(path).alias("_k"))),
        F.transform(_suffixes(path), lambda t: F.struct(F.lit("tail").alias("_kind"), t.alias("_k"))))).alias("_e")) \
        .groupBy(*keys, F.col("_e._kind").alias("_kind"), F.col("_e._k").alias("_k")).agg(
            F.min("path").alias("_low"), F.max("path").alias("_high"))
    asked = cited.where(truthy(F.col("file_path")).isNotNull()).select(*keys, "file_path").distinct() \
        .withColumn("_p", paths.clean_citation(F.col("file_path")))
    clean = F.col("_p")
    lookups = asked.select(*keys, "file_path", F.explode(F.concat(
        F.array(_looked_up("path", F.col("file_path"), 0), _looked_up("path", clean, 1),
                _looked_up("tail", clean, 2), _looked_up("base", paths.basename(clean), 3)),
        F.transform(_suffixes(clean), lambda t: _looked_up("path", t, 2)))).alias("_e")) \
        .select(*keys, "file_path", "_e.*")
    found = lookups.join(names, [*keys, "_kind", "_k"], "left").groupBy(*keys, "file_path").agg(*[
        f(F.when(F.col("_rank") == rank, F.col(c))).alias(f"{c}{rank}")
        for rank in range(4) for f, c in ((F.min, "_low"), (F.max, "_high"))])
    return found.select(*keys, "file_path", F.coalesce("_low0", "_low1", *[
        F.when(F.col(f"_low{rank}") == F.col(f"_high{rank}"), F.col(f"_low{rank}")) for rank in (2, 3)]).alias("resolved"))


def repair_stored_paths(findings: DataFrame, known: DataFrame, keys=DOC) -> DataFrame:
    """Older stored paths: drop '..' and up to five leading segments until a known
    file remains (J3). Adds ``repaired`` (NULL when nothing matches)."""
    keys = list(keys)
    asked = findings.select(*keys, "file_path").where(
        truthy(F.col("file_path")).isNotNull()).distinct()
    tries = asked.select(*keys, "file_path", F.posexplode(
        paths.repair_candidates(F.col("file_path"))).alias("_pos", "path"))
    hits = tries.join(known.select(*keys, "path").distinct(), [*keys, "path"], "left_semi") \
        .groupBy(*keys, "file_path").agg(F.min_by("path", "_pos").alias("repaired"))
    return findings.join(hits, [*keys, "file_path"], "left")


# ---- the line index --------------------------------------------------------------
def windows(data: np.ndarray) -> np.ndarray:
    """Every window of WINDOW bytes as a number: the bytes themselves, so equal numbers are equal
    bytes."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def lines_with(content: str, probes: list[str]) -> tuple[int, list[list[int]]]:
    """How many lines a text has, and the lines (from 1) that hold each probe once their blanks are
    collapsed. The windows of all lines are looked up among one window of each probe; what meets is compared in full."""
    rows = [" ".join(t.split()).encode() for t in content.splitlines()]
    found: list[list[int]] = [[] for _ in probes]
    blob = b"\n".join(rows)
    data = np.frombuffer(blob, np.uint8)
    asked = [p.encode() for p in probes]
    wanted = np.zeros(len(asked), np.uint64)
    place = np.zeros(len(asked), np.int64)
    for k, p in enumerate(asked):
        own = windows(np.frombuffer(p, np.uint8))
        place[k] = int(scrambled(own).argmin())  # spread: not all at a common beginning
        wanted[k] = own[place[k]]
    order = np.argsort(wanted, kind="stable")
    ranked = wanted[order]
    index = windows(data)
    first = np.searchsorted(ranked, index, "left")
    spots = np.flatnonzero((first < len(ranked)) & (ranked[np.minimum(first, len(ranked) - 1)] == index)) if len(ranked) else []
    starts = np.cumsum([0] + [len(r) + 1 for r in rows])
    for spot in spots:
        lo, hi = first[spot], np.searchsorted(ranked, index[spot], "right")
        for k in order[lo:hi].tolist():
            at = int(spot - place[k])
            if at >= 0 and blob.startswith(asked[k], at):
                line = int(np.searchsorted(starts, at, "right"))
                if not found[k] or found[k][-1] != line:
                    found[k].append(line)
    return len(rows), found


def probe_lines(asked: DataFrame, files: DataFrame, keys=DOC) -> DataFrame:
    """(keys, path, tag, n_lines, lines) for *asked* (keys, path, tag, probes) whose file is there: the lines
    that hold any of the probes, texts of WINDOW bytes or more without line breaks, as a part; null without
    probes. (keys, path, tag) is unique.

    A file is read once for up to PROBES tags; only line numbers leave it.
    """
    keys = list(keys)
    per_file = F.count(F.lit(1)).over(Window.partitionBy(*keys, "path"))
    part = F.pmod(F.xxhash64("tag"), F.floor((per_file - 1) / PROBES) + 1)
    nested = asked.select(*keys, "path", "tag", "probes", part.alias("_part")).groupBy(*keys, "path", "_part").agg(
        F.collect_list(F.struct("tag", "probes")).alias("asked"))
    rows = files.select(*keys, "path", "content").join(nested, [*keys, "path"])

    def search(batches):
        for batch in batches:
            at, tags, counts, lines = [], [], [], []
            for row, (content, wanted) in enumerate(zip(batch.column("content").to_pylist(), batch.column("asked").to_pylist(),
                                                        strict=True)):
                probes = sorted({p for w in wanted for p in w["probes"]})
                n, found = lines_with(content or "", probes)
                hits = dict(zip(probes, found, strict=True))
                for w in wanted:
                    at.append(row)
                    tags.append(w["tag"])
                    counts.append(n)
                    lines.append(sorted({line for p in w["probes"] for line in hits[p]}) if w["probes"] else None)
            spot = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(spot) for c in (*keys, "path")]
                + [pa.array(tags, pa.string()), pa.array(counts, pa.int32()), pa.array(lines, pa.list_(pa.int32()))],
                names=[*keys, "path", "tag", "n_lines", "lines"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, "path"))
    return rows.mapInArrow(search, f"{kept}, tag string, n_lines int, lines array<int>")


def check_evidence(findings: DataFrame, files: DataFrame, keys=DOC) -> DataFrame:
    """Give every finding an evidence status and correct or demote it (M1).

    verified / relocated / location_only / snippet_mismatch / line_out_of_range /
    file_missing / no_location. Needs file_path, line_start, line_end,
    code_snippet, confidence, state, triage_note. The lines of a snippet are looked up in the
    line index of its file, once a file; findings only meet line numbers.
    """
    keys = list(keys)
    where = resolve_citations(findings, files, keys)
    probed = findings.withColumn("_snippet", F.coalesce("code_snippet", F.lit(""))) \
        .withColumn("_ls", F.coalesce("line_start", F.lit(0))) \
        .withColumn("_le", F.greatest("_ls", F.coalesce(
            F.nullif(F.col("line_end"), F.lit(0)), F.col("_ls"))))
    found = probed.join(where, [*keys, "file_path"], "left")
    asked = found.where("resolved IS NOT NULL").select(*keys, F.col("resolved").alias("path"), F.col("_snippet").alias("tag")) \
        .distinct().withColumn("probes", F.coalesce(text.snippet_probes(F.col("tag")), F.array().cast("array<string>")))
    searched = probe_lines(asked, files, keys).select(
        *keys, F.col("path").alias("resolved"), F.col("tag").alias("_snippet"), F.col("n_lines").alias("_lines"),
        F.col("lines").isNotNull().alias("_probed"), F.coalesce("lines", F.array().cast("array<int>")).alias("_hits"))
    j = found.join(searched, [*keys, "resolved", "_snippet"], "left")
    ls, le, h = F.col("_ls"), F.col("_le"), F.col("_hits")
    in_range = (ls >= 1) & (ls <= F.col("_lines"))
    status = (F.when(truthy(F.col("file_path")).isNull(), "no_location")
              .when(F.col("_lines").isNull(), "file_missing")
              .when(F.exists(h, lambda x: x.between(ls - 6, le + 6)), "verified")
              .when(F.size(h) > 0, "relocated")
              .when(F.col("_probed"), F.when(in_range, "snippet_mismatch")
                    .otherwise("line_out_of_range"))
              .otherwise(F.when(in_range, "location_only").otherwise("line_out_of_range")))
    nearest = F.array_min(F.transform(h, lambda x: F.struct(
        F.abs(x - ls).alias("d"), x.alias("line"))))["line"]
    j = j.withColumn("evidence_status", status).withColumn(
        "_near", F.when(F.col("evidence_status") == "relocated", nearest))
    st = F.col("evidence_status")
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))
    missing = st == "file_missing"
    updates = {
        "file_path": F.when(F.col("_lines").isNotNull(), F.col("resolved"))
        .otherwise(F.col("file_path")),
        "line_start": F.coalesce("_near", "line_start"),
        "line_end": F.when(F.col("_near").isNotNull(), F.col("_near") + F.when(
            ls > 0, le - ls).otherwise(0)).otherwise(F.col("line_end")),
        "confidence": F.when(missing, F.lit(0.1)).when(
            st == "snippet_mismatch", F.least(conf, F.lit(0.5))).when(
            st == "line_out_of_range", F.least(conf, F.lit(0.25))).otherwise(
            F.col("confidence").cast("double")),
        "state": F.when(missing, "dismissed").when(
            (st == "line_out_of_range") & (F.col("state") == "confirmed"), "proposed")
        .otherwise(F.col("state")),
        "triage_note": F.when(missing, "Evidence check: the cited file does not exist "
                                       "in the codebase.").otherwise(F.col("triage_note")),
    }
    note = F.when(missing, F.concat(F.lit("Cited file '"), F.col("file_path"),
                                    F.lit("' does not exist in the codebase"))).when(
        st == "relocated", F.concat(
            F.lit("Cited line "), F.when(ls > 0, ls.cast("string")).otherwise("?"),
            F.lit(" corrected to "), F.col("_near").cast("string")))
    return j.select(*[updates.get(c, F.col(c)).alias(c) for c in findings.columns],
                    "evidence_status", note.alias("evidence_note"))


def evidence_histogram(checked: DataFrame, keys=()) -> DataFrame:
    return checked.groupBy(*keys, "evidence_status").agg(F.count(F.lit(1)).alias("n"))
