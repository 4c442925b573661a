"""Matching findings with scanner hits, with each other and with verdicts.

Every "within three lines of the same file" condition is rewritten as an
equality on line targets over pre-aggregated rows; no pair of findings of a
group is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.labels import truthy
from .ordered import crowded_groups, line_lookups, line_targets, pin, split_crowded

SCAN = ("scan_id",)


# ---- scanner hits nobody addressed (J4) -----------------------------------
def unaddressed_hits(hits: DataFrame, findings: DataFrame, keys=SCAN,
                     reach: int = 3) -> DataFrame:
    """Hits with no finding within *reach* lines of the same file.

    A hit without a line is addressed by any finding in its file; a finding
    without a line sits on line 0.
    """
    at = findings.where(truthy(F.col("file_path")).isNotNull()).select(
        *keys, "file_path", F.coalesce("line_start", F.lit(0)).alias("_line"))
    covered = at.select(*keys, "file_path", F.explode(F.concat(
        F.sequence(F.col("_line") - reach, F.col("_line") + reach),
        F.array(F.lit(None).cast("int")))).alias("_at")).distinct()
    h, c = hits.alias("h"), covered.alias("c")
    same = F.col("h.line_start").eqNullSafe(F.col("c._at")) \
        & (F.col("h.file_path") == F.col("c.file_path"))
    for k in keys:
        same = same & (F.col(f"h.{k}") == F.col(f"c.{k}"))
    return h.join(c, same, "left_anti")


def silent_sink_files(scores: DataFrame, findings: DataFrame, keys=("artifact_id",)):
    """Sink-bearing files without any finding."""
    found = findings.select(*keys, F.col("file_path").alias("path")).distinct()
    return scores.join(found, [*keys, "path"], "left_anti")


# ---- reviewer agreement (J6, D9) -------------------------------------------
def _key(name: str, *parts) -> dict:
    """Two independent 64-bit hashes standing for a composite key: fixed width for
    joins and aggregations, and together wide enough not to collide."""
    marked = [F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]
    return {f"{name}1": F.xxhash64(*marked), f"{name}2": F.xxhash64(F.lit(7), *marked)}


#: Reviewers that one word of a bitmap holds, and reviewers whose numbers may be broadcast.
BITS, FEW_REVIEWERS = 62, 10_000
#: Rows of one file that are compared among themselves; files with more spread their lines.
FEW_ROWS = 64


def _file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_file", F.coalesce("file_path", F.lit("")))


def _issue(findings: DataFrame) -> DataFrame:
    """What decides whether two findings report the same issue: file, line, CWE and loose tags."""
    c = F.col
    loose = F.concat(
        F.transform(labels.title_words(c("title")), lambda w: F.concat(F.lit("w:"), w)),
        F.array_compact(F.array(F.concat(F.lit("k:"), truthy(c("category"))))))
    return _file(findings).withColumns({"_cwe": labels.cwe_prefix(truthy(c("cwe"))), "_loose": loose})


def reviewer_agreement(findings: DataFrame, reviewers: int, keys=SCAN) -> DataFrame:
    """Findings with the number of distinct reviewers reporting the same issue.

    Same issue: same file, lines within 3 or unknown, and equal CWE, or (when
    not both have one) a shared title word or an equal category. Findings are exchanged once: the up to FEW_ROWS
    findings of a file meet in one row and are compared there. Only files with more spread their lines.
    """
    rows = _issue(findings)
    crowded = crowded_groups(rows, [*keys, "_file"], FEW_ROWS)
    names = findings.columns
    if crowded is None:
        return _counted_together(rows, names, reviewers, keys)
    few, many = split_crowded(rows, [*keys, "_file"], crowded)
    return _counted_together(few, names, reviewers, keys).unionByName(_counted_by_line(pin(many), names, reviewers, keys))


def _counted_together(rows: DataFrame, names, reviewers: int, keys) -> DataFrame:
    """Counts of files with few findings, one row a file."""
    c = F.col
    item = F.struct(F.struct(*names).alias("row"), c("line_start").alias("line"), c("_cwe").alias("cwe"), c("_loose").alias("loose"),
                    c("reviewed_by").alias("who"))
    files = rows.repartition(*keys, "_file").groupBy(*keys, "_file").agg(
        F.collect_list(item).alias("_all"), (F.min("reviewed_by") < F.max("reviewed_by")).alias("_shared"))

    def peer(x, y):
        near = x["line"].isNull() | y["line"].isNull() | (F.abs(x["line"].cast("long") - y["line"]) <= 3)
        both = x["cwe"].isNotNull() & y["cwe"].isNotNull()
        equal = x["line"].eqNullSafe(y["line"]) & x["cwe"].eqNullSafe(y["cwe"]) & (x["loose"] == y["loose"])
        return y["who"].isNotNull() & (equal | near & F.when(both, x["cwe"] == y["cwe"]).otherwise(F.arrays_overlap(x["loose"], y["loose"])))

    def count(x):
        who = F.transform(F.filter("_all", lambda y: peer(x, y)), lambda y: y["who"])
        return F.greatest(F.size(F.array_distinct(who)), F.lit(1))
    told = F.transform("_all", lambda x: F.struct(x["row"].alias("row"), F.when(c("_shared"), count(x)).otherwise(1).alias("n")))
    return files.select(F.explode(told).alias("_x")).select("_x.row.*", c("_x.n").cast("int").alias("agreement"),
                                                             F.lit(reviewers).alias("reviewers"))


def _counted_by_line(rows: DataFrame, names, reviewers: int, keys) -> DataFrame:
    """Counts of files with many findings: a reviewer is a bit; what is reported under one (file, tag, line) becomes one
    bitmap, and only then are lines spread. All groups are of numbers, so copies collapse before they are exchanged."""
    c, cwe, loose = F.col, F.col("_cwe"), F.col("_loose")
    group = [*[c(k) for k in keys], c("_file")]
    marked = rows.withColumns({**_key("_g", *group), **_key("_p", *group, c("line_start"), cwe, F.array_join(loose, "\x01"))})
    who = pin(rows.where("reviewed_by IS NOT NULL").select(c("reviewed_by").alias("_who")).distinct())
    numbers = who.withColumn("_no", F.row_number().over(Window.orderBy("_who")) - 1)  # one row a reviewer
    numbers = F.broadcast(numbers) if who.count() <= FEW_REVIEWERS else numbers
    narrow = marked.select("_g1", "_g2", "_p1", "_p2", c("line_start").alias("_line"), "_cwe", "_loose",
                           c("reviewed_by").alias("_who")).join(numbers, "_who", "left").drop("_who")
    shared = narrow.groupBy("_g1", "_g2").agg(F.min("_no").alias("_a"), F.max("_no").alias("_b")).where("_a <> _b").select("_g1", "_g2")
    active = pin(narrow.join(shared, ["_g1", "_g2"], "left_semi").withColumns({
        "_word": F.coalesce(F.floor(c("_no") / BITS).cast("int"), F.lit(0)),
        "_bits": F.coalesce(F.expr(f"shiftleft(1L, _no % {BITS})"), F.lit(0).cast("long"))}).drop("_no"))
    has = c("_cwe").isNotNull()
    mark = lambda m: F.transform("_loose", lambda t: F.concat(F.lit(m), t))
    exact = F.array_compact(F.array(F.concat(F.lit("c:"), c("_cwe"))))
    # "n" tags are met by rows without a CWE, "m" tags only by rows with one
    offered = F.concat(exact, mark("n"), F.when(~has, mark("m")).otherwise(
        F.array().cast("array<string>")))
    asked = F.concat(exact, F.when(has, mark("m")).otherwise(mark("n")))
    tag = lambda rows, *kept: rows.select(*kept, *[v.alias(k) for k, v in _key("_t", c("_g1"), c("_g2"), c("_tag")).items()])
    either = F.bit_or("_bits").alias("_bits")
    per_line = tag(active.where("_bits <> 0").select("_g1", "_g2", "_line", "_word", "_bits", F.explode(offered).alias("_tag")),
                   "_line", "_word", "_bits").groupBy("_t1", "_t2", "_line", "_word").agg(either)
    seen = per_line.select("_t1", "_t2", "_word", "_bits", F.explode(line_targets(c("_line"))).alias("_at")).groupBy(
        "_t1", "_t2", "_at", "_word").agg(either)
    wants = tag(active.select("_g1", "_g2", "_p1", "_p2", "_line", F.explode(asked).alias("_tag")), "_p1", "_p2", "_line").select(
        "_p1", "_p2", "_t1", "_t2", F.explode(line_lookups(c("_line"))).alias("_at")).distinct()
    peers = wants.join(seen, ["_t1", "_t2", "_at"]).select("_p1", "_p2", "_word", "_bits").unionByName(
        active.select("_p1", "_p2", "_word", "_bits"))
    counted = peers.groupBy("_p1", "_p2", "_word").agg(either).groupBy("_p1", "_p2").agg(
        F.greatest(F.sum(F.bit_count("_bits")), F.lit(1)).alias("_n"))
    return marked.join(counted, ["_p1", "_p2"], "left").select(
        *[c(n) for n in names],
        F.coalesce(c("_n"), F.lit(1)).cast("int").alias("agreement"),
        F.lit(reviewers).alias("reviewers"))


def agreement_histogram(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy(F.concat_ws("/", "agreement", "reviewers").alias(
        "agreement")).agg(F.count(F.lit(1)).alias("n"))


# ---- metadata carry-over (J7) ----------------------------------------------
def carry_metadata(judged: DataFrame, inputs: DataFrame, carry, keys=SCAN,
                   order: str = "ord") -> DataFrame:
    """Fill NULL metadata of judged rows from the input row they came from.

    Same file, lines within 3 or unknown; the last input with an equal title,
    else the first input. The up to FEW_ROWS inputs of a file are compared with its judged rows; only
    files with more collapse to one first row per line and one last row per (line, title), which spread to
    neighbouring lines.
    """
    carry, keys = list(carry), list(keys)
    c = F.col
    base = _file(inputs).select(
        *keys, "_file", F.coalesce("title", F.lit("")).alias("_title"), c("line_start").alias("_line"),
        c(order).alias("_ord"), F.struct(*carry, c("source").alias("_source")).alias("_pay"))
    want = _file(judged).select(*keys, "_file", F.coalesce("title", F.lit("")).alias("_wanted"), "finding_id",
                                c("line_start").alias("_asked"))
    crowded = crowded_groups(base, [*keys, "_file"], FEW_ROWS)
    if crowded is None:
        hits = _inputs_compared(want, base, keys)
    else:
        (few_want, many_want), (few, many) = (split_crowded(rows, [*keys, "_file"], crowded) for rows in (want, base))
        hits = _inputs_compared(few_want, few, keys).unionByName(_inputs_by_line(many_want, many, keys))
    best = hits.groupBy(*keys, "finding_id").agg(
        F.max_by("_last", c("_last._ord")).alias("_last"), F.min_by("_first", c("_first._ord")).alias("_first"))
    pay = F.coalesce(c("_last._pay"), c("_first._pay"))
    joined = judged.join(best, [*keys, "finding_id"], "left").withColumn("_pay", pay)
    out = []
    for n in judged.columns:
        if n in carry:
            out.append(F.coalesce(c(n), c(f"_pay.{n}")).alias(n))
        elif n == "source":
            out.append(F.when(c("_pay._source") == "access", "access").otherwise(c("source")).alias("source"))
        else:
            out.append(c(n))
    return joined.select(*out)


def _inputs_compared(want: DataFrame, base: DataFrame, keys) -> DataFrame:
    """Input rows near the wanted ones, as the last of equal title and the first of all."""
    c = F.col
    hit = F.struct("_ord", "_pay")
    near = c("_asked").isNull() | c("_line").isNull() | (F.abs(c("_asked").cast("long") - c("_line")) <= 3)
    return want.join(base, [*keys, "_file"]).where(near & c("finding_id").isNotNull()).select(
        *keys, "finding_id", F.when(c("_wanted") == c("_title"), hit).alias("_last"), hit.alias("_first"))


def _inputs_by_line(want: DataFrame, base: DataFrame, keys) -> DataFrame:
    """The same for files with many inputs, by line targets."""
    def spread(df, by, pick):
        per_line = df.groupBy(*keys, "_file", *by, "_line").agg(pick("_line").alias("_hit"))
        return per_line.select(*keys, "_file", *by, "_hit",
                               F.explode(line_targets(F.col("_line"))).alias("_at")) \
            .groupBy(*keys, "_file", *by, "_at").agg(pick("_at").alias("_hit"))

    def first(stage):
        hit = F.struct("_ord", "_pay") if stage == "_line" else F.col("_hit")
        return F.min_by(hit, F.col("_ord") if stage == "_line" else F.col("_hit._ord"))

    def last(stage):
        hit = F.struct("_ord", "_pay") if stage == "_line" else F.col("_hit")
        return F.max_by(hit, F.col("_ord") if stage == "_line" else F.col("_hit._ord"))

    anyone = spread(base, [], first).withColumnRenamed("_hit", "_first")
    titled = spread(base, ["_title"], last).withColumnRenamed("_hit", "_last")
    asked = want.select(*keys, "_file", F.col("_wanted").alias("_title"), "finding_id",
                        F.explode(line_lookups(F.col("_asked"))).alias("_at"))
    return asked.join(titled, [*keys, "_file", "_title", "_at"], "left").join(
        anyone, [*keys, "_file", "_at"], "left").select(*keys, "finding_id", "_last", "_first")


# ---- verdicts with lost ids (J8) ---------------------------------------------
def attach_verdicts(asked: DataFrame, answers: DataFrame, keys=("scan_id", "chunk")):
    """Answers matched to questions by id, then by (file, line), then by position
    when a chunk came back complete but without a single usable id.

    asked: keys, id, ord, file_path, line_start; answers: keys, id, n (position),
    file_path, line_start and a ``verdict`` payload. The last answer wins. Questions and answers of a chunk, one
    request to a model, are dealt together once; id, place and position are windows inside it.
    """
    c, keys = F.col, list(keys)
    place = ["file_path", "line_start"]
    questions = asked.select(*keys, "id", c("ord").alias("_at"), *place, F.struct(*asked.columns).alias("_asked"))
    replies = answers.select(*keys, "id", c("n").alias("_at"), *place, "verdict")
    rows = questions.unionByName(replies, allowMissingColumns=True).repartition(*keys)
    is_asked = c("_asked").isNotNull()
    within = lambda *by: Window.partitionBy(*keys, *by)
    whole = F.lit(True)
    for k in keys:
        whole = whole & c(k).isNotNull()
    known = ~is_asked & whole & c("id").isNotNull() & F.max(is_asked).over(within("id"))
    last = lambda which, order, *by: F.max_by(F.when(which, c("verdict")), F.when(which, order)).over(within(*by))
    loose = ~is_asked & ~c("_known")
    rows = rows.withColumn("_by_id", last(~is_asked & c("id").isNotNull(), c("_at"), "id")).withColumn("_known", known) \
        .withColumn("_by_loc", last(loose, c("_at"), *place)) \
        .withColumn("_by_pos", last(loose & c("_at").isNotNull(), F.coalesce(c("id").cast("string"), F.lit("")), "_at"))
    tally = lambda which: F.count_if(which).over(within())
    positional = (tally(is_asked) == tally(~is_asked)) & (tally(c("_known")) == 0)
    rows = rows.withColumn("_positional", positional)
    return rows.where(is_asked).select(
        *[c(f"_asked.{n}").alias(n) for n in asked.columns],
        F.when(whole, F.coalesce("_by_id", "_by_loc", F.when(c("_positional"), c("_by_pos")))).alias("verdict"))
