"""Exact repeats of byte strings with suffix arrays over sampled suffixes.

Every string of ``LENGTH`` bytes holds an anchor: the least hash among its ``GRAM``-byte
substrings. Equal strings have their anchors at the same place, so it is enough to sort
the suffixes that start at anchors, each with ``LENGTH - GRAM`` bytes before and
``LENGTH`` bytes after its start. Contexts that are equal in full are settled by their
hash; only first occurrences of different contexts around one anchor are sorted.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered_position, pin
from .texts import Rolling, flat, map_texts, mix, record, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM
#: Contexts of one task, and of one anchor from which its windows are grouped by Spark.
TASK_CONTEXTS, HOT_ANCHOR = 20_000, 20_000
PAD = 0xFF  # never a byte of UTF-8


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """*pick* (minimum or maximum) over values[i : i + width] for every full window."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def anchors_of(data: np.ndarray, starts: np.ndarray):
    """(gram hash, context hash, row, place) of every anchor."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    rolling = Rolling(data)
    begin = np.arange(n - GRAM + 1)
    grams = rolling.of(begin, begin + GRAM)
    low = sliding(grams, BEFORE + 1, np.minimum)  # of the string that starts here
    size = np.diff(starts)
    row_of = np.repeat(np.arange(len(size)), size)
    crossing = row_of[:len(low)] != row_of[LENGTH - 1:]
    low[crossing] = 0
    padded = np.concatenate((np.zeros(BEFORE, np.uint64), low, np.zeros(BEFORE, np.uint64)))
    at = np.flatnonzero((sliding(padded, BEFORE + 1, np.maximum) == grams) & (grams != 0))
    row = row_of[at]
    first, end = np.maximum(at - BEFORE, starts[row]), np.minimum(at + LENGTH, starts[row + 1])
    context = mix(rolling.of(first, end) + (at - first).astype(np.uint64) * np.uint64(1009) + (end - at).astype(np.uint64))
    return grams[at], context, row, at - starts[row]


def settle(batches):
    """Splits sorted anchors (gram, context, doc, place) into those whose whole context
    occurs earlier (kind 0) and first occurrences of contexts whose anchor has several
    contexts (kind 1). Rows stream through; only the open anchor is held."""
    gram = context = None
    several, waiting = False, None
    for batch in batches:
        g, c, doc, place = (batch.column(k).to_numpy() for k in ("gram", "context", "doc", "place"))
        if not len(g):
            continue
        new_gram = np.ones(len(g), bool)
        new_gram[1:] = g[1:] != g[:-1]
        new_gram[0] = gram is None or g[0] != gram
        new = new_gram.copy()
        new[1:] |= c[1:] != c[:-1]
        new[0] |= c[0] != context
        group = np.cumsum(new_gram)  # 0: the anchor that was open
        contexts = np.bincount(group, weights=new, minlength=group[-1] + 1)
        if waiting is not None and contexts[0] > 0:
            yield record("kind gram doc place", np.ones(1, np.int32), *[np.array([x]) for x in waiting])
            several, waiting = True, None
        many = contexts > 1
        many[0] |= several or (contexts[0] > 0 and gram is not None)
        kind = np.where(new, np.where(many[group], 1, 2), 0)
        last = group == group[-1]
        still = last & (kind == 2)
        if group[-1] > 0:
            several, waiting = False, None
        if still.any():
            k = int(np.flatnonzero(still)[0])
            waiting = (g[k], doc[k], place[k])
        several = several or bool(many[-1])
        gram, context = g[-1], c[-1]
        out = kind < 2
        yield record("kind gram doc place", kind[out].astype(np.int32), g[out], doc[out], place[out])


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the common-prefix tree at *least*
    deep, by a scan with a stack. ``lcp[i]`` belongs to neighbours i - 1 and i."""
    out, stack = [], [(0, 0)]
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while stack[-1][0] > depth:
            deep, first = stack.pop()
            if deep >= least:
                out.append((deep, first, i - 1))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    return out


def longest_earlier(common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For members sorted by what stands before them: the longest common part with any
    member that occurs earlier. ``common[i]`` belongs to neighbours i - 1 and i."""
    n, best = len(order), np.full(len(order), -1)
    for way in (1, -1):
        stack: list[tuple[int, int]] = []  # (occurrence, least common part down to the one below)
        for k in range(n):
            i = k if way == 1 else n - 1 - k
            least = int(common[i] if way == 1 else common[i + 1]) if k else 0
            if k:
                while stack and stack[-1][0] > order[i]:
                    least = min(least, stack.pop()[1])
                if stack and stack[-1][0] < order[i]:
                    best[i] = max(best[i], least)
            stack.append((int(order[i]), least))
    return best


def repeat_groups(gram: np.ndarray, doc: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray,
                  n_before: np.ndarray, n_after: np.ndarray):
    """Matched strings among the contexts of a task: (member, bytes before, bytes after).

    *before* is reversed. Sorted by anchor and what follows, the intervals of the
    common-prefix tree are the groups of occurrences that share their right part. In an
    interval whose members differ to the left, each member's longest left extension
    shared with an earlier one is found by a second scan; in one that does not, the whole
    left context is shared.
    """
    n = len(gram)
    keys = np.concatenate((gram.astype(">u8").view(np.uint8).reshape(n, 8), after), axis=1)
    by_right = np.argsort(np.ascontiguousarray(keys).view(f"S{8 + LENGTH}").ravel(), kind="stable")
    left_key = np.ascontiguousarray(before).view(f"S{BEFORE}").ravel()
    left_rank = np.empty(n, np.int64)
    left_rank[np.argsort(left_key, kind="stable")] = np.arange(n)
    occurrence = np.empty(n, np.int64)
    occurrence[np.lexsort((place, doc))] = np.arange(n)

    def common(table, sizes, a, b):
        differ = table[a] != table[b]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
        return np.minimum(length, np.minimum(sizes[a], sizes[b]))

    lcp = np.zeros(n, np.int64)
    lcp[1:] = common(after, n_after, by_right[:-1], by_right[1:])
    lcp[1:][gram[by_right[1:]] != gram[by_right[:-1]]] = 0
    nodes = intervals(lcp, GRAM)
    members, lefts, rights = [], [], []
    twos = np.array([x for x in nodes if x[2] == x[1] + 1], np.int64).reshape(-1, 3)
    if len(twos):
        a, b = by_right[twos[:, 1]], by_right[twos[:, 2]]
        members.append(np.where(occurrence[a] > occurrence[b], a, b))
        lefts.append(common(before, n_before, a, b))
        rights.append(twos[:, 0])
    for depth, first, last in nodes:
        if last == first + 1:
            continue
        group = by_right[first:last + 1]
        group = group[np.argsort(left_rank[group], kind="stable")]
        shared = np.zeros(len(group), np.int64)
        shared[1:] = common(before, n_before, group[:-1], group[1:])
        if shared[1:].min() == BEFORE:  # not diverse to the left
            longest = np.where(occurrence[group] == occurrence[group].min(), -1, BEFORE)
        elif shared.max() + depth < LENGTH:
            continue
        else:
            longest = longest_earlier(shared, occurrence[group])
        members.append(group)
        lefts.append(longest)
        rights.append(np.full(len(group), depth))
    if not members:
        none = np.zeros(0, np.int64)
        return none, none, none
    member, left, right = map(np.concatenate, (members, lefts, rights))
    long = (left >= 0) & (left + right >= LENGTH)
    return member[long], left[long], right[long]


def numbered_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text) with ``doc`` in the order that says which document is earlier:
    doc_id itself, or a position where ids repeat or are null (then text hashes break ties)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return ids.withColumn("doc", F.col("doc_id"))
    keys = ids.select("doc_id", F.xxhash64("text").alias("k")).distinct()
    places = ordered_position(keys, [], ["doc_id", "k"], "doc").select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), "doc")
    return ids.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k"))).drop("_d", "_k")


def repeated_parts(rows: DataFrame, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc, spans): per document of *rows* (doc, text) with any, the [start, end) parts
    that lie in a string of ``LENGTH`` bytes that also starts earlier; parts may overlap."""
    def sample(part: pa.RecordBatch) -> pa.RecordBatch:
        gram, context, row, place = anchors_of(*flat(part.column("text")))
        return record("gram context doc place", gram.view(np.int64), context.view(np.int64),
                      part.column("doc").take(pa.array(row)), place.astype(np.int32))
    sampled = map_texts(rows.select("doc", "text"), sample, "gram long, context long, doc long, place int")
    ordered = sampled.repartition(F.col("gram")).sortWithinPartitions("gram", "context", "doc", "place")
    settled = pin(ordered.mapInArrow(settle, "kind int, gram long, doc long, place int"))
    # where a document repeats as a row, its own anchors are not earlier ones
    whole = settled.where("kind = 0").select("doc", F.greatest(F.col("place") - BEFORE, F.lit(0)).alias("start"),
                                             (F.col("place") + LENGTH).alias("end"))
    edges = settled.where("kind = 1")
    per_anchor = edges.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    hot = per_anchor.where(F.col("n") > hot_anchor).select(F.col("gram").alias("_g"))
    tasks = max(1, -(-edges.count() // TASK_CONTEXTS))
    wanted = (edges.join(hot, F.col("gram") == F.col("_g"), "left")
              .groupBy("doc").agg(F.collect_list(F.struct("gram", "place", F.col("_g").isNotNull().alias("hot"))).alias("at")))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text, at in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "at")), strict=True):
                    raw = text.encode()
                    for x in at:
                        p = x["place"]
                        left, right = raw[max(0, p - BEFORE):p][::-1], raw[p:p + LENGTH]
                        out.append((x["gram"], doc, p, x["hot"], len(left), len(right),
                                    left.ljust(BEFORE, b"\xff"), right.ljust(LENGTH, b"\xff")))
                columns = list(zip(*out, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield record("gram doc place hot n_before n_after before after",
                             *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])
    contexts = rows.select("doc", "text").join(wanted, "doc").mapInArrow(
        cut, "gram long, doc long, place int, hot boolean, n_before int, n_after int, before binary, after binary")

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        gram, doc, place, n_before, n_after = (frame[c].to_numpy() for c in ("gram", "doc", "place", "n_before", "n_after"))
        before = np.frombuffer(b"".join(frame.before), np.uint8).reshape(-1, BEFORE)
        after = np.frombuffer(b"".join(frame.after), np.uint8).reshape(-1, LENGTH)
        member, left, right = repeat_groups(gram, doc, place, before, after, n_before, n_after)
        return pd.DataFrame({"doc": doc[member], "start": place[member] - left, "end": place[member] + right})

    scanned = contexts.where("NOT hot").groupBy(F.pmod(F.xxhash64("gram"), F.lit(tasks)).alias("task")).applyInPandas(
        scan, "doc long, start int, end int")
    # an anchor with very many contexts: its windows are grouped by their bytes instead
    windows = (contexts.where("hot")
               .withColumn("o", F.explode(F.sequence(F.greatest(F.lit(0), LENGTH - F.col("n_after")), F.col("n_before"))))
               .withColumn("w", F.concat(F.expr("substring(before, 1, o)"), F.lit(b"\xff"), F.expr(f"substring(after, 1, {LENGTH} - o)")))
               .select("doc", (F.col("place") - F.col("o")).alias("start"), F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(1), "w").alias("w2"))
               .distinct())
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("low"))
    later = (windows.join(earliest, ["w1", "w2"]).where(F.struct("doc", "start") > F.col("low"))
             .select("doc", "start", (F.col("start") + LENGTH).alias("end")))
    parts = whole.unionByName(scanned)
    if hot.limit(1).count():
        parts = parts.unionByName(later)
    return parts.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one document


def remove_repeats(docs: DataFrame, with_bytes: bool = False, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Per row of *docs* (doc_id, text; other columns are ignored): doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and, if wanted, ``kept``: the remaining bytes.

    A byte goes if a string of ``LENGTH`` bytes over it also starts earlier, in a smaller
    doc_id or before it in the same text; strings are judged on the input. A null text is
    empty. Rows that repeat doc_id and text are one document and all give its row; texts
    under one doc_id that differ follow each other by a hash.
    """
    rows = numbered_documents(docs)
    judged = rows.dropDuplicates(["doc"]) if rows.groupBy("doc").count().where("count > 1").limit(1).count() else rows
    spans = repeated_parts(judged, hot_anchor).withColumnRenamed("doc", "_doc")

    def remove(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw = (text or "").encode()
            cover = np.zeros(len(raw) + 1, np.int64)
            for s in spans or ():
                cover[s["start"]] += 1
                cover[min(s["end"], len(raw))] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            rise = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((doc_id, len(raw), int(gone.sum()), rise, hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array(c, k) for c, k in zip(
            list(zip(*out, strict=True)) or [()] * 6,
            (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        names = "doc_id n_bytes n_removed n_spans kept_sha256" + " kept" * with_bytes
        return record(names, *columns[:5 + with_bytes])
    joined = rows.join(spans, F.col("doc") == F.col("_doc"), "left").select("doc_id", "text", "spans")
    return map_texts(joined, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                     + ", kept binary" * with_bytes)
