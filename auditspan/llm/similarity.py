"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import pin
from .graphs import components
from .texts import Rolling, flat, grams, map_texts, mix, non_space, record, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9999, 160
#: n-grams and texts that a verification task holds of one side; texts that it compares
#: with all others at a time.
TASK_GRAMS, TASK_TEXTS, TASK_ROWS = 400_000, 4000, 512


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The most rows a band may have so that a pair at *threshold* meets in some band with
    probability *recall* and no more than *hashes* hashes are needed."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        bands = 1 if threshold >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def word_grams(column: pa.Array, n: int):
    """Hash, row of every n-gram; the words of a shorter text are one gram. Also two
    hashes of each row's word sequence and its word count."""
    data, starts = flat(column)
    rows = len(starts) - 1
    first, end, row = runs(data, starts, non_space())
    words = Rolling(data).of(first, end)
    count = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    keys = []
    for salt in (1, 2):
        own = mix(words ^ mix(np.full(1, salt, np.uint64))) * mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own)))
        stop = np.cumsum(count)
        keys.append(total[stop] - total[stop - count])
    gram, at = grams(words, row, n)
    short = np.flatnonzero((count > 0) & (count < n))
    return (np.concatenate((gram, mix(keys[0][short]))), np.concatenate((row[at], short)), keys, count)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, k1, k2, words, bands): hashes of the word sequence and one per band."""
    scale = np.random.default_rng(23).integers(1, 1 << 32, (bands * rows, 2), dtype=np.uint64)

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        gram, row, keys, count = word_grams(part.column("text"), n)
        order = np.argsort(row, kind="stable")
        gram, row = (gram[order] >> np.uint64(32)).astype(np.uint32), row[order]
        has, begin = np.unique(row, return_index=True)
        band = np.zeros((part.num_rows, bands), np.uint64)
        for k, (a, b) in enumerate(scale.astype(np.uint32)):
            low = np.minimum.reduceat(gram * (a | np.uint32(1)) + b, begin) if len(begin) else np.zeros(0, np.uint32)
            band[has, k // rows] = mix(band[has, k // rows] * np.uint64(31) + low)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * bands, pa.int32()),
                                         pa.array(band.ravel().view(np.int64)))
        return record("doc_id key k1 k2 words bands", part.column("doc_id"), part.column("key"),
                      keys[0].view(np.int64), keys[1].view(np.int64), count, lists)
    return map_texts(docs, sign, "doc_id long, key long, k1 long, k2 long, words long, bands array<long>")


def linked(rep: np.ndarray, weight: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], threshold: float):
    """Links between texts of different sides (or all links without sides): per text the
    linked texts and documents, and the smallest text of its part of the graph. Only n-grams that
    two texts share take part in the products. Only the links themselves, a bit for every
    pair, are held for all texts at once."""
    n = len(rep)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), size.astype(int))
    gram = np.concatenate(sets)
    found, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[inverse] > 1
    owner, spot = owner[shared], column[inverse[shared]]
    order = np.argsort(spot, kind="stable")
    owner, spot = owner[order], spot[order]
    width = max(64, (1 << 22) // max(n, 1))
    chunks = []
    for lo in range(0, int(spot[-1]) + 1 if len(spot) else 0, width):
        a, b = np.searchsorted(spot, (lo, lo + width))
        chunks.append((owner[a:b], spot[a:b] - lo))
    bits = np.zeros((n, -(-n // 8)), np.uint8)
    n_texts, n_docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for top in range(0, n, TASK_ROWS):
        end = min(top + TASK_ROWS, n)
        both = np.zeros((end - top, n), np.float32)
        for own, at in chunks:
            table = np.zeros((n, width), np.float32)
            table[own, at] = 1
            both += table[top:end] @ table.T
        near = both >= threshold * (size[top:end, None] + size[None, :] - both) - 1e-9
        near[np.arange(end - top), np.arange(top, end)] = False
        if side is not None:
            near &= side[top:end, None] != side[None, :]
        n_texts[top:end], n_docs[top:end] = near.sum(axis=1), near @ weight
        bits[top:end] = np.packbits(near, axis=1)
    parent = np.arange(n)
    while True:  # smallest neighbour, then its own smallest, until nothing moves
        low = parent.copy()
        for top in range(0, n, TASK_ROWS):
            near = np.unpackbits(bits[top:top + TASK_ROWS], axis=1, count=n).view(bool)
            low[top:top + TASK_ROWS] = np.minimum(low[top:top + TASK_ROWS], np.where(
                near, parent[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    return n_texts, n_docs, rep[parent]


def text_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, class, copy_id, n_links, n_linked_texts) per row of *docs* (doc_id, text;
    other columns are ignored), with ``key`` a hash of the text.

    Texts with equal word sequences are copies; ``copy_id`` is the smallest doc_id among
    them (null if none has an id). Different texts are linked if their sets of *n*-word shingles have a Jaccard
    similarity of *threshold* or more; texts that links reach have the same ``class``, a number from
    hashes of word sequences, so that neither null nor clashing ids lose or merge texts. ``n_links`` counts linked documents, copies included, ``n_linked_texts``
    different texts. A text of fewer than *n* words is one shingle; null, empty and
    wordless texts are copies of each other. Repeated rows are copies.

    One text of each copy group goes on. Texts that share a band hash are candidates:
    a bucket links its members to its smallest text, so no bucket is expanded into pairs,
    and the components of these stars are verified whole, on full sets. A component is cut
    into blocks of about ``TASK_GRAMS`` n-grams or ``TASK_TEXTS`` texts; a task takes two blocks and returns one
    row per text.
    """
    bands, rows = bands_and_rows(threshold, recall)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    node = F.xxhash64("k1", "k2", "words")
    signed = pin(signatures(ids, n, bands, rows))
    texts = pin(signed.groupBy("k1", "k2", "words").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "key")).alias("row"),
        F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands")).withColumn("node", node))
    members = texts.where("words > 0").select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = members.join(buckets, ["band", "hash"]).select(F.col("node").alias("a"), F.col("low").alias("b"))
    candidates = components(stars).join(
        texts.select("node", "copies", "words", "row"), "node")
    sizes = candidates.groupBy("component").agg(F.sum("words").alias("total"), F.count(F.lit(1)).alias("n"))
    spread = max(1, -(-int(sizes.agg(F.sum("total")).first()[0] or 1) // TASK_GRAMS))
    blocks = F.greatest(F.col("total") / TASK_GRAMS, F.col("n") / TASK_TEXTS).cast("long") + 1
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                    lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j"))))
    placed = (candidates.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", own)
              .withColumn("pair", F.explode(pairs))
              .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(spread))).otherwise(
                  F.xxhash64("component", "pair"))))
    wanted = candidates.select(F.col("row.doc_id").alias("_d"), F.col("row.key").alias("_k"))
    text_of = ids.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("text")

    def gram_sets(part: pa.RecordBatch) -> pa.RecordBatch:
        gram, row, keys, count = word_grams(part.column("text"), n)
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        gram, row = gram[first], row[first]
        cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
        sets = [gram[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return record("k1 k2 words grams", keys[0].view(np.int64), keys[1].view(np.int64), count,
                      pa.array(sets, pa.binary()))
    sets = map_texts(text_of, gram_sets, "k1 long, k2 long, words long, grams binary").groupBy(node.alias("node")).agg(
        F.first("grams").alias("grams"))  # equal for equal keys

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["component", "i", "j"], sort=False):
            part = part.sort_values("node")
            two = part.i.iloc[0] != part.j.iloc[0]
            side = (part.block == part.j).to_numpy() if two else None
            found = linked(part.node.to_numpy(), part.copies.to_numpy(), side,
                           [np.frombuffer(g, np.uint64) for g in part.grams], threshold)
            out.append(pd.DataFrame({"node": part.node, "n_texts": found[0], "n_docs": found[1], "low": found[2]}))
        return pd.concat(out)

    work = placed.join(sets, "node").select(
        "task", "component", F.when(F.col("blocks") == 1, 0).otherwise(F.col("block")).alias("block"),
        "pair.i", "pair.j", "node", "copies", "grams")
    checked = pin(work.groupBy("task").applyInPandas(verify, "node long, n_texts long, n_docs long, low long"))
    counts = checked.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    classes = components(checked.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_text = (texts.join(counts, "node", "left").join(classes, "node", "left")
                .select("k1", "k2", "words", "node", "rep", "copies", "n_texts", "n_docs", "component"))
    return signed.select("doc_id", "key", "k1", "k2", "words").join(per_text, ["k1", "k2", "words"]).select(
        "doc_id", "key", F.coalesce("component", "node").alias("class"), F.col("rep").alias("copy_id"),
        (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_linked_texts"))


def jaccard_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_linked_texts) per row of *docs*: ``text_classes``
    with the smallest doc_id of each class, null if none has an id."""
    rows = pin(text_classes(docs, n, threshold, recall))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "class").select("doc_id", "class_id", "copy_id", "n_links", "n_linked_texts")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The row of *docs* (doc_id, text and any others) with the least doc_id of each class of
    near duplicates; a null doc_id only where no other is. Of rows that repeat doc_id and
    text the least by all columns stays."""
    rows = pin(text_classes(docs).select("doc_id", "key", "class"))
    keep = rows.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s"),
    ).select(F.col("s.doc_id").alias("_d"), F.col("s.key").alias("_k"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    stay = keyed.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    # told from ids and hashes of texts, so that no text is stored for it
    repeated = rows.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if repeated.isEmpty():
        return stay.select(*docs.columns)
    same = stay["_d"].eqNullSafe(repeated["_d"]) & (stay["_k"] == repeated["_k"])
    more = stay.join(repeated, same, "left_semi")
    return stay.join(repeated, same, "left_anti").select(*docs.columns).unionByName(
        more.groupBy("_d", "_k").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*"))
