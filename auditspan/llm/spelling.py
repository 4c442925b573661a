"""Spelling variants: Gram matrices of letter counts find words one edit apart."""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import pin
from .texts import Rolling, flat, map_texts, record, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: Letters are dealt to so many groups by rank in ORDER; an edit changes two groups at most, so two words
#: one edit apart agree in some GROUPS - 2 of them.
GROUPS = 4
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
#: Words that share a key beyond which the key is cut into parts; words of one matrix product.
BLOCK_WORDS, PRODUCT_WORDS = 2048, 256
#: Pairs that are compared letter by letter at a time.
PAIRS = 100_000
#: Runs beyond this length are hashed one by one.
LONG_RUN = 64
CRC = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32)


def letter_runs(data: np.ndarray, starts: np.ndarray):
    """(first byte, end, row) of maximal runs of A-Z, a-z and U+00C0 to U+00FF. In UTF-8 the latter
    are 0xC3 and one byte."""
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0xC3] = True
    two = np.flatnonzero(data == 0xC3) + 1
    marks = data.copy()
    marks[two] = 0x61
    return runs(marks, starts, table)


def checksums(data: np.ndarray, first: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from *state* (the crc32 of what comes before it); all runs a byte at a time."""
    # table[k] of the reflected polynomial follows from crc32 of one byte
    table = CRC ^ CRC[0]
    length = end - first
    order = np.argsort(-length, kind="stable")
    start, length, crc = first[order], length[order], ~state[order]
    many = np.searchsorted(-length, -LONG_RUN, "left")
    for k in range(many):
        a, b = int(start[k]), int(start[k] + length[k])
        crc[k] = ~np.uint32(zlib.crc32(data[a:b].tobytes(), int(~crc[k])))
    start, rest = start[many:], length[many:]
    for k in range(int(rest[0]) if len(rest) else 0):
        live = np.searchsorted(-rest, -k, "left")
        part = crc[many:many + live]
        part[:] = table[(part ^ data[start[:live] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def word_counts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case. Where *every* divides the crc32 of
    ``<doc_id>:<run>``, the run loses the code point at that crc32 modulo its length. Equal
    words of a slice of texts are counted before they leave the task."""
    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = flat(part.column("text"))
        data = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
        first, end, row = letter_runs(data, starts)
        before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in part.column("doc_id").to_pylist()], np.uint32)
        crc = checksums(data, first, end, before[row])
        cut = crc % np.uint32(every) == 0
        words, times = [], []
        hashes, at, n = np.unique(Rolling(data).of(first[~cut], end[~cut]), return_index=True, return_counts=True)
        whole = data.tobytes()
        for a, b in zip(first[~cut][at].tolist(), end[~cut][at].tolist(), strict=True):
            words.append(whole[a:b].decode())
        times += n.tolist()
        for a, b, h in zip(first[cut].tolist(), end[cut].tolist(), crc[cut].tolist(), strict=True):
            run = whole[a:b].decode()
            spot = h % len(run)
            words.append(run[:spot] + run[spot + 1:])
            times.append(1)
        return record("word n", pa.array(words, pa.string()), pa.array(times, pa.int64()))
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return map_texts(ids, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, filled up with 0, and how often each letter occurs: those of ORDER,
    then U+00C0 to U+00FF. Letter k is in group k modulo GROUPS."""
    length = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(length.max(initial=0))), np.uint16)
    inside = np.arange(codes.shape[1]) < length[:, None]
    codes[inside] = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
    column = np.arange(0x100) - 0xC0 + len(ORDER)
    column[[ord(c) for c in ORDER]] = np.arange(len(ORDER))
    width = len(ORDER) + 0x40
    cell = np.nonzero(inside)[0] * width + column[codes[inside]]
    return codes, np.bincount(cell, minlength=len(words) * width).reshape(-1, width).astype(np.float32)


def one_edit(codes: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b (of lengths that differ by one at most) are exactly one inserted, deleted or replaced code point apart."""
    short, long = np.where(length[a] <= length[b], a, b), np.where(length[a] <= length[b], b, a)
    width = codes.shape[1]
    least = length[short]
    differs = codes[short] != codes[long]
    differs[np.arange(width) >= least[:, None]] = True
    ahead = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    # the same from the end
    k = np.arange(width)
    back_s, back_l = least[:, None] - 1 - k, length[long][:, None] - 1 - k
    unequal = (np.take_along_axis(codes[short], np.maximum(back_s, 0), 1)
               != np.take_along_axis(codes[long], np.maximum(back_l, 0), 1)) | (back_s < 0)
    behind = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
    same = length[a] == length[b]
    return np.where(same, ahead + behind == least - 1, ahead + behind >= least)


#: Pairs of letter groups; two near words agree in some of them.
CHOICES = [(a, b) for a in range(GROUPS) for b in range(a + 1, GROUPS)]


def group_keys(counts: np.ndarray) -> list[np.ndarray]:
    """For each pair of letter groups a number made of the letter counts in it."""
    salt = np.random.default_rng(5).integers(1, 1 << 62, counts.shape[1]) | 1
    own = [counts[:, g::GROUPS].astype(np.int64) @ salt[g::GROUPS] for g in range(GROUPS)]
    return [own[a] * 31 + own[b] for a, b in CHOICES]


def products(bucket: np.ndarray, counts: np.ndarray, length: np.ndarray, side: np.ndarray | None):
    """(left, right) rows of one bucket at the squared distance that one edit has: 2 at equal length, 1
    between adjacent lengths. Rows are sorted by bucket and length; small buckets share a product, a large one
    takes PRODUCT_WORDS rows times those of the same and the next length."""
    square = (counts * counts).sum(axis=1)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
    left, right, lo = [], [], 0
    while lo < len(bucket):
        hi = int(cuts[max(np.searchsorted(cuts, lo + PRODUCT_WORDS, "right") - 1, np.searchsorted(cuts, lo, "right"))])
        for top in range(lo, hi, PRODUCT_WORDS):
            end = min(top + PRODUCT_WORDS, hi)
            stop = hi if hi - lo <= PRODUCT_WORDS else top + int(np.searchsorted(length[top:hi], length[end - 1] + 1, "right"))
            apart = np.abs(length[top:end, None] - length[top:stop])
            near = square[top:end, None] + square[top:stop] - 2 * (counts[top:end] @ counts[top:stop].T) + apart == 2
            x, y = np.nonzero(near)
            x, y = x + top, y + top
            keep = (x < y) & (bucket[x] == bucket[y])
            if side is not None:
                keep &= side[x] != side[y]
            left.append(x[keep])
            right.append(y[keep])
        lo = hi
    return np.concatenate(left), np.concatenate(right)


def compared(words: list[str], n: np.ndarray, choice: np.ndarray, key: np.ndarray, side: np.ndarray | None = None) -> pd.DataFrame:
    """(word, n_near, form, form_n) from whole buckets (choice, key), or between the two sides of parts of one."""
    codes, counts = letter_matrix(words)
    length = np.array([len(w) for w in words])
    order = np.lexsort((length, key, choice))
    bucket = np.cumsum((np.diff(choice[order], prepend=-1) != 0) | (np.diff(key[order], prepend=key[order[0]]) != 0))
    a, b = products(bucket, counts[order], length[order], None if side is None else side[order])
    a, b = order[a], order[b]
    keep = np.concatenate([np.zeros(0, bool)] + [one_edit(codes, length, a[k:k + PAIRS], b[k:k + PAIRS])
                                                 for k in range(0, len(a), PAIRS)])
    a, b = a[keep], b[keep]
    agree = [(counts[a, g::GROUPS] == counts[b, g::GROUPS]).all(axis=1) for g in range(GROUPS)]
    first = np.stack([agree[p] & agree[q] for p, q in CHOICES]).argmax(axis=0)  # a pair counts in one bucket only
    a, b = a[first == choice[a]], b[first == choice[a]]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    spelled = np.array(words, object)
    found = pd.DataFrame({"word": spelled[a], "form": spelled[b], "form_n": n[b]})
    found = found.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    return found.groupby("word", sort=False).agg(
        n_near=("form", "size"), form=("form", "first"), form_n=("form_n", "first")).reset_index()


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have a near word: how many, and
    the one of largest n, the first in code point order among equals.

    A word stands in one bucket for each pair of letter groups, keyed by its letter counts in these groups: any two
    near words share such a bucket. Inside, words are sorted into length blocks; products of the letter counts of equal
    and adjacent lengths give all squared distances, only pairs at the distance of one edit are
    compared letter by letter, and a pair counts in the first bucket that it shares. A bucket of more than *block_words* is cut
    into parts, and every pair of parts is a task. What leaves a task is one row per word.
    """
    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                _, counts = letter_matrix(batch.column("word").to_pylist())
                for c, key in enumerate(group_keys(counts)):
                    yield record("word n choice key", batch.column("word"), batch.column("n"), np.full(batch.num_rows, c, np.int32), key)
    shelved = words.mapInArrow(keys, "word string, n long, choice int, key long")
    place, schema = ["choice", "key"], "word string, n_near long, form string, form_n long"
    large = pin(shelved.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_words).withColumn(
        "parts", F.floor((F.col("size") - 1) / block_words) + 1))

    def whole(batches):
        """Buckets of a partition one after the other; the last of a batch waits for the next batch."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            choice, key = rows.column("choice").to_numpy(), rows.column("key").to_numpy()
            cut = int(np.flatnonzero((choice != choice[-1]) | (key != key[-1]))[-1]) + 1 if len(key) and (
                (choice != choice[-1]) | (key != key[-1])).any() else 0
            rest = rows.slice(cut)
            if cut:
                yield rows.slice(0, cut)
        if rest is not None and rest.num_rows:
            yield rest

    def small(batches):
        for rows in whole(b for b in batches if b.num_rows):
            found = compared(rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("choice").to_numpy(),
                             rows.column("key").to_numpy())
            yield pa.RecordBatch.from_pandas(found, schema=pa.schema([
                ("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]), preserve_index=False)
    few = (shelved.join(large, place, "left_anti").select("word", "n", *place)
           .repartition(*place).sortWithinPartitions(*place).mapInArrow(small, schema))
    spread = (shelved.join(large, place).withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
              .select("word", "n", *place, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))

    def pair(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return compared(frame.word.tolist(), frame.n.to_numpy(), frame.choice.to_numpy(), frame.key.to_numpy(),
                        frame.part.to_numpy() if key[2] != key[3] else None)
    many = spread.groupBy(*place, "i", "j").applyInPandas(pair, schema)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return few.unionByName(many).groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the chain of forms. Every round doubles the
    distance that a word has moved; counts at least double along a chain, so it ends."""
    now = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = pin(now.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("more")))
        now = moved.select("word", "root")
        if not moved.where("more").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of *docs* (doc_id, text; other columns are
    ignored) of at least *least_length* code points and *least_count* occurrences, see :func:`word_counts`.

    Words are near if exactly one inserted, deleted or replaced code point sets them apart. ``form``
    is the near word of largest n, the first in code point order among equals, if that n is at least
    twice the word's own; ``root`` follows forms to the last and is the word itself without one.
    Null, empty and letterless texts give no words; a null doc_id is written as nothing in
    ``<doc_id>:<run>``. Repeated rows count again. An empty table gives no rows. Only distinct words are
    compared, whatever their counts.
    """
    words = pin(word_counts(docs, every).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)))
    near = pin(near_words(words))
    with_form = words.join(near, "word", "left").withColumn("likely", F.col("form_n") >= 2 * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("likely"), F.col("form")).alias("form"), F.when(F.col("likely"), F.col("form_n")).alias("form_n"))
    with_form = pin(with_form)
    ends = roots(with_form.where("form IS NOT NULL"))
    return with_form.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
