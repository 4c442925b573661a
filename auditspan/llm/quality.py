"""Quality rules: distribution divergence from language references."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import Rolling, flat, grams, map_texts, non_space, record, runs, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Character classes of the histogram, by leading byte of a code point.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond")
TOP_WORDS, MAX_CHARACTERS, MAX_WORDS = 64, 0.3, 0.35
#: Fewer words or characters than these say too little for a verdict.
GUARD_WORDS, GUARD_CHARACTERS = 50, 200
#: Documents with words, and words, that make a reference.
REFERENCE_DOCUMENTS, REFERENCE_WORDS = 10, 1000
#: Word counts at which the sampling noise of a reference is drawn, draws, and the share
#: of true samples of the reference that may lie beyond the noise.
NOISE_WORDS, NOISE_DRAWS, NOISE_SHARE = (10, 15, 25, 35, 50, 60, 75, 100, 125, 150, 200, 250, 350, 500, 1000), 4000, 0.001
FLUSH = 1 << 18


def class_table() -> np.ndarray:
    """Class of a byte; bytes that continue a code point get one class more."""
    table = np.full(256, CLASSES.index("other"), np.int64)
    for first, end, name in ((0x61, 0x7B, "lower"), (0x41, 0x5B, "upper"), (0x30, 0x3A, "digit")):
        table[first:end] = CLASSES.index(name)
    table[list(b" \t\n\v\f\r")] = CLASSES.index("space")
    table[list(b".,;:!?'\"-()")] = CLASSES.index("stop")
    table[list(SYMBOLS)] = CLASSES.index("symbol")
    table[0xC0:] = CLASSES.index("beyond")
    table[0x80:0xC0] = len(CLASSES)
    return table


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of *values* between consecutive *starts*."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def class_histogram(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows x classes counts of code points."""
    kind, n = class_table()[data], len(CLASSES)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.bincount(row * (n + 1) + kind, minlength=(len(starts) - 1) * (n + 1)).reshape(-1, n + 1)[:, :n]


def repeated_words(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words per row inside a window of words that the row has at least twice."""
    gram, at = grams(hashes, rows, WINDOW)
    if not len(gram):
        return np.zeros(n_rows, np.int64)
    order = np.lexsort((gram, rows[at]))
    same = (gram[order][1:] == gram[order][:-1]) & (rows[at][order][1:] == rows[at][order][:-1])
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n_rows)


def duplicate_lines(data: np.ndarray, starts: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Lines per row that have a word and equal an earlier line of the row."""
    table = np.ones(256, bool)
    table[0x0A] = False
    first, end, row = runs(data, starts, table)
    words = np.concatenate(([0], np.cumsum(non_space()[data], dtype=np.int64)))
    worded = words[end] > words[first]
    first, end, row = first[worded], end[worded], row[worded]
    hashes = rolling.of(first, end)
    order = np.lexsort((hashes, row))
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order[1:][same]], minlength=len(starts) - 1)


def measure_slice(part: pa.RecordBatch):
    data, starts = flat(part.column("text"))
    rows = len(starts) - 1
    rolling = Rolling(data)
    first, end, row = runs(data, starts, non_space())
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    word_chars = np.bincount(row, weights=points[end] - points[first], minlength=rows).astype(np.int64)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    hashes = rolling.of(first, end)
    base = (np.bincount(row, minlength=rows), word_chars, row_sums(symbols[data], starts),
            duplicate_lines(data, starts, rolling), repeated_words(hashes, row, rows))
    return base, class_histogram(data, starts), hashes, row


def language_references(docs: DataFrame) -> DataFrame:
    """One row per language: class counts and the most frequent words with their counts,
    over the whole texts of *docs*. A null language gives none, nor does one with fewer than
    ``REFERENCE_DOCUMENTS`` documents or ``REFERENCE_WORDS`` words, which would mirror its few
    texts. Word counts are summed per task before they are shuffled."""
    def count(batches):
        bags: dict = {}
        size = 0

        def flush():
            for lang, (classes, parts) in bags.items():
                word = np.concatenate([w for w, _ in parts])
                times = np.concatenate([t for _, t in parts])
                found, back = np.unique(word, return_inverse=True)
                sums = np.bincount(back, weights=times).astype(np.int64)
                yield record("lang word n classes", pa.array([lang] * len(found), pa.string()),
                             found.view(np.int64), sums, pa.nulls(len(found), pa.list_(pa.int64())))
                yield record("lang word n classes", pa.array([lang], pa.string()),
                             pa.array([None], pa.int64()), np.zeros(1, np.int64),
                             pa.array([classes.tolist()], pa.list_(pa.int64())))
            bags.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = flat(part.column("text"))
                first, end, row = runs(data, starts, non_space())
                hashes, histogram = Rolling(data).of(first, end), class_histogram(data, starts)
                has = np.bincount(row, minlength=part.num_rows) > 0
                histogram = np.column_stack((histogram, has))
                codes = part.column("lang").dictionary_encode()
                index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for k, lang in enumerate(codes.dictionary.to_pylist()):
                    if not (own := index == k).any():
                        continue
                    found, times = np.unique(hashes[own[row]], return_counts=True)
                    classes, parts = bags.setdefault(lang, [np.zeros(len(CLASSES) + 1, np.int64), []])
                    bags[lang][0] = classes + histogram[own].sum(axis=0)
                    parts.append((found, times))
                    size += len(found)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = docs.where("lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        count, "lang string, word long, n long, classes array<long>")
    per_word = counted.groupBy("lang", "word").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    heaviest = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    # two rounds, so that no task orders all words of a language
    slice_of = Window.partitionBy("lang", F.pmod("word", F.lit(64))).orderBy(F.desc("n"), "word")
    words = (per_word.where("word IS NOT NULL")
             .withColumn("_r", F.row_number().over(slice_of)).where(F.col("_r") <= TOP_WORDS)
             .withColumn("_r", F.row_number().over(heaviest)).where(F.col("_r") <= TOP_WORDS)
             .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_r", "word", "n"))).alias("words")))
    classes = per_word.where("word IS NULL").select(
        "lang", F.array(*[F.col(f"c{k}") for k in range(len(CLASSES))]).alias("classes"),
        F.col(f"c{len(CLASSES)}").alias("n_docs")).where(F.col("n_docs") >= REFERENCE_DOCUMENTS)
    totals = per_word.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n_words")).where(
        F.col("n_words") >= REFERENCE_WORDS)
    return classes.join(words, "lang").join(totals, "lang")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of every row of *p* from *q*."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2

    def against(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.sqrt(np.clip((against(p) + against(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def sampling_noise(q: np.ndarray) -> np.ndarray:
    """Distance from *q* that all but ``NOISE_SHARE`` of its own samples keep, for samples
    of ``NOISE_WORDS`` words; by a fixed seed."""
    rng = np.random.default_rng(29)
    q = q / q.sum()
    return np.array([np.quantile(divergence(rng.multinomial(n, q, NOISE_DRAWS).astype(float), q), 1 - NOISE_SHARE)
                     for n in NOISE_WORDS])


def quality_rules(docs: DataFrame, max_characters: float = MAX_CHARACTERS,
                  max_words: float = MAX_WORDS) -> DataFrame:
    """Counts and verdict per row of *docs* (doc_id, text, lang; other columns are ignored).

    A document fails when its character classes lie further than *max_characters*, or its
    common words further than *max_words*, from every language reference (Jensen-Shannon
    distance, 1 if there is no reference; then nothing fails by it). The fewer words a text
    has, the further chance alone takes it; the limit for words is never below the
    ``sampling_noise`` of the reference at that count. Texts under ``GUARD_WORDS`` words or ``GUARD_CHARACTERS``
    characters keep the base verdict. A null or empty text has zero counts and fails the
    base rule. Repeated rows each give a row. Languages are few by nature, so their
    references (``TOP_WORDS`` words each) travel with the tasks.
    """
    references = []
    for r in language_references(docs).toLocalIterator():
        times = np.array([w.n for w in r.words], float)
        times = np.append(times, r.n_words - times.sum())
        references.append((np.array(r.classes, float), np.array([w.word for w in r.words], np.int64).view(np.uint64),
                           times, np.maximum(sampling_noise(times), max_words)))

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        (n_words, word_chars, n_symbols, n_dup, n_repeat), histogram, hashes, row = measure_slice(part)
        rows = part.num_rows
        characters, common, beyond = np.ones(rows), np.ones(rows), np.full(rows, len(references) > 0)
        for classes, words, times, limit in references:
            characters = np.minimum(characters, divergence(histogram, classes))
            order = np.argsort(words)
            at = np.searchsorted(words[order], hashes).clip(max=len(words) - 1)
            column = np.where(words[order][at] == hashes, order[at], len(words))
            width = len(words) + 1
            counts = np.bincount(row * width + column, minlength=rows * width).reshape(rows, width)
            distance = divergence(counts, times)
            common = np.minimum(common, distance)
            beyond &= distance > np.interp(n_words, NOISE_WORDS, limit)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
        enough = (n_words >= GUARD_WORDS) & (histogram.sum(axis=1) >= GUARD_CHARACTERS)
        far = enough & (((characters > max_characters) & (len(references) > 0)) | beyond)
        return record("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
                      "class_distance word_distance", part.column("doc_id"), n_words, word_chars, n_symbols,
                      n_dup, n_repeat, failed, ~failed & ~far, characters, common)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), judge,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, kept boolean, class_distance double, "
                     "word_distance double")
