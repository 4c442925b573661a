"""Whitening, sketch dedup and spelling variants against brute force; the registered queries on a
folder of small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspan.llm import queries, sketches, spelling, whitening

from .conftest import prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- whitening ------------------------------------------------------------------------------
def vectors_of(rng, n=60, width=5):
    rows = [(k, [rng.gauss(0, 1 + j) for j in range(width)], "x") for k in range(n)]
    rows += [(n + k, rows[0][1], "copy") for k in range(90)]  # a vector that most rows hold
    rows += [(500, None, "x"), (501, [1.0, None, 0.0, 0.0, 0.0], "x"), (502, [math.nan] * width, "x"),
             (503, [math.inf] + [0.0] * (width - 1), "x"), (None, rows[1][1], "x"), (3, rows[3][1], "x"),
             (504, [], "x"), (505, [1e30] + [0.0] * (width - 1), "x")]
    return rows


def brute_whitening(rows, weights_of=None):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows])
    if weights_of == "distinct":
        fit = np.unique(x, axis=0)
    else:
        fit = x
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    white = (x - s / n) @ directions[:, order] / np.sqrt(values[order])
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, white, values[order] / values.sum()


@pytest.mark.parametrize("multiplicity", [True, False])
def test_whitening(spark, multiplicity):
    rows = vectors_of(random.Random(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h1 string").withColumn("weight", F.lit(7))
    got = whitening.whitened_vectors(df, components=4, multiplicity=multiplicity).collect()
    used = [r for r in rows if r[0] not in (500, 501, 502, 503, 504, 505)]
    n, deviation, white, explained = brute_whitening(used, None if multiplicity else "distinct")
    assert len(got) == 4 * len(used)
    by_row = defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
        assert r.n == n and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    for (vec_id, _, _), d, w in zip(used, deviation, white, strict=True):
        own = by_row[vec_id]
        assert {r.deviation for r in own} == {d}
        for r in own:
            assert abs(r.whitened) == pytest.approx(abs(w[r.component - 1]), abs=1e-9)
    signs = {(r.component, np.sign(r.whitened) == np.sign(white[k][r.component - 1]))
             for k, (i, _, _) in enumerate(used) for r in by_row[i] if abs(r.whitened) > 1e-6}
    assert len(signs) == 4  # either sign, the same for all rows


def test_whitening_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    one = whitening.whitened_vectors(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None
                                 and r.deviation == 0 and r.n == 2 for r in one)
    assert whitening.whitened_vectors(spark.createDataFrame([], schema)).count() == 0
    two = whitening.whitened_vectors(spark.createDataFrame(
        [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 5.0]), (5, [2.0, 2.0])], schema)).collect()
    assert Counter(r.n for r in two) == {2: 2, 3: 6}  # a fit for each length


def test_exact_beyond_64_bits():
    x = np.array([[1 << 61, -(1 << 61)], [1 << 61, 5]])
    assert whitening.integer_sums(x, np.array([3, 4])) == [7 << 61, -(3 << 61) + 20]
    centre = whitening.Centre(2, [1 << 62, -(1 << 61) + 5])
    assert centre.deviations(x) == [None, None]


# ---- sketch dedup ------------------------------------------------------------------------------
def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k:k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def top(k):
        while part[k] != k:
            k = part[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                part[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        t = top(k)
        least[t] = i if least.get(t) is None else least[t] if i is None else min(i, least[t])
    return [(i, len(sets[k]), least[top(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def assert_components(spark, rows):
    got = sketches.sketch_components(
        spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS size")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows), key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_sketch_components(spark, cases):
    assert_components(spark, [(r[0], r[1]) for r in cases] + [(None, cases[8][1].upper()), (None, None), (700, "A b"), (701, "a B")])


def edited(rng, words, edits):
    out = list(words)
    for p in rng.sample(range(len(out)), edits):
        out[p] = prose(rng, 1) + "q"
    return " ".join(out)


def test_sketch_chains_and_rest(spark, monkeypatch):
    """Chains whose ends are unlike, and a group around a hidden centre; blocks of three texts."""
    monkeypatch.setattr(sketches, "BLOCK_TEXTS", 3)
    rng = random.Random(12)
    rows, now = [], prose(rng, 60).split()
    for k in range(40):
        rows.append((k, " ".join(now)))
        now[rng.randrange(len(now))] = prose(rng, 1)
    centre = prose(rng, 80).split()
    rows += [(100 + k, edited(rng, centre, 2)) for k in range(60)] + [(99, " ".join(centre))]
    rows += [(200 + k, edited(rng, centre, 1)) for k in range(30)]
    assert_components(spark, rows)
    for turns in (0, 1):
        monkeypatch.setattr(sketches, "STAR_ROUNDS", turns)
        assert_components(spark, [r for r in rows if r[0] % 3])


def test_sketch_empty(spark, none):
    assert sketches.sketch_components(none).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    one, two = (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in "ab")
    scale = rng.integers(1, 1 << 63, (512, 2), dtype=np.uint64)

    def sketch(x):
        return np.array([sketches.registers_of(np.array([(x * (a | np.uint64(1)) + b).min()]))[0] for a, b in scale])
    a, b = sketch(np.concatenate((one, two[:400]))), sketch(two)
    assert (sketch(np.concatenate((one, two))) == np.maximum(a, b)).all()
    for shared in (0.5, 0.85):  # the joint estimate follows the true similarity
        x = np.concatenate((one[:int(4000 * shared)], two[:int(4000 * (1 - shared))]))
        a, b = sketch(one), sketch(x)
        true = len(np.intersect1d(one, x)) / len(np.union1d(one, x))
        u = np.array([len(one) / (len(one) + len(x))])
        found = sketches.best_similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([(a == b).sum()]), u, 1 - u)
        assert found[0] == pytest.approx(true, abs=0.06)
    assert not sketches.plausible(sketch(one)[None], sketch(two)[None], np.array([4000.0]), np.array([4000.0]), 85)[0]


# ---- spelling ---------------------------------------------------------------------------------
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_spelling(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 2 * n:
            form[w] = best
        out[w] = (n, len(others))
    result = set()
    for w, (n, k) in out.items():
        root = w
        while root in form:
            root = form[root]
        result.add((w, form.get(w), root, n, k, counts[form[w]] if w in form else None))
    return result


def spelling_rows(rng):
    stems = ["letter", "LETTER", "lettér", "leter", "lettter", "better", "bitter", "ÀÈÌÒÙ", "àèìòù", "x×÷yzw", "naïveté"]
    stems += [prose(rng, 1) + "abcde" for _ in range(30)]
    stems += [s[:p] + rng.choice("abcé") + s[p + rng.randint(0, 1):] for s in stems for p in (0, len(s) // 2, len(s))]
    rows = [(k, " ".join(rng.choices(stems, weights=[1 / (j + 1) for j in range(len(stems))], k=120))) for k in range(40)]
    rows += [(None, None), (None, "letter letter better"), (7, ""), (8, "12 34 -"), (9, "é" * 70 + " " + "q" * 3000), rows[0], rows[0]]
    return rows + [(k, "é" * 70 + "!" + "é" * 71) for k in range(50, 56)]


@pytest.mark.parametrize("every", [97, 5])
def test_spelling(spark, every):
    rows = spelling_rows(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word", "3 AS form")
    got = {tuple(r) for r in spelling.spelling_variants(df, every=every).collect()}
    assert got == brute_spelling(rows, every)


def test_spelling_in_small_blocks(spark):
    words = {w: n for w, _, _, n, _, _ in brute_spelling(spelling_rows(random.Random(6)), 5)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    whole, parts = ({tuple(r) for r in spelling.near_words(df, b).collect()} for b in (2048, 3))
    assert whole == parts and whole


def test_spelling_empty(spark, none):
    assert spelling.spelling_variants(none).count() == 0


# ---- the registered queries ---------------------------------------------------------------------
def test_registered_queries(spark, docs, tmp_path, cases):
    docs.drop("_n", "key", "gram").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = vectors_of(random.Random(5))
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    rows = [(r[0], r[1]) for r in cases]
    assert {tuple(r) for r in run("op13_spelling_variants")} == brute_spelling(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in run("op12_setsketch_dedup")) == sorted(brute_components(rows))
    white = run("op11_vector_whitening")
    assert {r.n for r in white} == {len(vectors) - 6} and max(r.component for r in white) == 5
    shards = run("op3_hypergeometric_shards")
    assert {r.law for r in shards} == {"rows"} and {r.grown_shard for r in shards} == {None}
    assert sorted((r.doc_id, r.text_crc32, r["size"]) for r in shards) == sorted(
        (i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    held = run("op8_word_field")
    assert sorted((r.doc_id, r.held_out) for r in held) == sorted((i, zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    found = run("op9_small_world")
    assert {r.query_id for r in found} == {k for k, v, _ in vectors if k is not None and k % 50 == 0 and k < 500}
