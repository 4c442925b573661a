"""Every operator against a brute-force version on a small table with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditspan.llm import (graphs, languages, licenses, lines, mixing, neighbours, packing, quality, repeats,
                           sharding, similarity)

from .conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_lines(docs, cases, none):
    got = lines.drop_recurring_lines(docs, min_documents=10).collect()
    assert len(got) == len(cases)
    by_id = {r.doc_id: r for r in got}
    posted = [r for r in cases if r[1] and "posted on" in r[1]]
    assert len(posted) == 14
    for doc_id, text, *_ in posted:
        first, line, last = text.split("\n")
        assert by_id[doc_id].text == f"{first}\n{last}" and by_id[doc_id].n_dropped == 1
    assert by_id[0].text is None and by_id[0].n_lines == 0 and by_id[1].n_lines == 1
    untouched = {r[0]: r[1] for r in cases} | {}
    assert all(by_id[k].text == t for k, t in untouched.items() if not t or "posted on" not in t)
    assert set(docs.columns) <= set(got[0].asDict())
    assert lines.drop_recurring_lines(none).count() == 0


def test_lines_in_every_document(spark):
    rng = random.Random(8)
    notice, passage, article = prose(rng, 12), prose(rng, 30), prose(rng, 40) + "\n" + prose(rng, 25)
    texts = {k: f"{notice} {k}\n{prose(rng, 5)}" for k in range(10, 30)}  # mostly boilerplate, no copies
    texts |= {k: f"{notice} {k}\n{prose(rng, 50)}" for k in range(30, 35)}
    texts |= {k: f"{prose(rng, 40)}\n{passage}" for k in (50, 51, 52)}
    texts |= {k: article for k in range(60, 72)}
    rows = [*texts.items(), (None, passage), (50, texts[50])]
    got = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    text_of = {r.doc_id: r.text for r in got}
    assert text_of[10] == texts[10] and text_of[60] == article and text_of[None] == passage
    assert all(text_of[k] == texts[k].split("\n")[1] for k in range(11, 35))
    assert all(text_of[k] == texts[k].split("\n")[0] for k in (50, 51, 52))
    assert all(text_of[k] == "" for k in range(61, 72))
    assert all(r.n_recurring == (2 if r.text in (article, "") else 1) for r in got)
    assert sum(r.n_dropped for r in got) == 24 + 4 + 22


def test_mixture(docs, cases, none):
    got = mixing.mixture(docs, block=4).collect()
    again = sorted(mixing.mixture(docs, block=4).collect(), key=str)
    assert sorted(got, key=str) == again and len(got) == len(cases)
    size = Counter()
    for _, text, _, source, _ in cases:
        size[source] += len(words(text))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, target, full = 1.5 * sum(size.values()), {}, set()
    while True:
        rest = budget - sum(2 * size[s] for s in full)
        free = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = 2 * size[s] if s in full else level * weight[s]
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 8 for s in names)
    mixed = mixing.mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"), block=4).collect()
    assert all(set(words(r.text)) <= set(words(next(c[1] for c in cases if c[0] == r.doc_id))) for r in mixed)
    assert mixing.mixture(none).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 48, 50, 101])
def test_permutation(spark, size):
    from pyspark.sql import functions as F
    got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(9)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(size))


def test_shards(docs, none):
    many = docs.crossJoin(docs.sparkSession.range(30).withColumnRenamed("id", "extra")).select("doc_id", "extra")
    many = many.distinct()
    got = sharding.shuffle_to_shards(many, 7, ["doc_id", "extra"], part_rows=100).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == many.count() and len(slots) == 7
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_to_shards(none.select("doc_id"), 4, ["doc_id"]).count() == 0
    assert sharding.shuffle_to_shards(docs.select("doc_id", "n_chars"), 4, ["doc_id"]).count() == docs.count()


def test_matrix_margins():
    table = np.array(sharding.draw_matrix([5, 0, 9, 3], [8, 4, 5], [1, 2]))
    assert table.sum(axis=1).tolist() == [5, 0, 9, 3] and table.sum(axis=0).tolist() == [8, 4, 5]
    means = np.mean([sharding.draw_matrix([6, 6], [3, 9], [k]) for k in range(600)], axis=0)
    assert np.allclose(means, [[1.5, 4.5], [1.5, 4.5]], atol=0.15)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard(docs, cases, none):
    sets = {r[0]: shingles(r[1]) for r in cases}
    copies = Counter(r[0] for r in cases)
    link = {a: [b for b in sets if b != a and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
            for a in sets}
    for blocks in (similarity.TASK_GRAMS, 200):
        similarity.TASK_GRAMS, before = blocks, similarity.TASK_GRAMS
        try:
            got = similarity.jaccard_classes(docs).collect()
        finally:
            similarity.TASK_GRAMS = before
        assert len(got) == len(cases)
        for r in got:
            seen, todo = {r.doc_id}, [r.doc_id]
            while todo:
                for b in link[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            assert r.class_id == min(seen)
            assert r.n_links == sum(copies[b] for b in link[r.doc_id]) + copies[r.doc_id] - 1
    assert similarity.jaccard_classes(none).count() == 0
    bands, rows = similarity.bands_and_rows()
    assert 1 - (1 - 0.8 ** rows) ** bands >= similarity.RECALL and bands * rows <= similarity.HASHES


def test_jaccard_of_null_and_clashing_ids(spark):
    import corpus_pipeline
    rng = random.Random(5)
    text = [prose(rng, 60) for _ in range(5)]
    near = text[0].rsplit(" ", 1)[0] + " end"
    rows = [(7, text[0]), (7, text[1]), (7, text[2]), (None, text[3]), (None, text[4]), (9, near), (3, text[2]), (4, text[4]),
            (7, text[0])]
    frame = spark.createDataFrame([(d, t, "aa", f"s{k}", len(t)) for k, (d, t) in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.class_id, r.copy_id, r.n_links) for r in similarity.jaccard_classes(frame).collect()}
    assert got == {(7, 7, 7, 2), (7, 7, 7, 0), (7, 3, 3, 1), (3, 3, 3, 1), (None, None, None, 0), (None, 4, 4, 1),
                   (4, 4, 4, 1), (9, 7, 9, 2)}
    kept = corpus_pipeline.jaccard_stage(spark, frame, "")
    want = Counter([(7, text[0], "s0"), (7, text[1], "s1"), (3, text[2], "s6"), (None, text[3], "s3"), (4, text[4], "s7")])
    assert Counter((r.doc_id, r.text, r.source) for r in kept.collect()) == want
    mixed = mixing.mixed_documents(kept, block=4).collect()
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(words(r.text))
    assert set(taken) == {7, 3, 4, None} and sum(taken.values()) == pytest.approx(1.5 * 300, abs=20)


def test_memory_of_a_verification(docs, monkeypatch):
    import tracemalloc
    rng = np.random.default_rng(6)
    n, common = 3000, rng.integers(0, 1 << 60, 20, dtype=np.uint64)
    sets = [np.append(common, rng.integers(0, 1 << 60, 1 + k % 6, dtype=np.uint64)) for k in range(n)]
    side, weight = np.arange(n) % 2 == 0, rng.integers(1, 5, n)
    tracemalloc.start()
    got = similarity.linked(np.arange(n), weight, side, sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # 46 MB; with the products of all pairs at once 137 MB
    own = np.array([1 + k % 6 for k in range(n)])
    near = (20 >= 0.8 * (20 + own[:, None] + own[None, :])) & (side[:, None] != side[None, :])
    assert got[0].tolist() == near.sum(axis=1).tolist() and got[1].tolist() == (near * weight).sum(axis=1).tolist()
    assert got[2].tolist() == [0 if row.any() else k for k, row in enumerate(near)]
    want = Counter(similarity.jaccard_classes(docs).collect())
    monkeypatch.setattr(similarity, "TASK_TEXTS", 2)
    assert Counter(similarity.jaccard_classes(docs).collect()) == want


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 40: 40, 50: 40, 60: 40}


def test_quality(docs, cases, none):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(cases)
    text_of = {r[0]: r[1] for r in cases}
    for r in got:
        text = text_of[r.doc_id] or ""
        w = words(text)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        count, cover, seen, dup = Counter(windows), set(), set(), 0
        for k, g in enumerate(windows):
            if count[g] > 1:
                cover |= set(range(k, k + 5))
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality_rules(none).count() == 0


def test_quality_of_short_and_odd_texts(spark):
    rng = random.Random(12)
    common, rare = prose(rng, 90).split(), prose(rng, 4000).split()
    weights = [1 / (k + 1) for k in range(len(common))]

    def clean(n):
        return " ".join(rng.choices(common, weights)[0] if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))

    long, short = [clean(400) for _ in range(60)], [clean(rng.randint(50, 99)) for _ in range(200)]
    junk = [" ".join(rng.sample(rare, n)) for n in (100, 120, 150, 300)]  # no common word
    marks = [" ".join(f"{w}##$$" for w in clean(n).split()) for n in (60, 150)]
    rows = [(t, "aa") for t in long + short] + [(t, None) for t in junk + marks] + [(t, f"x{k}") for k, t in enumerate(junk + marks)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert [r.lang for r in quality.language_references(frame).collect()] == ["aa"]
    got = {r.doc_id: r for r in quality.quality_rules(frame).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[k].word_distance > quality.MAX_WORDS for k in range(260)) > 20
    assert sum(not got[k].kept for k in range(260)) <= 2
    assert not any(got[k].kept for k in range(260, len(rows)))
    few = quality.quality_rules(frame.where("doc_id >= 260")).collect()  # nothing to hold them against
    assert all(r.kept for r in few) and {r.word_distance for r in few} == {1.0}


@pytest.mark.parametrize("hot", [repeats.HOT_ANCHOR, 1])
def test_repeats(docs, cases, none, hot):
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, with_bytes=True, hot_anchor=hot).collect()}
    seen = set()
    for doc_id, text in sorted({(r[0], r[1]) for r in cases}, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(raw[k:k + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        r = got[doc_id]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), gone.sum(), spans)
        assert r.kept == kept and r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert repeats.remove_repeats(docs).count() == len(cases)
    assert repeats.remove_repeats(none).count() == 0


def test_packing(docs, cases, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=300).collect()
    want = Counter()
    for doc_id, text, *_ in cases:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 300):
            part = np.array(ids[k:k + 300], "<u4")
            want[doc_id, k // 300, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 300
    first_fit: list[int] = []
    for length in sorted((r.length for r in got), reverse=True):
        k = next((k for k, used in enumerate(first_fit) if used + length <= 300), None)
        if k is None:
            first_fit.append(length)
        else:
            first_fit[k] += length
    assert len(bins) <= max(len(first_fit), -(-sum(r.length for r in got) // 300))
    assert packing.pack_documents(none, path).count() == 0


def test_token_words(spark):
    from tokenizers import Tokenizer
    import pyarrow as pa
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["Don't, STOP!! it's", "<|endoftext|>. <|ENDOFTEXT|>", "éa b c", "İstanbul ǅ 12.5, x.y.",
           "»quoted«. ...", "ä.", "", "日本語 text", "'s 'S", "\x1c\x85 z"]
    ids, starts = packing.Memo(path).tokens(pa.array(odd))
    tokenizer = Tokenizer.from_file(path)
    for k, text in enumerate(odd):
        assert ids[starts[k]:starts[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_fullest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        left = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 6)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for length, n in left.items():
            sums |= {s + length * k for s in sums for k in range(n + 1)}
        got = packing.fullest(room, left)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= left[k] for k, n in got.items())


def test_languages(docs, cases, none):
    model = languages.learn(docs)
    got = languages.language_id(docs, model, keep=("source",)).collect()
    assert len(got) == len(cases) and model[0] == ["aa", "zz"]
    for r in got:
        text = next(c[1] for c in cases if c[0] == r.doc_id)
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(words(text)) > 20 and "#" not in text:
            assert r.lang_pred == ("zz" if text[0] in "mnopqrstu" else "aa") and 0.5 < r.score <= 1
    assert languages.language_id(none, model).count() == 0
    assert {r.lang_pred for r in languages.language_id(docs, languages.learn(none)).collect()} == {"und"}
    switched = docs.sparkSession.createDataFrame([(1, "abcd efgh bade fig " * 5 + "mnop qrst nopu rust " * 5)], "doc_id long, text string")
    assert languages.language_id(switched, model).first().n_switches in range(1, 6)


def test_forward_backward():
    rng = np.random.default_rng(2)
    scores, hops = rng.normal(size=(150, 3)), rng.normal(size=(3, 3))
    row = np.repeat([0, 2], [140, 10])
    got = languages.posteriors(scores, hops, row, 3)
    psi, hop = languages.potentials(scores), np.exp(hops)
    for r in (0, 2):
        own = psi[row == r]
        ahead, back = [own[0]], [np.ones(3)]
        for p in own[1:]:
            ahead.append(ahead[-1] @ hop * p)
        for p in own[:0:-1]:
            back.append(hop @ (p * back[-1]))
        want = np.array(ahead) * np.array(back[::-1])
        assert np.allclose(got[row == r], want / want.sum(axis=1, keepdims=True))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    table = rng.normal(size=(600, 12)).astype(np.float32)
    table[50:120] = table[50]
    rows = [(k, v.tolist()) for k, v in enumerate(table)]
    odd = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [1.0, 2.0]),
           (905, []), (906, [float("inf")] * 12)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(frame, frame.where("vec_id % 50 = 0"), shard_rows=150).collect()
    unit = table.astype(float) / np.linalg.norm(table.astype(float), axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 600, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = unit @ unit[q]
        score[q] = -9
        best = sorted(range(600), key=lambda k: (-round(score[k], 12), k))[:5]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in mine)
        found += len(set(best) & {r.vec_id for r in mine})
        total += 5
    assert found >= 0.9 * total and not {r.query_id for r in got} & {x[0] for x in odd}
    assert neighbours.nearest_neighbours(frame.where("vec_id < 0"), frame).count() == 0


def test_neighbours_dealt_without_broadcast(spark):
    """However few they look, queries times shards never go through the driver; float and double columns, other
    lengths, repeated ids and queries of no shard's length."""
    rng = np.random.default_rng(4)
    table = [rng.normal(size=3 if k % 3 else 5).astype(np.float32).tolist() for k in range(240)]
    rows = [*enumerate(table), (7, table[8]), (7, table[7]), (9, table[7]), (10_000_000_000, table[10])]
    asked = [(k, table[k]) for k in range(0, 240, 20)] + [(40, table[40]), (40, table[41]), (900, table[7]), (901, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    for kind in ("float", "double"):
        found = neighbours.nearest_neighbours(
            frame, spark.createDataFrame(asked, f"id long, v array<{kind}>"), shard_rows=40, id_col="id", vector_col="v")
        got = sorted(tuple(r) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        want = defaultdict(list)
        for q, a in asked:
            best = []
            for k, b in rows:
                if k != q and len(a) == len(b):
                    x, y = np.array(a), np.array(b)
                    best.append((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), k))
            want[q] += sorted(best)[:5]
        want = [(q, r, k, -s) for q in sorted(want) for r, (s, k) in enumerate(sorted(want[q])[:5], 1)]
        assert [(q, r, k, round(s, 9)) for q, r, k, s in got] == want and 901 not in {r[0] for r in got}


def test_neighbours_shards_stay_few():
    assert [neighbours.shard_count(n, 64 * n, 4096) for n in (0, 1, 4096, 4097, 131_072, 1_000_000)] == [1, 1, 1, 2, 32, 32]
    assert neighbours.shard_count(10**8, 64 * 10**8, 4096) == -(-64 * 10**8 // neighbours.SHARD_NUMBERS)
    assert neighbours.beam_width(10) == neighbours.beam_width(4096) == 120 and neighbours.beam_width(4 * 4096) == 240


@pytest.mark.parametrize("crowd", (0, 1500))
def test_neighbours_graph_in_blocks(crowd):
    rng = np.random.default_rng(6)
    table = rng.normal(size=(3000, 24))
    table[:crowd] = table[0] + 0.02 * rng.normal(size=(crowd, 24))
    table = (table / np.linalg.norm(table, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(3000)]
    graph = neighbours.Graph(table, 1)
    assert len(graph.near) > 1 and sorted(graph.order) == list(range(3000))
    for near in graph.near:
        for node, links in enumerate(near):
            own = links[links >= 0].tolist()
            assert len(set(own)) == len(own) and node not in own and all(k < len(near) for k in own)
    asked = np.concatenate([table[:100], -table[:50]])
    found = graph.search(asked, 120)
    best = np.argsort(-(asked @ table.T), axis=1, kind="stable")[:, :5]
    assert all(len(set(f[f >= 0])) == (f >= 0).sum() for f in found)
    assert sum(len(set(b) & set(f)) for b, f in zip(best.tolist(), found.tolist(), strict=True)) >= 0.97 * best.size
    lone = neighbours.Graph(table[:1], 0).search(table[:2], 120)
    assert lone[:, 0].tolist() == [0, 0] and (lone[:, 1:] == -1).all()


def test_licenses(spark, docs, cases, none):
    mit = licenses.TEMPLATES[0][1]
    gone = mit.split()
    del gone[20]
    texts = [None, "", "Under the MIT  LICENSE, under the mit license!", "CC BY-NC 4.0 and Apache License, Version 2.0",
             "words before " + " ".join(gone) + " words after", "this program is free software", "under the mit licenses"]
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, key int")
    got = {r.doc_id: r for r in licenses.license_scan(frame.union(frame.where("doc_id = 2"))).collect()}
    base = lambda k: (got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels)
    assert base(0) == base(1) == (0, None, None, "") and got[0].n_words == 0
    assert base(2) == (2, 0, 4, "mit") and base(3) == (2, 0, 6, "apache-2,cc-by-nc")
    assert got[4].labels == "mit" and 0.8 <= got[4].score < 1 and got[4].base_labels == ""
    assert got[5].labels == got[6].labels == "" and got[6].n_words == 4
    assert all(r.labels == "" for r in licenses.license_scan(docs).collect())
    assert licenses.license_scan(docs).count() == len(cases) and licenses.license_scan(none).count() == 0


def test_pipeline(spark, docs, cases, tmp_path):
    import corpus_pipeline
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
        if k == 2:
            kept = {r.doc_id for r in frame.select("doc_id").collect()}
            assert frame.count() == len(kept)
    assert len([d for d in range(7, 23) if d in kept]) == 1  # base and its near copies
    assert {r[0] for r in cases if r[1] and ("posted on" in r[1] or r[1][0] in "mnopqrstu" and len(words(r[1])) > 20)} <= kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
