"""Licences that differ by a word, against a plain version of the voting; the mix of sources as rows."""

import random
import re

import pytest

from auditspan.llm import licenses, mixing

from .conftest import SCHEMA, prose

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def labels_of(spark, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(frame).collect()}
    return [got[k] for k in range(len(texts))]


def test_every_template_gives_its_own_label(spark):
    base = {"mit": "mit", "apache-2": "apache-2"}
    texts = [f"words before, {text} and words after" for _, text in licenses.TEMPLATES]
    assert labels_of(spark, texts) == [base.get(label, label) for label, _ in licenses.TEMPLATES]


def test_named_siblings(spark):
    cases = {
        "Licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.": "cc-by-sa",
        "GNU General Public License, version 2": "gpl-2",
        "GNU General Public License, version 3": "gpl-3",
        "GNU General Public License, version 4": "",
        "GNU Lesser General Public License, version 2.1": "lgpl-2.1",
        "GNU Affero General Public License, version 3": "agpl-3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version": "lgpl-2.1",
    }
    assert dict(zip(cases, labels_of(spark, list(cases)), strict=True)) == cases


def test_two_licences_in_one_text(spark):
    by_label = {}
    for label, text in licenses.TEMPLATES:
        by_label.setdefault(label, text)
    rng = random.Random(3)
    both = [("gpl-2", "cc-by-nc"), ("lgpl-3", "gpl-3"), ("bsd-3", "isc"), ("cc-by", "cc-by-sa")]
    texts = [f"{by_label[a]} {prose(rng, 30)} {by_label[b]}" for a, b in both]
    assert labels_of(spark, texts) == [",".join(sorted(p)) for p in both]


def plain_spans(text):
    """Verified spans by the same rule, one template at a time over word lists."""
    words = WORD.findall(text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text))
    k, out = licenses.GRAM, {}
    template_words = [WORD.findall(t.lower()) for _, t in licenses.TEMPLATES]
    for number, mine in enumerate(template_words):
        spots = {}
        for s in range(len(mine) - k + 1):
            spots.setdefault(tuple(mine[s:s + k]), []).append(s)
        votes = {}
        for p in range(len(words) - k + 1):
            for s in spots.get(tuple(words[p:p + k]), ()):
                votes.setdefault(p - s, []).append((p, s))
        island, last = [], None
        islands = []
        for d in sorted(votes):
            if last is not None and d - last > licenses.GAP:
                islands.append(island)
                island = []
            island += votes[d]
            last = d
        for one in [*islands, island]:
            if one:
                covered = {s + j for _, s in one for j in range(k)}
                lo, hi = min(p for p, _ in one), max(p for p, _ in one) + k - 1
                if len(covered) / len(mine) >= licenses.SIMILARITY and hi - lo + 1 <= 2 * len(mine):
                    out[number, lo] = (hi, {s for _, s in one})
    rivals = licenses.template_rivals()
    share = lambda seen, wanted: len(seen & set(wanted)) / len(wanted) if wanted else 0.0
    kept = {at: span for at, span in out.items() if not any(t == at[0] and own and not share(span[1], own) for t, _, own, _ in rivals)}
    return {at for at, (hi, seen) in kept.items() if not any(
        t == at[0] and r == n and lo <= hi and at[1] <= hi2 and share(seen2, theirs) > share(seen, own)
        for t, r, own, theirs in rivals for (n, lo), (hi2, seen2) in kept.items())}


def test_voting_against_a_plain_version(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 2)] = rng.choices(["x", "license", "the", "3", "2"], k=rng.randint(0, 2))
            parts += [prose(rng, rng.randint(0, 12)), " ".join(words)]
        texts.append(" ".join(parts))
    frame = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, key long")
    got = {(r.key, r.template, r.first_word) for r in licenses.template_spans(frame).collect()}
    assert got == {(k, *at) for k, t in enumerate(texts) for at in plain_spans(t)} and len(got) > 30


# ---- mixing ---------------------------------------------------------------------------------------
def test_slots_are_never_broadcast(spark, docs):
    plan = mixing.mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "source_no" in line and "block" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_mixed_rows(spark, cases):
    columns = [*SCHEMA.split(", ")]
    frame = spark.createDataFrame(cases, SCHEMA).selectExpr("*", "1 AS taken", "'x' AS row", "2 AS spans", "3 AS key", "4 AS size")
    again = frame.where("doc_id = 8").selectExpr("doc_id", "text", "lang", "'zzz' AS source", "n_chars", "taken", "row", "spans", "key", "size")
    both = frame.unionByName(again)
    first, second = (sorted(map(str, mixing.mixed_documents(both, block=4).collect())) for _ in range(2))
    assert first == second and len(columns) == 5
    rows = mixing.mixed_documents(both, block=4).collect()
    assert rows[0].asDict().keys() == frame.first().asDict().keys()
    assert all(r.taken == 1 and r.n_chars == len(r.text) for r in rows)
    assert {r.source for r in rows if r.doc_id == 8} == {next(c[3] for c in cases if c[0] == 8)}  # the least of the rows that repeat it
    assert mixing.mixed_documents(frame.where("doc_id < 0")).count() == 0
    assert mixing.mixed_documents(frame.where("text IS NULL OR text = ''")).count() == 0


@pytest.mark.parametrize("words", [40_000])
def test_long_text_is_split_once(spark, words):
    """A text of many spans: the split is bound outside the loop over spans."""
    text = " ".join(f"w{k}" for k in range(words))
    frame = spark.createDataFrame([(1, text, "aa", "s", len(text)), (2, "other words here", "aa", "t", 16)], SCHEMA)
    got = mixing.mixed_documents(frame).where("doc_id = 1").collect()
    want = text.split()
    assert got and all(set(r.text.split()) <= set(want) for r in got)
