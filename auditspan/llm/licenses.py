"""License scans by diagonal voting against templates."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import pin
from .texts import Rolling, alphanumeric, flat, grams, map_texts, record, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Phrases that always give their label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
           ("cc by nc", "cc-by-nc"))
#: Wordings of public licences. Short licences are whole, long ones stand with the notice that
#: their authors ask to put into files, and with the lines that name them.
GNU = ("This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
       "License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
GNU_NAME = "GNU {kind}General Public License, version {version}"
CC = "Creative Commons {terms} {version} International License"
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
         "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
         "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
         "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution. ")
BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
             "this software without specific prior written permission. ")
BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
           "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
           "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
           "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
           "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
           "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
MIT_HEAD = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software")
ISC_HEAD = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies")
GNU_KINDS = (("gpl-2", "", "2", "program"), ("gpl-3", "", "3", "program"), ("lgpl-2.1", "Lesser ", "2.1", "library"), ("lgpl-3", "Lesser ", "3", "library"),
             ("agpl-3", "Affero ", "3", "program"))
CC_TERMS = (("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nc", "Attribution-NonCommercial"),
            ("cc-by-nd", "Attribution-NoDerivatives"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
            ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
TEMPLATES = (
    ("mit", MIT_HEAD),
    ("mit", MIT_HEAD + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                 "in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                 "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                 "governing permissions and limitations under the License."),
    *[(label, text.format(thing=thing, kind=kind, version=version)) for label, kind, version, thing in GNU_KINDS for text in (GNU, GNU_NAME)],
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd-2", BSD_HEAD + BSD_END), ("bsd-3", BSD_HEAD + BSD_THIRD + BSD_END),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
              "MPL was not distributed with this file, You can obtain one at"),
    ("isc", ISC_HEAD),
    ("isc", ISC_HEAD + ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
            "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
            "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
             "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
             "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
             "distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software"),
    *[(label, CC.format(terms=terms, version=version)) for label, terms in CC_TERMS for version in ("4.0", "3.0")],
)
GRAM, GAP, SIMILARITY = 4, 3, 0.8
#: Words of a bucket in which overlapping spans meet.
REACH = 256


def folded(column: pa.Array):
    """Bytes with A-Z lowered, and row starts."""
    data, starts = flat(column)
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data], starts


def words_of(column: pa.Array):
    data, starts = folded(column)
    first, end, row = runs(data, starts, alphanumeric())
    return Rolling(data).of(first, end), row, len(starts) - 1


def phrase_places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """(doc_id, key, n_words, n_base, first_word, last_word, base_labels) per row."""
    probes = []
    for phrase, label in phrases:
        hashes, row, _ = words_of(pa.array([phrase]))
        probes.append((len(hashes), grams(hashes, row, len(hashes))[0][0], label))

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, rows = words_of(part.column("text"))
        n_base = np.zeros(rows, np.int64)
        first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        labels: list[set] = [set() for _ in range(rows)]
        begin = np.searchsorted(row, np.arange(rows))
        for n, wanted, label in probes:
            gram, at = grams(hashes, row, n)
            at = at[gram == wanted]
            n_base += np.bincount(row[at], minlength=rows)
            place = at - begin[row[at]]
            np.minimum.at(first, row[at], place)
            np.maximum.at(last, row[at], place)
            for r in set(row[at].tolist()):
                labels[r].add(label)
        none = n_base == 0
        return record("doc_id key n_words n_base first_word last_word base_labels", part.column("doc_id"),
                      part.column("key"), np.bincount(row, minlength=rows), n_base,
                      pa.array(first, mask=none), pa.array(last, mask=none),
                      pa.array([sorted(x) for x in labels], pa.list_(pa.string())))
    return map_texts(docs, scan, "doc_id long, key long, n_words long, n_base long, first_word long, "
                                 "last_word long, base_labels array<string>")


def template_grams(templates=TEMPLATES, k: int = GRAM):
    """Rows (gram, template, place, template words) of every template with k words."""
    out = []
    for number, (_, text) in enumerate(templates):
        hashes, row, _ = words_of(pa.array([text]))
        gram, at = grams(hashes, row, k)
        out += [(int(g), number, int(p), len(hashes)) for g, p in zip(gram.view(np.int64), at, strict=True)]
    return out


def template_rivals(templates=TEMPLATES, k: int = GRAM):
    """Rows (template, rival, own, theirs) of templates of different labels that share k words: where each has
    k words that the other has not. One row for each pair, both ways."""
    grams_of: dict[int, list] = {}
    for gram, number, spot, _ in template_grams(templates, k):
        grams_of.setdefault(number, []).append((gram, spot))
    out = []
    for a, mine in grams_of.items():
        for b, other in grams_of.items():
            here, there = {g for g, _ in mine}, {g for g, _ in other}
            if templates[a][0] != templates[b][0] and here & there:
                out.append((a, b, [s for g, s in mine if g not in there], [s for g, s in other if g not in here]))
    return out


def unrivalled(spans: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """Spans without those that a related licence explains as well or better. Licences of a family differ by a word
    or two, so a span needs some of its own words, those that a rival lacks, for every rival; and of two overlapping
    spans the one goes of whose own words the text holds the smaller share. A template that lies within its rival has no
    own words and goes if the rival is there."""
    spark = spans.sparkSession
    rivals = spark.createDataFrame(template_rivals(templates, k), "template int, rival int, own array<int>, theirs array<int>")

    def share(spots, wanted):
        return F.when(F.size(wanted) > 0, F.size(F.array_intersect(spots, wanted)) / F.size(wanted)).otherwise(0.0)
    here = ["key", "template", "first_word"]
    named = F.broadcast(rivals)  # a row for each pair of templates
    plain = spans.join(named, "template").where((F.size("own") > 0) & (share(F.col("spots"), F.col("own")) == 0)).select(*here).distinct()
    kept = spans.join(plain, here, "left_anti")
    each = kept.withColumn("shelf", F.explode(F.sequence(F.floor(F.col("first_word") / REACH), F.floor(F.col("last_word") / REACH))))
    other = each.select("key", "shelf", F.col("template").alias("rival"), F.col("first_word").alias("from"), F.col("last_word").alias("to"),
                        F.col("spots").alias("seen"))
    met = (each.join(named, "template").join(other, ["key", "shelf", "rival"])
           .where((F.col("from") <= F.col("last_word")) & (F.col("first_word") <= F.col("to"))))
    beaten = met.where(share(F.col("seen"), F.col("theirs")) > share(F.col("spots"), F.col("own"))).select(*here).distinct()
    return kept.join(beaten, here, "left_anti")


def template_spans(docs: DataFrame, templates=TEMPLATES, k: int = GRAM, gap: int = GAP,
                   similarity: float = SIMILARITY) -> DataFrame:
    """Verified places of templates: (key, template, label, first_word, last_word, score).

    All rolling k-grams of all texts are joined to the template's places; hits vote for
    the diagonal (place in the text less place in the template). Diagonals at most *gap*
    apart, as insertions and deletions leave them, merge. A span counts if its hits cover
    *similarity* of the template's words, it is not much longer than the template, and no
    overlapping span of a related licence fits better (:func:`unrivalled`).
    Equal texts share a key and are voted on once. The template table is bounded by
    *templates*, so it is broadcast.
    """
    spark = docs.sparkSession

    def roll(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, rows = words_of(part.column("text"))
        gram, at = grams(hashes, row, k)
        begin = np.searchsorted(row, np.arange(rows))
        key = part.column("key").to_numpy()
        return record("key place gram", key[row[at]], (at - begin[row[at]]).astype(np.int32), gram.view(np.int64))

    known = spark.createDataFrame(template_grams(templates, k), "gram long, template int, spot int, size int")
    labels = spark.createDataFrame([(i, label) for i, (label, _) in enumerate(templates)], "template int, label string")
    hits = (map_texts(docs, roll, "key long, place int, gram long").join(F.broadcast(known), "gram")
            .groupBy("key", "template", "size", "place", "spot").agg(F.lit(1).alias("one"))
            .withColumn("diagonal", F.col("place") - F.col("spot")))
    votes = hits.groupBy("key", "template", "size", "diagonal").agg(
        F.min("place").alias("first"), F.max("place").alias("last"),
        F.collect_set("spot").alias("spots"))  # at most the template's own places
    side = Window.partitionBy("key", "template").orderBy("diagonal")
    islands = (votes.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(side) <= gap, 0).otherwise(1))
               .withColumn("island", F.sum("new").over(side)))
    merged = islands.groupBy("key", "template", "size", "island").agg(
        F.min("first").alias("first_word"), (F.max("last") + k - 1).alias("last_word"),
        F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s, s + (k - 1))))))
    verified = pin(merged.withColumn("score", covered / F.col("size"))
                   .where((F.col("score") >= similarity)
                          & (F.col("last_word") - F.col("first_word") + 1 <= 2 * F.col("size"))))
    return (unrivalled(verified, templates, k).join(F.broadcast(labels), "template")
            .select("key", "template", "label", "first_word", "last_word", "score"))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row of *docs* (doc_id, text; other columns are ignored): base phrases and labels,
    and the labels and best score of :func:`template_spans`.

    A null or empty text has no words, places or labels, and score 0. Repeated rows each
    give a row. A base phrase scores 1.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64("text").alias("key"))
    found = template_spans(keyed, templates).groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best"))
    rows = phrase_places(keyed, phrases).join(found, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
