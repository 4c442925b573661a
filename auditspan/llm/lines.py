"""Line dedup with a log-template tree."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import pin
from .texts import Rolling, flat, map_texts, mix, non_space, record, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Leading tokens that a leaf fixes besides the token count; documents that make an equal
#: line recur; share of tokens a template must fix; shortest line; share of a document's
#: words from which recurring lines are its content.
DEPTH, MIN_DOCUMENTS, SIMILARITY, MIN_TOKENS, CONTENT_SHARE = 3, 2, 0.7, 3, 0.5
#: Different texts that make a template with variable places recur.
TEMPLATE_TEXTS = 10
VARIABLE = "<*>"


def tree_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, with_text: bool = True) -> DataFrame:
    """(doc_id, key, leaf, line, tokens, words, text) of every line with *min_tokens* tokens.

    The leaf is a hash of the token count and the first *depth* tokens, where a token
    with a digit is variable. ``line`` counts from 0 over all lines, ``words`` are those
    of the document. Without text, only (doc_id, key, leaf).
    """
    def parse(part: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = flat(part.column("text"))
        keep = np.ones(256, bool)
        keep[0x0A] = False
        first, end, row = runs(data, starts, keep)
        breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
        number = breaks[first] - breaks[starts[row]]
        word, stop, _ = runs(data, starts, non_space())
        digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
        hashes = np.where(digits[stop] > digits[word], np.uint64(0), Rolling(data).of(word, stop))
        line_of = np.searchsorted(first, word, "right") - 1
        tokens = np.bincount(line_of, minlength=len(first))
        begin = np.cumsum(tokens) - tokens
        leaf = mix(tokens.astype(np.uint64))
        for k in range(depth):
            has = tokens > k
            leaf[has] = mix(leaf[has] * np.uint64(31) + hashes[begin[has] + k] + np.uint64(k + 1))
        ok = tokens >= min_tokens
        at = pa.array(row[ok])
        own = (part.column("doc_id").take(at), part.column("key").take(at), leaf[ok].view(np.int64))
        if not with_text:
            return record("doc_id key leaf", *own)
        words = np.bincount(row, weights=tokens, minlength=part.num_rows).astype(np.int64)
        # the bytes of the wanted lines, one after the other
        size = (end - first)[ok]
        offsets = np.concatenate(([0], np.cumsum(size)))
        inside = np.zeros(len(data) + 1, np.int8)
        inside[first[ok]] = 1
        inside[end[ok]] -= 1
        text = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)),
                                           pa.py_buffer(data[np.cumsum(inside, dtype=np.int8)[:-1] > 0].tobytes()))
        return record("doc_id key leaf line tokens words text", *own, number[ok].astype(np.int32),
                      tokens[ok].astype(np.int32), words[row[ok]], text)
    return map_texts(docs, parse, "doc_id long, key long, leaf long" +
                     ", line int, tokens int, words long, text string" * with_text)


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY,
                    depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, key, words, lines) of documents with recurring lines, where *lines* holds
    structs (line, tokens, form, first).

    An equal line recurs if *min_documents* documents have it; ``first`` tells whether this
    is the one with the least doc_id (then key). Lines that only resemble each other need
    more witnesses, *least* (``TEMPLATE_TEXTS`` or *min_documents*) different texts, as
    copies of one text say nothing about variable places. In a leaf, a token stays fixed
    at its place if as many texts have it there; all other places are variable. Lines
    that agree in the fixed tokens share a template, which recurs if *least* texts have it
    and it fixes *similarity* of its places; ``form`` is its hash, or null. All counts are
    aggregations over the whole table; no leaf is ever gathered.
    """
    least = max(min_documents, TEMPLATE_TEXTS)
    lines = tree_lines(docs, depth, min_tokens)
    leaves = (tree_lines(docs, depth, min_tokens, False).groupBy("leaf", "doc_id", "key").agg(F.lit(1).alias("one"))
              .groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents))
    pieces = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda t: t != "")
    masked = F.transform(pieces, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))
    shape = F.when(F.col("n") >= least, F.array_join(masked, " "))
    kept = pin(lines.join(leaves, "leaf").withColumn("shape", shape).withColumn("same", F.xxhash64("text"))
               .withColumn("mask", F.xxhash64("shape")).drop("text", "n"))
    once = kept.where("shape IS NOT NULL").select("leaf", "shape", "tokens", "key").distinct()
    shapes = once.groupBy("leaf", "shape", "tokens").agg(F.count(F.lit(1)).alias("n"))
    places = shapes.select("leaf", "shape", "tokens", "n", F.posexplode(F.split("shape", " ")).alias("place", "token"))
    support = (places.where(F.col("token") != VARIABLE).groupBy("leaf", "place", "token")
               .agg(F.sum("n").alias("support")).where(F.col("support") >= least).drop("support"))
    fixed = places.join(support, ["leaf", "place", "token"]).groupBy("leaf", "shape", "tokens").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("fixed"))  # of one line
    fixed = fixed.where(F.size("fixed") >= similarity * F.col("tokens")).select(
        "leaf", "shape", F.xxhash64("leaf", F.to_json("fixed")).alias("form"))
    named = once.join(fixed, ["leaf", "shape"])
    recurring = (named.groupBy("form", "key").agg(F.lit(1).alias("one"))
                 .groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("form"))
    equal = (kept.groupBy("same", "doc_id", "key").agg(F.lit(1).alias("one"))
             .groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key")).alias("least"))
             .where(F.col("n") >= min_documents).select("same", "least"))
    forms = fixed.join(recurring, "form").select("leaf", F.xxhash64("shape").alias("mask"), "form")
    found = (kept.drop("shape").join(forms, ["leaf", "mask"], "left").join(equal, "same", "left")
             .where("form IS NOT NULL OR least IS NOT NULL"))
    first = F.coalesce(F.struct("doc_id", "key").eqNullSafe(F.col("least")), F.lit(False))
    return found.groupBy("doc_id", "key").agg(F.max("words").alias("words"), F.collect_set(
        F.struct("line", "tokens", "form", first.alias("first"))).alias("lines"))  # of one document


def drop_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY,
                         content_share: float = CONTENT_SHARE) -> DataFrame:
    """*docs* (doc_id, text and any others) with recurring lines gone from ``text``, and
    n_lines, n_recurring, n_dropped.

    A line that recurs by being equal stays in its first document, by doc_id, and goes from
    all others. Lines of a template are boilerplate and go everywhere, with one exception
    so that no text is lost: of the documents in which recurring lines hold more than
    *content_share* of the words (near copies, pages of boilerplate), the first that has
    the template keeps its lines. No document is exempt. A null text stays null with no
    lines; an empty text has one line. Lines under ``MIN_TOKENS`` tokens stay. Rows that
    repeat doc_id and text count as one document and get the same text. A null doc_id
    comes before all others. Columns named ``_d``, ``_k``, ``_key``, ``_gone`` or ``_found`` must
    not be there already.
    """
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    ids = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_key").alias("key"), "text")
    found = pin(recurring_lines(ids, min_documents, similarity))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x.tokens)
    forms = F.array_distinct(F.transform(F.filter("lines", lambda x: x.form.isNotNull()), lambda x: x.form))
    keeps = (found.where(total > content_share * F.col("words")).select("doc_id", "key", F.explode(forms).alias("form"))
             .groupBy("form").agg(F.min(F.struct("doc_id", "key")).alias("first"))
             .groupBy(F.col("first.doc_id").alias("_d"), F.col("first.key").alias("_k"))
             .agg(F.collect_set("form").alias("own")))  # of one document
    own = F.coalesce("own", F.array().cast("array<long>"))
    out = F.filter("lines", lambda x: F.when(x.form.isNull(), ~x.first).otherwise(~F.array_contains(own, x.form)))
    gone = found.join(keeps, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select(
        F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.size("lines").alias("_found"),
        F.transform(out, lambda x: x.line).alias("_gone"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    all_lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(all_lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    n_dropped = F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long")
    return joined.select(
        *[F.when(n_dropped > 0, rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
          for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
        F.coalesce("_found", F.lit(0)).cast("long").alias("n_recurring"), n_dropped.alias("n_dropped"))
