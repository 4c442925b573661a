"""Language ID of words in code-switched text with a linear-chain conditional random field.

Labels are languages. A word's features are its byte n-grams with word-boundary
marks (which include its prefixes and suffixes) and the word itself (the
lexicon), all hashed into one weight table. Emission weights and the transition
matrix are learned together by gradient ascent on the conditional likelihood;
training sequences join passages of different languages, so switches are seen.
Posteriors come from forward-backward.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_n
from .texts import Rolling, flat, map_texts, record, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The fit reads at most so many documents of a language, and so many characters of each.
FIT_DOCUMENTS, FIT_CHARACTERS = 150, 2_500
BUCKETS, LANE, EPOCHS, RATE, DECAY = 1 << 17, 48, 40, 0.35, 1e-5
GRAMS = (2, 3, 4)
CHUNK = 64
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data]


def word_types(data: np.ndarray, starts: np.ndarray):
    """Distinct words: features (flat bucket numbers, start per type), and per word its
    type and row."""
    data = lower(data)
    first, end, row = runs(data, starts, letter_table())
    _, at, kind = np.unique(Rolling(data).of(first, end), return_index=True, return_inverse=True)
    first, length = first[at], (end - first)[at]
    # ^word$ of every type in one buffer
    bounds = np.concatenate(([0], np.cumsum(length + 2)))
    buffer = np.full(bounds[-1], ord("^"), np.uint8)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    buffer[np.repeat(bounds[:-1] + 1, length) + inside] = data[np.repeat(first, length) + inside]
    buffer[bounds[1:] - 1] = ord("$")
    rolling = Rolling(buffer)
    owner = np.repeat(np.arange(len(length)), length + 2)
    hashes, owners = [rolling.of(bounds[:-1], bounds[1:])], [np.arange(len(length))]
    for n in GRAMS:
        begin = np.arange(max(len(buffer) - n + 1, 0))
        begin = begin[owner[begin] == owner[begin + n - 1]]
        hashes.append(rolling.of(begin, begin + n))
        owners.append(owner[begin])
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    bucket = (hashes[order] >> np.uint64(20)).astype(np.int64) % BUCKETS
    return bucket, np.searchsorted(owners[order], np.arange(len(length))), kind, row


def emissions(weights: np.ndarray, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Scores types x languages."""
    if not len(begin):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[bucket], begin, axis=0)


def forward_backward(psi: np.ndarray, hop: np.ndarray, enter: np.ndarray, leave: np.ndarray):
    """Scaled forward and backward vectors of lanes x steps x languages potentials."""
    steps = psi.shape[1]
    ahead, back = np.empty_like(psi), np.empty_like(psi)
    state = enter
    for t in range(steps):
        state = (state if t == 0 else state @ hop) * psi[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        ahead[:, t] = state
    state = leave
    for t in range(steps - 1, -1, -1):
        back[:, t] = state
        state = (state * psi[:, t]) @ hop.T
        state = state / state.sum(axis=1, keepdims=True)
    return ahead, back


def potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=-1, keepdims=True), -30, 0))


def fit(texts: list[str], labels: list[int], n_labels: int, seed: int = 11):
    """(weights, transitions) learned from labelled texts."""
    column = pa.array(texts, pa.string())
    bucket, begin, kind, row = word_types(*flat(column))
    rng = np.random.default_rng(seed)
    weights, hops = np.zeros((BUCKETS, n_labels)), np.eye(n_labels) * 2.0
    gold_of_row = np.array(labels, np.int64)
    # lanes of several passages: a cut every 8 to LANE words, passages in random order
    cuts = [0]
    while cuts[-1] < len(kind):
        cuts.append(cuts[-1] + int(rng.integers(8, LANE + 1)))
    pieces = np.array(list(zip(cuts[:-1], np.minimum(cuts[1:], len(kind)), strict=True)), np.int64).reshape(-1, 2)
    order = np.concatenate([np.arange(a, b) for a, b in pieces[rng.permutation(len(pieces))]] or [np.zeros(0, np.int64)])
    order = order[: len(order) // LANE * LANE] if len(order) >= LANE else np.resize(order, LANE)
    if not len(kind):
        return weights, hops
    types, gold = kind[order].reshape(-1, LANE), gold_of_row[row[order]].reshape(-1, LANE)
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(bucket))))
    flat_types, size = types.ravel(), len(begin)
    one_hot = np.eye(n_labels)[gold]
    speed_w, speed_h = np.full_like(weights, 1e-3), np.full_like(hops, 1e-3)
    ones = np.ones((len(types), n_labels))
    for _ in range(EPOCHS):
        psi = potentials(emissions(weights, bucket, begin)[types])
        hop = np.exp(hops - hops.max())
        ahead, back = forward_backward(psi, hop, ones, ones)
        posterior = ahead * back
        posterior /= posterior.sum(axis=2, keepdims=True)
        miss = (one_hot - posterior).reshape(-1, n_labels)
        per_type = np.stack([np.bincount(flat_types, weights=miss[:, k], minlength=size) for k in range(n_labels)], 1)
        grad = np.stack([np.bincount(bucket, weights=per_type[owner, k], minlength=BUCKETS)
                         for k in range(n_labels)], 1) - DECAY * len(order) * weights / BUCKETS
        pair = ahead[:, :-1, :, None] * hop * (psi * back)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        seen = np.zeros_like(hops)
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grad_h = seen - pair.sum(axis=(0, 1)) - 0.01 * hops
        speed_w += grad * grad
        speed_h += grad_h * grad_h
        weights += RATE * grad / np.sqrt(speed_w)
        hops += RATE * grad_h / np.sqrt(speed_h)
    return weights, hops


def posteriors(scores: np.ndarray, hops: np.ndarray, row: np.ndarray, n_rows: int):
    """Posterior of every word. A row is cut into chunks: chunk products give the vectors
    entering and leaving each chunk, and all chunks then run side by side."""
    words, labels = scores.shape
    if not words:
        return scores
    hop = np.exp(hops - hops.max())
    count = np.bincount(row, minlength=n_rows)
    chunks = -(-count // CHUNK)
    lane0 = np.cumsum(chunks) - chunks
    place = np.arange(words) - np.repeat(np.cumsum(count) - count, count)
    lane, step = lane0[row] + place // CHUNK, place % CHUNK
    n_lanes = int(chunks.sum())
    psi = np.ones((n_lanes, CHUNK, labels))
    psi[lane, step] = potentials(scores)
    used = np.zeros((n_lanes, CHUNK), bool)
    used[lane, step] = True
    opening = np.zeros(n_lanes, bool)  # lanes that start a row: no transition leads into them
    opening[lane0[chunks > 0]] = True
    product = np.broadcast_to(np.eye(labels), (n_lanes, labels, labels)).copy()
    for t in range(CHUNK):
        live = used[:, t]
        moved = (product[live].reshape(-1, labels) @ hop).reshape(-1, labels, labels)
        if t == 0:
            moved[opening] = np.eye(labels)
        moved = moved * psi[live, t][:, None, :]
        product[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
    ahead, back = np.ones((n_lanes, labels)), np.ones((n_lanes, labels))
    for c in range(1, int(chunks.max())):
        rows = np.flatnonzero(chunks > c)
        at = lane0[rows] + c
        state = np.einsum("ri,rij->rj", ahead[at - 1], product[at - 1])
        ahead[at] = state / state.sum(axis=1, keepdims=True)
    for c in range(int(chunks.max()) - 2, -1, -1):
        rows = np.flatnonzero(chunks > c + 1)
        at = lane0[rows] + c
        state = np.einsum("rij,rj->ri", product[at + 1], back[at + 1])
        back[at] = state / state.sum(axis=1, keepdims=True)
    forward, backward = np.empty_like(psi), np.empty_like(psi)
    state = ahead
    for t in range(CHUNK):
        state = np.where(opening[:, None], state, state @ hop) if t == 0 else state @ hop
        state = state * psi[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        forward[:, t] = state
    state = back
    for t in range(CHUNK - 1, -1, -1):
        backward[:, t] = state
        moved = (state * psi[:, t]) @ hop.T
        state = np.where(used[:, t][:, None], moved / moved.sum(axis=1, keepdims=True), state)
    out = (forward * backward)[lane, step]
    return out / out.sum(axis=1, keepdims=True)


def learn(labelled: DataFrame):
    """(languages, weights, transitions) from a bounded sample of *labelled* (doc_id, text,
    lang): ``FIT_DOCUMENTS`` documents of a language in the order of a hash, and a passage
    of ``FIT_CHARACTERS`` characters of each from a place that the hash picks."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    ids = top_n(rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(5)).alias("_h")),
                ["lang"], [F.col("_h"), F.col("doc_id")], FIT_DOCUMENTS).select("doc_id", "lang").distinct()
    room = F.greatest(F.length("text") - FIT_CHARACTERS, F.lit(0)) + 1
    sample = (rows.join(F.broadcast(ids), ["doc_id", "lang"])  # at most FIT_DOCUMENTS a language
              .select("doc_id", "lang", F.substring("text", 1 + F.pmod(F.xxhash64("doc_id"), room),
                                                    F.lit(FIT_CHARACTERS)).alias("text"))
              .orderBy("lang", "doc_id", "text").collect())
    names = sorted({r.lang for r in sample})
    if not names:
        return [], np.zeros((BUCKETS, 0)), np.zeros((0, 0))
    weights, hops = fit([r.text for r in sample], [names.index(r.lang) for r in sample], len(names))
    return names, weights.astype(np.float32), hops


def language_id(docs: DataFrame, model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) per row of *docs* (doc_id, text).

    The language with the largest mean posterior over all words of the whole text, and
    that mean. ``und`` with score 0 if the text is null, has no letter, or nothing was
    learned; ties go to the first language in order. Repeated rows each give a row; the
    columns named in *keep* go with it, others are ignored. ``n_switches`` counts neighbouring words with different likeliest
    languages."""
    names, weights, hops = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS x languages, fixed

    def predict(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = part.num_rows
        data, starts = flat(part.column("text"))
        share = np.zeros((rows, max(len(names), 1)))
        words, switches = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        if names and len(data):
            bucket, begin, kind, row = word_types(data, starts)
            marginal = posteriors(emissions(shared.value, bucket, begin)[kind].astype(float), hops, row, rows)
            words = np.bincount(row, minlength=rows)
            for k in range(len(names)):
                share[:, k] = np.bincount(row, weights=marginal[:, k], minlength=rows)
            share /= np.maximum(words, 1)[:, None]
            best = marginal.argmax(axis=1)
            changed = (best[1:] != best[:-1]) & (row[1:] == row[:-1])
            switches = np.bincount(row[1:][changed], minlength=rows)
            ascii_letters = letter_table()
            ascii_letters[0x80:] = False
            total = np.concatenate(([0], np.cumsum(ascii_letters[data], dtype=np.int64)))
            for i in np.flatnonzero((words > 0) & (total[starts[1:]] == total[starts[:-1]])):
                if not any(map(str.isalpha, part.column("text")[i].as_py())):
                    words[i] = 0
        known = words > 0
        pick = share.argmax(axis=1)
        label = [names[k] if ok else UNKNOWN for k, ok in zip(pick, known, strict=True)]
        score = np.where(known, np.clip(share[np.arange(rows), pick], 0, 1), 0.0)
        return pa.RecordBatch.from_arrays(
            [part.column("_id"), pa.array(label, pa.string()), pa.array(score), pa.array(words),
             pa.array(np.where(known, switches, 0)), *[part.column(c) for c in keep]],
            names=["doc_id", "lang_pred", "score", "n_words", "n_switches", *keep])

    others = [c for c in keep if c != "text"]
    kinds = dict(docs.dtypes)
    schema = "doc_id long, lang_pred string, score double, n_words long, n_switches long" + "".join(
        f", `{c}` {kinds[c]}" for c in keep)
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("_id"), "text", *others), predict, schema)


def held_out():
    """Documents that the fit never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
