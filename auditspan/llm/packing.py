"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered, pin
from .texts import Rolling, flat, non_space, record, runs, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY, END = 4096, 1
TAIL = b".,!?;:"


class Memo:
    """Token ids of the distinct words a task has met.

    The tokenizer drops white space and never merges across it, so the ids of a text are
    those of its words in order. A trailing run of stops after an ASCII letter or digit is
    a word of its own as well, which leaves far fewer distinct words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.size = np.array([END], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin and how many they are. Words of
        letters are one closed token run each, so many are encoded at once and split at
        the tokens that close a word."""
        ids, begin, size = [], np.zeros(len(words), np.int64), np.full(len(words), -1)
        plain, total = [i for i, w in enumerate(words) if w.isalpha()], 0
        for k in range(0, len(plain), 2000):
            some = plain[k:k + 2000]
            got = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, np.int32)
            closed = np.zeros(len(got), bool)
            known = got < len(self.closes)
            closed[known] = self.closes[got[known]]
            stops = np.flatnonzero(closed) + 1
            if len(stops) == len(some) and len(got) == stops[-1]:
                size[some] = np.diff(stops, prepend=0)
                begin[some] = total + stops - size[some]
                ids.append(got)
                total += len(got)
        rest = np.flatnonzero(size < 0)
        for i, code in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            got = code.ids
            begin[i], size[i] = total, len(got)
            ids.append(np.array(got, np.int32))
            total += len(got)
        return np.concatenate([np.zeros(0, np.int32), *ids]), begin, size

    def look_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words data[begin:end]."""
        found, at, back = np.unique(Rolling(data).of(begin, end), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, found).clip(max=max(len(self.hashes) - 1, 0))
        fresh = np.flatnonzero(self.hashes[spot] != found) if len(self.hashes) else np.arange(len(found))
        if len(fresh):
            first, length = begin[at[fresh]], (end - begin)[at[fresh]]
            bounds = np.cumsum(length + 1)  # one after the other, a space behind each
            text = np.full(bounds[-1], 0x20, np.uint8)
            inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            text[np.repeat(bounds - length - 1, length) + inside] = data[np.repeat(first, length) + inside]
            ids, start, size = self.encode(text[:-1].tobytes().decode("utf-8", "replace").split(" "))
            number = len(self.size) + np.arange(len(fresh))
            self.begin = np.append(self.begin, len(self.ids) + start)
            self.size = np.append(self.size, size)
            self.ids = np.concatenate((self.ids, ids))
            where = np.searchsorted(self.hashes, found[fresh])
            self.hashes = np.insert(self.hashes, where, found[fresh])
            self.place = np.insert(self.place, where, number)
        return self.place[np.searchsorted(self.hashes, found)][back]

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by ``END``, and where each row starts."""
        data, starts = flat(column)
        rows = len(starts) - 1
        first, end, row = runs(data, starts, non_space())
        tail, alnum = np.zeros(256, bool), np.zeros(256, bool)
        tail[list(TAIL)] = True
        alnum[0x30:0x3A] = alnum[0x41:0x5B] = alnum[0x61:0x7B] = True
        # last byte before the trailing run of stops
        stop = np.maximum.accumulate(np.where(tail[data], -1, np.arange(len(data)))) + 1 if len(data) else np.zeros(0, np.int64)
        cut = stop[end - 1] if len(end) else end
        cut = np.where((cut > first) & (cut < end), cut, end)
        cut = np.where(alnum[data[cut - 1]], cut, end) if len(cut) else cut
        folded, marks = data.copy(), np.concatenate(([0], np.cumsum(data == ord("<"), dtype=np.int64)))
        upper = np.flatnonzero((data >= 0x41) & (data <= 0x5A))
        special = marks[end] > marks[first]  # may hold a special token, which is matched as it is
        if special.any() and len(upper):
            owner = np.searchsorted(first, upper, "right") - 1
            upper = upper[~special[owner]]
        folded[upper] += 32
        # order of the parts of a row: word, its stops, and at last the closing id
        has = cut < end
        before = np.cumsum(has) - has
        at = np.arange(len(first)) + before + row
        words_to = np.searchsorted(row, np.arange(rows), "right")
        close = words_to + np.concatenate(([0], np.cumsum(has)))[words_to] + np.arange(rows)
        part = np.zeros(len(first) + int(has.sum()) + rows, np.int64)
        begin, finish = np.concatenate((first, cut[has])), np.concatenate((cut, end[has]))
        part[np.concatenate((at, at[has] + 1))] = self.look_up(folded, begin, finish)
        part[close] = 0
        size = self.size[part]
        place = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.begin[part] - place, size) + np.arange(size.sum())]
        ends = place[close] + 1
        return ids, np.concatenate(([0], ends))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): token sequences of all whole
    texts, only those longer than *capacity* cut. *tokenizer* is the path of its file."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        memo = None
        for batch in batches:
            for part in slices(batch, "text"):
                memo = memo or Memo(tokenizer)
                ids, starts = memo.tokens(part.column("text"))
                total = np.diff(starts)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = starts[row] + piece * capacity
                length = np.minimum(total[row] - piece * capacity, capacity)
                raw = ids.astype("<u4")
                crc = np.array([zlib.crc32(raw[a:a + n]) for a, n in zip(begin, length, strict=True)], np.int64)
                columns = [part.column("doc_id").take(pa.array(row)), piece.astype(np.int32), piece * capacity, length, crc]
                names = "doc_id piece start length ids_crc32"
                if with_ids:
                    # pieces follow one another without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, starts[-1]), pa.int32()), pa.array(ids)))
                    names += " ids"
                yield record(names, *columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def fullest(room: int, left: dict[int, int]) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to *room*: bit s of
    ``reach`` says that some choice adds up to s. The search ends early at a perfect fit."""
    if left.get(room):
        return {room: 1}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        count, step = min(left[length], room // length), 1
        while count:
            step = min(step, count)
            wider = (reach | reach << (length * step)) & mask
            if wider != reach:
                steps.append((reach, length, step))
                reach = wider
            count -= step
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for earlier, length, step in reversed(steps):
        if not earlier >> total & 1:
            total -= length * step
            out[length] = out.get(length, 0) + step
    return out


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths in each) until nothing is left: the longest length opens a bin, the
    fullest combination of the others joins it, and the pattern repeats while it can.

    Every pattern leaves some length with fewer rows than the pattern holds of it, so
    there are at most capacity x (1 + 1/2 + ... + 1/capacity) patterns whatever the data.
    """
    left, out = {k: n for k, n in counts.items() if n}, []
    heads = sorted(left, reverse=True)
    for head in heads:
        while left.get(head):
            left[head] -= 1
            fill = fullest(capacity - head, {k: n for k, n in left.items() if n}) if capacity > head else {}
            left[head] += 1
            pattern = dict(fill)
            pattern[head] = pattern.get(head, 0) + 1
            bins = min(left[k] // n for k, n in pattern.items())
            out.append((bins, pattern))
            for k, n in pattern.items():
                left[k] -= bins * n
                if not left[k]:
                    del left[k]
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """*pieces* (doc_id, piece, length 1 to *capacity*, ...) with sequence_id and offset.

    The driver sees one count per length, *capacity* numbers at most; pieces of a length
    are interchangeable, so each finds its bin from its number among them. *pieces* is
    read twice: give it stored.
    """
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, taken, bins = [], dict.fromkeys(counts, 0), 0
    for times, pattern in minimum_slack(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            table.append((length, taken[length], n, bins, offset))
            taken[length] += times * n
            offset += n * length
        bins += times
    table = np.array(sorted(table), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded as minimum_slack says
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    order = pieces.withColumn("_h", spread)
    ranked = numbered(order, ["length"], ["_h", "doc_id", "piece", "ids_crc32"], F.shiftright("_h", 54), "_n")
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches):
        table = shared.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_n").to_numpy() - 1
            row = table[np.searchsorted(keys, (length << 44) | number, "right") - 1] if len(table) else table
            since = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names[:-2]], pa.array(row[:, 3] + since // row[:, 2]),
                 pa.array(row[:, 4] + since % row[:, 2] * length)], names=names)
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.drop("_h").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of *docs* (doc_id, text; other columns are ignored)
    with its sequence and place in it.

    A null or empty text is the closing id alone. Repeated rows are packed each. An empty
    table gives no rows.
    """
    return packed(pin(token_pieces(docs, tokenizer, capacity, with_ids)), capacity)
