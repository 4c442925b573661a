"""MinHash near-dedup with SetSketch registers: banded, estimated jointly, verified."""

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

WORDS, PERCENT, RECALL, REGISTERS = 3, 85, 0.9999, 128
#: Registers are floor(1 - log_BASE of the least exponential value of rate RATE), held to 0 .. TOP.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair is dropped unread if its registers are so much (as a logarithm) likelier at another similarity.
DOUBT = 10.0
#: Rounds in which buckets link to one member each; texts and shingles of one side of a block after that.
STAR_ROUNDS, BLOCK_TEXTS, BLOCK_SHINGLES = 2, 2000, 400_000


def bands_and_rows(percent: int = PERCENT, recall: float = RECALL, registers: int = REGISTERS) -> tuple[int, int]:
    """The most registers a band may have so that a pair at the threshold shares some band with
    probability *recall*, within *registers*. Equal registers are at least as likely as the similarity."""
    best = (registers, 1)
    for rows in range(1, registers + 1):
        bands = 1 if percent >= 100 else int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** rows)))
        if bands * rows <= registers:
            best = (bands, rows)
    return best


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(0x20)


def shingles(column: pa.Array, n: int):
    """Distinct (hash, row) sorted by row and hash, the cuts between rows, and two hashes
    and the length of each row's word sequence. A text of fewer than *n* words is one shingle."""
    data, starts = flat(column)
    rows = len(starts) - 1
    data = lowered(data)
    first, end, row = runs(data, starts, non_space())
    words = Rolling(data).of(first, end)
    count = np.bincount(row, minlength=rows)
    stop = np.cumsum(count)
    place = (np.arange(len(row)) - (stop - count)[row]).astype(np.uint64)
    keys = []
    for salt in (3, 4):
        own = mix(words ^ mix(np.full(1, salt, np.uint64))) * mix(place * np.uint64(2) + np.uint64(salt))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own)))
        keys.append(total[stop] - total[stop - count])
    gram, at = grams(words, row, n)
    short = np.flatnonzero((count > 0) & (count < n))
    gram, row = np.concatenate((gram, mix(keys[0][short]))), np.concatenate((row[at], short))
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    return gram, row, np.searchsorted(row, np.arange(rows + 1)), keys, count


def registers_of(least: np.ndarray) -> np.ndarray:
    """Registers from least hashes: a hash is a uniform number, the least one gives the least
    exponential value, and its logarithm is truncated."""
    uniform = (least.astype(np.float64) + 0.5) / 2.0 ** 64
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketched(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, words, size, registers, bands): registers are 16-bit numbers one after the
    other; a band is a hash of its registers. Registers merge by their maxima."""
    scale = np.random.default_rng(41).integers(1, 1 << 63, (bands * rows, 2), dtype=np.uint64)

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        gram, row, cuts, keys, count = shingles(part.column("text"), n)
        has = np.flatnonzero(cuts[1:] > cuts[:-1])
        sketch = np.zeros((part.num_rows, bands * rows), np.uint16)
        band = np.zeros((part.num_rows, bands), np.uint64)
        scratch = np.empty_like(gram)
        for k, (a, b) in enumerate(scale):
            np.multiply(gram, a | np.uint64(1), out=scratch)
            np.add(scratch, b, out=scratch)
            if len(has):
                sketch[has, k] = registers_of(np.minimum.reduceat(scratch, cuts[has]))
            band[has, k // rows] = mix(band[has, k // rows] * np.uint64(31) + sketch[has, k])
        bounds = pa.array(np.arange(part.num_rows + 1) * bands, pa.int32())
        return record("doc_id k1 k2 words size registers bands", part.column("doc_id"), keys[0].view(np.int64),
                      keys[1].view(np.int64), count, np.diff(cuts), pa.array([r.tobytes() for r in sketch], pa.binary()),
                      pa.ListArray.from_arrays(bounds, pa.array(band.ravel().view(np.int64))))
    return map_texts(docs, sign, "doc_id long, k1 long, k2 long, words long, size long, registers binary, bands array<long>")


def log_likelihood(above, below, equal, u, v, j):
    """Of the counts of registers above, below and equal in two sketches, for relative sizes u + v = 1
    and Jaccard similarity j."""
    def p(x):
        return -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    return (above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny))
            + equal * np.log(np.maximum(1 - up - down, tiny)))


def best_similarity(above, below, equal, u, v) -> np.ndarray:
    """The similarity that makes the counts likeliest; the likelihood has one summit, found by
    golden sections."""
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        step = (high - low) * 0.381966
        a, b = low + step, high - step
        left = log_likelihood(above, below, equal, u, v, a) > log_likelihood(above, below, equal, u, v, b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def plausible(one: np.ndarray, two: np.ndarray, size_one: np.ndarray, size_two: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sketches leave a similarity of the threshold or more open."""
    above, below = (one > two).sum(axis=1), (one < two).sum(axis=1)
    equal = one.shape[1] - above - below
    u = size_one / (size_one + size_two)
    v = 1 - u
    best = best_similarity(above, below, equal, u, v)
    at = np.minimum(percent / 100, np.minimum(u / v, v / u))
    gap = log_likelihood(above, below, equal, u, v, best) - log_likelihood(above, below, equal, u, v, at)
    return (best >= at) | (gap <= DOUBT)


def similar_pairs(pairs: DataFrame, texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of *pairs* that are linked: sizes that allow it, then registers that do, then the
    shingles themselves."""
    def side(df, name, *columns):
        return df.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    def estimate(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(f"{s}_registers").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                        for s in "ab")
            sizes = [batch.column(f"{s}_size").to_numpy().astype(np.float64) for s in "ab"]
            yield batch.select(["a", "b"]).filter(pa.array(plausible(one, two, *sizes, percent)))

    def compare(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    sized = (pairs.join(side(texts, "a", "size", "registers"), "a").join(side(texts, "b", "size", "registers"), "b")
             .where(small * 100 >= large * percent))
    open_pairs = pin(sized.mapInArrow(estimate, "a long, b long"))
    both = open_pairs.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b")
    return both.mapInArrow(compare, "a long, b long")


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Two sorted sets of distinct shingles."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    common = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return 100 * common >= percent * (len(one) + len(two) - common)


def joined_parts(part: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """What the parts (0 .. k - 1) of some texts are once every link between texts of different sides
    (or any two, without sides) is taken: the smallest part each part reaches.

    A text's shingles are looked up in an inverted index of all texts, which counts what it
    shares with each. Only one number a part is kept, never a list of pairs.
    """
    n, size = len(part), np.array([len(s) for s in sets])
    owner, values = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    posting = owner[order]
    ranked = values[order]
    label = np.arange(part.max() + 1)
    for t in range(n):
        lo, hi = np.searchsorted(ranked, sets[t], "left"), np.searchsorted(ranked, sets[t], "right")
        length = hi - lo
        at = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(posting[at], minlength=n)
        near = 100 * common >= percent * (size[t] + size - common)
        if side is not None:
            near &= side != side[t]
        found = np.unique(label[part[near]])
        own = label[part[t]]
        if len(found) and (len(found) > 1 or found[0] != own):
            low = min(own, found[0])
            label[np.isin(label, found) | (label == own)] = low
    return label


def sketch_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of *docs* (doc_id, text; other columns are
    ignored, whatever their names).

    A text's set holds its distinct *n*-word shingles, A-Z in lower case; a text of fewer words is one shingle.
    Texts are linked if ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    doc_id that links reach. Null, empty and wordless texts have no shingles and are linked with
    nothing: their component is their own doc_id. Texts of one word sequence are copies and linked, rows that repeat an id too; a null
    doc_id never names a component unless no member has an id, and ``kept`` is false for it. An empty
    table gives no rows.

    One text of each group of copies is sketched. Texts that share a band of registers are candidates. A bucket links
    its members to one of them; these pairs pass the joint estimate and then the full sets, and what is
    linked becomes one part. After ``STAR_ROUNDS`` rounds with other members, only buckets that still hold several parts go on: there all members are compared, in
    pairs of blocks, for links between parts. No link between parts is lost but by the bands' recall, and no pair inside a part is formed.
    """
    bands, rows = bands_and_rows(percent, recall)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = pin(sketched(ids, n, bands, rows))
    node = F.xxhash64("k1", "k2", "words")
    groups = pin(signed.where("words > 0").groupBy("k1", "k2", "words").agg(
        F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("registers").alias("registers"),
        F.min("bands").alias("bands")).withColumn("node", node))
    members = groups.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    full = members.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = pin(members.join(full.drop("n"), ["band", "hash"]).select("node", "size", "band", "hash"))
    candidates = members.select("node").distinct()
    texts = pin(groups.join(candidates, "node").select("node", "size", "registers", "k1", "k2", "words", "rep"))

    def sets_of(part: pa.RecordBatch) -> pa.RecordBatch:
        gram, row, cuts, keys, count = shingles(part.column("text"), n)
        return record("k1 k2 words set", keys[0].view(np.int64), keys[1].view(np.int64), count,
                      pa.array([gram[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    # one document of a group has its least id; the few texts that ids clash on drop out by their keys
    wanted = texts.select(F.col("rep").alias("doc_id"))
    with_id = ids.join(wanted.where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi").select("text")
    sets_input = with_id.unionByName(ids.where("doc_id IS NULL").select("text"))
    sets = pin(map_texts(sets_input, sets_of, "k1 long, k2 long, words long, set binary")
               .join(texts.select("k1", "k2", "words"), ["k1", "k2", "words"], "left_semi")
               .groupBy(node.alias("node")).agg(F.first("set").alias("set")))  # equal for equal keys

    links = texts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    parts = texts.select("node", F.col("node").alias("part"))
    for turn in range(STAR_ROUNDS):
        placed = members.join(parts, "node")
        order = F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"), F.col("part"))
        hubs = placed.groupBy("band", "hash").agg(F.min(order).alias("hub"), F.min("part").alias("lo"),
                                                  F.max("part").alias("hi")).where("lo <> hi")
        stars = placed.join(hubs, ["band", "hash"]).where(F.col("part") != F.col("hub.part")).select(
            F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        links = pin(links.unionByName(similar_pairs(stars, texts, sets, percent)))
        parts = pin(merged(texts, links))
    links = links.unionByName(rest_links(members, parts, sets, percent))
    found = merged(texts, links).select("node", F.col("part").alias("component"))
    named = groups.select("k1", "k2", "words", "node", "rep").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    wordy = signed.where("words > 0").select("doc_id", "size", "k1", "k2", "words").join(
        named.join(least, "component").select("k1", "k2", "words", "component_id"), ["k1", "k2", "words"])
    every = wordy.select("doc_id", "size", "component_id").unionByName(
        signed.where("words = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("size").alias("n_shingles"), "component_id",
                        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def merged(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part): the smallest node that *links* (a, b) reach."""
    reached = components(links)
    return texts.select("node").join(reached, "node", "left").select(
        "node", F.coalesce("component", "node").alias("part"))


def rest_links(members: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the parts that still meet in a bucket, all members against all, in pairs
    of blocks. Buckets with equal members are compared once; a bucket of two has been compared."""
    placed = members.join(parts, "node")
    buckets = placed.groupBy("band", "hash").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("lo <> hi AND n > 2")
    once = buckets.groupBy("mark", "n").agg(F.min(F.struct("band", "hash")).alias("b"), F.max("total").alias("total"))
    blocks = (F.greatest(F.col("n") / BLOCK_TEXTS, F.col("total") / BLOCK_SHINGLES).cast("long") + 1).alias("blocks")
    chosen = pin(once.select("b.band", "b.hash", blocks, "total"))
    tasks = max(1, int((chosen.agg(F.sum("total")).first()[0] or 0) // BLOCK_SHINGLES))
    work = (placed.join(chosen, ["band", "hash"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .withColumn("task", F.when(F.col("blocks") > 1, F.xxhash64("band", "hash", "i", "j")).otherwise(
                F.pmod(F.xxhash64("band", "hash"), F.lit(tasks))))
            .select("task", "band", "hash", "i", "j", "block", "node", "part"))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})]
        for (_, _, i, j), meeting in frame.groupby(["band", "hash", "i", "j"], sort=False):
            names, part = np.unique(meeting.part.to_numpy(), return_inverse=True)
            side = meeting.block.to_numpy() if i != j else None
            label = joined_parts(part, side, [np.frombuffer(s, np.uint64) for s in meeting["set"]], percent)
            moved = np.flatnonzero(label != np.arange(len(label)))
            out.append(pd.DataFrame({"a": names[moved], "b": names[label[moved]]}))
        return pd.concat(out)
    return work.join(sets, "node").groupBy("task").applyInPandas(verify, "a long, b long")
