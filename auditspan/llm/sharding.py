"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a partition, and partitions whose rows of the matrix one task draws.
PART_ROWS, GROUP = 1 << 16, 1024
#: What numpy's own sampler takes; the sampler below draws the same law at any size.
NUMPY_LIMIT = 10 ** 9


def log_rising(a: np.ndarray | float, d: float) -> float:
    """log gamma(a + d) - log gamma(a) - d log(a), without the cancellation of two large logarithms."""
    if a < 64:  # too small for the series: step up first
        steps = np.arange(64)
        return log_rising(a + 64, d) + d * np.log1p(64 / a) - np.log1p(d / (a + steps)).sum()
    def tail(x):
        return (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return (a + d - 0.5) * np.log1p(d / a) - d + tail(a + d) - tail(a)


def ratio_of_uniforms(rng, good: int, bad: int, drawn: int) -> int:
    """Good ones among *drawn* by acceptance and rejection under a hat of two uniforms (HRUA); the ratio of
    probabilities to that of the mode comes from differences of log gammas, exact to double precision at any size."""
    total = good + bad
    few, many = min(good, bad), max(good, bad)
    sample = min(drawn, total - drawn)
    share = few / total
    spread = np.sqrt((total - sample) * sample * share * (1 - share) / (total - 1) + 0.5)
    # width of the hat: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
    width, centre = 1.7155277699214135 * spread + 0.8989161620588988, sample * share + 0.5
    mode = int((sample + 1) * (few + 1) // (total + 2))
    end = min(min(sample, few) + 1.0, np.floor(centre + 16 * spread))

    def log_ratio(k: int) -> float:
        """log of P(k) / P(mode). The linear terms of the four factorials meet in one logarithm."""
        d = k - mode
        parts = ((mode + 1, d), (few - mode + 1, -d), (sample - mode + 1, -d), (many - sample + mode + 1, d))
        linear = d * (np.log((few - mode + 1) / (mode + 1)) + np.log((sample - mode + 1) / (many - sample + mode + 1)))
        return linear - sum(log_rising(float(a), float(x)) for a, x in parts)
    while True:
        u, v = rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        if x < 0 or x >= end:
            continue
        k = int(np.floor(x))
        t = log_ratio(k)
        if u * (4 - u) - 3 <= t or (u * (u - t) < 1 and 2 * np.log(u) <= t):
            break
    if good > bad:
        k = sample - k
    return k if drawn <= total - drawn else good - k


def hypergeometric(rng, good: int, bad: int, drawn: int) -> int:
    """Good ones among *drawn*, exactly hypergeometric at any size."""
    if not good or not bad or not drawn:
        return min(good, drawn)
    if drawn == good + bad:
        return good
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    if min(good, bad, drawn, good + bad - drawn) < 16:
        return by_steps(rng, good, bad, drawn)
    return ratio_of_uniforms(rng, good, bad, drawn)


def by_steps(rng, good: int, bad: int, drawn: int) -> int:
    """Good ones among *drawn*, one by one over the smallest of the four classes."""
    total = good + bad
    if good > bad:
        return drawn - by_steps(rng, bad, good, drawn)
    if drawn > total - drawn:
        return good - by_steps(rng, good, bad, total - drawn)
    if drawn < good:  # the law does not change when classes and draws trade places
        good, drawn = drawn, good
    hit = 0
    for k in range(good):
        hit += int(rng.integers(total - k)) < drawn - hit
    return hit


def draw_matrix(counts: list[int], margins: list[int], seed: list[int]) -> list[list[int]]:
    """Rows of counts with the given sums whose columns add up to *margins*: how many
    rows of each partition a uniform shuffle sends to each shard."""
    rng, left, out = np.random.default_rng(seed), list(margins), []
    for count in counts:
        row, need, rest = [], count, sum(left)
        for shard, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, need)
            row.append(got)
            left[shard] -= got
            need -= got
        out.append(row)
    return out


def communication_matrix(counts: DataFrame, margins: list[int], seed: int) -> DataFrame:
    """(part, ends): running ends of the shares of each shard in the order of a partition.

    *counts* has (part, n). Counts of whole groups of partitions are drawn first, then
    each group draws its own partitions against what it got, so a task sees ``GROUP``
    partitions or the groups' sums only.
    """
    grouped = counts.withColumn("grp", F.floor(F.col("part") / GROUP).cast("long"))

    def upper(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("grp")
        drawn = draw_matrix(frame.n.astype(int).tolist(), margins, [seed, 1])
        return pd.DataFrame({"grp": frame.grp, "margins": drawn})

    def lower(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        drawn = draw_matrix(frame.n.astype(int).tolist(), [int(x) for x in frame.margins.iloc[0]],
                            [seed, 2, int(frame.grp.iloc[0])])
        return pd.DataFrame({"part": frame.part, "ends": [np.cumsum(row).tolist() for row in drawn]})

    sums = grouped.groupBy("grp").agg(F.sum("n").alias("n"))
    tops = sums.groupBy(F.lit(0).alias("all")).applyInPandas(upper, "grp long, margins array<long>")
    return grouped.join(tops, "grp").groupBy("grp").applyInPandas(lower, "part long, ends array<long>")


def shuffle_to_shards(df: DataFrame, shards: int, by: list[str], seed: int = 3,
                      part_rows: int = PART_ROWS) -> DataFrame:
    """*df* with ``shard`` (0 to *shards* - 1) and ``slot`` (gapless from 0 in a shard).

    Shard sizes differ by one row at most and every arrangement is equally likely as far
    as the hashes of *by* are random: partitions are hash classes (so a task that is run
    again finds the same rows), each is permuted by a second hash and cut by its row of
    the matrix, and each shard is permuted again by a third hash. *by* names the columns
    that tell rows apart; rows equal in all of them are interchangeable. Nulls count as
    values. An empty table stays empty. Columns named ``_part``, ``_rank``, ``_cell``,
    ``_u``, ``shard`` or ``slot`` must not be there already.
    """
    rows = df.count()
    parts, shard_cells = max(1, -(-rows // part_rows)), max(1, -(-rows // (part_rows * shards)))
    margins = [rows // shards + (s < rows % shards) for s in range(shards)]

    def scrambled(salt: int):
        return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(c) for c in by])

    tagged = df.withColumn("_part", F.pmod(scrambled(1), F.lit(parts)))
    matrix = communication_matrix(tagged.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")),
                                  margins, seed)
    inside = Window.partitionBy("_part").orderBy(scrambled(2), *by)
    sent = (tagged.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(matrix, F.col("_part") == F.col("part"))
            .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_rank"))).cast("int"))
            .withColumn("_u", scrambled(3))
            .withColumn("_cell", F.floor((F.col("_u") / 2.0 ** 64 + 0.5) * shard_cells))
            .drop("part", "ends", "_part", "_rank"))
    cells = sent.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col("shard").alias("_s"), F.col("_cell").alias("_c"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    again = Window.partitionBy("shard", "_cell").orderBy("_u", *by)
    return (sent.withColumn("slot", F.row_number().over(again) - 1)
            .join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_cell") == F.col("_c")))
            .withColumn("slot", (F.col("slot") + F.col("_before")).cast("long"))
            .drop("_s", "_c", "_before", "_cell", "_u"))
