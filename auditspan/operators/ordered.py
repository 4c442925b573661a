"""Ordered per-group logic that keeps working when one group is huge.

A plain ``OVER (PARTITION BY key ORDER BY ...)`` sends a whole group to one
task. The helpers here cut a group into blocks first (a monotone, coarse
expression of the ordering, for example an hour or a run of line numbers),
summarise the blocks, and combine: only summaries ever meet in one task.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def _cols(keys):
    return [F.col(k) for k in keys]


def same(keys, left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def top_n(df: DataFrame, keys, order, n: int, name: str = "rn",
          salts: int = SALTS) -> DataFrame:
    """First *n* rows of every group, numbered from 1 in *name*.

    Two rounds: each of *salts* slices of a group keeps its own first n, then
    the group picks among at most ``salts * n`` rows.
    """
    slices = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns
                                 if not _is_complex(df, c)]), F.lit(salts))
    part = Window.partitionBy(*_cols(keys), "_slice").orderBy(*order)
    full = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return (df.withColumn("_slice", slices)
            .withColumn(name, F.row_number().over(part)).where(F.col(name) <= n)
            .drop("_slice", name)
            .withColumn(name, F.row_number().over(full)).where(F.col(name) <= n))


def _is_complex(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def running_totals(df: DataFrame, keys, order, block: Column, **sums) -> DataFrame:
    """Inclusive running sums per group, e.g. ``n=F.lit(1)`` for a row number."""
    keys = list(keys)
    tagged = df.withColumn("_block", block)
    for name, value in sums.items():
        tagged = tagged.withColumn(name, value.cast("bigint"))
    totals = tagged.groupBy(*keys, "_block").agg(
        *[F.sum(n).alias(f"_t_{n}") for n in sums])
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(over_blocks), F.lit(0)).alias(f"_c_{n}")
          for n in sums])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = tagged.select(
        "*", *[F.sum(n).over(inside).alias(f"_s_{n}") for n in sums]).alias("l")
    joined = local.join(carried.alias("r"), same([*keys, "_block"], "l", "r"))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"_s_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, keys, order, block: Column, name: str = "seq") -> DataFrame:
    """Row number from 1 per group."""
    return running_totals(df, keys, order, block, **{name: F.lit(1)})


def previous_value(df: DataFrame, keys, order, block: Column, value: Column,
                   name: str) -> DataFrame:
    """Value of the preceding row of the group (NULL on the first row)."""
    keys = list(keys)
    order_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    tagged = df.withColumn("_block", block).withColumn("_value", value)
    lasts = tagged.groupBy(*keys, "_block").agg(
        F.max_by("_value", order_struct).alias("_last"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    carried = lasts.select(*keys, "_block", F.lag("_last").over(over_blocks).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = tagged.select("*", F.lag("_value").over(inside).alias("_prev"),
                          F.row_number().over(inside).alias("_pos")).alias("l")
    joined = local.join(carried.alias("r"), same([*keys, "_block"], "l", "r"))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_prev")).alias(name))


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder the cluster names; only a local session, as in tests,
    may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(configured or os.path.join(
        tempfile.mkdtemp(prefix="auditspan-"), "checkpoints"))


def pin(df: DataFrame) -> DataFrame:
    """Store an intermediate that several branches read, and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ordered_position(df: DataFrame, keys, order, name: str = "pos") -> DataFrame:
    """Exact 0-based position per group without gathering any group.

    Range-partitions by (keys, order), so a huge group spans many partitions.
    The sorted rows are checkpointed once, which pins the partition layout that
    the offsets below are computed from.
    """
    keys = list(keys)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = [*_cols(keys), *[F.col(o) if isinstance(o, str) else o for o in order]]
    laid_out = (df.repartitionByRange(*by).sortWithinPartitions(*by)
                .withColumn("_mid", F.monotonically_increasing_id()).checkpoint())
    pid = F.shiftright("_mid", 33)
    spot = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # one summary row per (partition, group): a partition holds few whole groups
    parts = (laid_out.groupBy(*keys, pid.alias("_pid"))
             .agg(F.min(spot).alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_pid", "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    left = laid_out.withColumn("_pid", pid).withColumn("_spot", spot).alias("l")
    joined = left.join(offsets.alias("r"), same([*keys, "_pid"], "l", "r"))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._spot") - F.col("r._first") + F.col("r._before")).cast("bigint").alias(name))


# ---- few and crowded groups ---------------------------------------------
#: Rows of a small side that a join sends to every task.
FEW_SIDE = 100_000


def few(stored: DataFrame) -> DataFrame:
    """A stored side of a join, sent to every task if it has few rows."""
    return F.broadcast(stored) if stored.count() <= FEW_SIDE else stored


def crowded_groups(df: DataFrame, keys, most: int) -> DataFrame | None:
    """Hashes of the groups with more than *most* rows, None if there are none. A small group that shares
    the hash of a crowded one counts as crowded, which costs time only."""
    found = pin(df.groupBy(F.xxhash64(*_cols(keys)).alias("_spot")).agg(F.count(F.lit(1)).alias("_rows")).where(
        F.col("_rows") > most).select("_spot"))
    return None if found.isEmpty() else found


def split_crowded(df: DataFrame, keys, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the other groups, and rows of the crowded ones."""
    tagged = df.withColumn("_spot", F.xxhash64(*_cols(keys)))
    return tuple(tagged.join(crowded, "_spot", how).drop("_spot") for how in ("left_anti", "left_semi"))


# ---- line neighbourhoods ------------------------------------------------
# "Within three lines, or either line unknown" becomes an equality on targets.
ANY_LINE = -2_147_483_648
UNKNOWN_LINE = -2_147_483_647


def line_targets(line: Column, reach: int = 3) -> Column:
    """Targets a row answers to: lines around it, plus the two markers."""
    return F.when(line.isNull(), F.array(F.lit(ANY_LINE), F.lit(UNKNOWN_LINE))).otherwise(
        F.concat(F.sequence(line - reach, line + reach), F.array(F.lit(ANY_LINE))))


def line_lookups(line: Column) -> Column:
    """Targets a row asks for: its own line and unknown ones, or any line."""
    return F.when(line.isNull(), F.array(F.lit(ANY_LINE))).otherwise(
        F.array(line, F.lit(UNKNOWN_LINE)))


def merge_ranges(df: DataFrame, keys, lo: str = "lo", hi: str = "hi",
                 gap: int = 2) -> DataFrame:
    """Overlapping or nearly touching line ranges merged per file.

    Ranges with the same start collapse first, so a window never holds more
    rows than the file has lines.
    """
    starts = df.groupBy(*keys, lo).agg(F.max(hi).alias(hi))
    w = Window.partitionBy(*keys).orderBy(lo)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tagged = starts.withColumn(
        "_new", F.when(reach.isNull() | (F.col(lo) > reach + gap), 1).otherwise(0))
    tagged = tagged.withColumn("_island", F.sum("_new").over(w))
    return tagged.groupBy(*keys, "_island").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")
