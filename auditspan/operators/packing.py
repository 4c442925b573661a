"""Order-dependent packing of files and endpoints into batches.

Greedy packing carries a little state along an ordered sequence. A long
sequence is cut into blocks, each summarised as a function from the state before it to
the state after it. Such functions compose associatively, so a parallel prefix gives
every block its entry state: rounds of Spark groups of FAN neighbours compose upwards until one
function a sequence is left, and the same rounds hand states down again. The blocks then assign
their rows in parallel. No group ever holds more than FAN summaries or one block of numbers.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.text import token_estimate
from .ordered import ordered_position, pin, previous_value

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC = ("artifact_id",)
BLOCK, FAN = 20_000, 32


def file_tokens(files: DataFrame, candidates: DataFrame | None = None, keys=DOC):
    """(keys, path, tokens): estimate from the JSON-encoded size of the content,
    plus the candidates that travel with the file."""
    own = files.select(*keys, "path", token_estimate(
        text.json_text_length(F.col("content"))).alias("_t"))
    if candidates is None:
        return own.select(*keys, "path", F.col("_t").alias("tokens"))
    # length of a JSON list of objects: names, values, separators and brackets
    size = F.lit(2)
    for f in candidates.schema:
        if f.name in keys:
            continue
        value = text.json_text_length(F.col(f.name)) if f.dataType.typeName() == "string" \
            else F.length(F.col(f.name).cast("string"))
        size = size + len(f.name) + 6 + F.when(F.col(f.name).isNull(), 4).otherwise(value)
    extra = candidates.groupBy(*keys, F.col("file_path").alias("path")).agg(
        F.sum(size).alias("_c"))
    return own.join(extra, [*keys, "path"], "left").select(
        *keys, "path", (F.col("_t") + F.coalesce(token_estimate(F.col("_c")), F.lit(0)))
        .alias("tokens"))


# ---- greedy packing under a token limit (W15) --------------------------------
def _next_starts(tokens: np.ndarray, limit: int):
    """For a batch starting at each row: tokens left open at the end of the block
    and how many batches closed before that."""
    n = len(tokens)
    prefix = np.concatenate([[0], np.cumsum(tokens)])
    nxt = np.maximum(np.searchsorted(prefix, prefix[:-1] + limit, side="right") - 1,
                     np.arange(n) + 1)
    left = np.empty(n, dtype=np.int64)
    closed = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        if j >= n:
            left[i], closed[i] = prefix[n] - prefix[i], 0
        else:
            left[i], closed[i] = left[j], closed[j] + 1
    return prefix, nxt, left, closed


def entry_states(steps: DataFrame, keys, compose, apply, first, fan: int = FAN) -> DataFrame:
    """(keys, _block, state, batch): with what each block of *steps* (keys, _block and the columns of a
    step) is entered, *first* for block 0.

    ``compose(steps) -> step`` joins neighbouring steps given as dicts, ``apply(state, step) -> state``
    runs one. Each round groups *fan* neighbours, so there are as many rounds up and down as the longest
    sequence has digits in base *fan*; a sequence of one block needs none.
    """
    keys = list(keys)
    inner = [f.name for f in steps.schema if f.name not in (*keys, "_block")]
    schema = T.StructType([*[steps.schema[k] for k in keys], T.StructField("_block", T.LongType()),
                           *[steps.schema[c] for c in inner]])
    out_schema = T.StructType([*[steps.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("_block", "state", "batch")]])
    up = (F.col("_block") / F.lit(fan)).cast("long").alias("_up")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        step = compose(pdf.sort_values("_block")[inner].to_dict("records"))
        return pd.DataFrame([[*key, *[step[c] for c in inner]]], columns=[f.name for f in schema])

    def hand_down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_block"), []
        now = (int(pdf["state"].iat[0]), int(pdf["batch"].iat[0]))
        for block, step in zip(pdf["_block"], pdf[inner].to_dict("records"), strict=True):
            out.append([*key[:-1], int(block), *now])
            now = apply(now, step)
        return pd.DataFrame(out, columns=[f.name for f in out_schema])

    levels = [pin(steps.select(*[f.name for f in schema]))]
    while (levels[-1].agg(F.max("_block")).first()[0] or 0) > 0:
        levels.append(pin(levels[-1].groupBy(*keys, up).applyInPandas(merge, schema)))
    states = levels.pop().select(*keys, "_block", F.lit(first[0]).cast("long").alias("state"),
                                 F.lit(first[1]).cast("long").alias("batch"))
    while levels:
        above = states.withColumnRenamed("_block", "_up")
        nested = levels.pop().withColumn("_up", up).join(above, [*keys, "_up"])
        states = nested.groupBy(*keys, "_up").applyInPandas(hand_down, out_schema)
    return states


def _one_block(rows: DataFrame, keys, first) -> tuple[DataFrame, DataFrame]:
    """Sequences of several blocks, and the entry states of those that fit into one."""
    n = rows.groupBy(*keys).agg(F.max("_block").alias("_b"))
    return n.where("_b > 0").select(*keys), n.where("_b = 0").select(
        *keys, *[F.lit(v).cast("long").alias(c) for c, v in (("_block", 0), ("state", first[0]), ("batch", first[1]))])


class Filling:
    """What a block of tokens does to an open batch, as a step on (tokens open, batch number).

    ``marks`` are the running sums at which the open batch overflows: with a room below marks[j] and not
    below marks[j - 1], row j closes it, ``closed[j]`` more batches close inside and ``left[j]``
    tokens stay open. A room of ``total`` or more takes the whole block. Rooms never exceed the limit, so
    marks beyond it are dropped and a step stays as small as what fits into one batch.
    """

    def __init__(self, limit: int):
        self.limit = limit
        #: Nothing is open: no room, and the batch that opens first is number 0.
        self.first = (limit + 1, -1)

    def step(self, tokens: np.ndarray) -> dict:
        prefix, _, left, closed = _next_starts(tokens, self.limit)
        sums = prefix[1:]
        useful = min(int(np.searchsorted(sums, self.limit, side="right")) + 1, len(sums))
        return {"total": int(prefix[-1]), "marks": sums[:useful].tolist(), "left": left[:useful].tolist(),
                "closed": closed[:useful].tolist()}

    def apply(self, state: tuple[int, int], step: dict) -> tuple[int, int]:
        carry, batch = state
        room = self.limit - carry
        if room >= step["total"]:
            return carry + int(step["total"]), batch
        j = int(np.searchsorted(np.asarray(step["marks"]), room, "right"))
        return int(step["left"][j]), batch + 1 + int(step["closed"][j])

    def compose(self, steps: list[dict]) -> dict:
        out = None
        for step in steps:
            if out is None:
                out = {k: v if k == "total" else list(v) for k, v in step.items()}
                continue
            # rooms that close a batch in the first part enter the second with what is left there
            ends = [self.apply((int(x), int(c)), step) for x, c in zip(out["left"], out["closed"], strict=True)]
            later = [k for k, m in enumerate(step["marks"]) if k == 0 or out["total"] + step["marks"][k - 1] <= self.limit]
            if out["total"] > self.limit:
                later = []
            out = {"total": out["total"] + int(step["total"]),
                   "marks": list(out["marks"]) + [out["total"] + int(step["marks"][k]) for k in later],
                   "left": [e[0] for e in ends] + [int(step["left"][k]) for k in later],
                   "closed": [e[1] for e in ends] + [int(step["closed"][k]) for k in later]}
        return out


def pack_batches(sizes: DataFrame, token_limit: int, keys=DOC, block: int = BLOCK):
    """Batch number per file: path order, a new batch when the next file would
    exceed the limit (a file larger than the limit gets its own). (keys, path) is unique."""
    keys, filling = list(keys), Filling(token_limit)
    rows = ordered_position(pin(sizes.select(*keys, "path", "tokens")), keys, ["path"], "pos") \
        .withColumn("_block", F.floor(F.col("pos") / block))
    key_fields = [rows.schema[k] for k in keys]
    step_schema = T.StructType([
        *key_fields, T.StructField("_block", T.LongType()), T.StructField("total", T.LongType()),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("marks", "left", "closed")]])

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        step = filling.step(pdf.sort_values("pos")["tokens"].to_numpy(np.int64))
        return pd.DataFrame([[*key, *step.values()]], columns=[f.name for f in step_schema])

    long, entries = _one_block(rows, keys, filling.first)
    if not long.isEmpty():
        steps = rows.join(long, keys, "left_semi").groupBy(*keys, "_block").applyInPandas(summarise, step_schema)
        entries = entries.unionByName(entry_states(steps, keys, filling.compose, filling.apply, filling.first))
    out_schema = T.StructType([
        *key_fields, rows.schema["path"], T.StructField("tokens", T.LongType()),
        T.StructField("pos", T.LongType()), T.StructField("batch", T.LongType())])

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tokens = pdf["tokens"].to_numpy(np.int64)
        room, batch = token_limit - int(pdf["state"].iat[0]), int(pdf["batch"].iat[0])
        prefix, nxt, _, _ = _next_starts(tokens, token_limit)
        numbers = np.empty(len(tokens), dtype=np.int64)
        start = int(np.searchsorted(prefix[1:], room, side="right"))
        numbers[:start] = batch
        while start < len(tokens):
            end, batch = min(int(nxt[start]), len(tokens)), batch + 1
            numbers[start:end] = batch
            start = end
        return pdf.assign(batch=numbers)[[f.name for f in out_schema]]

    placed = rows.join(entries, [*keys, "_block"])
    return placed.groupBy(*keys, "_block").applyInPandas(assign, out_schema)


# ---- endpoint batches (W16) -----------------------------------------------------
def endpoint_batches(endpoints: DataFrame, per: int = 40, keys=DOC, block: int = BLOCK):
    """Batch number per endpoint in (handler file, line) order: a batch closes at
    *per* rows, or at half of that when the file changes."""
    keys, per = list(keys), max(5, per)
    half = per // 2
    eps = endpoints.select(*keys, "endpoint_id", F.coalesce(
        "handler_file", "file_path", F.lit("")).alias("_file"),
        F.coalesce("line", F.lit(0)).alias("_line"))
    placed = ordered_position(eps, keys, ["_file", "_line", "endpoint_id"], "pos")
    cut = F.floor(F.col("pos") / block)
    rows = previous_value(placed, keys, ["pos"], cut, F.col("_file"), "_prev").select(
        *keys, "endpoint_id", "pos", cut.alias("_block"),
        (F.col("_file") != F.coalesce("_prev", "_file")).alias("_changed"))
    key_fields = [rows.schema[k] for k in keys]
    step_schema = T.StructType([*key_fields, T.StructField("_block", T.LongType()), *[
        T.StructField(c, T.ArrayType(T.LongType())) for c in ("sizes", "closed")]])

    def run(changed, size, closed):
        """Feed rows to every entry size at once; returns sizes and closings."""
        for moved in changed:
            full = (size >= per) | ((size >= half) & moved & (size > 0))
            closed = closed + full
            size = np.where(full, 1, size + 1)
        return size, closed

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        changed = pdf.sort_values("pos")["_changed"].to_numpy(bool)
        size, closed = run(changed, np.arange(per + 1), np.zeros(per + 1, dtype=np.int64))
        return pd.DataFrame([[*key, size.tolist(), closed.tolist()]],
                            columns=[f.name for f in step_schema])

    def apply(state, step):
        return int(step["sizes"][state[0]]), state[1] + int(step["closed"][state[0]])

    def compose(steps):
        ends = [(size, 0) for size in range(per + 1)]
        for step in steps:
            ends = [apply(state, step) for state in ends]
        return {"sizes": [e[0] for e in ends], "closed": [e[1] for e in ends]}

    long, entries = _one_block(rows, keys, (0, 0))
    if not long.isEmpty():
        steps = rows.join(long, keys, "left_semi").groupBy(*keys, "_block").applyInPandas(summarise, step_schema)
        entries = entries.unionByName(entry_states(steps, keys, compose, apply, (0, 0)))
    out_schema = T.StructType([
        *key_fields, rows.schema["endpoint_id"], T.StructField("pos", T.LongType()),
        T.StructField("batch", T.LongType())])

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        size, batch, out = int(pdf["state"].iat[0]), int(pdf["batch"].iat[0]), []
        for moved in pdf["_changed"].to_numpy(bool):
            if size and (size >= per or (size >= half and moved)):
                batch, size = batch + 1, 0
            size += 1
            out.append(batch)
        return pdf.assign(batch=out)[[f.name for f in out_schema]]

    return rows.join(entries, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(
        assign, out_schema)


# ---- fixed chunks (W17) and splitting a batch (W18) -------------------------------
def fixed_chunks(rows: DataFrame, size: int, keys, order) -> DataFrame:
    """Chunk number and place within the chunk, *size* rows per chunk."""
    placed = ordered_position(rows, keys, order, "_pos")
    return placed.withColumn("chunk", F.floor(F.col("_pos") / size)) \
        .withColumn("ord", F.col("_pos") % size).drop("_pos")


def split_by_file(batch_files: DataFrame, keys=("artifact_id", "batch")) -> DataFrame:
    """Halves of every batch in path order (the first half is the smaller one).
    A batch is bounded by its token limit."""
    w = Window.partitionBy(*keys)
    return batch_files.withColumn("half", F.when(
        F.row_number().over(w.orderBy("path")) <= F.floor(F.count(F.lit(1)).over(w) / 2),
        "a").otherwise("b"))


def split_by_lines(files: DataFrame) -> DataFrame:
    """Each file as two halves of its lines with the offset to add back."""
    lines = text.lines_of(F.col("content"))
    rest = [c for c in files.columns if c != "content"]
    rows = files.select(*rest, lines.alias("_l")).withColumn(
        "_mid", F.floor(F.size("_l") / 2).cast("int"))
    parts = F.array(
        F.struct(F.lit("a").alias("half"), F.lit(0).alias("line_offset"),
                 F.slice("_l", F.lit(1), F.col("_mid")).alias("lines")),
        F.struct(F.lit("b").alias("half"), F.col("_mid").alias("line_offset"),
                 F.slice("_l", F.col("_mid") + 1, F.size("_l")).alias("lines")))
    return rows.where(F.size("_l") > 1).select(*rest, F.explode(parts).alias("p")).select(
        *rest, "p.*")


def shift_lines(rows: DataFrame, middle, line: str = "line_start") -> DataFrame:
    """Rows assigned to a half, lines of the second half counted from its start."""
    at = F.coalesce(F.col(line), F.lit(1))
    return rows.withColumn("half", F.when(at <= middle, "a").otherwise("b")).withColumn(
        line, F.when(at <= middle, F.col(line)).otherwise(
            F.greatest(F.lit(1), F.col(line) - middle)))


def split_mode(message, depth, n_files):
    """How to shrink a failed batch: file, slice or '' (give up)."""
    from ..functions import fixed
    low = F.lower(F.coalesce(message, F.lit("")))
    overflow = text.contains_any(low, fixed.OVERFLOW_MARKERS) & (depth < 4)
    junk = text.contains_any(low, fixed.BAD_OUTPUT_MARKERS) & (depth < 2) & (n_files > 1)
    return F.when(overflow & (n_files > 1), "file").when(
        overflow & (n_files == 1), "slice").when(junk & ~overflow, "file").otherwise("")
