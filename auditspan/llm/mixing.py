"""Mixing sources to target weights, with DataFrame operations only.

The words of a source form one stream of fixed-length blocks. Every output shard
draws its counts of blocks by source, every slot of a source maps to a block by a
pseudorandom permutation of the source's block numbers (a fresh one for each
pass), and blocks are joined by number.

The multinomial draws are made conditional on their sums: independent draws would
leave a small source off its target by the square root of its slots, so a random
permutation deals exactly the wanted number of slots of every source to shards of
equal size, which is the multinomial law given the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import pin, running_totals

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCK, SHARDS, ROUNDS, SEED = 64, 16, 4, 17
#: Slots that one row of the work list unfolds to.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_no, source_size, target): *share* of all sizes split by weight,
    a source stopping at *cap* times its size and the excess going to the others.

    Sources in code point order, null last, take *weights* in turn. The level at which
    the others settle is read off the sources in the order in which they fill up. The
    windows run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sums.withColumn("source_no", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = named.withColumn("weight", F.get(
        F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights))).withColumn(
        "limit", F.col("source_size") * cap)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    settled = weighed.withColumn("budget", F.sum("source_size").over(everything) * share).withColumn(
        "full_before", F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    settled = settled.withColumn("level", (F.col("budget") - F.col("full_before")) / F.sum("weight").over(
        filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    settled = settled.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    first_open = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return settled.select("source", "source_no", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(
        first_open * F.col("weight")).alias("target"))


def permuted(index: Column, size: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1, for any size.

    A Feistel network over a grid of a x b cells (a x b just above size) adds hashes to
    the two coordinates in turn; a value beyond size walks on until it is below. As fewer
    than a cells lie beyond, a small grid needs fewer than a steps; on larger ones a run
    of 64 such steps has a chance below 64 ** -64.
    """
    a = F.ceil(F.sqrt(F.greatest(size, F.lit(1)).cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for r in range(ROUNDS):
            if r % 2:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(r), right, *salt), a), a)
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(r), left, *salt), b), b)
        return left * b + right

    start = once(index)
    return F.when(start < size, start).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), start,
        lambda x, _: F.when(x < size, x).otherwise(once(x))))


def word_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every whole text; a null text has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.xxhash64("text").alias("text_key"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mixing_slots(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, pass, block): what every slot of the mix holds."""
    sizes = (targets.where("source_size > 0")
             .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
             .withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")))
    order = Window.orderBy("source_no")
    sizes = sizes.withColumn("first", F.sum("slots").over(order) - F.col("slots")).withColumn(
        "all", F.sum("slots").over(Window.partitionBy()))
    work = (sizes.where("slots > 0")
            .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))))
            .repartition(F.col("source_no"), F.col("run")))
    slots = work.withColumn("own", F.explode(F.sequence(
        F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("slots")) - 1)))
    turn = F.floor(F.col("own") / F.col("blocks")).cast("long")
    place = permuted(F.col("first") + F.col("own"), F.col("all"), F.lit(seed))
    return slots.withColumn("place", place).select(
        F.floor(F.col("place") * shards / F.col("all")).cast("int").alias("shard"), F.col("place").alias("slot"),
        "source_no", turn.alias("pass"),
        permuted(F.pmod("own", F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("source_no"), turn).alias("block"))


def placed_documents(docs: DataFrame, targets_of=source_targets) -> tuple[DataFrame, DataFrame]:
    """Documents with the place of their words in the stream of their source, and the
    targets. The stream follows a hash of doc_id; rows are small, so both are stored."""
    sized = pin(word_streams(docs))
    targets = pin(targets_of(sized))
    numbered = sized.join(targets.select(F.col("source").alias("_s"), "source_no"),
                          F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "_h", F.xxhash64(F.lit(SEED), "doc_id", "text_key"))
    ends = running_totals(numbered, ["source_no"], ["_h", "doc_id", "size"], F.shiftright("_h", 54),
                          stream_end=F.col("size"))
    return ends.withColumn("stream", F.col("stream_end") - F.col("size")).drop("stream_end", "_h"), targets


def document_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block it has words in: words [lo, hi) of the document."""
    return (placed.where("size > 0")
            .withColumn("block", F.explode(F.sequence(
                F.floor(F.col("stream") / block), F.floor((F.col("stream") + F.col("size") - 1) / block))))
            .withColumn("lo", F.greatest(F.col("block") * block - F.col("stream"), F.lit(0)))
            .withColumn("hi", F.least((F.col("block") + 1) * block - F.col("stream"), F.col("size"))))


def mixture(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of *docs* (doc_id, text,
    source; other columns are ignored).

    *taken* counts the words that the mix takes, repeats included, and is at most twice
    the size. A null, empty or wordless text has size 0 and is never taken; a null source
    is a source of its own, the last. Repeated rows each take part. An empty table gives
    no rows. Reruns agree, as only hashes of the rows decide.
    """
    placed, targets = placed_documents(docs)
    placed = pin(placed)
    times = mixing_slots(targets, block, shards).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (document_blocks(placed, block).join(times, ["source_no", "block"])
             .groupBy("source_no", "stream").agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("taken")))
    with_words = placed.where("size > 0").join(taken, ["source_no", "stream"], "left")
    every = with_words.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return every.join(targets.drop("source"), "source_no").select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def single(rows: DataFrame) -> DataFrame:
    """One of the rows (row, doc_id, key) that repeat an id and text: the least by all columns."""
    same = ["doc_id", "key"]
    repeated = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("again_id"), F.col("key").alias("again_key"))
    if not repeated.limit(1).count():
        return rows
    on = F.col("doc_id").eqNullSafe(F.col("again_id")) & F.col("key").eqNullSafe(F.col("again_key"))
    least = rows.join(repeated, on, "left_semi").groupBy(*same).agg(F.min("row").alias("row"))
    return rows.join(repeated, on, "left_anti").unionByName(least)


def mixed_documents(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix as rows with the columns of *docs* (doc_id, text, source, n_chars and any others, whatever
    their names).

    Each pass over a document is a row with the words taken in it: the whole text where
    all words are, else the taken words joined by spaces. Rows that repeat both doc_id and
    text are one document, the least of them by all columns. Null, empty and wordless texts are never
    taken; an empty table gives no rows.
    """
    rows = single(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                              F.xxhash64("text").alias("key")))
    placed, targets = placed_documents(rows.select("row.doc_id", "row.text", "row.source"))
    # Slots unfold from a few rows, so their size is unknown to the planner: never broadcast
    slots = mixing_slots(targets, block, shards).select("source_no", "pass", "block").hint("merge")
    spans = (document_blocks(placed, block).join(slots, ["source_no", "block"])
             .groupBy(F.col("doc_id").alias("taken_id"), "text_key", "size", "pass")
             .agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"),
                  F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")))
    split = F.array(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)))
    # the array of one binds the words, so a text is split once for all its spans
    part = F.get(F.transform(split, lambda words: F.array_join(F.transform("spans", lambda s: F.array_join(
        F.slice(words, s.lo.cast("int") + 1, (s.hi - s.lo).cast("int")), " ")), " ")), 0)
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("key") == F.col("text_key")))
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(part)
    mixed = joined.select(F.col("row").withField("text", text).alias("row"))
    return mixed.select(F.col("row").withField("n_chars", F.char_length("row.text").cast("long")).alias("row")).select("row.*")
