"""Approximate nearest neighbours: one navigable small-world graph per shard."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import pin, top_n

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_ROWS, QUERY_ROWS, NEAREST = 4096, 1024, 5
#: A query meets every shard. Beyond this number shards grow instead, until one holds so many numbers.
SHARDS, SHARD_NUMBERS = 32, 1 << 23
#: Links of a node above the ground layer (twice as many on it); width of the beam while
#: building and searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 80, 120
#: Nodes that are linked together at first; nodes of a beam followed at a time; numbers in a work array;
#: pairs of vectors multiplied at a time, which stay in the cache.
FIRST_ROWS, AT_ONCE, CELLS, PAIRS = 256, 8, 1 << 23, 1024


class Graph:
    """Hierarchical navigable small-world graph over unit vectors. Nodes are numbered so that those of
    the upper layers come first. ``near[layer]`` is a flat nodes x links array of node numbers, -1
    where there is no link. Nodes and queries are worked on in blocks."""

    def __init__(self, vectors: np.ndarray, seed: int):
        level = (-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.vectors = vectors[self.order]
        self.near = [self.layer(int((level >= k).sum()), LINKS * (1 if k else 2)) for k in range(level.max(initial=0) + 1)]

    def layer(self, n: int, most: int) -> np.ndarray:
        """Links of the first *n* nodes. A node is linked with the nearest of those before it, and they with it."""
        near, done = np.full((n, most), -1, np.int32), 0
        while done < n:
            end = min(n, max(FIRST_ROWS, done + done // 2))
            step = max(1, CELLS // end)
            for lo in range(done, end, step):
                hi = min(end, lo + step)
                nearness = self.vectors[lo:hi] @ self.vectors[:hi].T
                nearness[:, lo:][np.triu(np.ones((hi - lo, hi - lo), bool))] = -np.inf
                width = min(BUILD_WIDTH, hi)
                found = np.argpartition(nearness, hi - width, axis=1)[:, hi - width:]
                near[lo:hi, :LINKS] = self.spread_out(found, np.take_along_axis(nearness, found, 1), LINKS)
            self.link_back(near, done, end)
            done = end
        return near

    def spread_out(self, nodes: np.ndarray, nearness: np.ndarray, most: int) -> np.ndarray:
        """For each row, links among *nodes* that are nearer to the row's node than to each other, then the nearest others;
        a nearness of minus infinity is no node."""
        order = np.argsort(-nearness, axis=1, kind="stable")
        nodes, nearness = np.take_along_axis(nodes, order, 1), np.take_along_axis(nearness, order, 1)
        out, width = np.full((len(nodes), most), -1, np.int32), nodes.shape[1]
        step = max(1, CELLS // (width * max(width, self.vectors.shape[1])))
        for lo in range(0, len(nodes), step):
            own, s = nodes[lo:lo + step], nearness[lo:lo + step]
            x = self.vectors[own]
            between = x @ x.transpose(0, 2, 1)
            nearest_kept, kept = np.full(own.shape, -np.inf, np.float32), np.zeros(own.shape, bool)
            number = np.zeros(len(own), int)
            for i in range(width):
                kept[:, i] = keep = (s[:, i] > nearest_kept[:, i]) & (number < most)
                number += keep
                np.maximum(nearest_kept[:, i:], between[:, i, i:], out=nearest_kept[:, i:], where=keep[:, None])
            turn = np.argsort(np.where(s > -np.inf, ~kept, 2), axis=1, kind="stable")[:, :most]
            links = np.where(np.take_along_axis(s, turn, 1) > -np.inf, np.take_along_axis(own, turn, 1), -1)
            out[lo:lo + step, :links.shape[1]] = links
        return out

    def link_back(self, near: np.ndarray, done: int, end: int) -> None:
        """Links to the nodes from *done* to *end* from those they link to; a full row keeps links that spread out."""
        most = near.shape[1]
        node, other = np.repeat(np.arange(done, end), LINKS), near[done:end, :LINKS].ravel()
        order = np.argsort(other, kind="stable")
        order = order[other[order] >= 0]
        node, other = node[order], other[order]
        to, first, row, count = np.unique(other, return_index=True, return_inverse=True, return_counts=True)
        place = np.arange(len(node)) - first[row]
        for begin in range(0, int(count.max(initial=0)), most):
            late = (place >= begin) & (place < begin + most)
            some = np.flatnonzero(count > begin)
            spot = np.searchsorted(some, row[late])
            links = np.full((len(some), 2 * most), -1, np.int32)
            links[:, :most] = near[to[some]]
            links[spot, most + place[late] - begin] = node[late]
            links = np.take_along_axis(links, np.argsort(links < 0, axis=1, kind="stable"), 1)
            full = (links >= 0).sum(1) > most
            near[to[some[~full]]] = links[~full, :most]
            step = max(1, CELLS // (2 * most * self.vectors.shape[1]))
            for own in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // step) or 1):
                mine = to[some[own]]
                nearness = self.nearness(links[own], self.vectors[mine])
                near[mine] = self.spread_out(links[own], nearness, most)

    def nearness(self, nodes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Of each row of *nodes* to the row's vector, minus infinity where there is no node."""
        return np.where(nodes < 0, np.float32(-np.inf), (self.vectors[nodes] @ vectors[:, :, None])[:, :, 0])

    def descend(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes on the ground layer from which to search, and their nearness."""
        node, best = np.zeros(len(queries), int), queries @ self.vectors[0]
        for near in self.near[:0:-1]:
            going = np.arange(len(queries))
            while len(going):
                links = near[node[going]]
                s = self.nearness(links, queries[going])
                turn = s.argmax(1)[:, None]
                links, s = np.take_along_axis(links, turn, 1)[:, 0], np.take_along_axis(s, turn, 1)[:, 0]
                nearer = s > best[going]
                going = going[nearer]
                node[going], best[going] = links[nearer], s[nearer]
        return node, best

    def beam(self, queries: np.ndarray, width: int) -> np.ndarray:
        """For each query, the numbers of the best nodes found on the ground layer, best first, then -1."""
        near, n, m = self.near[0], len(self.vectors), len(queries)
        best, score, ahead = np.full((m, width), -1), np.full((m, width), -np.inf, np.float32), np.zeros((m, width), bool)
        best[:, 0], score[:, 0] = self.descend(queries)
        ahead[:, 0] = True
        seen = np.zeros(m * n, np.uint16)
        seen[np.arange(m) * n + best[:, 0]] = 1
        turns = np.arange(1, AT_ONCE * near.shape[1] + 1, dtype=np.uint16).reshape(AT_ONCE, -1)
        while True:
            number = np.cumsum(ahead, axis=1, dtype=np.int32)
            row, spot = np.nonzero(ahead & (number <= AT_ONCE))
            if not len(row):
                return best
            ahead[row, spot] = False
            links, turn = near[best[row, spot]], turns[number[row, spot] - 1]
            cell = (row * n)[:, None] + links
            new = (links >= 0) & (seen[cell] == 0)
            cell, turn, links, row = cell[new], turn[new], links[new], np.repeat(row, new.sum(1))
            seen[cell] = turn  # of two equal cells one stays
            new = seen[cell] == turn
            row, links = row[new], links[new]
            s = np.concatenate([np.einsum("ij,ij->i", self.vectors[links[lo:lo + PAIRS]], queries[row[lo:lo + PAIRS]])
                                for lo in range(0, len(row) or 1, PAIRS)])
            nearer = s > score[row, -1]
            row, links, s = row[nearer], links[nearer], s[nearer]
            rows, first, at, count = np.unique(row, return_index=True, return_inverse=True, return_counts=True)
            if not len(rows):
                continue
            place = np.arange(len(row)) - first[at]
            more, more_score = np.full((len(rows), count.max()), -1), np.full((len(rows), count.max()), -np.inf, np.float32)
            more[at, place], more_score[at, place] = links, s
            all_scores = np.hstack([score[rows], more_score])
            turn = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
            best[rows] = np.take_along_axis(np.hstack([best[rows], more]), turn, 1)
            ahead[rows] = np.take_along_axis(np.hstack([ahead[rows], more >= 0]), turn, 1)
            score[rows] = np.take_along_axis(all_scores, turn, 1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """For each query, the places in the given vectors of the best found, best first, then -1."""
        best = self.beam(queries, width)
        return np.where(best < 0, -1, self.order[best])


def unit(exact: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.nan_to_num(exact / length[:, None], posinf=0, neginf=0).astype(np.float32)


class Shard:
    """Nodes of a shard, from Arrow batches with the columns ids and vector, and their graph."""

    def __init__(self, parts: list[pa.RecordBatch], width: int, seed: int):
        self.exact = np.concatenate([numbers(p, width) for p in parts])
        self.length = np.linalg.norm(self.exact.astype(np.float64), axis=1)
        self.graph = Graph(unit(self.exact, self.length), seed)
        self.sizes = np.concatenate([p.column("ids").value_lengths().to_numpy() for p in parts])
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate([p.column("ids").flatten().to_numpy() for p in parts])

    def answers(self, query_ids: np.ndarray, queries: np.ndarray, nearest: int) -> tuple[np.ndarray, ...]:
        """(query_id, vec_id, score) of the *nearest* of each query, by scores in double precision."""
        norm = np.linalg.norm(queries, axis=1)
        found = self.graph.search(unit(queries, norm), max(beam_width(len(self.sizes)), 4 * nearest))
        score = (self.exact[found].astype(np.float64) @ queries[:, :, None])[:, :, 0] / (self.length[found] * norm[:, None])
        turn = np.argsort(np.where(found < 0, np.inf, -score), axis=1, kind="stable")[:, :4 * nearest + 1]
        found, score = np.take_along_axis(found, turn, 1), np.take_along_axis(score, turn, 1)
        row, spot = np.nonzero(found >= 0)
        node, count = found[row, spot], self.sizes[found[row, spot]]
        row, score = np.repeat(row, count), np.repeat(score[row, spot], count)
        ids = self.ids[np.repeat(self.begin[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        other = ids != query_ids[row]
        row, ids, score = row[other], ids[other], score[other]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < nearest
        return query_ids[row[kept]], ids[kept], score[kept]


def numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(-1, width)


def shard_count(rows: int, size: int, shard_rows: int) -> int:
    """Shards of *shard_rows* up to SHARDS of them, beyond which they grow until one holds SHARD_NUMBERS of *size* numbers."""
    return max(1, min(-(-rows // shard_rows), SHARDS), -(-size // SHARD_NUMBERS))


def beam_width(rows: int) -> int:
    """In larger shards the beam is wider, so that few of them find what many small ones do."""
    return int(SEARCH_WIDTH * max(1.0, rows / SHARD_ROWS) ** 0.5)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of rows that have a nearness: not null, not zero, all finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST,
                       shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of *queries* the *nearest* rows of
    *vectors* found by cosine, without rows of the query's own id.

    Equal vectors are one node that keeps its *nearest* + 1 smallest ids, which are all
    that ties can call for. Nodes are dealt to shards by hash, and every query to every shard, in one
    exchange without a join: a query is a row a shard, which Spark could take for few and broadcast. A task
    reads the nodes of a shard, keeps its graph as flat arrays and streams the queries through it; the
    shards' results merge. Scores come from the original vectors in double precision; ties go to the
    smaller id. Vectors of another length share no shard. Rows that are null, zero or hold null or
    non-finite components take no part; repeated ids are rows like others. Empty tables give no rows.
    """
    plain = all(frame.schema[vector_col].dataType.simpleString() == "array<float>" for frame in (vectors, queries))
    stored, exact = "array<float>" if plain else "array<double>", F.col("vector").cast("array<double>")
    rows = usable(vectors, id_col, vector_col)
    hashed = rows.withColumn("h1", F.xxhash64(F.lit(1), exact)).withColumn("h2", F.xxhash64(F.lit(2), exact))
    nodes = pin(top_n(hashed.select("vec_id", "h1", "h2", F.col("vector").cast(stored)), ["h1", "h2"], [F.col("vec_id")], nearest + 1)
                .groupBy("h1", "h2").agg(F.min("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
                .withColumn("width", F.size("vector")))
    size = nodes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("width"), F.lit(0)).alias("numbers")).first()
    shards = shard_count(size["rows"], size["numbers"], shard_rows)

    def row(shard: Column, h1: Column, query_id: Column, ids: Column) -> list[Column]:
        return [F.size("vector").alias("width"), shard.alias("shard"), query_id.cast("long").alias("query_id"),
                h1.cast("long").alias("h1"), ids.cast("array<long>").alias("ids"), F.col("vector").cast(stored).alias("vector")]
    none = F.lit(None)
    given = nodes.select(*row(F.pmod("h1", F.lit(shards).cast("long")), F.col("h1"), none, F.col("ids")))
    asked = usable(queries, id_col, vector_col).select(
        *row(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))), none, F.col("vec_id"), none))
    dealt = given.union(asked).repartition(4 * shards, "width", "shard").sortWithinPartitions(
        "width", "shard", F.asc_nulls_first("query_id"), "h1")

    def search(batches):
        key, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            asks = batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column("width").to_numpy(), batch.column("shard").to_numpy(), asks])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                (width, number, asked), part = keys[:, lo].tolist(), batch.slice(lo, hi - lo)
                if key != (width, number):
                    key, parts, shard = (width, number), [], None
                if not asked:
                    parts.append(part)
                    continue
                if parts:
                    shard, parts = Shard(parts, width, number), []
                if shard is None:
                    continue
                ids, vectors = part.column("query_id").to_numpy(), numbers(part, width).astype(np.float64)
                step = max(1, min(QUERY_ROWS, CELLS // max(len(shard.sizes), beam_width(len(shard.sizes)) * width)))
                for at in range(0, len(ids), step):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in shard.answers(ids[at:at + step], vectors[at:at + step], nearest)],
                        names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    return top_n(found, ["query_id"], [F.desc("score"), F.col("vec_id")], nearest, "rank").select(
        "query_id", "rank", "vec_id", "score")
