"""Approximate nearest neighbours by largest inner product over robust-pruned directed graphs.

Vectors are dealt to shards by ranges of their norm and then by a hash of their
bytes, so that equal vectors meet: an index holds each distinct vector once,
with its smallest ids. A vector gets one more coordinate, sqrt(M^2 - |v|^2) with
M the shard's largest norm, so that the largest inner product with a query is
the smallest distance; in a range of norms this coordinate stays small, and the
graph is that of the vectors' directions. Each
shard's graph is built by insertion in growing batches: a greedy beam search
over the graph so far proposes neighbours, robust pruning drops a candidate
that a kept neighbour covers within the relaxed distance, and reverse edges are
pruned alike. Queries follow their shard's vectors through the same task and
search its graph with a beam. Scores are exact inner products in double
precision on the original vectors, and the shards' lists meet in a top-k a query.

Each shard has a task of its own, which holds its vectors and graph, of about
``SHARD`` vectors; queries stream through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

K = 20
DEGREE, BEAM, RELAX = 32, 64, 1.2
SEARCH_BEAM = 192
#: Vectors of a shard; small tables have LEAST_SHARDS shards.
SHARD, LEAST_SHARDS = 20_000, 8
#: Norms are counted in steps of this ratio; a shard's span so many steps at most.
STEP, WIDEST = 1.05, 4
_INF = np.float32(np.inf)


class Graph:
    """A directed graph over the rows of ``x``, searched and built for many points at once."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        self.sq = (self.x**2).sum(1)
        self.degree, self.beam, self.relax = degree, beam, np.float32(relax**2)
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        self.start = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1))) if n else 0
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int64) if n else order
        done, size = 1, 1
        while done < n:
            self._insert(order[done : done + size], order[:done])
            done += size
            size = min(done, 2048)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the beam's end for each query, nearest first; -1 and infinity fill up."""
        m, n = len(q), len(self.x)
        qq = (q**2).sum(1)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), _INF, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0], open_[:, 0] = self.start, True
        dist[:, 0] = qq + self.sq[self.start] - 2 * (q @ self.x[self.start])
        seen[:, self.start] = True
        rows = np.arange(m)
        while len(rows):
            # expand the nearest open entries of each beam
            first = np.argsort(~open_[rows], axis=1, kind="stable")[:, :2]
            valid = np.take_along_axis(open_[rows], first, 1)
            at = np.where(valid, np.take_along_axis(ids[rows], first, 1), -1)
            r2 = np.repeat(rows, 2)
            flat = first.ravel()
            open_[r2, flat] = False
            near = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(rows), -1)
            safe = np.maximum(near, 0)
            fresh = (near >= 0) & ~seen[rows[:, None], safe]
            near = np.where(fresh, near, -1)
            seen[rows[:, None], safe] |= fresh
            if near.shape[1] > self.degree:  # both entries may name a point: the second naming goes
                s = np.sort(near, 1)
                if ((s[:, 1:] == s[:, :-1]) & (s[:, 1:] >= 0)).any():
                    o = np.argsort(near, 1, kind="stable")
                    sn = np.take_along_axis(near, o, 1)
                    dup = np.zeros_like(sn, bool)
                    dup[:, 1:] = (sn[:, 1:] == sn[:, :-1]) & (sn[:, 1:] >= 0)
                    np.put_along_axis(near, o, np.where(dup, -1, sn), 1)
            d = qq[rows][:, None] + self.sq[safe] - 2 * np.matmul(self.x[safe], q[rows][:, :, None])[:, :, 0]
            d = np.where(near >= 0, d, _INF)
            all_d = np.concatenate([dist[rows], d], 1)
            all_i = np.concatenate([ids[rows], near], 1)
            all_o = np.concatenate([open_[rows], near >= 0], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            bd = np.take_along_axis(all_d, best, 1)
            o = np.argsort(bd, 1, kind="stable")
            best = np.take_along_axis(best, o, 1)
            dist[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(all_i, best, 1)
            open_[rows] = np.take_along_axis(all_o, best, 1)
            rows = rows[open_[rows].any(1)]
        return ids, dist

    def _prune(self, points: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Robust pruning of each point's candidates, nearest first; rows of ``cand`` hold -1 where empty."""
        o = np.argsort(np.where(cand >= 0, dist, _INF), 1, kind="stable")
        cand, dist = np.take_along_axis(cand, o, 1), np.take_along_axis(dist, o, 1)
        m, c = cand.shape
        alive = (cand >= 0) & (cand != points[:, None])
        kept = np.full((m, self.degree), -1, np.int32)
        count = np.zeros(m, np.int64)
        x = self.x[np.maximum(cand, 0)]
        between = self.sq[np.maximum(cand, 0)]
        for j in range(c):
            take = np.nonzero(alive[:, j] & (count < self.degree))[0]
            if not len(take):
                continue
            kept[take, count[take]] = cand[take, j]
            count[take] += 1
            if j + 1 < c:
                d = between[take, j][:, None] + between[take, j + 1 :] - 2 * np.matmul(x[take, j + 1 :], x[take, j][:, :, None])[:, :, 0]
                alive[take, j + 1 :] &= self.relax * np.maximum(d, 0) > dist[take, j + 1 :]
        return kept

    def _insert(self, points: np.ndarray, before: np.ndarray) -> None:
        for at in range(0, len(points), 512):
            part = points[at : at + 512]
            ids, dist = self.search(self.x[part], self.beam)
            self.edges[part] = self._prune(part, ids, dist)
        src = np.repeat(points, self.degree)
        dst = self.edges[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        targets, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        lo, step = 0, 512
        while lo < len(targets):
            while step > 1 and step * int(counts[lo : lo + step].max()) > 1 << 16:  # many edges may meet in one point
                step //= 2
            t, s, c = targets[lo : lo + step], starts[lo : lo + step], counts[lo : lo + step]
            lo, step = lo + step, 512
            width = int(c.max())
            new = np.full((len(t), width), -1, np.int32)
            col = np.arange(width)
            inside = col[None, :] < c[:, None]
            new[inside] = src[(s[:, None] + col[None, :])[inside]]
            cand = np.concatenate([self.edges[t], new], 1)
            full = (cand >= 0).sum(1) > self.degree
            packed = np.take_along_axis(cand, np.argsort(cand < 0, 1, kind="stable"), 1)
            self.edges[t[~full]] = packed[~full, : self.degree]
            if full.any():
                pt, pc = t[full], packed[full]
                d = self.sq[pt][:, None] + self.sq[np.maximum(pc, 0)] - 2 * np.matmul(self.x[np.maximum(pc, 0)], self.x[pt][:, :, None])[:, :, 0]
                self.edges[pt] = self._prune(pt, pc, np.maximum(d, 0))


class Shard:
    """Distinct vectors with their smallest ids, and the graph over them."""

    def __init__(self, k: int, search_beam: int):
        self.k, self.beam = k, search_beam
        self.ids: dict[bytes, list[int]] = {}
        self.graph: Graph | None = None

    def add(self, vector: bytes, ids: list[int]) -> None:
        have = self.ids.setdefault(vector, [])
        have[:] = sorted({*have, *ids})[: self.k + 1]

    def build(self) -> None:
        self.lists = list(self.ids.values())
        self.vectors = np.frombuffer(b"".join(self.ids), np.float64).reshape(len(self.ids), -1) if self.ids else np.zeros((0, 0))
        self.ids = {}
        square = (self.vectors**2).sum(1)
        top = square.max() if len(square) else 1.0
        self.graph = Graph(np.concatenate([self.vectors, np.sqrt(np.maximum(top - square, 0))[:, None]], 1) / np.sqrt(top))

    def nearest(self, query_ids: list[int], q: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """At most k rows a query: copies of a vector tie, and so do their ids."""
        if not len(self.vectors):
            return
        flat = np.concatenate([q, np.zeros((len(q), 1))], 1)
        norm = np.sqrt((q**2).sum(1, keepdims=True))
        found, _ = self.graph.search((flat / np.maximum(norm, 1e-300)).astype(np.float32), self.beam)
        for query, vector, near in zip(query_ids, q, found):
            near = near[near >= 0]
            scores = (self.vectors[near] * vector).sum(1)
            rows = [(-s, i) for s, at in zip(scores.tolist(), near.tolist()) for i in self.lists[at] if i != query]
            for s, i in sorted(rows)[: self.k]:
                yield query, i, -s


class Dealt:
    """Which shard a vector belongs to: ranges of norms, each with shards enough for its vectors."""

    def __init__(self, counts: dict[int, int], size: int):
        """``counts`` of steps of the norm; a range ends when it holds ``size`` vectors or is ``WIDEST`` steps wide."""
        self.last, self.first, self.shards = [], [0], []
        steps = sorted(counts)
        total, begin = 0, steps[0]
        for step, following in zip(steps, [*steps[1:], None]):
            total += counts[step]
            if following is None or total >= size or following - begin >= WIDEST:
                self.last.append(step)
                self.shards.append(max(-(-total // size), 1))
                self.first.append(self.first[-1] + self.shards[-1])
                total, begin = 0, following

    def __len__(self) -> int:
        return self.first[-1]

    def of(self, vector: np.ndarray, h: int) -> int:
        step = int(np.floor(np.log(np.sqrt((vector**2).sum())) / np.log(STEP)))
        i = min(int(np.searchsorted(self.last, step)), len(self.last) - 1)
        return self.first[i] + h % self.shards[i]


def _collapsed(batches: Iterator[pa.RecordBatch], dealt: Dealt, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition to distinct vectors, each with its k + 1 smallest ids: enough for any query, itself left out."""
    import xxhash

    held: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        ids = [sorted({*held[v]})[: k + 1] for v in keys]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([dealt.of(np.frombuffer(v), xxhash.xxh64_intdigest(v)) for v in keys], pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(keys, pa.binary())], ["shard", "kind", "ids", "vector"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            have = held.setdefault((np.array(v, np.float64) + 0.0).tobytes(), [])  # -0.0 equals 0.0
            have.append(i)
            if len(have) > 8 * k:
                have[:] = sorted({*have})[: k + 1]
        if len(held) > 20_000:
            yield out()
    yield out()


def _searched(batches: Iterator[pa.RecordBatch], k: int, search_beam: int) -> Iterator[pa.RecordBatch]:
    shard, at = None, None
    for batch in batches:
        numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[tuple[int, int, float]] = []
        lo = 0
        while lo < batch.num_rows:
            hi = lo
            while hi < batch.num_rows and hi - lo < 256 and numbers[hi] == numbers[lo] and kinds[hi] == kinds[lo]:
                hi += 1
            ids, vectors = batch.column(2).slice(lo, hi - lo).to_pylist(), batch.column(3).slice(lo, hi - lo).to_pylist()
            if numbers[lo] != at:
                shard, at = Shard(k, search_beam), numbers[lo]
            if kinds[lo] == 0:
                for i, v in zip(ids, vectors):
                    shard.add(v, i)
            else:
                if shard.graph is None:
                    shard.build()
                out += shard.nearest([i[0] for i in ids], np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1))
            lo = hi
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", search_beam: int = SEARCH_BEAM, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` names, its k largest inner products among all others.

    Null ids take no part, nor do vectors that aren't usable or whose number of
    components differs from the commonest (the smaller of equally common ones).
    Of rows that repeat an id and a vector one counts; a query row never finds
    its own id. With fewer than k others all are found. Vectors may have any
    number of components. Equal scores go to the least ids. An empty table
    gives an empty result. Other columns play no part, whatever their names.
    """
    clean = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(usable(F.col(vector_col)), F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    steps = clean.groupBy(F.size("v").alias("d"), F.floor(F.log(norm) / float(np.log(STEP))).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each number of components and each step of the norm that occurs; doubles have some 29,000 steps
    dims = steps.groupBy("d").agg(F.sum("n").alias("n"), F.collect_list(F.struct("s", "n")).alias("steps")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, n, counts = (dims[0]["d"], dims[0]["n"], {r["s"]: r["n"] for r in dims[0]["steps"]}) if dims else (0, 0, {0: 0})
    clean = clean.filter(F.size("v") == dim)
    dealt = Dealt(counts, max(-(-n // (shards or max(LEAST_SHARDS, -(-n // SHARD)))), 1))
    parts = len(dealt)
    held = map_arrow(clean.select("vec_id", "v"), lambda it: _collapsed(it, dealt, k), "shard int, kind int, ids array<long>, vector binary")
    asked = clean.filter("q").select("vec_id", "v").distinct()
    asked = map_arrow(asked, _queries, "ids array<long>, vector binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard"), F.lit(1).alias("kind"), "ids", "vector")
    tasks = held.unionByName(asked).repartitionById(parts, "shard").sortWithinPartitions("shard", "kind")
    found = map_arrow(tasks, lambda it: _searched(it, k, search_beam), "query_id long, vec_id long, score double")
    # ids that repeat with other vectors keep their best score
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [[i] for i in batch.column(0).to_pylist()]
        blobs = [(np.array(v, np.float64) + 0.0).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], ["ids", "vector"])
