"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more component that makes all norms equal, so that the largest inner product is the least distance.
A bounded sample is halved again and again at the median of its main split, which gives lists of equal size; their
means are the centroids. A neighbour graph over the centroids, small enough for any worker, is searched best first.
Every vector is listed under its nearest centroid and, near borders, under others within a distance ratio; a query
reads all lists within its own distance ratio. Products are in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written


@dataclass(frozen=True)
class Graph:
    centroids: np.ndarray  # lists x dims + 1
    neighbours: np.ndarray  # lists x degree
    entries: np.ndarray
    norm: float  # of the longest vector

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors of the table with their extra component."""
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1) / self.norm

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries have none; their length doesn't change the order and is made 1."""
        return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], 1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids met by a best-first walk with a beam: ids and distances, nearest first."""
        n, c = len(x), len(self.centroids)
        beam = min(beam, c)
        seen = np.zeros((n, c), bool)
        entries = self.entries
        seen[:, entries] = True
        ids = np.broadcast_to(entries, (n, len(entries))).copy()
        far = np.sqrt(((x[:, None, :] - self.centroids[entries][None]) ** 2).sum(2))
        opened = np.zeros(ids.shape, bool)
        ids, far, opened = _best(ids, far, opened, beam)
        live = np.arange(n)
        while live.size:
            shut = opened[live] | (ids[live] < 0)
            pick = np.argmin(np.where(shut, np.inf, far[live]), 1)
            go = ~shut[np.arange(len(live)), pick]
            live, pick = live[go], pick[go]
            if not live.size:
                break
            opened[live, pick] = True
            next_ = self.neighbours[ids[live, pick]]
            new = ~seen[live[:, None], next_]
            seen[live[:, None], next_] = True
            d = np.full(next_.shape, np.inf)
            r, k = np.nonzero(new)
            d[r, k] = np.sqrt(((x[live[r]] - self.centroids[next_[r, k]]) ** 2).sum(1))
            next_ = np.where(new, next_, -1)
            a, b, o = _best(np.concatenate([ids[live], next_], 1), np.concatenate([far[live], d], 1), np.concatenate([opened[live], np.zeros(d.shape, bool)], 1), beam)
            if a.shape[1] > ids.shape[1]:
                grow = a.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                far = np.pad(far, ((0, 0), (0, grow)), constant_values=np.inf)
                opened = np.pad(opened, ((0, 0), (0, grow)))
            ids[live], far[live], opened[live] = a, b, o
        return ids, far


def _best(ids: np.ndarray, far: np.ndarray, opened: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.argsort(far, 1, kind="stable")[:, :most]
    return np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1), np.take_along_axis(opened, by, 1)


def halves(x: np.ndarray, leaf: int, seed: int) -> list[np.ndarray]:
    """Row sets of at most `leaf` rows: each set is cut at the median between two means."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        p = x[rows]
        c = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(6):
            side = p @ (c[1] - c[0])
            upper = side > np.median(side)
            if not upper.any():
                break
            c = np.stack([p[~upper].mean(0), p[upper].mean(0)])
        by = np.argsort(p @ (c[1] - c[0]), kind="stable")
        todo += [rows[by[: len(rows) // 2]], rows[by[len(rows) // 2 :]]]
    return out


def build(sample: np.ndarray, lists: int, norm: float, degree: int = 16, seed: int = 3) -> Graph:
    empty = Graph(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), norm)
    x = empty.lifted(sample)
    sets = halves(x, max(1, -(-len(x) // lists)), seed)
    centroids = np.stack([x[s].mean(0) for s in sets])
    n = len(centroids)
    degree = min(degree, n - 1)
    neighbours = np.zeros((n, max(degree, 1)), int)
    for i in range(0, n, 512):
        d = ((centroids[i : i + 512] ** 2).sum(1)[:, None] - 2 * centroids[i : i + 512] @ centroids.T) + (centroids**2).sum(1)[None]
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if degree:
            neighbours[i : i + len(d)] = np.argsort(d, 1, kind="stable")[:, :degree]
    # sets come in tree order, so a link to the next one and to a far one joins all parts of the graph
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) + n // 2) % n], 1)
    return Graph(centroids, np.concatenate([neighbours, ring], 1), np.unique(np.linspace(0, n - 1, min(n, 12)).astype(int)), norm)


def vectors_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array of double): rows with an id and a finite vector that isn't zero."""
    v = F.col("v")
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _one_each(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _sample(rows: DataFrame, most: int, n: int) -> np.ndarray:
    """About `most` of n vectors, by a cut through the hashes of their ids, in order of these; nothing is sorted or
    moved but the sample."""
    h = F.xxhash64("vec_id")
    below = int((2 * min(1.0, most / n) - 1) * (1 << 63))
    some = rows if most >= n else rows.where(h <= below)
    found = sorted(some.select(h.alias("h"), "vec_id", "v").collect(), key=lambda r: (r["h"], r["vec_id"]))
    return np.array([r["v"] for r in found])


def _ranked(row: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each of n rows the k largest scores, ties to the smaller id."""
    row, ids, score = row[keep], ids[keep], score[keep]
    by = np.lexsort((ids, -score, row))
    edge = np.searchsorted(row[by], np.arange(n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        some = by[a : min(b, a + k)]
        yield ids[some], score[some]


#: A smaller sample might miss by chance; tables of fewer vectors are their own sample.
LEAST_SAMPLE = 512


@dataclass(frozen=True)
class Settings:
    rows_per_list: int = 256
    max_lists: int = 8192
    sample_per_list: int = 8  # the sample has at most max_lists x sample_per_list vectors
    copies: int = 4  # lists of a vector near borders
    closure: float = 1.3  # distance ratio of its lists
    reach: float = 1.18  # distance ratio of the lists a query reads
    least_lists: int = 32
    block: int = 4096  # vectors, and queries, that one task compares at a time


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product but its own row, ties to the smaller id.

    Null, zero and non-finite vectors and null ids take no part. An id with several vectors has the least of them,
    component by component, among candidates and among queries alike, however rows are partitioned; other columns are
    ignored. Of equal vectors only the k + 1 smallest ids can be in any result, so the others leave before the index
    is built. All remaining rows are indexed. The centroids are fitted on about `sample_per_list` vectors a list, those
    whose ids hash least; their number is bounded (`max_lists`), so what workers hold doesn't grow with the input, but
    beyond about max_lists x rows_per_list vectors the lists do. Long lists and lists that many queries read are dealt
    out in blocks. A table of vectors of different lengths is an error.
    """
    s = settings or Settings()
    spark = table.sparkSession
    rows = usable(table, id_column, vector_column)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = written(_one_each(rows).withColumn("_n", nth).where(F.col("_n") <= k + 1).drop("_n"), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    lists = int(min(s.max_lists, max(1, facts["n"] // s.rows_per_list)))
    graph = build(_sample(rows, max(lists * s.sample_per_list, LEAST_SAMPLE), facts["n"]), lists, float(facts["norm"]))
    shared = spark.sparkContext.broadcast(graph)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, far = graph.search(graph.lifted(vectors_of(part, "v")), max(16, 2 * s.copies))
                r, c = np.nonzero((far[:, : s.copies] <= s.closure * far[:, :1] + 1e-12) & (ids[:, : s.copies] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, c], pa.int64()), pa.array(c == 0), part.column("vec_id").take(pa.array(r)), part.column("v").take(pa.array(r))], ["list", "home", "vec_id", "v"])

    postings = written(rows.select("vec_id", "v").mapInArrow(listed, "list long, home boolean, vec_id long, v array<double>"), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("size"), F.sum(F.col("home").cast("int")).alias("homes"))
    known = sizes.collect()  # one row for each centroid
    homes = np.zeros(len(graph.centroids), np.int64)
    for r in known:
        homes[r["list"]] = r["homes"]
    shared_homes = spark.sparkContext.broadcast(homes)

    def aimed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, homes = shared.value, shared_homes.value
        n = len(graph.centroids)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = graph.aimed(vectors_of(part, "v"))
                todo, beam, picked = np.arange(len(x)), min(n, 64), []
                while todo.size:
                    ids, far = graph.search(x[todo], beam)
                    held = np.cumsum(np.where(ids >= 0, homes[np.maximum(ids, 0)], 0), 1)
                    # lists within the ratio, at least some, and on until k + 1 different vectors are in them
                    take = (ids >= 0) & ((far <= s.reach * far[:, :1]) | (np.arange(ids.shape[1]) < s.least_lists) | (held - np.where(ids >= 0, homes[np.maximum(ids, 0)], 0) < k + 1))
                    more = take[:, -1] & (ids.shape[1] < n)
                    if beam >= n and ids.shape[1] < n:
                        more[:] = False
                    sure = ~more if beam < n else np.ones(len(todo), bool)
                    r, c = np.nonzero(take & sure[:, None])
                    picked.append((todo[r], ids[r, c]))
                    todo, beam = todo[~sure], min(n, 2 * beam)
                r, lists_ = (np.concatenate(y) for y in zip(*picked, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(lists_, pa.int64()), part.column("vec_id").take(pa.array(r)), part.column("v").take(pa.array(r))], ["list", "query_id", "q"])

    asked = _one_each(usable(queries, id_column, vector_column))
    probes = written(asked.mapInArrow(aimed, "list long, query_id long, q array<double>"), "probes")
    load = probes.groupBy("list").agg(F.count("*").alias("asked"))
    dealt = sizes.join(load, "list").select("list", F.ceil(F.col("size") / s.block).cast("int").alias("blocks"), F.ceil(F.col("asked") / s.block).cast("int").alias("parts"))
    left = postings.join(F.broadcast(dealt), "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
    right = probes.join(F.broadcast(dealt), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "q")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one block of a list for each of its queries, a row each."""
        asked, best_ids, best_scores = np.zeros(0, np.int64), [], []
        if left.num_rows and right.num_rows:
            v, ids = vectors_of(left.combine_chunks().to_batches()[0], "v"), left.column("vec_id").to_numpy()
            q, asked = vectors_of(right.combine_chunks().to_batches()[0], "q"), right.column("query_id").to_numpy()
            # what rounding can part two ways of taking one product
            margin = 4 * v.shape[1] * np.finfo(float).eps * np.sqrt((v * v).sum(1).max()) * np.sqrt((q * q).sum(1, keepdims=True))
            for i in range(0, len(q), 128):
                near = q[i : i + 128] @ v.T
                near[asked[i : i + 128][:, None] == ids] = -np.inf
                # everything that may tie with the k-th largest, however much that is
                least = np.partition(near, len(v) - k, 1)[:, len(v) - k, None] if len(v) > k else np.full((len(near), 1), -np.inf)
                r, c = np.nonzero(near >= least - margin[i : i + 128])
                score = np.concatenate([np.einsum("ij,ij->i", q[i + r[j : j + 16384]], v[c[j : j + 16384]]) for j in range(0, len(r), 16384)])
                for ids_, scores_ in _ranked(r, ids[c], score, ids[c] != asked[i : i + 128][r], len(near), k):
                    best_ids.append(ids_)
                    best_scores.append(scores_)
        return pa.table({"query_id": pa.array(asked, pa.int64()), "ids": pa.array(best_ids, pa.list_(pa.int64())), "scores": pa.array(best_scores, pa.list_(pa.float64()))})

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        sizes = table.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        asked, row = np.unique(np.repeat(table.column("query_id").to_numpy(), sizes), return_inverse=True)
        ids, score = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
        by = np.lexsort((ids, row))
        row, ids, score = row[by], ids[by], score[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        best = list(_ranked(row, ids, score, new, len(asked), k))
        sizes = np.array([len(x) for x, _ in best], np.int64)
        place = np.concatenate([np.arange(1, n + 1) for n in sizes]) if len(sizes) else np.zeros(0, int)
        flat = [np.concatenate([x[i] for x in best]) if best else np.zeros(0) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, sizes), pa.int64()), pa.array(place, pa.int32()), pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    keys = ["list", "block", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, "query_id long, ids array<long>, scores array<double>")
    groups = max(16, probes.count() // 4096)
    return met.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("group").applyInArrow(merged, schema)
