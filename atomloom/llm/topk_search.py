"""Exact top-k by inner product: ball trees searched by branch and bound, shard by shard.

Vectors are dealt to shards, each small enough for one task. Queries go through the shards in
waves: first each searches the shard it lies in, then the next 7, then the next 56 and so on. The
k-th score that a query has so far is shared with all shards of its next wave, where it prunes from
the start. Within a shard, nodes are visited in order of the upper bound of their inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import Scratch, materialise

SCALE = 1024
K = 10
QUERY_EVERY = 100
SHARD_VECTORS = 8192
#: By how much each wave's shards are more than all before.
WAVE = 8
#: Queries that one task searches a shard for; beyond that the shard is copied to further tasks.
CELL_QUERIES = 65536
#: Most partitions that a wave is dealt to; a task takes its shards one after the other.
PARTITIONS = 20_000
LEAF_VECTORS = 64


class BallTree:
    """Balls over the rows of ``vectors``; leaves hold up to LEAF_VECTORS of them, halved at the median of the widest dimension."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        centres, radii, self.spans, self.children = [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            start, end, parent = todo.pop()
            own = vectors[self.order[start:end]].astype(np.float64)
            centre = own.mean(axis=0, dtype=np.float64)
            node = len(centres)
            if parent >= 0:
                self.children[parent].append(node)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            self.spans.append((start, end))
            self.children.append([])
            if end - start > LEAF_VECTORS:
                half = (end - start) // 2
                widest = np.argmax(own.var(axis=0))
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, widest], half)]
                todo += [(start, start + half, node), (start + half, end, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a score that no vector of the node exceeds; padded against rounding."""
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        exact = queries @ self.centres.T + norms[:, None] * self.radii
        return exact + 1e-9 * (1 + np.abs(exact) + norms[:, None] * np.abs(self.centres).max(initial=0))


def search(tree: BallTree, ids: np.ndarray, query: np.ndarray, own_id: int, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
    """The k best (score, id) with at least ``least``; ties go to the smaller id, ``own_id`` takes no part."""
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
    nodes = [(-bounds[0], 0)]
    while nodes:
        bound, node = heapq.heappop(nodes)
        floor = max(least, best[0][0]) if len(best) == k else least
        if -bound < floor:
            break
        if tree.children[node]:
            for child in tree.children[node]:
                heapq.heappush(nodes, (-bounds[child], child))
            continue
        start, end = tree.spans[node]
        scores = tree.vectors[start:end] @ query
        for i in np.flatnonzero(scores >= floor):
            item = (int(scores[i]), -int(ids[start + i]))
            if -item[1] == own_id:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(score, -i) for score, i in sorted(best, reverse=True)]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors by rows, as floor(SCALE * x): doubles where no inner product can pass 2**53, else 64-bit integers, or Python's beyond those."""
    rows = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * SCALE)
    top = float(np.abs(scaled).max(initial=0))
    if top * top * max(rows.shape[1], 1) < 2**52:
        return scaled
    if top * top * max(rows.shape[1], 1) < 2**62:
        return scaled.astype(np.int64)
    return np.array([[int(y) if np.isfinite(y) else int(x) * SCALE for x, y in zip(*both)] for both in zip(rows.tolist(), scaled.tolist())], object)


class Shard:
    """The vectors of one shard, and the trees over them: one for each kind of numbers that queries ask for."""

    def __init__(self, parts: list[pa.RecordBatch]):
        copies = np.concatenate([p.column("copies").to_numpy() for p in parts])
        self.ids = np.repeat(np.concatenate([p.column("vec_id").to_numpy() for p in parts]), copies)
        self.rows = np.repeat(_matrix(pa.concat_arrays([p.column("v") for p in parts])), copies, axis=0)
        self.trees: dict[bool, BallTree] = {}

    def tree(self, exact: bool) -> BallTree:
        if exact not in self.trees:
            self.trees[exact] = BallTree(_exact(self.rows) if exact else self.rows)
        return self.trees[exact]

    def found(self, queries: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, vector, score) of the ``k`` best of each query with at least its score so far."""
        asked = _matrix(queries.column("v"))
        exact = asked.dtype != self.rows.dtype  # either may be small where the other is not
        tree = self.tree(exact)
        asked = _exact(asked) if exact else asked
        bounds = tree.bounds(asked)
        for i, (own, least) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("least").to_pylist())):
            for score, other in search(tree, self.ids[tree.order], asked[i], own, bounds[i], k, -np.inf if least is None else least):
                yield own, other, max(-_LONG - 1, min(score, _LONG))


def _exact(rows: np.ndarray) -> np.ndarray:
    return rows if rows.dtype == object or not rows.size else np.vectorize(int, otypes=[object])(rows)


_LONG = 2**63 - 1
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_CELL = ["dim", "shard", "part"]


def _searched(k: int):
    """For rows by cell, vectors before queries: builds each shard once and streams its queries through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*_CELL, "asks"]], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for start, end in zip(starts[:-1], starts[1:]):
                if start == end:
                    continue
                piece, (*key, asks) = batch.slice(start, end - start), keys[start].tolist()
                if key != cell:
                    cell, held, shard = key, [], None
                if not asks:
                    held.append(piece)
                    continue
                if shard is None and held:
                    shard, held = Shard(held), []
                found = list(shard.found(piece, k)) if shard else []
                yield pa.record_batch([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, *, k: int = K, query_every: int = QUERY_EVERY, shard_vectors: int = SHARD_VECTORS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The ``k`` best inner products of each query of ``vectors`` (vec_id long, embedding array; others are ignored).

    Components count as floor(1024 * x). Queries are the rows whose vec_id is divisible by
    ``query_every``; candidates are all rows but those of the query's own vec_id. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and fewer than ``k``
    candidates give fewer rows.

    Rows with a null vec_id or vector, or null or non-finite components, take no part. Rows that
    repeat a vec_id are candidates each for itself; where a query's rows do, it is the smallest of
    its vectors. Scores are exact at any size of components, and returned as the nearest long
    where they are beyond it. Vectors of another length than the query's are no candidates; those
    of length 0 take no part. An empty table gives an empty one.

    Rows that repeat both are counted before they move, and go to a shard as one, so no shard is
    larger than others. Each wave shuffles the vectors once and every query to its shards of that
    wave; waves grow in number with the logarithm of the table. A task holds one shard, through
    which the queries are streamed. The result is written to the shared folder.
    """
    if vectors.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    clean = vectors.select("vec_id", F.col("embedding").alias("v")).filter(
        "vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    with Scratch() as scratch:
        counted = clean.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
        counted = materialise(counted.withColumn("dim", F.size("v").cast("long")), "vectors")
        asked = counted.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = materialise(asked.withColumn("dim", F.size("v").cast("long")), "queries")
        shards, n_asked = max(1, -(-counted.count() // shard_vectors)), asked.count()
        home = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))
        best, done = None, 0
        while done < shards:
            upto = min(shards, max(1, WAVE * done))
            parts = max(1, -(-n_asked * (upto - done) // (shards * cell_queries)))
            least = F.lit(None).cast("long").alias("least")
            queries = asked.select("*", least)
            if best is not None:
                last = best.filter((F.col("rank") == k) & (F.col("score") > -_LONG)).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
                queries = asked.join(last, "vec_id", "left")
            offset = F.explode(F.sequence(F.lit(done).cast("long"), F.lit(upto - 1).cast("long")))
            queries = queries.withColumn("offset", offset).select(
                "dim", F.pmod(home + F.col("offset"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).alias("part"),
                F.lit(1).cast("long").alias("asks"), "vec_id", "v", F.lit(1).cast("long").alias("copies"), "least",
            )
            part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
            rows = counted.select("dim", home.alias("shard"), part, F.lit(0).cast("long").alias("asks"), "vec_id", "v", "copies", least)
            n = min(shards * parts, PARTITIONS)
            dealt = rows.unionByName(queries).repartitionById(n, F.pmod(F.col("shard") * parts + F.col("part"), F.lit(n)).cast("int"))
            found = dealt.sortWithinPartitions(*_CELL, "asks").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
            if best is not None:
                found = found.unionByName(best.select(found.columns))
            best, done = materialise(_best(found, k), "top-k"), upto
        scratch.keep(best)
    return best


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
