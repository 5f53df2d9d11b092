"""Sharding by longest processing time: groups of equal texts, largest first, each to the shard with least bytes so far.

Groups of one size are interchangeable, so the heap works on sizes and how many groups have each:
what it does to a thousand groups of a size is told by how many of them each shard takes. Sizes
that differ are few: those of T bytes in all are less than the root of 2 T, 15 million in 100 TB.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import Scratch, materialise, numbered
from atomloom.llm.merkle_manifest import CRC, CRC_TABLE

SHARDS = 8
#: Groups of more than one in so many rows of the table meet their rows by broadcast: there are fewer of them than this.
HOT_GROUPS = 10_000


class Loads:
    """The loads of shards, dealt out longest first."""

    def __init__(self, shards: int):
        self.heap = [(0, k) for k in range(shards)]

    def deal(self, size: int, count: int) -> dict[int, int]:
        """How many of ``count`` groups of ``size`` each shard takes, if each in turn goes to the least loaded (ties: the first).

        Where the least loaded shards lie within ``size`` of each other and would take turns, whole
        turns are taken at once, until the next shard comes within reach.
        """
        taken: dict[int, int] = {}
        while count:
            if count > len(self.heap):
                ranked = sorted(self.heap)
                near = [x for x in ranked if x[0] - ranked[0][0] < size]
                turns = count // len(near)
                if len(near) < len(ranked):
                    turns = min(turns, (ranked[len(near)][0] - near[-1][0]) // size)
                if turns > 0:
                    for _, k in near:
                        taken[k] = taken.get(k, 0) + turns
                    count -= turns * len(near)
                    self.heap = [(load + turns * size, k) for load, k in near] + ranked[len(near) :]
                    heapq.heapify(self.heap)
                    continue
            load, k = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, k))
            taken[k] = taken.get(k, 0) + 1
            count -= 1
        return taken


def _dealt(shards: int):
    """For the sizes in descending order: (bytes, shards, stops), the shards that take groups of that size, and the number of groups taken up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = Loads(shards)
        for batch in batches:
            taken = [sorted(loads.deal(s, c).items()) for s, c in zip(batch.column("bytes").to_pylist(), batch.column("groups").to_pylist())]
            who = pa.array([[k for k, _ in t] for t in taken], pa.list_(pa.int32()))
            stops = pa.array([np.cumsum([c for _, c in t]).tolist() for t in taken], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("bytes"), who, stops], names=["bytes", "shards", "stops"])

    return run


def shard(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """Where each row of ``docs`` (doc_id, text; others are ignored) goes: shards of near equal bytes, equal texts together.

    Returns doc_id, size (bytes of the text and 1), text_crc32, law (always ``bytes``), shard, slot
    (the row's place in its shard, by doc_id, from 0) and grown_shard (always null, as this law
    needs all sizes). The largest groups are dealt first, each to the shard with least bytes, ties
    to the first shard; among groups of one size the first shards take those of the least digests.

    A null text counts as an empty one, and is in one group with those; a null doc_id has the first
    slots; repeated rows are rows each. A group is never split, so one that holds more than its
    share makes its shard the largest. An empty table gives an empty one. Texts are read once and
    never move: groups are SHA-256 digests, counted on each task before they are shuffled. Groups
    of one size, and rows of one shard, are numbered in ranges; only the counts by size, fewer than
    the root of twice the bytes, stream through one task, which keeps nothing but the loads.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    with Scratch() as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
        rows = materialise(rows, "shard-rows")
        groups = numbered(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), ["bytes"], ["digest"], "shard-groups")
        groups = materialise(groups, "shard-placed")
        sizes = groups.groupBy("bytes").agg(F.count("*").alias("groups")).repartition(1).sortWithinPartitions(F.desc("bytes"))
        dealt = materialise(sizes.mapInArrow(_dealt(shards), "bytes long, shards array<int>, stops array<long>"), "shard-dealt")
        at = F.size(F.filter("stops", lambda s: s <= F.col("place")))
        placed = materialise(groups.join(dealt, "bytes").select("digest", "copies", F.get("shards", at).alias("shard")), "shard-of-group")
        many = F.col("copies") * HOT_GROUPS > rows.count()
        hot = placed.filter(many).select("digest", "shard")  # fewer than HOT_GROUPS
        cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(placed.filter(~many).select("digest", "shard"), "digest")
        sent = rows.join(F.broadcast(hot), "digest").unionByName(cold)
        out = numbered(sent.select("doc_id", "size", "text_crc32", "shard", "digest"), ["shard"], ["doc_id", "digest"], "shard-slots")
        out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
        out = materialise(out, "shards")
        scratch.keep(out)
    return out


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE k AS (SELECT {CRC_TABLE} AS tab),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS digest, {CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, k),
g AS (SELECT digest, sum(size)::BIGINT AS bytes FROM d GROUP BY digest),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, digest) AS turn, row_number() OVER (PARTITION BY bytes ORDER BY digest) AS place FROM g),
s(turn, bytes, shard, loads) AS (
  SELECT 0, 0::BIGINT, 0, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]
  UNION ALL
  SELECT turn, bytes, low - 1, list_transform(loads, lambda x, i: CASE WHEN i = low THEN x + bytes ELSE x END)
  FROM (SELECT o.turn::INT AS turn, o.bytes, s.loads, list_position(s.loads, list_min(s.loads))::INT AS low FROM s JOIN o ON o.turn = s.turn + 1)),
p AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS place FROM s WHERE turn > 0),
r AS (SELECT d.*, p.shard::INT AS shard FROM d JOIN o USING (digest) JOIN p ON p.bytes = o.bytes AND p.place = o.place)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, digest) - 1 AS slot, NULL::INT AS grown_shard FROM r
"""
