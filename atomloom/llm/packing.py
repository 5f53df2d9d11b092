"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt to shards, and each shard is packed by best fit, longest first. Where no open
bin has room, each permitted size is priced by what is still to be packed: the cost of the bin,
over the tokens that would fill it. The cheapest is opened. A shard is packed with each mix of
sizes, the cheapest packing is kept, and then every bin shrinks to the least permitted size that
holds its contents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import broadcast_if_few

CAPACITIES = (2048, 8192, 32768)
#: Cost of a sequence besides that of its places: what starting it costs, in places.
OVERHEAD = 256
#: The length at which attention costs a place as much as all else does.
ATTENTION = 131_072
SHARD_PIECES = 16_384


def bin_cost(capacity: int) -> float:
    """Places, a fixed cost, and attention's growth with the square of the length."""
    return OVERHEAD + capacity * (1 + capacity / ATTENTION)


def filling(negative: list[int], at: int, capacity: int) -> int:
    """What a bin of ``capacity`` would hold that begins with piece ``at``: always the largest of the pieces behind that fits.

    ``negative`` has the lengths, which descend, with the sign changed.
    """
    used = 0
    while at < len(negative):
        used -= negative[at]
        at = bisect.bisect_left(negative, used - capacity, at + 1)  # the first piece no longer than what is free
    return used


def best_fit(lengths: list[int], mix: tuple[int, ...], capacities: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int], int]:
    """``lengths``, which descend, packed in bins of the sizes in ``mix``: each one's (bin, offset), the bins' contents, and how many opened above the least size.

    A size's price is the cost of the permitted size that its expected filling shrinks to, for each token of that filling.
    """
    negative = [-n for n in lengths]
    room: list[tuple[int, int]] = []  # (free places, bin), ascending
    placed, used, larger = [], [], 0

    def price(capacity: int) -> tuple[float, int]:
        filled = filling(negative, i, capacity)
        return bin_cost(next(c for c in capacities if c >= filled)) / filled, capacity

    for i, n in enumerate(lengths):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fitting = [c for c in mix if c >= n]
            free = min(fitting, key=price)
            larger += free > fitting[0]
            b = len(used)
            used.append(0)
        placed.append((b, used[b]))
        used[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    return placed, used, larger


def pack(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int]]:
    """The cheapest best-fit packing of ``lengths``, which descend, over all mixes of ``capacities``: each one's (bin, offset), and the bins' final sizes.

    Ties go to the mix of fewer sizes, then of smaller ones.
    """
    best = None
    for k in range(1, len(capacities) + 1):
        for mix in combinations(capacities, k):
            if lengths and mix[-1] < lengths[0]:
                continue
            placed, used, _ = best_fit(lengths, mix, capacities)
            sizes = [next(c for c in capacities if c >= u) for u in used]
            cost = sum(map(bin_cost, sizes))
            if best is None or cost < best[0]:
                best = cost, placed, sizes
    return best[1], best[2]


_OUT = "shard long, bin long, capacity long, doc_id long, piece long, first_token long, bin_offset long, n_tokens long"


def _packer(capacities: tuple[int, ...]):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("shard", "doc_id", "piece", "n_tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in groupby(rows(batches), key=lambda r: r[0]):
            own = list(own)
            placed, sizes = pack([r[3] for r in own], capacities)
            columns = zip(*((shard, b, sizes[b], r[1], r[2], r[2] * capacities[-1], at, r[3]) for (b, at), r in zip(placed, own)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def pack_lengths(lengths: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Places in sequences for ``lengths`` (doc_id long, n_tokens long; others are ignored).

    One row for each piece: shard, bin (number within the shard), capacity of the bin (one of
    ``capacities``), doc_id, piece (from 0), first_token (the piece's, in its document), bin_offset (its first place in the bin) and n_tokens.
    Documents longer than the largest capacity are cut in pieces of it, so every token has one place.

    Rows of null or no tokens have no place. Repeated rows are packed each for itself. A null
    doc_id is a document like others. Ties in length are packed by doc_id and piece. An empty
    table gives an empty one.

    Only ids and lengths are shuffled. Shards hold about ``shard_pieces`` pieces whatever the size
    of ``lengths``; rows that repeat a doc_id too often are spread over shards as well. Each shard
    leaves a few bins part-filled at most.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    lengths = lengths.select("doc_id", F.col("n_tokens").cast("long").alias("size")).filter("size > 0")
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / top))))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(top).cast("long"), F.col("size") - F.col("piece") * top).alias("n_tokens"))
    whole = lengths.agg(F.count("*").alias("n"), F.sum(F.floor((F.col("size") - 1) / top)).alias("more")).first()
    shards = max(1, -(-(whole["n"] + (whole["more"] or 0)) // shard_pieces))
    # What more rows repeat than a shard holds is dealt out by the rows' places in their tasks.
    many = pieces.groupBy(F.col("doc_id").alias("_id"), F.col("piece").alias("_piece")).count().filter(F.col("count") > shard_pieces)
    many = broadcast_if_few(many.select("_id", "_piece", F.lit(True).alias("_many")), "repeated")
    marked = pieces.join(many, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")), "left")
    dealt = marked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.when(F.col("_many"), F.monotonically_increasing_id())), F.lit(shards)))
    dealt = dealt.select("shard", "doc_id", "piece", "n_tokens")
    in_order = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece")
    return in_order.mapInArrow(_packer(capacities), _OUT)


def sequences(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The training sequences of ``placed`` (of ``pack_lengths``) for ``tokens`` (doc_id long, ids array<int>).

    One row for each bin: shard, bin, capacity, ids (of all its pieces, in order) and lengths (of
    each piece, by which attention is kept within documents); what is left up to ``capacity`` is
    padding. ``tokens`` has one row for each doc_id of ``placed``; a null doc_id meets its like.
    No more than a bin, of bounded size, is gathered; tokens are cut before they are shuffled to bins.
    """
    parts = placed.select("shard", "bin", "capacity", "first_token", "bin_offset", "n_tokens", F.col("doc_id").alias("_doc"))
    found = parts.join(tokens.select("doc_id", "ids"), F.col("_doc").eqNullSafe(F.col("doc_id")))
    piece = F.struct("bin_offset", F.slice("ids", F.col("first_token").cast("int") + 1, F.col("n_tokens").cast("int")).alias("ids"))
    bins = found.select("shard", "bin", "capacity", piece.alias("p")).groupBy("shard", "bin", "capacity").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return bins.select("shard", "bin", "capacity", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"))


def pack_documents(docs: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pack_lengths`` for ``docs`` (doc_id long, text string; others are ignored), a document's tokens being its UTF-8 bytes and an end token.

    Null and empty texts are the end token alone.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return pack_lengths(docs.select("doc_id", size.alias("n_tokens")), capacities=capacities, shard_pieces=shard_pieces)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
