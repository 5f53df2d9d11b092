"""N-gram Jaccard join by vertical partitioning.

The order of all n-grams, that of their hashes, is cut into fragments. Pairs of documents that may
link are found in fragments: two sets that differ in at most d n-grams cannot differ in all of
d + 1 segments of the order, so they meet where a whole segment agrees. Of each pair found, the
overlap is counted fragment by fragment, and the partial counts are summed by pair.

Documents with equal sets are one class from the start; the work is on classes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from math import ceil, exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import Scratch, broadcast_if_few, materialise, valid_text
from atomloom.llm.components import connected_components
from atomloom.llm.words import gather, slices, split_words, stops_of

WORDS = 4
PERCENT = 85
#: Fragments of the signatures: one for so many bytes of text, and so many at least. A task holds one of them.
FRAGMENT_BYTES, MIN_FRAGMENTS = 32 * 2**20, 32
#: Words whose sets are made at a time, so that they stay in the caches.
RUN_WORDS = 2**16
#: Fragments in which overlaps are counted, and pairs that one group of a fragment counts at a time.
COUNT_FRAGMENTS, GROUP_PAIRS = 4, 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_U32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_runs(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of n-grams of ``texts`` as ascending 64-bit hashes: for runs of about RUN_WORDS words, the sets end to end and where they begin and end."""
    import xxhash

    offsets, index, words = split_words(pc.ascii_lower(texts))
    names = words.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[index]
    if "" in names:  # which is no word
        kept = index != names.index("")
        hashes, offsets = hashes[kept], stops_of(kept)[offsets]
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_WORDS, "right")) - 1)
        yield _sets(hashes[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], n)
        at = stop


def _sets(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts that lie in ``words`` between ``offsets``, end to end, and where they begin and end."""
    sizes = np.diff(offsets)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    grams = np.full(len(words), n, np.uint64)
    for k in range(n):
        grams += padded[k : len(words) + k] * _ODD[k]
    for text in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():  # one n-gram, of all the words
        a, b = offsets[text], offsets[text + 1]
        grams[a] = (words[a:b] * _ODD[: b - a]).sum() + np.uint64(b - a)
    grams = mix(grams)
    counts = np.where(sizes < n, np.minimum(sizes, 1), sizes - n + 1)
    for a, count in zip(offsets.tolist(), counts.tolist()):
        grams[a : a + count].sort()
    place = np.arange(len(words)) - np.repeat(offsets[:-1], sizes)
    new = np.concatenate(([True], grams[1:] != grams[:-1]))[: len(grams)] | (place == 0)
    kept = new & (place < np.repeat(counts, sizes))
    return grams[kept], stops_of(kept)[offsets]


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The set of n-grams of each of ``texts``, as ascending 64-bit hashes."""
    for grams, stops in set_runs(texts, n):
        yield from (grams[a:b] for a, b in zip(stops.tolist(), stops[1:].tolist()))


def most_apart(sizes: int | np.ndarray, percent: int):
    """The most n-grams in which two linked sets can differ, by the sum of their sizes."""
    return sizes * (100 - percent) // (100 + percent)


class Segmenter:
    """Cuts sets to segments, of which two linked sets have one in common."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.counts = percent, [1], {}

    def low(self, k: int) -> int:
        """The least size of class ``k``; linked sets are in the same class or in neighbouring ones."""
        while len(self.lows) <= k:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
        return self.lows[k]

    def size_class(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.low(len(self.lows))
        return bisect.bisect_right(self.lows, size) - 1

    def segments(self, instance: int) -> tuple[int, int, int]:
        """For sets of the classes ``instance`` - 1 and ``instance``: the number of segments, how many may be light without notice, and the most n-grams of a light one.

        No linked sets differ in more than d segments. With d + 1 + s of them, s + 1 agree, so a set
        with at most s light ones shares a segment that is not light. Segments of a single n-gram
        agree wherever texts share a passage, so they are light too where enough others are left.
        0 segments: only equal sets link.
        """
        if instance not in self.counts:
            d = most_apart(2 * (self.low(instance + 1) - 1), self.percent)
            least = self.low(max(0, instance - 1))
            light, spare = 1, 2

            def wanted() -> float:
                mean = least / (d + 1 + spare)
                return 2 + 1.5 * (d + 1 + spare) * exp(-mean) * (1 + mean * light)

            while spare < wanted() and spare <= d:
                spare += 1
            if spare > d:
                light, spare = 0, 2 + ceil(2 * d * exp(-least / (d + 1)))
            self.counts[instance] = (d + 1 + spare, spare, light) if d else (0, 0, 0)
        return self.counts[instance]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """``signatures_of`` of one set."""
        return self.signatures_of(grams, np.array([0, len(grams)]))[1]

    def signatures_of(self, grams: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the segments of the sets in ``grams`` between ``stops``, for the instances of each one's class and the next: the number of the set, and the hash."""
        sizes = np.diff(stops)
        first = np.array([self.size_class(size) for size in sizes.tolist()], np.int64)
        mixed, top, owners = mix(grams), grams >> _U32, np.repeat(np.arange(len(sizes)), sizes)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for instance in (first, first + 1):
            count, spare, light = np.array([self.segments(k) if size else (0, 0, 0) for k, size in zip(instance.tolist(), sizes.tolist())], np.int64).reshape(-1, 3).T
            segment = (top * np.repeat(count.astype(np.uint64), sizes)) >> _U32
            new = np.concatenate(([True], (segment[1:] != segment[:-1]) | (owners[1:] != owners[:-1])))[: len(grams)]
            starts = np.flatnonzero(new)
            held, owner = segment[starts], owners[starts]
            label = _ODD[6] * (instance + 1).astype(np.uint64)
            sums = mix(np.add.reduceat(mixed, starts) + (held + np.uint64(1)) * _ODD[5] + label[owner]) if len(starts) else held
            heavy = np.diff(np.append(starts, len(grams))) > light[owner]
            needed = count - np.bincount(owner[heavy], minlength=len(sizes)) > spare  # too many are light, so that these must do
            kept = (heavy | needed[owner]) & (count[owner] > 0)
            found.append((owner[kept], sums[kept]))
            for own in np.flatnonzero(needed & (count > 0)).tolist():
                empty = np.ones(count[own], bool)
                empty[held[slice(*np.searchsorted(owner, (own, own + 1)))].astype(np.int64)] = False
                empty = np.flatnonzero(empty).astype(np.uint64)
                found.append((np.full(len(empty), own), mix((empty + np.uint64(1)) * _ODD[5] + label[own])))
        owner, sums = (np.concatenate(c) for c in zip(*found))
        return owner, sums


def parities(grams: np.ndarray) -> np.ndarray:
    """How many n-grams fall to each number of lowest bits, modulo 2: at least 256 bits, and one or more for each n-gram; packed."""
    width = max(256, 1 << (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """``parities`` as of fewer bits, ``size`` bytes of them."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


_PART = pa.struct([("fragment", pa.int32()), ("sigs", pa.list_(pa.int32()))])


def _sketcher(n: int, percent: int, fragments: int):
    """doc_id, text -> doc_id, set_key, n_shingles, parity (of 256 bits), parities (of more), parts (signatures by fragment).

    Copies within a task have parts only once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, sent = Segmenter(percent), set()
        for batch in slices(batches):
            at = 0
            for grams, stops in set_runs(batch.column("text"), n):
                sizes = np.diff(stops)
                full = np.flatnonzero(sizes)
                keys = np.zeros(len(sizes), np.uint64)
                keys[full] = mix(np.add.reduceat(mix(grams ^ _ODD[7]), stops[full])) if len(full) else 0
                keys, new, parity, wide = keys.view(np.int64), np.zeros(len(sizes), bool), [None] * len(sizes), [None] * len(sizes)
                for k in full.tolist():
                    if (known := (int(keys[k]), int(sizes[k]))) in sent:
                        continue
                    sent.add(known)
                    new[k] = True
                    bits = parities(grams[stops[k] : stops[k + 1]])
                    parity[k], wide[k] = folded(bits, 32).tobytes(), bits.tobytes()
                owner, sig = segmenter.signatures_of(grams[np.repeat(new, sizes)], stops_of(np.where(new, sizes, 0)))
                where = (sig >> _U32) % np.uint64(fragments)
                part = owner * fragments + where.astype(np.int64)
                order = np.argsort(part)
                part = part[order]
                starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(part)).astype(np.int32)), pa.array(sig[order].astype(np.uint32).view(np.int32)))
                structs = pa.StructArray.from_arrays([pa.array((part[starts] % fragments).astype(np.int32)), lists], fields=list(_PART))
                parts = pa.ListArray.from_arrays(pa.array(stops_of(np.bincount(part[starts] // fragments, minlength=len(sizes))).astype(np.int32)), structs)
                columns = [batch.column("doc_id").slice(at, len(sizes)), pa.array(keys, mask=sizes == 0), pa.array(sizes), pa.array(parity, pa.binary()), pa.array(wide, pa.binary()), parts]
                at += len(sizes)
                yield pa.record_batch(columns, names=["doc_id", "set_key", "n_shingles", "parity", "parities", "parts"])

    return run


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the classes that ``a`` and ``b`` join the smallest of their labels, which are classes themselves."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def candidates(key: np.ndarray, member: np.ndarray, size: np.ndarray, parity: np.ndarray, percent: int, component: np.ndarray | None = None) -> np.ndarray:
    """Pairs of classes that meet in a ``key`` and whose sizes and parities allow a link, as a * len(size) + b with a < b.

    ``member`` has the class at each key; ``size`` and ``parity`` are by class. Parities differ in
    no more bits than the sets in n-grams, so no link is lost. Without ``component`` only pairs
    that join what is not joined yet are returned, enough to connect all; with it, all pairs of
    unlike component.
    """
    order = np.argsort(key)
    key, member = key[order], member[order]
    del order
    same = key[1:] == key[:-1]
    kept = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, member = key[kept], member[kept].astype(np.int64)  # few keys are shared
    order = np.lexsort((member, size[member], key))  # one order in all fragments, so that they find the same pairs
    key, member = key[order], member[order]
    label = np.arange(len(size)) if component is None else component

    def mixed(key: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Whether the members of each position's key are of several labels."""
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        own = label[member]
        return np.repeat(np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts), np.diff(np.append(starts, len(key))))

    lag, found, held = 1, [], 0
    kept = mixed(key, member) if len(key) else np.zeros(0, bool)
    key, member = key[kept], member[kept]
    at = np.arange(len(key))
    while True:
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        a, b = member[at], member[at + lag]
        # Sizes ascend within a key, so who is too small for this partner is so for all further ones.
        near = 100 * size[a] >= percent * size[b]
        at, a, b = at[near], a[near], b[near]
        if not len(at):
            break
        fits = label[a] != label[b]
        a, b = a[fits], b[fits]
        apart = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
        fits = apart <= most_apart(size[a] + size[b], percent)
        pairs = np.unique(np.minimum(a, b)[fits] * len(size) + np.maximum(a, b)[fits])
        if component is None and len(pairs):
            settle(label, pairs // len(size), pairs % len(size))
            at = at[mixed(key, member)[at]]  # a group that has grown together is done
        found.append(pairs)
        held += len(pairs)
        if held > 4_000_000:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
        lag += 1
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


_PACKED = "fragment int, set_key array<long>, n_shingles array<long>, parity binary, widths array<int>, sigs array<int>, component array<long>"
_PARTS = pa.schema([("fragment", pa.int32()), ("set_key", pa.list_(pa.int64())), ("n_shingles", pa.list_(pa.int64())), ("parity", pa.binary()), ("widths", pa.list_(pa.int32())), ("sigs", pa.list_(pa.int32())), ("component", pa.list_(pa.int64()))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_key, n_shingles, parity, component, parts -> a row for each fragment of a batch, so that few rows are shuffled however many fragments there are."""
    for batch in batches:
        lists = batch.column("parts")
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        fragment, sigs = flat.field("fragment").to_numpy(), flat.field("sigs")
        order = np.argsort(fragment, kind="stable")
        fragment, row, sigs = fragment[order], pa.array(row[order]), sigs.take(pa.array(order))
        cuts = np.append(np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1]))[: len(fragment)]), len(fragment))

        def listed(values: pa.Array, at: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)

        stops = sigs.offsets.to_numpy()
        bits = batch.column("parity").take(row)
        bits = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((32 * cuts).astype(np.int32).tobytes()), bits.buffers()[2]])
        columns = [pa.array(fragment[cuts[:-1]]), *(listed(batch.column(c).take(row), cuts) for c in ("set_key", "n_shingles")), bits]
        columns += [listed(pa.array(np.diff(stops)), cuts), listed(sigs.flatten(), stops[cuts] - stops[0]), listed(batch.column("component").take(row), cuts)]
        yield pa.record_batch(columns, schema=_PARTS)


def _pairer(percent: int, across: bool):
    """The candidates of the fragments of one task: enough to connect all, or those ``across`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, _PARTS)
        if len(table):
            table = table.combine_chunks()
            flat = lambda c: table.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False)
            key, size, widths = flat("set_key"), flat("n_shingles"), flat("widths")
            fragment = np.repeat(table.column("fragment").to_numpy(), np.diff(table.column("set_key").chunk(0).offsets.to_numpy()))
            # Copies that several tasks sent are one row; of those, one for each class.
            order = np.lexsort((fragment, size, key))
            fragment, key, size = fragment[order].astype(np.int64), key[order], size[order]
            other = np.concatenate(([True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])))
            kept = other | np.concatenate(([True], fragment[1:] != fragment[:-1]))
            first, own = order[other], (key[other], size[other])
            member, fragment = (np.cumsum(other) - 1)[kept], fragment[kept]
            parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, 4)[first]
            component = flat("component")[first] if across else None
            kept = order[kept]
            sigs, _ = gather(flat("sigs").view(np.uint32), stops_of(widths), kept)
            meet = np.repeat(fragment << 32, widths[kept])
            meet |= sigs
            member = np.repeat(member.astype(np.int32), widths[kept])
            del table, sigs, widths, order, key, size, other, kept
            pairs = candidates(meet, member, own[1], parity, percent, component)
            a, b = pairs // len(own[0]), pairs % len(own[0])
            yield pa.record_batch([pa.array(c) for c in (own[0][a], own[1][a], own[0][b], own[1][b])], names=["a_key", "a_size", "b_key", "b_size"])

    return run


_PLAUSIBLE = ["a", "a_size", "b", "b_size"]


def _plausible(percent: int):
    """Pairs whose parities are no further apart than linked sets can be; parities differ in no more bits than the sets in n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            most = most_apart(batch.column("a_size").to_numpy() + batch.column("b_size").to_numpy(), percent).tolist()
            for x, y, most_bits in zip(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist(), most):
                size = min(len(x), len(y))
                apart = folded(np.frombuffer(x, np.uint8), size) ^ folded(np.frombuffer(y, np.uint8), size)
                kept.append(int(np.bitwise_count(apart).sum()) <= most_bits)
            yield batch.select(_PLAUSIBLE).filter(pa.array(kept, pa.bool_()))

    return run


def _grams(n: int):
    """node, text -> node, fragment, grams: a row for each fragment of the order in which a set has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, fragments, sets = [], [], []
            for node, grams in zip(batch.column("node").to_pylist(), shingles(batch.column("text"), n)):
                cuts = [0, *np.searchsorted(grams, _CUTS).tolist(), len(grams)]
                for fragment, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        nodes.append(node)
                        fragments.append(fragment)
                        sets.append(grams[a:b].view(np.int64))
            offsets = pa.array(stops_of(np.array(list(map(len, sets)), np.int64)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), lists], names=["node", "fragment", "grams"])

    return run


_CUTS = np.array([(k << 64) // COUNT_FRAGMENTS for k in range(1, COUNT_FRAGMENTS)], np.uint64)
_PARTIAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64())])


def _partial_overlaps(members: pa.Table, pairs: pa.Table) -> pa.Table:
    """The overlap of each pair in one fragment, where it is not 0."""
    sets = {node: np.asarray(grams.values) for node, grams in zip(members.column("node").to_pylist(), members.column("grams"))}
    found = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        if a in sets and b in sets and (both := len(np.intersect1d(sets[a], sets[b], assume_unique=True))):
            found.append((a, b, both))
    return pa.Table.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], schema=_PARTIAL)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, fragment, grams): the n-gram sets of the documents that ``nodes`` (node) names, written out.

    The nodes are broadcast if they are few, so that texts are shuffled, once, only beyond that.
    """
    wanted = broadcast_if_few(nodes.select(F.col("node").alias("doc_id")).distinct(), "paired")
    texts = docs.select("doc_id", valid_text("text")).join(wanted, "doc_id").groupBy(F.col("doc_id").alias("node")).agg(F.min("text").alias("text"))
    return materialise(texts.mapInArrow(_grams(n), "node long, fragment int, grams array<long>"), "sets")


def check_pairs(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, a_size, b, b_size, all long) whose ``sets`` (node, fragment, grams) link, as (a, b).

    Each fragment counts its part of every pair's overlap by itself; parts are summed by pair.
    Pairs are counted where they share most: at the smallest neighbour of either end. A group of
    more than GROUP_PAIRS pairs is cut into the cells of a grid, by a hash of either end: a dense
    group's cells hold about GROUP_PAIRS pairs and few sets each, and those of a single document's
    pairs grow with their root only.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    owned = pairs.join(least.withColumnRenamed("m", "m_a"), "a").join(least.select(F.col("a").alias("b"), F.col("m").alias("m_b")), "b")
    owned = owned.select("a", "a_size", "b", "b_size", F.least("m_a", "m_b").alias("owner"))
    sizes = owned.groupBy("owner").agg(F.ceil(F.sqrt(F.count("*") / GROUP_PAIRS)).alias("side"))
    split = F.pmod(F.xxhash64("a"), "side") * F.col("side") + F.pmod(F.xxhash64("b"), "side")
    grouped = materialise(owned.join(sizes, "owner").withColumn("split", split).drop("side"), "pair-groups")
    members = grouped.select("owner", "split", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = members.join(sets, "node")
    every = F.explode(F.sequence(F.lit(0), F.lit(COUNT_FRAGMENTS - 1))).alias("fragment")
    asked = grouped.select(*(F.col(c).alias(c) for c in ("owner", "split", "a", "b")), every)
    cell = ["owner", "split", "fragment"]
    partial = held.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(_partial_overlaps, "a long, b long, both long")
    overlap = partial.groupBy("a", "b").agg(F.sum("both").alias("both"))
    given = grouped.select(F.col("a").alias("x"), "a_size", F.col("b").alias("y"), "b_size").distinct()
    counted = overlap.join(given, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
    return counted.filter(100 * F.col("both") >= percent * (F.col("a_size") + F.col("b_size") - F.col("both"))).select("a", "b")


def link_documents(docs: DataFrame, *, n: int = WORDS, percent: int = PERCENT, fragments: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id long, text string; others are ignored).

    A text's set holds its distinct runs of ``n`` words (words: anything but ASCII white space,
    A-Z in lower case), or the whole text where it has fewer. Documents link where the overlap of
    their sets is at least ``percent`` hundredths of their union; component_id is the smallest
    doc_id that links reach. Sets are compared by 64-bit hashes.

    A text without words, or null, has an empty set, links with nothing, and is its own component.
    Repeated rows are linked each, alike; a doc_id whose rows differ is judged by its smallest
    text where pairs are checked. A null doc_id gets the component of its copies, or null.
    Bytes that are no UTF-8 count as U+FFFD. An empty table gives an empty one. ``fragments`` is by default in proportion to the texts.

    Hot groups: copies are one class before anything is paired, so a group of any size makes one
    row a task. Near copies meet in segments and are filtered by size and parity; of those left,
    only enough to connect them are checked, and then the pairs between what did not connect.
    Pairs are checked in groups of bounded size.
    """
    if fragments is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
        fragments = max(MIN_FRAGMENTS, -(-size // FRAGMENT_BYTES))
    sketched = docs.select("doc_id", valid_text("text")).mapInArrow(
        _sketcher(n, percent, fragments), "doc_id long, set_key long, n_shingles long, parity binary, parities binary, parts array<struct<fragment:int,sigs:array<int>>>"
    )
    sketched = materialise(sketched, "sketches")

    def paired(rows: DataFrame, tasks: int, across: bool) -> DataFrame:
        parts = rows.select("set_key", "n_shingles", "parity", "component", "parts").filter(F.size("parts") > 0).mapInArrow(_packed, _PACKED)
        dealt = parts.repartitionById(tasks, F.pmod("fragment", F.lit(tasks)))
        found = dealt.mapInArrow(_pairer(percent, across), "a_key long, a_size long, b_key long, b_size long")
        return materialise(found.distinct(), "pairs")

    with Scratch() as scratch:
        # First enough pairs to connect all that may belong together, so that a group of near copies has no more of them than members.
        pairs = paired(sketched.withColumn("component", F.lit(None).cast("long")), fragments, False)

        # A class is known by its smallest doc_id. Only classes of several documents, or in a pair, need a row.
        classes = sketched.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("parities").alias("bits"))
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a_key").alias("k"), F.col("a_size").alias("s")), F.struct(F.col("b_key").alias("k"), F.col("b_size").alias("s")))).alias("e")).select("e.k", "e.s", F.lit(True).alias("paired")).distinct()
        classes = classes.join(ends, (F.col("set_key") == F.col("k")) & (F.col("n_shingles") == F.col("s")), "left")
        classes = materialise(classes.filter("copies > 1 OR paired").select("set_key", "n_shingles", "node", F.coalesce("paired", F.lit(False)).alias("paired"), F.when(F.col("paired"), F.col("bits")).alias("bits")), "classes")

        def links_of(pairs: DataFrame) -> DataFrame:
            def end(side: str) -> DataFrame:
                return classes.select(F.col("set_key").alias(f"{side}_key"), F.col("n_shingles").alias(f"{side}_size"), F.col("node").alias(side), F.col("bits").alias(f"{side}_bits"))

            by_node = pairs.join(end("a"), ["a_key", "a_size"]).join(end("b"), ["b_key", "b_size"]).select(*_PLAUSIBLE, "a_bits", "b_bits")
            likely = materialise(by_node.mapInArrow(_plausible(percent), "a long, a_size long, b long, b_size long"), "plausible")
            sets = sets_of(docs, likely.select(F.explode(F.array("a", "b")).alias("node")), n)
            return check_pairs(likely, sets, percent=percent)

        def table_of(reached: DataFrame) -> DataFrame:
            """The component of each class, broadcast if few."""
            return broadcast_if_few(classes.join(reached, "node", "left").select("set_key", "n_shingles", "paired", F.coalesce("component", "node").alias("component")), "components")

        reached = connected_components(links_of(pairs))
        # Then all pairs that are left between unlike components. Any class that has one was in a pair before.
        table = table_of(reached)
        unsettled = sketched.filter(F.size("parts") > 0).join(table.filter("paired"), ["set_key", "n_shingles"])
        pairs = paired(unsettled, max(8, min(fragments, table.count() // 20_000)), True)
        more = links_of(pairs)
        reached = connected_components(more.union(reached.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        table = table_of(reached)
        scratch.keep(table)
    rows = sketched.select("doc_id", "set_key", "n_shingles").join(table, ["set_key", "n_shingles"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
