"""Ranked lexical search of many items at once, with what the items have in common computed once.

Sets of terms that several items share are mined first: from the pair of terms that most items
hold, then pairs of pairs and so on, into a graph whose nodes add up two others. Over a block of
documents each node is one accumulator, a partial score of every document, made once however many
items use it; an item's scores are the sum of the few nodes that it is left with.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import Scratch, materialise, utf8, valid_text
from atomloom.llm.words import slices, stops_of

K = 10
B_PERCENT = 90
SATURATION = 8
#: Terms of items, with repeats over items, that are searched for in one pass: about so many, in half-filled groups of items.
GROUP_TERMS = 20_000
#: Of an item's terms, so many of those that most items share are paired up when sets are mined; results do not depend on it.
PAIRED_TERMS = 256
#: Bytes of accumulators that a task holds.
BLOCK_BYTES = 64 * 2**20
#: Groups that the best of each task are ranked in before they meet.
SALTS = 64

#: Everything but digits, letters and what is not ASCII parts terms; A-Z count as a-z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def mine(items: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Sums of two nodes each, numbered from ``n_terms`` on, and the nodes that each of ``items`` (lists of distinct terms) is left with.

    Nodes of an item are disjoint sets of its terms and cover them. Each sum is used by two items or more.
    """
    holders = [0] * n_terms  # by node, the items that still have it, as bits
    for i, own in enumerate(items):
        for t in own:
            holders[t] |= 1 << i
    left = [set(own) for own in items]
    queue: list[tuple[int, int, int]] = []

    def offer(a: int, b: int) -> None:
        shared = (holders[a] & holders[b]).bit_count()
        if shared > 1:
            heapq.heappush(queue, (-shared, min(a, b), max(a, b)))

    pairs = set()
    for own in items:
        common = sorted((t for t in own if holders[t].bit_count() > 1), key=lambda t: (-holders[t].bit_count(), t))[:PAIRED_TERMS]
        common.sort()
        pairs.update((a, b) for n, a in enumerate(common) for b in common[n + 1 :])
    for a, b in pairs:
        offer(a, b)
    sums = []
    while queue:
        count, a, b = heapq.heappop(queue)
        both = holders[a] & holders[b]
        if both.bit_count() != -count:
            offer(a, b)
            continue
        node = len(holders)
        sums.append((a, b))
        holders.append(both)
        holders[a] &= ~both
        holders[b] &= ~both
        beside: set[int] = set()
        while both:
            i = both.bit_length() - 1
            both ^= 1 << i
            left[i] -= {a, b}
            beside |= left[i]
            left[i].add(node)
        for other in beside:
            offer(node, other)
    return sums, [sorted(own) for own in left]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text"))):
            found = [t.decode() for t in dict.fromkeys(terms(text))]
            yield pa.record_batch([pa.array([i] * len(found), pa.int64()), pa.array(found, pa.string())], names=["item_id", "term"])


_PLAN = "group long, node int, kind string, term string, item_id long, parts array<int>"


def _plan(key: tuple, table: pa.Table) -> pa.Table:
    """The graph of one group of items, in order of ``node``: a row a term, then a row a sum with its two parts, then a row an item with its parts."""
    table = table.sort_by([("item_id", "ascending"), ("term", "ascending")])
    vocabulary = sorted(set(table.column("term").to_pylist()))
    at = {t: n for n, t in enumerate(vocabulary)}
    own: dict[int | None, list[int]] = {}
    for i, t in zip(table.column("item_id").to_pylist(), table.column("term").to_pylist()):
        own.setdefault(i, []).append(at[t])
    sums, left = mine(list(own.values()), len(at))
    rows = [("term", t, None, None) for t in vocabulary] + [("sum", None, None, list(s)) for s in sums] + [("item", None, i, parts) for i, parts in zip(own, left)]
    kind, term, item, parts = zip(*rows)
    group = pa.array([key[0].as_py()] * len(rows), pa.int64())
    node = pa.array(range(len(rows)), pa.int32())
    return pa.table({"group": group, "node": node, "kind": kind, "term": pa.array(term, pa.string()), "item_id": pa.array(item, pa.int64()), "parts": pa.array(parts, pa.list_(pa.int32()))})


class Plan:
    """A group's graph, as tasks use it."""

    def __init__(self, rows: list):
        by = {kind: [r for r in rows if r["kind"] == kind] for kind in ("term", "sum", "item")}
        self.vocabulary = [r["term"].encode() for r in by["term"]]
        self.sums = [tuple(r["parts"]) for r in by["sum"]]
        self.items = [(r["item_id"], r["parts"]) for r in by["item"]]
        self.block = max(1, BLOCK_BYTES // (8 * (len(rows) + 1)))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Items by documents, from the first rows of ``values``, a score of each term and document; the others are for the sums."""
        n = len(self.vocabulary)
        for node, (a, b) in enumerate(self.sums, n):
            np.add(values[a], values[b], out=values[node])
        return np.array([values[parts].sum(axis=0) for _, parts in self.items])


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of ``docs``: the number of terms, and those of ``vocabulary`` by place in it with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: n for n, t in enumerate(vocabulary)}
        for batch in slices(batches):
            n, sizes, found, tfs = [], [], [], []
            for text in utf8(batch.column("text")):
                words = terms(text)
                counts = Counter(words)
                known = counts.keys() & at.keys()
                n.append(len(words))
                sizes.append(len(known))
                found += [at[t] for t in known]
                tfs += [counts[t] for t in known]
            stops = pa.array(stops_of(np.array(sizes, np.int64)), pa.int32())
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(stops, pa.array(found, pa.int32())), pa.ListArray.from_arrays(stops, pa.array(tfs, pa.int32())),
            ], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>").filter("n > 0")


def _lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms; beyond 64 bits on the way, by Python's integers."""
    if B_PERCENT * documents * int(n.max(initial=0)) < 2**62:
        return 100 - B_PERCENT + B_PERCENT * documents * n // total
    return np.array([100 - B_PERCENT + B_PERCENT * documents * int(x) // total for x in n], np.int64)


class _Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.held = [np.empty(0, np.int64)] * 4  # item, score, whether it has a doc_id, doc_id

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        both = [np.concatenate(x) for x in zip(self.held, (item, scores[item, at], known[at], ids[at]))]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        item, score = both[0][order], both[1][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.held = [x[order][rank < self.k] for x in both]
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]


def _ranked(plan: Plan, weights: np.ndarray, documents: int, total: int, k: int):
    """For postings: the ``k`` best documents of a task for each item of ``plan``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(plan.items), k)
        values = np.empty((len(plan.vocabulary) + len(plan.sums), plan.block), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, plan.block):
                own = batch.slice(start, plan.block)
                found, tfs = own.column("terms"), own.column("tfs").flatten().to_numpy().astype(np.int64)
                m = _lengths(own.column("n").to_numpy(), documents, total)
                doc = np.repeat(np.arange(own.num_rows), np.diff(found.offsets.to_numpy()))
                term = found.flatten().to_numpy()
                block = values[:, : own.num_rows]
                block[: len(plan.vocabulary)] = 0
                block[term, doc] = weights[term] * (1_000_000_000 * tfs // (1000 * tfs + SATURATION * m[doc]))
                ids = own.column("doc_id")
                best.add(plan.scores(block), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy())
        item, score, known, ids = best.held
        names = pa.array([i for i, _ in plan.items], pa.int64()).take(pa.array(item))
        yield pa.record_batch([names, pa.array(ids, mask=known == 0), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, *, k: int = K, group_terms: int = GROUP_TERMS) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text); other columns are ignored.

    Returns item_id, rank (from 1), doc_id, score, for scores above 0; equal scores by doc_id,
    null first. Terms are runs of digits, letters and anything that is not ASCII, A-Z as a-z; a
    null text has none, and bytes that are no UTF-8 count as U+FFFD. A term's weight falls with the
    number of documents that hold it, its score rises with its occurrences to a bound and falls
    with the length of the document over the mean; scores are 64-bit integers.

    Rows that repeat an item_id are one item with the terms of all; a null item_id is one. Repeated
    documents are ranked each for itself. Items or documents without terms have no rows; an empty
    table gives an empty one.

    Items are taken in groups of about ``group_terms`` terms at most, so a group's graph, which
    goes to every task, has a bound whatever the number of items (one item with more terms is a
    group by itself); for each group documents are read once, and only the occurrences of its terms
    are kept. Tasks hold one block of accumulators and send on the ``k`` best of each item, which
    are ranked in SALTS parts before they meet.
    """
    spark = docs.sparkSession
    with Scratch() as scratch:
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(valid_text("text"), F.lit("")).alias("text"))
        held = materialise(rows.mapInArrow(_item_terms, "item_id long, term string").distinct(), "search-items")
        size = held.count()
        groups = 1 if size <= group_terms else -(-2 * size // group_terms)
        group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group")
        plans = materialise(held.select(group, "item_id", "term").groupBy("group").applyInArrow(_plan, _PLAN), "search-plans")
        found = []
        for g in range(groups):
            plan = Plan(plans.filter(F.col("group") == g).orderBy("node").collect())  # as small as group_terms
            if not plan.items:
                continue
            posted = materialise(postings(docs, plan.vocabulary), "search-postings")
            documents, total = posted.agg(F.count("*"), F.sum("n")).first()
            holding = dict(posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())  # one a term of the group
            weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(plan.vocabulary))], np.int64)
            best = posted.filter("size(terms) > 0").mapInArrow(_ranked(plan, weights, documents, total or 1, k), "item_id long, doc_id long, score long")
            order = [F.desc("score"), F.asc_nulls_first("doc_id")]
            salted = best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
            placed = salted.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            found.append(materialise(placed.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "search-best"))
        scratch.keep(*found)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_SPLIT} AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, row, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS total FROM w),
f AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM w) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark)),
v AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, s GROUP BY term, documents),
r AS (
  SELECT item_id, any_value(doc_id) AS doc_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN v USING (term) JOIN w USING (row), s GROUP BY item_id, row),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
