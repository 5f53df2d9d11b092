"""Lexical search, Merkle manifest and sharding: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force beside them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomloom.llm import common, lexical_search, merkle_manifest, sharding

LONG = "a very long text " * 20_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one two three"), (5, "one two three"), (5, "another text"), (None, "one two three"), (7, "Ünïcode — 日本語 \U0001f600\nx\x00y")]


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang), with columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src" if r[0] else None, 3, "x", 1, "y", 2, "z") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, digest string, n long, shard string")


def test_numbering_by_ranges(spark):
    rows = [("a" if i % 3 else "b", i // 2) for i in range(200)] + [("c", None), ("c", None), ("c", 1)]
    with common.Scratch() as scratch:
        got = common.numbered(spark.createDataFrame(rows, "g string, o int"), ["g"], ["o"], "test")
        found = defaultdict(list)
        for r in got.orderBy("g", "place").collect():
            found[r["g"]].append((r["o"], r["place"], r["n"]))
        scratch.keep()
    for g, own in found.items():
        assert [p for _, p, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}
        order = [-1 if o is None else o for o, *_ in own]
        assert order == sorted(order)


# 11

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k):
    counts = [(d, Counter(words(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    total, n_docs = sum(sum(c.values()) for _, c in counts), len(counts)
    df = Counter(t for _, c in counts for t in c)
    held = defaultdict(set)
    for i, t in items:
        held[i] |= set(words(t))
    out = {}
    for i, own in held.items():
        scores = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, -1 if d is None else d, d))
        out[i] = [(d, -s) for s, _, d in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


@pytest.mark.parametrize("group_terms", [10_000, 150])
def test_search_by_brute_force(spark, group_terms):
    rng = np.random.default_rng(0)
    say = lambda n: " ".join(f"{'Wort' if rng.random() < 0.5 else 'wORT'}{int(rng.zipf(1.4)) % 60}" + rng.choice([",", "", "-x", "é"]) for _ in range(n))
    rows = [*ODD, *((20 + i, say(int(rng.integers(1, 60)))) for i in range(300)), *((900 - i, "Wort1 wort2 gleich") for i in range(40))]
    items = [(i, say(12)) for i in range(25)] + [(30, None), (31, ""), (32, "no such terms at all"), (None, "one wort2 gleich"), (0, "three one"), (33, "wort2 Gleich wort1"), (33, "wort2 Gleich wort1")]
    got = defaultdict(list)
    found = lexical_search.rank(docs(spark, rows), spark.createDataFrame([(*i, 1, "k") for i in items], "item_id long, text string, group long, kind string"), group_terms=group_terms)
    for r in found.orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    assert got == ranked(rows, items, 10)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.rank(docs(spark, ODD), none).count() == 0
    assert lexical_search.rank(docs(spark, []), one).count() == 0
    assert lexical_search.rank(docs(spark, [(1, None), (2, " .")]), one).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 14), unique=True, max_size=12), max_size=9), st.integers(0, 2**31))
def test_shared_sums_add_up(items, seed):
    """Items' scores are those of their terms, each sum serves two items or more, and sharing never costs an addition."""
    sums, left = lexical_search.mine(items, 15)
    values = np.zeros((15 + len(sums), 4), np.int64)
    values[:15] = np.random.default_rng(seed).integers(0, 1000, size=(15, 4))
    for node, (a, b) in enumerate(sums, 15):
        values[node] = values[a] + values[b]
    for own, parts in zip(items, left):
        assert (values[parts].sum(axis=0) == values[own].sum(axis=0)).all() and len(parts) <= len(own)
    served = Counter()
    for parts in left:
        todo = list(parts)
        while todo:
            node = todo.pop()
            served[node] += 1
            todo += sums[node - 15] if node >= 15 else ()
    assert all(served[15 + n] >= 2 for n in range(len(sums)))
    adds = lambda lists: sum(max(0, len(x) - 1) for x in lists)
    assert adds(left) + len(sums) <= adds(items)


def test_what_items_share_is_found():
    """Items with ten terms in common are left with one node for them and their own terms."""
    sums, left = lexical_search.mine([[*range(10), 10 + i] for i in range(5)], 15)
    assert len(sums) == 9 and all(len(parts) == 2 for parts in left)


def test_long_documents_do_not_overflow():
    n = np.array([3, 2**40], np.int64)
    assert lexical_search._lengths(n, 2**30, 2**45).tolist() == [10 + 90 * 2**30 * int(x) // 2**45 for x in n]


# 12


def h(*parts):
    return hashlib.sha256(b"".join(p.encode() if isinstance(p, str) else p for p in parts)).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def manifest_by_brute_force(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[(r["lang"] is not None, (r["lang"] or "").encode())].append((-1 if r["doc_id"] is None else r["doc_id"], leaf(r, r["text"]), r))
    built = {k: levels_of([x[1] for x in sorted(own, key=lambda x: x[:2])]) for k, own in trees.items()}
    top = levels_of([built[k][-1][0] for k in sorted(built)])
    out = []
    for n, k in enumerate(sorted(trees)):
        for at, (_, own, r) in enumerate(sorted(trees[k], key=lambda x: x[:2])):
            text, siblings = r["text"], ""
            node = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for levels, i in ((built[k], at), (top, n)):
                for nodes in levels[:-1]:
                    run = nodes[i - i % 8 : i - i % 8 + 8]
                    siblings += "".join(run[: i % 8] + run[i % 8 + 1 :])
                    run[i % 8] = node
                    node, i = h(*run), i // 8
            out.append((r["doc_id"], own, built[k][-1][0], top[-1][0], h(siblings), node, node == top[-1][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest_by_brute_force(spark, monkeypatch, levels):
    """Trees of one leaf, of a full run and one more, with blocks of all heights; more languages than one run."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8**levels)
    rows = [*ODD, (70, "Null Lang", None), (71, "null lang", None), (72, "Empty lang", "")]
    rows += [(1000 * n + i, f"Text {i}" if i % 2 else f"text {i}", f"l{n}é") for n, size in enumerate((1, 8, 9, 64, 65, 150, 2, 2, 3)) for i in range(size)]
    table = docs(spark, rows)
    got = merkle_manifest.manifest(table)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == manifest_by_brute_force([r.asDict() for r in table.collect()])


def test_manifest_of_little(spark):
    assert merkle_manifest.manifest(docs(spark, [])).count() == 0
    one = merkle_manifest.manifest(docs(spark, [(1, "x")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h("") and one["verified"]
    same = merkle_manifest.manifest(docs(spark, [(1, "x")] * 20)).collect()
    assert len(same) == 20 and len({tuple(r)[:4] for r in same}) == 1 and all(r["verified"] for r in same)


def test_versions_share_what_they_do_not_copy():
    leaves = [h(str(i)) for i in range(100)]
    tree = merkle_manifest.Tree(leaves, merkle_manifest.depth(100))
    before = [list(nodes) for nodes in tree.levels]
    copies = merkle_manifest.copied("other", list(tree.path(42)))
    changed = merkle_manifest.Tree([*leaves[:42], "other", *leaves[43:]], 3)
    assert copies == [changed.levels[n][42 // 8**n] for n in range(4)] and tree.levels == before
    assert merkle_manifest.copied(leaves[42], list(tree.path(42)))[-1] == tree.root


# 13


def longest_first(sizes, shards):
    """Loads of the shards, and how many groups of each size each takes, one group at a time."""
    loads, taken = [0] * shards, defaultdict(Counter)
    for s in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += s
        taken[s][k] += 1
    return loads, taken


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 70), max_size=12), st.integers(1, 9), st.integers(0, 5000))
def test_whole_turns_are_what_single_steps_are(counts, shards, huge):
    if huge:
        counts = counts | {huge + 100: 1}
    want_loads, want = longest_first([s for s, c in counts.items() for _ in range(c)], shards)
    loads = sharding.Loads(shards)
    got = {s: loads.deal(s, counts[s]) for s in sorted(counts, reverse=True)}
    assert got == {s: dict(c) for s, c in want.items()}
    assert sorted((k, load) for load, k in loads.heap) == list(enumerate(want_loads))


def test_a_billion_groups_of_a_size_are_dealt_at_once():
    loads = sharding.Loads(8)
    loads.deal(10**12, 1)
    assert sum(loads.deal(7, 10**9).values()) == 10**9
    assert max(x for x, _ in loads.heap[1:]) <= 10**12


@pytest.mark.parametrize("hot", [10_000, 3])
def test_shards(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "HOT_GROUPS", hot)
    rng = np.random.default_rng(3)
    rows = [*ODD, *((100 + i, "x" * int(rng.integers(0, 40))) for i in range(200)), *((500 + i, "many copies of this") for i in range(60))]
    got = sharding.shard(docs(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += size(t)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert [loads[k] for k in range(8)] == longest_first(groups.values(), 8)[0]
    together = defaultdict(set)
    for r in got:
        together[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    for k in range(8):
        own = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == k)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_shards_of_nothing(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharding.shard(docs(spark, [(1, "x")] * 3)).orderBy("slot").collect()] == [(0, 0), (0, 1), (0, 2)]


def test_shards_are_near_equal(spark):
    found = sharding.op13_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r["n"] for r in found]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 1000
