"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator; brute force beside them."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomloom.llm import chat_format, components, jaccard_join, license_scan, line_dedup, packing, piece_codec, quality_rules, token_files, topk_search, toxicity

SCHEMA = "doc_id long, text string, source string, n_lines string, key string, host string, kept string"
LONG = "a very long text " * 20_000


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source), with columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one two three"), (5, "one two three"), (None, "one two three"), (7, "Ünïcode — 日本語 \U0001f600\nx\x00y")]


# 1


def test_license_scan(spark):
    header = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nAn own line.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
    swapped = "\n".join(reversed(header.strip().split("\n")))
    rows = [*ODD, (10, header), (11, swapped), (12, "text. Released under the MIT License. more"), (13, "released   UNDER the mit license\nReleased under the MIT License"), (13, "released   UNDER the mit license\nReleased under the MIT License")]
    got = sorted(map(tuple, license_scan.scan(docs(spark, rows)).collect()))
    assert got == [
        (10, "apache-header", "Apache-2.0", 0, 3), (10, "apache-notice", "Apache-2.0", 0, 0), (11, "apache-notice", "Apache-2.0", 3, 3),
        (12, "mit-notice", "MIT", 1, 1), (13, "mit-notice", "MIT", 0, 0),
    ]
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_scan_of_wrapped_texts(spark):
    import textwrap

    table, at = license_scan.SENTENCES, {rule: ids for rule, _, ids in license_scan.RULES}
    wrap = lambda rule, mark: "\n".join(textwrap.fill(table[i][-1] + ("." if i != "apache-notice" else ";"), 75, initial_indent=mark, subsequent_indent=mark) for i in at[rule])
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by law"
    banner = "*" * 3000 + " Released under the " + " " * 3000 + "MIT License " + "*" * 3000
    rows = [
        (1, wrap("mit-text", " * ")), (2, wrap("gpl3-header", "")), (3, "Copyright X\r\n\r\n" + wrap("bsd-2-text", "   ")), (4, apache), (5, banner),
        (6, "Copyright 2020 X. All rights reserved."), (7, "All\nrights reserved"), (8, "Not released under the\nMIT License"), (9, "Released under the\nMIT License in part"),
        # A sentence is behind another only where it begins after the other's end.
        (10, "you may not use this file except in compliance with the License\nLicensed under the Apache License,\nVersion 2.0"),
    ]
    got = {(r["doc_id"], r["rule_id"]): (r["first_sentence"], r["last_sentence"]) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert set(got) == {(1, "mit-text"), (2, "gpl3-header"), (3, "bsd-2-text"), (4, "apache-header"), (4, "apache-notice"), (5, "mit-notice"), (6, "reserved-notice"), (7, "reserved-notice"), (10, "apache-notice")}
    assert got[4, "apache-header"] == (0, 4) and got[4, "apache-notice"] == (0, 0) and got[7, "reserved-notice"] == (0, 1) and got[10, "apache-notice"] == (1, 2)
    assert got[1, "mit-text"] == (0, rows[0][1].count("\n")) and got[3, "bsd-2-text"][0] == 1
    same = {"twice": ["a b a"]}
    assert [tuple(r)[3:] for r in license_scan.scan(docs(spark, [(1, "a\nb\na\nb\na")]), sentences=same, rules=[("r", "L", ["twice", "twice"])]).collect()] == []
    assert [tuple(r)[3:] for r in license_scan.scan(docs(spark, [(1, "a\nb\na\na\nb\na")]), sentences=same, rules=[("r", "L", ["twice", "twice"])]).collect()] == [(0, 5)]
    assert license_scan.scan(docs(spark, rows), sentences={}).count() == 0


def test_public_licence_headers(spark):
    """Wrapped and commented as they stand in files."""
    gpl2 = "/*\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL"
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs(spark, [(1, gpl2), (2, mpl), (3, isc)])).collect()}
    assert got == {(1, "GPL-2.0"), (2, "MPL-2.0"), (3, "ISC")}


# 2


def plain_measure(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(re.search(r"[^\x20\x09-\x0D]", line) is not None and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x1c ", max_size=60))
def test_measures_by_brute_force(text):
    assert quality_rules.measure(text.encode()) == plain_measure(text)


def test_quality_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}***" for i in range(60)) + "\n" + "\n".join(["same line"] * 80)
    rows = [*ODD, *((100 + i, f"{good} {i}", "fine") for i in range(20)), *((200 + i, "short", "bad") for i in range(40)), (300, good, "bad"), (400, junk, "fine"), (500, good, None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert all(got[100 + i]["kept"] for i in range(20)) and got[500]["kept"]
    assert got[300]["host_verdict"] == "blocked" and not got[300]["base_failed"] and not got[300]["kept"]
    assert not got[400]["kept"] and got[1]["n_words"] == 0 and not got[2]["kept"] and not got[None]["kept"]
    assert quality_rules.judge(docs(spark, rows)).count() == len(rows)
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_many_hosts_take_the_salted_way(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(60)), f"h{i % 3}") for i in range(30)]
    few = sorted(map(tuple, quality_rules.judge(docs(spark, rows)).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality_rules.judge(docs(spark, rows)).collect())) == few


# 3


def test_layouts_become_the_same_turns(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi <|end|> & [INST]"},{"role":"assistant","content":"a\\nb"}]}',
        '{"conversations":[{"from":"human","value":"hi <|end|> & [INST]"},{"from":"gpt","value":"a\\nb"}]}',
        '{"prompt":"hi <|end|> & [INST]","response":"a\\nb"}',
        '{"instruction":"hi <|end|> & [INST]","output":"a\\nb"}',
        '{"instruction":"hi <|end|> & [INST]","input":"","output":"a\\nb"}',
        '{"prompt":"q","response":null,"system":"s"}',
        '{"other":1}', '{"messages":[]}', "[1]", None,
        '{"messages":[{"role":null,"content":null}]}',
    ]
    df = spark.createDataFrame([(i, r, "t", "u") for i, r in enumerate(records)], "id int, json string, formatted string, _turns string")
    out = chat_format.format_chats(df.withColumn("record", F.try_parse_json("json")))
    rows = out.select("id", "layout", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).orderBy("id").collect()
    want = [("user", "hi <|end|> & [INST]"), ("assistant", "a\nb")]
    for r in rows[:5]:
        assert list(map(tuple, r["turns"])) == want and r["loss"] == "a\nb" and "[INST]" not in r["formatted"]
    assert [r["layout"] for r in rows] == ["messages", "shared", "prompt", "instruction", "instruction_input", "system_prompt", None, None, None, None, "messages"]
    assert list(map(tuple, rows[5]["turns"])) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert all(r["turns"] == [] and r["formatted"] == "" and r["loss"] == "" for r in rows[6:10])
    assert list(map(tuple, rows[10]["turns"])) == [("", "")]
    assert out.count() == len(records) and chat_format.format_chats(df.limit(0).withColumn("record", F.try_parse_json("json"))).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["&lt;|", "&amp;lt;", "<|<|", "<<|end|>", "</s><s>", "[[/INST]", "&#91;INST]", "&", "", "<<SYS>><</SYS>>", "\U0001f600<|end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat_format.CONTROL)


def test_turns_tie_and_lack_values(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x")]
    packed = chat_format.format_chats(chat_format.pack_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r["turns"] for r in packed.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert list(map(tuple, got[1])) == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")] and list(map(tuple, got[None])) == [("user", "x")]


def test_members_that_no_layout_knows(spark):
    """They do not matter; records of no layout, or of several, are counted by their null layout."""
    records = [
        '{"messages":[{"role":"user","content":"a","name":"x"},{"role":"assistant","content":"b"}]}',
        '{"id":7,"meta":{"k":[1,2]},"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b","weight":1}]}',
        '{"prompt":5,"response":"b","tags":["t"]}',
        '{"question":"a","answer":"b","source":{"url":"u"}}',
        '{"prompt":"a","response":"b","messages":[{"role":"user","content":"a"}]}',
        '{"text":"a"}',
        "{}",
        '{"messages":[]}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "i int, json string").select("i", F.expr("parse_json(json)").alias("record"))
    got = {r["i"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat_format.format_chats(df).select("i", "layout", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    two = lambda a: [("user", a), ("assistant", "b")]
    assert got == {0: ("messages", two("a")), 1: ("shared", two("a")), 2: ("prompt", two("5")), 3: ("question", two("a")), 4: (None, []), 5: (None, []), 6: (None, []), 7: (None, [])}


# 4


@pytest.mark.parametrize("copies, cells", [(0, {"shard_vectors": 100}), (150, {"shard_vectors": 8, "cell_queries": 1})])
def test_top_k_by_brute_force(spark, copies, cells):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[:copies] = x[0]  # ties
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]
    rows += [(700, None, 1), (800, [1.0] * 7 + [float("nan")], 1), (900, [1.0] * 7 + [None], 1), (1000, [float("inf")] * 8, 1), (1100, [1.0, 2.0], 1), (1200, [], 1), (None, [1.0] * 8, 1), (500, rows[500][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")
    got = {}
    for r in topk_search.top_k(df, **cells).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    for q in range(0, 600, 100):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(600) if i != q)[:10]
        assert got.pop(q) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got
    assert topk_search.top_k(df.limit(0)).count() == 0
    assert topk_search.top_k(df.filter("vec_id < 4 OR vec_id = 1100")).count() == 3  # fewer candidates than k


def test_top_k_of_one_row_many_times(spark):
    rows = spark.range(3000).selectExpr("if(id < 2900, 7, id) AS vec_id", "array(double(if(id < 2900, 1, 2)), 0D) AS embedding")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk_search.top_k(rows.filter("vec_id = 7 OR vec_id IN (2900, 2901)"), k=4, shard_vectors=1).orderBy("rank").collect()]
    assert got == [(2900, 2901, 4 * 1024**2), *[(2900, 7, 2 * 1024**2)] * 3]


def test_top_k_of_huge_components_and_repeated_rows(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [3e38, 2.0]), (3, [1e18, 5.0]), (4, [-3e38, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 7.0]), (5, [0.0, 7.0])]
    got = {}
    for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    top, low = 2**63 - 1, -(2**63)
    # Of two beyond the longs the larger stays first, though both are returned as the largest.
    assert got == {0: [(1, top), (2, top), (3, top), (5, 7 * 1024 * 1024), (5, 7 * 1024 * 1024), (5, 1024 * 1024), (4, low)]}


# 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_packing_holds_its_promises(lengths):
    lengths = sorted(lengths, reverse=True)
    placed, sizes = packing.pack(lengths, (20, 50, 100))
    used = Counter()
    for (b, at), n in zip(placed, lengths):
        assert at == used[b]
        used[b] += n
    assert all(used[b] <= c and all(used[b] > s for s in (20, 50, 100) if s < c) for b, c in enumerate(sizes))
    assert len({b for b, _ in placed}) == len(sizes)


@pytest.mark.parametrize("capacity", [64, 100])
def test_best_fit_by_brute_force(capacity):
    """With one size: each piece in the fullest bin that has room, the earliest of equals, or else in a new one."""
    rng = np.random.default_rng(capacity)
    lengths = sorted(rng.integers(1, 65, size=300).tolist(), reverse=True)
    placed, used, _ = packing.best_fit(lengths, (capacity,), (capacity,))
    bins = []
    for (b, at), n in zip(placed, lengths):
        room = [(capacity - x, k) for k, x in enumerate(bins) if x + n <= capacity]
        if room:
            assert (min(room)[0], b) == (capacity - bins[b], b) and at == bins[b]
            bins[b] += n
        else:
            assert (b, at) == (len(bins), 0)
            bins.append(n)
    assert bins == used


def test_packing_against_exhaustive_search(monkeypatch):
    monkeypatch.setattr(packing, "OVERHEAD", 4)
    monkeypatch.setattr(packing, "ATTENTION", 150)
    sizes = (20, 50, 100)

    def cheapest(lengths, bins=()):
        if not lengths:
            return sum(packing.bin_cost(next(c for c in sizes if c >= b)) for b in bins)
        n, rest = lengths[0], lengths[1:]
        joined = [cheapest(rest, (*bins[:k], b + n, *bins[k + 1 :])) for k, b in enumerate(bins) if b + n <= sizes[-1]]
        return min([cheapest(rest, (*bins, n)), *joined])

    rng, ratios = np.random.default_rng(1), []
    for _ in range(200):
        lengths = sorted((int(rng.integers(1, rng.choice([21, 61, 101]))) for _ in range(rng.integers(1, 7))), reverse=True)
        ratios.append(sum(map(packing.bin_cost, packing.pack(lengths, sizes)[1])) / cheapest(lengths))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.2 and np.mean(np.array(ratios) < 1 + 1e-9) > 0.95


def test_sizes_are_chosen_jointly_at_production_capacities(spark):
    """Larger sizes than needed are opened for filling, some bins shrink, and the mix costs less than any one size or the least fitting one."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lengths = sorted((min(r[0] + 1, 32768) for r in texts.select(F.octet_length("text")).collect()), reverse=True)
    placed, used, larger = packing.best_fit(lengths, packing.CAPACITIES, packing.CAPACITIES)
    opened = {}
    for (b, _), n in zip(placed, lengths):
        opened.setdefault(b, n)
    sizes = packing.pack(lengths, packing.CAPACITIES)[1]
    assert larger > 100 and len(set(sizes)) > 1
    shrunk = packing.pack([5000, 3000, 100], packing.CAPACITIES)
    assert shrunk[1] == [8192] or sorted(shrunk[1]) == [2048, 8192]
    least = [next(c for c in packing.CAPACITIES if c >= n) for n in lengths]
    assert sum(map(packing.bin_cost, sizes)) < 0.95 * sum(map(packing.bin_cost, least))
    assert sum(map(packing.bin_cost, sizes)) < 0.95 * packing.bin_cost(32768) * sum(lengths) / 32768


def test_packing_shrinks_bins():
    """A bin that is opened large for what seems to fill it, and is not filled, becomes a small one."""
    placed, used, larger = packing.best_fit([8100, 60], (8192,), (2048, 8192))
    assert packing.pack([1500, 400], (2048, 8192))[1] == [2048] and packing.pack([], packing.CAPACITIES) == ([], [])
    assert [c for c in packing.pack([8192, 1000], packing.CAPACITIES)[1]] == [8192, 2048]


def test_sequences_hold_all_tokens(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i == 7 else i, rng.integers(0, 1000, size=rng.integers(1, 90)).tolist()) for i in range(60)] + [(100, [])]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    placed = packing.pack_lengths(tokens.select("doc_id", F.size("ids").alias("n_tokens")), capacities=(16, 32), shard_pieces=20)
    bins = {(r["shard"], r["bin"]): r for r in packing.sequences(placed, tokens).collect()}
    found = {}
    for r in placed.collect():
        ids = bins[r["shard"], r["bin"]]["ids"]
        found.setdefault(r["doc_id"], {})[r["piece"]] = ids[r["bin_offset"] : r["bin_offset"] + r["n_tokens"]]
        assert len(ids) == sum(bins[r["shard"], r["bin"]]["lengths"]) <= r["capacity"] == bins[r["shard"], r["bin"]]["capacity"]
    assert {d: [x for k in sorted(p) for x in p[k]] for d, p in found.items()} == {d: ids for d, ids in rows if ids}


def test_packing_spreads_repeated_rows(spark):
    got = packing.pack_documents(docs(spark, [(None, "same")] * 500), capacities=(64,), shard_pieces=50)
    assert got.count() == 500 and got.groupBy("shard").count().agg(F.max("count")).first()[0] < 150


def test_pack_documents(spark):
    rows = [*ODD, *((100 + i, "x" * (i * 37 % 900)) for i in range(300))]
    got = packing.pack_documents(docs(spark, rows), capacities=(512, 1024), shard_pieces=64).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    bins = {}
    for r in got:
        bins.setdefault((r["shard"], r["bin"], r["capacity"]), []).append((r["bin_offset"], r["n_tokens"]))
    for (_, _, capacity), held in bins.items():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= capacity and not (capacity == 1024 and end <= 512)
    assert len({(s, b) for s, b, _ in bins}) == len(bins)
    filled = sum(r["n_tokens"] for r in got) / sum(c for _, _, c in bins)
    assert filled > 0.9
    assert packing.pack_documents(docs(spark, [])).count() == 0


# 6


def test_dedup_lines(spark):
    shared, short = "A shared LINE of text", "short one"
    rows = [
        (1, f"{shared}\nown line number one\n{shared}"), (2, f"  {shared.lower()}\t\nown line number two\n{short}"), (3, f"{short}\nx\n\n{shared}x"),
        (4, None), (5, ""), (6, "own line number six"), (6, "own line number six"), (None, f"{shared}\nlast"), (8, f"élève de l\n{LONG}"), (9, f"ÉLÈVE DE L\n{LONG}"),
    ]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "key", "host", "kept", "n_lines", "n_dropped"]
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert found[1] == (rows[0][1], 3, 0) and found[2] == ("own line number two\nshort one", 3, 1) and found[3] == (rows[2][1], 4, 0)
    assert found[4] == ("", 1, 0) and found[5] == ("", 1, 0) and found[6][2] == 0 and found[None] == ("last", 2, 1)
    assert found[8] == (f"élève de l\n{LONG}", 2, 0) and found[9] == ("ÉLÈVE DE L", 2, 1)  # only A-Z lose their case
    assert got.count() == len(rows) and line_dedup.dedup_lines(docs(spark, [])).count() == 0
    three = line_dedup.dedup_lines(docs(spark, rows), min_documents=3)
    assert {r["doc_id"]: r["n_dropped"] for r in three.collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, None: 1, 8: 0, 9: 0}


# 7


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["Don't STOP... <|endoftext|> l'été ÉTÉ Σας ΣΑΣ İ", "x\x1cy\x85z á ́b ﬁ", "12 3.5% a-b a_b (hi)!!", "ﬃ Å K ſ 日本語"]
    rows = [*ODD, *((20 + i, t) for i, t in enumerate(texts))]
    token_files.write_token_files(docs(spark, rows), str(tmp_path / "t"), path)
    read = token_files.read_token_files(spark, str(tmp_path / "t"))
    got = read.collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = {d: library.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows}
    assert len(got) == len(rows) and all(r["ids"] == want[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in got)
    in_files = [(r["file"], key(r)) for r in got]
    assert [k for _, k in sorted(in_files)] == sorted(k for _, k in in_files)  # files and rows ascend together
    starts = sorted(token_files.token_starts(read.select("doc_id", "n_tokens", "file")).collect(), key=lambda r: r["start"])
    assert [key(r) for r in starts] == sorted(key(r) for r in starts)
    assert [r["start"] for r in starts] == [sum(r["n_tokens"] for r in starts[:i]) for i in range(len(starts))]
    one = read.filter("doc_id = 21")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,21)]" in one._jdf.queryExecution().toString()
    token_files.write_token_files(docs(spark, []), str(tmp_path / "none"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_starts_follow_the_files_where_a_doc_id_repeats(spark, tmp_path):
    texts = ["a b c d e", "z", "b", "a much longer text than the others", "a"]
    rows = [*((1, t) for t in texts), (0, "first"), (2, "last"), (None, "b c"), (None, "a")]
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(docs(spark, rows), str(tmp_path / "t"), path)
    read = token_files.read_token_files(spark, str(tmp_path / "t"))
    found = token_files.token_starts(read).collect()
    ordered = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["place"]))
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:i]) for i in range(len(rows))]
    flat = [t for r in ordered for t in r["ids"]]
    assert all(flat[r["start"] : r["start"] + r["n_tokens"]] == r["ids"] for r in found)
    in_files = [r["ids"] for r in sorted(read.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["place"]))]
    assert in_files == [r["ids"] for r in ordered]


def test_case_is_kept_where_it_tells(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["Stop <|ENDOFTEXT|> STOP", "<|EndOfText|>", "a<|StartOfText|>B <|endoftext|> <|startoftext|>", "<|endoftext|>", "WORD<| STOP<|X|>, <|", "H\u0331a W\u030a T\u0308. Y\u030a J\u030cB E\u0301 I\u0307", "h\u0331a"]
    rows = list(enumerate(texts))
    token_files.write_token_files(docs(spark, rows), str(tmp_path / "t"), path)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    assert got == {d: library.encode(t, add_special_tokens=False).ids + [2] for d, t in rows}
    assert 49407 not in got[1] and 49407 in got[3]


def test_token_query_by_brute_force(spark):
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.op7_token_files(spark, sf_dir).collect()}
    at, want = 0, {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


# 8


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "   ", "a  b\n c  ", "▁ x▁y", "<s> </s> <0x0A>", "a" * 400 + "=" * 90, "\t\r\n x", "e.g. http://a.b/c?d=e", "日本\0語 \0"]
    rows = [*ODD, *((20 + i, t) for i, t in enumerate(texts))]
    encoded = piece_codec.encode_pieces(docs(spark, rows), path)
    want = {d: library.encode(t or "") for d, t, *_ in rows}
    got = encoded.collect()
    assert len(got) == len(rows) and all(r["ids"] == want[r["doc_id"]] for r in got)
    assert all(r["text"] == library.decode(want[r["doc_id"]]) for r in piece_codec.decode_pieces(encoded, path).collect())
    assert piece_codec.encode_pieces(docs(spark, []), path).count() == 0
    sf_dir = "/root/testdata/sf0.001"
    for r in piece_codec.op8_sentencepiece(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect():
        ids = library.encode(r["text"])
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 8))
def test_suffix_array(codes, depth):
    got = piece_codec.suffix_array(np.array(codes, np.uint32), depth)
    assert [codes[i : i + depth] for i in got] == sorted(codes[i : i + depth] for i in range(len(codes)))


# 9


def components_by_brute_force(rows, n, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("n, percent, seed", [(4, 85, 0), (5, 80, 1), (4, 85, 2), (2, 80, 3)])
def test_components_by_brute_force(spark, n, percent, seed):
    """Families of near copies of all sizes, edited more and less, so that pairs fall on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One Two\tthree"), (8, "a b c d"), (9, "a b c d e")]
    for size in (5, 7, 9, 14, 25, 60, 200, 900):
        base = [f"w{rng.integers(400)}" for _ in range(size)]
        for k in range(14):
            words = list(base)
            for _ in range(int(rng.integers(0, 2 + size // 40))):
                at = int(rng.integers(len(words)))
                words[at : at + 1] = [[], ["new"], [words[at], "more"]][int(rng.integers(3))]
            rows.append((len(rows) + 10, " ".join(words)))
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    df = docs(spark, [*shuffled, shuffled[0]])
    got = jaccard_join.link_documents(df, n=n, percent=percent)
    assert got.count() == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components_by_brute_force(rows, n, percent)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.link_documents(docs(spark, [])).count() == 0
    assert {r["component_id"] for r in jaccard_join.link_documents(docs(spark, [(1, None), (2, ""), (None, "a b c d e f")])).collect()} == {1, 2, None}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=120), st.sets(st.integers(0, 2**64 - 1), max_size=12), st.integers(0, 12), st.sampled_from([80, 85, 95]))
def test_linked_sets_share_a_signature(common, extra, less, percent):
    """The pigeonhole: any two unlike sets that link meet in a signature."""
    a, b = set(common), set(sorted(common)[less:]) | extra
    if a != b and b and 100 * len(a & b) >= percent * len(a | b):
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        segmenter = jaccard_join.Segmenter(percent)
        assert set(segmenter.signatures(x).tolist()) & set(segmenter.signatures(y).tolist())


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_size_classes(percent):
    """Linked sets are of the same class or of neighbouring ones."""
    segmenter = jaccard_join.Segmenter(percent)
    for size in [*range(1, 300), 5000, 123_456]:
        assert segmenter.low(k := segmenter.size_class(size)) <= size < segmenter.low(k + 1)
        assert segmenter.size_class(100 * size // percent) - k <= 1


def test_a_large_family_of_near_copies(spark):
    """Thousands of unlike near copies, exact copies beside them, and a stranger that shares most of their words."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(3000):
        words = list(base)
        for at in rng.integers(0, 300, size=2):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((k + 10, " ".join(words)))
    rows += [(5, "cold " + " ".join(base[:150])), *((9000 + k, " ".join(base)) for k in range(500))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(docs(spark, rows)).collect()}
    assert got[5] == 5 and {c for d, c in got.items() if d != 5} == {10}


def test_line_dedup_beyond_the_broadcast(spark, monkeypatch):
    """The salted join gives what the broadcast gives, with a line that all documents share."""
    rows = [(i, f"a line that all share\nanother line {i % 40} of some\nits own line {i} alone") for i in range(300)]
    few = sorted(map(tuple, line_dedup.dedup_lines(docs(spark, rows)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs(spark, rows)).collect())) == few


def test_bytes_that_are_no_utf8(spark):
    """They count as U+FFFD everywhere."""
    df = docs(spark, [(1, ""), (2, "good words here"), (3, "x")])
    broken = df.withColumn("text", F.when(F.col("doc_id") == 1, F.expr("cast(X'61FF6220C3' AS STRING)")).otherwise(F.col("text")))
    fixed = df.withColumn("text", F.when(F.col("doc_id") == 1, "a\ufffdb \ufffd").otherwise(F.col("text")))
    runs = [
        quality_rules.judge,
        line_dedup.dedup_lines,
        jaccard_join.link_documents,
        lambda d: toxicity.grade(d, toxicity.OrdinalModel({"good": 1.0}, (0.5,))),
        lambda d: piece_codec.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model")),
        license_scan.scan,
    ]
    for run in runs:
        assert sorted(map(str, run(broken).collect())) == sorted(map(str, run(fixed).collect()))


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4050)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (7, None), (None, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components.connected_components(df.limit(0)).count() == 0


# 10


def test_ordinal_regression_recovers_the_order():
    rng = np.random.default_rng(0)
    true = rng.normal(size=30)
    rows = [sorted(rng.choice(30, size=6, replace=False).tolist()) for _ in range(3000)]
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = np.digitize(score, [-1.0, 1.0, 3.0])
    w, cuts = toxicity.fit_ordinal(rows, grades, 30, 4)
    assert np.all(np.diff(cuts) > 0) and np.corrcoef(w, true)[0, 1] > 0.97


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(table, labels.filter("doc_id % 5 <> 0"))
    held = toxicity.grade(table, model).join(labels.filter("doc_id % 5 = 0"), "doc_id")
    counts = {(r["toxic"], r["found"]): r["count"] for r in held.groupBy("toxic", (F.col("grade") > 0).alias("found")).count().collect()}
    caught, missed = counts.get((1, True), 0), counts.get((1, False), 0)
    assert caught / (caught + missed) > 0.85 and counts.get((0, True), 0) <= 0.01 * counts[(0, False)]
    assert list(model.cuts) == sorted(model.cuts)


def test_toxicity_cases(spark):
    rows = [*ODD, *((100 + i, f"plain words number {i} stand here") for i in range(40)), *((200 + i, f"You IDIOT! scum number {i} stand here") for i in range(40))]
    labels = spark.createDataFrame([*((100 + i, 0, 1) for i in range(40)), *((200 + i, 1, 1) for i in range(40)), (None, 1, 1), (5, None, 1), (7, 3, 1), (999, 1, 1)], "doc_id long, toxic int, text int")
    df = docs(spark, rows)
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.grade(df, model).collect()}
    assert all(got[200 + i]["grade"] > 0 and got[100 + i]["grade"] == 0 for i in range(40)) and got[1]["grade"] == 0
    assert got[200]["expected_severity"] > 0.5 and toxicity.grade(df, model).count() == len(rows)
    none = toxicity.fit(df, labels.filter("toxic = 0"))
    assert none.cuts == () and {r["grade"] for r in toxicity.grade(df, none).collect()} == {0}
    assert toxicity.grade(docs(spark, []), model).count() == 0 and toxicity.fit(docs(spark, []), labels.limit(0)).weights == {}


def test_parts_are_packed_whatever_the_number_of_fragments(spark):
    """What is shuffled to find pairs has a row for each fragment of a batch, not for each document and fragment; the pairs are the same."""
    texts = [" ".join(f"w{(i * 7 + k * (i // 3 * 11 + 1)) % 997}" for k in range(200)) + (" end" if i % 3 else "") for i in range(300)]
    batch = pa.record_batch([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"])
    packed = {}
    for fragments in (4, 256):
        sketches = [b.append_column("component", pa.nulls(b.num_rows, pa.int64())) for b in jaccard_join._sketcher(4, 85, fragments)(iter([batch]))]
        rows = pa.Table.from_batches(sketches).combine_chunks().to_batches()
        packed[fragments] = list(jaccard_join._packed(iter(rows)))
        assert sum(b.num_rows for b in packed[fragments]) <= fragments
        assert sum(len(b.column("set_key").flatten()) for b in packed[fragments]) == sum(len(p) for p in rows[0].column("parts").to_pylist())
    found = [{frozenset((r["a_key"], r["b_key"])) for b in jaccard_join._pairer(85, False)(iter(p)) for r in b.to_pylist()} for p in packed.values()]
    assert found[0] and {k for pair in found[0] for k in pair} == {k for pair in found[1] for k in pair}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = [sorted(map(tuple, jaccard_join.link_documents(docs, fragments=f).collect())) for f in (4, 256)]
    assert links[0] == links[1] and any(c != d for d, _, c in links[0])
