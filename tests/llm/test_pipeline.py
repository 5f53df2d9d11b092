"""Each stage of the pipeline against brute force on its own input, and on tables of odd rows."""

import corpus_pipeline as cp
from test_cases import LONG, components_by_brute_force, plain_measure

from atomloom.llm import toxicity
from atomloom.llm.common import materialise

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(cp.COLUMNS)
    held = [docs]
    for name, stage in cp.STAGES:
        held.append(materialise(stage(spark, held[-1], SF), f"test-{name}"))
        if name != "packing":
            assert held[-1].columns == cp.COLUMNS
    rows = [{r["doc_id"]: r for r in x.collect()} for x in held[:-1]]
    assert [len(r) for r in rows] == [x.count() for x in held[:-1]]

    base = {d for d, r in rows[0].items() if (m := plain_measure(r["text"]))[0] >= 50 and 2 * m[5] <= m[0]}
    assert set(rows[1]) <= base and len(rows[1]) > 0.9 * len(base)

    model = toxicity.fit(held[1], spark.read.parquet(f"{SF}/labels.parquet"))
    graded = {r["doc_id"]: r["grade"] for r in toxicity.grade(held[1], model).collect()}
    assert set(rows[2]) == {d for d, g in graded.items() if not g}

    first = {}
    key = lambda line: line.encode().strip().lower().decode()
    for d in sorted(rows[2]):
        for line in rows[2][d]["text"].split("\n"):
            first.setdefault(key(line), d)
    for d, r in rows[2].items():
        want = "\n".join(line for line in r["text"].split("\n") if len(key(line)) < 10 or first[key(line)] == d)
        assert rows[3][d]["text"] == want and rows[3][d]["n_chars"] == len(want)

    linked = components_by_brute_force([(d, r["text"]) for d, r in rows[3].items()], cp.NEAR_WORDS, cp.NEAR_PERCENT)
    assert set(rows[4]) == {d for d, (_, c) in linked.items() if c == d}

    packed = held[5].collect()
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
    assert sizes == {d: len(r["text"].encode()) + 1 for d, r in rows[4].items()}
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, packed))


def test_stages_on_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, words, "en", "s", 1), (3, words, "en", "s", 1), (4, words + " x", "en", None, 1), (None, words, "en", "s", 1), (6, LONG, "en", "s", 1)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, SCHEMA)
        for _, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= max(len(table), 20)
    kept = cp.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 3, 4]
    near = cp.jaccard_join(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 2, 3, 3, 6]
