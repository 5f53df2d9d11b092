"""Merkle manifest of a dataset: a digest of every row, of every part and of the whole, and a proof for each row.

Rows are leaves, ordered by doc_id within their language. A tree is built in aligned blocks, each
of which a task reduces to one node, so that rounds of blocks over blocks reach the root. A
tampered leaf makes a version of its block that copies the ancestors of the leaf and shares all
other nodes; above the block the version goes on over what the upper rounds send down: the
siblings on the block's way to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import Scratch, materialise, numbered

ARITY = 8
#: Levels that one round of blocks takes; a block holds ARITY ** LEVELS nodes at most.
LEVELS = 4
BLOCK = ARITY**LEVELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "path array<struct<before:string,after:string>>"
_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves, until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Tree:
    """The nodes of one block, level by level from its leaves up; never changed."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> Iterator[tuple[str, str]]:
        """What stands before and after the way up from leaf ``at``, in its run of each level."""
        for nodes in self.levels[:-1]:
            first = at - at % ARITY
            yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + ARITY])
            at //= ARITY


def copied(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version with ``node`` at the foot of ``path`` does not share: copies of its ancestors, the root last."""
    out = [node]
    for before, after in path:
        out.append(digest(f"{before}{out[-1]}{after}"))
    return out


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digests(docs: DataFrame, *, tamper_every: int = 3) -> DataFrame:
    """(tree, doc_id, leaf, tampered) of ``docs``: digests as bytes; ``tampered`` is null where nothing is tampered with."""

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*(_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256))

    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
    lower = F.translate("text", _UPPER, _LOWER)
    # A name that sorts as its language does, null first, and is never null.
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(chosen, leaf(lower)).alias("tampered"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, place, n, node) from ``nodes`` up to the one with a root a tree; n is the number of leaves of the tree."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0

    def reduce(done: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            n = table.column("n")[0].as_py()
            levels = min(LEVELS, max(0, depth(n) - done))
            root = Tree([x.hex() for x in table.column("node").to_pylist()], levels).root
            return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "n": [n], "node": [bytes.fromhex(root)]})

        return run

    for done in range(0, depth(most), LEVELS):
        below = out[-1].select("tree", F.floor(F.col("place") / BLOCK).alias("block"), "place", "n", "node")
        out.append(materialise(below.groupBy("tree", "block").applyInArrow(reduce(done), "tree string, place long, n long, node binary"), "merkle-nodes"))
    return out


def _block_tree(own: pa.Table, done: int) -> Tree:
    return Tree([x.hex() for x in own.column("node").to_pylist()], min(LEVELS, max(0, depth(own.column("n")[0].as_py()) - done)))


def _by_block(below: DataFrame, above: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each block of ``below`` together with the one row of ``above`` that is its node."""
    left = below.withColumn("block", F.floor(F.col("place") / BLOCK))
    right = above.withColumnRenamed("place", "block")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(run, schema)


def _paths(rounds: list[DataFrame], top: DataFrame, down_to: int) -> DataFrame:
    """(tree, place, path, subroot, root) of the nodes of round ``down_to``, from ``top``, the same of the last one's nodes."""

    def extend(done: int):
        def run(own: pa.Table, above: pa.Table) -> pa.Table:
            own = own.sort_by("place")
            tree, upper = _block_tree(own, done), [(p["before"], p["after"]) for p in above.column("path")[0].as_py()]
            paths = [[dict(zip(("before", "after"), p)) for p in [*tree.path(i), *upper]] for i in range(len(own))]
            same = lambda name: pa.array([above.column(name)[0].as_py()] * len(own), pa.string())
            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            return pa.table({"tree": own.column("tree"), "place": own.column("place"), "path": pa.array(paths, kind), "subroot": same("subroot"), "root": same("root")})

        return run

    for r in range(len(rounds) - 2, down_to - 1, -1):
        top = materialise(_by_block(rounds[r], top, extend(r * LEVELS), f"tree string, place long, {_PATH}, subroot string, root string"), "merkle-paths")
    return top


def _proved(own: pa.Table, above: pa.Table) -> pa.Table:
    own = own.sort_by("place")
    tree, upper = _block_tree(own, 0), [(p["before"], p["after"]) for p in above.column("path")[0].as_py()]
    tail = "".join(b + a for b, a in upper)
    root = above.column("root")[0].as_py()
    proofs, folded = [], []
    for i, (leaf, tampered) in enumerate(zip(tree.levels[0], own.column("tampered").to_pylist())):
        path = list(tree.path(i))
        proofs.append(digest("".join(b + a for b, a in path) + tail))
        folded.append(copied(leaf if tampered is None else tampered.hex(), path + upper)[-1])
    same = lambda value: pa.array([value] * len(own), pa.string())
    return pa.table({
        "doc_id": own.column("doc_id"), "leaf": tree.levels[0], "subroot": same(above.column("subroot")[0].as_py()), "root": same(root),
        "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
    })


def manifest(docs: DataFrame, *, tamper_every: int = 3) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; others are ignored), one row for each of theirs.

    A leaf is the SHA-256 of its five values, each with its length, ``-`` if null; bytes of texts
    count as they are. Every 8 nodes in a row become one, until one is left: the subroot of a
    language, and likewise over the subroots the root. ``proof_sha256`` is the digest of all
    siblings from the leaf to the root. A row whose doc_id's CRC-32 is divisible by
    ``tamper_every`` is tampered with, its text's A-Z lower-cased: ``folded_root`` is the root of
    the version that holds only this leaf, or of the leaf as it is for any other row, and
    ``verified`` says whether that is the root.

    Rows of one doc_id follow each other by leaf; a null doc_id comes first and is not tampered
    with, a null language is the first tree. Empty and very long texts are leaves as any other. An
    empty table gives an empty one. Languages of any size are numbered in ranges, and blocks hold
    at most 4096 nodes, so no task grows with the table; texts are read once and never move.
    """
    with Scratch() as scratch:
        leaves = numbered(leaf_digests(docs, tamper_every=tamper_every), ["tree"], ["doc_id", "leaf"], "merkle-leaves")
        leaves = materialise(leaves.withColumnRenamed("leaf", "node"), "merkle-placed")
        rounds = _rounds(leaves.select("tree", "place", "n", "node"))
        subroots = numbered(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["tree"], ["name"], "merkle-names")
        subroots = materialise(subroots, "merkle-subroots")
        top = _rounds(subroots.select("tree", "place", "n", "node"))
        ends = top[-1].select(
            "tree", "place", F.array().cast("array<struct<before:string,after:string>>").alias("path"),
            F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("node")).alias("root"),
        )
        ways = _paths(top, ends, 0).join(subroots.select("place", "name", F.lower(F.hex("node")).alias("own")), "place")
        ways = ways.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("own").alias("subroot"), "root")
        out = materialise(_by_block(leaves, _paths(rounds, ways, 1), _proved, _OUT), "merkle-manifest")
        scratch.keep(out)
    return out


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 of the bytes of a text in SQL, by the table of its polynomial; {0} is the text.
CRC_TABLE = """(SELECT list(c ORDER BY n) FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n)))"""
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, x: xor(c // 256, tab[(xor(c % 256, x) + 1)::INT])), 4294967295)"""

_VALUE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HASH = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

ORACLE = f"""
WITH RECURSIVE k AS (SELECT {CRC_TABLE} AS tab),
leaf AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_HASH.format("text")} AS leaf,
    CASE WHEN {CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {_HASH.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents, k),
placed AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
up(tree, level, place, node, n) AS (
  SELECT tree, 0, place, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY tree, level, place // 8, n),
sub AS (SELECT tree, node AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, place, node, n) AS (
  SELECT 0, place, subroot, n FROM sub
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, place // 8, n),
fold(id, tree, level, place, node, proof) AS (
  SELECT id, tree, 0, place, coalesce(tampered, leaf), '' FROM placed
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.place // 8, sha256(string_agg(CASE WHEN e.place = f.place THEN f.node ELSE e.node END, '' ORDER BY e.place)),
    any_value(f.proof) || coalesce(string_agg(e.node, '' ORDER BY e.place) FILTER (WHERE e.place <> f.place), '')
  FROM fold f JOIN up e ON e.tree = f.tree AND e.level = f.level AND e.place // 8 = f.place // 8 AND e.n > 1 GROUP BY f.id, f.tree, f.level, f.place // 8),
rest(id, level, place, node, proof) AS (
  SELECT f.id, 0, s.place, f.node, f.proof FROM fold f JOIN sub s ON s.tree = f.tree AND s.height = f.level
  UNION ALL
  SELECT f.id, f.level + 1, f.place // 8, sha256(string_agg(CASE WHEN e.place = f.place THEN f.node ELSE e.node END, '' ORDER BY e.place)),
    any_value(f.proof) || coalesce(string_agg(e.node, '' ORDER BY e.place) FILTER (WHERE e.place <> f.place), '')
  FROM rest f JOIN top e ON e.level = f.level AND e.place // 8 = f.place // 8 AND e.n > 1 GROUP BY f.id, f.level, f.place // 8)
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, sha256(r.proof) AS proof_sha256, r.node AS folded_root, r.node = t.node AS verified
FROM placed p JOIN sub s USING (tree) JOIN top t ON t.n = 1 JOIN rest r ON r.id = p.id AND r.level = t.level
"""
