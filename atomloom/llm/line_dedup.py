"""Line dedup: drop the lines that several documents share, but for the first document's.

Lines are exploded as hashes of their normalised form, counted by distinct documents per hash,
and each document is put together again by position without the lines over the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from atomloom.llm.common import BROADCAST_ROWS, materialise, utf8, valid_text

MIN_KEY_CHARS = 10
MIN_DOCUMENTS = 2
#: Parts into which a shared line's documents are dealt where shared lines are not broadcast.
SALTS = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None where the key is shorter than ``min_chars`` code points.

    bytes.strip and bytes.lower touch the ASCII white space and A-Z alone.
    """
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _keys(min_chars: int):
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                own = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], schema=out)

    return run


def _rebuild(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, shared in zip(utf8(batch.column("text")), batch.column("shared_keys").to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if shared:
                    shared = set(shared)
                    lines = [line for line in lines if line_key(line, min_chars) not in shared]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.record_batch(
                [
                    *(batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("text", "shared_keys")),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                ],
                names=[*(n for n in batch.schema.names if n not in ("text", "shared_keys")), "text", "n_lines", "n_dropped"],
            )

    return run


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` (doc_id long, text string, other columns) without repeated lines.

    A key of ``min_chars`` code points or more that at least ``min_documents`` documents hold
    loses its lines everywhere but in the smallest doc_id that holds it. Returns the columns of
    ``docs``, with ``text`` cut, and ``n_lines`` (before) and ``n_dropped``.

    A null or empty text is one empty line, and comes back as an empty text. Repeated rows of one
    doc_id count as one document and are cut alike. A null doc_id counts as a document after all
    others, whose lines are compared as any other's. An empty table gives an empty one. Columns
    of ``docs`` named n_lines, n_dropped or shared_keys are replaced.

    The shuffles move one hash per document and distinct line, aggregated before they move, and
    each text once. Shared lines meet the documents by broadcast if they are few, and else in a
    join in which each line's documents are dealt to SALTS parts, so a very common line is no hot
    spot. Bytes that are no UTF-8 count, and come back, as U+FFFD.
    """
    docs = docs.drop("n_lines", "n_dropped", "shared_keys").withColumn("text", valid_text("text"))
    last = 2**63 - 1
    keys = docs.select(F.coalesce("doc_id", F.lit(last)).alias("doc_id"), "text").mapInArrow(_keys(min_chars), "doc_id long, key binary")
    if min_documents == 2:
        held = F.min("doc_id") < F.max("doc_id")
    else:
        held = F.count_distinct("doc_id") >= min_documents
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("first_doc"), held.alias("held")).filter("held").select("key", "first_doc")
    shared = materialise(shared, "shared-lines")
    if shared.count() <= BROADCAST_ROWS:
        met = keys.join(F.broadcast(shared), "key")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    dropped = met.filter(F.col("doc_id") > F.col("first_doc"))
    by_doc = dropped.groupBy("doc_id").agg(F.collect_set("key").alias("shared_keys")).withColumnRenamed("doc_id", "_doc")
    rows = docs.join(by_doc, F.coalesce(docs["doc_id"], F.lit(last)) == by_doc["_doc"], "left").drop(by_doc["_doc"])
    schema = StructType([*(f for f in docs.schema if f.name != "text"), StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return rows.mapInArrow(_rebuild(min_chars), schema).select(*docs.columns, "n_lines", "n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id > s.first_doc AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
